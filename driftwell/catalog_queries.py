"""Queries of the catalog frames and the statements made from them, over system tables derived from the given ones.

Each system table is one SELECT that both engines run: parts are relations, line numbers
their columns, customers routines, orders triggers and policies, suppliers types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import definitions as D
from .functions import names as N
from .functions import statements as S
from .operators import bulk_copy, catalog, drift, key_ranges, sequences, status
from .operators import relations as R
from .operators.ordering import with_places
from .operators.view_meaning import ViewMeanings
from .plans import apply
from .plans.bootstrap import CopyFailed, Database, move
from .plans.evolve import EvolvingTable
from .plans.journal import Chunk, CopyJournal, chunks_of_frame
from .registry import ORACLE_SQL, query
from .sources.tables import shared_path, table

_T = lambda x: f"CAST({x} AS STRING)"
_COLUMN = "(SELECT DISTINCT l_partkey, l_linenumber FROM {lineitem})"

SYSTEM_SQL = {
    "pg_roles": "SELECT CAST(r_regionkey AS BIGINT) + 1 AS oid, r_name AS rolname FROM {region}",
    "pg_namespace": "SELECT CAST(n_nationkey AS BIGINT) AS oid, n_name AS nspname, CAST(n_regionkey AS BIGINT) + 1 AS nspowner FROM {nation}",
    "pg_database": f"SELECT p_partkey AS oid, 'db' || {_T('p_partkey')} AS datname, CAST(p_size % 5 AS BIGINT) + 1 AS datdba FROM {{part}} WHERE p_partkey % 50 = 0",
    "pg_class": f"""
      SELECT p_partkey AS oid, 't' || {_T('p_partkey')} AS relname, CAST(p_partkey % 25 AS BIGINT) AS relnamespace,
        CASE WHEN p_partkey % 11 = 0 THEN 'S' WHEN p_partkey % 13 = 0 THEN 'v' WHEN p_partkey % 17 = 0 THEN 'm' WHEN p_partkey % 7 = 0 THEN 'p' WHEN p_partkey % 19 = 0 THEN 'c' ELSE 'r' END AS relkind,
        p_partkey % 5 = 0 AS relispartition, CAST(p_size % 5 AS BIGINT) + 1 AS relowner, p_size % 4 = 0 AS relrowsecurity, p_size % 8 = 0 AS relforcerowsecurity,
        CASE WHEN p_size % 3 = 0 THEN 'd' WHEN p_size % 3 = 1 THEN 'n' ELSE 'f' END AS relreplident,
        'RANGE (' || lower(p_brand) || ')' AS partkeydef, 'FOR VALUES IN (' || {_T('p_size')} || ')' AS partbound, 'SELECT ''' || p_name || '''' AS viewdef
      FROM {{part}}
      UNION ALL SELECT p_partkey + 10000000, 'ix' || {_T('p_partkey')}, CAST(p_partkey % 25 AS BIGINT), 'i', FALSE, 1, FALSE, FALSE, 'n', '', '', '' FROM {{part}} WHERE p_partkey % 2 = 0""",
    "pg_inherits": "SELECT p_partkey AS inhrelid, (p_partkey % 9 + 1) * 7 AS inhparent FROM {part} WHERE p_partkey > 70 AND p_partkey % 7 <> 0 AND (p_partkey % 5 = 0 OR p_partkey % 6 = 0)",
    "pg_attribute": f"""
      SELECT l_partkey AS attrelid, CAST(l_linenumber AS BIGINT) AS attnum, 'c' || {_T('l_linenumber')} AS attname, (l_partkey + l_linenumber) % 4 + 1 AS atttypid,
        CASE WHEN (l_partkey + l_linenumber) % 4 = 0 THEN 'integer' WHEN (l_partkey + l_linenumber) % 4 = 1 THEN 'text' ELSE 'numeric(15,2)' END AS format_type,
        (l_partkey + l_linenumber) % 2 = 0 AS attnotnull, l_partkey % 3 AS attcollation, (l_partkey * 7 + l_linenumber) % 10 = 0 AS attisdropped,
        CASE WHEN l_linenumber = 1 AND l_partkey % 3 = 0 THEN 'a' WHEN l_linenumber = 1 AND l_partkey % 3 = 1 THEN 'd' ELSE '' END AS attidentity,
        CASE WHEN l_linenumber = 5 THEN 's' ELSE '' END AS attgenerated
      FROM {_COLUMN} c""",
    "pg_attrdef": f"""
      SELECT l_partkey AS adrelid, CAST(l_linenumber AS BIGINT) AS adnum, CASE WHEN l_linenumber % 2 = 0 THEN 'nextval(''s' || {_T('l_partkey')} || ''')' ELSE {_T('l_linenumber')} END AS expr
      FROM {_COLUMN} c WHERE (l_partkey + l_linenumber) % 3 = 0 OR l_linenumber = 5""",
    "pg_type": f"""
      SELECT s_suppkey AS oid, CASE WHEN s_suppkey % 9 = 0 THEN '_' ELSE '' END || 'ty' || {_T('s_suppkey')} AS typname, CAST(s_nationkey AS BIGINT) AS typnamespace,
        CASE WHEN s_suppkey % 4 = 0 THEN 'd' WHEN s_suppkey % 4 = 1 THEN 'c' WHEN s_suppkey % 4 = 2 THEN 'e' ELSE 'r' END AS typtype, s_suppkey * 19 AS typrelid,
        s_suppkey % 4 + 1 AS typbasetype, 'numeric(' || {_T('s_suppkey % 9 + 1')} || ',0)' AS base_format, s_suppkey % 3 AS typcollation, s_suppkey % 2 = 0 AS typnotnull,
        CASE WHEN s_suppkey % 5 = 0 THEN {_T('s_suppkey')} END AS typdefault, CAST(s_nationkey % 5 AS BIGINT) + 1 AS typowner
      FROM {{supplier}}""",
    "pg_collation": f"""
      SELECT c_custkey AS oid, 'coll' || {_T('c_custkey')} AS collname, CAST(c_nationkey AS BIGINT) AS collnamespace,
        CASE WHEN c_custkey % 3 = 0 THEN 'c' WHEN c_custkey % 3 = 1 THEN 'i' ELSE 'b' END AS collprovider, c_custkey % 2 = 0 AS collisdeterministic,
        'lc' || {_T('c_custkey % 5')} AS collcollate, 'lc' || {_T('c_custkey % 4')} AS collctype, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS colllocale,
        'icu-' || c_mktsegment AS colliculocale
      FROM {{customer}}""",
    "pg_index": f"""
      SELECT p_partkey + 10000000 AS indexrelid, p_partkey AS indrelid, p_partkey % 4 = 0 AS indisprimary, p_partkey % 3 = 0 AS indisunique,
        'CREATE INDEX ix' || {_T('p_partkey')} AS indexdef FROM {{part}} WHERE p_partkey % 2 = 0""",
    "pg_constraint": f"""
      SELECT p_partkey AS oid, 'k' || {_T('p_partkey')} AS conname, CASE WHEN p_size % 3 = 0 THEN 'p' WHEN p_size % 3 = 1 THEN 'f' ELSE 'c' END AS contype, p_partkey AS conrelid, CAST(0 AS BIGINT) AS contypid,
        CASE WHEN p_size % 3 = 1 THEN 'FOREIGN KEY (c1)' ELSE 'CHECK (c1 > ' || {_T('p_size')} || ')' END AS constraintdef FROM {{part}}
      UNION ALL SELECT c_custkey + 20000000, 'dk' || {_T('c_custkey')}, 'c', 0, c_custkey % 40, 'CHECK (VALUE > ' || {_T('c_custkey')} || ')' FROM {{customer}} WHERE c_custkey % 40 <> 0""",
    "pg_sequence": "SELECT p_partkey AS seqrelid, CAST(p_size AS BIGINT) AS seqincrement, 1 AS seqmin, 1000000 AS seqmax, p_size AS seqstart, 1 AS seqcache, p_size % 2 = 0 AS seqcycle FROM {part} WHERE p_partkey % 11 = 0",
    "pg_depend": """
      SELECT 'pg_class' AS classid, p_partkey AS objid, '' AS refclassid, CAST(0 AS BIGINT) AS refobjid, CAST(0 AS BIGINT) AS refobjsubid, 'e' AS deptype FROM {part} WHERE p_partkey % 23 = 0
      UNION ALL SELECT 'pg_class', p_partkey, 'pg_class', p_partkey + 1, 1, 'a' FROM {part} WHERE p_partkey % 22 = 0
      UNION ALL SELECT 'pg_class', p_partkey, 'pg_class', p_partkey + 1, 1, 'i' FROM {part} WHERE p_partkey % 33 = 0
      UNION ALL SELECT 'pg_proc', c_custkey, '', 0, 0, 'e' FROM {customer} WHERE c_custkey % 29 = 0
      UNION ALL SELECT 'pg_proc', c_custkey, '', 0, 0, 'i' FROM {customer} WHERE c_custkey % 31 = 0
      UNION ALL SELECT 'pg_type', s_suppkey, '', 0, 0, 'e' FROM {supplier} WHERE s_suppkey % 37 = 7
      UNION ALL SELECT 'pg_collation', c_custkey, '', 0, 0, 'e' FROM {customer} WHERE c_custkey % 43 = 0
      UNION ALL SELECT 'pg_trigger', o_orderkey, '', 0, 0, 'e' FROM {orders} WHERE o_orderkey % 41 = 0""",
    "pg_proc": f"""
      SELECT c_custkey AS oid, 'f' || {_T('c_custkey % 60')} AS proname, CAST(c_nationkey AS BIGINT) AS pronamespace,
        CASE WHEN c_custkey % 4 = 0 THEN 'f' WHEN c_custkey % 4 = 1 THEN 'p' WHEN c_custkey % 4 = 2 THEN 'a' ELSE 'w' END AS prokind,
        'CREATE OR REPLACE FUNCTION f' || {_T('c_custkey')} AS functiondef, 'x' || {_T('c_custkey')} || ' integer' AS identity_args, 'x' || {_T('c_custkey')} || ' integer' AS arguments,
        CAST(c_nationkey % 5 AS BIGINT) + 1 AS proowner, CASE WHEN c_custkey % 3 = 0 THEN 's' WHEN c_custkey % 3 = 1 THEN 'r' ELSE 'u' END AS proparallel
      FROM {{customer}}""",
    "pg_trigger": f"""
      SELECT o_orderkey AS oid, 'tr' || {_T('o_orderkey')} AS tgname, o_orderkey % 200 AS tgrelid, o_custkey AS tgfoid, o_orderkey % 10 = 0 AS tgisinternal,
        CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS tgparentid, CASE WHEN o_orderkey % 4 = 0 THEN 'O' WHEN o_orderkey % 4 = 1 THEN 'D' WHEN o_orderkey % 4 = 2 THEN 'R' ELSE 'A' END AS tgenabled,
        'CREATE TRIGGER tr' || {_T('o_orderkey')} AS triggerdef
      FROM {{orders}}""",
    "pg_policy": f"""
      SELECT 'po' || {_T('o_orderkey')} AS polname, o_orderkey % 200 AS polrelid,
        CASE WHEN o_orderkey % 5 = 0 THEN 'r' WHEN o_orderkey % 5 = 1 THEN 'a' WHEN o_orderkey % 5 = 2 THEN 'w' WHEN o_orderkey % 5 = 3 THEN 'd' ELSE '*' END AS polcmd,
        o_orderkey % 2 = 0 AS polpermissive, CASE WHEN o_orderkey % 3 <> 0 THEN 'c1 > ' || {_T('o_custkey')} END AS using_expr,
        CASE WHEN o_orderkey % 4 = 0 THEN 'c2 = ''' || o_orderpriority || '''' ELSE '' END AS check_expr, o_orderkey AS k
      FROM {{orders}}""",
    "policy_roles": "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 5 + 1 END AS role FROM {orders} WHERE o_orderkey % 7 <> 0 UNION SELECT o_orderkey, o_orderkey % 4 + 2 FROM {orders} WHERE o_orderkey % 3 = 1 AND o_orderkey % 7 <> 0",
    "pg_range": "SELECT s_suppkey AS rngtypid, 'integer' AS subtype, CASE WHEN s_suppkey % 8 = 3 THEN s_suppkey ELSE 0 END AS rngcollation, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey ELSE -1 END AS rngcanonical, s_suppkey + 1 AS rngsubdiff FROM {supplier} WHERE s_suppkey % 4 = 3",
    "pg_aggregate": f"""
      SELECT c_custkey AS aggfnoid, 'n' AS aggkind, c_custkey - 1 AS aggtransfn, CASE WHEN c_custkey % 3 = 0 THEN c_custkey - 2 ELSE -1 END AS aggfinalfn, CASE WHEN c_custkey % 5 = 0 THEN c_custkey - 1 ELSE -1 END AS aggcombinefn,
        CAST(-1 AS BIGINT) AS aggserialfn, CAST(-1 AS BIGINT) AS aggdeserialfn, CASE WHEN c_custkey % 7 = 0 THEN c_custkey - 2 ELSE -1 END AS aggmtransfn, CASE WHEN c_custkey % 7 = 0 THEN c_custkey - 1 ELSE -1 END AS aggminvtransfn,
        CAST(-1 AS BIGINT) AS aggmfinalfn, 'bigint' AS transtype, 'integer' AS mtranstype, CASE WHEN c_custkey % 4 = 2 THEN {_T('c_custkey')} END AS agginitval, CASE WHEN c_custkey % 9 = 0 THEN '0' END AS aggminitval,
        c_custkey % 6 = 0 AS aggfinalextra, FALSE AS aggmfinalextra, CASE WHEN c_custkey % 12 = 6 THEN 's' ELSE 'r' END AS aggfinalmodify, 'r' AS aggmfinalmodify, c_custkey % 11 AS aggsortop
      FROM {{customer}} WHERE c_custkey % 4 = 2""",
    "pg_extension": f"SELECT CASE WHEN p_partkey % 40 = 0 THEN 'plpgsql' ELSE 'ext' || {_T('p_partkey')} END AS extname, CAST(p_partkey % 30 AS BIGINT) AS extnamespace FROM {{part}} WHERE p_partkey % 10 = 0",
    "acl_class": "SELECT DISTINCT l_partkey AS k, CAST(l_suppkey % 6 AS BIGINT) AS grantee, CASE WHEN l_linenumber % 3 = 0 THEN 'SELECT' WHEN l_linenumber % 3 = 1 THEN 'INSERT' ELSE 'UPDATE' END AS privilege_type, l_linenumber % 2 = 0 AS is_grantable FROM {lineitem}",
    "acl_namespace": "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS k, c_custkey % 6 AS grantee, CASE WHEN c_custkey % 2 = 0 THEN 'USAGE' ELSE 'CREATE' END AS privilege_type, c_custkey % 4 = 0 AS is_grantable FROM {customer}",
    "acl_proc": "SELECT DISTINCT o_custkey AS k, o_orderkey % 6 AS grantee, 'EXECUTE' AS privilege_type, FALSE AS is_grantable FROM {orders}",
    "acl_type": "SELECT s_suppkey AS k, s_suppkey % 6 AS grantee, 'USAGE' AS privilege_type, s_suppkey % 2 = 0 AS is_grantable FROM {supplier}",
    "acl_database": "SELECT DISTINCT l_partkey AS k, CAST(l_suppkey % 6 AS BIGINT) AS grantee, 'CONNECT' AS privilege_type, FALSE AS is_grantable FROM {lineitem} WHERE l_partkey % 50 = 0",
    "pg_default_acl": "SELECT c_custkey AS oid, c_custkey % 5 + 1 AS defaclrole, CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE CAST(c_nationkey AS BIGINT) END AS defaclnamespace, CASE WHEN c_custkey % 4 = 0 THEN 'r' WHEN c_custkey % 4 = 1 THEN 'S' WHEN c_custkey % 4 = 2 THEN 'f' ELSE 'T' END AS defaclobjtype FROM {customer} WHERE c_custkey % 10 = 0",
    "acl_default": "SELECT c_custkey AS k, c_custkey % 6 AS grantee, 'SELECT' AS privilege_type, c_custkey % 4 = 0 AS is_grantable FROM {customer} WHERE c_custkey % 10 = 0",
    "db_settings": f"SELECT p_partkey AS setdatabase, CAST(CASE WHEN p_partkey % 100 = 0 THEN 0 ELSE 5 END AS BIGINT) AS setrole, CASE WHEN p_size % 2 = 0 THEN 'search_path' ELSE 'work_mem' END || '=a=' || {_T('p_size')} || '''b' AS entry FROM {{part}} WHERE p_partkey % 50 = 0",
}

TABLES = "region nation customer supplier part orders lineitem".split()
_ORACLE = ", ".join(f"{k} AS ({v.format(**{t: t for t in TABLES})})" for k, v in SYSTEM_SQL.items())


def on_system(sql: str):  # noqa: ANN201
    """A query whose SQL sees the system tables."""
    return query(f"WITH {_ORACLE} {sql}")


def system(spark: SparkSession, sf_dir: str) -> R.System:
    frames = {t: table(spark, sf_dir, t) for t in TABLES}
    s = {k: spark.sql(v, **{t: f for t, f in frames.items() if f"{{{t}}}" in v}) for k, v in SYSTEM_SQL.items()}
    for name, acl, rows in (("pg_class", "relacl", "class"), ("pg_namespace", "nspacl", "namespace"), ("pg_proc", "proacl", "proc"), ("pg_type", "typacl", "type"), ("pg_database", "datacl", "database"), ("pg_default_acl", "defaclacl", "default")):
        lists = s[f"acl_{rows}"].groupBy(F.col("k").alias("oid")).agg(F.collect_list(F.struct("grantee", "privilege_type", "is_grantable")).alias(acl))
        s[name] = s[name].join(lists, "oid", "left")
    roles = s["policy_roles"].groupBy("k").agg(F.collect_list("role").alias("polroles"))
    s["pg_policy"] = s["pg_policy"].join(roles, "k", "left").withColumn("polroles", F.coalesce("polroles", F.array().cast("array<bigint>")))
    s["pg_db_role_setting"] = s["db_settings"].groupBy("setdatabase", "setrole").agg(F.collect_list("entry").alias("setconfig"))
    return R.System(s)


_NS = "JOIN pg_namespace n ON n.oid = "
_FREE = "NOT EXISTS (SELECT 1 FROM pg_depend d WHERE d.classid = '{}' AND d.objid = {} AND d.deptype = '{}')"

_COLUMNS_SQL = f"""
SELECT n.nspname AS schema_name, c.relname AS table_name, a.attname AS column_name, a.attnum AS ordinal, a.format_type AS data_type, a.attnotnull AS not_null,
  d.expr AS column_default, a.attgenerated = 's' AS is_generated, a.attidentity AS identity,
  CASE WHEN a.attidentity IN ('a', 'd') THEN (
    SELECT 'INCREMENT BY ' || q.seqincrement || ' MINVALUE ' || q.seqmin || ' MAXVALUE ' || q.seqmax || ' START WITH ' || q.seqstart || ' CACHE ' || q.seqcache || CASE WHEN q.seqcycle THEN ' CYCLE' ELSE '' END
    FROM pg_sequence q JOIN pg_depend i ON i.classid = 'pg_class' AND i.objid = q.seqrelid AND i.refclassid = 'pg_class' AND i.refobjid = a.attrelid AND i.refobjsubid = a.attnum AND i.deptype = 'i') END AS identity_options,
  CASE WHEN a.attcollation <> 0 AND a.attcollation <> t.typcollation THEN co.collname END AS collation_name,
  CASE WHEN a.attcollation <> 0 AND a.attcollation <> t.typcollation THEN cn.nspname END AS collation_schema
FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid AND c.relkind IN ('r', 'p') {_NS} c.relnamespace JOIN pg_type t ON t.oid = a.atttypid
LEFT JOIN pg_attrdef d ON d.adrelid = a.attrelid AND d.adnum = a.attnum LEFT JOIN pg_collation co ON co.oid = a.attcollation LEFT JOIN pg_namespace cn ON cn.oid = co.collnamespace
WHERE a.attnum > 0 AND NOT a.attisdropped"""


@on_system(_COLUMNS_SQL)
def i02_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.columns(system(spark, sf_dir))


@on_system(f"""SELECT n.nspname AS schema_name, c.relname AS table_name, i.relname AS index_name, x.indexdef AS index_def, x.indisprimary AS is_primary, x.indisunique AS is_unique
FROM pg_index x JOIN pg_class i ON i.oid = x.indexrelid JOIN pg_class c ON c.oid = x.indrelid AND c.relkind IN ('r', 'p', 'm') {_NS} c.relnamespace""")
def i03_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.indexes(system(spark, sf_dir))


@on_system(f"""SELECT n.nspname AS schema_name, c.relname AS table_name, k.conname AS constraint_name, k.contype AS constraint_type, k.constraintdef AS constraint_def
FROM pg_constraint k JOIN pg_class c ON c.oid = k.conrelid AND c.relkind IN ('r', 'p') {_NS} c.relnamespace""")
def i04_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.constraints(system(spark, sf_dir))


@on_system(f"""SELECT n.nspname AS schema_name, c.relname AS sequence_name, coalesce(n2.nspname || '.' || t.relname || '.' || a.attname, '') AS owned_by,
  EXISTS (SELECT 1 FROM pg_depend i WHERE i.classid = 'pg_class' AND i.objid = c.oid AND i.deptype = 'i') AS is_identity
FROM pg_class c {_NS} c.relnamespace LEFT JOIN pg_depend d ON d.objid = c.oid AND d.deptype = 'a' LEFT JOIN pg_class t ON t.oid = d.refobjid
LEFT JOIN pg_namespace n2 ON n2.oid = t.relnamespace LEFT JOIN pg_attribute a ON a.attrelid = d.refobjid AND a.attnum = d.refobjsubid WHERE c.relkind = 'S'""")
def i05_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sequences(system(spark, sf_dir)).withColumn("owned_by", F.coalesce("owned_by", F.lit("")))


@on_system("""SELECT n.nspname AS schema_name, c.relname AS sequence_name, min(n2.nspname || '.' || t.relname || '.' || a.attname) AS owned_by
FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_depend d ON d.objid = c.oid AND d.deptype = 'a' JOIN pg_class t ON t.oid = d.refobjid
JOIN pg_namespace n2 ON n2.oid = t.relnamespace JOIN pg_attribute a ON a.attrelid = d.refobjid AND a.attnum = d.refobjsubid WHERE c.relkind = 'S' GROUP BY 1, 2""")
def i27_sequence_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sequence_owner(R.sequences(system(spark, sf_dir)))


@on_system(f"""SELECT n.nspname AS schema_name, p.proname AS func_name, p.functiondef AS func_def, p.oid AS func_oid, p.identity_args AS func_args
FROM pg_proc p {_NS} p.pronamespace WHERE p.prokind IN ('f', 'p') AND {_FREE.format('pg_proc', 'p.oid', 'e')} AND {_FREE.format('pg_proc', 'p.oid', 'i')}""")
def i06_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.functions(system(spark, sf_dir))


@on_system(f"""SELECT n.nspname AS schema_name, c.relname AS table_name, t.tgname AS trigger_name, t.triggerdef AS trigger_def, t.tgenabled AS enabled
FROM pg_trigger t JOIN pg_class c ON c.oid = t.tgrelid {_NS} c.relnamespace
WHERE NOT t.tgisinternal AND t.tgparentid = 0 AND {_FREE.format('pg_trigger', 't.oid', 'e')} AND {_FREE.format('pg_proc', 't.tgfoid', 'e')}""")
def i07_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.triggers(system(spark, sf_dir))


@on_system(f"""SELECT n.nspname AS schema_name, c.relname AS view_name, c.relkind AS relkind, c.viewdef AS view_def FROM pg_class c {_NS} c.relnamespace
WHERE c.relkind IN ('v', 'm') AND {_FREE.format('pg_class', 'c.oid', 'e')} AND c.oid % 6 <> 0 AND c.viewdef NOT LIKE '%red%'""")
def i08_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = system(spark, sf_dir)
    kept = s.relations("vm").where("oid % 6 = 0").select("schema_name", F.col("table_name").alias("view_name"))
    return R.views(s, kept, "red")


@on_system(f"""SELECT n.nspname AS schema_name, c.relname AS table_name, c.relkind = 'p' AS is_partitioned, c.relispartition AS is_partition,
  coalesce(CASE WHEN c.relkind = 'p' THEN c.partkeydef END, '') AS partition_by, coalesce(CASE WHEN c.relispartition THEN c.partbound END, '') AS bound,
  coalesce(pn.nspname, '') AS parent_schema, coalesce(p.relname, '') AS parent_name
FROM pg_class c {_NS} c.relnamespace LEFT JOIN pg_inherits i ON i.inhrelid = c.oid AND c.relispartition LEFT JOIN pg_class p ON p.oid = i.inhparent LEFT JOIN pg_namespace pn ON pn.oid = p.relnamespace
WHERE c.relkind IN ('r', 'p')""")
def i11_partition_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.partition_info(system(spark, sf_dir)).fillna("", ["partition_by", "bound", "parent_schema", "parent_name"])


@on_system(f"""SELECT n.nspname AS schema_name, t.typname AS type_name, 'CREATE TYPE "' || n.nspname || '"."' || t.typname || '" AS (' || string_agg('"' || a.attname || '" ' || a.format_type, ', ' ORDER BY a.attnum) || ')' AS ddl
FROM pg_type t {_NS} t.typnamespace JOIN pg_class c ON c.oid = t.typrelid AND c.relkind = 'c' JOIN pg_attribute a ON a.attrelid = c.oid AND a.attnum > 0 AND NOT a.attisdropped
WHERE t.typtype = 'c' AND {_FREE.format('pg_type', 't.oid', 'e')} GROUP BY 1, 2""")
def i12_composite_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ddl = D.composite_type(F.col("schema_name"), F.col("type_name"), F.col("attributes"))
    return R.composite_types(system(spark, sf_dir)).select("schema_name", "type_name", ddl.alias("ddl"))


@on_system(f"""SELECT n.nspname AS schema_name, c.relname AS table_name, c.relrowsecurity AS rowsecurity, c.relforcerowsecurity AS force_rowsecurity FROM pg_class c {_NS} c.relnamespace WHERE c.relkind IN ('r', 'p')""")
def i13_row_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.row_security(system(spark, sf_dir))


_POLICIES_SQL = f"""SELECT n.nspname AS schema_name, c.relname AS table_name, p.polname AS policy_name, p.polcmd, p.polpermissive AS permissive,
  CASE WHEN EXISTS (SELECT 1 FROM policy_roles r WHERE r.k = p.k AND r.role = 0) THEN 'PUBLIC'
       ELSE coalesce((SELECT string_agg(rolname, ',' ORDER BY rolname) FROM pg_roles g JOIN policy_roles r ON r.role = g.oid WHERE r.k = p.k), '') END AS roles,
  coalesce(p.using_expr, '') AS using_expr, p.check_expr
FROM pg_policy p JOIN pg_class c ON c.oid = p.polrelid {_NS} c.relnamespace"""


@on_system(_POLICIES_SQL)
def i14_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.policies(system(spark, sf_dir)).withColumn("roles", F.array_join("roles", ",")).fillna("", ["using_expr"])


@on_system(f"""SELECT policy_name, 'CREATE POLICY "' || policy_name || '" ON "' || schema_name || '"."' || table_name || '" AS ' || CASE WHEN permissive THEN 'PERMISSIVE' ELSE 'RESTRICTIVE' END || ' FOR ' ||
  CASE polcmd WHEN 'r' THEN 'SELECT' WHEN 'a' THEN 'INSERT' WHEN 'w' THEN 'UPDATE' WHEN 'd' THEN 'DELETE' ELSE 'ALL' END || ' TO ' ||
  CASE WHEN roles IN ('', 'PUBLIC') THEN 'PUBLIC' ELSE '"' || replace(roles, ',', '", "') || '"' END ||
  CASE WHEN using_expr <> '' THEN ' USING (' || using_expr || ')' ELSE '' END || CASE WHEN check_expr <> '' THEN ' WITH CHECK (' || check_expr || ')' ELSE '' END AS ddl
FROM ({_POLICIES_SQL})""")
def f16_policy_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    ddl = S.policy(c("schema_name"), c("table_name"), c("policy_name"), c("polcmd"), c("permissive"), c("roles"), c("using_expr"), c("check_expr"))
    return R.policies(system(spark, sf_dir)).select("policy_name", ddl.alias("ddl"))


@on_system(f"""SELECT n.nspname AS schema_name, c.collname AS coll_name, 'CREATE COLLATION IF NOT EXISTS "' || n.nspname || '"."' || c.collname || '" (' ||
  CASE c.collprovider WHEN 'i' THEN 'PROVIDER = icu, LOCALE = ''' || coalesce(c.colllocale, '') || '''' WHEN 'b' THEN 'PROVIDER = builtin, LOCALE = ''' || coalesce(c.colllocale, '') || ''''
    ELSE 'PROVIDER = libc, ' || CASE WHEN c.collcollate = c.collctype THEN 'LOCALE = ''' || c.collcollate || '''' ELSE 'LC_COLLATE = ''' || c.collcollate || ''', LC_CTYPE = ''' || c.collctype || '''' END END ||
  CASE WHEN c.collisdeterministic THEN '' ELSE ', DETERMINISTIC = false' END || ')' AS ddl, c.colliculocale AS locale_15
FROM pg_collation c {_NS} c.collnamespace WHERE {_FREE.format('pg_collation', 'c.oid', 'e')}""")
def i15_collations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col, system(spark, sf_dir)
    ddl = D.collation(c("schema_name"), c("coll_name"), c("provider"), c("provider_locale"), c("collcollate"), c("collctype"), c("deterministic"))
    older = R.collations(s, 15).select("schema_name", "coll_name", c("provider_locale").alias("locale_15"))
    return R.collations(s, 17).select("schema_name", "coll_name", ddl.alias("ddl")).join(older, ["schema_name", "coll_name"])


@on_system(f"""SELECT n.nspname AS schema_name, t.typname AS type_name, CASE WHEN t.typcollation <> 0 AND t.typcollation IS DISTINCT FROM b.typcollation THEN coalesce(cn.nspname || '.' || co.collname, '') ELSE '' END AS collation_ref,
  'CREATE DOMAIN "' || n.nspname || '"."' || t.typname || '" AS ' || t.base_format || coalesce(' DEFAULT ' || t.typdefault, '') || CASE WHEN t.typnotnull THEN ' NOT NULL' ELSE '' END ||
  coalesce((SELECT string_agg(' CONSTRAINT "' || k.conname || '" ' || k.constraintdef, '' ORDER BY k.conname) FROM pg_constraint k WHERE k.contypid <> 0 AND k.contypid = t.oid), '') AS ddl
FROM pg_type t {_NS} t.typnamespace LEFT JOIN pg_type b ON b.oid = t.typbasetype LEFT JOIN pg_collation co ON co.oid = t.typcollation LEFT JOIN pg_namespace cn ON cn.oid = co.collnamespace
WHERE t.typtype = 'd' AND {_FREE.format('pg_type', 't.oid', 'e')}""")
def i16_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = F.transform("checks", lambda k: F.concat(F.lit("CONSTRAINT "), S.quote_ident(k["name"]), F.lit(" "), k["def"]))
    ddl = S.domain(F.col("schema_name"), F.col("type_name"), F.col("base_type"), F.col("default_expr"), F.col("not_null"), checks)
    collation = F.coalesce(F.concat("collation_schema", F.lit("."), "collation_name"), F.lit(""))
    return R.domains(system(spark, sf_dir)).select("schema_name", "type_name", collation.alias("collation_ref"), ddl.alias("ddl"))


@on_system(f"""SELECT n.nspname AS schema_name, t.typname AS type_name, 'CREATE TYPE "' || n.nspname || '"."' || t.typname || '" AS RANGE (SUBTYPE = ' || r.subtype ||
  coalesce(', COLLATION = "' || cn.nspname || '"."' || co.collname || '"', '') || coalesce(', CANONICAL = "' || pn.nspname || '"."' || p.proname || '"', '') ||
  coalesce(', SUBTYPE_DIFF = "' || dn.nspname || '"."' || d.proname || '"', '') || ')' AS ddl
FROM pg_range r JOIN pg_type t ON t.oid = r.rngtypid {_NS} t.typnamespace LEFT JOIN pg_collation co ON co.oid = r.rngcollation LEFT JOIN pg_namespace cn ON cn.oid = co.collnamespace
LEFT JOIN pg_proc p ON p.oid = r.rngcanonical LEFT JOIN pg_namespace pn ON pn.oid = p.pronamespace LEFT JOIN pg_proc d ON d.oid = r.rngsubdiff LEFT JOIN pg_namespace dn ON dn.oid = d.pronamespace
WHERE {_FREE.format('pg_type', 't.oid', 'e')}""")
def i17_range_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    pair = lambda a, b: (c(a), c(b))
    ddl = D.range_type(c("schema_name"), c("type_name"), c("subtype"), pair("collation_schema", "collation_name"), pair("canonical_schema", "canonical_name"), pair("diff_schema", "diff_name"))
    return R.range_types(system(spark, sf_dir)).select("schema_name", "type_name", ddl.alias("ddl"))


@on_system(f"""
, f AS (SELECT p.oid, '"' || n.nspname || '"."' || p.proname || '"' AS name FROM pg_proc p {_NS} p.pronamespace)
SELECT f.name AS agg_name, 'CREATE AGGREGATE ' || f.name || '(' || p.arguments || ') (' || chr(10) || '  SFUNC = ' || tf.name || ',' || chr(10) || '  STYPE = ' || a.transtype ||
  coalesce(',' || chr(10) || '  FINALFUNC = ' || ff.name || CASE WHEN a.aggfinalextra THEN ',' || chr(10) || '  FINALFUNC_EXTRA' ELSE '' END || ',' || chr(10) || '  FINALFUNC_MODIFY = ' || CASE a.aggfinalmodify WHEN 's' THEN 'SHAREABLE' WHEN 'w' THEN 'READ_WRITE' ELSE 'READ_ONLY' END, '') ||
  coalesce(',' || chr(10) || '  COMBINEFUNC = ' || cf.name, '') || coalesce(',' || chr(10) || '  INITCOND = ''' || a.agginitval || '''', '') ||
  coalesce(',' || chr(10) || '  MSFUNC = ' || mf.name || ',' || chr(10) || '  MINVFUNC = ' || vf.name || ',' || chr(10) || '  MSTYPE = ' || a.mtranstype || coalesce(',' || chr(10) || '  MINITCOND = ''' || a.aggminitval || '''', ''), '') ||
  CASE p.proparallel WHEN 's' THEN ',' || chr(10) || '  PARALLEL = SAFE' WHEN 'r' THEN ',' || chr(10) || '  PARALLEL = RESTRICTED' ELSE '' END || chr(10) || ')' AS ddl
FROM pg_aggregate a JOIN pg_proc p ON p.oid = a.aggfnoid JOIN f ON f.oid = p.oid JOIN f tf ON tf.oid = a.aggtransfn LEFT JOIN f ff ON ff.oid = a.aggfinalfn LEFT JOIN f cf ON cf.oid = a.aggcombinefn
LEFT JOIN f mf ON mf.oid = a.aggmtransfn LEFT JOIN f vf ON vf.oid = a.aggminvtransfn WHERE {_FREE.format('pg_proc', 'p.oid', 'e')}""")
def i18_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = S.qualified(F.col("schema_name"), F.col("agg_name"))
    return R.aggregates(system(spark, sf_dir)).select(D.aggregate().alias("ddl"), name.alias("agg_name"))


@on_system(f"""SELECT n.nspname AS schema_name, c.relname AS table_name FROM pg_class c {_NS} c.relnamespace
WHERE c.relkind = 'r' AND c.relreplident IN ('d', 'n') AND NOT EXISTS (SELECT 1 FROM pg_index x WHERE x.indrelid = c.oid AND x.indisprimary)""")
def i19_tables_without_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tables_without_key(system(spark, sf_dir))


@on_system("SELECT e.extname AS name, coalesce(n.nspname, '') AS schema_name FROM pg_extension e LEFT JOIN pg_namespace n ON n.oid = e.extnamespace WHERE e.extname <> 'plpgsql'")
def i20_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.extensions(system(spark, sf_dir)).fillna("", ["schema_name"])


@on_system(f"""SELECT DISTINCT n.nspname AS schema_name, c.relname AS table_name FROM pg_inherits i JOIN pg_class c ON c.oid = i.inhrelid AND c.relkind IN ('r', 'p') {_NS} c.relnamespace WHERE NOT c.relispartition""")
def i21_inheriting_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.inheriting_tables(system(spark, sf_dir))


@on_system(f"""SELECT n.nspname AS schema_name, c.relname AS table_name FROM pg_class c {_NS} c.relnamespace WHERE c.relkind IN ('r', 'p') AND NOT c.relispartition""")
def i28_publishable_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.publishable_tables(system(spark, sf_dir))


_KIND = "CASE c.relkind WHEN 'r' THEN 'table' WHEN 'p' THEN 'table' WHEN 'S' THEN 'sequence' WHEN 'v' THEN 'view' ELSE 'materialized_view' END"
_ROUTINE = "CASE p.prokind WHEN 'f' THEN 'function' ELSE 'procedure' END"
_OWNERS_SQL = f"""
SELECT {_KIND} AS kind, n.nspname AS schema_name, c.relname AS object_name, '' AS func_args, r.rolname AS owner FROM pg_class c {_NS} c.relnamespace JOIN pg_roles r ON r.oid = c.relowner
WHERE c.relkind IN ('r', 'S', 'v', 'm') AND {_FREE.format('pg_class', 'c.oid', 'e')}
UNION ALL SELECT 'schema', n.nspname, n.nspname, '', r.rolname FROM pg_namespace n JOIN pg_roles r ON r.oid = n.nspowner
UNION ALL SELECT 'type', n.nspname, t.typname, '', r.rolname FROM pg_type t {_NS} t.typnamespace JOIN pg_roles r ON r.oid = t.typowner WHERE t.typtype IN ('e', 'd') AND t.typname NOT LIKE '#_%' ESCAPE '#' AND {_FREE.format('pg_type', 't.oid', 'e')}
UNION ALL SELECT {_ROUTINE}, n.nspname, p.proname, p.identity_args, r.rolname FROM pg_proc p {_NS} p.pronamespace JOIN pg_roles r ON r.oid = p.proowner WHERE p.prokind IN ('f', 'p') AND {_FREE.format('pg_proc', 'p.oid', 'e')}
UNION ALL SELECT 'database', '', d.datname, '', r.rolname FROM pg_database d JOIN pg_roles r ON r.oid = d.datdba"""


@on_system(_OWNERS_SQL)
def i22_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.owners(system(spark, sf_dir)).fillna("", ["schema_name", "func_args"])


@on_system(f"""SELECT kind, object_name, func_args, 'ALTER ' || CASE
  WHEN kind IN ('table', 'view', 'materialized_view') THEN 'TABLE "' || schema_name || '"."' || object_name || '"' WHEN kind IN ('function', 'procedure') THEN 'ROUTINE "' || schema_name || '"."' || object_name || '"(' || func_args || ')'
  WHEN kind IN ('schema', 'database') THEN upper(kind) || ' "' || object_name || '"' ELSE upper(kind) || ' "' || schema_name || '"."' || object_name || '"' END || ' OWNER TO "' || owner || '"' AS ddl FROM ({_OWNERS_SQL})""")
def f23_owner_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    what = S.object_text(F.col("kind"), F.col("schema_name"), F.col("object_name"), F.col("func_args"))
    rows = R.owners(system(spark, sf_dir)).select("kind", "object_name", "func_args", S.owner_change(what, F.col("owner")).alias("ddl"))
    return rows.fillna("", ["func_args"])


_TO = "coalesce(g.rolname, 'PUBLIC') AS grantee, a.privilege_type, a.is_grantable"
_ACL = "LEFT JOIN pg_roles g ON g.oid = a.grantee"
_PRIVILEGES_SQL = f"""
SELECT 'relation' AS acl_kind, {_KIND} AS kind, n.nspname AS schema_name, c.relname AS object_name, '' AS func_args, '' AS for_role, '' AS objtype, {_TO}
FROM pg_class c {_NS} c.relnamespace JOIN acl_class a ON a.k = c.oid {_ACL} WHERE c.relkind IN ('r', 'p', 'v', 'm', 'S') AND a.grantee <> c.relowner AND {_FREE.format('pg_class', 'c.oid', 'e')}
UNION ALL SELECT 'schema', 'schema', n.nspname, n.nspname, '', '', '', {_TO} FROM pg_namespace n JOIN acl_namespace a ON a.k = n.oid {_ACL} WHERE a.grantee <> n.nspowner
UNION ALL SELECT 'function', {_ROUTINE}, n.nspname, p.proname, p.identity_args, '', '', {_TO} FROM pg_proc p {_NS} p.pronamespace JOIN acl_proc a ON a.k = p.oid {_ACL} WHERE p.prokind IN ('f', 'p') AND a.grantee <> p.proowner AND {_FREE.format('pg_proc', 'p.oid', 'e')}
UNION ALL SELECT 'type', 'type', n.nspname, t.typname, '', '', '', {_TO} FROM pg_type t {_NS} t.typnamespace JOIN acl_type a ON a.k = t.oid {_ACL} WHERE a.grantee <> t.typowner AND t.typname NOT LIKE '#_%' ESCAPE '#' AND {_FREE.format('pg_type', 't.oid', 'e')}
UNION ALL SELECT 'database', 'database', '', d.datname, '', '', '', {_TO} FROM pg_database d JOIN acl_database a ON a.k = d.oid {_ACL} WHERE a.grantee <> d.datdba
UNION ALL SELECT 'default', 'default', coalesce(n.nspname, ''), '', '', r.rolname, d.defaclobjtype, {_TO} FROM pg_default_acl d JOIN pg_roles r ON r.oid = d.defaclrole LEFT JOIN pg_namespace n ON n.oid = d.defaclnamespace JOIN acl_default a ON a.k = d.oid {_ACL}"""


@on_system(_PRIVILEGES_SQL)
def i23_privileges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.privileges(system(spark, sf_dir)).fillna("", R.PRIVILEGES[2:7])


_ON = """CASE acl_kind WHEN 'relation' THEN CASE kind WHEN 'sequence' THEN 'SEQUENCE' ELSE 'TABLE' END || ' "' || schema_name || '"."' || object_name || '"' WHEN 'function' THEN 'ROUTINE "' || schema_name || '"."' || object_name || '"(' || func_args || ')'
  WHEN 'type' THEN 'TYPE "' || schema_name || '"."' || object_name || '"' WHEN 'default' THEN CASE objtype WHEN 'r' THEN 'TABLES' WHEN 'S' THEN 'SEQUENCES' WHEN 'f' THEN 'FUNCTIONS' ELSE 'TYPES' END ELSE upper(kind) || ' "' || object_name || '"' END"""
_BEFORE = """CASE WHEN acl_kind = 'default' THEN 'ALTER DEFAULT PRIVILEGES FOR ROLE "' || for_role || '" ' || CASE WHEN schema_name <> '' THEN 'IN SCHEMA "' || schema_name || '" ' ELSE '' END ELSE '' END"""
_WHO = """CASE WHEN grantee = 'PUBLIC' THEN 'PUBLIC' ELSE '"' || grantee || '"' END"""


@on_system(f"""SELECT {_BEFORE} || 'GRANT ' || privilege_type || ' ON ' || {_ON} || ' TO ' || {_WHO} || CASE WHEN is_grantable THEN ' WITH GRANT OPTION' ELSE '' END AS add,
  {_BEFORE} || 'REVOKE ' || privilege_type || ' ON ' || {_ON} || ' FROM ' || {_WHO} AS remove FROM ({_PRIVILEGES_SQL})""")
def f25_privilege_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.privileges(system(spark, sf_dir)).select(S.privilege_change("GRANT").alias("add"), S.privilege_change("REVOKE").alias("remove"))


@on_system("""SELECT d.datname AS database, split_part(s.entry, '=', 1) AS name, 'ALTER DATABASE "' || d.datname || '" SET "' || split_part(s.entry, '=', 1) || '" TO ' ||
  CASE WHEN s.entry LIKE 'search_path=%' THEN substr(s.entry, 13) ELSE '''' || replace(substr(s.entry, 10), '''', '''''') || '''' END AS ddl FROM db_settings s JOIN pg_database d ON d.oid = s.setdatabase WHERE s.setrole = 0""")
def i24_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.settings(system(spark, sf_dir)).select("database", "name", S.setting(F.col("database"), F.col("entry")).alias("ddl"))


_CREATE_SQL = f"""
, l AS (SELECT *, '"' || column_name || '" ' || data_type AS head, CASE WHEN collation_name IS NULL THEN '' ELSE ' COLLATE "' || collation_schema || '"."' || collation_name || '"' END AS coll, CASE WHEN not_null THEN ' NOT NULL' ELSE '' END AS nn FROM ({_COLUMNS_SQL})),
lines AS (SELECT schema_name, table_name, string_agg(CASE WHEN identity IN ('a', 'd') THEN head || ' GENERATED ' || CASE identity WHEN 'a' THEN 'ALWAYS' ELSE 'BY DEFAULT' END || ' AS IDENTITY' || coalesce(' (' || identity_options || ')', '')
    WHEN column_default LIKE 'nextval(%' THEN head || coll || nn || ' DEFAULT ' || column_default WHEN is_generated THEN head || coll || ' GENERATED ALWAYS AS (' || column_default || ') STORED'
    ELSE head || coll || nn || coalesce(' DEFAULT ' || column_default, '') END, ',' || chr(10) || '  ' ORDER BY ordinal) AS body FROM l GROUP BY 1, 2),
created AS (SELECT c.oid, n.nspname AS schema_name, c.relname AS table_name, c.relispartition, 'CREATE TABLE IF NOT EXISTS "' || n.nspname || '"."' || c.relname || '" ' ||
    CASE WHEN c.relispartition AND p.oid IS NOT NULL THEN 'PARTITION OF "' || pn.nspname || '"."' || p.relname || '" ' || c.partbound ELSE '(' || chr(10) || '  ' || coalesce(lines.body, '') || chr(10) || ')' END ||
    CASE WHEN c.relkind = 'p' THEN ' PARTITION BY ' || c.partkeydef ELSE '' END AS ddl
  FROM pg_class c {_NS} c.relnamespace LEFT JOIN pg_inherits i ON i.inhrelid = c.oid AND c.relispartition LEFT JOIN pg_class p ON p.oid = i.inhparent LEFT JOIN pg_namespace pn ON pn.oid = p.relnamespace
  LEFT JOIN lines ON lines.schema_name = n.nspname AND lines.table_name = c.relname WHERE c.relkind IN ('r', 'p'))"""


@on_system(f"{_CREATE_SQL} SELECT schema_name, table_name, ddl FROM created")
def f21_create_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.table_definitions(system(spark, sf_dir)).drop("is_partition")


@on_system(f"""{_CREATE_SQL}
SELECT schema_name, table_name, ddl || CASE WHEN relispartition THEN '' ELSE
  coalesce((SELECT string_agg(';' || chr(10) || 'ALTER TABLE "' || schema_name || '"."' || table_name || '" ADD CONSTRAINT "' || k.conname || '" ' || k.constraintdef, '' ORDER BY k.conname) FROM pg_constraint k WHERE k.conrelid = created.oid), '') ||
  coalesce((SELECT string_agg(';' || chr(10) || x.indexdef, '' ORDER BY x.indexdef) FROM pg_index x WHERE x.indrelid = created.oid AND NOT x.indisprimary), '') END AS ddl FROM created""")
def f22_full_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.full_definitions(system(spark, sf_dir))


def changed(source: R.System) -> R.System:
    """A target that lacks some things, has others, and differs in others."""
    s = dict(source.tables)
    s["pg_namespace"] = s["pg_namespace"].where("oid % 12 <> 5")
    s["pg_class"] = s["pg_class"].where("oid % 10 <> 3").withColumn("relname", F.when(F.col("oid") % 50 == 7, F.concat("relname", F.lit("_old"))).otherwise(F.col("relname"))).withColumn("relrowsecurity", F.lit(False))
    s["pg_attribute"] = s["pg_attribute"].where("(attrelid + attnum) % 13 <> 4").withColumn("format_type", F.when((F.col("attrelid") + F.col("attnum")) % 17 == 2, "bigint").otherwise(F.col("format_type")))
    s["pg_index"] = s["pg_index"].where("indrelid % 3 <> 1")
    s["pg_constraint"] = s["pg_constraint"].where("oid % 4 <> 1")
    s["pg_proc"] = s["pg_proc"].where("oid % 9 <> 4").withColumn("functiondef", F.when(F.col("oid") % 8 == 0, F.concat("functiondef", F.lit("  x"))).otherwise(F.concat("functiondef", F.lit("\n"))))
    s["pg_trigger"] = s["pg_trigger"].where("oid % 15 <> 6").withColumn("tgenabled", F.when(F.col("oid") % 21 == 5, "O").otherwise(F.col("tgenabled")))
    s["pg_policy"] = s["pg_policy"].where("k % 11 <> 2").withColumn("polcmd", F.when(F.col("k") % 22 == 3, "*").otherwise(F.col("polcmd")))
    return R.System(s, source.schemas)


_PAIR = f"""
, tn AS (SELECT * FROM pg_namespace WHERE oid % 12 <> 5),
tc AS (SELECT * EXCLUDE relname, CASE WHEN oid % 50 = 7 THEN relname || '_old' ELSE relname END AS relname FROM pg_class WHERE oid % 10 <> 3),
st AS (SELECT c.oid, c.relispartition AS part, n.nspname AS s, c.relname AS t FROM pg_class c {_NS} c.relnamespace WHERE c.relkind IN ('r', 'p')),
tt AS (SELECT c.oid, n.nspname AS s, c.relname AS t FROM tc c JOIN tn n ON n.oid = c.relnamespace WHERE c.relkind IN ('r', 'p')),
both_t AS (SELECT st.* FROM st JOIN tt USING (s, t) WHERE NOT st.part),
sa AS (SELECT attrelid AS oid, attname, attnum, format_type FROM pg_attribute WHERE NOT attisdropped),
ta AS (SELECT oid, attname, CASE WHEN (oid + attnum) % 17 = 2 THEN 'bigint' ELSE format_type END AS format_type FROM sa WHERE (oid + attnum) % 13 <> 4),
sp AS (SELECT p.oid, n.nspname AS s, p.proname AS f, p.identity_args AS a FROM pg_proc p {_NS} p.pronamespace WHERE p.prokind IN ('f', 'p') AND {_FREE.format('pg_proc', 'p.oid', 'e')} AND {_FREE.format('pg_proc', 'p.oid', 'i')}),
sg AS (SELECT t.oid, n.nspname AS s, c.relname AS t, t.tgname AS g, t.tgenabled AS e FROM pg_trigger t JOIN pg_class c ON c.oid = t.tgrelid {_NS} c.relnamespace
  WHERE NOT t.tgisinternal AND t.tgparentid = 0 AND {_FREE.format('pg_trigger', 't.oid', 'e')} AND {_FREE.format('pg_proc', 't.tgfoid', 'e')}),
tg AS (SELECT sg.s, tc.relname AS t, sg.g, CASE WHEN sg.oid % 21 = 5 THEN 'O' ELSE sg.e END AS e FROM sg JOIN tc ON tc.oid = sg.oid % 200 JOIN tn ON tn.oid = tc.relnamespace WHERE sg.oid % 15 <> 6),
so AS (SELECT p.k, n.nspname AS s, c.relname AS t, p.polname AS g, p.polcmd AS c FROM pg_policy p JOIN pg_class c ON c.oid = p.polrelid {_NS} c.relnamespace),
tp AS (SELECT so.s, tc.relname AS t, so.g, CASE WHEN so.k % 22 = 3 THEN '*' ELSE so.c END AS c FROM so JOIN tc ON tc.oid = so.k % 200 JOIN tn ON tn.oid = tc.relnamespace WHERE so.k % 11 <> 2)"""


@on_system(f"""{_PAIR}
SELECT section_no, object_type, drift_type, name FROM (
SELECT 1 AS section_no, 'schema' AS object_type, 'missing_on_target' AS drift_type, nspname AS name FROM pg_namespace WHERE oid % 12 = 5
UNION ALL SELECT 2, 'table', 'missing_on_target', t FROM st WHERE (s, t) NOT IN (SELECT (s, t) FROM tt)
UNION ALL SELECT 3, 'table', 'missing_on_source', t FROM tt WHERE (s, t) NOT IN (SELECT (s, t) FROM st)
UNION ALL SELECT 4, 'column', 'missing_on_target', sa.attname FROM both_t JOIN sa USING (oid) LEFT JOIN ta USING (oid, attname) WHERE ta.oid IS NULL AND EXISTS (SELECT 1 FROM ta x WHERE x.oid = both_t.oid)
UNION ALL SELECT 6, 'column', 'different', sa.attname FROM both_t JOIN sa USING (oid) JOIN ta USING (oid, attname) WHERE sa.format_type <> ta.format_type
UNION ALL SELECT 7, 'index', 'missing_on_target', i.relname FROM both_t JOIN pg_index x ON x.indrelid = both_t.oid JOIN pg_class i ON i.oid = x.indexrelid WHERE both_t.oid % 3 = 1 OR i.oid NOT IN (SELECT oid FROM tc) OR i.relname NOT IN (SELECT relname FROM tc WHERE oid = i.oid)
UNION ALL SELECT 8, 'constraint', 'missing_on_target', k.conname FROM both_t JOIN pg_constraint k ON k.conrelid = both_t.oid WHERE k.oid % 4 = 1
UNION ALL SELECT 10, 'function', 'missing_on_target', f FROM sp WHERE oid % 9 = 4 OR s NOT IN (SELECT nspname FROM tn)
UNION ALL SELECT 10, 'function', 'different', f FROM sp WHERE oid % 9 <> 4 AND s IN (SELECT nspname FROM tn) AND oid % 8 = 0
UNION ALL SELECT 11, 'trigger', 'missing_on_target', g FROM sg WHERE (s, t, g) NOT IN (SELECT (s, t, g) FROM tg)
UNION ALL SELECT 11, 'trigger', 'different', g FROM sg JOIN tg USING (s, t, g) WHERE sg.e <> tg.e
UNION ALL SELECT 13, 'policy', 'missing_on_target', g FROM so WHERE (s, t, g) NOT IN (SELECT (s, t, g) FROM tp)
UNION ALL SELECT 13, 'policy', 'different', g FROM so JOIN tp USING (s, t, g) WHERE so.c <> tp.c)""")
def x01_detect_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections 1 to 13 of the report in one call; the rest have queries of their own."""
    s = system(spark, sf_dir)
    return drift.detect_drift(s, changed(s)).where("section_no <= 13 and section_no <> 12").select("section_no", "object_type", "drift_type", "name")


@on_system(f"""{_PAIR}
SELECT 12 AS section_no, t AS name, detail FROM (
  SELECT st.s, st.t, c.relrowsecurity AS r FROM st JOIN tt USING (s, t) JOIN pg_class c ON c.oid = st.oid) CROSS JOIN (SELECT 'row security is off' AS detail) WHERE r""")
def x01_row_security_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = system(spark, sf_dir)
    return drift.row_security_drift(R.row_security(s), R.row_security(changed(s))).select("section_no", "name", "detail")


@on_system(f"""{_PAIR}, depth AS (
  WITH RECURSIVE w AS (SELECT oid, 0 AS d FROM pg_class WHERE oid NOT IN (SELECT inhrelid FROM pg_inherits) UNION ALL SELECT i.inhrelid, d + 1 FROM w JOIN pg_inherits i ON i.inhparent = w.oid) SELECT oid, max(d) AS d FROM w GROUP BY 1)
SELECT t AS name, row_number() OVER (ORDER BY coalesce(d, 0), s, t) AS place FROM st LEFT JOIN depth USING (oid) WHERE (s, t) NOT IN (SELECT (s, t) FROM tt)""")
def o05_missing_tables_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = system(spark, sf_dir)
    missing = drift.missing_tables(s, changed(s)).where("section_no = 2")
    return with_places(missing, *drift.ordered()).select("name", "place")


# ---- owners, privileges and settings against a target ----------------------------------

_ROLES = "(SELECT rolname FROM pg_roles WHERE rolname <> 'ASIA')"


def _known_roles(s: R.System) -> DataFrame:
    return s["pg_roles"].where("rolname <> 'ASIA'").select("rolname")


@on_system(f""", o AS ({_OWNERS_SQL}), t AS (SELECT * EXCLUDE owner, CASE WHEN length(object_name) % 3 = 0 THEN 'EUROPE' ELSE owner END AS owner FROM o WHERE object_name NOT LIKE '%7')
SELECT 'ownership (' || o.kind || ')' AS object_type, o.object_name AS name, 'source=' || o.owner || ', target=' || t.owner AS detail, o.owner IN {_ROLES} AS has_fix
FROM o JOIN t USING (kind, schema_name, object_name, func_args) WHERE o.owner <> t.owner""")
def x01_owner_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = system(spark, sf_dir)
    mine = R.owners(s)
    theirs = mine.where("object_name NOT LIKE '%7'").withColumn("owner", F.when(F.length("object_name") % 3 == 0, "EUROPE").otherwise(F.col("owner")))
    found = drift.owner_drift(mine, theirs, _known_roles(s))
    return found.select("object_type", "name", "detail", (F.col("fix_ddl") != "").alias("has_fix"))


@on_system(f""", o AS ({_OWNERS_SQL}), t AS (SELECT * EXCLUDE owner, CASE WHEN length(object_name) % 3 = 0 THEN 'EUROPE' ELSE owner END AS owner FROM o WHERE object_name NOT LIKE '%7')
SELECT o.object_name AS name, o.owner FROM o JOIN t USING (kind, schema_name, object_name, func_args) WHERE o.owner <> t.owner AND o.owner IN {_ROLES}""")
def d22_ownership_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = system(spark, sf_dir)
    mine = R.owners(s)
    theirs = mine.where("object_name NOT LIKE '%7'").withColumn("owner", F.when(F.length("object_name") % 3 == 0, "EUROPE").otherwise(F.col("owner")))
    return apply.ownership_changes(mine, theirs, _known_roles(s)).select("name", F.regexp_extract("fix_ddl", 'OWNER TO "(.*)"$', 1).alias("owner"))


_CHANGED_PRIVILEGES = f"""
, p AS ({_PRIVILEGES_SQL}), t AS (SELECT * EXCLUDE is_grantable, CASE WHEN length(object_name) % 4 = 1 THEN NOT is_grantable ELSE is_grantable END AS is_grantable FROM p WHERE object_name NOT LIKE '%3'),
u AS (SELECT * FROM p WHERE object_name NOT LIKE '%4')"""
_PRIVILEGE_KEY = "acl_kind, kind, schema_name, object_name, func_args, for_role, objtype, grantee, privilege_type"


def _privilege_pair(s: R.System) -> tuple[DataFrame, DataFrame]:
    p = R.privileges(s)
    named = F.coalesce("object_name", F.lit(""))
    option = F.when(F.length(named) % 4 == 1, ~F.col("is_grantable")).otherwise(F.col("is_grantable"))
    return p.where(~named.like("%4")), p.where(~named.like("%3")).withColumn("is_grantable", option)


@on_system(f"""{_CHANGED_PRIVILEGES}
SELECT drift_type, 'privilege (' || kind || ')' AS object_type, grantee || ':' || privilege_type AS name, count(*) AS n FROM (
  SELECT 'missing_on_target' AS drift_type, u.* FROM u WHERE object_name LIKE '%3'
  UNION ALL SELECT 'missing_on_source', t.* FROM t WHERE object_name LIKE '%4'
  UNION ALL SELECT 'different', u.* FROM u JOIN t USING ({_PRIVILEGE_KEY}) WHERE u.is_grantable <> t.is_grantable) GROUP BY 1, 2, 3""")
def x01_privilege_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = system(spark, sf_dir)
    return drift.privilege_drift(*_privilege_pair(s), _known_roles(s)).groupBy("drift_type", "object_type", "name").agg(F.count(F.lit(1)).alias("n"))


@on_system(f"""{_CHANGED_PRIVILEGES}
SELECT grantee || ':' || privilege_type AS name, count(*) AS n FROM (
  SELECT u.* FROM u WHERE object_name LIKE '%3' UNION ALL SELECT u.* FROM u JOIN t USING ({_PRIVILEGE_KEY}) WHERE u.is_grantable <> t.is_grantable)
WHERE grantee = 'PUBLIC' OR grantee IN {_ROLES} GROUP BY 1""")
def d23_privilege_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = system(spark, sf_dir)
    return apply.privilege_additions(*_privilege_pair(s), _known_roles(s)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@on_system("""SELECT d.datname AS database, split_part(s.entry, '=', 1) AS name FROM db_settings s JOIN pg_database d ON d.oid = s.setdatabase
WHERE s.setrole = 0 AND (d.oid % 300 = 0 OR d.oid % 200 = 0)""")
def d24_setting_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = R.settings(system(spark, sf_dir))
    k = F.substring("database", 3, 20).cast("long")
    theirs = mine.where(k % 300 != 0).withColumn("value", F.when(k % 200 == 0, "other").otherwise(F.col("value")))
    return apply.setting_changes(mine, theirs).select("database", "name")


# ---- what is captured, made and seen ---------------------------------------------------

_PUBLISHABLE = f"SELECT n.nspname AS schema_name, c.relname AS table_name FROM pg_class c {_NS} c.relnamespace WHERE c.relkind IN ('r', 'p') AND NOT c.relispartition"


@on_system(f"SELECT 'table' AS captured_as, schema_name, table_name FROM ({_PUBLISHABLE}) UNION ALL SELECT DISTINCT 'schema', schema_name, '' FROM ({_PUBLISHABLE})")
def r01_capture_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = R.publishable_tables(system(spark, sf_dir))
    return apply.capture_set(tables, 14).unionByName(apply.capture_set(tables, 16))


@on_system(f"""{_PAIR}
SELECT place, name FROM (
SELECT 2 AS place, t AS name FROM st WHERE (s, t) NOT IN (SELECT (s, t) FROM tt)
UNION ALL SELECT 4, sa.attname FROM both_t JOIN sa USING (oid) LEFT JOIN ta USING (oid, attname) WHERE ta.oid IS NULL AND EXISTS (SELECT 1 FROM ta x WHERE x.oid = both_t.oid)
UNION ALL SELECT 7, i.relname FROM both_t JOIN pg_index x ON x.indrelid = both_t.oid AND x.indisunique JOIN pg_class i ON i.oid = x.indexrelid WHERE both_t.oid % 3 = 1 OR i.oid NOT IN (SELECT oid FROM tc) OR i.relname NOT IN (SELECT relname FROM tc WHERE oid = i.oid)
UNION ALL SELECT 8, k.conname FROM both_t JOIN pg_constraint k ON k.conrelid = both_t.oid WHERE k.oid % 4 = 1 AND k.constraintdef NOT LIKE 'FOREIGN KEY%')""")
def d12_table_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = system(spark, sf_dir)
    return apply.table_structure(s, changed(s)).select("place", "name")


@on_system(f"""SELECT 'sequences' AS stage, c.relname AS name, 'CREATE SEQUENCE IF NOT EXISTS "' || n.nspname || '"."' || c.relname || '"'
  || coalesce(' INCREMENT BY ' || q.seqincrement || ' MINVALUE ' || q.seqmin || ' MAXVALUE ' || q.seqmax || ' START WITH ' || q.seqstart || ' CACHE ' || q.seqcache || CASE WHEN q.seqcycle THEN ' CYCLE' ELSE ' NO CYCLE' END, '') AS statement
FROM pg_class c {_NS} c.relnamespace LEFT JOIN pg_sequence q ON q.seqrelid = c.oid
WHERE c.relkind = 'S' AND NOT EXISTS (SELECT 1 FROM pg_depend i WHERE i.classid = 'pg_class' AND i.objid = c.oid AND i.deptype = 'i')
UNION ALL SELECT 'schemas', nspname, 'CREATE SCHEMA IF NOT EXISTS "' || nspname || '"' FROM pg_namespace
UNION ALL SELECT 'foreign_keys', k.conname, 'ALTER TABLE "' || n.nspname || '"."' || c.relname || '" ADD CONSTRAINT "' || k.conname || '" ' || k.constraintdef FROM pg_constraint k JOIN pg_class c ON c.oid = k.conrelid AND c.relkind IN ('r', 'p') {_NS} c.relnamespace WHERE k.contype = 'f'
UNION ALL SELECT 'row_security', c.relname, 'ALTER TABLE "' || n.nspname || '"."' || c.relname || '" ENABLE ROW LEVEL SECURITY' || CASE WHEN c.relforcerowsecurity THEN '; ALTER TABLE "' || n.nspname || '"."' || c.relname || '" FORCE ROW LEVEL SECURITY' ELSE '' END
  FROM pg_class c {_NS} c.relnamespace WHERE c.relkind IN ('r', 'p') AND c.relrowsecurity
UNION ALL SELECT 'triggers', t.tgname, t.triggerdef || CASE t.tgenabled WHEN 'O' THEN '' ELSE '; ALTER TABLE "' || n.nspname || '"."' || c.relname || '" ' || CASE t.tgenabled WHEN 'D' THEN 'DISABLE TRIGGER' WHEN 'R' THEN 'ENABLE REPLICA TRIGGER' ELSE 'ENABLE ALWAYS TRIGGER' END || ' "' || t.tgname || '"' END
  FROM pg_trigger t JOIN pg_class c ON c.oid = t.tgrelid {_NS} c.relnamespace WHERE NOT t.tgisinternal AND t.tgparentid = 0 AND {_FREE.format('pg_trigger', 't.oid', 'e')} AND {_FREE.format('pg_proc', 't.tgfoid', 'e')}""")
def d26_stage_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages before and after the copy that have no query of their own."""
    s, out = system(spark, sf_dir), None
    for name in ("schemas", "sequences", "foreign_keys", "row_security", "triggers"):
        rows = apply.stage(name, s).select(F.lit(name).alias("stage"), "name", "statement")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""
SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND o_orderpriority <> '5-LOW'""")
def d19_visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = lambda permissive, using, *roles, cmd="r": {"polcmd": cmd, "permissive": permissive, "roles": list(roles), "using_expr": using}
    policies = [
        policy(True, "o_orderstatus = 'F'"), policy(True, "o_totalprice > 200000", "clerk", cmd="*"), policy(False, "o_orderpriority <> '5-LOW'", "PUBLIC"),
        policy(True, "true", "boss"), policy(True, "true", cmd="w"),
    ]
    return apply.visible_rows(table(spark, sf_dir, "orders"), policies, ["clerk"]).select("o_orderkey")


# ---- copies and status -----------------------------------------------------------------


@query("""
WITH p AS (SELECT p_partkey AS key, greatest(p_size, floor(p_retailprice * 100 / 8192)) AS pages FROM part),
n AS (SELECT key, CASE WHEN pages >= 4 THEN 4 ELSE 1 END AS n, pages FROM p),
s AS (SELECT key, n, CAST(ceil(pages / n) AS BIGINT) AS size FROM n)
SELECT key, i AS chunk_no, i * size AS low, CASE WHEN i < n - 1 THEN (i + 1) * size ELSE -1 END AS high FROM (SELECT *, unnest(range(n)) AS i FROM s)""")
def b03_page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("pages"), (F.col("p_retailprice") * 100).alias("bytes"))
    return bulk_copy.page_plan(tables, 4).withColumn("chunk_no", F.col("chunk_no").cast("long")).withColumn("high", F.coalesce("high", F.lit(-1)))


@query("""
WITH b AS (SELECT min(o_orderkey) AS f, CAST(ceil((max(o_orderkey) - min(o_orderkey) + 1) / 5) AS BIGINT) AS size FROM orders)
SELECT CAST((o_orderkey - f) // size AS INTEGER) AS chunk_no, count(*) AS n FROM orders, b GROUP BY 1""")
def b05_copy_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bulk_copy.copy_in_chunks(table(spark, sf_dir, "orders"), shared_path(spark, "chunks"), "o_orderkey", 5)


@query("""
SELECT 'orders' AS copied, 8 AS chunks, count(*) AS n_rows, TRUE AS even, TRUE AS open_ends FROM orders
UNION ALL SELECT 'lineitem', 8, count(*), TRUE, TRUE FROM lineitem""")
def b04_quantile_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of equal rows though a third of the keys lie far apart, and by a key of several columns: none has 1.3 times the mean."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey")
    far = orders.select(F.when(key % 3 == 0, key * 1000000).otherwise(key).alias("k"))
    out = None
    for name, rows, keys in (("orders", far, ["k"]), ("lineitem", lines.select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber"), ["l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber"])):
        ranges = key_ranges.key_ranges(rows, keys, 8)
        ends = ranges[0].low is None and ranges[-1].high is None and all(a.high == b.low for a, b in zip(ranges, ranges[1:]))
        sizes = key_ranges.with_range(rows, ranges).groupBy("chunk_no").agg(F.count(F.lit(1)).alias("n"))
        found = sizes.agg(F.count(F.lit(1)).cast("int").alias("chunks"), F.sum("n").alias("n_rows"), (F.max("n") <= F.avg("n") * 1.3).alias("even"))
        found = found.select(F.lit(name).alias("copied"), "chunks", "n_rows", "even", F.lit(ends).alias("open_ends"))
        out = found if out is None else out.unionByName(found)
    return out


@query("""
SELECT 'orders' AS copied, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS keys, 6 AS read_chunks, 5 AS first_run FROM orders
UNION ALL SELECT 'customer', count(*), CAST(sum(c_custkey) AS BIGINT), 6, 6 FROM customer""")
def m01_resumed_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A move that fails at a chunk is run again: it copies that chunk alone, and readers see all tables at once."""
    journal, reads = CopyJournal(spark, shared_path(spark, "move")), {"orders": [], "customer": []}
    tables, keys = {t: table(spark, sf_dir, t) for t in reads}, {"orders": "o_orderkey", "customer": "c_custkey"}

    def counted(t: str, chunk: Chunk) -> Chunk:
        def read() -> DataFrame:
            reads[t].append(chunk.name)
            if t == "orders" and reads[t].count("000003") == 1 and chunk.name == "000003":
                raise OSError("the connection was lost")
            return chunk.read()

        return Chunk(chunk.name, read)

    chunks = {t: [counted(t, c) for c in chunks_of_frame(df, [keys[t]], 6)] for t, df in tables.items()}
    db = Database("d", tables, "", snapshot="s1", journal=journal, chunks=chunks)
    first = {}
    try:
        move(spark, db)
    except CopyFailed:
        first = {t: len(journal.chunks_in("s1", t)) for t in tables}
        if journal.current() is not None:
            raise
    move(spark, db)
    out = None
    for t, key in keys.items():
        found = journal.table(t).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(key).alias("keys"))
        done = len(reads[t]) - (t == "orders")  # without the read that failed
        found = found.select(F.lit(t).alias("copied"), "n_rows", "keys", F.lit(done).alias("read_chunks"), F.lit(first[t]).alias("first_run"))
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT doc_id, substr(replace(trim(text), chr(10), ' '), 1, 120) AS shown FROM documents")
def f14_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.preview(F.col("text")).alias("shown"))


@query("SELECT c_name AS datname FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_name NOT IN ('Customer#000000003', 'Customer#000000004')")
def s08_discover_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("datname"), (F.col("c_mktsegment") == "BUILDING").alias("datistemplate"))
    return catalog.discover_databases(rows, exclude=["Customer#000000003", "Customer#000000004"])


@query("""
SELECT CAST(sum(CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey ELSE 0 END) AS BIGINT) AS n_rows, count(*) AS n_tables, count(*) FILTER (o_orderkey % 50 = 0) AS n_failed,
  format('{:,}', CAST(sum(CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey ELSE 0 END) AS BIGINT)) AS n_rows_text FROM orders""")
def g06_copy_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return status.totals(table(spark, sf_dir, "orders").select(k.alias("key"), F.when(k % 50 == 0, -1).otherwise(F.col("o_custkey")).alias("rows")))


@query("""
WITH s AS (SELECT c_nationkey AS k, max(c_custkey) AS v FROM customer GROUP BY 1), t AS (SELECT c_nationkey AS k, max(c_custkey) AS v FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1)
SELECT count(*) FILTER (s.v > t.v) AS n_updated, count(*) FILTER (s.v < t.v) AS n_ahead FROM s JOIN t USING (k)""")
def g09_updated_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = lambda rows: rows.groupBy(F.col("c_nationkey").alias("key")).agg(F.max("c_custkey").alias("last_value")).select("key", "last_value", F.lit(1).cast("long").alias("start_value"), F.lit(True).alias("readable"))
    c = table(spark, sf_dir, "customer")
    return status.updated_count(sequences.reconcile(marks(c), marks(c.where("c_custkey % 7 <> 0"))))


_WORKERS_SQL = "SELECT c_name AS database, 'sub' || c_nationkey AS subname, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS relid, c_custkey * 7 AS pid FROM customer"


@query(f"""SELECT database, pid, row_number() OVER (ORDER BY (relid IS NULL) DESC, subname, pid) AS place FROM ({_WORKERS_SQL})""")
def o02_workers_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main apply workers (without a table) before those of single tables."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    rows = c.select(F.col("c_name").alias("database"), F.concat(F.lit("sub"), F.col("c_nationkey").cast("string")).alias("subname"), F.when(key % 3 != 0, key).alias("relid"), (key * 7).alias("pid"))
    return with_places(rows, F.col("relid").isNull().desc(), "subname", "pid").select("database", "pid", "place")


@query("""
SELECT 'db=' || c_name || ' section=subscription name=sub' || c_nationkey || ' pid=' || c_custkey || ' received_lsn=0/' || c_custkey || ' latest_end_lsn=0/' || (c_custkey - 1) || ' lag="' || c_custkey || ' bytes"' AS line FROM customer
UNION ALL SELECT 'db=' || c_name || ' section=slot name=sl' || c_custkey || ' type=logical active=' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || ' restart_lsn=0/1 confirmed_flush_lsn=0/2 wal_status=' || CASE WHEN c_custkey % 5 = 0 THEN '""' ELSE 'reserved' END FROM customer
UNION ALL SELECT 'db=' || c_name || ' section=lag app=ap' || c_custkey || ' state=streaming sent_lsn=0/9 replay_lsn=0/8 write_lag=0.5 replay_lag=""' FROM customer""")
def m07_stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, text = table(spark, sf_dir, "customer"), lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    key, db = F.col("c_custkey"), F.col("c_name").alias("database")
    subs = c.select(db, text("sub", F.col("c_nationkey")).alias("subname"), key.alias("pid"), F.lit(None).cast("long").alias("relid"), text("0/", key).alias("received_lsn"), text("0/", key - 1).alias("latest_end_lsn"), text(key, " bytes").alias("lag"))
    slots = c.select(db, text("sl", key).alias("slot_name"), F.lit("logical").alias("slot_type"), (key % 2 == 0).alias("active"), F.lit("0/1").alias("restart_lsn"), F.lit("0/2").alias("confirmed_flush_lsn"), F.when(key % 5 != 0, "reserved").alias("wal_status"))
    lag = c.select(db, text("ap", key).alias("application_name"), F.lit("streaming").alias("state"), F.lit("0/9").alias("sent_lsn"), F.lit("0/8").alias("replay_lsn"), F.lit("0.5").alias("write_lag"), F.lit(None).cast("string").alias("replay_lag"))
    frames = [status.subscription_lines(subs), status.slot_lines(slots), status.lag_lines(lag)]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).select("line")


@query("""
SELECT c_name AS database, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 2 = 0) AS n_tables, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = 0) AS n_sequences,
  0 AS n_lag, 'lag: TimeoutError: no answer' AS errors FROM customer""")
def m02_status_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every database in one job; one that could not be read is an error of its own."""
    dbs = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("database"))
    rows = table(spark, sf_dir, "orders").join(dbs, F.col("o_custkey") == F.col("c_custkey")).select("database", "o_orderkey", "o_orderstatus")
    found = status.collect_sections(dbs.select("database"), {"tables": rows.where("o_orderkey % 2 = 0"), "sequences": rows.where("o_orderkey % 3 = 0"), "lag": TimeoutError("no answer")})
    n = lambda c: F.size(c).cast("long")
    errors = F.array_join(F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return found.select("database", n("tables").alias("n_tables"), n("sequences").alias("n_sequences"), F.size("lag").alias("n_lag"), errors.alias("errors"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT max(c_custkey) FROM customer WHERE c_nationkey = 3)")
def p06_scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the one parent that a subquery names."""
    c = table(spark, sf_dir, "customer")
    return spark.sql("SELECT o_orderkey FROM {o} WHERE o_custkey = (SELECT max(c_custkey) FROM {c} WHERE c_nationkey = 3)", o=table(spark, sf_dir, "orders"), c=c)


@query("""
WITH s AS (SELECT c_nationkey AS k, max(c_custkey) AS v FROM customer GROUP BY 1)
SELECT k AS key, 'SELECT setval(''"public"."seq' || k || '"'', ' || v || ', true)' AS statement FROM s""")
def d09_sequence_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.max("c_custkey").alias("last_value"))
    name = S.qualified(F.lit("public"), F.concat(F.lit("seq"), F.col("key").cast("string")))
    return marks.select("key", S.set_value(name, F.col("last_value"), F.lit(True)).alias("statement"))


# ---- what needs what ------------------------------------------------------------------

_VIEW = "p_partkey % 11 <> 0 AND (p_partkey % 13 = 0 OR p_partkey % 17 = 0)"
#: Views read one or two of less than half and a third of their number, so they are several levels deep; types do the same, and some need each other.
NEEDS_SQL = {
    "pg_rewrite": f"SELECT p_partkey + 30000000 AS oid, p_partkey AS ev_class FROM {{part}} WHERE {_VIEW}",
    "pg_depend": f"""
      SELECT 'pg_rewrite' AS classid, p_partkey + 30000000 AS objid, 'pg_class' AS refclassid, CAST(floor(p_partkey / 26) AS BIGINT) * 13 AS refobjid, CAST(0 AS BIGINT) AS refobjsubid, 'n' AS deptype FROM {{part}} WHERE {_VIEW}
      UNION ALL SELECT 'pg_rewrite', p_partkey + 30000000, 'pg_class', CAST(floor(p_partkey / 51) AS BIGINT) * 17, 0, 'n' FROM {{part}} WHERE {_VIEW}
      UNION ALL SELECT 'pg_rewrite', p_partkey + 30000000, 'pg_class', p_partkey, 0, 'n' FROM {{part}} WHERE {_VIEW}
      UNION ALL SELECT 'pg_type', s_suppkey, 'pg_type', CAST(floor(s_suppkey / 2) AS BIGINT), 0, 'n' FROM {{supplier}}
      UNION ALL SELECT 'pg_type', s_suppkey, 'pg_type', CAST(floor(s_suppkey / 3) AS BIGINT), 0, 'n' FROM {{supplier}}
      UNION ALL SELECT 'pg_type', s_suppkey, 'pg_type', s_suppkey + 20, 0, 'n' FROM {{supplier}} WHERE s_suppkey % 40 = 39
      UNION ALL SELECT 'pg_type', s_suppkey, 'pg_type', s_suppkey - 20, 0, 'n' FROM {{supplier}} WHERE s_suppkey % 40 = 19""",
}
_NEEDS = ", ".join(f"needs_{k} AS ({v.format(**{t: t for t in TABLES})})" for k, v in NEEDS_SQL.items())


def with_needs(spark: SparkSession, sf_dir: str) -> R.System:
    """The system tables, with what needs what."""
    s = system(spark, sf_dir)
    more = {k: spark.sql(v, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in v}) for k, v in NEEDS_SQL.items()}
    s.tables["pg_rewrite"], s.tables["pg_depend"] = more["pg_rewrite"], s["pg_depend"].unionByName(more["pg_depend"])
    return s


_LEVELS = """
up AS (SELECT a, b FROM e UNION SELECT up.a, e.b FROM up JOIN e ON e.a = up.b),
stuck AS (SELECT DISTINCT a FROM up WHERE EXISTS (SELECT 1 FROM up u WHERE u.a = up.b AND u.b = up.b) OR a = b),
deep AS (SELECT oid AS a, 0 AS d FROM o UNION SELECT e.a, d + 1 FROM deep JOIN e ON e.b = deep.a WHERE e.a NOT IN (SELECT a FROM stuck)),
ring AS (SELECT x.a, string_agg(y.named, ', ' ORDER BY y.named) AS members FROM up x JOIN up r ON r.a = x.b AND r.b = x.a JOIN o y ON y.oid = x.b GROUP BY x.a)
SELECT schema_name, name, CASE WHEN o.oid NOT IN (SELECT a FROM stuck) THEN max(d) END AS level, any_value(members) AS members
FROM o JOIN deep ON deep.a = o.oid LEFT JOIN ring ON ring.a = o.oid GROUP BY o.oid, schema_name, name"""


@query(f"""WITH RECURSIVE {_ORACLE}, {_NEEDS},
o AS (SELECT c.oid, n.nspname AS schema_name, c.relname AS name, n.nspname || '.' || c.relname AS named FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace
  WHERE relkind IN ('v', 'm') AND {_FREE.format('pg_class', 'c.oid', 'e')}),
e AS (SELECT DISTINCT ev_class AS a, refobjid AS b FROM needs_pg_rewrite r JOIN needs_pg_depend d ON d.objid = r.oid AND d.classid = 'pg_rewrite'
  WHERE ev_class <> refobjid AND ev_class IN (SELECT oid FROM o) AND refobjid IN (SELECT oid FROM o)), {_LEVELS}""")
def d17_view_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and materialized views by what they read: made level by level, one pass is enough."""
    s = with_needs(spark, sf_dir)
    return _levels_of("views", s)


def _levels_of(name: str, s: R.System) -> DataFrame:
    rows = apply.by_level(name, apply.stage(name, s), s)
    members = F.array_join(F.array_sort(F.transform("cycle", lambda m: F.concat_ws(".", m["schema_name"], m["name"]))), ", ")
    return rows.select("schema_name", "name", "level", members.alias("members"))


@query(f"""WITH RECURSIVE {_ORACLE}, {_NEEDS},
o AS (SELECT t.oid, n.nspname AS schema_name, t.typname AS name, n.nspname || '.' || t.typname AS named FROM pg_type t JOIN pg_namespace n ON n.oid = t.typnamespace
  WHERE typtype = 'r' AND t.oid IN (SELECT rngtypid FROM pg_range) AND {_FREE.format('pg_type', 't.oid', 'e')}),
e AS (SELECT DISTINCT objid AS a, refobjid AS b FROM needs_pg_depend WHERE classid = 'pg_type' AND objid IN (SELECT oid FROM o) AND refobjid IN (SELECT oid FROM o)), {_LEVELS}""")
def d08_range_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range types by what they are made of; those that need each other are reported with all members."""
    return _levels_of("ranges", with_needs(spark, sf_dir))


@query("""
SELECT 's' || s_nationkey AS schema, 'v' || s_suppkey AS name, CASE WHEN s_suppkey % 7 = 4 THEN 'missing_on_target' ELSE 'different' END AS drift_type,
  'CREATE OR REPLACE VIEW "s' || s_nationkey || '"."v' || s_suppkey || '" AS SELECT o.o_orderkey AS k, o.o_totalprice FROM public.orders o WHERE o.o_totalprice > ' || s_suppkey || ' AND o.o_orderkey < 10' AS fix_ddl
FROM supplier WHERE s_suppkey % 7 IN (2, 3, 4)""")
def j14_view_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views whose target has other aliases, quoting, white space or order of conditions are no drift; another filter, table or column name is."""
    k = F.col("s_suppkey").cast("string")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("schema_name"), F.concat(F.lit("v"), k).alias("view_name"), F.lit("v").alias("relkind"))
    made = lambda before, after: F.concat(F.lit(before), k, F.lit(after))
    source = rows.withColumn("view_def", made("SELECT o.o_orderkey AS k, o.o_totalprice FROM public.orders o WHERE o.o_totalprice > ", " AND o.o_orderkey < 10"))
    kind = F.col("s_suppkey") % 7
    other = (
        F.when(kind == 0, made('SELECT  x."o_orderkey" k,\n x.o_totalprice FROM "public"."orders" AS x WHERE x.o_totalprice > ', " AND x.o_orderkey < 10"))
        .when(kind == 1, made("SELECT o_orderkey AS k, o_totalprice FROM orders WHERE o_orderkey < 10 AND o_totalprice > ", ""))
        .when(kind == 2, made("SELECT o.o_orderkey AS k, o.o_totalprice FROM public.orders o WHERE o.o_totalprice >= ", " AND o.o_orderkey < 10"))
        .when(kind == 3, made("SELECT o.o_orderkey AS k, o.o_totalprice FROM public.old_orders o WHERE o.o_totalprice > ", " AND o.o_orderkey < 10"))
        .when(kind == 5, made("select o.o_orderkey as k, o.o_totalprice from public.orders o where (o.o_totalprice > ", ") and (o.o_orderkey < 10)"))
        .otherwise(F.col("view_def"))
    )
    target = source.withColumn("view_def", other).where(kind != 4)
    columns = [("o_orderkey", "bigint"), ("o_totalprice", "numeric(15,2)")]
    meanings = ViewMeanings(spark, {("public", "orders"): columns, ("public", "old_orders"): columns})
    return drift.view_drift(source, target, meanings=meanings).select("schema", "name", "drift_type", "fix_ddl")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority ELSE 'none yet' END AS o_orderpriority
FROM orders""")
def d12_evolved_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target written before, between and after changes of its columns and labels: old files are read as the newest structure has them."""
    orders = table(spark, sf_dir, "orders")
    key, target = F.col("o_orderkey"), EvolvingTable(spark, shared_path(spark, "evolving"))
    target.create(orders.select(key.cast("int").alias("o_orderkey")).schema)
    target.append(orders.where(key % 3 == 0).select(key.cast("int").alias("o_orderkey")))
    structure = "column string, kind string, default string"
    target.evolve(spark.createDataFrame([("o_orderkey", "bigint", None), ("o_orderstatus", "string", "'F'"), ("o_totalprice", "double", None)], structure), {"o_orderstatus": ["F", "O"]})
    target.append(orders.where((key % 3 == 1) & F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_orderstatus", "o_totalprice"))
    target.evolve(spark.createDataFrame([("o_orderpriority", "string", "'none ' || 'yet'")], structure), {"o_orderstatus": ["F", "P", "O"]})
    target.append(orders.where((key % 3 == 1) & ~F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit("none yet").alias("o_orderpriority")))
    target.append(orders.where(key % 3 == 2).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))
    return target.read()


_STATE = """t.triggerdef || CASE t.tgenabled WHEN 'O' THEN '' ELSE '; ALTER TABLE "' || sg.s || '"."' || sg.t || '" ' || CASE t.tgenabled WHEN 'D' THEN 'DISABLE TRIGGER'
  WHEN 'R' THEN 'ENABLE REPLICA TRIGGER' ELSE 'ENABLE ALWAYS TRIGGER' END || ' "' || t.tgname || '"' END"""


@on_system(f"""{_PAIR}
SELECT section_no, drift_type, name, fix_ddl FROM (
SELECT 1 AS section_no, 'missing_on_target' AS drift_type, nspname AS name, 'CREATE SCHEMA IF NOT EXISTS "' || nspname || '"' AS fix_ddl FROM pg_namespace WHERE oid % 12 = 5
UNION ALL SELECT 3, 'missing_on_source', t, 'DROP TABLE "' || s || '"."' || t || '"' FROM tt WHERE (s, t) NOT IN (SELECT (s, t) FROM st)
UNION ALL SELECT 6, 'different', sa.attname, '' FROM both_t JOIN sa USING (oid) JOIN ta USING (oid, attname) WHERE sa.format_type <> ta.format_type
UNION ALL SELECT 7, 'missing_on_target', i.relname, x.indexdef FROM both_t JOIN pg_index x ON x.indrelid = both_t.oid JOIN pg_class i ON i.oid = x.indexrelid WHERE both_t.oid % 3 = 1 OR i.oid NOT IN (SELECT oid FROM tc) OR i.relname NOT IN (SELECT relname FROM tc WHERE oid = i.oid)
UNION ALL SELECT 8, 'missing_on_target', k.conname, 'ALTER TABLE "' || s || '"."' || t || '" ADD CONSTRAINT "' || k.conname || '" ' || k.constraintdef FROM both_t JOIN pg_constraint k ON k.conrelid = both_t.oid WHERE k.oid % 4 = 1
UNION ALL SELECT 10, 'missing_on_target', f, p.functiondef FROM sp JOIN pg_proc p USING (oid) WHERE oid % 9 = 4 OR s NOT IN (SELECT nspname FROM tn)
UNION ALL SELECT 10, 'different', f, p.functiondef FROM sp JOIN pg_proc p USING (oid) WHERE oid % 9 <> 4 AND s IN (SELECT nspname FROM tn) AND oid % 8 = 0
UNION ALL SELECT 11, 'missing_on_target', sg.g, {_STATE} FROM sg JOIN pg_trigger t USING (oid) WHERE (sg.s, sg.t, sg.g) NOT IN (SELECT (s, t, g) FROM tg)
UNION ALL SELECT 11, 'different', sg.g, {_STATE} FROM sg JOIN pg_trigger t ON t.oid = sg.oid JOIN tg ON tg.s = sg.s AND tg.t = sg.t AND tg.g = sg.g WHERE sg.e <> tg.e
UNION ALL SELECT 14, 'missing_on_target', c.relname, CASE c.relkind WHEN 'm' THEN 'CREATE MATERIALIZED VIEW "' ELSE 'CREATE OR REPLACE VIEW "' END || n.nspname || '"."' || c.relname || '" AS ' || c.viewdef
  FROM pg_class c {_NS} c.relnamespace WHERE c.relkind IN ('v', 'm') AND {_FREE.format('pg_class', 'c.oid', 'e')}
    AND NOT EXISTS (SELECT 1 FROM tc x JOIN tn y ON y.oid = x.relnamespace WHERE x.oid = c.oid AND x.relname = c.relname))""")
def x01_fix_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the report gives to run for schemas, tables to drop, types, indexes, constraints, functions, triggers and views."""
    s = system(spark, sf_dir)
    return drift.detect_drift(s, changed(s)).where("section_no in (1, 3, 6, 7, 8, 10, 11, 14)").select("section_no", "drift_type", "name", "fix_ddl")


@query("""
WITH s AS (SELECT DISTINCT p_brand AS b, p_size AS l, chr(39) || lpad(CAST(p_size AS VARCHAR), 2, '0') || chr(39) AS q FROM part),
t AS (SELECT b, l FROM s WHERE b <> 'Brand#13' AND (ascii(b[7:7]) + l) % 7 <> 3)
SELECT b AS name, 'missing_on_target' AS drift_type, 'CREATE TYPE "public"."' || b || '" AS ENUM (' || string_agg(q, ', ' ORDER BY l) || ')' AS fix_ddl
FROM s WHERE b NOT IN (SELECT b FROM t) GROUP BY b
UNION ALL SELECT b, 'different', 'ALTER TYPE "public"."' || b || '" ADD VALUE IF NOT EXISTS ' || q FROM s WHERE b IN (SELECT b FROM t) AND (b, l) NOT IN (SELECT (b, l) FROM t)""")
def x01_enum_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as enums of their parts' sizes: a type that the target lacks, and labels that its types lack."""
    part = table(spark, sf_dir, "part").select(F.lit("public").alias("schema_name"), F.col("p_brand").alias("type_name"), "p_size").distinct()
    there = part.where((F.col("type_name") != "Brand#13") & ((F.ascii(F.substring("type_name", 7, 1)) + F.col("p_size")) % 7 != 3))
    keys = ["schema_name", "type_name"]
    labels = lambda rows: catalog.ordered_labels(rows.withColumn("label", F.lpad(F.col("p_size").cast("string"), 2, "0")), keys, "label", "p_size")
    return drift.enum_drift(labels(part), labels(there)).select("name", "drift_type", "fix_ddl")


#: The stages whose statements other queries hold against SQL of their own.
_SAME = {
    "collations": ("i15_collations", "ddl"), "composites": ("i12_composite_types", "ddl"), "domains": ("i16_domains", "ddl"), "ranges": ("i17_range_types", "ddl"),
    "aggregates": ("i18_aggregates", "ddl"), "functions": ("i06_functions", "func_def"), "late_functions": ("i06_functions", "func_def"), "policies": ("f16_policy_ddl", "ddl"),
    "tables": ("f21_create_table", "ddl"),
}
_VIEWS_SQL = f"""WITH {_ORACLE} SELECT CASE c.relkind WHEN 'm' THEN 'DROP MATERIALIZED VIEW IF EXISTS "' || n.nspname || '"."' || c.relname || '"; CREATE MATERIALIZED VIEW "' ELSE 'CREATE OR REPLACE VIEW "' END
  || n.nspname || '"."' || c.relname || '" AS ' || c.viewdef AS ddl FROM pg_class c {_NS} c.relnamespace WHERE c.relkind IN ('v', 'm') AND {_FREE.format('pg_class', 'c.oid', 'e')}"""


@query(" UNION ALL ".join(
    [f"SELECT '{name}' AS stage, {column} AS statement FROM ({ORACLE_SQL[of]})" for name, (of, column) in _SAME.items()]
    + [f"SELECT 'views', ddl FROM ({_VIEWS_SQL})", "SELECT 'enums', 'CREATE TYPE \"public\".\"' || b || '\" AS ENUM (' || string_agg(chr(39) || l || chr(39), ', ' ORDER BY l) || ')' FROM (SELECT DISTINCT p_brand AS b, p_type AS l FROM part) GROUP BY b"]
))
def d25_other_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of the stages that d26_stage_statements leaves out."""
    s, out = system(spark, sf_dir), None
    brands = table(spark, sf_dir, "part").select(F.lit("public").alias("schema_name"), F.col("p_brand").alias("type_name"), F.col("p_type").alias("label"))
    enums = catalog.ordered_labels(brands.distinct(), ["schema_name", "type_name"], "label", "label")
    for name in [*_SAME, "views", "enums"]:
        rows = apply.stage(name, s, enums).select(F.lit(name).alias("stage"), "statement")
        out = rows if out is None else out.unionByName(rows)
    return out
