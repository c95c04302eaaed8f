"""The registered queries and their SQL: each operator over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names as N
from .functions import statements as S
from .operators import bulk_copy, catalog, changes, drift, integrity, keyed_diff, sequences, status
from .operators.ordering import with_places
from .plans import reinit
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401  the first two are what others take from here
from .sources.tables import shared_path, table

# ---- row drift ------------------------------------------------------------------------

_ORDERS_TARGET = """
t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
      FROM orders WHERE o_orderkey % 97 <> 0
      UNION ALL SELECT o_orderkey + 10000000, o_totalprice FROM orders WHERE o_orderkey % 101 = 0)"""
_DRIFT_SQL = f"""
WITH {_ORDERS_TARGET},
d AS (SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
             CASE WHEN t.o_orderkey IS NULL THEN 'missing_on_target' WHEN s.o_orderkey IS NULL THEN 'missing_on_source'
                  WHEN s.o_totalprice IS DISTINCT FROM t.o_totalprice THEN 'different' END AS drift_type
      FROM orders s FULL JOIN t ON s.o_orderkey = t.o_orderkey)"""


def orders_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drifted copy of orders that several queries compare with."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    price = F.when(key % 89 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    kept = o.where(key % 97 != 0).withColumn("o_totalprice", price)
    return kept.unionByName(o.where(key % 101 == 0).withColumn("o_orderkey", key + 10000000))


@query(_DRIFT_SQL + " SELECT o_orderkey, drift_type FROM d WHERE drift_type IS NOT NULL")
def j07_row_drift_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keyed_diff.keyed_diff(table(spark, sf_dir, "orders"), orders_target(spark, sf_dir), ["o_orderkey"], ["o_totalprice"])
    return found.select("o_orderkey", "drift_type")


@query(_DRIFT_SQL + " SELECT drift_type, count(*) AS n FROM d WHERE drift_type IS NOT NULL GROUP BY drift_type")
def g05_drift_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j07_row_drift_orders(spark, sf_dir).groupBy("drift_type").agg(F.count(F.lit(1)).alias("n"))


@query(_DRIFT_SQL + """,
k AS (SELECT drift_type, count(*) AS n,
             min(CASE drift_type WHEN 'missing_on_target' THEN 1 WHEN 'missing_on_source' THEN 2 ELSE 3 END) AS s
      FROM d WHERE drift_type IS NOT NULL GROUP BY drift_type)
SELECT CAST(sum(n) AS VARCHAR) || ' drifts: ' || string_agg(n || ' ' || drift_type, ', ' ORDER BY s) AS summary FROM k""")
def g05_drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.when(F.col("drift_type") == "missing_on_target", 1).when(F.col("drift_type") == "missing_on_source", 2).otherwise(3)
    return keyed_diff.summary_text(j07_row_drift_orders(spark, sf_dir).withColumn("section_no", section))


@query("""
WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal,
                  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer)
SELECT c_custkey, 'c_acctbal' AS column_name FROM customer s JOIN t USING (c_custkey) WHERE s.c_acctbal IS DISTINCT FROM t.c_acctbal
UNION ALL
SELECT c_custkey, 'c_mktsegment' FROM customer s JOIN t USING (c_custkey) WHERE s.c_mktsegment IS DISTINCT FROM t.c_mktsegment""")
def j08_column_value_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    target = c.withColumn("c_acctbal", F.when(key % 13 == 0, F.col("c_acctbal") + 10).otherwise(F.col("c_acctbal"))).withColumn(
        "c_mktsegment", F.when(key % 17 != 0, F.col("c_mktsegment"))
    )
    return keyed_diff.keyed_diff(c, target, ["c_custkey"]).select("c_custkey", F.explode("differs").alias("column_name"))


@query("""
SELECT s_suppkey, 'missing_on_target' AS drift_type FROM supplier WHERE s_suppkey % 10 <> 0 AND s_suppkey % 7 = 0
UNION ALL SELECT s_suppkey, 'missing_on_source' FROM supplier WHERE s_suppkey % 10 = 0 AND s_suppkey % 7 <> 0""")
def j16_two_way_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    return keyed_diff.both_ways(s.where("s_suppkey % 10 <> 0"), s.where("s_suppkey % 7 <> 0"), ["s_suppkey"])


# ---- copy -----------------------------------------------------------------------------


@query("SELECT p_size, p_name, p_partkey FROM part")
def b02_common_columns_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(bulk_copy.shared_columns(part, ["p_size", "p_name", "p_added", "p_partkey", "p_retailprice"], frozenset({"p_retailprice"})))


_CHUNKS = """
b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders),
z AS (SELECT lo, hi, CAST(ceil((hi - lo + 1) / 4.0) AS BIGINT) AS size FROM b),
c AS (SELECT CAST(i AS INTEGER) AS chunk_no, lo + i * size AS low, CASE WHEN i < 3 THEN lo + (i + 1) * size END AS high FROM z, range(4) r(i))"""


@query(f"""WITH {_CHUNKS}
SELECT chunk_no, low, coalesce(high, -1) AS high, (SELECT count(*) FROM orders WHERE o_orderkey >= low AND (high IS NULL OR o_orderkey < high)) AS n_rows FROM c""")
def b04_chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    counts = bulk_copy.with_chunk(orders, "o_orderkey", 4).groupBy("chunk_no").agg(F.count(F.lit(1)).alias("n_rows"))
    return bulk_copy.chunk_plan(orders, "o_orderkey", 4).join(counts, "chunk_no", "left").select(
        "chunk_no", "low", F.coalesce("high", F.lit(-1)).alias("high"), F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


@query("""
WITH b AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem)
SELECT CAST((l_orderkey - lo) // CAST(ceil((hi - lo + 1) / 8.0) AS BIGINT) AS INTEGER) AS chunk_no, count(*) AS n_rows,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM lineitem, b GROUP BY 1""")
def b05_chunked_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bulk_copy.with_chunk(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", 8)
    return rows.groupBy("chunk_no").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("SELECT p_partkey, p_name, p_brand FROM part")
def b01_copy_and_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "part-copy")
    bulk_copy.copy_table(table(spark, sf_dir, "part"), path, ["p_partkey", "p_name", "p_brand"])
    return spark.read.parquet(path)


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest region → nation → supplier as (child, parent) edges."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    return (
        table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("child"), F.lit(None).cast("string").alias("parent"))
        .unionByName(table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")))
        .unionByName(table(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("child"), name("n", "s_nationkey").alias("parent")))
    )


_TREE_SQL = """
e AS (SELECT 'r' || r_regionkey AS child, CAST(NULL AS VARCHAR) AS parent FROM region
      UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
      UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""


@query(f"""WITH RECURSIVE {_TREE_SQL},
t AS (SELECT child, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.child, t.depth + 1 FROM e JOIN t ON e.parent = t.child)
SELECT child, depth FROM t""")
def i01_partition_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.tree_depths(_tree(spark, sf_dir))


@query(f"WITH {_TREE_SQL} SELECT child FROM e WHERE child NOT IN (SELECT parent FROM e WHERE parent IS NOT NULL)")
def b09_leaf_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.leaves(_tree(spark, sf_dir))


@query("""
WITH c AS (
  SELECT 'customer' AS key, count(*) AS s, count(*) FILTER (c_custkey % 19 <> 0) AS t FROM customer
  UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (l_quantity < 50) FROM lineitem
  UNION ALL SELECT 'nation', count(*), count(*) FROM nation UNION ALL SELECT 'orders', count(*), count(*) FROM orders
  UNION ALL SELECT 'part', count(*), count(*) FROM part UNION ALL SELECT 'region', count(*), count(*) FROM region
  UNION ALL SELECT 'supplier', count(*), count(*) FROM supplier)
SELECT key, s AS source_count, t AS target_count FROM c WHERE s <> t""")
def b10_verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")}
    target = tables | {"customer": tables["customer"].where("c_custkey % 19 <> 0"), "lineitem": tables["lineitem"].where("l_quantity < 50")}
    return bulk_copy.count_mismatches(tables, target)


# ---- catalog --------------------------------------------------------------------------


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS labels FROM (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2) GROUP BY user_id")
def i09_ordered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return catalog.ordered_labels(seen, ["user_id"], "event_type", "first").select("user_id", F.array_join("labels", ",").alias("labels"))


@query("""
SELECT 'lineitem' AS table_name, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, sum(n) > count(*) AS full_identity
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderkey), count(*) > count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'part', count(*), count(DISTINCT p_partkey), count(*) > count(DISTINCT p_partkey) FROM part""")
def i19_no_pk_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"], "part": ["p_partkey"]}
    return catalog.key_report({t: (table(spark, sf_dir, t), k) for t, k in keys.items()})


@query("""
SELECT conv_id, turn, coalesce(g, 'PUBLIC') AS grantee, p AS privilege_type, o AS is_grantable FROM (
  SELECT conv_id, turn, CASE WHEN role = 'user' THEN NULL ELSE role END AS g, 'SELECT' AS p, turn % 2 = 0 AS o FROM conversations
  UNION ALL SELECT conv_id, turn, 'c' || (conv_id % 5), 'UPDATE', FALSE FROM conversations)
WHERE coalesce(g, 'PUBLIC') <> 'c' || (conv_id % 3)""")
def i23_acl_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda g, p, o: F.struct(g.alias("grantee"), F.lit(p).alias("privilege_type"), o.alias("is_grantable"))
    of = lambda n: F.concat(F.lit("c"), (F.col("conv_id") % n).cast("string"))
    acl = F.array(entry(F.when(F.col("role") != "user", F.col("role")), "SELECT", F.col("turn") % 2 == 0), entry(of(5), "UPDATE", F.lit(False)))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", acl.alias("acl"), of(3).alias("owner"))
    return catalog.explode_acl(rows, "acl", "owner").drop("owner")


@query("""
WITH s AS (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1),
t AS (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT coalesce(s.o_orderpriority, t.o_orderpriority) AS o_orderpriority, coalesce(s.n, 0) AS source, coalesce(t.n, 0) AS target
FROM s FULL JOIN t ON s.o_orderpriority = t.o_orderpriority""")
def i38_counts_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    return catalog.group_counts(o.where(p != "1-URGENT"), o.where((F.col("o_orderkey") % 97 != 0) & (p != "5-LOW")), "o_orderpriority")


@query("""
SELECT name FROM (SELECT DISTINCT source AS name FROM documents UNION SELECT DISTINCT 'pg_temp_' || lang FROM documents)
WHERE name NOT LIKE 'pg\\_temp\\_%' ESCAPE '\\' AND name NOT IN ('src3', 'src5')""")
def s06_discover_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    names = d.select(F.col("source").alias("name")).distinct().unionByName(d.select(F.concat(F.lit("pg_temp_"), "lang").alias("name")).distinct())
    return catalog.discover(names, exclude=["src3", "src5"])


@query("""
WITH have AS (SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS l FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderpriority <> '3-MEDIUM')
SELECT DISTINCT o_orderstatus, o_orderpriority AS label FROM orders
WHERE NOT EXISTS (SELECT 1 FROM have WHERE s = o_orderstatus AND l = o_orderpriority)""")
def d05_enum_missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("order", F.col("o_orderpriority"))
    of = lambda df: catalog.ordered_labels(df, ["o_orderstatus"], "o_orderpriority", "order")
    return catalog.missing_labels(of(o), of(o.where("o_orderkey % 97 <> 0 and o_orderpriority <> '3-MEDIUM'")), ["o_orderstatus"])


# ---- sequences ------------------------------------------------------------------------


def _marks(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("key")).agg(F.max(value).alias("last_value")).select(
        "key", "last_value", F.lit(1).cast("long").alias("start_value"), F.lit(True).alias("readable")
    )


def _customer_marks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    return _marks(c, "c_nationkey", "c_custkey"), _marks(c.where("c_custkey % 7 <> 0"), "c_nationkey", "c_custkey")


def _with_value_after(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value_after", F.coalesce("new_value", "target_value")).drop("new_value")


_MARKS_SQL = """
s AS (SELECT c_nationkey AS k, max(c_custkey) AS v FROM customer GROUP BY 1),
t AS (SELECT c_nationkey AS k, max(c_custkey) AS v FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1)"""
_SYNC_SQL = f"""WITH {_MARKS_SQL}
SELECT s.k AS key, s.v AS source_value, t.v AS target_value,
       CASE WHEN s.v > t.v THEN 'updated' WHEN s.v < t.v THEN 'target_ahead' ELSE 'ok' END AS status,
       CASE WHEN s.v > t.v THEN s.v + MARGIN ELSE t.v END AS value_after
FROM s JOIN t ON s.k = t.k"""


@query(_SYNC_SQL.replace("MARGIN", "0"))
def x04_sequence_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_value_after(sequences.reconcile(*_customer_marks(spark, sf_dir)))


@query(_SYNC_SQL.replace("MARGIN", "1000"))
def x04_sequence_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_value_after(sequences.reconcile(*_customer_marks(spark, sf_dir), margin=1000))


@query("""
WITH u AS (SELECT s_nationkey AS k, max(s_suppkey) AS m FROM supplier WHERE s_nationkey % 4 <> 1 GROUP BY 1),
t AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 1000000 END AS v FROM nation WHERE n_nationkey % 2 = 1)
SELECT t.k AS key, CAST(CASE WHEN u.k IS NULL THEN t.v ELSE greatest(u.m + 1, t.v) END AS BIGINT) AS target_value,
       CASE WHEN u.k IS NULL THEN 'orphaned_unknown' WHEN u.m + 1 > t.v THEN 'orphaned_fixed' ELSE 'ok' END AS status
FROM t LEFT JOIN u USING (k)""")
def x05_orphan_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"))
    mark = F.when(F.col("key") % 3 == 0, F.lit(1)).otherwise(F.lit(1000000)).cast("long")
    target = n.select("key", mark.alias("last_value"), F.lit(1).cast("long").alias("start_value"), F.lit(True).alias("readable"))
    used = table(spark, sf_dir, "supplier").where("s_nationkey % 4 <> 1").groupBy(F.col("s_nationkey").alias("key")).agg(F.max("s_suppkey").alias("max_id"))
    return sequences.orphans(target.where("key % 2 = 0"), target, used)


@query(f"""WITH {_MARKS_SQL}
SELECT s.k AS key, s.v AS source_value, coalesce(t.v, -1) AS target_value,
       CASE WHEN t.k IS NULL THEN 'missing_on_target' WHEN s.v > t.v THEN 'behind' WHEN s.v < t.v THEN 'target_ahead' ELSE 'ok' END AS status
FROM s LEFT JOIN (SELECT * FROM t WHERE k % 5 <> 0) t ON s.k = t.k""")
def x06_sequence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _customer_marks(spark, sf_dir)
    return sequences.read_only_status(source, target.where("key % 5 <> 0")).withColumn("target_value", F.coalesce("target_value", F.lit(-1)))


# ---- integrity ------------------------------------------------------------------------


@query(f"""WITH {_ORDERS_TARGET}
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM t)""")
def d16_fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = integrity.foreign_key_violations(table(spark, sf_dir, "lineitem"), orders_target(spark, sf_dir), ["l_orderkey"], ["o_orderkey"])
    return bad.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def d14_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- names and statements -------------------------------------------------------------


@query("""SELECT c_custkey, '"' || replace(c_mktsegment || '"x', '"', '""') || '"."' || replace(c_name, '"', '""') || '"' AS quoted FROM customer""")
def f01_quote_ident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", N.qualified(F.concat("c_mktsegment", F.lit('"x')), F.col("c_name")).alias("quoted"))


@query("SELECT doc_id, md5('''' || replace(text, '''', '''''') || '''') AS literal_md5 FROM documents")
def f03_quote_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(N.quote_literal(F.col("text"))).alias("literal_md5"))


@query("""
SELECT c_custkey, 'sub_' || CASE WHEN p = c_name THEN p ELSE p || '_' || substr(sha1(c_name), 1, 6) END AS name
FROM (SELECT c_custkey, c_name, regexp_replace(lower(c_name), '[^a-z0-9]', '_', 'g') AS p FROM customer)""")
def f04_safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", N.stream_name("sub", F.col("c_name")).alias("name"))


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(coalesce(text, ''), '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g'), '[ \t\n\v\f\r]+', ' ', 'g')) AS norm_md5
FROM documents""")
def f06_normalize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(N.normalize_ws(F.col("text"))).alias("norm_md5"))


@query(r"""
SELECT event_id, 'db=' || event_type || ' section=table schema=' ||
       CASE WHEN props = '' THEN '""' WHEN regexp_matches(props, '[ \t\n"=]') THEN '"' || replace(props, '"', '\"') || '"' ELSE props END AS line
FROM events""")
def f07_kv_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", status.line(F.col("event_type"), "table", schema=N.kv_quote(F.col("props"))).alias("line")
    )


@query("""
SELECT event_id, CAST((event_id // 7 - event_id // 9) * 4294967296 + (event_id * 31 - event_id * 17) AS BIGINT) AS lag_bytes FROM events""")
def f12_lsn_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lsn = lambda high, low: F.concat_ws("/", F.hex(high), F.hex(low))
    e = F.col("event_id")
    sent, received = lsn(F.floor(e / 7), e * 31), lsn(F.floor(e / 9), e * 17)
    return table(spark, sf_dir, "events").select("event_id", (N.lsn_to_number(sent) - N.lsn_to_number(received)).cast("long").alias("lag_bytes"))


@query("""
SELECT n_nationkey, 'GRANT SELECT ON TABLE "public"."' || n_name || '" TO ' ||
       CASE WHEN n_regionkey = 0 THEN 'PUBLIC' ELSE '"r' || n_regionkey || '"' END || CASE WHEN n_nationkey % 2 = 0 THEN ' WITH GRANT OPTION' ELSE '' END AS add,
       'REVOKE SELECT ON TABLE "public"."' || n_name || '" FROM ' || CASE WHEN n_regionkey = 0 THEN 'PUBLIC' ELSE '"r' || n_regionkey || '"' END AS remove
FROM nation""")
def f24_grant_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.when(F.col("n_regionkey") != 0, F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    what = S.object_text(F.lit("table"), F.lit("public"), F.col("n_name"))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", S.grant(F.lit("SELECT"), what, who, F.col("n_nationkey") % 2 == 0).alias("add"), S.revoke(F.lit("SELECT"), what, who).alias("remove")
    )


@query("""
WITH m AS (SELECT max(ts) AS now FROM events),
a AS (SELECT event_id, user_id, CAST(floor(epoch(now) - epoch(ts)) AS BIGINT) AS age FROM events, m)
SELECT event_id, age, printf('%02d:%02d:%02d', age // 3600, age % 3600 // 60, age % 60) AS age_text FROM a WHERE age > 30""")
def i35_long_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    age = F.floor(micros(F.lit(now)) / 1e6 - micros(F.col("ts")) / 1e6).cast("long")
    return events.select("event_id", age.alias("age")).where("age > 30").orderBy(F.desc("age")).select("event_id", "age", N.hms(F.col("age")).alias("age_text"))


# ---- drift report ---------------------------------------------------------------------


def _catalog_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tables named after parts: schema = brand, table = part; the target lacks some and has others."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("schema_name"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("table_name"), "p_partkey", "p_type")
    extra = p.where("p_partkey % 31 = 0").withColumn("table_name", F.concat("table_name", F.lit("_old")))
    return p, p.where("p_partkey % 23 <> 0").unionByName(extra)


@query("""
SELECT 'missing_on_target' AS drift_type, 'part' || p_partkey AS name, '' AS fix_ddl FROM part WHERE p_partkey % 23 = 0
UNION ALL SELECT 'missing_on_source', 'part' || p_partkey || '_old', 'DROP TABLE "' || p_brand || '"."part' || p_partkey || '_old"' FROM part WHERE p_partkey % 31 = 0""")
def x01_table_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.table_drift(*_catalog_pair(spark, sf_dir)).select("drift_type", "name", "fix_ddl")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS is_fk,
       row_number() OVER (ORDER BY CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END, p_brand, 'part' || p_partkey) AS place
FROM part WHERE p_partkey % 23 = 0""")
def o04_fix_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _catalog_pair(spark, sf_dir)
    kind = F.when(F.col("p_partkey") % 3 == 0, "ALTER TABLE x ADD CONSTRAINT y FOREIGN KEY").otherwise("CREATE TABLE x")
    items = drift.table_drift(source, target, source.select("schema_name", "table_name", kind.alias("ddl")))
    part = F.substring("name", 5, 20).cast("long")
    return with_places(drift.fixes(items), "is_fk", *drift.ordered()).select(part.alias("p_partkey"), "is_fk", "place")


# ---- status ---------------------------------------------------------------------------

_STATE = """
c AS (SELECT c_custkey, c_name, regexp_replace(lower(c_name), '[^a-z0-9]', '_', 'g') || '_' || substr(sha1(c_name), 1, 6) AS nm FROM customer)"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("database"))
    name = N.stream_name("s", F.col("database"))
    key = F.col("c_custkey")
    subs = c.where(key % 5 != 0).select(name.alias("subname"), F.when(key % 4 == 0, "12 MB").otherwise("0 bytes").alias("lag"))
    slots = c.where(key % 7 != 0).select(name.alias("slot_name"), (key % 3 != 0).alias("active"))
    lag = c.where(key % 2 == 0).select(name.alias("application_name"), key.alias("sent"))
    return status.merge_status(c, "s", subs, slots, lag)


@query(f"""WITH {_STATE}
SELECT c_name AS database, CAST(c_custkey % 5 <> 0 AS BIGINT) AS n_subscriptions, CAST(c_custkey % 7 <> 0 AS BIGINT) AS n_slots, CAST(c_custkey % 2 = 0 AS BIGINT) AS n_lag FROM c""")
def j19_status_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.size(c).cast("long")
    return _status(spark, sf_dir).select("database", n("subscription").alias("n_subscriptions"), n("slots").alias("n_slots"), n("lag").alias("n_lag"))


@query("""
SELECT health, CASE health WHEN 'error' THEN 'err' WHEN 'ok' THEN 'ok' ELSE 'warn' END AS level, count(*) AS n FROM (
  SELECT CASE WHEN c_custkey % 11 = 0 THEN 'error' WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'no replication'
              WHEN c_custkey % 3 = 0 THEN 'slot inactive' WHEN c_custkey % 13 = 0 OR c_custkey % 4 = 0 THEN 'warning' ELSE 'ok' END AS health
  FROM customer) GROUP BY 1, 2""")
def f29_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _status(spark, sf_dir)
    active = F.size(F.filter("slots", lambda s: s["active"]))
    text = status.health(F.col("c_custkey") % 11 == 0, F.size("subscription"), F.size("slots"), active, (F.col("c_custkey") % 13 == 0).cast("int"), F.get("subscription", F.lit(0))["lag"])
    return rows.select(text.alias("health")).groupBy("health").agg(F.count(F.lit(1)).alias("n")).select("health", status.level(F.col("health")).alias("level"), "n")


@query(r"""
WITH s AS (SELECT o_orderpriority AS p, count(*) AS n, count(*) FILTER (o_orderkey % 97 <> 0) AS m FROM orders GROUP BY 1)
SELECT 'db=orders section=table schema=' || p || ' source=' || n || ' target=' || m || ' match=' || CASE WHEN n = m THEN 'true' ELSE 'false' END AS line FROM s""")
def m07_table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = catalog.group_counts(o, o.where("o_orderkey % 97 <> 0"), "o_orderpriority")
    return status.table_lines(rows.select(F.lit("orders").alias("database"), F.col("o_orderpriority").alias("schema"), "source", "target"))


# ---- streams --------------------------------------------------------------------------


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0)")
def r11_new_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracked = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return reinit.new_tables(table(spark, sf_dir, "nation").select("n_nationkey"), tracked)


@query(f"""
WITH s AS (SELECT s_name AS database, s_suppkey % 2 = 0 AS pub, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'lost' ELSE 'reserved' END AS slot,
                  s_suppkey % 5 <> 0 AS sub, s_suppkey % 7 <> 0 AS en, s_suppkey % 11 <> 0 AS run FROM supplier)
SELECT database,
  concat_ws('; ', CASE WHEN NOT pub THEN 'publication not found on source' END, CASE WHEN slot IS NULL THEN 'replication slot not found' END,
    CASE WHEN slot = 'lost' THEN 'replication slot is lost' END, CASE WHEN slot = 'reserved' AND NOT sub THEN 'subscription not found on target' END,
    CASE WHEN slot = 'reserved' AND sub AND NOT en THEN 'subscription exists but is disabled' END,
    CASE WHEN slot = 'reserved' AND sub AND en AND NOT run THEN 'apply worker is not running' END,
    CASE WHEN coalesce(slot, 'lost') = 'lost' AND sub THEN 'subscription has no usable slot' END,
    CASE WHEN coalesce(slot, 'lost') = 'lost' AND NOT sub THEN 'subscription not found on target' END,
    CASE WHEN coalesce(slot, 'lost') = 'lost' THEN '{reinit.LOST_WINDOW}' END) AS issues,
  concat_ws('; ', CASE WHEN NOT pub THEN 'recreate publication' END, CASE WHEN slot = 'reserved' AND NOT sub THEN 'recreate subscription on the surviving slot' END,
    CASE WHEN slot = 'reserved' AND sub AND NOT en THEN 'enable subscription' END,
    CASE WHEN slot = 'reserved' AND sub AND en AND NOT run THEN 'refresh subscription without copy' END,
    CASE WHEN coalesce(slot, 'lost') = 'lost' AND sub THEN 'drop subscription' END, CASE WHEN slot = 'lost' THEN 'drop slot' END,
    CASE WHEN coalesce(slot, 'lost') = 'lost' THEN 'recreate subscription with a fresh slot' END) AS actions,
  coalesce(pub AND slot = 'reserved' AND sub AND en AND run, FALSE) AS was_healthy
FROM s""")
def r13_reinit_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    state = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("database"), (k % 2 == 0).alias("has_publication"), F.when(k % 3 == 1, "lost").when(k % 3 == 2, "reserved").alias("slot_status"),
        (k % 5 != 0).alias("has_subscription"), (k % 7 != 0).alias("is_enabled"), (k % 11 != 0).alias("worker_running"),
    )
    return reinit.decide(state).select("database", F.array_join("issues_found", "; ").alias("issues"), F.array_join("actions_taken", "; ").alias("actions"), "was_healthy")


_FINAL_SQL = """
SELECT user_id, event_id, event_type FROM (
  SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
WHERE k = 1 AND event_type <> 'error'"""


def as_changes(events: DataFrame) -> DataFrame:
    """events as changes of a table keyed by user: sign-ups insert, errors delete, the rest update."""
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    lsn = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(lsn.alias("lsn"), F.col("event_id").alias("seq"), op.alias("op"), "user_id", "event_id", "event_type")


@query(_FINAL_SQL)
def r14_cdc_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = as_changes(table(spark, sf_dir, "events"))
    empty = log.select("user_id", "event_id", "event_type").limit(0)
    return changes.apply_keyed(empty, log, ["user_id"])


@query("""
WITH b AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
d AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2)
SELECT l_orderkey, l_returnflag FROM (SELECT b.l_orderkey, b.l_returnflag, unnest(range(b.n - coalesce(d.n, 0))) AS i
  FROM b LEFT JOIN d ON b.l_orderkey = d.l_orderkey AND b.l_returnflag = d.l_returnflag)""")
def r14_cdc_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    base = rows.select("l_orderkey", "l_returnflag")
    return changes.apply_multiset(base, base.limit(0), rows.where("l_linenumber = 1").select("l_orderkey", "l_returnflag"))


@query(_FINAL_SQL)
def r14_stream_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state, by a stream over files that come in no order: one batch for each, compacted on the way."""
    from .streaming.apply import start_apply
    from .streaming.tables import ChangeTable

    log, at = as_changes(table(spark, sf_dir, "events")), shared_path(spark, "changes")
    log.repartition(4, "event_id").write.parquet(at)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(at)
    target = ChangeTable(spark, shared_path(spark, "users"), log.select("user_id", "event_id", "event_type").schema, ["user_id"])
    start_apply(stream, target, shared_path(spark, "users-checkpoint")).awaitTermination()
    target.compact()
    return target.read()


@query("""
SELECT user_id, event_id, event_type FROM (
  SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, live DESC) AS k, live
  FROM (SELECT CASE WHEN event_type = 'view' THEN user_id + 1000 ELSE user_id END AS user_id, event_id, ts, event_type, event_type <> 'error' AS live FROM events
        UNION ALL SELECT user_id, event_id, ts, event_type, FALSE FROM events WHERE event_type = 'view'))
WHERE k = 1 AND live""")
def r14_key_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views move their user's row to another key."""
    log = as_changes(table(spark, sf_dir, "events"))
    moves = F.col("event_type") == "view"
    log = log.withColumn("before", F.when(moves, F.struct("user_id"))).withColumn("user_id", F.when(moves, F.col("user_id") + 1000).otherwise(F.col("user_id")))
    empty = log.select("user_id", "event_id", "event_type").limit(0)
    return changes.apply_keyed(empty, log, ["user_id"])


from . import catalog_queries, stream_queries  # noqa: E402, F401  register their queries
