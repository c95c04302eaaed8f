"""Catalog frames as joins over the system tables of a PostgreSQL side.

`System` holds one DataFrame for each system table, as `sources.jdbc` reads it: the table's
own columns, with what only the server can render (an index's definition, an expression, a
type's name) as text columns beside them. Access lists are arrays of (grantee, privilege_type,
is_grantable), with grantee 0 for everybody. Every function gives one frame for all tables of
all chosen schemas; what the server would be asked table by table is one join here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the catalog's one-letter kinds are called.
RELATION_KINDS = {"r": "table", "p": "table", "v": "view", "m": "materialized_view", "S": "sequence"}
ROUTINE_KINDS = {"f": "function", "p": "procedure"}


def called(code: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


@dataclass
class System:
    """System tables by name (pg_class and so on), and the schemas to look at (all if None)."""

    tables: dict[str, DataFrame]
    schemas: list[str] | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def named(self, rows: DataFrame, namespace: str, how: str = "inner", name: str = "schema_name") -> DataFrame:
        """rows with the name of the schema whose oid is in `namespace`; only chosen schemas with an inner join."""
        names = self["pg_namespace"].select(F.col("oid").alias(namespace), F.col("nspname").alias(name))
        if self.schemas is not None and how == "inner":
            names = names.where(F.col(name).isin(self.schemas))
        return rows.join(names, namespace, how)

    def unowned(self, rows: DataFrame, of: str, key: str = "oid", kind: str = "e") -> DataFrame:
        """rows that nothing has taken in: no extension (e), no object that makes them by itself (i)."""
        taken = self["pg_depend"].where((F.col("classid") == of) & (F.col("deptype") == kind)).select(F.col("objid").alias(key))
        return rows.join(taken, key, "left_anti")

    def relations(self, kinds: str) -> DataFrame:
        return self.named(self["pg_class"].where(F.col("relkind").isin(list(kinds))), "relnamespace").withColumnRenamed("relname", "table_name")

    def collations(self, key: str) -> DataFrame:
        """key, collation_name, collation_schema."""
        return self.named(self["pg_collation"].select(F.col("oid").alias(key), F.col("collname").alias("collation_name"), "collnamespace"), "collnamespace", "left", "collation_schema").drop("collnamespace")

    def routines(self, key: str, prefix: str) -> DataFrame:
        """key, and the schema and name of the routine with that oid."""
        rows = self["pg_proc"].select(F.col("oid").alias(key), F.col("proname").alias(f"{prefix}_name"), F.col("pronamespace").alias("_ns"))
        return self.named(rows, "_ns", "left", f"{prefix}_schema").drop("_ns")

    def roles(self, key: str, name: str) -> DataFrame:
        return self["pg_roles"].select(F.col("oid").alias(key), F.col("rolname").alias(name))


_TABLE = ["schema_name", "table_name"]


def attributes(s: System) -> DataFrame:
    """The columns of tables with no more than their types; `columns` tells the rest."""
    tables = s.relations("rp").select(F.col("oid").alias("attrelid"), *_TABLE)
    types = s["pg_type"].select(F.col("oid").alias("atttypid"))
    rows = s["pg_attribute"].where("attnum > 0 and not attisdropped").join(tables, "attrelid").join(types, "atttypid")
    return rows.select(*_TABLE, F.col("attname").alias("column_name"), F.col("format_type").alias("data_type"))


def columns(s: System) -> DataFrame:
    """The columns of tables; a collation only where it isn't its type's own, identity columns with their sequence's options."""
    q = s["pg_sequence"]
    text = lambda c: F.col(c).cast("string")
    options = q.select(
        F.col("seqrelid").alias("objid"),
        F.concat(
            F.lit("INCREMENT BY "), text("seqincrement"), F.lit(" MINVALUE "), text("seqmin"), F.lit(" MAXVALUE "), text("seqmax"),
            F.lit(" START WITH "), text("seqstart"), F.lit(" CACHE "), text("seqcache"), F.when(F.col("seqcycle"), " CYCLE").otherwise(""),
        ).alias("identity_options"),
    )
    inner = s["pg_depend"].where("classid = 'pg_class' and refclassid = 'pg_class' and deptype = 'i'")
    options = inner.join(options, "objid").select(F.col("refobjid").alias("attrelid"), F.col("refobjsubid").alias("attnum"), "identity_options")
    defaults = s["pg_attrdef"].select(F.col("adrelid").alias("attrelid"), F.col("adnum").alias("attnum"), F.col("expr").alias("column_default"))
    types = s["pg_type"].select(F.col("oid").alias("atttypid"), "typcollation")
    tables = s.relations("rp").select(F.col("oid").alias("attrelid"), *_TABLE)
    rows = (
        s["pg_attribute"].where("attnum > 0 and not attisdropped").join(tables, "attrelid").join(types, "atttypid")
        .join(defaults, ["attrelid", "attnum"], "left").join(options, ["attrelid", "attnum"], "left").join(s.collations("attcollation"), "attcollation", "left")
    )
    own = (F.col("attcollation") != 0) & (F.col("attcollation") != F.col("typcollation"))
    return rows.select(
        *_TABLE, F.col("attname").alias("column_name"), F.col("attnum").alias("ordinal"), F.col("format_type").alias("data_type"),
        F.col("attnotnull").alias("not_null"), "column_default", (F.col("attgenerated") == "s").alias("is_generated"), F.col("attidentity").alias("identity"),
        F.when(F.col("attidentity").isin("a", "d"), F.col("identity_options")).alias("identity_options"),
        F.when(own, F.col("collation_name")).alias("collation_name"), F.when(own, F.col("collation_schema")).alias("collation_schema"),
    )


def indexes(s: System) -> DataFrame:
    tables = s.relations("rpm").select(F.col("oid").alias("indrelid"), *_TABLE)
    names = s["pg_class"].select(F.col("oid").alias("indexrelid"), F.col("relname").alias("index_name"))
    return s["pg_index"].join(tables, "indrelid").join(names, "indexrelid").select(
        *_TABLE, "index_name", F.col("indexdef").alias("index_def"), F.col("indisprimary").alias("is_primary"), F.col("indisunique").alias("is_unique")
    )


def constraints(s: System) -> DataFrame:
    tables = s.relations("rp").select(F.col("oid").alias("conrelid"), *_TABLE)
    return s["pg_constraint"].join(tables, "conrelid").select(
        *_TABLE, F.col("conname").alias("constraint_name"), F.col("contype").alias("constraint_type"), F.col("constraintdef").alias("constraint_def")
    )


def sequences(s: System) -> DataFrame:
    """Sequences, the column that owns each (null without one), and whether it belongs to an identity column."""
    d = s["pg_depend"]
    owners = s.named(s["pg_class"].select(F.col("oid").alias("refobjid"), F.col("relname").alias("_t"), "relnamespace"), "relnamespace", "left", "_s")
    columns = s["pg_attribute"].select(F.col("attrelid").alias("refobjid"), F.col("attnum").alias("refobjsubid"), F.col("attname").alias("_c"))
    owned = d.where("deptype = 'a'").join(owners, "refobjid").join(columns, ["refobjid", "refobjsubid"], "left").select(
        F.col("objid").alias("oid"), F.concat("_s", F.lit("."), "_t", F.lit("."), "_c").alias("owned_by")
    )
    inner = d.where("classid = 'pg_class' and deptype = 'i'").select(F.col("objid").alias("oid"), F.lit(True).alias("_inner")).distinct()
    return s.relations("S").join(owned, "oid", "left").join(inner, "oid", "left").select(
        "schema_name", F.col("table_name").alias("sequence_name"), "owned_by", F.col("_inner").isNotNull().alias("is_identity")
    )


def sequence_definitions(s: System) -> DataFrame:
    """Sequences and identity columns' sequences with what they were made with; null where the catalog doesn't tell."""
    parameters = s["pg_sequence"].select(F.col("seqrelid").alias("oid"), *[F.col(f"seq{x}").alias(x) for x in ("increment", "min", "max", "start", "cache", "cycle")])
    inner = s["pg_depend"].where("classid = 'pg_class' and deptype = 'i'").select(F.col("objid").alias("oid"), F.lit(True).alias("_inner")).distinct()
    rows = s.relations("S").join(parameters, "oid", "left").join(inner, "oid", "left")
    return rows.select("schema_name", F.col("table_name").alias("sequence_name"), "increment", "min", "max", "start", "cache", "cycle", F.col("_inner").isNotNull().alias("is_identity"))


def sequence_owner(sequences_: DataFrame) -> DataFrame:
    """The one owning column of each sequence: the first by name, where the catalog tells of several."""
    return sequences_.where("owned_by is not null").groupBy("schema_name", "sequence_name").agg(F.min("owned_by").alias("owned_by"))


def functions(s: System) -> DataFrame:
    """Functions and procedures that no extension and no other object made."""
    rows = s["pg_proc"].where(F.col("prokind").isin(*ROUTINE_KINDS))
    rows = s.unowned(s.unowned(rows, "pg_proc"), "pg_proc", kind="i")
    return s.named(rows, "pronamespace").select(
        "schema_name", F.col("proname").alias("func_name"), F.col("functiondef").alias("func_def"), F.col("oid").alias("func_oid"), F.col("identity_args").alias("func_args")
    )


def triggers(s: System) -> DataFrame:
    """Triggers that users made: not internal, no copy on a partition, neither they nor their function an extension's."""
    rows = s.unowned(s.unowned(s["pg_trigger"].where("not tgisinternal and tgparentid = 0"), "pg_trigger").withColumnRenamed("oid", "_oid"), "pg_proc", "tgfoid")
    tables = s.named(s["pg_class"], "relnamespace").select(F.col("oid").alias("tgrelid"), "schema_name", F.col("relname").alias("table_name"))
    return rows.join(tables, "tgrelid").select(
        *_TABLE, F.col("tgname").alias("trigger_name"), F.col("triggerdef").alias("trigger_def"), F.col("tgenabled").alias("enabled")
    )


def views(s: System, hypertable_views: DataFrame | None = None, marker: str | None = None) -> DataFrame:
    """Views and materialized views; those that another system keeps up to date go.

    hypertable_views: schema_name, view_name of the kept ones, None where the side has no such
    table. marker: text that gives such a view away in its definition.
    """
    rows = s.unowned(s.relations("vm"), "pg_class").select("schema_name", F.col("table_name").alias("view_name"), "relkind", F.col("viewdef").alias("view_def"))
    if hypertable_views is not None:
        rows = rows.join(hypertable_views, ["schema_name", "view_name"], "left_anti")
    return rows.where(~F.contains("view_def", F.lit(marker))) if marker else rows


def view_needs(s: System) -> DataFrame:
    """schema_name, view_name, needs_schema_name, needs_view_name: views that a view's rule reads."""
    named = s.named(s["pg_class"].where(F.col("relkind").isin("v", "m")), "relnamespace", "left").select("oid", "schema_name", F.col("relname").alias("view_name"))
    rules = s["pg_depend"].where("classid = 'pg_rewrite' and refclassid = 'pg_class' and deptype = 'n'").select(F.col("objid").alias("rule"), F.col("refobjid").alias("needs"))
    rules = rules.join(s["pg_rewrite"].select(F.col("oid").alias("rule"), F.col("ev_class").alias("oid")), "rule").where("oid <> needs").select("oid", "needs").distinct()
    other = named.select(F.col("oid").alias("needs"), F.col("schema_name").alias("needs_schema_name"), F.col("view_name").alias("needs_view_name"))
    return rules.join(named, "oid").join(other, "needs").select("schema_name", "view_name", "needs_schema_name", "needs_view_name")


def type_needs(s: System) -> DataFrame:
    """schema_name, type_name, needs_schema_name, needs_type_name: types that a type is made of."""
    named = s.named(s["pg_type"], "typnamespace", "left").select("oid", "schema_name", F.col("typname").alias("type_name"))
    pairs = s["pg_depend"].where("classid = 'pg_type' and refclassid = 'pg_type' and deptype = 'n'").select(F.col("objid").alias("oid"), F.col("refobjid").alias("needs")).distinct()
    other = named.select(F.col("oid").alias("needs"), F.col("schema_name").alias("needs_schema_name"), F.col("type_name").alias("needs_type_name"))
    return pairs.join(named, "oid").join(other, "needs").select("schema_name", "type_name", "needs_schema_name", "needs_type_name")


def partition_info(s: System) -> DataFrame:
    """How each table is partitioned, and of what it is a partition."""
    parents = s.named(s["pg_class"].select(F.col("oid").alias("inhparent"), F.col("relname").alias("parent_name"), "relnamespace"), "relnamespace", "left", "parent_schema")
    parents = s["pg_inherits"].join(parents, "inhparent").select(F.col("inhrelid").alias("oid"), "parent_schema", "parent_name")
    child = F.col("relispartition")
    return s.relations("rp").join(parents, "oid", "left").select(
        *_TABLE, (F.col("relkind") == "p").alias("is_partitioned"), child.alias("is_partition"),
        F.when(F.col("relkind") == "p", F.col("partkeydef")).alias("partition_by"), F.when(child, F.col("partbound")).alias("bound"),
        F.when(child, F.col("parent_schema")).alias("parent_schema"), F.when(child, F.col("parent_name")).alias("parent_name"),
    )


def composite_types(s: System) -> DataFrame:
    """schema_name, type_name, attributes (name and type, in order)."""
    own = s["pg_class"].where("relkind = 'c'").select(F.col("oid").alias("typrelid"))
    types = s.unowned(s.named(s["pg_type"].where("typtype = 'c'"), "typnamespace"), "pg_type").join(own, "typrelid", "left_semi")
    parts = s["pg_attribute"].where("attnum > 0 and not attisdropped").select(F.col("attrelid").alias("typrelid"), "attnum", "attname", "format_type")
    return types.join(parts, "typrelid").groupBy("schema_name", F.col("typname").alias("type_name")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("attnum", "attname", "format_type"))), lambda a: F.struct(a["attname"].alias("name"), a["format_type"].alias("type"))).alias("attributes")
    )


def row_security(s: System) -> DataFrame:
    return s.relations("rp").select(*_TABLE, F.col("relrowsecurity").alias("rowsecurity"), F.col("relforcerowsecurity").alias("force_rowsecurity"))


def policies(s: System) -> DataFrame:
    """Row policies; the roles by name and sorted, everybody as PUBLIC."""
    tables = s.named(s["pg_class"], "relnamespace").select(F.col("oid").alias("polrelid"), "schema_name", F.col("relname").alias("table_name"))
    rows = s["pg_policy"].join(tables, "polrelid")
    key = ["polrelid", "polname"]
    named = rows.select(*key, F.explode("polroles").alias("role")).join(s.roles("role", "rolname"), "role").groupBy(*key).agg(F.array_sort(F.collect_set("rolname")).alias("_roles"))
    everybody = (F.size("polroles") == 1) & (F.get("polroles", F.lit(0)) == 0)
    return rows.join(named, key, "left").select(
        *_TABLE, F.col("polname").alias("policy_name"), "polcmd", F.col("polpermissive").alias("permissive"),
        F.when(everybody, F.array(F.lit("PUBLIC"))).otherwise(F.coalesce("_roles", F.array().cast("array<string>"))).alias("roles"), "using_expr", "check_expr",
    )


def collations(s: System, version: int) -> DataFrame:
    """Collations; the provider's locale stands in another column from version to version."""
    locale = F.col("colllocale") if version >= 17 else F.col("colliculocale") if version >= 15 else F.col("collcollate")
    rows = s.unowned(s.named(s["pg_collation"], "collnamespace"), "pg_collation")
    return rows.select(
        "schema_name", F.col("collname").alias("coll_name"), F.col("collprovider").alias("provider"), F.col("collisdeterministic").alias("deterministic"),
        "collcollate", "collctype", locale.alias("provider_locale"),
    )


def domains(s: System) -> DataFrame:
    """Domains with their checks, in one join."""
    types = s.unowned(s.named(s["pg_type"].where("typtype = 'd'"), "typnamespace"), "pg_type")
    base = s["pg_type"].select(F.col("oid").alias("typbasetype"), F.col("typcollation").alias("_base"))
    check = F.struct("conname", "constraintdef")
    checks = s["pg_constraint"].where("contypid <> 0").groupBy(F.col("contypid").alias("oid")).agg(
        F.transform(F.array_sort(F.collect_list(check)), lambda c: F.struct(c["conname"].alias("name"), c["constraintdef"].alias("def"))).alias("checks")
    )
    rows = types.join(base, "typbasetype", "left").join(s.collations("typcollation"), "typcollation", "left").join(checks, "oid", "left")
    own = (F.col("typcollation") != 0) & ~F.col("typcollation").eqNullSafe(F.col("_base"))
    return rows.select(
        "schema_name", F.col("typname").alias("type_name"), F.col("base_format").alias("base_type"), F.col("typnotnull").alias("not_null"), F.col("typdefault").alias("default_expr"),
        F.when(own, F.col("collation_name")).alias("collation_name"), F.when(own, F.col("collation_schema")).alias("collation_schema"), "checks",
    )


def range_types(s: System) -> DataFrame:
    types = s.unowned(s.named(s["pg_type"], "typnamespace"), "pg_type").select(F.col("oid").alias("rngtypid"), "schema_name", F.col("typname").alias("type_name"))
    return (
        s["pg_range"].join(types, "rngtypid").join(s.collations("rngcollation"), "rngcollation", "left")
        .join(s.routines("rngcanonical", "canonical"), "rngcanonical", "left").join(s.routines("rngsubdiff", "diff"), "rngsubdiff", "left")
        .select("schema_name", "type_name", "subtype", "collation_name", "collation_schema", "canonical_schema", "canonical_name", "diff_schema", "diff_name")
    )


#: The support functions of an aggregate: column of pg_aggregate, and what their name's columns begin with.
SUPPORT = {
    "aggtransfn": "transfn", "aggfinalfn": "finalfn", "aggcombinefn": "combinefn", "aggserialfn": "serialfn", "aggdeserialfn": "deserialfn",
    "aggmtransfn": "mtransfn", "aggminvtransfn": "minvtransfn", "aggmfinalfn": "mfinalfn",
}


def aggregates(s: System) -> DataFrame:
    """User-made aggregates with the names of their support functions."""
    owned = s.named(s.unowned(s["pg_proc"], "pg_proc"), "pronamespace").select(
        F.col("oid").alias("aggfnoid"), "schema_name", F.col("proname").alias("agg_name"), F.col("arguments").alias("args"), F.col("proparallel").alias("parallel")
    )
    rows = s["pg_aggregate"].join(owned, "aggfnoid")
    for column, prefix in SUPPORT.items():
        rows = rows.join(s.routines(column, prefix), column, "left")
    names = [f"{p}_{x}" for p in SUPPORT.values() for x in ("schema", "name")]
    return rows.select(
        "schema_name", "agg_name", "args", "aggkind", *names, "transtype", "mtranstype", "agginitval", "aggminitval", "aggfinalextra", "aggmfinalextra",
        F.col("aggfinalmodify").alias("finalmodify"), F.col("aggmfinalmodify").alias("mfinalmodify"), (F.col("aggsortop") != 0).alias("has_sortop"), "parallel",
    )


def tables_without_key(s: System) -> DataFrame:
    """Plain tables whose rows no primary key tells apart, and that no other identity was chosen for."""
    keyed = s["pg_index"].where("indisprimary").select(F.col("indrelid").alias("oid"))
    return s.relations("r").where(F.col("relreplident").isin("d", "n")).join(keyed, "oid", "left_anti").select(*_TABLE)


def extensions(s: System) -> DataFrame:
    """Extensions but the language that is always there."""
    return s.named(s["pg_extension"].where("extname <> 'plpgsql'"), "extnamespace", "left").select(F.col("extname").alias("name"), "schema_name")


def inheriting_tables(s: System) -> DataFrame:
    """Tables that inherit from others without being partitions."""
    children = s["pg_inherits"].select(F.col("inhrelid").alias("oid")).distinct()
    return s.relations("rp").where("not relispartition").join(children, "oid", "left_semi").select(*_TABLE)


def publishable_tables(s: System) -> DataFrame:
    """Tables that a stream can name: plain and partitioned ones, partitions come with their parents."""
    return s.relations("rp").where("not relispartition").select(*_TABLE)


def owners(s: System, databases: bool = True) -> DataFrame:
    """kind, schema_name, object_name, func_args, owner of relations, schemas, types, routines and databases."""
    null = F.lit(None).cast("string")

    def of(rows: DataFrame, owner: str, kind: Column, name: str, args: Column = null, schema: Column | None = None) -> DataFrame:
        return rows.join(s.roles(owner, "owner"), owner).select(
            kind.alias("kind"), (F.col("schema_name") if schema is None else schema).alias("schema_name"), F.col(name).alias("object_name"), args.alias("func_args"), "owner"
        )

    types = s.unowned(s.named(s["pg_type"].where(F.col("typtype").isin("e", "d") & ~F.startswith("typname", F.lit("_"))), "typnamespace"), "pg_type")
    routines = s.unowned(s.named(s["pg_proc"].where(F.col("prokind").isin(*ROUTINE_KINDS)), "pronamespace"), "pg_proc")
    out = of(s.unowned(s.relations("rSvm"), "pg_class"), "relowner", called(F.col("relkind"), RELATION_KINDS), "table_name")
    out = out.unionByName(of(s.named(s["pg_namespace"], "oid"), "nspowner", F.lit("schema"), "schema_name"))
    out = out.unionByName(of(types, "typowner", F.lit("type"), "typname"))
    out = out.unionByName(of(routines, "proowner", called(F.col("prokind"), ROUTINE_KINDS), "proname", F.col("identity_args")))
    return out.unionByName(of(s["pg_database"], "datdba", F.lit("database"), "datname", schema=null)) if databases else out


PRIVILEGES = ["acl_kind", "kind", "schema_name", "object_name", "func_args", "for_role", "objtype", "grantee", "privilege_type", "is_grantable"]


def privileges(s: System) -> DataFrame:
    """A row for each grant to others than the owner, from all six kinds of access lists."""
    null = F.lit(None).cast("string")

    def of(rows: DataFrame, acl: str, owner: str | None, acl_kind: str, **columns: Column) -> DataFrame:
        entries = rows.withColumn("_a", F.explode(acl))
        if owner:
            entries = entries.where(F.col("_a.grantee") != F.col(owner))
        entries = entries.withColumn("_to", F.col("_a.grantee")).join(s.roles("_to", "_role"), "_to", "left")
        found = {k: columns.get(k, null) for k in PRIVILEGES[1:7]}
        return entries.select(
            F.lit(acl_kind).alias("acl_kind"), *[v.alias(k) for k, v in found.items()],
            F.coalesce("_role", F.lit("PUBLIC")).alias("grantee"), F.col("_a.privilege_type").alias("privilege_type"), F.col("_a.is_grantable").alias("is_grantable"),
        )

    c = F.col
    types = s.unowned(s.named(s["pg_type"].where(~F.startswith("typname", F.lit("_"))), "typnamespace"), "pg_type")
    routines = s.unowned(s.named(s["pg_proc"].where(c("prokind").isin(*ROUTINE_KINDS)), "pronamespace"), "pg_proc")
    defaults = s.named(s["pg_default_acl"].join(s.roles("defaclrole", "for_role"), "defaclrole"), "defaclnamespace", "left")
    if s.schemas is not None:
        defaults = defaults.where(c("schema_name").isNull() | c("schema_name").isin(s.schemas))
    frames = [
        of(s.unowned(s.relations("rpvmS"), "pg_class"), "relacl", "relowner", "relation", kind=called(c("relkind"), RELATION_KINDS), schema_name=c("schema_name"), object_name=c("table_name")),
        of(s.named(s["pg_namespace"], "oid"), "nspacl", "nspowner", "schema", kind=F.lit("schema"), schema_name=c("schema_name"), object_name=c("schema_name")),
        of(routines, "proacl", "proowner", "function", kind=called(c("prokind"), ROUTINE_KINDS), schema_name=c("schema_name"), object_name=c("proname"), func_args=c("identity_args")),
        of(types, "typacl", "typowner", "type", kind=F.lit("type"), schema_name=c("schema_name"), object_name=c("typname")),
        of(s["pg_database"], "datacl", "datdba", "database", kind=F.lit("database"), object_name=c("datname")),
        of(defaults, "defaclacl", None, "default", kind=F.lit("default"), schema_name=c("schema_name"), for_role=c("for_role"), objtype=c("defaclobjtype")),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def settings(s: System) -> DataFrame:
    """database, name, value: an entry for each setting of a database, split at its first `=`."""
    rows = s["pg_db_role_setting"].select(F.col("setdatabase").alias("oid"), "setrole", F.explode("setconfig").alias("entry"))
    name = F.split_part("entry", F.lit("="), F.lit(1))
    return rows.where("setrole = 0").join(s["pg_database"].select("oid", F.col("datname").alias("database")), "oid").select(
        "database", name.alias("name"), F.substring("entry", F.length(name) + 2, F.length("entry")).alias("value"), "entry"
    )
