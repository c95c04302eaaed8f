"""Catalog frames: discovery, trees, ordered labels, grants and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Namespaces of the systems themselves, never moved.
SYSTEM_SCHEMAS = [
    "pg_catalog", "information_schema", "pg_toast", "pg_anonymizer", "anon",
    "_timescaledb_catalog", "_timescaledb_config", "_timescaledb_internal", "_timescaledb_cache",
    "timescaledb_information", "timescaledb_experimental", "toolkit_experimental",
]
#: Later versions of the same extension have these, too.
SYSTEM_SCHEMAS += ["_timescaledb_functions", "_timescaledb_debug"]


def discover(names: DataFrame, explicit: list[str] | None = None, exclude: list[str] = (), system: list[str] = SYSTEM_SCHEMAS) -> DataFrame:
    """Names to work on: an explicit list wins; else all but temporary, system and excluded ones."""
    if explicit:
        return names.where(F.col("name").isin(explicit)).orderBy("name")
    left_out = [*system, *exclude]
    return names.where(~F.col("name").like(r"pg\_temp\_%") & ~F.col("name").like(r"pg\_toast\_temp\_%") & ~F.col("name").isin(left_out)).orderBy("name")


def discover_databases(databases: DataFrame, explicit: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    """Databases to work on (datname, datistemplate): an explicit list wins; else all but templates and excluded ones, by name."""
    if explicit:
        return databases.where(F.col("datname").isin(explicit)).select("datname").orderBy("datname")
    return databases.where(~F.col("datistemplate") & ~F.col("datname").isin(list(exclude))).select("datname").orderBy("datname")


def uncovered(names: DataFrame, explicit: list[str], **options) -> DataFrame:
    """Names that discovery would give and the explicit list leaves out."""
    return discover(names, **options).where(~F.col("name").isin(explicit))


def tree_depths(edges: DataFrame, max_depth: int = 32) -> DataFrame:
    """child, depth (0 for roots) of a forest of (child, parent) edges; a root's parent is null.

    One recursive query; each level is one join. A tree deeper than max_depth, or with a cycle, fails.
    """
    return edges.sparkSession.sql(
        f"""WITH RECURSIVE tree(child, depth) MAX RECURSION LEVEL {max_depth + 1} AS (
          SELECT child, 0 FROM {{edges}} WHERE parent IS NULL
          UNION ALL SELECT e.child, t.depth + 1 FROM tree t JOIN {{edges}} e ON e.parent = t.child)
        SELECT child, depth FROM tree""",
        edges=edges,
    )


def by_depth(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """tables (schema_name, table_name, oid) with part_depth, parents before their partitions.

    edges: oid and parent of partitions; tables that are in no tree have depth 0.
    """
    roots = edges.select(F.col("parent").alias("child")).distinct().join(edges.select(F.col("oid").alias("child")), "child", "left_anti")
    tree = edges.select(F.col("oid").alias("child"), "parent").unionByName(roots.withColumn("parent", F.lit(None).cast(edges.schema["parent"].dataType)))
    depths = tree_depths(tree).select(F.col("child").alias("oid"), F.col("depth").alias("part_depth"))
    out = tables.join(depths, "oid", "left").withColumn("part_depth", F.coalesce("part_depth", F.lit(0)))
    return out.orderBy("part_depth", "schema_name", "table_name")


def leaves(edges: DataFrame) -> DataFrame:
    """Nodes without children."""
    parents = edges.where("parent is not null").select(F.col("parent").alias("child")).distinct()
    return edges.select("child").join(parents, "child", "left_anti")


def ordered_labels(rows: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """keys, labels: each key's labels in order (labels are distinct and few: an enum's, a row type's)."""
    return rows.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_set(F.struct(F.col(order).alias("o"), F.col(label).alias("l")))), lambda x: x["l"]).alias("labels")
    )


def missing_labels(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label: an item for each label that only the source has."""
    gone = F.array_except("labels", F.coalesce("_have", F.array().cast("array<string>")))
    return source.join(target.withColumnRenamed("labels", "_have"), keys, "left").select(*keys, F.explode(gone).alias("label"))


def explode_acl(objects: DataFrame, acl: str, owner: str | None = None) -> DataFrame:
    """A row for each entry (grantee, privilege_type, is_grantable) of an object's list; null grantees are PUBLIC, owners' own go."""
    rows = objects.withColumn("_a", F.explode(acl)).select(
        *[c for c in objects.columns if c != acl],
        F.coalesce(F.col("_a.grantee"), F.lit("PUBLIC")).alias("grantee"),
        F.col("_a.privilege_type").alias("privilege_type"), F.col("_a.is_grantable").alias("is_grantable"),
    )
    return rows.where(F.col("grantee") != F.col(owner)) if owner else rows


def without_members(objects: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Objects that belong to no extension."""
    return objects.join(members.select(key), key, "left_anti")


def key_report(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """table_name, n_rows, n_keys, full_identity: whether rows must be matched in full for want of a key."""
    out = None
    for name, (df, keys) in tables.items():
        groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        one = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys")).select(
            F.lit(name).alias("table_name"), "n_rows", "n_keys", (F.col("n_rows") > F.col("n_keys")).alias("full_identity")
        )
        out = one if out is None else out.unionByName(one)
    return out


def group_counts(source: DataFrame, target: DataFrame, by: str) -> DataFrame:
    """by, source, target: rows of each group on both sides, 0 where there is none."""
    s = source.groupBy(by).agg(F.count(F.lit(1)).alias("source"))
    t = target.groupBy(by).agg(F.count(F.lit(1)).alias("target"))
    return s.join(t, by, "full_outer").select(by, F.coalesce("source", F.lit(0)).alias("source"), F.coalesce("target", F.lit(0)).alias("target"))


def session_tables(spark: SparkSession, schema: str) -> DataFrame:
    """column rows of a Spark namespace, in the shape that drift compares."""
    rows = [
        (schema, t.name, c.name, i, c.dataType, not c.nullable)
        for t in spark.catalog.listTables(schema)
        for i, c in enumerate(spark.catalog.listColumns(t.name, schema))
    ]
    return spark.createDataFrame(rows, "schema_name string, table_name string, column_name string, ordinal int, data_type string, not_null boolean")
