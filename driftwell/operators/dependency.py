"""The order in which objects that need each other can be made: levels of a graph with several parents, and its cycles.

Each round is two joins and is written, so lineage stays short; there are as many rounds as levels, plus a few
for what lies on cycles. Catalogs are small, but nothing here is brought to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import shared_path


def _kept(rows: DataFrame) -> DataFrame:
    path = shared_path(rows.sparkSession, "levels")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, level, cycle for each of `nodes` (node). edges: node, needs; those to unknown nodes don't count.

    The level is the longest way down to a node that needs nothing (0). A node that can't be placed has
    none: `cycle` then has all members of the cycle that it lies on, and is null if it only needs one.
    """
    nodes = nodes.select("node").distinct()
    known = nodes.withColumnRenamed("node", "needs")
    waiting = _kept(edges.select("node", "needs").distinct().join(nodes, "node", "left_semi").join(known, "needs", "left_semi").select("node", "needs"))
    left, placed, level = nodes, None, 0
    while True:
        ready = _kept(left.join(waiting.select("node").distinct(), "node", "left_anti"))
        if ready.isEmpty():
            break
        at = ready.select("node", F.lit(level).alias("level"))
        placed = at if placed is None else placed.unionByName(at)
        left = left.join(ready, "node", "left_anti")
        waiting = _kept(waiting.join(ready.withColumnRenamed("node", "needs"), "needs", "left_anti").select("node", "needs"))
        level += 1
    kind = nodes.schema["node"].dataType.simpleString()
    none = nodes.limit(0).select("node", F.lit(0).alias("level"))
    placed = (none if placed is None else placed).withColumn("cycle", F.lit(None).cast(f"array<{kind}>"))
    if waiting.isEmpty():
        return placed
    stuck = left.join(_cycles(waiting), "node", "left").select("node", F.lit(None).cast("int").alias("level"), "cycle")
    return placed.unionByName(stuck)


def _cycles(edges: DataFrame) -> DataFrame:
    """node, cycle (its members in order) of the nodes on cycles of edges."""
    # What nobody needs is on no cycle; without it, few nodes are left.
    while True:
        inner = _kept(edges.join(edges.select(F.col("needs").alias("node")).distinct(), "node", "left_semi").select("node", "needs"))
        if inner.count() == edges.count():
            break
        edges = inner
    reach, n = edges, -1
    while (now := reach.count()) != n:  # ways twice as long each time
        n = now
        longer = reach.join(reach.select(F.col("node").alias("needs"), F.col("needs").alias("_to")), "needs").select("node", F.col("_to").alias("needs"))
        reach = _kept(reach.unionByName(longer).distinct())
    both = reach.join(reach.select(F.col("needs").alias("node"), F.col("node").alias("needs")), ["node", "needs"])
    return both.groupBy("node").agg(F.array_sort(F.collect_set("needs")).alias("cycle"))


def in_order(rows: DataFrame, keys: list[str], needs: DataFrame) -> DataFrame:
    """rows with `level` and `cycle`, to be made by level. needs: the keys, and `needs_` and each key of what is needed."""
    name = lambda prefix: F.struct(*[F.col(f"{prefix}{k}").alias(k) for k in keys])
    found = levels(rows.select(name("").alias("node")), needs.select(name("").alias("node"), name("needs_").alias("needs")))
    return rows.join(found.select("node.*", "level", "cycle"), keys)
