"""Connected components of a table of links, by rounds of grouping and joining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import stored

MAX_ROUNDS = 64


def _signature(edges: DataFrame) -> tuple:
    """Tells two sets of distinct links apart: their number, and two sums of 128-bit hashes' halves."""
    md5 = F.md5(F.concat_ws(":", "u", "v"))
    half = lambda at: F.sum(F.conv(F.substring(md5, at, 12), 16, 10).cast("decimal(20,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), half(1), half(13)).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id reachable) for every id in links.

    Each round turns every id's links to larger neighbours into links to its smallest
    neighbour, and then the other way round, so that chains halve and stars stay. A round
    never makes more links than it gets; a star's centre is only ever grouped by a minimum,
    which combines before the shuffle, and joined to one row.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = stored(
        both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    state = _signature(edges)
    for _ in range(MAX_ROUNDS):
        # Every id takes its smallest neighbour (or itself) as parent; larger neighbours are linked to it.
        either = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = either.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = either.where("v > u").join(parent, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # Smaller neighbours are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        after = stored(small.where("u > v").distinct(), "links")
        before, state, edges = state, _signature(after), after
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )
