"""Row and catalog drift: two tables compared by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING_ON_TARGET, MISSING_ON_SOURCE, DIFFERENT = "missing_on_target", "missing_on_source", "different"


def _same(keys: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def keyed_diff(source: DataFrame, target: DataFrame, keys: list[str], compare: list[str] | None = None) -> DataFrame:
    """keys, drift_type and `differs` (the names of unequal columns) of every key that drifts.

    One full outer join on the keys; nulls equal nulls. Only keys and compared columns are
    read from either side.
    """
    if compare is None:
        compare = [c for c in source.columns if c in target.columns and c not in keys]
    side = lambda df, name: df.select(*keys, *compare, F.lit(True).alias("_in")).alias(name)
    joined = side(source, "s").join(side(target, "t"), _same(keys, "s", "t"), "full_outer")
    unequal = F.filter(
        F.array(*[F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")), F.lit(c)) for c in compare]) if compare else F.array().cast("array<string>"),
        lambda c: c.isNotNull(),
    )
    kind = (
        F.when(F.col("t._in").isNull(), MISSING_ON_TARGET).when(F.col("s._in").isNull(), MISSING_ON_SOURCE)
        .when(F.size(unequal) > 0, DIFFERENT)
    )
    found = joined.select(
        *[F.when(F.col("s._in"), F.col(f"s.{k}")).otherwise(F.col(f"t.{k}")).alias(k) for k in keys],
        kind.alias("drift_type"), F.when(kind == DIFFERENT, unequal).otherwise(F.array().cast("array<string>")).alias("differs"),
    )
    return found.where("drift_type is not null")


def only_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose key (nulls equal) is not in right."""
    return left.alias("l").join(right.select(*keys).alias("r"), _same(keys, "l", "r"), "left_anti")


def both_ways(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with drift_type."""
    return only_left(source, target, keys).select(*keys, F.lit(MISSING_ON_TARGET).alias("drift_type")).unionByName(
        only_left(target, source, keys).select(*keys, F.lit(MISSING_ON_SOURCE).alias("drift_type"))
    )


def summary_text(items: DataFrame) -> DataFrame:
    """One row: `N drifts: a x, b y` in order of first appearance (`section_no`), or that there is none."""
    counts = items.groupBy("drift_type").agg(F.count(F.lit(1)).alias("n"), F.min("section_no").alias("first"))
    parts = F.array_sort(F.collect_list(F.struct("first", "drift_type", "n")))
    text = F.concat(
        F.sum("n").cast("string"), F.lit(" drifts: "),
        F.array_join(F.transform(parts, lambda p: F.concat_ws(" ", p["n"].cast("string"), p["drift_type"])), ", "),
    )
    return counts.agg(F.when(F.count(F.lit(1)) == 0, "No drift detected").otherwise(text).alias("summary"))
