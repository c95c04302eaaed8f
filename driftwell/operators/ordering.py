"""Places in a total order, without bringing a table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_path


def with_places(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """rows with their place from 1 in the order, which must be total for a defined result.

    The sorted table is written once with each row's number in its partition; partitions'
    sizes, summed up, are added to it.
    """
    at = F.monotonically_increasing_id()
    path = shared_path(rows.sparkSession, "places")
    rows.orderBy(*order).select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_at")).write.parquet(path)
    stored = rows.sparkSession.read.parquet(path)
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition of the sort
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stored.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").select(*rows.columns, (F.col("_before") + F.col("_at") + 1).alias(name))
