"""Sequences: high-water marks on both sides, brought forward and never back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effective(values: DataFrame) -> DataFrame:
    """values with last_value from start_value where it is null; `called` says whether it was used."""
    return values.select(
        "key", F.coalesce("last_value", "start_value").alias("value"), F.col("last_value").isNotNull().alias("called"),
        (F.col("last_value").isNull() & ~F.coalesce("readable", F.lit(True))).alias("unreadable"),
    )


def compare(source: DataFrame, target: DataFrame) -> DataFrame:
    """key, source_value, target_value and what stands on either side, one row a sequence."""
    s, t = effective(source), effective(target)
    return s.alias("s").join(t.alias("t"), "key", "full_outer").select(
        "key", F.col("s.value").alias("source_value"), F.col("t.value").alias("target_value"),
        F.col("s.called").alias("source_called"), F.col("s.unreadable").alias("source_unreadable"), F.col("t.unreadable").alias("target_unreadable"),
    )


def _status(source_ahead: str):  # noqa: ANN202
    src, tgt = F.col("source_value"), F.col("target_value")
    denied = F.coalesce("source_unreadable", F.lit(False)) | F.coalesce("target_unreadable", F.lit(False))
    return F.when(denied, "permission_denied").when(src > tgt, source_ahead).when(src < tgt, "target_ahead").otherwise("ok")


def reconcile(source: DataFrame, target: DataFrame, margin: int = 0) -> DataFrame:
    """key, source_value, target_value, status, new_value (null where nothing is written)."""
    rows = compare(source, target).where("source_value is not null and target_value is not null")
    return rows.select(
        "key", "source_value", "target_value", _status("updated").alias("status"),
        F.when(_status("updated") == "updated", F.col("source_value") + margin).alias("new_value"),
    )


def read_only_status(source: DataFrame, target: DataFrame) -> DataFrame:
    """key, source_value, target_value, status without writing; sequences that only the target has are left out."""
    rows = compare(source, target).where("source_value is not null")
    status = F.when(F.col("target_value").isNull(), "missing_on_target").otherwise(_status("behind"))
    return rows.select("key", "source_value", "target_value", status.alias("status"))


def orphans(source: DataFrame, target: DataFrame, used: DataFrame) -> DataFrame:
    """Sequences that only the target has, set from the largest used value (used: key, max_id).

    One without a known owner column is reported and not written; one that is far enough is ok.
    """
    alone = effective(target).join(source.select("key"), "key", "left_anti").join(used.withColumn("_owned", F.lit(True)), "key", "left")
    new = F.greatest(F.coalesce("max_id", F.lit(0)) + 1, F.col("value"))
    status = F.when(F.col("_owned").isNull(), "orphaned_unknown").when(new > F.col("value"), "orphaned_fixed").otherwise("ok")
    return alone.select("key", F.when(status == "orphaned_unknown", F.col("value")).otherwise(new).alias("target_value"), status.alias("status"))
