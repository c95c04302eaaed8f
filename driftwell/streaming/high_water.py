"""Sequences kept up by a stream: each key's high-water mark, and what has to be written when it rises."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def high_water(changes: DataFrame, key: str, value: str) -> DataFrame:
    """key, high: the greatest value of each key so far, as a stateful aggregate that emits the keys of each batch.

    State is one number a key, in the checkpoint; a restart goes on from it, and values may come in any order.
    """
    return changes.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(value).cast("long").alias("high"))


def due(marks: DataFrame, targets: DataFrame, margin: int = 0) -> DataFrame:
    """key, new_value of the marks that a target's sequence is behind, or that no sequence of the target has. targets: key, last_value."""
    behind = F.col("last_value").isNull() | (F.col("high") > F.col("last_value"))
    return marks.join(targets.select("key", "last_value"), "key", "left").where(behind).select("key", (F.col("high") + margin).alias("new_value"))


def keep_up(
    changes: DataFrame, key: str, value: str, read_targets: Callable[[], DataFrame], write: Callable[[DataFrame, int], object], checkpoint: str,
    margin: int = 0, **trigger,
):  # noqa: ANN201
    """Start the stream. After each batch `write(rows, batch)` gets the keys whose target is behind, with the value to set.

    The target is read in each batch, so a batch that comes again after a crash writes nothing twice. For
    periodic work give `processingTime`; without a trigger it ends when all that is there was seen.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        write(due(batch, read_targets(), margin), batch_id)

    query = high_water(changes, key, value).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()
