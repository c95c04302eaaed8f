"""Change apply: the last change of each key over a base, for keyed and for keyless tables.

A change is (lsn, seq, op, key columns, other columns); op is I, U, D or T (truncate). An
update that changes the key has the key before it in a struct column `before`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_key_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """changes without `before`: an update that moves a row to another key also deletes the one before, at the same position."""
    if "before" not in changes.columns:
        return changes
    moved = reduce(lambda a, b: a | b, (~F.col(k).eqNullSafe(F.col(f"before.{k}")) for k in keys)) & F.col("before").isNotNull() & (F.col("op") == "U")
    gone = changes.where(moved)
    for k in keys:
        gone = gone.withColumn(k, F.col(f"before.{k}"))
    return changes.drop("before").unionByName(gone.withColumn("op", F.lit("D")).drop("before"))


def split_updates(changes: DataFrame, columns: list[str]) -> DataFrame:
    """changes without updates: the row before (`before`, a struct of all columns) is deleted, the row after inserted, in this order."""
    if "before" not in changes.columns:
        return changes
    update = F.col("op") == "U"
    gone = changes.where(update).withColumns({c: F.col(f"before.{c}") for c in columns}).withColumn("op", F.lit("D"))
    return changes.withColumn("op", F.when(update, F.lit("I")).otherwise(F.col("op"))).unionByName(gone).drop("before")


def last_changes(changes: DataFrame, keys: list[str], after: int | None = None) -> DataFrame:
    """The last change of each key, after a position and after the last truncate.

    max_by combines before the shuffle, so a hot key costs one row a task.
    """
    rows = changes if after is None else changes.where(F.col("lsn") > after)
    cut = rows.where("op = 'T'").agg(F.max(F.struct("lsn", "seq")).alias("cut"))
    cut = cut.first()["cut"]
    rows = rows.where("op <> 'T'")
    if cut is not None:
        rows = rows.where(F.struct("lsn", "seq") > F.struct(F.lit(cut["lsn"]).cast(changes.schema["lsn"].dataType), F.lit(cut["seq"]).cast(changes.schema["seq"].dataType)))
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("lsn", "seq")).alias("_last"))
    return last.select(*keys, "_last.*")


def apply_keyed(base: DataFrame, changes: DataFrame, keys: list[str], after: int | None = None) -> DataFrame:
    """base with the changes applied: rows whose key changed go, the last inserts and updates come."""
    changes = split_key_changes(changes, keys)
    last = last_changes(changes, keys, after)
    truncated = not (changes if after is None else changes.where(F.col("lsn") > after)).where("op = 'T'").isEmpty()
    news = last.where("op <> 'D'").select(*base.columns)
    if truncated:
        return news
    on = reduce(lambda a, b: a & b, (F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys))
    return base.alias("b").join(last.select(*keys).alias("c"), on, "left_anti").unionByName(news)


def apply_multiset(base: DataFrame, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """A keyless table: each delete takes one occurrence of its full row, if there is one.

    Occurrences are counted, not numbered: a hot row is one row a task until the end.
    """
    columns = base.columns
    signed = base.withColumn("_n", F.lit(1)).unionByName(inserts.select(columns).withColumn("_n", F.lit(1))).unionByName(
        deletes.select(columns).withColumn("_n", F.lit(-1))
    )
    left = signed.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n > 0")
    return repeated(left, "_n")


def repeated(rows: DataFrame, n: str, block: int = 4096) -> DataFrame:
    """Each row as often as its column `n` says, which goes.

    A row that occurs more often than `block` times is first cut into blocks, which are dealt
    over the tasks, so that none has to make all copies of a hot row.
    """
    columns = [c for c in rows.columns if c != n]
    blocks = rows.where(F.col(n) > block).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / block))).alias("_b"))
    blocks = blocks.withColumn(n, F.least(F.col(n) - F.col("_b") * block, F.lit(block).cast("long"))).repartition("_b", *columns).drop("_b")
    both = rows.where(F.col(n) <= block).unionByName(blocks)
    return both.select(*columns, F.explode(F.array_repeat(F.lit(1), F.col(n).cast("int"))).alias("_k")).drop("_k")
