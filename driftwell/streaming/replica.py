"""A database filled by one stream of changes, read in commit order, into which new tables can be handed over.

Changes of all tables come in one stream (`one_stream`), with a commit record for each commit: its
position, the commit before it, and how many changes it has. Files may come in any order. A batch is
first appended to all its tables; then an epoch is put in place, with the position up to which every
commit has come whole, and all before it, too. A read as of an epoch sees that position in every
table, so never an order without its lines. Commits that are not whole yet wait as counts
(`pending`), whose number follows how far files are out of order.

A table is handed over in three states, which follow from marks alone, so a restart finds them again:
`copying` (it is tracked, its changes are kept, its copy isn't in), `catching up` (the copy was
taken at a position that the epochs have not reached) and `in step`. Changes up to the copy's
position are in the copy and count no more, those after it follow, so each counts once. A table is
tracked before its snapshot is taken; changes that came before it was tracked are in the snapshot.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.marks import Marks
from .tables import StreamedTable, table_for

COPYING, CATCHING_UP, IN_STEP = "copying", "catching up", "in step"


class NotInStep(RuntimeError):
    """The table can't be read in commit order yet."""


def one_stream(changes: dict[str, DataFrame], commits: DataFrame) -> DataFrame:
    """The changes of several tables and the commits as one frame: lsn, seq, op, table, a struct for each table and `commit`.

    changes: lsn, seq, op, the table's columns, and `before` where updates need it. commits: lsn, prev, n.
    """
    out = commits.select("lsn", F.lit(0).cast("long").alias("seq"), F.lit("C").alias("op"), F.lit(None).cast("string").alias("table"), F.struct("prev", "n").alias("commit"))
    for name, rows in changes.items():
        own = [c for c in rows.columns if c not in ("lsn", "seq", "op")]
        out = out.unionByName(rows.select("lsn", "seq", "op", F.lit(name).alias("table"), F.struct(*own).alias(name)), allowMissingColumns=True)
    return out


class Replica:
    """Tables below one path, the epochs over them, and which tables are tracked."""

    def __init__(self, spark: SparkSession, path: str, position: int = 0):
        """position: where the stream began, the `prev` of its first commit."""
        self.spark, self.path, self.start = spark, path.rstrip("/"), position
        self.epochs, self.tracked = Marks(spark, f"{self.path}/epochs"), Marks(spark, f"{self.path}/tracked")
        self._tables: dict[str, StreamedTable] = {}

    # ---- tables and their states

    def track(self, name: str, schema: StructType, keys: list[str], copied: bool = True) -> StreamedTable:
        """Keep the table's changes from now on. `copied`: it begins with a copy; else empty, in step at once."""
        self.tracked.put(name, {"schema": schema.json(), "keys": keys, "copied": copied})
        return self.table(name)

    def table(self, name: str) -> StreamedTable:
        if name not in self._tables:
            found = self.tracked.get(name)
            self._tables[name] = table_for(self.spark, f"{self.path}/tables/{name}", StructType.fromJson(json.loads(found["schema"])), found["keys"])
        return self._tables[name]

    def state(self, name: str, epoch: int | None = None) -> str:
        if not self.tracked.get(name)["copied"]:
            return IN_STEP
        copied = self.table(name).copied_at()
        if copied is None:
            return COPYING
        return IN_STEP if self.position(epoch) >= copied else CATCHING_UP

    def states(self) -> DataFrame:
        """table, state, position (of the copy), epoch_position: a row for each tracked table."""
        at = self.position()
        rows = [(t, self.state(t), self.table(t).copied_at(), at) for t in self.tracked.names()]
        return self.spark.createDataFrame(rows, "table string, state string, position long, epoch_position long")

    def hand_over(self, name: str, schema: StructType, keys: list[str], snapshot: Callable[[], tuple[DataFrame, int]]) -> str:
        """Track a table, then take its snapshot (rows, position) and copy it in, unless that is done; its state."""
        self.track(name, schema, keys)
        if self.table(name).copied_at() is None:
            rows, position = snapshot()
            self.table(name).copy_in(rows, position)
        return self.state(name)

    # ---- batches and epochs

    def latest(self) -> int | None:
        names = self.epochs.names("epoch-")
        return int(names[-1].split("-")[1]) if names else None

    def position(self, epoch: int | None = None) -> int:
        """Up to where every commit has come."""
        epoch = self.latest() if epoch is None else epoch
        return self.start if epoch is None else self.epochs.get(_epoch(epoch))["position"]

    def append(self, changes: DataFrame, batch: int) -> None:
        """Append a batch to its tables and put its epoch in place; nothing if the epoch is there."""
        if self.epochs.has(_epoch(batch)):
            return
        before = self.latest()
        rows = changes.persist()
        try:
            for name in self.tracked.names():
                if name in changes.columns:
                    self.table(name).append(rows.where(F.col("table") == name).select("lsn", "seq", "op", "`" + name.replace("`", "``") + "`.*"), batch)
            position = self._settle(rows, batch, before)
        finally:
            rows.unpersist()
        self.epochs.put(_epoch(batch), {"position": position, "before": before})

    def _pending(self, epoch: int) -> str:
        return f"{self.path}/pending/{_epoch(epoch)}"

    def _settle(self, rows: DataFrame, batch: int, before: int | None) -> int:
        """Write the commits that still wait after this batch; the new position."""
        at = self.position(before) if before is not None else self.start
        is_commit = F.col("op") == "C"
        counts = rows.groupBy("lsn").agg(
            F.sum(F.when(is_commit, 0).otherwise(1)).alias("seen"), F.max(F.when(is_commit, F.col("commit.prev"))).alias("prev"), F.max(F.when(is_commit, F.col("commit.n"))).alias("n")
        )
        if before is not None:
            counts = counts.unionByName(self.spark.read.schema(counts.schema).parquet(self._pending(before)))
        draft = f"{self._pending(batch)}-all"
        counts.where(F.col("lsn") > at).groupBy("lsn").agg(F.sum("seen").alias("seen"), F.max("prev").alias("prev"), F.max("n").alias("n")).write.mode("overwrite").parquet(draft)
        waiting = self.spark.read.parquet(draft)
        # The first commit that isn't whole, or whose predecessor hasn't come: all before it are settled.
        known = waiting.select(F.col("lsn").alias("prev")).unionByName(self.spark.range(1).select(F.lit(at).cast("long").alias("prev")))
        orphans = waiting.where("n is not null").join(known, "prev", "left_anti").select("lsn")
        bad = waiting.where("n is null or seen <> n").select("lsn").unionByName(orphans).agg(F.min("lsn")).first()[0]
        settled = waiting if bad is None else waiting.where(F.col("lsn") < bad)
        reached = settled.agg(F.max("lsn")).first()[0]
        position = at if reached is None else reached
        waiting.where(F.col("lsn") > position).select(counts.columns).write.mode("overwrite").parquet(self._pending(batch))
        self.epochs.remove_folder(draft)
        return position

    def read(self, name: str, epoch: int | None = None) -> DataFrame:
        """The table as of an epoch (the newest, if not named), in commit order."""
        epoch = self.latest() if epoch is None else epoch
        if (state := self.state(name, epoch)) != IN_STEP:
            raise NotInStep(f"{name} is {state}")
        # Before the first epoch there are no batches to see, only what a table began with.
        return self.table(name).read(-1 if epoch is None else epoch, self.position(epoch))

    def restart(self) -> None:
        """Forget all batches and epochs; tables stay tracked and keep their copies."""
        self.epochs.clear()
        self.epochs.remove_folder(f"{self.path}/pending")
        for t in self.tracked.names():
            self.table(t).restart()

    def compact(self) -> int:
        """Bring every table's batches up to the newest epoch into one base; how many tables had any."""
        epoch = self.latest()
        return 0 if epoch is None else sum(self.table(t).compact(epoch, self.position(epoch)) for t in self.tracked.names())

    def vacuum(self, grace: float) -> int:
        """Remove what bases of this age cover, and epochs' pending counts but the newest's."""
        for epoch in [int(n.split("-")[1]) for n in self.epochs.names("epoch-")][:-1]:
            self.epochs.remove_folder(self._pending(epoch))
        return sum(self.table(t).vacuum(grace) for t in self.tracked.names())


def _epoch(n: int) -> str:
    return f"epoch-{n:012d}"

