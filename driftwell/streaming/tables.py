"""Tables that a change stream fills, batch by batch.

A batch appends its changes as one immutable folder, which counts when its mark is there; a batch
that comes again after that is passed over, and one that stopped before it is written anew. Reading
works the state out of all changes, so batches and files may come in any order. A read may name a
batch and a position and then sees the changes of those batches up to that position.

`ChangeTable` keeps the last change of each key, `RowTable` how often each full row was added less
how often it was taken; `table_for` picks by the keys. `compact` brings the batches up to one into a
base, with what it can drop by then; `vacuum` removes what a base covers, after a time in which
readers of the older state end.
"""

from __future__ import annotations

import time
import uuid
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.changes import last_changes, repeated, split_key_changes, split_updates
from ..sources.marks import Marks

#: Seconds for which what a base covers stays readable.
GRACE_S = 3600.0
#: Changes that one task sums up, and the tasks over which those of one hot row are dealt.
SUM_ROWS, HOT_TASKS = 1_000_000, 8


class StreamedTable(ABC):
    """Batches, bases and an initial copy below one path. A base covers all batches up to its number."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self.marks = Marks(spark, f"{self.path}/marks")

    #: The columns of a folder: those of the table and what places a change.
    log: StructType

    @abstractmethod
    def _logged(self, changes: DataFrame) -> DataFrame:
        """The changes as rows of a folder."""

    @abstractmethod
    def _settled(self, rows: DataFrame) -> DataFrame:
        """As few rows that give the same state, whatever comes after them."""

    @abstractmethod
    def _state(self, rows: DataFrame) -> DataFrame:
        """The table's rows."""

    def _numbers(self, kind: str) -> list[int]:
        return [int(n.rsplit("-", 1)[1]) for n in self.marks.names(f"{kind}-")]

    def _name(self, kind: str, n: int) -> str:
        return f"{kind}-{n:012d}"

    def versions(self) -> list[int]:
        """The batches that are in and not removed yet."""
        return self._numbers("batch")

    def append(self, changes: DataFrame, batch: int) -> None:
        name = self._name("batch", batch)
        if self.marks.has(name) or batch <= max(self._numbers("base"), default=-1):
            return
        self._logged(changes).write.mode("overwrite").parquet(f"{self.path}/{name}")
        self.marks.put(name, {})

    def copy_in(self, rows: DataFrame, position: int) -> bool:
        """Begin with `rows`, the table as it was at a position; changes up to it count no more. False if there is a copy."""
        if self.marks.has("copy"):
            return False
        folder = f"copy-{uuid.uuid4().hex}"
        fresh = rows.select(self.schema.fieldNames()).withColumns({"lsn": F.lit(position).cast("long"), "seq": F.lit(-1).cast("long"), "op": F.lit("I")})
        self._logged(fresh).write.parquet(f"{self.path}/{folder}")
        return self.marks.put("copy", {"folder": folder, "position": position})

    def copied_at(self) -> int | None:
        """The position of the initial copy."""
        return self.marks.get("copy")["position"] if self.marks.has("copy") else None

    def changes(self, batch: int | None = None, position: int | None = None) -> DataFrame:
        """The newest base, the batches after it and the initial copy; as of a batch and a position, if named."""
        bases = [n for n in self._numbers("base") if batch is None or n <= batch]
        batches = [n for n in self.versions() if (batch is None or n <= batch) and (not bases or n > bases[-1])]
        if batch is not None and not bases and self._numbers("base") and batch not in self.versions():
            raise ValueError(f"batch {batch} was compacted away")
        folders = [f"{self.path}/{self._name('batch', n)}" for n in batches]
        if bases:
            folders.append(f"{self.path}/{self.marks.get(self._name('base', bases[-1]))['folder']}")
        rows = self.spark.read.schema(self.log).parquet(*folders) if folders else self.spark.createDataFrame([], self.log)
        if position is not None:
            rows = rows.where(F.col("lsn") <= position)
        if (copied := self.copied_at()) is not None:
            rows = rows.where(F.col("lsn") > copied).unionByName(self.spark.read.schema(self.log).parquet(f"{self.path}/{self.marks.get('copy')['folder']}"))
        return rows

    def read(self, batch: int | None = None, position: int | None = None) -> DataFrame:
        return self._state(self.changes(batch, position))

    def compact(self, batch: int | None = None, position: int | None = None) -> bool:
        """A base of all up to a batch (the newest, if not named); whether there was anything to do.

        What lies beyond `position` stays as it is, so that reads as of later positions see it in its place.
        The initial copy stays a folder of its own.
        """
        found = [n for n in self.versions() if batch is None or n <= batch]
        base = max(self._numbers("base"), default=-1)
        if not found or found[-1] <= base:
            return False
        copied = self.copied_at()
        rows = self.changes(found[-1])
        rows = rows if copied is None else rows.where(F.col("lsn") > copied)
        done = rows if position is None else rows.where(F.col("lsn") <= position)
        out = self._settled(done).select(self.log.fieldNames())
        if position is not None:
            out = out.unionByName(rows.where(F.col("lsn") > position).select(self.log.fieldNames()))
        folder = f"{self._name('base', found[-1])}-{uuid.uuid4().hex}"
        out.write.parquet(f"{self.path}/{folder}")
        return self.marks.put(self._name("base", found[-1]), {"folder": folder})

    def vacuum(self, grace: float = GRACE_S) -> int:
        """Remove the batches and bases that a base of at least this age covers; how many went."""
        now = time.time()
        covering = [n for n in self._numbers("base") if self.marks.age(self._name("base", n), now) >= grace]
        if not covering:
            return 0
        gone = [(k, n) for k, ns in (("batch", self.versions()), ("base", self._numbers("base"))) for n in ns if n < covering[-1] or k == "batch" and n == covering[-1]]
        for kind, n in gone:
            name = self._name(kind, n)
            folder = self.marks.get(name).get("folder", name)
            self.marks.remove(name)  # first the mark: nobody begins to read what is about to go
            self.marks.remove_folder(f"{self.path}/{folder}")
        return len(gone)

    def restart(self) -> None:
        """Forget all batches, but not the initial copy."""
        for kind in ("base", "batch"):
            for n in self._numbers(kind):
                folder = self.marks.get(self._name(kind, n)).get("folder", self._name(kind, n))
                self.marks.remove(self._name(kind, n))
                self.marks.remove_folder(f"{self.path}/{folder}")

    def clear(self) -> None:
        self.marks.remove_folder(self.path)


class ChangeTable(StreamedTable):
    """A table with a key: its last change decides. Deletes stay as changes, so that older ones lose to them."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str]):
        super().__init__(spark, path, schema, keys)
        self.log = StructType(schema.fields).add("lsn", "long").add("seq", "long").add("op", "string")

    def _logged(self, changes: DataFrame) -> DataFrame:
        return split_key_changes(changes, self.keys).select(self.log.fieldNames())

    def _settled(self, rows: DataFrame) -> DataFrame:
        """The last change of each key, and the last truncate."""
        cut = rows.where("op = 'T'").orderBy("lsn", "seq", ascending=False).limit(1)
        return last_changes(rows, self.keys).select(self.log.fieldNames()).unionByName(cut.select(self.log.fieldNames()))

    def _state(self, rows: DataFrame) -> DataFrame:
        return last_changes(rows, self.keys).where("op <> 'D'").select(self.schema.fieldNames())


class RowTable(StreamedTable):
    """A table without a key: full rows and their multiplicities, signed, so that a delete may come before its insert.

    An update needs the full row before it (`before`). A row that was taken more often than added isn't there.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str] | None = None):
        super().__init__(spark, path, schema, [])
        self.log = StructType(schema.fields).add("lsn", "long").add("seq", "long").add("op", "string").add("n", "long")

    def _logged(self, changes: DataFrame) -> DataFrame:
        """Nothing is counted here: places differ, so a task would keep all its rows to find hardly any that are equal."""
        n = F.when(F.col("op") == "D", -1).when(F.col("op") == "I", 1).otherwise(0).cast("long")
        return split_updates(changes, self.schema.fieldNames()).withColumn("n", n).select(self.log.fieldNames())

    def _last_cut(self, rows: DataFrame) -> tuple[int, int] | None:
        return rows.where("op = 'T'").agg(F.max(F.struct("lsn", "seq")).alias("cut")).first()["cut"]

    def _after_cut(self, rows: DataFrame) -> DataFrame:
        if (cut := self._last_cut(rows)) is None:
            return rows
        place: Column = F.struct("lsn", "seq")
        return rows.where((F.col("op") != "T") & (place > F.struct(F.lit(cut[0]).cast("long"), F.lit(cut[1]).cast("long"))))

    def _summed(self, rows: DataFrame) -> DataFrame:
        """A task sums its own rows first, SUM_ROWS about, since it keeps a sum for each full row that it meets."""
        columns, rows = self.schema.fieldNames(), self._after_cut(rows)
        if (tasks := -(-rows.count() // SUM_ROWS)) > rows.rdd.getNumPartitions():
            rows = rows.select(*columns, "lsn", "n", F.pmod("seq", F.lit(HOT_TASKS)).alias("_deal")).repartition(tasks, *columns, "_deal")
        return rows.groupBy(*columns).agg(F.sum("n").alias("n"), F.max("lsn").alias("lsn"))

    def _settled(self, rows: DataFrame) -> DataFrame:
        """Each row's multiplicity at the place of its last change, and the last truncate, which takes nothing more away."""
        kept = self._summed(rows).where("n <> 0").withColumns({"seq": F.lit(1 << 62), "op": F.lit("I")})
        cut = rows.where("op = 'T'").orderBy("lsn", "seq", ascending=False).limit(1)
        return kept.select(self.log.fieldNames()).unionByName(cut.select(self.log.fieldNames()))

    def _state(self, rows: DataFrame) -> DataFrame:
        return repeated(self._summed(rows).where("n > 0").select(*self.schema.fieldNames(), "n"), "n")


def table_for(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> StreamedTable:
    """A table by its identity: keyed where there are keys, else by full rows."""
    return (ChangeTable if keys else RowTable)(spark, path, schema, keys)

