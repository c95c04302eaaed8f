"""A copy that can be resumed: what is in is written down chunk by chunk, and a rerun copies the rest.

A copy belongs to a snapshot, which the caller names: chunks of different snapshots never mix. Each
chunk is written to a folder of its own and counts when its mark is there. Readers of the target see
a snapshot when all its tables are in and it has been published, all tables at once.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.bulk_copy import shared_columns
from ..operators.key_ranges import KeyRange, file_groups, key_ranges
from ..sources.jdbc import Endpoint, read_query
from ..sources.marks import Marks

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Chunk:
    """A part of a table: its name, the same in every run, and how to read it."""

    name: str
    read: Callable[[], DataFrame]


@dataclass
class Copied:
    """rows: of all chunks that are in; read: chunks that this run copied; failed: those that it couldn't, with the reason."""

    rows: int = 0
    read: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)


def _numbered(parts: list, read: Callable) -> list[Chunk]:
    return [Chunk(f"{k:06d}", lambda part=part: read(part)) for k, part in enumerate(parts)]


def chunks_of_frame(rows: DataFrame, keys: list[str], n: int) -> list[Chunk]:
    """By ranges of a key that the source is sorted or indexed by: each chunk reads its range."""
    return _numbered(key_ranges(rows, keys, n), lambda r: rows.where(r.column()))


def chunks_of_database(spark: SparkSession, endpoint: Endpoint, table: str, ranges: list[KeyRange]) -> list[Chunk]:
    return _numbered(ranges, lambda r: read_query(spark, endpoint, f"SELECT * FROM {table} WHERE {r.sql()}"))


def chunks_of_files(spark: SparkSession, path: str, n: int) -> list[Chunk]:
    """By groups of files: nothing is read twice."""
    return _numbered(file_groups(spark, path, n), lambda files: spark.read.parquet(*files))


class CopyJournal:
    """The copies below one path: a folder for each snapshot, and which of them is the published one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.published = Marks(spark, f"{self.path}/published")

    def _marks(self, snapshot: str) -> Marks:
        return Marks(self.spark, f"{self.path}/{snapshot}/marks")

    def chunks_in(self, snapshot: str, table: str) -> list[str]:
        return [n.split("@", 1)[1] for n in self._marks(snapshot).names(f"{table}@")]

    def _copy_chunk(self, snapshot: str, table: str, chunk: Chunk, columns: list[str] | None) -> None:
        rows, seen = chunk.read(), Observation("copied")
        rows = rows if columns is None else rows.select(shared_columns(rows, columns))
        folder = f"{table}/{chunk.name}-{uuid.uuid4().hex}"
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/{snapshot}/{folder}")
        self._marks(snapshot).put(f"{table}@{chunk.name}", {"folder": folder, "rows": seen.get["n"], "schema": rows.schema.json()})

    def copy(self, snapshot: str, table: str, chunks: list[Chunk], columns: list[str] | None = None, at_once: int = 4) -> Copied:
        """Copy the chunks that aren't in, several at once; one that fails stops no other."""
        there, out = set(self.chunks_in(snapshot, table)), Copied()

        def one(chunk: Chunk) -> str:
            try:
                self._copy_chunk(snapshot, table, chunk, columns)
            except Exception as e:  # the caller learns of it by `failed`
                log.exception("%s: chunk %s of %s failed", snapshot, chunk.name, table)
                return f"{type(e).__name__}: {e}"
            return ""

        due = [c for c in chunks if c.name not in there]
        with ThreadPoolExecutor(max_workers=at_once) as pool:
            for chunk, error in zip(due, pool.map(one, due)):
                if error:
                    out.failed[chunk.name] = error
                else:
                    out.read.append(chunk.name)
        marks = self._marks(snapshot)
        out.rows = sum(marks.get(n)["rows"] for n in marks.names(f"{table}@"))
        return out

    def read(self, snapshot: str, table: str) -> DataFrame:
        """What is in of a table."""
        marks = self._marks(snapshot)
        found = [marks.get(n) for n in marks.names(f"{table}@")]
        if not found:
            raise ValueError(f"nothing of {table} is in")
        return self.spark.read.parquet(*[f"{self.path}/{snapshot}/{f['folder']}" for f in found])

    def publish(self, snapshot: str, tables: list[str]) -> None:
        """Let readers see this snapshot's tables, all at once, in place of those before."""
        names = self.published.names()
        n = int(names[-1]) + 1 if names else 0
        if not self.published.put(f"{n:012d}", {"snapshot": snapshot, "tables": tables}):
            raise RuntimeError("another snapshot was published meanwhile")

    def current(self) -> str | None:
        names = self.published.names()
        return self.published.get(names[-1])["snapshot"] if names else None

    def table(self, name: str) -> DataFrame:
        """A table of the published snapshot."""
        if (snapshot := self.current()) is None:
            raise ValueError("no snapshot is published")
        return self.read(snapshot, name)

    def forget(self, snapshot: str) -> None:
        """Remove a snapshot that isn't the published one."""
        if snapshot == self.current():
            raise ValueError(f"{snapshot} is published")
        self.published.remove_folder(f"{self.path}/{snapshot}")
