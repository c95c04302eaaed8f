"""Moving whole databases: a fixed snapshot, the copy, its checks, then the stream.

The position is recorded before the copy, the copy reads that snapshot, and the stream
starts after that position. A database that fails stops no other. With a journal a move that
failed is run again and copies only the chunks that aren't in; readers of the target see
nothing of it before all tables are in and checked, and then all of them at once.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.bulk_copy import copy_tables, count_mismatches
from ..operators.integrity import foreign_key_violations
from .journal import Chunk, CopyJournal

log = logging.getLogger(__name__)


class AlreadyStreaming(RuntimeError):
    """The database has a stream; copying over it would lose its changes."""


class CopyFailed(RuntimeError):
    """A table was not copied, or not whole."""


@dataclass
class Database:
    """What a move needs of one database: its snapshot's tables, where they go, and its stream."""

    name: str
    tables: dict[str, DataFrame]
    target_root: str
    target_columns: dict[str, list[str]] = field(default_factory=dict)
    foreign_keys: list[tuple[str, list[str], str, list[str]]] = field(default_factory=list)
    position: int = 0
    is_streaming: bool = False
    start_stream: Callable[[int], None] | None = None
    cleanup: Callable[[], None] | None = None
    #: For a move that can be resumed: the snapshot's name, the same in every run, its journal, and chunks of the tables (one if there are none).
    snapshot: str = ""
    journal: CopyJournal | None = None
    chunks: dict[str, list[Chunk]] = field(default_factory=dict)


@dataclass
class Outcome:
    name: str
    copied: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    error: str = ""


def move(spark: SparkSession, db: Database, at_once: int = 4) -> Outcome:
    """Copy, verify, check references, start the stream after the snapshot's position."""
    if db.is_streaming:
        raise AlreadyStreaming(db.name)
    if db.journal is not None:
        out, target = _copy_by_journal(db, db.journal, at_once)
    else:
        paths = {t: f"{db.target_root}/{t}.parquet" for t in db.tables}
        plan = {t: (df, paths[t], db.target_columns.get(t, df.columns)) for t, df in db.tables.items()}
        out = Outcome(db.name, copy_tables(spark, plan, at_once))
        target = {t: spark.read.parquet(p) for t, p in paths.items() if out.copied[t] >= 0}
    failed = frozenset(t for t, n in out.copied.items() if n < 0)
    differ = [r["key"] for r in count_mismatches(db.tables, target, failed).collect()] if target else []  # at most a row a table
    if failed or differ:
        raise CopyFailed(f"{db.name}: failed {sorted(failed)}, differ {sorted(differ)}")
    for child, child_keys, parent, parent_keys in db.foreign_keys:
        bad = foreign_key_violations(target[child], target[parent], child_keys, parent_keys)
        if not bad.isEmpty():
            out.warnings.append(f"{child}({', '.join(child_keys)}) has rows without {parent}")
    if db.journal is not None:
        db.journal.publish(db.snapshot, sorted(db.tables))
    if db.start_stream is not None:
        db.start_stream(db.position)
    return out


def _copy_by_journal(db: Database, journal: CopyJournal, at_once: int) -> tuple[Outcome, dict[str, DataFrame]]:
    if not db.snapshot:
        raise ValueError("a journal needs the snapshot's name")
    out = Outcome(db.name)
    for t, df in db.tables.items():
        chunks = db.chunks.get(t) or [Chunk("all", lambda df=df: df)]
        done = journal.copy(db.snapshot, t, chunks, db.target_columns.get(t), at_once)
        out.copied[t] = -1 if done.failed else done.rows
    return out, {t: journal.read(db.snapshot, t) for t, n in out.copied.items() if n >= 0}


def bootstrap(spark: SparkSession, databases: list[Database], at_once: int = 4) -> list[Outcome]:
    """Move each database; raises at the end if any failed."""
    outcomes = []
    for db in databases:
        try:
            outcomes.append(move(spark, db, at_once))
        except Exception as e:
            log.exception("database %s failed", db.name)
            if not isinstance(e, AlreadyStreaming) and db.cleanup is not None:
                db.cleanup()
            outcomes.append(Outcome(db.name, error=f"{type(e).__name__}: {e}"))
    bad = [o.name for o in outcomes if o.error]
    if bad:
        raise RuntimeError(f"failed: {', '.join(bad)}", outcomes)
    return outcomes
