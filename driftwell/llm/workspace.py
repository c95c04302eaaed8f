"""Where intermediate tables go, and joins whose small side has a checked size."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes where rows differ in size, up to which one side of a join is broadcast; beyond, both are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20

#: Rows and bytes of an Arrow batch while tables are written here.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}

#: Bytes of text that a task works on at once.
SLICE_BYTES = 1 << 19

#: The column that holds the numbers of a written table.
NUMBER = "_driftwell_row_number"

_LOCAL: dict[str, str] = {}
#: The tables of each `scratch` block that is open.
_SCRATCH: list[list[str]] = []
#: The written table of each DataFrame object that was numbered.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, DataFrame] = weakref.WeakKeyDictionary()
#: Where tables are that were made here.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of bounded rows and bytes while a table is written: executors hold them outside the heap,
    and a default batch of whole texts takes tens of MB for each task."""
    before = {}
    for key, most in ARROW_LIMITS.items():
        now = spark.conf.get(key, None)
        if now is not None and (not now.isdigit() or not 0 < int(now) <= most):
            before[key] = now
            spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def release(spark: SparkSession) -> None:
    """Let go of what is unreachable: Spark removes the shuffle files of jobs that have ended when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are `stored` inside go when the block ends, but those with `keep`, which stay for the block
    around it, or for good. The driver then lets go of what is unreachable, and Spark of its shuffle files."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.pop()
        _remove(spark, made)
        release(spark)


def _remove(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def forget(docs: DataFrame) -> None:
    """Remove the table that docs was `stored` in, and the one in which its rows have numbers; what was only read stays."""
    tables = (docs, _WRITTEN.pop(docs, None))
    _remove(docs.sparkSession, [_PATHS.pop(t) for t in tables if t is not None and t in _PATHS])


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None, keep: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and lost executors lose nothing.

    It stays when the innermost `keep` scratch blocks end.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if around := _SCRATCH[: max(0, len(_SCRATCH) - keep)]:
        around[-1].append(path)
    with small_batches(spark):
        df.write.options(**(options or {})).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def sliced(batches: Iterable[pa.RecordBatch], rows: int, column: int | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of so many rows, and of SLICE_BYTES in a text column, so that what a task
    makes of one stays small whatever the texts' lengths; a longer text is a slice of its own. What Arrow
    holds unused goes back at the end, since Spark keeps Python workers for later tasks."""
    for batch in batches:
        ends = None
        if column is not None:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = min(at + rows, batch.num_rows)
            if ends is not None:
                before = ends[at - 1] if at else 0
                to = max(at + 1, min(to, int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> bool:
    """Whether df has at most `rows` rows; with `size`, the bytes of a row, also at most BROADCAST_BYTES in all."""
    if df.limit(rows + 1).count() > rows:
        return False
    return size is None or (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it `fits`, else unchanged (a shuffle join follows)."""
    return F.broadcast(df) if fits(df, rows, size) else df


def written(docs: DataFrame) -> DataFrame:
    """docs with a number for each row (NUMBER), written once: the same DataFrame object gives the same table.

    How files are cut into partitions depends on the cores there are when a job is planned,
    so numbers that two jobs must agree on are read from this table and never made twice.
    """
    if docs not in _WRITTEN:
        path = fresh_path(docs.sparkSession, "numbered")
        rows = docs.withColumn(NUMBER, F.monotonically_increasing_id())
        rows.write.option("compression", "zstd").parquet(path)
        _WRITTEN[docs] = docs.sparkSession.read.schema(rows.schema).parquet(path)
        _PATHS[_WRITTEN[docs]] = path
    return _WRITTEN[docs]


#: Bits of a row's number that hold its place in its file.
PLACE_BITS = 40


def located(docs: DataFrame) -> DataFrame:
    """docs, numbered by each row's file and place in it in place of a copy that is `written`.

    For a table just as it was read from Parquet files: joins or unions after it would repeat places.
    """
    if docs not in _WRITTEN:
        spark, file = docs.sparkSession, F.col("_metadata.file_path")
        files = [r[0] for r in docs.select(file).distinct().collect()]  # names only; the driver lists them to read them
        places = [(name, n << PLACE_BITS) for n, name in enumerate(sorted(files))]
        first = F.broadcast(spark.createDataFrame(places, "_file string, _first long"))
        rows = docs.withColumns({"_file": file, "_place": F.col("_metadata.row_index")}).join(first, "_file")
        _WRITTEN[docs] = rows.select(*docs.columns, (F.col("_first") + F.col("_place")).alias(NUMBER))
    return docs


def numbered(docs: DataFrame, *columns: Column | str, name: str = "_row") -> DataFrame:
    """Columns of docs behind a number of each row, so that null or repeated ids stay apart.

    Of a DataFrame that was `written` the numbers are the written ones; of any other they
    are good for one job.
    """
    rows = _WRITTEN[docs] if docs in _WRITTEN else docs.withColumn(NUMBER, F.monotonically_increasing_id())
    return rows.select(F.col(NUMBER).alias(name), *columns)


def without_rows(docs: DataFrame, dropped: DataFrame, name: str = "_row") -> DataFrame:
    """The rows of docs, which was `written` before its rows got into `dropped`, whose number is not there."""
    return _WRITTEN[docs].join(sized(dropped.select(F.col(name).alias(NUMBER))), NUMBER, "left_anti").select(*docs.columns)
