"""Bulk copy: shared columns, key ranges, the copy itself, and its verification."""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .key_ranges import key_ranges, with_range

log = logging.getLogger(__name__)


def shared_columns(source: DataFrame, target_columns: list[str], generated: frozenset[str] = frozenset()) -> list[str]:
    """Columns on both sides in the target's order, without generated ones."""
    return [c for c in target_columns if c in source.columns and c not in generated]


def chunk_plan(rows: DataFrame, key: str, chunks: int) -> DataFrame:
    """chunk_no, low, high: equal ranges of the key; the last has no end. One range if there are fewer keys than chunks."""
    bounds = rows.agg(F.min(key).alias("first"), F.max(key).alias("last"))
    span = F.col("last") - F.col("first") + 1
    size = F.ceil(span / chunks)
    n = F.when((F.lit(chunks) > 1) & (span >= chunks), F.ceil(span / size)).otherwise(1).cast("int")
    return bounds.where("first is not null").select(
        "first", size.alias("size"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"), n.alias("n")
    ).select(
        "chunk_no", (F.col("first") + F.col("chunk_no") * F.col("size")).cast("long").alias("low"),
        F.when(F.col("chunk_no") < F.col("n") - 1, (F.col("first") + (F.col("chunk_no") + 1) * F.col("size")).cast("long")).alias("high"),
    )


def page_plan(tables: DataFrame, workers: int, block_bytes: int = 8192) -> DataFrame:
    """key, chunk_no, low, high (pages; the last has no end) of tables: key, pages (as last counted), bytes.

    A table has at least the pages that its bytes fill, whatever was counted last. It is cut
    into `workers` equal chunks if there are several workers and a page for each of them.
    """
    pages = F.greatest(F.coalesce("pages", F.lit(0)), F.floor(F.col("bytes") / block_bytes))
    n = F.when((F.lit(workers) > 1) & (pages >= workers), F.lit(workers)).otherwise(1)
    size = F.ceil(pages / n)
    rows = tables.select("key", size.alias("size"), n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return rows.select(
        "key", "chunk_no", (F.col("chunk_no") * F.col("size")).cast("long").alias("low"),
        F.when(F.col("chunk_no") < F.col("n") - 1, (F.col("chunk_no") + 1) * F.col("size")).cast("long").alias("high"),
    )


def with_chunk(rows: DataFrame, key: str, chunks: int) -> DataFrame:
    """rows with the chunk_no that the plan gives them: arithmetic on two numbers, no join."""
    first, last = rows.agg(F.min(key), F.max(key)).first()
    if first is None:
        return rows.withColumn("chunk_no", F.lit(0))
    span = last - first + 1
    n = chunks if chunks > 1 and span >= chunks else 1
    size = -(-span // n)
    return rows.withColumn("chunk_no", F.floor((F.col(key) - first) / size).cast("int"))


def copy_table(source: DataFrame, path: str, target_columns: list[str], generated: frozenset[str] = frozenset()) -> int:
    """Write the shared columns over what is at path, and return how many rows went."""
    from pyspark.sql import Observation

    seen = Observation("copied")
    source.select(shared_columns(source, target_columns, generated)).observe(seen, F.count(F.lit(1)).alias("n")).write.mode(
        "overwrite"
    ).parquet(path)
    return seen.get["n"]


def _copy_numbered(rows: DataFrame, path: str, chunks: int) -> DataFrame:
    """A folder for each chunk_no; neighbouring numbers are dealt apart, so a chunk is one task's work, made again alone if it is lost."""
    rows.repartitionByRange(chunks, "chunk_no").write.mode("overwrite").partitionBy("chunk_no").parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy("chunk_no").agg(F.count(F.lit(1)).alias("n"))


def copy_in_chunks(source: DataFrame, path: str, key: str, chunks: int) -> DataFrame:
    """Write source in chunks of equal ranges of a numeric key; chunk_no and n of what was written."""
    return _copy_numbered(with_chunk(source, key, chunks), path, chunks)


def copy_in_ranges(source: DataFrame, path: str, keys: list[str], chunks: int) -> DataFrame:
    """Write source in chunks of about equal rows, by quantiles of any key; chunk_no and n of what was written."""
    ranges = key_ranges(source, keys, chunks)
    return _copy_numbered(with_range(source, ranges), path, len(ranges))


def copy_tables(spark: SparkSession, tables: dict[str, tuple[DataFrame, str, list[str]]], at_once: int = 4) -> dict[str, int]:
    """Copy several tables, `at_once` jobs at a time; a table that fails counts -1 and stops no other."""

    def one(item: tuple[DataFrame, str, list[str]]) -> int:
        try:
            return copy_table(*item)
        except Exception:  # the caller reports the table
            log.exception("copy to %s failed", item[1])
            return -1

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return dict(zip(tables, pool.map(one, tables.values())))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """key, n for each table, in one job."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(key).alias("key"), "n") for key, df in tables.items()]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return out


def count_mismatches(source: dict[str, DataFrame], target: dict[str, DataFrame], failed: frozenset[str] = frozenset()) -> DataFrame:
    """key, source_count, target_count where they differ; failed tables are left out."""
    keys = [k for k in source if k in target and k not in failed]
    s, t = row_counts({k: source[k] for k in keys}), row_counts({k: target[k] for k in keys})
    return s.withColumnRenamed("n", "source_count").join(t.withColumnRenamed("n", "target_count"), "key").where("source_count <> target_count")
