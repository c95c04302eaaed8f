"""Exact dedup: a log-structured merge index of text digests, in DataFrame operations only.

* Memtable and flush: each task digests its rows, sorts them by digest and writes one
  immutable run (a Parquet file with a Bloom filter on the digest); nothing is shuffled.
* Compaction: when a level holds FAN_IN runs or more, they merge into one run of the next
  level, which keeps, for each digest, the row with the smallest rank. The merge combines on
  the map side, so a digest that holds a third of all rows arrives as one row per task.
* Lookups of single digests push an equality down to the runs, whose filters and sorted
  row groups let Parquet pass over most of them.
* Hits receive byte verification: rows whose digest passes a bitmap filter of the digests
  seen twice are grouped by digest and normalised text. A digest with two texts is a
  collision, and its rows are then grouped by the text itself. The filter has sixteen bits
  for each such digest, up to MOST_BITS; a fuller one only verifies more rows.

Defined results: null text counts as empty; empty texts are equal to each other; among
equal texts the longest original (in code points), then the smallest id, then the first
row stays; null ids rank last; repeated rows are copies of each other. Columns besides id
and text are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import fresh_path, numbered, scratch, sized, stored, without_rows, written

#: Runs of a level that are merged.
FAN_IN = 4
#: The largest filter of repeated digests: 32 MB, broadcast as 8192 rows at most.
MOST_BITS = 1 << 28
_PAGE = 1 << 15
BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.max.bytes": str(1 << 20)}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256_digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _slot(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(bits))


def repeated_filter(digests: DataFrame, bits: int) -> DataFrame:
    """A bitmap of the digests' slots, as pages of 4 KB."""
    slot = _slot(F.col("digest"), bits)
    return digests.groupBy(F.shiftright(slot, 15).alias("_page")).agg(
        F.bitmap_construct_agg(slot.bitwiseAND(_PAGE - 1)).alias("_bits")
    )


def _in_page(bits: Column, slot: Column) -> Column:
    bit = slot.bitwiseAND(_PAGE - 1).cast("int")
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, bit.bitwiseAND(7)) == 1


class DigestLog:
    """An index that grows by flushes, and whose runs are merged level by level."""

    def __init__(
        self,
        spark,
        path: str | None = None,
        *,
        id_col: str = "doc_id",
        text_col: str = "text",
        digest: Callable[[Column], Column] = sha256_digest,
        filter_bits: int | None = None,
        fan_in: int = FAN_IN,
    ):
        self.spark, self.path = spark, path or fresh_path(spark, "digest-log")
        self.id_col, self.text_col, self.digest, self.filter_bits, self.fan_in = id_col, text_col, digest, filter_bits, fan_in
        #: The runs' folders by level, and how many runs were ever written.
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def _texts(self, docs: DataFrame) -> DataFrame:
        norm = normalised(F.col(self.text_col))
        return numbered(docs, F.col(self.id_col).alias("id"), F.col(self.text_col), name="row").select(
            "id", "row", F.coalesce(F.char_length(self.text_col), F.lit(0)).alias("n_chars"), norm.alias("norm")
        ).withColumn("digest", self.digest(F.col("norm")))

    def _write(self, run: DataFrame, level: int) -> DataFrame:
        """A run, sorted by digest in each of its files."""
        out = f"{self.path}/level{level}-{self.written:06d}"
        run.sortWithinPartitions("digest").write.options(**BLOOM).parquet(out)
        self.written += 1
        self.levels += [[]] * (level + 1 - len(self.levels))
        self.levels[level] = [*self.levels[level], out]
        return self.spark.read.schema(run.schema).parquet(out)

    def flush(self, docs: DataFrame) -> DataFrame:
        """Append docs as sorted runs, one for each task; returns the rows of these runs (digest, keep, n = 1)."""
        rank = F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("no_id"), "id", F.lit(self.written).alias("flush"), "row")
        return self._write(self._texts(docs).select("digest", rank.alias("keep"), F.lit(1).cast("long").alias("n")), 0)

    def _merged(self, runs: list[str]) -> DataFrame:
        return self.spark.read.parquet(*runs).groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))

    def compact(self) -> None:
        """Merge each level that is full into one run of the next."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fan_in:
                self._write(self._merged(self.levels[level]), level + 1)
                self.levels[level] = []
            level += 1

    def index(self) -> DataFrame:
        """digest, keep (the smallest rank's id, flush and row), n (rows): all runs merged into one."""
        runs = [r for level in self.levels for r in level]
        self.levels = [[] for _ in self.levels]
        return self._write(self._merged(runs), max(1, len(self.levels) - 1))

    def find(self, digests: list[bytes]) -> DataFrame:
        """digest, keep, n of some digests, by the runs' filters."""
        runs = [r for level in self.levels for r in level]
        rows = self.spark.read.parquet(*runs).where(F.col("digest").isin([bytearray(d) for d in digests]))
        return rows.groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))

    def collisions(self, docs: DataFrame, merged: DataFrame) -> DataFrame:
        """Digests of `merged` that stand for more than one text of docs."""
        again = merged.where("n > 1")
        bits = self.filter_bits or max(_PAGE, min(MOST_BITS, 1 << (16 * again.count()).bit_length()))
        pages = F.broadcast(repeated_filter(again, bits))
        slot = _slot(F.col("digest"), bits)
        hits = (
            self._texts(docs)
            .select("digest", "norm")
            .join(pages, F.shiftright(slot, 15) == F.col("_page"))
            .where(_in_page(F.col("_bits"), slot))
        )
        texts = hits.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("_n"))
        return stored(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("digest"), "collisions")


def find_copies(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: id, row, digest, keep_id, group_size, kept."""
    log = DigestLog(docs.sparkSession, **options)
    rows = log.flush(docs).select("digest", F.col("keep.id").alias("id"), F.col("keep.row").alias("row"))
    merged = log.index()
    collided = log.collisions(docs, merged)
    out = rows.join(merged, "digest").select(
        "id", "row", "digest", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
    )
    if collided.isEmpty():
        return out
    # Rows under a collided digest, grouped by the bytes themselves.
    texts = log._texts(docs).join(sized(collided), "digest", "left_semi")
    rank = F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("no_id"), "id", "row")
    best = texts.groupBy("digest", "norm").agg(F.min(rank).alias("keep"), F.count(F.lit(1)).alias("n"))
    exact = texts.join(best, ["digest", "norm"]).select(
        "id", "row", "digest", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
    )
    return out.join(sized(collided), "digest", "left_anti").select(*exact.columns).unionByName(exact)


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that are copies of a kept one."""
    written(docs)
    with scratch(docs.sparkSession):
        found = stored(find_copies(docs, **options).where(~F.col("kept")).select(F.col("row").alias("_row")), "dropped", keep=True)
    return without_rows(docs, found)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_copies(docs).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, sha256(norm) AS h,
         row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS k,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, h AS text_sha256 FROM r
"""
