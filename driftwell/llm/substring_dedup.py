"""Substring dedup by hashing units of text: whole lines and paragraphs, and sentences inside them.

Units are normalised (lower case, white space collapsed) and hashed to 128 bits. The
earliest occurrence, by document id, row and place, is kept. Every later copy of a whole line or
paragraph is removed, whatever its length. Sentences add the passages that lie inside
lines: they are removed where they stand in a run of removable sentences of at least
`min_run_words` words, so that a short sentence that two clean documents happen to share
stays. With a single `unit`, its units are treated as the sentences are. Spans are code
points of the original text.

1. A pass hashes all units and counts the first 64 bits globally. Each task sends one row
   for each hash of a document, and the sums combine on the map side.
2. The hashes seen more than once go into a bitmap of fixed size, which only spares work:
   whatever it lets through is counted again. A second pass sends the units in the bitmap,
   with both halves of the hash; they are grouped by the whole hash, joined to their first
   occurrence, and turned into runs for each document.
3. The runs are cut out of the texts.

Defined results: null text stays null and has no units; rows with the same id are documents
of their own, in the order of their rows, so the later of two equal rows loses all its
units; ids of any type rank by their order, null last; no row goes; columns besides id and
text are kept, may have any name, and none is added to `remove_repeats`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import NUMBER, numbered, sized, sliced, stored, written

#: What ends a unit; a unit holds its end.
ENDS = {
    "line": re.compile(r"\n+"),
    "paragraph": re.compile(r"\n[ \t\r]*\n\s*"),
    # Runs of marks and blanks are tried from their fronts only, so that long ones take linear time.
    "sentence": re.compile(r"(?<![.!?])[.!?]++[ \t]++|(?<![ \t\r])[ \t\r]++\n\s*+|\n\s*+"),
}
#: The unit of `units`, the query's (lines, paragraphs and sentences), and the least run of sentences.
UNIT, ALL, MIN_RUN_WORDS = "sentence", "all", 15
#: Bits of the filter of repeated hashes: 8 MB, whatever the input.
FILTER_BITS = 1 << 26
#: The columns that `with_spans` adds.
SPANS, KEPT = "_driftwell_spans", "_driftwell_kept"
#: Rows whose units a task holds at once.
ROWS = 512


def units(text: str, unit: str = UNIT) -> Iterator[tuple[int, int, bytes, int]]:
    """(start, end, normalised bytes, words) of each unit that has words."""
    start = 0
    for end in [*[m.end() for m in ENDS[unit].finditer(text)], len(text)]:
        if end > start:
            words = text[start:end].lower().encode("utf-8", "replace").split()
            if words:
                yield start, end, b" ".join(words), len(words)
        start = end


def _pieces(text: str, start: int, end: int, unit: str) -> Iterator[tuple[int, int]]:
    for stop in [*[m.end() for m in ENDS[unit].finditer(text, start, end)], end]:
        if stop > start:
            yield start, stop
        start = stop


def placed_units(text: str, unit: str) -> Iterator[tuple[int, int, bool, int, int, bytes, int]]:
    """(number of its first small unit, how many it holds, whole, start, end, normalised bytes, words) of each unit.

    Small units are sentences, or those of a single `unit`; lines and paragraphs are whole.
    A paragraph of one line is that line, so lines and paragraphs are copies of each other.
    """
    if unit != ALL:
        for no, (start, end, norm, n) in enumerate(units(text, unit)):
            yield no, 1, False, start, end, norm, n
        return
    no = 0
    for start, end in _pieces(text, 0, len(text), "paragraph"):
        first, lines, n_words = no, [], 0
        for line_start, line_end in _pieces(text, start, end, "line"):
            line_first, norms, n_line = no, [], 0
            for a, b in _pieces(text, line_start, line_end, "sentence"):
                words = text[a:b].lower().encode("utf-8", "replace").split()
                if words:
                    norms.append(b" ".join(words))
                    yield no, 1, False, a, b, norms[-1], len(words)
                    no, n_line = no + 1, n_line + len(words)
            if norms:
                lines.append(b" ".join(norms))
                yield line_first, no - line_first, True, line_start, line_end, lines[-1], n_line
                n_words += n_line
        if len(lines) > 1:
            yield first, no - first, True, start, end, b" ".join(lines), n_words


def _split(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    low = np.array([h & 0xFFFFFFFFFFFFFFFF for h in hashes], np.uint64).view(np.int64)
    return low, np.array([h >> 64 for h in hashes], np.uint64).view(np.int64)


def repeated_hashes(rows: DataFrame, unit: str) -> DataFrame:
    """First halves of the hashes that occur twice or more."""
    from xxhash import xxh3_64_intdigest

    def first_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS, 1):
            hashes = [
                np.array([xxh3_64_intdigest(norm, seed=whole) for _, _, whole, _, _, norm, _ in placed_units(text.as_py() or "", unit)], np.uint64)
                for text in batch.column(1)
            ]
            seen, n = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n.astype(np.int64))], ["h1", "n"])

    found = rows.select("_row", "text").mapInArrow(first_halves, "h1 long, n long")
    return found.groupBy("h1").agg(F.sum("n").alias("n")).where("n > 1").select("h1")


def hash_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the hashes, of a size that is fixed beforehand, as bytes on the driver."""
    slot = F.pmod(F.col("h1"), F.lit(bits))
    pages = hashes.groupBy(F.shiftright(slot, 15).alias("page")).agg(
        F.bitmap_construct_agg(slot.bitwiseAND((1 << 15) - 1)).alias("bits")
    )
    bitmap = np.zeros((bits >> 15, 4096), np.uint8)
    for page, data in pages.toLocalIterator():
        bitmap[page] = np.frombuffer(bytes(data), np.uint8)
    return bitmap.reshape(-1)


def repeated_units(rows: DataFrame, unit: str, bitmap: np.ndarray) -> DataFrame:
    """Every occurrence of a unit that is in the bitmap: _row, no_id, id, unit_no, n_units, whole, start, end, n_words, h1, h2."""
    from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

    held, bits = rows.sparkSession.sparkContext.broadcast(bitmap), bitmap.size * 8

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = held.value
        for batch in sliced(batches, ROWS, 3):
            first, where, norms = [], [], []
            for i, text in enumerate(batch.column(3)):
                for no, n, whole, start, end, norm, words in placed_units(text.as_py() or "", unit):
                    first.append(xxh3_64_intdigest(norm, seed=whole))
                    where.append((i, no, n, whole, start, end, words))
                    norms.append(norm)
            h1 = np.array(first, np.uint64).view(np.int64)
            slot = h1 % bits
            kept = np.flatnonzero((marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
            low, high = _split([xxh3_128_intdigest(norms[i], seed=where[i][3]) for i in kept.tolist()])
            place = np.array(where, np.int64).reshape(-1, 7)[kept]
            yield pa.RecordBatch.from_arrays(
                [*[c.take(pa.array(place[:, 0])) for c in batch.columns[:3]], *[pa.array(place[:, k]) for k in range(1, 7)], pa.array(low), pa.array(high)],
                ["_row", "no_id", "id", "unit_no", "n_units", "whole", "start", "end", "n_words", "h1", "h2"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        occurrences,
        f"_row long, no_id boolean, id {kind}, unit_no long, n_units long, whole long, start long, end long, n_words long, h1 long, h2 long",
    )


def find_repeats(
    docs: DataFrame, unit: str = ALL, min_run_words: int = MIN_RUN_WORDS, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """_row, spans (array of start, end, n_units; sorted) of the rows of docs that have units to remove."""
    written(docs)
    rows = numbered(docs, F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "text")
    bitmap = hash_filter(stored(repeated_hashes(rows, unit), "repeated-hashes"), filter_bits)
    found = stored(repeated_units(rows, unit, bitmap), "repeated-units")
    place = F.struct("no_id", "id", "_row", "unit_no")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Written first, so that the join shuffles both sides and a hot hash can be split.
    first = stored(first.select("h1", "h2", "first"), "first-places")
    later = found.join(first, ["h1", "h2"]).where(place > F.col("first"))
    # Small units in runs; each whole unit for itself, with whatever else begins where it does.
    island = F.col("unit_no") - F.row_number().over(Window.partitionBy("_row", "whole").orderBy("unit_no"))
    parts = (
        later.select("_row", "whole", "unit_no", "n_units", "start", "end", "n_words", F.when(F.col("whole") == 1, F.col("unit_no")).otherwise(island).alias("island"))
        .groupBy("_row", "whole", "island")
        .agg(
            F.min("unit_no").alias("unit_no"), F.max(F.col("unit_no") + F.col("n_units")).alias("to"),
            F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("words"),
        )
        .where((F.col("whole") == 1) | (F.col("words") >= min_run_words))
    )
    # Parts that overlap or touch are one span.
    order = Window.partitionBy("_row").orderBy("unit_no")
    before = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = parts.withColumn("begins", F.when(F.col("unit_no") <= before, 0).otherwise(1))
    runs = (
        begins.withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_row", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("to") - F.min("unit_no")).alias("n_units"))
    )
    spans = runs.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "n_units"))).alias("spans"))
    return stored(spans, "repeat-spans")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with SPANS (null where nothing goes) and KEPT, the text without them.

    docs is the DataFrame object that `find_repeats` was given, so that the numbers fit.
    """
    named = spans.select(F.col("_row").alias(NUMBER), F.col("spans").alias(SPANS))
    rows = written(docs).join(sized(named, size=32 + 32 * F.size(SPANS)), NUMBER, "left")
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(SPANS, i - 1)["end"]).cast("int")
    end = lambda i: F.when(i == F.size(SPANS), F.char_length("text")).otherwise(F.get(SPANS, i)["start"]).cast("int")
    between = F.transform(F.sequence(F.lit(0), F.size(SPANS)), lambda i: F.substring("text", start(i) + 1, end(i) - start(i)))
    return rows.withColumn(KEPT, F.when(F.col(SPANS).isNull(), F.col("text")).otherwise(F.array_join(between, "")))


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeated units cut out of `text`; no row goes."""
    return with_spans(docs, find_repeats(docs, **options)).withColumn("text", F.col(KEPT)).select(*docs.columns)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = with_spans(docs, find_repeats(docs))
    spans = F.coalesce(F.col(SPANS), F.expr("array()").cast("array<struct<start:bigint,end:bigint,n_units:bigint>>"))
    return rows.select(
        "doc_id",
        F.col(SPANS).isNotNull().alias("has_repeats"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["n_units"]).alias("n_removed"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("removed_chars"),
        F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("removed_spans"),
        F.col(KEPT).alias("text"),
    )
