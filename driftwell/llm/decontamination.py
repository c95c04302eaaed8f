"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The benchmark's n-grams are kept under their hashes. One pass over the documents looks up
each word among the anchors, the longest word of each n-gram, which is seldom in other
texts; where one stands, the windows that could hold it there (ten at most of each length)
are cut out and looked up in the hash set, and compared in full (the verification). Words
inside any verified window are hits. Only DataFrame operations are used.

Anchors and the set are broadcast after a check of their bytes. A larger set is joined by a
shuffle: every window's two hashes and place, without its words; what is found is verified
against the words, which are shuffled once. The result is the same.

Defined results: null or wordless texts have no words and no hits; wordless items have no
window; items with fewer than `n` words are one window; repeated rows are scanned apart;
null item ids are never listed. Columns besides id and text may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import scan, slice_text, word_array
from .workspace import NUMBER, fits, numbered, scratch, sized, stored, without_rows, written

NGRAM = 10
SPANS = "_driftwell_spans"


def test_ngrams(benchmark: DataFrame, n: int = NGRAM, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The distinct windows: h1, h2 (hashes), length, phrase, anchor, offset (of the anchor in the window), items."""
    items = benchmark.select(F.col(id_col).alias("item"), word_array(F.col(text_col)).alias("w")).where("size(w) > 0")
    windows = items.select(
        "item", F.least(F.size("w"), F.lit(n)).alias("length"), "w",
        F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))).alias("start"),
    ).select("item", "length", F.slice("w", F.col("start") + 1, F.col("length")).alias("w"))
    longest = F.array_max(
        F.transform("w", lambda x, i: F.struct(F.char_length(x).alias("n"), (-i).alias("i"), x.alias("word")))
    )
    windows = windows.select("item", "length", F.array_join("w", " ").alias("phrase"), longest.alias("a"))
    return windows.groupBy(
        "length", "phrase", F.col("a.word").alias("anchor"), (-F.col("a.i")).alias("offset")
    ).agg(F.collect_set("item").alias("items")).select(*_hashes(F.col("phrase")), "*")


def _hashes(phrase: Column) -> list[Column]:
    return [F.xxhash64(phrase).alias("h1"), F.xxhash64(F.lit("again"), phrase).alias("h2")]


def _found_by_anchor(docs: DataFrame, grams: DataFrame, anchors: DataFrame) -> DataFrame:
    """_row, id, n_words, span, items: verified windows, and one row without a span for each row of docs."""
    at = scan(docs, anchors).withColumn("spot", F.explode_outer("spots"))
    start, length = F.col("at") - F.col("spot.offset"), F.col("spot.length")
    inside = (start >= 0) & (start + length <= F.col("n_words"))
    cut = at.where(F.col("at").isNull() | inside).select(
        "_row", "id", "n_words", "at", start.alias("start"), length.alias("length"),
        F.when(F.col("at").isNotNull(), slice_text(F.col("words"), start, length)).alias("cut"),
    )
    table = grams.select("h1", F.col("length").alias("_length"), "phrase", "items")
    met = cut.join(
        F.broadcast(table), (F.xxhash64("cut") == F.col("h1")) & (F.col("length") == F.col("_length")) & (F.col("cut") == F.col("phrase")), "left"
    ).where(F.col("at").isNull() | F.col("items").isNotNull())
    span = F.when(F.col("at").isNotNull(), F.struct("start", (F.col("start") + F.col("length")).alias("end")))
    return met.select("_row", "id", "n_words", span.alias("span"), "items")


def _found_by_shuffle(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """The same, for a benchmark of any size."""
    written(docs)
    rows = numbered(docs, F.col("doc_id").alias("id"), F.col("text").alias("_text"))
    rows = rows.select("_row", "id", word_array(F.col("_text")).alias("words"))
    lengths = sorted(r["length"] for r in grams.select("length").distinct().collect())  # NGRAM at most
    out = rows.select("_row", "id", F.size("words").cast("long").alias("n_words"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("span"), F.lit(None).cast(grams.schema["items"].dataType).alias("items"))
    windows = None
    for n in lengths:
        one = rows.where(F.size("words") >= n).select("_row", F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("start"), "words")
        one = one.select("_row", F.col("start").cast("long"), F.lit(n).alias("length"), *_hashes(slice_text(F.col("words"), F.col("start"), F.lit(n))))
        windows = one if windows is None else windows.unionByName(one)
    if windows is None:
        return out
    met = windows.join(grams, ["h1", "h2", "length"]).select("_row", "start", "length", "phrase", "items")
    true = met.join(rows, "_row").where(slice_text(F.col("words"), F.col("start"), F.col("length")) == F.col("phrase"))
    span = F.struct("start", (F.col("start") + F.col("length")).alias("end"))
    return out.unionByName(true.select("_row", "id", F.size("words").cast("long").alias("n_words"), span.alias("span"), "items"))


def _covered(spans: Column) -> Column:
    """How many places sorted spans (start, end) cover together."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end"))
    add = lambda a, s: F.struct(
        (a["total"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["end"], s["start"]))).alias("total"),
        F.greatest(a["end"], s["end"]).alias("end"),
    )
    return F.aggregate(spans, zero, add, lambda a: a["total"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """One row for each row of docs: _row, id, n_words, n_hit, items (ids), spans (of words)."""
    grams = stored(test_ngrams(benchmark, n), "test-ngrams")
    if fits(grams, size=F.octet_length("phrase") + 40 * F.size("items") + 64):
        spots = F.collect_set(F.struct("offset", "length")).alias("spots")
        hits = _found_by_anchor(docs, grams, grams.groupBy("anchor").agg(spots))
    else:
        hits = _found_by_shuffle(docs, grams)
    rows = hits.groupBy("_row", "id").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    return rows.select("_row", "id", "n_words", _covered(F.col("spans")).alias("n_hit"), "items", "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, share: float = 0.0) -> DataFrame:
    """docs without the rows of whose words more than `share` are hit."""
    written(docs)
    with scratch(docs.sparkSession):
        bad = find_contamination(docs, benchmark, n).where((F.col("n_hit") > 0) & (F.col("n_hit") > share * F.col("n_words")))
        bad = stored(bad.select("_row"), "contaminated", keep=True)
    return without_rows(docs, bad)


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """docs with the hit words, and the separators in front of them, cut out of `text`."""
    written(docs)
    bad = stored(
        find_contamination(docs, benchmark, n).where("n_hit > 0").select(F.col("_row").alias(NUMBER), F.col("spans").alias(SPANS)), "hits"
    )
    rows = written(docs).join(sized(bad, size=16 * F.size(SPANS) + 64), NUMBER, "left")
    marks = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
    gaps, words = F.split("text", marks), F.regexp_extract_all("text", F.lit(f"({marks})"))
    inside = lambda i: F.exists(SPANS, lambda s: (s["start"] <= i) & (i < s["end"]))
    pairs = F.filter(
        F.transform(words, lambda w, i: F.struct(i.alias("i"), F.concat(F.get(gaps, i), w).alias("t"))),
        lambda p: ~inside(p["i"]),
    )
    cut = F.concat(F.array_join(F.transform(pairs, lambda p: p["t"]), ""), F.element_at(gaps, -1))
    return rows.withColumn("text", F.when(F.col(SPANS).isNull(), F.col("text")).otherwise(cut)).select(*docs.columns)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return find_contamination(docs, benchmark).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _az(column: str) -> str:
    return f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_az('text')}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array({_az('text')}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (n, phrase)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
