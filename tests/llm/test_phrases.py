"""Phrases against brute force and SQL, with samples that propose too much, too little and nothing."""

import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftwell.llm import phrases as P

ROOT = "/root/testdata/sf0.01"
SCHEMA = "text string, lang string, word string, h1 int, n string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def slow(rows, least=P.LEAST, top=P.TOP):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in candidates.items():
        longer = [b for (other, q), b in candidates.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked, seen = [], Counter()
    for row in sorted(out, key=lambda r: (-r[6], -r[2], r[1].encode())):
        seen[row[0]] += 1
        if seen[row[0]] <= top:
            ranked.append((row[0], seen[row[0]], *row[1:]))
    return sorted(ranked)


def corpus(seed, docs=120, vocabulary=40):
    rng = random.Random(seed)
    out = []
    for _ in range(docs):
        words = []
        for _ in range(rng.randrange(0, 120)):
            words.append(rng.choice(["New York city", "of the", "as well as", f"w{int(rng.paretovariate(0.7)) % vocabulary}", "É x", "Ab"]))
            words.append(rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]))
        out.append(("".join(words), rng.choice(["en", "de", None, "und"])))
    return out


def table(spark, rows):
    return spark.createDataFrame([(t, lang, "x", 1, "y") for t, lang in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("share", "lowered"), [(25, 2), (100, 10), (8, 1), (0, 1), (25, 6)])
def test_against_brute_force(spark, share, lowered):
    rows = corpus(share)
    found = P.mine(table(spark, rows), share=share, lowered=lowered)
    assert found.columns == COLUMNS
    assert sorted(tuple(r) for r in found.collect()) == slow(rows)


def test_the_border_says_when_the_sample_was_wrong(spark):
    rows = corpus(9)
    whole, failed = P.frequent(table(spark, rows), share=100, lowered=P.LEAST)
    nothing, failed_more = P.frequent(table(spark, rows), share=0, lowered=1)
    assert failed == [] and 1 <= len(failed_more) <= 2
    key = lambda df: sorted(map(str, df.collect()))
    assert key(whole) == key(nothing)


def test_a_task_has_one_python_worker(spark, monkeypatch):
    """Each Arrow pass reads tables or a shuffle: one on top of another has a worker of its own beside it, with its own memory."""
    frame, below = type(spark.range(0)), []

    def seen(self, *args, call=frame.mapInArrow, **more):
        below.append(self._jdf.queryExecution().executedPlan().toString())
        return call(self, *args, **more)

    monkeypatch.setattr(frame, "mapInArrow", seen)
    rows = corpus(9)
    assert sorted(tuple(r) for r in P.mine(table(spark, rows)).collect()) == slow(rows)
    assert len(below) > 5 and not [plan for plan in below if "InArrow" in plan]


def test_best_of_rounds(spark):
    rows = spark.range(5000).select(F.lit("en").alias("g"), (F.col("id") % 700).alias("score"), F.col("id").cast("string").alias("name"))
    order = [F.desc("score"), F.asc("name")]
    few = P.best_of(rows, "g", order, 30, ranked=200)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, P.best_of(rows, "g", order, 30).collect()))


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000
    rows = [(1, None, None, "en", "x", big), (2, None, None, "en", "y", big + 7), (1, 2, None, None, None, big - 5), (None, None, None, "en", None, 3 * big)]
    found = P.scored(spark.createDataFrame(rows, "h1 long, h2 long, h3 long, lang string, word string, n long")).collect()
    assert [(r.a, r.score) for r in found] == [(big - 5, 1000000 * (big - 5) ** 2 // (big * (big + 7)))]


def test_one_hash_for_two_words_is_no_wrong_count(spark):
    rows = corpus(3, docs=40)
    with pytest.raises(RuntimeError):
        P.mine(table(spark, rows), hash_bits=4)


def test_a_block_takes_little_more_than_its_texts():
    """What a task holds at its peak while it finds a block's words and phrases, beside the block and Arrow's own."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(20_000)}" for _ in range(500)) + ". end" for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 1000), pa.array(texts)], ["lang", "text"])
    block = P._Block(0, 64)
    block.texts = [batch]
    every = np.full(1 << 12, 255, np.uint8)
    tracemalloc.start()
    try:
        hashes, words, together, _ = block.flat()
        found = [len(phrases) for _, phrases in P.wanted(hashes, words, together, [every], 3, np.zeros(1 << 12, np.uint8))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(words) == 2000 * 501 and found == [0, 0] and peak < 6 * batch.nbytes, peak / batch.nbytes


def test_edges(spark):
    long = "the same words again " * 60_000
    rows = [(None, "en"), ("", "en"), (" \t\n.", "en"), ("one", None), (long, "en"), ("The same\twords", "und")] + [("The same\twords", None)] * 10
    assert sorted(tuple(r) for r in P.mine(table(spark, rows)).collect()) == slow(rows)
    assert P.mine(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{ROOT}/documents.parquet')")
    expected = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({P.OP13_SQL})").fetchall()
    found = [tuple(r) for r in P.op13_phrases(spark, ROOT).select(COLUMNS).collect()]
    assert sorted(found) == sorted(expected) and len(found) > 1000
