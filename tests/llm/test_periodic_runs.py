"""Periodic runs against brute force: the automaton, the cut into stretches, the query on the whole small table."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from driftwell.llm import periodic_runs as P
from driftwell.llm.placed_words import WHITE_SPACE, byte_kinds, placed_words

ROOT = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, _row string, runs int, extra string"


def slow_runs(words, least=P.RUN_WORDS, times=P.TIMES):
    """Every run by its definition."""
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            own = words[start:i]
            if len(own) >= max(least, times * q) and not any(all(own[k] == own[k - p] for k in range(p, len(own))) for p in range(1, q)):
                found.append((start, len(own), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text, planted=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if planted and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


def test_the_automaton_finds_every_run():
    rng = random.Random(5)
    for turn in range(300):
        n, alphabet = rng.randrange(0, 160), rng.choice([1, 2, 3, 8])
        words = [rng.randrange(alphabet) for _ in range(n)]
        for _ in range(rng.randrange(3)):  # stretches with a period, some with a flaw
            unit = [rng.randrange(alphabet) for _ in range(rng.randrange(1, 14))]
            at, times = rng.randrange(len(words) + 1), rng.randrange(2, 9)
            words[at:at] = unit * times + unit[: rng.randrange(len(unit))]
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = 9
        assert P.runs_of(words) == slow_runs(words), (turn, words)


def test_squares_are_the_exact_common_suffixes():
    rng = random.Random(6)
    for _ in range(60):
        words = [rng.randrange(2) for _ in range(40)]
        seen = {}
        for i, q, longest in P.squares(words):
            seen.setdefault((i, q), longest)
        for (i, q), longest in seen.items():
            k = 0
            while i - q - k >= 0 and words[i - k] == words[i - q - k]:
                k += 1
            assert k == longest >= q


def test_the_cut_loses_no_run():
    rng = random.Random(7)
    texts = []
    for _ in range(400):
        words = [f"w{rng.randrange(rng.choice([3, 30, 3000]))}" for _ in range(rng.randrange(0, 200))]
        if rng.random() < 0.6:
            unit = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 30))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = unit * rng.randrange(2, 6) + unit[:1]
        if rng.random() < 0.3:
            words = words + words[: len(words) // 2] * 2  # far copies without a run
        texts.append(" ".join(words))
    placed = placed_words(pa.array(texts), WHITE_SPACE)
    cut = [set() for _ in texts]
    for low, high in P.repetitive(placed.first, placed.ids):
        text = int(np.searchsorted(placed.first, low, side="right")) - 1
        assert high <= placed.first[text + 1]
        cut[text] |= {(s + low - int(placed.first[text]), length, q) for s, length, q in P.runs_of(placed.ids[low:high].tolist())}
    assert [sorted(c) for c in cut] == [sorted(slow_runs(t.split())) for t in texts]
    assert sum(map(len, cut)) > 50


def test_words_by_their_bytes():
    texts = ["", None, "  a\tb ", "c", "d.e f", "É x y z", "a"]
    placed = placed_words(pa.array(texts).slice(1), WHITE_SPACE)
    words = [[placed.distinct[i].as_py().decode() for i in placed.ids[a:b]] for a, b in zip(placed.first, placed.first[1:])]
    assert words == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts[1:]]
    placed = placed_words(pa.array(["A b.C", "d"]), byte_kinds(b" ", b"."), lower=True)
    assert [w.as_py() for w in placed.distinct] == [b"a", b"b", b"c", b"d"] and placed.piece.tolist() == [0, 0, 1, 1]


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len((r.text or "").split()) <= 700]  # brute force is cubic; the longest texts follow by their runs
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = {r[0]: tuple(r) for r in P.op12_periodic_runs(spark, ROOT).select(columns).collect()}
    assert len(found) == len(docs) and len(short) > 100
    for r in short:
        assert found[r.doc_id] == slow_row(r.doc_id, r.text)
    assert sum(x[1] > 0 for x in found.values()) > 5


@pytest.mark.parametrize("times", [1, 2])
def test_edges(spark, times):
    line = "one two three four five six seven eight nine ten\n"
    texts = [None, "", " \t\n", "word", line * 3, line * 2, "x " * 24, "x " * 23, ("fine " * 200_000), "a b " * 40 + line * 4, "ä ö " * 12]
    rows = [(i, t, "r", 1, "e") for i, t in enumerate(texts)] * times + [(None, line * 3, "r", 1, "e")]
    found = P.periodic_runs(spark.createDataFrame(rows, SCHEMA)).drop("_row").collect()
    assert len(found) == len(rows)
    by_id = {r.id: r for r in found}
    assert [len(by_id[i].runs) for i in range(len(texts))] == [0, 0, 0, 0, 1, 0, 1, 0, 1, 2, 1]
    assert by_id[4].collapsed == line.strip() and by_id[8].collapsed == "fine" and by_id[0].collapsed == "" and by_id[0].n_words == 0
    assert tuple(by_id[8].runs[0]) == (0, 200_000, 1) and len(by_id[None].runs) == 1
    assert by_id[9].collapsed == "a b " + line.strip()


def test_empty_table(spark):
    assert P.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
