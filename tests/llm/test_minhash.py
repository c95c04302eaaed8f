"""MinHash near-dedup against brute force, and the sketches against what they promise."""

import os
import random

import duckdb
import numpy as np
import pytest

from driftwell.llm import minhash as M
from driftwell.llm.jaccard_join import shingle_sets

ROOT = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, _row string, keys int, component string"


def shingles(text, n=M.SHINGLE):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def slow_components(docs, share=M.SHARE):
    """Index of each document -> smallest id reachable by links, by all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= share * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(docs):
        ids.setdefault(find(i), []).append(doc_id)
    return [min((x for x in ids[find(i)] if x is not None), default=None) for i in range(len(docs))]


def near_copies(rng, n, length=120):
    """Texts in families whose members differ in some words, about the threshold and on both sides of it."""
    out = []
    while len(out) < n:
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, length))]
        for _ in range(rng.randrange(1, 6)):
            own = list(words)
            for _ in range(rng.randrange(0, 1 + len(own) // 15)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(5000)}"
            out.append(" ".join(own[: len(own) - rng.randrange(0, 1 + len(own) // 10)]))
    return out[:n]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_families(spark, tmp_path, seed):
    rng = random.Random(seed)
    docs = [(i * 7 % 601, t, "r", 1, "c") for i, t in enumerate(near_copies(rng, 400))]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/d")
    table = spark.read.parquet(f"{tmp_path}/d")
    expected = dict(zip([d[0] for d in docs], slow_components([(d[0], d[1]) for d in docs])))
    found = M.find_near(table).collect()
    assert {r.id: r.component_id for r in found} == expected
    assert {r.id: r.n_shingles for r in found} == {d[0]: len(shingles(d[1])) for d in docs}
    kept = M.keep_one(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == set(expected.values())


def test_a_hot_family(spark, tmp_path):
    """Many near copies and exact copies of one text are one component, though their lists hold them all."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(1500):
        own = list(words)
        own[rng.randrange(200)] = f"x{rng.randrange(400)}"
        docs.append((i, " ".join(own), "r", 1, "c"))
    docs += [(2000 + i, " ".join(words), "r", 1, "c") for i in range(300)] + [(5000, "something else altogether here", "r", 1, "c")]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/d")
    found = M.find_near(spark.read.parquet(f"{tmp_path}/d")).select("id", "component_id").collect()
    assert {r.component_id for r in found if r.id < 5000} == {0} and len(found) == len(docs)


def test_edges(spark, tmp_path):
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    rows = [
        (1, a, "x", 1, "c"), (2, a.upper(), "x", 1, "c"), (3, a + " sigma", None, None, None), (3, a, "x", 1, "c"), (None, a, "x", 1, "c"), (4, None, "x", 1, "c"),
        (5, "", "x", 1, "c"), (6, " \t\n", "x", 1, "c"), (7, "one two", "x", 1, "c"), (8, "ONE two", "x", 1, "c"), (9, "one two three", "x", 1, "c"),
        (None, None, "x", 1, "c"), (10, "word " * 200_000, "x", 1, "c"), (11, "word " * 5, "x", 1, "c"), (None, "alone", "x", 1, "c"),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/d")
    found = M.find_near(spark.read.parquet(f"{tmp_path}/d"))
    assert found.columns == ["_row", "id", "n_shingles", "component_id", "component"]
    expected = sorted(zip([r[0] for r in rows], slow_components([r[:2] for r in rows])), key=str)
    got = sorted(((r.id, r.component_id) for r in found.collect()), key=str)
    # Wordless texts are their own component, whatever their id.
    assert got == sorted([(i, c if t and t.strip() else i) for (i, t, *_), c in zip(rows, slow_components([r[:2] for r in rows]))], key=str) and len(expected) == len(got)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/d")
    empty = spark.read.parquet(f"{tmp_path}/d")
    assert M.find_near(empty).count() == 0 and M.keep_one(empty).count() == 0


def test_small_keys_meet_as_often_as_they_should():
    """Of pairs of similarity s, keys of one collection are equal with s ** WIDTH, and tables miss few pairs."""
    rng = np.random.default_rng(4)
    equal, missed, s, pairs = 0, 0, 0.8, 600
    for _ in range(pairs):
        common, rest = rng.integers(0, 1 << 63, 400, dtype=np.uint64), rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        keys = M.small_keys([np.concatenate([common, rest[:50]]), np.concatenate([common, rest[50:]])])
        same = keys[0] == keys[1]
        equal += same.sum()
        missed += not (same[: M.SIDE].any() and same[M.SIDE :].any())
    assert abs(equal / (pairs * 2 * M.SIDE) - s**M.WIDTH) < 0.02 and missed == 0
    assert M.small_keys([np.arange(3, dtype=np.uint64)]).shape == (1, 2 * M.SIDE)
    assert len(shingle_sets([b"a b c"], M.SHINGLE)[0]) == 1


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{ROOT}/documents.parquet')")
    columns = ["doc_id", "n_shingles", "component_id", "kept"]
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({M.OP11_SQL})").fetchall()
    assert sorted(tuple(r) for r in M.op11_minhash(spark, ROOT).select(columns).collect()) == sorted(expected)


def test_keys_inside_one_component_form_no_more_pairs(spark):
    """Two classes that are connected share keys with each other alone; a third shares one of each collection with one of them."""
    own = [(c, k, 100 * min(c, 2) + k) for c in (1, 2, 3) for k in (0, 1, 2, 3)]  # 2 and 3 have the same keys
    own = [(c, k, 7 if (c, k) in ((1, 0), (2, 0)) else 8 if (c, k) in ((1, 2), (2, 2)) else key) for c, k, key in own]
    small = spark.createDataFrame([(c, c, k, key) for c, k, key in own], "cls long, component long, k int, key long")
    connected = spark.createDataFrame([(c, max(2, c) if c < 3 else 2, k, key) for c, k, key in own], "cls long, component long, k int, key long")
    alone = connected.where("cls <> 1")
    keys = lambda rows: {r["cls"]: sorted(p["k"] for p in r["a"] + r["b"]) for r in M.shared_keys(rows, 2).collect()}
    assert keys(small) == {1: [0, 2], 2: [0, 1, 2, 3], 3: [1, 3]}
    assert keys(alone) == {}
    assert M.tensored(M.shared_keys(small, 2), 2).count() == 1 + 4 + 1


def test_rows_are_numbered_by_their_files(spark, tmp_path):
    """No copy of the table is written, and a row has one number however the files are cut and read."""
    from driftwell.llm import workspace as W

    spark.range(5000).selectExpr("id AS doc_id", "repeat(cast(id AS string), 20) AS text").repartition(3).write.parquet(f"{tmp_path}/a b%20c")
    made = []
    for size in ("128m", "16k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        docs = W.located(spark.read.parquet(f"{tmp_path}/a b%20c"))
        made.append({(r["n"], r["doc_id"]) for r in W.numbered(docs, "doc_id", name="n").collect()})
        assert not any("/numbered-" in f for f in W.written(docs).inputFiles())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert made[0] == made[1] and len({n for n, _ in made[0]}) == 5000


def test_only_what_was_made_here_is_forgotten(spark, tmp_path):
    from driftwell.llm import workspace as W

    spark.range(10).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    made = W.stored(docs, "made")
    numbers, at = W.written(made), W._PATHS[made].removeprefix("file:")
    W.forget(docs)
    assert docs.count() == numbers.count() == made.count() == 10
    W.forget(made)
    assert not os.path.exists(at) and made not in W._WRITTEN
