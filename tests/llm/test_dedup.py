"""Exact dedup, substring dedup, sharding and the Jaccard join against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwell.llm import components, exact_dedup, jaccard_join, sharding, substring_dedup
from driftwell.llm.substring_dedup import KEPT, SPANS

SCHEMA = "doc_id long, text string, _row string, lang string, source string"
A = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
EDGE = [
    (1, "same text", "x", "en", "s"), (2, "same  text\n", "x", None, None), (3, "other", "x", "en", "s"), (3, "other", "x", "en", "s"),
    (None, "same text", None, "en", "s"), (4, None, "x", "en", "s"), (5, "", "x", "en", "s"), (6, " \t", "x", "en", "s"),
    (7, A, "x", "en", "s"), (8, A.upper(), "x", "en", "s"), (9, A + " lambda", "x", "en", "s"), (10, "one two", "x", "en", "s"), (11, "word " * 30000, "x", "en", "s"),
]


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(EDGE, SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


def copies(docs):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(docs):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id, i))
    return groups


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda norm: F.unhex(F.substring(F.sha2(norm, 256), 1, 2)), lambda norm: F.unhex(F.lit("00"))])
@pytest.mark.parametrize("bits", [1 << 24, 1 << 15])
def test_exact_dedup(edge, digest, bits):
    """Also under digests that collide: the byte verification finds the true groups."""
    got = exact_dedup.find_copies(edge, digest=digest, filter_bits=bits).collect()
    docs = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    expected = []
    for members in copies(docs).values():
        best = min(members, key=lambda m: (m[0], m[1], m[2] if m[2] is not None else 0, m[3]))
        expected += [(m[2], best[2], len(members), m[3] == best[3]) for m in members]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=key) == sorted(expected, key=key)
    kept = exact_dedup.deduplicate(edge, digest=digest, filter_bits=bits)
    assert kept.columns == edge.columns and kept.count() == len(copies(docs))


def test_exact_dedup_flushes(spark, edge):
    """Runs that were flushed apart merge level by level to the same index, and keep the smallest identifier."""
    log = exact_dedup.DigestLog(spark, fan_in=2)
    whole = exact_dedup.DigestLog(spark)
    whole.flush(edge)
    expected = {bytes(r["digest"]): (r["keep"]["id"], r["n"]) for r in whole.index().collect()}
    for part in ("doc_id <= 3", "doc_id between 4 and 5", "doc_id between 6 and 8", "doc_id > 8 or doc_id is null"):
        log.flush(edge.where(part))
        log.compact()
    assert [len(level) for level in log.levels] == [0, 0, 1]
    assert {bytes(r["digest"]): (r["keep"]["id"], r["n"]) for r in log.index().collect()} == expected
    digest = hashlib.sha256(b"").digest()
    found = log.find([digest, b"no such digest"])
    assert [(bytes(r["digest"]), r["keep"]["id"], r["n"]) for r in found.collect()] == [(digest, 6, 3)]
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [In(digest" in plan or "EqualTo(digest" in plan


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/d")
    empty = spark.read.parquet(f"{tmp_path}/d")
    assert exact_dedup.find_copies(empty).count() == 0
    assert jaccard_join.find_near(empty).count() == 0 and jaccard_join.keep_one(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_columns_come_back_as_they_were(spark, tmp_path):
    """Every operator that drops or cuts rows gives back columns with the names of helpers, with their values."""
    from driftwell.llm import decontamination, quality

    names = ["_row", "row", "id", "_spans", "_kept", "component", "digest", "words", "fold", "block", "cls", "n"]
    docs = [(i, f"text number {i % 7} with some words of its kind and a few more of them", "en", *[f"{n}-{i}" for n in names]) for i in range(20)]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names)
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{tmp_path}/d")
    table = spark.read.parquet(f"{tmp_path}/d")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 20, 2)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "text number 3"), (2, None)], "item_id long, text string")
    for out in (exact_dedup.deduplicate(table), jaccard_join.keep_one(table), decontamination.drop_contaminated(table, bench), quality.keep_good(table, labels)):
        got = [tuple(r) for r in out.collect()]
        assert out.columns == table.columns and got and set(got) <= set(docs)
    for out in (substring_dedup.remove_repeats(table), decontamination.cut_contaminated(table, bench)):
        got = {(r["doc_id"], *tuple(r)[2:]) for r in out.collect()}
        assert out.columns == table.columns and got == {(d[0], *d[2:]) for d in docs}


def brute_components(docs):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent, partners = list(range(len(docs))), [0] * len(docs)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
                partners[i] += 1
                partners[j] += 1
    ids = defaultdict(list)
    for i in range(len(docs)):
        ids[find(i)].append(docs[i][0])
    least = {root: min((x for x in members if x is not None), default=None) for root, members in ids.items()}
    return [(docs[i][0], len(sets[i]), least[find(i)], partners[i]) for i in range(len(docs))]


def near(spark, docs, path):
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(path)
    table = spark.read.parquet(path)
    got = [(r["id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.find_near(table).collect()]
    stored = [(r["doc_id"], r["text"]) for r in table.collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(brute_components(stored), key=key)


def test_jaccard_edges(spark, tmp_path, edge):
    near(spark, [(r[0], r[1]) for r in EDGE], f"{tmp_path}/e")
    kept = jaccard_join.keep_one(edge)  # rows without words all stay; of copies the smallest id's first row
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 10, 11]


def test_jaccard_random(spark, tmp_path):
    """Chains, stars and small sets of all sizes around the boundary, with many near copies."""
    import random

    rng = random.Random(7)
    docs, n = [], 0
    for family in range(18):
        size = rng.choice([2, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 15, 16, 18, 25, 60, 90, 120])
        base = [f"w{family}x{rng.randrange(400)}" for _ in range(size)]
        for _ in range(rng.randrange(2, 10)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(w))
                rng.choice([lambda: w.__setitem__(at, "new"), lambda: w.insert(at, "put"), lambda: w.append("end")])()
            docs.append((n, " ".join(w)))
            n += 1
    near(spark, docs, f"{tmp_path}/r")


@pytest.mark.parametrize(("changed", "most"), [(6, 16 * 300), (60, 0)])
def test_a_list_makes_no_rows_of_all_its_pairs(spark, monkeypatch, changed, most):
    """Of 300 sets in one list those that link go on with a few partners each; those that are far apart with none."""
    rng = np.random.default_rng(changed)
    base = rng.integers(1, 1 << 62, 100)
    tokens = [np.unique(np.concatenate([base[rng.permutation(100)[changed:]], rng.integers(1, 1 << 62, changed)])) for _ in range(300)]
    rows = []
    for cls, own in enumerate(tokens):
        bits = (np.bincount(own % (64 * jaccard_join.PARITY), minlength=64 * jaccard_join.PARITY) & 1).astype(np.uint8)
        rows.append((cls, len(own), own.tolist(), *np.packbits(bits).view(np.int64).tolist()))
    parity = ", ".join(f"p{k} long" for k in range(jaccard_join.PARITY))
    sets = spark.createDataFrame(rows, f"cls long, n long, tokens array<long>, {parity}")
    lists = sets.selectExpr("7L AS token", "cls", "n", "0L AS own", "0L AS place")
    made, verified = [], jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *more: made.append(pairs.count()) or verified(pairs, *more))
    monkeypatch.setattr(jaccard_join, "REST_LEAST", 0)
    found = jaccard_join.linked_in_lists(lists, sets).collect()
    assert sum(made) <= most and {r["component"] for r in found} == ({0} if most else set())
    assert len(found) == (300 if most else 0)


def test_jaccard_rounds(spark, tmp_path, monkeypatch):
    """A large group of near copies goes through the rounds, whatever is left for the last."""
    import random

    rng = random.Random(3)
    base = [f"b{i}" for i in range(80)]
    docs = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(80)] = f"c{rng.randrange(30)}"
        docs.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "REST_PAIRS", 0)
    monkeypatch.setattr(jaccard_join, "REST_LEAST", 40)
    for name, least in (("MORE_LEADS", 2), ("TASK_PAIRS", 16), ("BLOCK_SETS", 9), ("BLOCK_SHINGLES", 2000), ("TASK_ENTRIES", 500)):
        monkeypatch.setattr(jaccard_join, name, least)
    near(spark, docs, f"{tmp_path}/g")


def test_templates(spark, tmp_path):
    """Documents put together from common fragments share long lists and few links."""
    import random

    rng = random.Random(11)
    fragments = [" ".join(f"f{k}w{i}" for i in range(60)) for k in range(30)]
    docs = [(i, " ".join(fragments[k] for k in rng.sample(range(30), 10))) for i in range(150)]
    docs += [(200 + i, " ".join([*d[1].split()[: 560 - i], f"end{i}"])) for i, d in enumerate(docs[:20])]
    near(spark, docs, f"{tmp_path}/t")


def test_boundary_is_by_cost(spark):
    """Long lists of small sets make enumeration the cheaper way; without lists nothing is enumerated."""
    sets = spark.range(2000).selectExpr("id AS cls", "8L AS n")
    hot = spark.range(2000).selectExpr("7L AS token", "id AS cls", "8L AS n")
    cold = spark.range(2000).selectExpr("id div 2 AS token", "id AS cls", "8L AS n")
    assert jaccard_join.boundary(hot, sets) == 8 and jaccard_join.boundary(cold, sets) == 0
    large = sets.withColumn("n", jaccard_join.F.lit(40).cast("long"))
    assert jaccard_join.boundary(hot.withColumn("n", jaccard_join.F.lit(40).cast("long")), large) == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.integers(1, 60), st.integers(0, 60))
def test_least_overlap(s, t, o):
    if o <= min(s, t):
        assert (100 * o >= 75 * (s + t - o)) == (o >= jaccard_join.least_overlap(s, t))
        if 100 * o >= 75 * (s + t - o):
            assert t in jaccard_join.partner_sizes(s)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150), (7, 7), (300, 1000)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 150: 100, 200: 100, 300: 300, 1000: 300}


PASSAGE = "The quick brown fox goes over. A lazy dog looks on and wonders why. Then all of them walk home together slowly. Night falls over the hill."


def brute_repeats(docs, unit, least):
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    seen, out = {}, {}
    for i in order:
        text = docs[i][1]
        runs, last = [], None
        for no, (start, end, norm, n) in enumerate(substring_dedup.units(text or "", unit)):
            if seen.setdefault(norm, (i, no)) == (i, no):
                continue
            if last is not None and no == last + 1:
                runs[-1][1], runs[-1][2] = end, runs[-1][2] + n
            else:
                runs.append([start, end, n])
            last = no
        out[i] = [(a, b) for a, b, n in runs if n >= least]
    return out


def test_substring_dedup(spark, tmp_path, monkeypatch):
    docs = [
        (1, f"Some words in front. {PASSAGE} And an end."), (2, f"no stop here {PASSAGE} More.\nAnother line here."), (3, "A clean one. It shares nothing."),
        (4, f"{PASSAGE}\n{PASSAGE}"), (5, None), (6, ""), (7, "Another line here."), (None, PASSAGE), (8, "x. " * 400), (3, "A clean one. It shares nothing."),
    ]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/d")
    table = spark.read.parquet(f"{tmp_path}/d")
    stored = [(r["doc_id"], r["text"]) for r in table.collect()]
    full = np.full(1 << 12, 255, np.uint8)  # a filter that lets everything through changes nothing
    for unit, least, bitmap in (("sentence", 15, None), ("line", 5, None), ("paragraph", 1, full), ("sentence", 3, full)):
        if bitmap is not None:
            monkeypatch.setattr(substring_dedup, "hash_filter", lambda *_: full)
        expected = sorted(str((*stored[i], s)) for i, s in brute_repeats(stored, unit, least).items())
        rows = substring_dedup.with_spans(table, substring_dedup.find_repeats(table, unit, least, 1 << 15)).collect()
        assert sorted(str((r["doc_id"], r["text"], [(s["start"], s["end"]) for s in r[SPANS] or []])) for r in rows) == expected
        for r in rows:
            text = r["text"]
            for s in reversed(r[SPANS] or []):
                text = text[: s["start"]] + text[s["end"] :]
            assert r[KEPT] == text
    monkeypatch.undo()
    cut = {(r["doc_id"], r["text"]) for r in substring_dedup.remove_repeats(table).collect()}
    assert {docs[0], docs[2], (3, "")} <= cut and not any("lazy dog" in t for i, t in cut if i == 2)


def test_substring_dedup_of_string_ids(spark, tmp_path):
    """Ids of any type; columns with the names of helpers come back as they were; of equal rows the first stays."""
    docs = [("b", "Line of b.\nshared line", 1, "k", "s"), ("a", "shared line\nLine of a.", 2, "k", "s"), ("a", "shared line\nLine of a.", 3, "k", "s"), (None, "Line of b.", 4, "k", "s")]
    spark.createDataFrame(docs, "doc_id string, text string, _row int, _kept string, _spans string").coalesce(1).write.parquet(f"{tmp_path}/d")
    got = {tuple(r) for r in substring_dedup.remove_repeats(spark.read.parquet(f"{tmp_path}/d")).collect()}
    assert got == {("b", "Line of b.\n", 1, "k", "s"), (*docs[1][:5],), ("a", "", 3, "k", "s"), (None, "", 4, "k", "s")}


def test_long_runs_take_linear_time():
    import time

    began = time.perf_counter()
    for text in ("." * 1_000_000, " " * 1_000_000, "\t\r" * 500_000 + "x", "!? " * 300_000, "\n \n" * 300_000):
        list(substring_dedup.placed_units(text, "all"))
    assert time.perf_counter() - began < 20


def test_substring_dedup_whole_units(spark, tmp_path):
    """Later copies of whole lines and paragraphs go whatever their length; short sentences inside lines stay."""
    docs = [
        (1, "Short line.\nAnother one here."), (2, "  short LINE.\nOwn words."), (3, "Own text. Short line. And more."),
        (4, "First half\nsecond half.\n\nTail."), (5, "Head.\n\nFirst half second\nhalf.\n\nEnd of five."), (6, "Twice\nTwice\n \nTWICE\n"),
        (7, f"Front of seven. {PASSAGE}"), (8, f"Front of eight. {PASSAGE} Back of eight."), (9, "Another one here."),
    ]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/d")
    table = spark.read.parquet(f"{tmp_path}/d")
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(table).collect()}
    same = {i: t for i, t in docs if i in (1, 3, 4, 7)}
    assert cut == {**same, 2: "Own words.", 5: "Head.\n\nEnd of five.", 6: "Twice\n", 8: "Front of eight. Back of eight.", 9: ""}
    found = {r["_row"]: r["spans"] for r in substring_dedup.find_repeats(table).collect()}
    assert sorted(s["n_units"] for spans in found.values() for s in spans) == [1, 1, 2, 2, 4]


def test_numbers_outlive_the_partitions(spark, tmp_path):
    """A table that is cut into partitions otherwise in each later job (as when executors join) keeps its numbers."""
    docs = [(i, f"text {i % 20} of its kind with some more words\nown {i}", "mine") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, _row string").repartition(8).write.parquet(f"{tmp_path}/d")
    table = spark.read.parquet(f"{tmp_path}/d")

    def cut(partitions):
        spark.conf.set("spark.sql.files.openCostInBytes", "4194304" if partitions > 1 else "0")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4194304" if partitions > 1 else "134217728")
        spark.conf.set("spark.sql.files.minPartitionNum", str(partitions))

    try:
        cut(1)
        spans = substring_dedup.find_repeats(table).cache()
        near_ones = jaccard_join.find_near(table).cache()
        assert spans.count() == 20 and near_ones.count() == 40
        cut(8)
        assert table.rdd.getNumPartitions() > 1
        got = {r["doc_id"]: r[KEPT] for r in substring_dedup.with_spans(table, spans).collect()}
        assert got == {i: t if i < 20 else f"own {i}" for i, t, _ in docs}
        twentieth = near_ones.where("id >= 20").select("_row")
        left = jaccard_join.without_rows(table, twentieth).collect()
        assert {r["doc_id"] for r in left} == set(range(20)) and {r["_row"] for r in left} == {"mine"}
    finally:
        for name in ("openCostInBytes", "maxPartitionBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{name}")


def test_units_cover_the_text():
    text = "One. Two!  Three\n\nFour? five"
    parts = [text[a:b] for a, b, _, _ in substring_dedup.units(text)]
    assert "".join(parts) == text


def test_shards(spark, tmp_path):
    store = sharding.ShardStore(spark, f"{tmp_path}/s", target_bytes=1 << 20, fan_in=3, shard_rows=50)
    for k in range(4):
        store.append(spark.range(k * 100, k * 100 + 100).selectExpr("id AS doc_id", "repeat(cast(id AS string), 20) AS text").coalesce(1))
    store.append(spark.createDataFrame([], "doc_id long, text string"))
    before, files = store.version(), store.shards().count()
    old = {r["doc_id"] for r in store.read(1).collect()}
    after = store.compact()
    assert before == 5 and after > before and store.shards().count() < files
    assert sorted(r["doc_id"] for r in store.read().collect()) == list(range(400))
    assert {r["doc_id"] for r in store.read(1).collect()} == old == set(range(100))
    late = sharding.ShardStore(spark, f"{tmp_path}/s")
    with pytest.raises(sharding.CommitConflict):
        late._commit(late.shards(), before - 1)
    assert store.compact() == after
    sizes = [r["bytes"] for r in store.shards().collect()]
    assert max(sizes) <= 2 << 20
    kept = sorted(r["doc_id"] for r in store.read().collect())
    assert store.vacuum() > 0 and store.vacuum() == 0 and sorted(r["doc_id"] for r in store.read().collect()) == kept
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        store.read(1).collect()


def test_merges_go_on_until_no_tier_is_due(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "MERGE_SHARDS", 3)
    store = sharding.ShardStore(spark, f"{tmp_path}/s", target_bytes=1 << 20, fan_in=3, shard_rows=10)
    store.append(spark.range(200).selectExpr("id AS doc_id").coalesce(1))
    store.compact()
    assert store.shards().groupBy("tier").count().where("count >= 3").isEmpty() and store.read().count() == 200


def test_vacuum_leaves_what_is_being_written(spark, tmp_path):
    """A vacuum between the files of an append and its commit, and between those of a merge and its commit."""
    store = sharding.ShardStore(spark, f"{tmp_path}/s", target_bytes=1 << 20, fan_in=2, shard_rows=10)
    commit, removed = store._commit, []

    def vacuum_first(manifest, version):
        removed.append(store.vacuum())
        return commit(manifest, version)

    store._commit = vacuum_first
    for k in range(3):
        store.append(spark.range(k * 50, k * 50 + 50))
    store.compact()
    assert sorted(r.id for r in store.read().collect()) == list(range(150))
    assert store.vacuum() > 0 and store.read().count() == 150 and store._in_work() == set()

    def fail(manifest, version):
        raise OSError("the driver stopped")

    store._commit = fail
    with pytest.raises(OSError, match="stopped"):
        store.append(spark.range(5))
    assert len(store._in_work()) == 1 and store.vacuum() == 0 and store.read().count() == 150


def test_sharding_of_an_empty_table_and_long_texts(spark, tmp_path):
    store = sharding.ShardStore(spark, f"{tmp_path}/s")
    rows = spark.createDataFrame([(1, "x" * 3_000_000), (1, "x" * 3_000_000), (None, None)], "doc_id long, text string")
    store.append(rows.limit(0))
    store.append(rows)
    store.compact()
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in store.read().collect()) == [(0, 0), (1, 3_000_000), (1, 3_000_000)]
