"""The quality and toxicity models on small corpora, held-out rows of the tables, and the pipeline."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import quality, toxicity

ROOT = "/root/testdata/sf0.01"


def brute_symbols(text):
    """The symbols of a text: upper case and digits folded, a repeated word as one symbol."""
    out, before = [], None
    for w in (text or "").replace("\uffff", " ").split():
        if w == before:
            out.append(quality.REPEAT)
        else:
            out += [*([" "] if out else []), *("A" if c.isupper() else "0" if c.isdigit() else c for c in w)]
        before = w
    return out


def brute_kneser_ney(texts):
    """Probability of (context, symbol) by the definition, from dictionaries."""
    n, pad = quality.ORDER, chr(quality.PAD)
    grams = Counter()
    for t in texts:
        symbols = [pad] * (n - 1) + brute_symbols(t)
        grams.update(tuple(symbols[i : i + n]) for i in range(len(symbols) - n + 1))
    counts = [grams]
    for order in range(n - 1, 0, -1):
        below = Counter()
        for g, c in counts[0].items():
            below[g[1:]] += c if g[1] == pad else 1
        counts.insert(0, below)
    discounts = []
    for order in counts:
        k = Counter(order.values())
        if min(k[1], k[2], k[3]) == 0:
            discounts.append([0.5, 1.0, 1.5])
            continue
        y = k[1] / (k[1] + 2 * k[2])
        raw = [1 - 2 * y * k[2] / k[1], 2 - 3 * y * k[3] / k[2], 3 - 4 * y * k[4] / k[3]]
        discounts.append([min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)])
    followers = []
    for order in counts:
        f = defaultdict(dict)
        for g, c in order.items():
            f[g[:-1]][g[-1]] = c
        followers.append(f)

    def p(context, symbol):
        value = 1 / (len(counts[0]) + 1)
        for order in range(1, n + 1):
            seen = followers[order - 1].get(context[len(context) - order + 1 :] if order > 1 else ())
            if seen is None:
                continue
            d, total = discounts[order - 1], sum(seen.values())
            c = seen.get(symbol, 0)
            left = sum(d[min(x, 3) - 1] for x in seen.values()) / total
            value = ((c - d[min(c, 3) - 1]) / total if c else 0) + left * value
        return value

    return p


def brute_nats(text, p):
    n = quality.ORDER
    symbols = [chr(quality.PAD)] * (n - 1) + brute_symbols(text)
    logs = [math.log(p(tuple(symbols[i - n + 1 : i]), symbols[i])) for i in range(n - 1, len(symbols))]
    return (len(logs), -sum(logs) / len(logs)) if logs else (0, None)


def brute_quality(docs, folds, trusted):
    """(n_symbols, nats, kept) of each (doc_id, text, lang), by the definition."""
    models = [brute_kneser_ney([t for (i, t, _), f in zip(docs, folds) if f != k and i in trusted]) for k in (0, 1)]
    nats = [brute_nats(t, models[f]) for (_, t, _), f in zip(docs, folds)]
    known = defaultdict(list)
    for (i, _, lang), (_, x) in zip(docs, nats):
        if i in trusted and x is not None:
            step = math.ceil(x / quality.STEP) * quality.STEP
            known[None].append(step)
            if lang is not None:
                known[lang].append(step)
    at = lambda lang, q: sorted(known[lang])[math.ceil(q * len(known[lang]) - 1e-9) - 1]
    out = []
    for (_, _, lang), (n, x) in zip(docs, nats):
        if x is None or not known:
            out.append((n, x, x is not None))
            continue
        lang = lang if lang in known else None
        score = (x * n + at(lang, 0.5) * quality.PRIOR_SYMBOLS) / (n + quality.PRIOR_SYMBOLS)
        out.append((n, x, score <= at(lang, quality.QUANTILE) + quality.SLACK))
    return out


def test_quality_by_the_definition(spark, tmp_path, monkeypatch):
    """Perplexities, thresholds by language and decisions against dictionaries, block by block too."""
    monkeypatch.setattr(quality, "BLOCK_BITS", 4)
    monkeypatch.setattr(quality, "LONG", 40)
    rng = np.random.default_rng(4)
    words = ["the", "Cat", "sat", "on", "a", "mat", "and", "dog", "12", "caf\u00e9", "\u043c\u044b", "\u0434\u043e\u043c", "\U00020000"]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(1, 12)))), str(rng.choice(["en", "de"]))) for i in range(120)]
    docs += [(200 + i, "".join(rng.choice(list("the cat\u043c\u044b\u0434qx"), 30)), "en") for i in range(20)]
    docs += [(1, "the the the cat", None), (400, None, "en"), (401, " ", "fr"), (None, "zz zz", "fr"), (2, docs[2][1], docs[2][2])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(3).write.parquet(f"{tmp_path}/d")
    table = spark.read.parquet(f"{tmp_path}/d").select("*", quality._fold().alias("f"))
    rows = table.collect()
    trusted = {i for i in range(120) if i % 3}
    labels = spark.createDataFrame([(i, int(i in trusted)) for i in range(120)] + [(0, 1), (0, 0)], "doc_id long, quality int")
    expected = brute_quality([(r["doc_id"], r["text"], r["lang"]) for r in rows], [r["f"] for r in rows], trusted)
    shown = lambda i, lang, n, x, kept: str((i, lang, n, None if x is None else round(x, 5), kept))
    got = quality.classify(table, labels).collect()
    in_files = quality.classify(table, labels, where=[F.col("_metadata.file_path"), F.col("_metadata.row_index")])
    pick = ("doc_id", "lang", "n_symbols", "nats", "score", "kept")
    assert sorted(str([r[c] if c not in ("nats", "score") or r[c] is None else round(r[c], 9) for c in pick]) for r in got) == sorted(
        str([r[c] if c not in ("nats", "score") or r[c] is None else round(r[c], 9) for c in pick]) for r in in_files.collect()
    )
    assert sorted(shown(r["doc_id"], r["lang"], r["n_symbols"], r["nats"], r["kept"]) for r in got) == sorted(
        shown(r["doc_id"], r["lang"], *e) for r, e in zip(rows, expected)
    )
    assert all(r["kept"] == (r["score"] <= r["threshold"]) for r in got if r["nats"] is not None)
    assert len({r["kept"] for r in got}) == 2


def test_quality_edges(spark, tmp_path):
    docs = [(1, "the cat sat", "en", "x"), (2, None, "en", "x"), (3, "", None, "x"), (4, "  ", "en", "x"), (5, "the cat sat", None, "x"), (None, "the dog", "en", "x"), (1, "the cat sat", "en", "x"), (6, "the cat " * 30000, "de", "x")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, nats string").write.parquet(f"{tmp_path}/d")
    table = spark.read.parquet(f"{tmp_path}/d")
    labels = spark.createDataFrame([(1, 1), (5, 1), (6, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    got = quality.classify(table, labels).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"] for r in got if r["kept"]} >= {1, 5} and not any(r["kept"] for r in got if r["doc_id"] in (2, 3, 4))
    assert quality.keep_good(table, labels).columns == table.columns
    unlabelled = quality.classify(table, labels.limit(0)).collect()
    assert all(r["kept"] for r in unlabelled if r["doc_id"] not in (2, 3, 4))
    assert quality.classify(table.limit(0), labels).count() == 0


def test_open_vocabulary(spark, tmp_path):
    """A minority script keeps its letters: its clean text scores better than junk of the same letters."""
    rng = np.random.default_rng(2)
    common = [f"{chr(97 + i % 26)}{chr(97 + i // 2 % 26)}{chr(0xE0 + i % 24)}{chr(0x3B1 + i % 24)} plain words" for i in range(120)]
    clean = "\u043c\u044b \u0448\u043b\u0438 \u0434\u043e\u043c\u043e\u0439 \U00020000\U00020001"
    junk = "".join(rng.permutation(list(clean)))
    texts = common * 5 + [f"{clean} {k % 4 * 'x'}" for k in range(40)]
    spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, junk, clean, "", None])], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/d")
    table = spark.read.parquet(f"{tmp_path}/d")
    model = quality.train(table.where(f"doc_id < {len(texts)}").select(quality._fold().alias("fold"), "text"))
    nats = {r["doc_id"]: r["nats"] for r in quality.perplexities(table, model).collect()}
    n = len(texts)
    assert nats[n] > nats[n + 1] + 1 and nats[n + 2] is None and nats[n + 3] is None and len(nats) == n + 4


def test_quantiles_are_exact(spark):
    rows = spark.range(1, 1001).selectExpr("'a' AS lang", "id / 1000.0D AS nats")
    assert math.isclose(quality.quantiles(rows, ["lang"], 0.9).first()["at"], 0.9, abs_tol=2 * quality.STEP)


def test_quality_held_out(spark):
    """Trained on labels of even ids, judged on odd ones."""
    docs, labels = spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/labels.parquet")
    got = quality.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    share = {r["quality"]: r["share"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] >= 0.97 and share[0] <= 0.25


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    got = toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "label"), "doc_id")
    share = {r["label"]: (r["share"], r["severity"]) for r in got.groupBy("label").agg(F.avg(F.col("toxic").cast("int")).alias("share"), F.avg("expected_severity").alias("severity")).collect()}
    assert share[1][0] >= 0.85 and share[0][0] <= 0.01 and share[1][1] > 10 * share[0][1]


def test_toxicity_is_ordinal():
    rng = np.random.default_rng(0)
    rows, toxic = [], []
    for i in range(600):
        k = int(rng.integers(0, 5)) if i % 3 == 0 else 0
        rows.append(np.array([toxicity.feature(f"bad{j}") for j in range(k)] + [toxicity.feature(f"w{x}") for x in rng.integers(0, 300, 20)], np.int64))
        toxic.append(k > 0)
    model = toxicity.fit(np.array(toxic), rows)
    assert (np.diff(model.thetas) > 0).all()
    severity = [model.exceed([sum(model.weights[toxicity.feature(f"bad{j}")] for j in range(k))]).sum() for k in range(5)]
    assert severity == sorted(severity) and severity[0] < 0.3 and severity[4] > 1.5


def brute_loss(model, rows, grade, chosen):
    """The penalised mean negative log-likelihood of the grades, row by row."""
    thetas, total = [-math.inf, *model.thetas, math.inf], 0.0
    sigmoid = lambda x: 1 / (1 + math.exp(-x)) if x > -700 else 0.0
    for row, g in zip(rows, grade):
        score = sum(float(model.weights[f]) for f in row)
        below = lambda k: 0.0 if thetas[k] == -math.inf else 1.0 if thetas[k] == math.inf else sigmoid(thetas[k] - score)  # noqa: B023, E731
        total -= math.log(max(below(g + 1) - below(g), 1e-12))
    return total / len(rows) + 0.5 * toxicity.L2 * sum(float(model.weights[f]) ** 2 for f in chosen)


def test_toxicity_by_the_definition(spark):
    """The fit is a minimum of the loss written out row by row, and scores are the definition's."""
    rng = np.random.default_rng(3)
    texts, toxic = [], []
    for i in range(160):
        bad = [f"bad{j}" for j in range(int(rng.integers(1, 4)))] if i % 3 == 0 else []
        texts.append(" ".join([*bad, *[f"w{x}" for x in rng.integers(0, 40, 6)]]))
        toxic.append(bool(bad))
    texts[1], texts[2] = "bad0 w1 w2", "w3"  # so that the kinds can't be told apart wholly
    rows = [np.sort(np.array([f for w in toxicity.words(t) for f in toxicity.features(w)], np.int64)) for t in texts]
    model = toxicity.fit(np.array(toxic), rows)
    chosen = np.flatnonzero(model.weights)
    z_grades = toxicity.grades(np.array(toxic), _marker_counts(np.array(toxic), rows))
    loss = brute_loss(model, rows, z_grades, chosen)
    for k in range(12):
        moved = toxicity.Model(model.weights.copy(), model.thetas.copy())
        if k < 8:
            moved.weights[chosen] += rng.normal(0, 0.05, len(chosen)).astype(np.float32)
        else:
            moved.thetas = np.sort(moved.thetas + rng.normal(0, 0.1, len(moved.thetas)))
        assert brute_loss(moved, rows, z_grades, chosen) > loss - 1e-4
    docs = spark.createDataFrame(list(enumerate(texts[:30])), "doc_id long, text string")
    for r in toxicity.score(docs, model).collect():
        score = sum(float(model.weights[f]) for w in set(texts[r["doc_id"]].split()) for f in toxicity.features(w))
        over = [1 / (1 + math.exp(-(score - t))) for t in model.thetas]
        ladder = [1, *over, 0]
        assert math.isclose(r["expected_severity"], sum(over), abs_tol=1e-5)
        assert r["severity"] == int(np.argmax([a - b for a, b in zip(ladder, ladder[1:])]))
        assert r["toxic"] == (over[0] >= toxicity.TOXIC_FROM and score > 0)


def _marker_counts(toxic, rows):
    """How many different marker features each row has, by the definition of a marker."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    seen = defaultdict(lambda: [0, 0])
    for t, row in zip(toxic, rows):
        for f in set(row.tolist()):
            seen[f][int(t)] += 1
    marker = set()
    for f, (c, t) in seen.items():
        if c + t >= 3:
            odds = math.log((t + 0.5) / (n1 - t + 0.5)) - math.log((c + 0.5) / (n0 - c + 0.5))
            error = math.sqrt(1 / (t + 0.5) + 1 / (n1 - t + 0.5) + 1 / (c + 0.5) + 1 / (n0 - c + 0.5))
            if odds / error >= toxicity.MARKER_Z:
                marker.add(f)
    return np.array([len(set(row.tolist()) & marker) for row in rows])


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """Repeated rows of a labelled id are one row of the sample, and bytes are bounded."""
    docs = spark.createDataFrame([(1, "bad one")] * 50 + [(2, "fine two")] * 50 + [(3, "good three words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(docs, labels).count() == 3
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 4)
    assert toxicity.labelled_sample(docs, labels).count() == 0


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "you idiot", "x"), (2, None, "x"), (None, "", "x"), (1, "you idiot", "x"), (3, "fine " * 50000, "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (9, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 5 and not any(r["toxic"] for r in got if r["doc_id"] in (2, None, 3))
    nothing = toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()
    assert not any(r["toxic"] for r in nothing)
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).count() == 0


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("p"))
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{root}/{t}.parquet")
    return root


def test_pipeline_stages(spark, small):
    """Each stage against brute force on its own input."""
    import corpus_pipeline
    from tests.llm.test_dedup import brute_components, copies
    from tests.llm.test_scans import brute_hits

    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    columns = docs.columns
    for name in ("quality", "exact_dedup", "jaccard_join", "decontamination"):
        before = rows(docs)
        out = corpus_pipeline.stored(stages[name](spark, docs, small), "t")
        kept = {i for i, _ in rows(out)}
        assert out.columns == columns
        if name == "quality":
            assert len(kept) > 0.5 * len(before)
        elif name == "exact_dedup":
            assert kept == {min(m)[2] for m in copies(before).values()}
        elif name == "jaccard_join":
            assert kept == {c for _, _, c, _ in brute_components(before)}
        else:
            assert kept == {i for i, t in before if brute_hits(t, bench)[1] == 0}
        docs = out
    assert corpus_pipeline.run(spark, small).count() == docs.count()
