"""Toxicity: cumulative-link ordinal regression of severity grades on sparse text features.

A document's features are its distinct words and how they begin, hashed. One weight vector is shared by all
ordered thresholds: P(grade > k) = sigmoid(w.x - theta_k), theta rising. The output is the
expected severity, the sum of these probabilities.

Labels say toxic or not; grades above 0 follow from how many marker words a toxic document
has (thirds of the toxic sample), where markers are words far more frequent in toxic
documents. The fit uses a bounded sample of labelled rows (TOXIC_ROWS and CLEAN_ROWS, the
first by a hash of the id, as many of them as SAMPLE_BYTES hold); every document is scored,
in whole, in one pass without a shuffle. A document is called toxic if P(grade > 0) is at
least TOXIC_FROM; fitted on labels of even ids, that finds 0.85 or more of the toxic
documents of odd ids and calls 0.01 of the clean ones toxic at most (a test holds it to that).

Defined results: null and wordless texts have no features and get the model's bias; a text
whose words do not speak for it (a score of 0 or less) is never called toxic; labels
that contradict each other count as toxic; of rows with one labelled id the first by a hash
of the text is in the sample; without labels of both kinds all weights are 0 and nothing is
toxic; repeated rows are scored apart; columns besides id and text are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import sliced, stored

HASH_BITS = 18
#: The sample that the model is fitted on, at most.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_BYTES = 2048, 4096, 64 << 20
#: Rows that a task reads at once.
ROWS = 512
#: Features that the fit keeps, and the grades.
FEATURES, GRADES = 2048, 4
#: A word is a marker from this many standard errors of its log-odds.
MARKER_Z = 4.0
L2, STEPS, RATE = 1e-4, 400, 0.1
#: Lengths of the beginnings that count as features, and the probability from which a text is toxic.
PREFIXES, TOXIC_FROM = (4, 5, 6, 7), 0.4
#: Words in a worker's memo (about 120 bytes each, 25 MB).
MEMO_WORDS = 200_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feature(word: str) -> int:
    return crc32(word.encode("utf-8", "replace")) & ((1 << HASH_BITS) - 1)


def features(word: str) -> list[int]:
    """A word's hashed features: itself and its beginnings."""
    return [feature(word), *[feature(f"{word[:k]}*") for k in PREFIXES if len(word) > k]]


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Model:
    """Weights of hashed features, and the rising thresholds."""

    weights: np.ndarray
    thetas: np.ndarray

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return _sigmoid(np.asarray(score)[:, None] - self.thetas[None, :])


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, features (packed int32) of a sample bounded in rows and bytes, the same on every run."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.where("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(
        known.where("toxic = 0").orderBy(*order).limit(CLEAN_ROWS)
    )
    text = F.coalesce("text", F.lit(""))
    chosen = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id")
    chosen = chosen.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS, 2):
            rows = [np.sort(np.array([f for w in words(t.as_py()) for f in features(w)], np.int32)).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "toxic", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(chosen.mapInArrow(hashed, f"doc_id {kind}, toxic int, features binary"), "labelled-sample")
    so_far = F.sum(F.octet_length("features")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    places = rows.select("doc_id", so_far.alias("bytes")).where(F.col("bytes") <= SAMPLE_BYTES)  # the sample's ids, in one task
    return rows.join(F.broadcast(places.select("doc_id")), "doc_id", "left_semi").select("toxic", "features")


def grades(toxic: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """0 for clean; 1 to 3 for toxic rows by thirds of their number of markers."""
    out = np.zeros(len(toxic), np.int64)
    if toxic.any():
        cuts = np.quantile(markers[toxic], [1 / 3, 2 / 3])
        out[toxic] = 1 + (markers[toxic, None] > cuts[None, :]).sum(axis=1)
    return out


def fit(toxic: np.ndarray, rows: list[np.ndarray]) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam on the whole sample."""
    size = 1 << HASH_BITS
    empty = Model(np.zeros(size, np.float32), np.array([30.0, 31.0, 32.0]))
    toxic = toxic.astype(bool)
    if not toxic.any() or toxic.all():
        return empty
    flat = np.concatenate([np.empty(0, np.int32), *[r.astype(np.int32) for r in rows]])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    present = np.unique(owner.astype(np.int64) << HASH_BITS | flat)
    by, what = present >> HASH_BITS, present & (size - 1)
    in_toxic = np.bincount(what[toxic[by]], minlength=size)
    in_clean = np.bincount(what[~toxic[by]], minlength=size)
    n1, n0 = toxic.sum(), (~toxic).sum()
    odds = np.log((in_toxic + 0.5) / (n1 - in_toxic + 0.5)) - np.log((in_clean + 0.5) / (n0 - in_clean + 0.5))
    error = np.sqrt(1 / (in_toxic + 0.5) + 1 / (n1 - in_toxic + 0.5) + 1 / (in_clean + 0.5) + 1 / (n0 - in_clean + 0.5))
    z = np.where(in_toxic + in_clean >= 3, odds / error, 0)
    marker = z >= MARKER_Z
    grade = grades(toxic, np.bincount(by[marker[what]], minlength=len(rows)))
    chosen = np.sort(np.argsort(-np.abs(z), kind="stable")[:FEATURES])
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    used = place[flat] >= 0
    column, owner = place[flat[used]], owner[used]
    del flat, used, present, by, what

    w, theta0, steps = np.zeros(len(chosen)), np.array([2.0]), np.zeros(GRADES - 2)
    parts = [w, theta0, steps]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for t in range(1, STEPS + 1):
        theta = theta0 + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
        score = np.bincount(owner, w[column], len(rows))
        lower = np.where(grade > 0, theta[np.maximum(grade, 1) - 1] - score, -50.0)
        upper = np.where(grade < GRADES - 1, theta[np.minimum(grade, GRADES - 2)] - score, 50.0)
        a, b = _sigmoid(lower), _sigmoid(upper)
        p = np.maximum(b - a, 1e-9)
        by_score = (a + b - 1) / len(rows)
        by_theta = np.zeros(GRADES - 1)
        np.add.at(by_theta, np.minimum(grade, GRADES - 2), np.where(grade < GRADES - 1, b * (1 - b) / p, 0) / len(rows))
        np.add.at(by_theta, np.maximum(grade, 1) - 1, np.where(grade > 0, -a * (1 - a) / p, 0) / len(rows))
        up = [
            np.bincount(column, by_score[owner], len(chosen)) - L2 * w,
            np.array([by_theta.sum()]),
            np.cumsum(by_theta[::-1])[::-1][1:] * np.exp(steps),
        ]
        for k, g in enumerate(up):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            parts[k] += RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[chosen] = w
    return Model(weights, theta0 + np.concatenate([[0.0], np.cumsum(np.exp(steps))]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    sample = labelled_sample(docs, labels).collect()  # TOXIC_ROWS + CLEAN_ROWS rows and SAMPLE_BYTES at most
    sample.sort(key=lambda r: (r["toxic"], r["features"]))
    return fit(np.array([r["toxic"] for r in sample]), [np.frombuffer(r["features"], np.int32) for r in sample])


class _Weights(dict):
    """Words' weights as they come up."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        value = float(sum(self.weights[f] for f in features(word)))
        if len(self) < MEMO_WORDS:
            self[word] = value
        return value


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity, severity (the likeliest grade), toxic for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = _Weights(held.value.weights).__getitem__
        for batch in sliced(batches, ROWS, 1):
            total = np.array([sum(sorted(map(weight, words(t.as_py() or "")))) for t in batch.column(1)], np.float64)
            over = held.value.exceed(total)
            ladder = np.concatenate([np.ones((len(total), 1)), over, np.zeros((len(total), 1))], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(over.sum(axis=1)), pa.array((ladder[:, :-1] - ladder[:, 1:]).argmax(axis=1).astype(np.int32)),
                 pa.array((over[:, 0] >= TOXIC_FROM) & (total > 0))],
                ["doc_id", "expected_severity", "severity", "toxic"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, expected_severity double, severity int, toxic boolean")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
