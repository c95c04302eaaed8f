"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model predicts symbols (all characters, with upper case and digits folded, and one
symbol for a word that repeats the word before it) from the three symbols before. The
vocabulary is open: every character of trusted text is a symbol of its own, and the model
grows with the text.

1. Texts fall into two folds by a hash of the text, so that equal texts share one. Trusted
   text is counted once, by fold; each fold's documents are scored by the model of the other
   fold, so no document, trusted or not, is scored by a model that has seen it.
2. Counts are sharded by n-gram; each order is joined with its contexts' totals and with the
   order below. The model stays in tables in the shared folder.
3. Documents are packed in blocks of bounded size. A block's distinct n-grams are joined
   with the tables, and the probabilities are grouped with the block again, so no table
   reaches the driver or a task as a whole.
4. A document's score is its perplexity, drawn towards its language's median while it has
   few symbols. It is rejected if its score is above the threshold: a quantile of the
   perplexities of trusted documents of its language, and a margin.

Trusted documents are those whose labels all say quality 1.

Defined results: a text without words (null, empty, white space) has no perplexity and is
rejected; a language without trusted documents, null too, takes the threshold over all
languages; without any trusted document nothing is rejected but wordless texts; documents
of a fold whose other fold has no trusted text have perplexity 1; repeated rows are scored
apart; columns besides doc_id, text and lang may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import NUMBER, scratch, sized, sliced, stored, without_rows, written

ORDER, REPEAT = 4, "\x01"
#: What stands in front of a text; the code point is no character, so no text holds it after `symbols_of`.
PAD = 0xFFFF
#: The quantile of trusted perplexities, and how far above it (in nats a symbol) a document may be.
QUANTILE, SLACK = 0.995, 0.1
#: Scores are drawn to the median by so many symbols, since few symbols say little.
PRIOR_SYMBOLS = 24
#: Bits of a character in a context.
WIDE = 21
#: Blocks that a task holds rows of.
OPEN_BLOCKS = 3
#: Characters of a block (two folds together), the power of two of its rows at most, and of a text that is a block of its own.
BLOCK_CHARS, BLOCK_BITS, LONG = 16_000_000, 12, 1_000_000
#: Rows whose n-grams a task makes at once.
ROWS = 128
#: Log-perplexities are counted in steps of this size, so that quantiles are exact and alike at any size.
STEP = 0.001


@lru_cache(maxsize=1)
def folds() -> np.ndarray:
    """For each character the one it counts as."""
    table = np.arange(0x110000, dtype=np.int32)
    for c in range(0x110000):
        x = chr(c)
        if x.isupper():
            table[c] = ord("A")
        elif x.isdigit():
            table[c] = ord("0")
    return table


def symbols_of(text: str) -> str:
    words = text.replace(chr(PAD), " ").split()
    before = None
    for i, w in enumerate(words):
        if w == before:
            words[i] = REPEAT
        before = w
    return " ".join(words).replace(f" {REPEAT}", REPEAT)


def distinct_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of texts as contexts and symbols, which of them ends at each symbol, and the texts' lengths."""
    parts = [symbols_of(t) for t in texts]
    pads = chr(PAD) * (ORDER - 1)
    chars = folds()[np.frombuffer(pads.join(["", *parts]).encode("utf-32-le", "replace"), np.uint32)]
    lengths = np.array([len(p) for p in parts], np.int64)
    ends = np.flatnonzero(chars != PAD)
    present = np.zeros(0x110000, bool)
    present[chars] = True
    alphabet = np.flatnonzero(present)
    if len(alphabet) > 1 << 16:
        chars = chars.astype(np.int64)
        context = sum(chars[ends - k] << (WIDE * (k - 1)) for k in range(1, ORDER))
        grams, inverse = np.unique(np.stack([context, chars[ends]], axis=1), axis=0, return_inverse=True)
        return grams[:, 0], grams[:, 1], inverse.reshape(-1), lengths
    number = np.empty(0x110000, np.uint16)
    number[alphabet] = np.arange(len(alphabet))
    ids = number[chars]
    codes = np.zeros(len(ends), np.uint64)
    for k in range(ORDER):
        codes |= ids[ends - k].astype(np.uint64) << np.uint64(16 * k)
    codes, inverse = np.unique(codes, return_inverse=True)
    letters = [alphabet[((codes >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)] for k in range(ORDER)]
    context = sum((letters[k] << (WIDE * (k - 1)) for k in range(1, ORDER)), np.zeros(len(codes), np.int64))
    return context, letters[0], inverse, lengths


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2)).cast("int")


def _suffix(order: int) -> Column:
    """The context of an n-gram of this order, from a longer one."""
    return F.col("context").bitwiseAND(F.lit((1 << (WIDE * (order - 1))) - 1).cast("long"))


def _by_fold(values: dict[int, float], other: float) -> Column:
    return F.when(F.col("fold") == 0, F.lit(values.get(0, other))).otherwise(F.lit(values.get(1, other)))


def _discounts(grams: DataFrame) -> list[Column]:
    """The three discounts of an order, by fold."""
    n = {k: [0.0] * 5 for k in (0, 1)}
    for fold, c, k in grams.where("c <= 4").groupBy("fold", "c").count().collect():  # eight rows at most
        n[fold][c] = float(k)
    found: list[dict[int, float]] = [{}, {}, {}]
    for fold, (_, *m) in n.items():
        if min(m[:3]) == 0:
            values = [0.5, 1.0, 1.5]
        else:
            y = m[0] / (m[0] + 2 * m[1])
            values = [min(max(k + 1 - (k + 2) * y * m[k + 1] / m[k], 0.05), k + 0.95) for k in range(3)]
        for k, value in enumerate(values):
            found[k][fold] = value
    return [_by_fold(f, 1.0) for f in found]


@dataclass
class Model:
    """Two models in tables: `fold` is the fold that a model scores, and that it has not seen."""

    #: Probability of a symbol that nothing is known of.
    base: Column
    #: By order: fold, context, symbol, p.
    seen: list[DataFrame]
    #: By order: fold, context, left (the weight that a context leaves to the order below).
    left: list[DataFrame]


def train(texts: DataFrame) -> Model:
    """The models of `texts`: fold (of the text), text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS, 1):
            fold, texts = np.array(batch.column(0).to_pylist(), np.int32), [t or "" for t in batch.column(1).to_pylist()]
            for k in np.unique(fold).tolist():
                context, symbol, inverse, _ = distinct_grams([texts[i] for i in np.flatnonzero(fold == k)])
                n = np.bincount(inverse, minlength=len(context)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(context), 1 - k, np.int32)), pa.array(context), pa.array(symbol), pa.array(n)], ["fold", "context", "symbol", "c"]
                )

    counted = texts.select("fold", "text").mapInArrow(count, "fold int, context long, symbol long, c long")
    orders = [stored(counted.groupBy("fold", "context", "symbol").agg(F.sum("c").alias("c")), "grams")]
    for order in range(ORDER - 1, 0, -1):
        # Below the top, a count is of the distinct symbols in front; n-grams at a text's start keep their own.
        starts = F.lit(False) if order == 1 else F.shiftright("context", WIDE * (order - 2)).bitwiseAND((1 << WIDE) - 1) == PAD
        below = orders[0].groupBy("fold", _suffix(order).alias("context"), "symbol").agg(
            F.when(F.max(starts), F.sum("c")).otherwise(F.count(F.lit(1))).alias("c")
        )
        orders.insert(0, stored(below, f"grams-{order}"))
    # All symbols, and one for those that were never seen.
    base = _by_fold({r["fold"]: 1.0 / (r["count"] + 1) for r in orders[0].groupBy("fold").count().collect()}, 1.0)  # two rows at most
    seen, left = [], []
    for order, counts in enumerate(orders, 1):
        d1, d2, d3 = _discounts(counts)
        totals = counts.groupBy("fold", "context").agg(
            F.sum("c").alias("total"),
            *[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2)],
            F.count(F.when(F.col("c") > 2, 1)).alias("n3"),
        ).select("fold", "context", "total", ((F.col("n1") * d1 + F.col("n2") * d2 + F.col("n3") * d3) / F.col("total")).alias("left"))
        totals = stored(totals, f"contexts-{order}")
        own = (F.col("c") - F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)) / F.col("total")
        joined = counts.join(totals, ["fold", "context"]).withColumn("own", own)
        if order == 1:
            lower = joined.withColumn("lower", base)
        else:
            below = seen[-1].select("fold", F.col("context").alias("suffix"), "symbol", F.col("p").alias("lower"))
            lower = joined.withColumn("suffix", _suffix(order - 1)).join(below, ["fold", "suffix", "symbol"])
        p = lower.select("fold", "context", "symbol", (F.col("own") + F.col("left") * F.col("lower")).alias("p"))
        seen.append(stored(p, f"probabilities-{order}"))
        left.append(totals.select("fold", "context", "left"))
    return Model(base, seen, left)


def log_probabilities(grams: DataFrame, model: Model) -> DataFrame:
    """fold, context, symbol, log_p of distinct n-grams (fold, context, symbol)."""
    rows = grams.select("fold", "context", "symbol", model.base.alias("p"))
    for order in range(1, ORDER + 1):
        own = model.seen[order - 1].select("fold", F.col("context").alias("suffix"), "symbol", F.col("p").alias("own"))
        rest = model.left[order - 1].withColumnRenamed("context", "suffix")
        rows = rows.withColumn("suffix", _suffix(order)).join(own, ["fold", "suffix", "symbol"], "left").join(rest, ["fold", "suffix"], "left")
        rows = rows.select("fold", "context", "symbol", F.coalesce("own", F.coalesce("left", F.lit(1.0)) * F.col("p")).alias("p"))
    return rows.select("fold", "context", "symbol", F.log("p").alias("log_p"))


def _block(docs: DataFrame, where: list[Column | str]) -> Column:
    """Which block a row is in: so many rows that stand together as make BLOCK_CHARS characters of average texts.

    A text of LONG characters or more is a block of its own. where: columns that say where a
    row stands, the same each time it is read; the last one counts rows.
    """
    *table, at = (F.col(c) if isinstance(c, str) else c for c in where)
    average = docs.agg(F.avg(F.char_length("text"))).first()[0] or 1
    bits = min(max(int(np.log2(BLOCK_CHARS / max(average, 1))), 0), BLOCK_BITS)
    length = F.coalesce(F.char_length("text"), F.lit(0))
    return F.xxhash64(*table, length >= LONG, F.when(length >= LONG, at).otherwise(F.shiftright(at, bits)), _fold())


def _packed(rows: DataFrame) -> DataFrame:
    """block, rows: rows (block first) of one block, packed; a block may come in parts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _by_block(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in parts:
                    out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    return rows.mapInArrow(pack, "block long, rows binary")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Blocks (column 0) with their rows. Rows of a block stand together, so OPEN_BLOCKS are held at once; a block may come in parts."""
    held: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        blocks, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[order], np.arange(len(blocks) + 1))
        for k, block in enumerate(blocks.tolist()):
            held.setdefault(block, []).append(batch.take(pa.array(order[edges[k] : edges[k + 1]])))
        while len(held) > OPEN_BLOCKS:
            block = next(iter(held))
            yield block, held.pop(block)
    yield from held.items()


def _texts(batch: pa.RecordBatch) -> Iterator[list[str]]:
    for part in sliced([batch], ROWS, batch.num_columns - 1):
        yield [t or "" for t in part.column(part.num_columns - 1).to_pylist()]


def perplexities(docs: DataFrame, model: Model, where: list[Column | str] | None = None) -> DataFrame:
    """_row, doc_id, lang, n_symbols, nats (mean negative log-probability; null without words).

    where: see `_block`; `_row` is null then. Without it docs is `written`, and its numbers serve.
    """
    rows = docs.withColumn("_row", F.lit(None).cast("long")) if where else written(docs).withColumn("_row", F.col(NUMBER))
    rows = rows.select(_block(docs, where or [F.col(NUMBER)]).alias("block"), _fold().alias("fold"), "_row", "doc_id", F.col("lang").cast("string"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"_row long, doc_id {kind}, lang string, n_symbols long, nats double"

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _by_block(batches):
            context, symbol = (np.concatenate(x) for x in zip(*[distinct_grams(t)[:2] for part in parts for t in _texts(part)]))
            contexts, at = np.unique(context, return_inverse=True)
            keys = np.unique((at << WIDE) | symbol)
            context, symbol = contexts[keys >> WIDE], keys & ((1 << WIDE) - 1)
            fold = np.full(len(keys), parts[0].column(1)[0].as_py(), np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), block, np.int64)), pa.array(fold), pa.array(context), pa.array(symbol.astype(np.int32))],
                ["block", "fold", "context", "symbol"],
            )

    def score(packed: pa.Table, known: pa.Table) -> pa.Table:
        context, symbol, log_p = (known.column(c).to_numpy() for c in ("context", "symbol", "log_p"))
        contexts, at = np.unique(context, return_inverse=True)
        keys = (at << WIDE) | symbol
        order = np.argsort(keys)
        keys, log_p = keys[order], log_p[order].astype(np.float64)
        out = []
        for data in packed.column("rows"):
            with pa.ipc.open_stream(data.as_buffer()) as stream:
                for batch in stream:
                    sums, lengths = [], []
                    for texts in _texts(batch):
                        own_context, own_symbol, inverse, n = distinct_grams(texts)
                        of_grams = log_p[np.searchsorted(keys, (np.searchsorted(contexts, own_context) << WIDE) | own_symbol)]
                        total, ends = np.concatenate([[0.0], np.cumsum(of_grams[inverse])]), np.cumsum(n)
                        sums.append(total[ends] - total[ends - n])
                        lengths.append(n)
                    n = np.concatenate(lengths)
                    nats = pa.array(-np.concatenate(sums) / np.maximum(n, 1), pa.float64(), mask=n == 0)
                    out.append(pa.RecordBatch.from_arrays([*batch.columns[2:5], pa.array(n), nats], ["_row", "doc_id", "lang", "n_symbols", "nats"]))
        return pa.Table.from_batches(out)

    found = stored(rows.select("block", "fold", "text").mapInArrow(grams, "block long, fold int, context long, symbol int"), "block-grams")
    known = log_probabilities(found.select("fold", "context", "symbol").distinct(), model)
    known = stored(known.withColumn("log_p", F.col("log_p").cast("float")), "log-probabilities")
    told = found.join(known, ["fold", "context", "symbol"]).select("block", "context", "symbol", "log_p")
    return _packed(rows).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def quantiles(scores: DataFrame, keys: list[str], q: float) -> DataFrame:
    """The q-quantile of `nats` for each key, exact to STEP: the first step at which the share q is reached."""
    steps = scores.groupBy(*keys, F.ceil(F.col("nats") / STEP).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    reached = steps.select(*keys, "step", F.sum("n").over(up).alias("so_far"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    return reached.where(F.col("so_far") >= q * F.col("all")).groupBy(*keys).agg((F.min("step") * STEP).alias("at"))


def judged(scores: DataFrame, known: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """scores with `score`, `threshold` (both in nats; null without any trusted document) and `kept`.

    known: the scores of trusted documents.
    """
    known = known.where("nats is not null")
    levels = ((0.5, "middle"), (quantile, "high"))
    by_lang = [quantiles(known, ["lang"], q).withColumnRenamed("at", name) for q, name in levels]
    overall = [next((r["at"] for r in quantiles(known.withColumn("k", F.lit(1)), ["k"], q).collect()), None) for q, _ in levels]  # one number each
    rows = scores.join(sized(by_lang[0].join(by_lang[1], "lang"), 100_000), "lang", "left")
    middle, high = (F.coalesce(c, F.lit(x).cast("double")) for c, x in zip(("middle", "high"), overall))
    n = F.col("n_symbols")
    score = (F.col("nats") * n + middle * PRIOR_SYMBOLS) / (n + PRIOR_SYMBOLS)
    return rows.select(
        *scores.columns, score.alias("score"), (high + slack).alias("threshold"),
        F.when(F.col("nats").isNull(), False).otherwise(F.coalesce(score <= high + slack, F.lit(True))).alias("kept"),
    )


def classify(
    docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, where: list[Column | str] | None = None
) -> DataFrame:
    """_row, doc_id, lang, n_symbols, nats, score, threshold, kept for each row of docs; where: see `perplexities`."""
    with scratch(docs.sparkSession):
        ids = sized(stored(trusted_ids(labels), "trusted", keep=True))
        model = train(docs.join(ids, "doc_id", "left_semi").select(_fold().alias("fold"), "text"))
        scores = stored(perplexities(docs, model, where), "perplexities", keep=True)
    return judged(scores, scores.join(ids, "doc_id", "left_semi"), quantile, slack)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rows that the classifier rejects."""
    written(docs)
    with scratch(docs.sparkSession):
        bad = stored(classify(docs, labels, **options).where(~F.col("kept")).select("_row"), "rejected", keep=True)
    return without_rows(docs, bad)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    in_files = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    return classify(docs, labels, where=in_files).select(
        "doc_id", F.exp("nats").alias("perplexity"), F.exp("score").alias("score"), F.exp("threshold").alias("threshold"), "kept"
    )
