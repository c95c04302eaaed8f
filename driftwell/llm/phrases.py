"""Phrase collocations by Toivonen's method: a sample proposes phrases, a full pass counts them and their border.

Frequent are phrases of 1 to 3 words that occur LEAST times or more in their language; a phrase can be
frequent only if both phrases inside it that are one word shorter are. That holds for the sample, too:

1. A sample of documents (by a hash of the text, SHARE of them, so it grows with the table) is counted
   against a lowered threshold. What reaches it is proposed: words and pairs of words.
2. The full pass counts, together: all words; all pairs of proposed words; all triples whose two pairs are
   proposed. These are the proposed phrases and their negative border, the smallest phrases that the sample
   doesn't propose. It has two scans. The first counts phrases by slots of a hash space, 2 ** 32 for each of
   its buckets, which says how often a phrase occurs at most; the second counts exactly, by the hashes of all
   its words, what may reach LEAST. Few phrases do, so few are shuffled with their words.
3. Where something of the border is frequent, the sample was wrong about it, and larger phrases may have
   been left out: those that the true frequent phrases now suggest and no pass has counted. Another full pass
   counts them alone. This ends when no frequent phrase is outside of what the last pass was told: with
   three words after two such passes at most.

Tasks hold the proposed phrases as bitmaps that grow with their number up to MOST_BITS (32 MB); a bitmap that
says yes too often makes a task count more, never less, and the same bitmaps tell later passes what was
counted. Tasks add up blocks of 8 MB of text before anything is shuffled, so a common phrase sends one
count a block. Words are told apart by 64-bit hashes; a hash of two words, one of them frequent, is found
and the whole is done again with other hashes.

Scores compare a phrase with its two parts at its weakest cut; sums and products are decimals of 38 digits.
The best of each language are taken in rounds of bounded groups, never from all phrases in one task.

Defined results: null and wordless texts have no phrases; a null language is `und`, with texts that say so;
repeated rows count as often as they come; texts of any length are cut at SLICE_BYTES only between texts (a
longer one is worked on alone); an empty table has no phrases; columns besides text and lang may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .placed_words import byte_kinds, placed_words
from .workspace import scratch, sized, sliced, stored

#: Words end at spaces and tabs, pieces at marks and line ends.
KINDS = byte_kinds(b" \t", b".,;:!?\n\v\f\r")
LEAST, TOP, MOST_WORDS = 10, 2000, 3
#: Percent of a phrase's occurrences that lie in one longer candidate, from which it is dropped.
INSIDE = 50
#: Of a hundred documents so many are the sample; what occurs twice there is proposed.
SHARE, LOWERED = 25, 2
#: Bytes of text that a task adds up before it sends counts.
BLOCK_BYTES = 8 << 20
#: Bits of a bitmap for each phrase, and at most.
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Texts that a task works on at once.
ROWS = 4096
#: Words whose phrases a task looks up at once.
WORDS = 1 << 17
#: Rows that one task ranks; rows of phrases or words that a join broadcasts.
RANKED, BROADCAST = 64_000, 200_000
TRIES = 8
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


def phrase_hash(*words: np.ndarray) -> np.ndarray:
    """One hash of phrases from those of their words; phrases of one, two and three words have hashes of their own."""
    out = np.full(len(words[0]), len(words), np.uint64)
    for h in words:
        out = _mix(out * _K[0] + h.view(np.uint64))
    return out


def _held(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(bitmap.size * 8 - 1)
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bitmap(slots: DataFrame) -> Broadcast:
    """A bitmap of the low bits of `slot`, of a size that follows the number of rows; its bytes are bounded by MOST_BITS."""
    bits = max(1 << 15, min(MOST_BITS, 1 << (BITS_EACH * slots.count()).bit_length()))
    slot = F.col("slot").bitwiseAND(bits - 1)
    pages = slots.groupBy(F.shiftright(slot, 15).alias("page")).agg(F.bitmap_construct_agg(slot.bitwiseAND((1 << 15) - 1)).alias("bits"))
    out = np.zeros((bits >> 15, 4096), np.uint8)
    for page, data in pages.toLocalIterator():
        out[page] = np.frombuffer(bytes(data), np.uint8)
    return slots.sparkSession.sparkContext.broadcast(out.reshape(-1))


class _Block:
    """Texts of a task, until their phrases are added up together."""

    def __init__(self, seed: int, hash_bits: int):
        self.seed, self.mask = seed, (1 << hash_bits) - 1
        self.texts: list[pa.RecordBatch] = []
        self.size = 0

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
        """Itself, whenever it has BLOCK_BYTES of batches (lang, text), and with the rest at the end."""
        for batch in sliced(batches, ROWS, 1):
            self.texts.append(batch)
            self.size += batch.nbytes
            if self.size >= BLOCK_BYTES:
                yield self
                self.texts, self.size = [], 0
        if self.texts:
            yield self

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, tuple[int, pa.Array]]]:
        """The words' hashes by number, the words' numbers in their order, whether a word and the next are in one piece,
        and of each language the number of its first word and its words."""
        from xxhash import xxh3_64_intdigest

        table = pa.Table.from_batches(self.texts).combine_chunks()
        langs = table.column(0).combine_chunks()
        hashes, words, pieces, names, n_pieces = [], [], [], {}, 0
        for lang in langs.unique().to_pylist():
            own = pa.RecordBatch.from_arrays([table.column(1).filter(pc.equal(langs, lang)).combine_chunks()], ["text"])
            encoded = []
            for part in sliced([own], ROWS, 0):  # what finds words takes many times the bytes of its texts
                placed = placed_words(part.column(0), KINDS, lower=True)
                encoded.append(pa.DictionaryArray.from_arrays(pa.array(placed.ids), placed.distinct))
                text = np.repeat(np.arange(len(placed.first) - 1), np.diff(placed.first))
                pieces.append(placed.piece + text + n_pieces)  # a text begins a piece
                n_pieces = int(pieces[-1][-1]) + 1 if len(text) else n_pieces
            encoded = pa.chunked_array(encoded).unify_dictionaries()
            distinct = encoded.chunk(0).dictionary
            names[lang] = len(hashes), distinct
            words += [part.indices.to_numpy() + np.int32(len(hashes)) for part in encoded.chunks]
            seed = xxh3_64_intdigest(lang.encode(), seed=self.seed)
            hashes += [xxh3_64_intdigest(word, seed=seed) & self.mask for word in distinct.to_pylist()]
        piece = np.concatenate(pieces)
        return np.array(hashes, np.uint64).view(np.int64), np.concatenate(words), piece[1:] == piece[:-1], names


def asked(told: list[np.ndarray], hashes: np.ndarray, first: np.ndarray | slice, second: np.ndarray | slice) -> np.ndarray:
    """Whether the last of `told` holds both parts of a phrase and none before it does; without `told` always."""
    new = np.ones(len(hashes[first]), bool)
    for k, held in enumerate(told):
        own = _held(hashes, held)
        both = own[first] & own[second]
        new &= both if k == len(told) - 1 else ~both
    return new


def wanted(
    hashes: np.ndarray, words: np.ndarray, together: np.ndarray, told: list[np.ndarray], longest: int, likely: np.ndarray | None = None
) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(places of each word of the phrase in `words`, hashes of the phrases), for two words and for three; with `likely` those that it holds.

    WORDS are looked at at once, so that what the looking takes does not follow the block.
    """
    own = phrase_hash(hashes)
    for size in range(2, longest + 1):
        places, found = [], []
        for start in range(0, max(1, len(words) - size + 1), WORDS):
            w = words[start : start + WORDS + size - 1]
            t = together[start : start + max(0, len(w) - 1)]
            if size == 2:
                at = np.flatnonzero(t & asked(told, own, w[:-1], w[1:]))
            else:
                h = hashes[w]
                at = np.flatnonzero(t[:-1] & t[1:] & asked(told, phrase_hash(h[:-1], h[1:]), slice(None, -1), slice(1, None)))
            new = phrase_hash(*[hashes[w[at + k]] for k in range(size)])
            if likely is not None:
                kept = _held(new, likely)
                at, new = at[kept], new[kept]
            places.append(at + start)
            found.append(new)
        at = np.concatenate(places)
        yield [at + k for k in range(size)], np.concatenate(found)


_ENTRY = np.dtype([("slot", "<u4"), ("n", "u1")])


def slot_counts(hashes: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """bucket, entries: blobs of (slot, count) by bucket of the hash space; 255 stands for any larger count."""
    bucket = ((hashes >> np.uint64(32)) & np.uint64(buckets - 1)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    blob = np.empty(len(hashes), _ENTRY)
    blob["slot"], blob["n"] = (hashes & np.uint64(0xFFFFFFFF))[order], np.minimum(n, 255)[order]
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(edges))
    return pa.RecordBatch.from_arrays([pa.array(full), pa.array([blob[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary())], ["bucket", "entries"])


def frequent_slots(docs: DataFrame, told: list[Broadcast], least: int, longest: int, seed: int, hash_bits: int) -> DataFrame:
    """slot: of all phrases that may occur `least` times or more."""
    parts = docs.rdd.getNumPartitions()
    buckets = 1 << max(6, (4 * parts).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [t.value for t in told]
        for block in _Block(seed, hash_bits).blocks(batches):
            hashes, words, together, _ = block.flat()
            yield slot_counts(phrase_hash(hashes), np.bincount(words, minlength=len(hashes)), buckets)
            for _, found in wanted(hashes, words, together, bitmaps, longest):
                yield slot_counts(*np.unique(found, return_counts=True), buckets)

    def across(table: pa.Table) -> pa.Table:
        entries = np.concatenate([np.frombuffer(x.as_buffer(), _ENTRY) for x in table.column("entries")])
        entries = entries[np.argsort(entries["slot"], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], np.diff(entries["slot"].astype(np.int64)) != 0]))
        n = np.add.reduceat(entries["n"].astype(np.int64), first)
        enough = (n >= least) | (np.maximum.reduceat(entries["n"], first) == 255)
        return pa.table({"slot": entries["slot"][first[enough]].astype(np.int64)})

    return docs.mapInArrow(count, "bucket long, entries binary").groupBy("bucket").applyInArrow(across, "slot long")


def phrase_counts(docs: DataFrame, told: list[Broadcast], least: int, seed: int, hash_bits: int, likely: Broadcast | None = None) -> DataFrame:
    """h1, h2, h3, lang, word, n: how often phrases of docs (lang, text) occur, from `least` on.

    h2 and h3 are null where there are fewer words; lang and word only come with single words. With `likely`, only
    phrases that it holds are counted, single words too (those however rare), and a row without h1 has the
    number of all words of its language; without it there are no single words.
    """
    names = ["h1", "h2", "h3", "lang", "word", "n"]

    def rows(columns: list[np.ndarray], n: np.ndarray, lang: str | None = None, words: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(n), 1 << 16):
            part = slice(at, at + (1 << 16))
            m = len(n[part])
            longs = [pa.array(c[part]) for c in columns] + [pa.nulls(m, pa.int64())] * (3 - len(columns))
            named = pa.nulls(m, pa.string()) if words is None else words.slice(at, m).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*longs, pa.array([lang] * m, pa.string()), named, pa.array(n[part])], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [t.value for t in told]
        for block in _Block(seed, hash_bits).blocks(batches):
            hashes, words, together, by_lang = block.flat()
            if likely is not None:
                n, enough = np.bincount(words, minlength=len(hashes)), _held(phrase_hash(hashes), likely.value)
                for lang, (first, distinct) in by_lang.items():
                    own = slice(first, first + len(distinct))
                    kept = np.flatnonzero(enough[own])
                    yield from rows([hashes[own][kept]], n[own][kept], lang, distinct.take(pa.array(kept)))
                    yield from rows([], n[own].sum(keepdims=True), lang)
            for places, found in wanted(hashes, words, together, bitmaps, MOST_WORDS, None if likely is None else likely.value):
                # Equal phrases have equal hashes; those of one hash and other words stay apart.
                own = np.stack([hashes[words[p]] for p in places])
                order = np.lexsort((*own[::-1], found))
                own = own[:, order]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(own, axis=1) != 0).any(axis=0)])[: len(found)])
                yield from rows(list(own[:, new]), np.diff(np.append(new, len(found))))

    counted = docs.mapInArrow(count, "h1 long, h2 long, h3 long, lang string, word string, n long")
    return counted.groupBy("h1", "h2", "h3", "lang", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("h2").isNull())


def slots_of(found: DataFrame, told: Broadcast | None = None) -> DataFrame:
    """slot of each phrase of one or two words; with `told` of those that it doesn't hold.

    Both are settled in one pass: two passes of Arrow in one stage keep two Python workers for each task.
    """

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = batch.column(0).to_numpy(), batch.column(1)
            two = np.asarray(pc.is_valid(h2))
            out = np.where(two, phrase_hash(h1, pc.fill_null(h2, 0).to_numpy()), phrase_hash(h1)) & np.uint64(0xFFFFFFFF)
            if told is not None:
                out = out[~_held(out, told.value)]
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], ["slot"])

    return found.where("h1 is not null and h3 is null").select("h1", "h2").mapInArrow(slots, "slot long")


def frequent(docs: DataFrame, least: int = LEAST, *, share: int = SHARE, lowered: int = LOWERED, seed: int = 0, hash_bits: int = 64) -> tuple[DataFrame, list[int]] | None:
    """The rows of phrase_counts for all frequent phrases, and how much of the border failed before each further pass.

    None if a frequent word shares its hash with another word.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(100)) < share)
    told = [bitmap(stored(frequent_slots(sample, [], lowered, 2, seed, hash_bits), "proposed"))]
    likely = bitmap(stored(frequent_slots(docs, told, least, MOST_WORDS, seed, hash_bits), "likely"))
    counted = stored(phrase_counts(docs, told, least, seed, hash_bits, likely), "phrases")
    same = counted.where("word is not null").groupBy("h1").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("most"))
    if not same.where((F.col("words") > 1) & (F.col("most") >= least)).isEmpty():
        return None
    found, failed = counted.where((F.col("n") >= least) | F.col("h1").isNull()), []
    while missed := slots_of(found, told[-1]).count():
        failed.append(missed)
        told.append(bitmap(stored(slots_of(found), "told")))
        found = found.unionByName(stored(phrase_counts(docs, told, least, seed, hash_bits), "more-phrases"))
    return found, failed


def scored(found: DataFrame) -> DataFrame:
    """lang, h1, h2, h3, a, l, r, score of the candidates that no longer one takes up."""
    words = found.where("word is not null").select("h1", "lang", "n")
    pairs = found.where("h2 is not null and h3 is null").select("h1", "h2", "n")
    triples = found.where("h3 is not null").select("h1", "h2", "h3", "n")

    def count_of(rows: DataFrame, table: DataFrame, on: dict[str, str], name: str, *more: str) -> DataFrame:
        side = table.select(*[F.col(theirs).alias(f"_{ours}") for ours, theirs in on.items()], F.col("n").alias(name), *more)
        return rows.join(sized(side, BROADCAST), [F.col(ours) == F.col(f"_{ours}") for ours in on]).drop(*[f"_{ours}" for ours in on])

    def score(left: str, right: str) -> Column:
        wide = lambda c: f"cast({c} as decimal(19, 0))"
        return F.expr(f"(cast(1000000 as decimal(7, 0)) * {wide('a')} * {wide('a')}) div ({wide(left)} * {wide(right)})")

    two = pairs.select("h1", "h2", F.col("n").alias("a"))
    two = count_of(count_of(two, words, {"h1": "h1"}, "l", "lang"), words, {"h2": "h1"}, "r").withColumn("score", score("l", "r"))
    longer = triples.select("h1", "h2", "n").unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "n"))
    longer = longer.groupBy("h1", "h2").agg(F.max("n").alias("longer"))
    two = two.join(longer, ["h1", "h2"], "left").where(F.coalesce("longer", F.lit(0)) * 100 < F.col("a") * INSIDE).drop("longer")
    three = triples.withColumnRenamed("n", "a")
    three = count_of(count_of(three, words, {"h1": "h1"}, "l1", "lang"), pairs, {"h2": "h1", "h3": "h2"}, "r1").withColumn("s1", score("l1", "r1"))
    three = count_of(count_of(three, pairs, {"h1": "h1", "h2": "h2"}, "l2"), words, {"h3": "h1"}, "r2").withColumn("s2", score("l2", "r2"))
    early = F.col("s1") <= F.col("s2")
    pick = lambda x: F.when(early, F.col(f"{x}1")).otherwise(F.col(f"{x}2"))
    three = three.select("lang", "h1", "h2", "h3", "a", pick("l").alias("l"), pick("r").alias("r"), pick("s").alias("score"))
    return three.unionByName(two.withColumn("h3", F.lit(None).cast("long")).select(three.columns))


def best_of(rows: DataFrame, group: str, order: list[Column], top: int, ranked: int = RANKED) -> DataFrame:
    """The first rows of each group, with their rank. Groups are cut by hash, and the best of each part go on, until a task can rank them."""
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    n = rows.count()
    while n > ranked:
        parts = F.pmod(F.xxhash64(*rows.columns), F.lit(-(-n // ranked)))
        rows = stored(rows.withColumn("_part", parts).withColumn("rank", place(group, "_part")).where(F.col("rank") <= top).drop("rank", "_part"), "best")
        before, n = n, rows.count()
        if 2 * n > before:
            break
    return rows.withColumn("rank", place(group)).where(F.col("rank") <= top)


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    with scratch(docs.sparkSession):
        for seed in range(TRIES):
            if (counted := frequent(docs, least, seed=seed, **options)) is not None:
                break
        else:
            raise RuntimeError(f"two words had one hash {TRIES} times")
        found = counted[0]
        words = found.where("word is not null").select("h1", "word")
        rows = stored(scored(found), "scored-phrases")
        for k in (1, 2, 3):
            rows = rows.join(sized(words.select(F.col("h1").alias(f"h{k}"), F.col("word").alias(f"w{k}")), BROADCAST), f"h{k}", "left")
        rows = rows.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score")
        totals = found.where("h1 is null").select("lang", "n")
        kept = stored(best_of(rows, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top).join(sized(totals), "lang"), "phrases", keep=True)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS p
  FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w FROM p),
o AS (
  SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(k)),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM o GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, phrase, a, j, array_to_string(w[1 : j], ' ') AS first, array_to_string(w[j + 1 : c.k], ' ') AS rest
  FROM c, (VALUES (1), (2)) v(j) WHERE j < c.k),
s AS (
  SELECT cuts.*, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, array_to_string(w[1 : 2], ' ') AS phrase, a FROM c WHERE k = 3
        UNION ALL SELECT lang, array_to_string(w[2 : 3], ' '), a FROM c WHERE k = 3) GROUP BY 1, 2),
kept AS (
  SELECT low.* FROM low LEFT JOIN inside ON inside.lang = low.lang AND inside.phrase = low.phrase AND low.k = 2
  WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT kept.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang)
WHERE rank <= 2000
"""
