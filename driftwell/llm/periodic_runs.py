"""Periodic runs: stretches of words that repeat with a period, such as one line three times or more in a row.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a
length of at least max(24, 3 * q) that no neighbouring word extends keeping the period.

1. Words become numbers, and a stretch that may hold a run is cut out: within a run every 8 words
   occur again inside the run, so a run lies inside a stretch of places whose 8 words occur elsewhere
   in the stretch. Stretches are looked for in what the pass before left until nothing more goes. The
   cut is exact: runs, and the words that end them, are never touched by it.
2. Each stretch gets the suffix automaton of its words. Its states, by their links, form a tree; the
   states above a prefix's state are the suffixes that end with it. Appending word i is the `access`
   of a link-cut tree: the path from the prefix's state to the root takes the colour i, and the
   segments of other colours that it covers say where those suffixes ended last. A segment of colour
   e and longest suffix L means that the words before i repeat at a distance of i - e for exactly L
   words; with i - e <= L that is a square, whose first word is i - L - (i - e) + 1. The most recent
   end is at the smallest period, so a square's distance is the smallest period of its stretch.
   Squares of one period at consecutive words are one run.
   Links of the finished automaton don't change, so the preferred paths of the link-cut tree are
   kept as stacks of segments on heavy paths in place of splay trees: an access covers the upper
   part of each heavy path that it meets, and what it covers leaves the stack.

Every text is a row of its own; no shuffle takes place. A task works on SLICE_BYTES of text at once;
a longer text is worked on alone, and its automaton grows with its repetitive stretches only.

Defined results: null and wordless texts have no words and no runs; repeated rows get the same
result; an empty table gives an empty result; columns besides id and text may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .placed_words import WHITE_SPACE, placed_words
from .workspace import numbered, sliced

#: Words of a run at least, and how many times its period.
RUN_WORDS, TIMES = 24, 3
#: Words of which every place in a run has a copy in the run: at most (RUN_WORDS + 2) / 3, and 8 hold for any period.
GRAM = 8
#: Texts that a task works on at once.
ROWS = 512
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

Run = tuple[int, int, int]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


def _stretches(place: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges in `place` of the stretches of consecutive places of one owner that are long enough for a run."""
    new = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(owner) != 0)])[: len(place)]
    at = np.append(np.flatnonzero(new), len(place))
    long = np.diff(at) >= RUN_WORDS - GRAM + 1
    return at[:-1][long], at[1:][long]


def repetitive(first: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """(first word, end) of the stretches that may hold runs, in texts of the words first[i] to first[i + 1]."""
    grams = np.zeros(len(ids), np.uint64)
    words = ids.astype(np.uint64) + np.uint64(1)
    for k in range(GRAM):
        grams[: len(ids) - k] = _mix(grams[: len(ids) - k] + words[k:] * _K[0] + np.uint64(k))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(ids))
    place = place[place + GRAM <= first[1:][owner]]
    owner = owner[place]
    while len(place):
        key = _mix(grams[place] + owner.astype(np.uint64) * _K[0])
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(np.diff(key[order]) == 0)
        twice = np.zeros(len(place), bool)
        twice[order[same]] = twice[order[same + 1]] = True
        low, high = _stretches(place[twice], owner[twice])
        if not len(low):
            return []
        own = place[twice]
        kept = np.concatenate([own[a:b] for a, b in zip(low.tolist(), high.tolist())])
        if len(kept) == len(place):
            return [(int(own[a]), int(own[b - 1]) + GRAM) for a, b in zip(low.tolist(), high.tolist())]
        place, owner = kept, np.repeat(np.arange(len(low)), high - low)
    return []


class SuffixAutomaton:
    """All factors of a sequence. States from 0 (the root): the length of the longest factor, the link to the longest
    suffix that ends at more places, and transitions: the first of each state in arrays, others in `more`."""

    def __init__(self, words: list[int]):
        self.length, self.link, self.prefix = [0], [-1], []
        self._word, self._to, self._more = [-1], [-1], {}
        last = 0
        for w in words:
            last = self._append(last, w)
            self.prefix.append(last)

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self._word.append(-1)
        self._to.append(-1)
        return len(self.length) - 1

    def _next(self, state: int, w: int) -> int:
        if self._word[state] == w:
            return self._to[state]
        more = self._more.get(state)
        return more.get(w, -1) if more else -1

    def _lead(self, state: int, w: int, to: int) -> None:
        if self._word[state] in (-1, w):
            self._word[state], self._to[state] = w, to
        else:
            self._more.setdefault(state, {})[w] = to

    def _append(self, last: int, w: int) -> int:
        new = self._state(self.length[last] + 1, 0)
        at = last
        while at >= 0 and (to := self._next(at, w)) < 0:
            self._lead(at, w, new)
            at = self.link[at]
        if at < 0:
            return new
        if self.length[at] + 1 == self.length[to]:
            self.link[new] = to
            return new
        copy = self._state(self.length[at] + 1, self.link[to])
        self._word[copy], self._to[copy] = self._word[to], self._to[to]
        if to in self._more:
            self._more[copy] = dict(self._more[to])
        while at >= 0 and self._next(at, w) == to:
            self._lead(at, w, copy)
            at = self.link[at]
        self.link[to] = self.link[new] = copy
        return new

    def heads(self) -> list[int]:
        """The topmost state of each state's heavy path in the tree of links."""
        length, link = self.length, self.link
        deepest_first = np.argsort(np.array(length), kind="stable")[::-1].tolist()
        weight, heavy = [1] * len(length), [-1] * len(length)
        for s in deepest_first[:-1]:
            up = link[s]
            weight[up] += weight[s]
            if heavy[up] < 0 or weight[s] > weight[heavy[up]]:
                heavy[up] = s
        head = list(range(len(length)))
        for s in reversed(deepest_first):  # above before below
            if heavy[s] >= 0:
                head[heavy[s]] = head[s]
        return head


def squares(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(i, q, L): the L words up to word i occurred q words before, most recently, exactly so many, and q <= L.

    Of one i and q the greatest L comes first; smaller ones may follow.
    """
    automaton = SuffixAutomaton(words)
    length, link, head = automaton.length, automaton.link, automaton.heads()
    #: Of each heavy path, (longest factor, colour) of its segments, the lowest first.
    stacks: list[list[tuple[int, int]] | None] = [None] * len(length)
    for i, state in enumerate(automaton.prefix):
        while state > 0:
            top, reach = head[state], length[state]
            stack = stacks[top]
            if stack is None:
                stacks[top] = [(reach, i)]
            else:
                met = []
                while stack and stack[-1][0] <= reach:
                    met.append(stack.pop())
                if stack:
                    met.append((reach, stack[-1][1]))
                for longest, end in reversed(met):
                    if i - end <= longest:
                        yield i, i - end, longest
                stack.append((reach, i))
            state = link[top]


def runs_of(words: list[int]) -> list[Run]:
    """(start, length, period) of the runs of a sequence, by start, then period."""
    found: list[Run] = []
    open_runs: dict[int, list[int]] = {}

    def close(q: int, start: int, end: int) -> None:
        if end - start + 1 >= max(RUN_WORDS, TIMES * q):
            found.append((start, end - start + 1, q))

    for i, q, longest in squares(words):
        run = open_runs.get(q)
        if run is not None and run[1] >= i - 1:
            run[1] = i
            continue
        if run is not None:
            close(q, *run)
        open_runs[q] = [i - longest - q + 1, i]
    for q, run in open_runs.items():
        close(q, *run)
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Of n words those that no run contains after its first period."""
    kept = np.ones(n, bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return kept


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, id, n_words, runs (array of start, length and period in words, by start, then period) and collapsed (the
    kept words joined by one space) for each row of docs."""
    rows = numbered(docs, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS, 2):
            words = placed_words(batch.column(2), WHITE_SPACE)
            first = words.first.tolist()
            runs: list[list[Run]] = [[] for _ in range(batch.num_rows)]
            for low, high in repetitive(words.first, words.ids):
                text = int(np.searchsorted(words.first, low, side="right")) - 1
                shift = low - first[text]
                runs[text] += [(start + shift, length, q) for start, length, q in runs_of(words.ids[low:high].tolist())]
            texts = []
            for text, own in zip(batch.column(2).cast(pa.binary()).to_pylist(), runs):
                parts = (text or b"").split()
                if own:
                    own.sort(key=lambda r: (r[0], r[2]))
                    parts = [parts[k] for k in np.flatnonzero(kept_words(len(parts), own)).tolist()]
                texts.append(b" ".join(parts))
            flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
            places = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            lists = pa.ListArray.from_arrays(places, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(words.first)), lists, pa.array(texts, pa.binary()).cast(pa.string())],
                ["_row", "id", "n_words", "runs", "collapsed"],
            )

    return rows.mapInArrow(find, f"_row long, id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones the first. Null if there is none."""
    better = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    return F.when(F.size(runs) > 0, F.reduce(runs, F.get(runs, F.lit(0)), better))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The contract's texts: of a tenth of the documents, by their id, the words from some word on repeat with a period."""
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, a, p = F.size("_words").cast("long"), F.col("_a"), F.col("_p")
    g = F.floor(h / 10).cast("long")
    at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
    planted = F.array_join(F.transform(at, lambda i: F.get("_words", i.cast("int"))), " ")
    out = docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("_words"), "text")
    out = out.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", F.floor((n - a) / (g % 8 + 3)).cast("long") + 1)
    return out.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(with_planted_runs(docs)).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
