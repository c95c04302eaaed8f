"""SentencePiece encoding and decoding by exact merge-type BPE with backtracking.

A text is encoded without building it up by merges. An Aho-Corasick pass gives the longest
piece from each place; pieces are taken left to right, and a piece may follow another only
if re-merging the two together gives the same two again. Where no piece fits, the place is
marked in a bitfield as failed and the piece before is shortened. The result is the one
sequence that merging would have produced.

Merges never cross the front of a word (no piece but runs of the space mark has that mark
inside), so words are encoded on their own and kept in a bounded memo; any text length
works, in time linear in it. Texts are read in Arrow batches, nothing is shuffled.

Defined results: null is the empty text, which has no ids; repeated rows are encoded
alike; columns besides id and text are passed over.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import sliced

SPACE = "▁"
#: Words in each of a worker's two memos and the longest that goes in (about 250 bytes a word, 50 MB in all),
#: and pairs of pieces whose fit is known (about 200 bytes each, 40 MB).
MEMO_WORDS, MEMO_CHARS, PAIRS = 100_000, 48, 200_000
#: Rows that a task encodes at once.
ROWS = 512
_RUN = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceBPE:
    """The vocabulary of a BPE model with byte fallback, and exact encoding with it."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.text: dict[int, str] = {}
        self.byte_id, self.byte_of = [sp.unk_id()] * 256, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.byte_of[i] = i, value
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.score[piece], self.text[i] = i, sp.get_score(i), piece
        self.chars = {c for piece in self.ids for c in piece}
        runs = {p for p in self.ids if len(p) > 1 and not p.strip(SPACE)}
        if any(SPACE in p[1:] for p in self.ids if p not in runs):
            raise ValueError("a piece of this model crosses the front of a word")
        self.word_score = {p: s for p, s in self.score.items() if p not in runs and len(p) > 1}
        self.run_score = {p: s for p, s in self.score.items() if p in runs}
        # What merging can end in: single characters, and pieces that merge to themselves.
        self.units = self.chars | {p for p in self.word_score if self.merge(p, self.word_score) == [p]}
        self.finder = ahocorasick.Automaton()
        for unit in self.units:
            if len(unit) > 1:
                self.finder.add_word(unit, unit)
        self.finder.make_automaton()
        self.shorter: dict[str, str | None] = {
            u: next((u[:k] for k in range(len(u) - 1, 0, -1) if u[:k] in self.units), None) for u in self.units
        }
        self.follows: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.breaks = "\n" not in self.chars
        self.line_break = array("i", self.unit_ids("\n")).tobytes()
        #: What an id shows as: pieces, and bytes that are characters of their own.
        self.shown = {i: p.replace(SPACE, " ") for i, p in self.text.items()}
        self.shown |= {i: chr(v) for i, v in self.byte_of.items() if v < 128}
        self.shown |= {i: "" for i in range(sp.get_piece_size()) if sp.is_control(i)}
        self.number = list(map(str, range(sp.get_piece_size())))

    @staticmethod
    def merge(symbols: Iterable[str], score: dict[str, float]) -> list[str]:
        """Merging as defined: the best-scored adjacent pair first, the leftmost among equals."""
        out = list(symbols)
        while True:
            best, at = None, -1
            for i in range(len(out) - 1):
                s = score.get(out[i] + out[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return out
            out[at : at + 2] = [out[at] + out[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.follows.get(key)
        if known is None:
            known = self.merge(left + right, self.word_score) == [left, right]
            if len(self.follows) < PAIRS:
                self.follows[key] = known
        return known

    def backtrack(self, word: str) -> list[str]:
        """The units of a word all of whose characters are in the vocabulary."""
        longest = list(word)
        for end, unit in self.finder.iter(word):
            longest[end - len(unit) + 1] = unit  # later ends are longer
        failed, stack, pos, unit, n = bytearray(len(word) + 1), [], 0, longest[0], len(word)
        while True:
            end = pos + len(unit)
            if not failed[end] and (not stack or self.fits(stack[-1], unit)):
                stack.append(unit)
                if end == n:
                    return stack
                pos, unit = end, longest[end]
                continue
            shorter = self.shorter[unit]
            while shorter is None:
                failed[pos] = 1
                unit = stack.pop()
                pos -= len(unit)
                shorter = self.shorter[unit]
            unit = shorter

    def units_of(self, word: str) -> list[str]:
        """Like backtrack, for any word; characters outside the vocabulary stay alone."""
        if not word:
            return []
        chars = self.chars
        if chars.issuperset(word):
            return self.backtrack(word)
        out, start = [], 0
        for i, c in enumerate(word):
            if c not in chars:
                if start < i:
                    out += self.backtrack(word[start:i])
                out.append(c)
                start = i + 1
        return out + (self.backtrack(word[start:]) if start < len(word) else [])

    def unit_ids(self, units: Iterable[str]) -> list[int]:
        known = self.ids.get
        out = [known(u) for u in units]
        if None not in out:
            return out
        ids, byte_id, out = self.ids, self.byte_id, []
        for u in units:
            i = ids.get(u)
            out += [i] if i is not None else [byte_id[b] for b in u.encode("utf-8", "surrogatepass")]
        return out

    @lru_cache(maxsize=_RUN)  # noqa: B019  one vocabulary lives as long as its worker
    def _short_run(self, n: int) -> list[int]:
        return self.unit_ids(self.merge(SPACE * n, self.run_score))

    def run_ids(self, n: int) -> list[int]:
        """n space marks in a row. Merged from the left, long runs begin with the longest piece."""
        if not self.run_score:
            return [self.ids[SPACE]] * n
        longest = max(self.run_score, key=len)
        k = len(longest)
        if self.merge(SPACE * (2 * k), self.run_score) != [longest] * 2:
            return self.unit_ids(self.merge(SPACE * n, self.run_score))
        return [self.ids[longest]] * (n // k) + (self._short_run(n % k) if n % k else [])

    def word(self, rest: str) -> bytes:
        """The ids of a space mark and `rest`, as packed int32."""
        if self.breaks and "\n" in rest:  # lines are apart: nothing merges with a line break
            first, *others = rest.split("\n")
            return self.line_break.join([self.lookup(first), *[self.lookup(x, "") for x in others]])
        return array("i", self.unit_ids(self.units_of(SPACE + rest))).tobytes()

    def lookup(self, rest: str, mark: str = SPACE) -> bytes:
        memo = self.memo if mark else self.bare
        found = memo.get(rest)
        if found is None:
            found = self.word(rest) if mark else array("i", self.unit_ids(self.units_of(rest))).tobytes()
            if len(rest) <= MEMO_CHARS and not (mark and self.breaks and "\n" in rest):
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                memo[rest] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        rests = text.replace(" ", SPACE).split(SPACE)
        packed = list(map(self.memo.get, rests))
        if None in packed:
            packed = [self.lookup(r) if p is None else p for r, p in zip(rests, packed)]
        ids = np.frombuffer(b"".join(packed), np.int32)
        lone = ids == self.ids[SPACE]
        return self._with_runs(ids, lone) if self.run_score and (lone[1:] & lone[:-1]).any() else ids

    def _with_runs(self, ids: np.ndarray, lone: np.ndarray) -> np.ndarray:
        """Space marks that stand alone side by side, brought together into runs."""
        edges = np.flatnonzero(np.diff(np.concatenate([[False], lone, [False]]).astype(np.int8)))
        out, at = [], 0
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            out += [ids[at:start], np.array(self.run_ids(end - start), np.int32)]
            at = end
        return np.concatenate([*out, ids[at:]])

    def decode(self, ids: Iterable[int], strip: bool = True) -> str:
        """The text of ids; the space in front of the first word is left out with `strip`."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        pieces = list(map(self.shown.get, ids))
        if None not in pieces:
            text = "".join(pieces)
            return text[1:] if strip and text.startswith(" ") else text
        out, held, first = [], bytearray(), True
        for i in ids:
            value = self.byte_of.get(i)
            if value is not None:
                held.append(value)
                first = False
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            piece = self.text.get(i, "")
            if first and strip and piece.startswith(SPACE):
                piece = piece[1:]
            first = False
            out.append(piece.replace(SPACE, " "))
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)


@lru_cache(maxsize=2)
def load(model_file: str) -> PieceBPE:
    return PieceBPE(model_file)


def encode_texts(docs: DataFrame, model_file: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with a column `ids` (array<int>); the general form."""
    path = model_file or default_model()

    @F.pandas_udf("array<int>")
    def encode(texts):  # noqa: ANN001, ANN202
        bpe = load(path)
        return texts.map(lambda t: bpe.encode(t or "").tolist())

    return docs.withColumn("ids", encode(F.col(text_col)))


def decode_ids(docs: DataFrame, model_file: str | None = None, ids_col: str = "ids") -> DataFrame:
    """docs with a column `decoded`, the text of `ids`."""
    path = model_file or default_model()

    @F.pandas_udf("string")
    def decode(ids):  # noqa: ANN001, ANN202
        bpe = load(path)
        return ids.map(lambda x: bpe.decode(map(int, x)) if x is not None else "")

    return docs.withColumn("decoded", decode(F.col(ids_col)))


def round_trip_digests(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to, for each row of docs."""
    path = model_file or default_model()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        number = bpe.number
        for batch in sliced(batches, ROWS, 1):
            n_tokens, ids_hex, text_hex = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "").tolist()
                n_tokens.append(len(ids))
                ids_hex.append(hashlib.sha256(",".join([number[i] for i in ids]).encode()).hexdigest())
                text_hex.append(hashlib.sha256(bpe.decode(ids).encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
