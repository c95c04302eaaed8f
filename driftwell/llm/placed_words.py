"""Words of a batch of texts by their bytes, all texts at once: where they stand, and what they are."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a byte is: part of a word, a separator of words, or a separator that phrases don't cross.
WORD, SPACE, BREAK = 0, 1, 2


def byte_kinds(spaces: bytes, breaks: bytes = b"") -> np.ndarray:
    kinds = np.full(256, WORD, np.uint8)
    kinds[list(spaces)] = SPACE
    kinds[list(breaks)] = BREAK
    return kinds


#: Words end at `[\x20\x09-\x0D]`.
WHITE_SPACE = byte_kinds(b" \t\n\v\f\r")


@dataclass
class PlacedWords:
    """ids: each word as a number of `distinct` (binary); text i has the words first[i] to first[i + 1]; piece: grows at each break."""

    first: np.ndarray
    ids: np.ndarray
    distinct: pa.Array
    piece: np.ndarray | None


def placed_words(texts: pa.Array, kinds: np.ndarray, lower: bool = False) -> PlacedWords:
    """The words of string or binary texts; null has none. `lower`: A-Z count as a-z."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0] : offsets[-1]]
    edges = offsets - offsets[0]
    kind = kinds[data]
    inside = kind == WORD
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = edges[(edges > 0) & (edges < len(data))]  # a word never goes on into the next text
    begins[cut], ends[cut - 1] = inside[cut], inside[cut - 1]
    start = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - start
    letters = data[inside]
    if lower:
        letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters).astype(np.uint8)
    places = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(letters)])
    encoded = words.dictionary_encode()
    piece = np.cumsum(kind == BREAK, dtype=np.int32)[start].astype(np.int64) if (kinds == BREAK).any() else None
    return PlacedWords(np.searchsorted(start, edges), encoded.indices.to_numpy(), encoded.dictionary, piece)
