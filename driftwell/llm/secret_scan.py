"""Secret scans: patterns, and a token-efficiency test for random strings.

Base kinds (assign, access, hex) are patterns. The method adds `random`: a run of key
characters that mixes digits and letters and costs many tokens for its length under a
tiktoken vocabulary, since a vocabulary has short pieces only for what no text contains.
Known digests and identifiers are excluded before the test. Texts are read in Arrow
batches; nothing is shuffled, and each row of the input gives one row.

Defined results: null counts as empty; spans are code points, the end is exclusive;
repeated rows are scanned apart; columns besides id and text are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .workspace import sliced

KINDS = ["assign", "access", "hex", "random"]

# Fixed patterns of the base kinds, and the least length of what they must hold.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: The efficiency test: least length of a run, and characters per token below which it is random.
RUN_LEAST, RATIO = 20, 2.2
#: Rows that a task scans at once.
ROWS = 512

_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % RUN_LEAST)
_KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"  # digests
    r"|(?:sha256|sha512|sha1|md5)[-=_][A-Za-z0-9+/=]+"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUIDs
    r"|[0-9/_=+-]+"  # numbers, dates
    r"|[A-Za-z]+[0-9]{1,4}"  # names with a number
    r"|[A-Za-z]*(?:[_/=-]++[A-Za-z]*[0-9]{0,4})+)"  # words joined by marks; a run of marks is never split
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):  # noqa: ANN201
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def characters_per_token(run: str, tokenizer) -> float:  # noqa: ANN001
    return len(run) / len(tokenizer.encode_ordinary(run))


def is_random(run: str, tokenizer, ratio: float = RATIO) -> bool:  # noqa: ANN001
    body = run.strip("=-_/+")
    if len(body) < RUN_LEAST or not re.search(r"\d", body) or not re.search(r"[A-Za-z]", body) or _KNOWN.fullmatch(body):
        return False
    return characters_per_token(body, tokenizer) < ratio


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base kinds, in order."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, tokenizer, ratio: float = RATIO) -> list[tuple[int, int, int]]:  # noqa: ANN001
    return [(m.start(), 3, m.end()) for m in _RUN.finditer(text) if is_random(m[0], tokenizer, ratio)]


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for each row of docs."""
    path = vocabulary or default_vocabulary()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(path)
        for batch in sliced(batches, ROWS, 1):
            counts, digests, all_spans = [[], [], [], []], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + random_spans(text, tokenizer, ratio))
                for kind, column in enumerate(counts):
                    column.append(sum(s[1] == kind for s in spans))
                digests.append(hashlib.sha256(shown(base).encode()).hexdigest())
                all_spans.append(shown(spans))
            n = [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *n[:3], pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), n[3]],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scan,
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long",
    )


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
