"""Word arrays, and a scan that looks up each word of a table in a small table of anchors.

The scan keeps the whole pass inside one stage: split, posexplode, broadcast hash join.
A marker in front of each row's words matches a marker among the anchors, so every row
comes out at least once and carries its word count; no second pass joins the counts back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import numbered

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; plain ASCII texts take the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER)
    )


def word_array(text: Column) -> Column:
    """Runs of digits, lower-case letters and characters beyond ASCII; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def slice_text(words: Column, start: Column, length: Column) -> Column:
    """`length` words from word `start` (from 0), joined by spaces; fewer at the end."""
    return F.array_join(F.slice(words, (start + 1).cast("int"), length.cast("int")), " ")


def scan(docs: DataFrame, anchors: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each word that is an anchor, and one marker row for each row of docs.

    anchors: a table that the caller knows to be small, of `anchor` (string) and columns of its own. Result: _row, id, n_words, words,
    at (the word's place from 0; null in marker rows) and the anchors' own columns.
    """
    marker = anchors.sparkSession.range(1).select(F.lit("").alias("anchor")).join(anchors.limit(0), "anchor", "left")
    table = anchors.unionByName(marker.select(*anchors.columns))
    rows = numbered(docs, F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    rows = rows.select("_row", "id", word_array(F.col("_text")).alias("words"))
    rows = rows.select(
        "_row", "id", "words", F.size("words").cast("long").alias("n_words"),
        F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("_pos", "_word"),
    )
    return rows.join(F.broadcast(table), F.col("_word") == F.col("anchor")).select(
        "_row", "id", "n_words", "words",
        F.when(F.col("_pos") > 0, F.col("_pos") - 1).cast("long").alias("at"),
        *[c for c in anchors.columns if c != "anchor"],
    )
