"""Identifiers, literals and derived names, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote_ident(x: Column) -> Column:
    """An identifier in double quotes; quotes in it are doubled (case is kept)."""
    return F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))


def qualified(schema: Column, name: Column) -> Column:
    return F.concat_ws(".", quote_ident(schema), quote_ident(name))


def quote_literal(x: Column) -> Column:
    """A text literal in single quotes; quotes in it are doubled."""
    return F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))


def safe_name(x: Column) -> Column:
    """Lower case with `_` for what is not a-z or 0-9; a changed name gets a hash of the original."""
    plain = F.regexp_replace(F.lower(x), "[^a-z0-9]", "_")
    return F.when(plain == x, plain).otherwise(F.concat_ws("_", plain, F.substring(F.sha1(x), 1, 6)))


def stream_name(prefix: str, database: Column) -> Column:
    """What a database's stream is called on either side."""
    return F.concat_ws("_", F.lit(prefix), safe_name(database))


def normalize_ws(x: Column) -> Column:
    """White space collapsed to single spaces, none at the ends; null is empty."""
    blanks = F.lit(" \t\n\x0b\f\r")
    return F.regexp_replace(F.btrim(F.coalesce(x, F.lit("")), blanks), r"[ \t\n\x0B\f\r]+", " ")


def kv_quote(x: Column) -> Column:
    """A value for `key=value` lines: quoted if empty or if it holds a space, tab, line break, quote or `=`."""
    escaped = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit('""')).when(x.rlike(r'[ \t\n"=]'), escaped).otherwise(x)


def lsn_to_number(lsn: Column) -> Column:
    """A log position `X/Y` (two hex halves) as decimal(20,0)."""
    half = lambda i: F.conv(F.split_part(lsn, F.lit("/"), F.lit(i)), 16, 10).cast("decimal(20,0)")
    return (half(1) * F.lit(4294967296).cast("decimal(20,0)") + half(2)).cast("decimal(20,0)")


def hms(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60)


def preview(text: Column, n: int = 120) -> Column:
    """The first characters of a statement, on one line."""
    return F.substring(F.translate(F.trim(text), "\n", " "), 1, n)


def size_text(n: Column) -> Column:
    """A byte count in the largest unit that leaves ten or more of it (rounded half up)."""
    out = F.concat_ws(" ", n.cast("bigint").cast("string"), F.lit("bytes"))
    for power, unit in enumerate(("kB", "MB", "GB", "TB"), 1):
        scale = 1024**power
        out = F.when(F.abs(n) >= 10 * 1024 * scale // 1024, F.concat_ws(" ", F.round(n / scale).cast("bigint").cast("string"), F.lit(unit))).otherwise(out)
    return out
