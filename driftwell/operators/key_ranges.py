"""Chunks of about equal rows: ranges of a key whose bounds are quantiles of a sample.

The key may be several columns of any orderable type. The first range has no lower and the last no
upper bound, so rows that came after the sample was taken fall into a range, too. Bounds are never
null; nulls come first, as Spark orders them.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.jdbc import Endpoint
from .ordering import with_places

#: Rows of the sample for each range: a range's share is then within a tenth of the mean.
SAMPLED_EACH = 2000


@dataclass(frozen=True)
class KeyRange:
    """Rows from `low` on and before `high`, tuples of the key's values; None has no bound."""

    keys: tuple[str, ...]
    low: tuple | None
    high: tuple | None

    def column(self) -> Column:
        """The range as a condition; single comparisons reach the scan as pushed filters."""
        out = F.lit(True)
        if self.low is not None:
            out = out & _from(self.keys, self.low)
        if self.high is not None:
            out = out & _before(self.keys, self.high)
        return out

    def sql(self) -> str:
        """The same condition as standard SQL, for a database that reads the range itself."""
        parts = [f(self.keys, bound) for f, bound in ((_sql_from, self.low), (_sql_before, self.high)) if bound is not None]
        return " AND ".join(parts) or "1 = 1"


def _from(keys: tuple[str, ...], bound: tuple) -> Column:
    key, value = F.col(keys[0]), F.lit(bound[0])
    if len(keys) == 1:
        return key >= value
    return (key >= value) & ((key > value) | _from(keys[1:], bound[1:]))


def _before(keys: tuple[str, ...], bound: tuple) -> Column:
    key, value = F.col(keys[0]), F.lit(bound[0])
    less = (key < value) | key.isNull()
    return less if len(keys) == 1 else less | ((key == value) & _before(keys[1:], bound[1:]))


def _name(key: str) -> str:
    return '"' + key.replace('"', '""') + '"'


def _value(value) -> str:  # noqa: ANN001
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    return "'" + str(value).replace("'", "''") + "'"


def _sql_from(keys: tuple[str, ...], bound: tuple) -> str:
    key, value = _name(keys[0]), _value(bound[0])
    if len(keys) == 1:
        return f"{key} >= {value}"
    return f"({key} > {value} OR ({key} = {value} AND {_sql_from(keys[1:], bound[1:])}))"


def _sql_before(keys: tuple[str, ...], bound: tuple) -> str:
    key, value = _name(keys[0]), _value(bound[0])
    less = f"{key} < {value} OR {key} IS NULL"
    return f"({less})" if len(keys) == 1 else f"({less} OR ({key} = {value} AND {_sql_before(keys[1:], bound[1:])}))"


def key_ranges(rows: DataFrame, keys: list[str], chunks: int, n: int | None = None) -> list[KeyRange]:
    """At most `chunks` ranges of about equal rows. n: the rows there are, if known (a table's count is metadata).

    The sample is sorted by Spark; only the bounds come to the driver. A key that holds more rows
    than a chunk should is a range's lower bound and stays whole: choose a key that tells rows apart.
    """
    n = rows.count() if n is None else n
    share = min(1.0, chunks * SAMPLED_EACH / max(n, 1))
    present = rows.select(*keys).dropna()
    sample = present if share == 1.0 else present.sample(share, seed=1)
    placed = with_places(sample, *keys)
    step = max(placed.count() / chunks, 1.0)
    at = F.floor((F.col("place") - 1) / step)
    bounds = placed.withColumn("_k", at).where((F.col("_k") > 0) & (F.col("_k") > F.floor((F.col("place") - 2) / step)))
    found = [tuple(r[k] for k in keys) for r in bounds.select(*keys).distinct().orderBy(*keys).collect()]  # chunks - 1 at most
    edges = [None, *found, None]
    return [KeyRange(tuple(keys), low, high) for low, high in zip(edges, edges[1:])]


def with_range(rows: DataFrame, ranges: list[KeyRange], name: str = "chunk_no") -> DataFrame:
    """rows with the number of their range: how many lower bounds they have reached."""
    reached = [F.coalesce(_from(r.keys, r.low), F.lit(False)).cast("int") for r in ranges if r.low is not None]
    return rows.withColumn(name, sum(reached, F.lit(0)))


def read_key_ranges(spark: SparkSession, endpoint: Endpoint, table: str, ranges: list[KeyRange]) -> DataFrame:
    """A table of a database, a partition for each range."""
    options = endpoint.options()
    properties = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], table, predicates=[r.sql() for r in ranges], properties=properties)


def file_groups(spark: SparkSession, path: str, chunks: int) -> list[list[str]]:
    """The data files of a table in groups of about equal bytes: a table of files is cut by its files, as no key tells where its rows are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    groups: list[list] = [[0, []] for _ in range(max(1, chunks))]
    for r in files.orderBy(F.desc("length"), "path").toLocalIterator():
        least = min(groups, key=lambda g: g[0])
        least[0] += r["length"]
        least[1].append(r["path"])
    return [g[1] for g in groups if g[1]]
