"""Whether two definitions of a view mean the same: their analysed plans are compared, not their texts.

Names of table aliases, quoting, white space and the order of conditions don't count; output columns' names
and types do. Definitions that Spark can't analyse are compared as normalised text.
"""

from __future__ import annotations

import logging
import re
from collections import Counter

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalize_ws

log = logging.getLogger(__name__)
#: Spark's names for types that a catalog calls otherwise (fixed values; others are tried as they are).
TYPES = {
    "integer": "int", "bigint": "bigint", "smallint": "smallint", "text": "string", "character varying": "string", "uuid": "string", "boolean": "boolean",
    "real": "float", "double precision": "double", "numeric": "decimal(38,10)", "date": "date", "timestamp without time zone": "timestamp_ntz",
    "timestamp with time zone": "timestamp", "bytea": "binary",
}


def spark_type(named: str) -> str:
    """varchar(10), numeric(15,2), integer[] and the rest as Spark writes them."""
    named = named.strip().lower()
    if named.endswith("[]"):
        return f"array<{spark_type(named[:-2])}>"
    if m := re.fullmatch(r"numeric\((\d+),(\d+)\)", named):
        return f"decimal({m[1]},{m[2]})"
    return TYPES.get(re.sub(r"\(.*\)", "", named).strip(), named)


class ViewMeanings:
    """Analyses definitions over relations, which are views without rows in a session of their own."""

    def __init__(self, spark: SparkSession, columns: dict[tuple[str, str], list[tuple[str, str]]]):
        """columns: of each relation (schema, name), its columns' names and types as the catalog has them."""
        self.session = spark.newSession()
        self.session.conf.set("spark.sql.ansi.enabled", "true")
        self.session.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
        self.names: dict[str, str] = {}
        often = Counter(name for _, name in columns)
        for k, ((schema, name), of) in enumerate(sorted(columns.items())):
            # Its own name, by which columns may call it; a name of several schemas has the schema before it.
            view = "`" + (name if often[name] == 1 else f"{schema}.{name}").replace("`", "``") + "`"
            # Each has a leaf of its own: relations with the same columns are still different ones.
            rows = self.session.range(k, k + 1).select(*[F.lit(None).cast(spark_type(kind)).alias(c) for c, kind in of])
            rows.createOrReplaceTempView(view)  # a name in quotes, as SQL has it
            self.names[f"{schema}.{name}"] = view
            self.names.setdefault(name, view)

    def _plain(self, text: str) -> str:
        """The text with the views' names for the relations that stand where a relation can stand."""

        def name(m: re.Match) -> str:
            asked = m[2].replace('"', "")
            return m[1] + self.names.get(asked, m[2])

        text = re.sub(r"(?i)::\s*(character varying|double precision|timestamp with(?:out)? time zone|\w+)(\([\d, ]+\))?", lambda m: f"::{spark_type(m[0][2:])}", text)
        return re.sub(r"(?i)\b((?:from|join)\s+\(*\s*|,\s*)((?:\"[^\"]+\"|\w+)(?:\.(?:\"[^\"]+\"|\w+))?)(?=[\s,);]|$)", name, text).strip().rstrip(";")

    def analysed(self, text: str) -> DataFrame | None:
        try:
            return self.session.sql(self._plain(text))
        except PySparkException as e:
            log.info("compared as text: %s", str(e).split("\n", 1)[0])
            return None

    def same(self, a: str, b: str) -> bool:
        if _spaced(a) == _spaced(b):
            return True
        x, y = self.analysed(a), self.analysed(b)
        return x is not None and y is not None and x.schema == y.schema and x.sameSemantics(y)


def _spaced(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


#: A whole number that a comparison's right side begins with. It is no place, length, precision or limit, so which
#: number it is doesn't change what the rest means; how many digits it has can (a decimal's precision follows).
COMPARED = r"(?<=[<>=]\s{0,8})(?:0|[1-9]\d{0,8})(?![\w.])"
#: Where a comparison sign may stand inside quotes, or a comment hides one, texts are taken as they are.
HIDDEN = r"""'[^']*[<>=][^']*'|"[^"]*[<>=][^"]*"|`|--|/\*|\$"""


def _shape(source: Column, target: Column) -> Column:
    """Of two definitions all but their compared numbers; of these, which are equal to each other and their digits.

    A number that stands elsewhere in either, too, is named as it is: it may be equal to that.
    """
    numbers = [F.regexp_extract_all(x, F.lit(COMPARED), F.lit(0)) for x in (source, target)]
    left = [F.regexp_replace(x, COMPARED, "?") for x in (source, target)]
    known = F.array_distinct(F.concat(*numbers))
    others = F.transform(F.regexp_extract_all(F.concat_ws(" ", *left), F.lit(r"\d+"), F.lit(0)), lambda x: F.regexp_replace(x, r"^0+(?=\d)", ""))
    place = lambda x: F.when(F.array_contains(others, x), F.concat(F.lit("="), x)).otherwise(F.concat_ws(":", F.array_position(known, x).cast("string"), F.length(x).cast("string")))
    places = [F.transform(n, place) for n in numbers]
    shape = F.struct(left[0].alias("source"), places[0].alias("s"), left[1].alias("target"), places[1].alias("t"))
    none = F.array().cast("array<string>")
    whole = F.struct(source.alias("source"), none.alias("s"), target.alias("target"), none.alias("t"))
    return F.when(source.rlike(HIDDEN) | target.rlike(HIDDEN) | source.contains("?") | target.contains("?"), whole).otherwise(shape)


def same_views(pairs: DataFrame, keys: list[str], meanings: ViewMeanings) -> DataFrame:
    """The keys of pairs (keys, source_def, target_def) whose definitions mean the same.

    Pairs with equal text are settled by Spark. Of the others those of one shape mean the same or not together, so one
    pair of each shape is analysed, whatever the number of views.
    """
    equal = normalize_ws(F.col("source_def")).eqNullSafe(normalize_ws(F.col("target_def")))
    a, b = (F.coalesce(c, F.lit("")) for c in ("source_def", "target_def"))
    shaped = pairs.where(~equal).select(*keys, F.struct(a.alias("a"), b.alias("b")).alias("_pair"), F.to_json(_shape(a, b)).alias("_shape"))
    one = shaped.groupBy("_shape").agg(F.min("_pair").alias("one"))
    found = [(r["_shape"],) for r in one.toLocalIterator() if meanings.same(r["one"]["a"], r["one"]["b"])]
    alike = shaped.join(pairs.sparkSession.createDataFrame(found, "_shape string"), "_shape", "left_semi")
    return pairs.where(equal).select(*keys).unionByName(alike.select(*keys))
