"""A target whose columns and labels change while its files stay: structure drift carried out on data.

Each version of the structure is a mark: columns, the defaults that older rows have in columns that came
later, and the labels of enum columns. Files are written under the version of their time and never
rewritten; reading brings them to the newest version (or to an older one) by adding and widening
columns, which Spark does within the scan. Structures only grow: what would lose values is refused.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..operators.integrity import outside_labels
from ..sources.marks import Marks

#: Types that a type may become without losing a value.
WIDER = {
    "tinyint": ("smallint", "int", "bigint"), "smallint": ("int", "bigint"), "int": ("bigint", "double"), "float": ("double",), "date": ("timestamp", "timestamp_ntz"),
}


class Narrower(ValueError):
    """The change would lose values that are there or could be there."""


def widens(old: DataType, new: DataType) -> bool:
    a, b = old.simpleString(), new.simpleString()
    if a == b or b in WIDER.get(a, ()) or b == "string":
        return True
    if a.startswith("decimal") and b.startswith("decimal"):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    return False


class EvolvingTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions, self.files = Marks(spark, f"{self.path}/versions"), Marks(spark, f"{self.path}/files")

    # ---- structure

    def version(self) -> int:
        names = self.versions.names("v")
        return int(names[-1][1:]) if names else 0

    def _at(self, version: int) -> dict:
        return self.versions.get(f"v{version:06d}")

    def schema(self, version: int | None = None) -> StructType:
        return StructType.fromJson(json.loads(self._at(version or self.version())["schema"]))

    def labels(self, version: int | None = None) -> dict[str, list[str]]:
        return self._at(version or self.version())["labels"]

    def _put(self, before: int, schema: StructType, defaults: dict[str, str], labels: dict[str, list[str]]) -> int:
        if not self.versions.put(f"v{before + 1:06d}", {"schema": schema.json(), "defaults": defaults, "labels": labels}):
            raise RuntimeError(f"version {before + 1} was made meanwhile")
        return before + 1

    def create(self, schema: StructType, labels: dict[str, list[str]] | None = None) -> int:
        if self.version():
            raise ValueError("the table is there")
        return self._put(0, schema, {}, labels or {})

    def add_column(self, name: str, kind: str, default: str | None = None) -> int:
        """A column that older rows have with `default`, a constant SQL expression (null without one)."""
        at = self.version()
        now = self._at(at)
        if name in self.schema().fieldNames():
            raise ValueError(f"{name} is there")
        schema = StructType([*self.schema().fields, StructField(name, DataType.fromDDL(kind))])
        return self._put(at, schema, now["defaults"] | ({} if default is None else {name: default}), now["labels"])

    def widen(self, name: str, kind: str) -> int:
        at, new = self.version(), DataType.fromDDL(kind)
        now, schema = self._at(at), self.schema()
        if not widens(schema[name].dataType, new):
            raise Narrower(f"{name}: {schema[name].dataType.simpleString()} to {kind}")
        return self._put(at, StructType([StructField(f.name, new if f.name == name else f.dataType) for f in schema.fields]), now["defaults"], now["labels"])

    def grow_labels(self, column: str, labels: list[str]) -> int:
        """The labels of a column in their order; those that were there stay, in the order they had."""
        at = self.version()
        now = self._at(at)
        old = now["labels"].get(column, [])
        if [x for x in labels if x in old] != old:
            raise Narrower(f"{column}: {old} to {labels}")
        return self._put(at, self.schema(), now["defaults"], now["labels"] | {column: labels})

    def evolve(self, columns: DataFrame, labels: dict[str, list[str]] | None = None) -> list[str]:
        """Bring the structure up to a source's: column, kind, default (a row for each column, in the table's order). What was done.

        Columns that only this table has stay, with nulls in new rows.
        """
        done = []
        for r in columns.toLocalIterator():
            fields = {f.name: f.dataType for f in self.schema().fields}
            if r["column"] not in fields:
                self.add_column(r["column"], r["kind"], r["default"])
                done.append(f"add {r['column']} {r['kind']}")
            elif fields[r["column"]] != DataType.fromDDL(r["kind"]):
                self.widen(r["column"], r["kind"])
                done.append(f"widen {r['column']} to {r['kind']}")
        for column, of in (labels or {}).items():
            if self.labels().get(column) != of:
                self.grow_labels(column, of)
                done.append(f"labels of {column}")
        return done

    # ---- rows

    def append(self, rows: DataFrame) -> None:
        """Write rows under the newest version: their columns are all among the table's, with types that the table's can hold."""
        at = self.version()
        schema, labels = self.schema(at), self.labels(at)
        for f in rows.schema.fields:
            if f.name not in schema.fieldNames():
                raise ValueError(f"no column {f.name}")
            if not widens(f.dataType, schema[f.name].dataType):
                raise Narrower(f"{f.name}: {f.dataType.simpleString()} to {schema[f.name].dataType.simpleString()}")
        bad = [outside_labels(rows, c, of).select(F.lit(c).alias("column")).limit(1) for c, of in labels.items() if c in rows.columns]
        if bad and (found := reduce(DataFrame.unionByName, bad).first()) is not None:
            raise ValueError(f"{found['column']} has a value that is no label")
        folder = f"data/v{at:06d}-{uuid.uuid4().hex}"
        rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]).write.parquet(f"{self.path}/{folder}")
        self.files.put(folder.split("/")[1], {})

    def read(self, version: int | None = None) -> DataFrame:
        """All rows as of a version (the newest, if not named): those written under it and under older ones."""
        version = version or self.version()
        schema, defaults, parts = self.schema(version), self._at(version)["defaults"], []
        for at in range(1, version + 1):
            folders = [f"{self.path}/data/{n}" for n in self.files.names(f"v{at:06d}-")]
            if not folders:
                continue
            own = self.schema(at)

            def value(f: StructField, own: StructType = own) -> Column:
                if f.name in own.fieldNames():
                    return F.col(f.name)
                return F.expr(defaults[f.name]) if f.name in defaults else F.lit(None)

            parts.append(self.spark.read.schema(own).parquet(*folders).select(*[value(f).cast(f.dataType).alias(f.name) for f in schema.fields]))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)
