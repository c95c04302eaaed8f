"""Integrity: foreign keys, uniqueness and label sets, as checks over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def foreign_key_violations(child: DataFrame, parent: DataFrame, child_keys: list[str], parent_keys: list[str]) -> DataFrame:
    """Rows of child whose (non-null) key has no parent."""
    refs = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_keys)])
    on = [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(child_keys)]
    return child.dropna(subset=child_keys).join(refs, on, "left_anti")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def outside_labels(rows: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """Rows whose value is not one of an enum's labels."""
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(labels))
