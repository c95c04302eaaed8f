"""Configuration of a move: two endpoints, what to move, and how much at once."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.names import stream_name
from .operators.bulk_copy import page_plan
from .operators.catalog import discover, discover_databases
from .sources.jdbc import Endpoint


@dataclass(frozen=True)
class Config:
    source: Endpoint
    target: Endpoint
    databases: list[str] = field(default_factory=list)
    schemas: list[str] = field(default_factory=list)
    exclude_databases: list[str] = field(default_factory=list)
    exclude_schemas: list[str] = field(default_factory=list)
    stream_prefix: str = "driftwell"
    tables_at_once: int = 4
    chunks_per_table: int = 4
    sequence_interval_s: int = 10

    def databases_of(self, found: DataFrame) -> DataFrame:
        """Of the databases found (datname, datistemplate) those to move: the listed ones, else all but the excluded."""
        return discover_databases(found, self.databases, self.exclude_databases)

    def schemas_of(self, names: DataFrame) -> DataFrame:
        """Of the schemas found (name) those to move."""
        return discover(names, self.schemas, self.exclude_schemas)

    def streams_of(self, databases: DataFrame) -> DataFrame:
        """datname with the name of its stream."""
        return databases.withColumn("stream", stream_name(self.stream_prefix, F.col("datname")))

    def plan_of(self, tables: DataFrame) -> DataFrame:
        """The chunks of tables (key, pages, bytes)."""
        return page_plan(tables, self.chunks_per_table)


def load_config(path: str = "config.yaml") -> Config:
    """Read a YAML file; a missing file is an error, unknown keys too."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text())
    known = {f.name for f in fields(Config)}
    if unknown := set(raw) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Config(**(raw | {side: Endpoint(**raw[side]) for side in ("source", "target")}))
