"""Reading tables, and the folder that tasks and driver share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in spark.checkpoint.dir; in a temporary folder only with a local master that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        app = spark.sparkContext.applicationId
        base = _LOCAL.setdefault(app, "") or tempfile.mkdtemp(prefix="spark-")
        _LOCAL[app] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
