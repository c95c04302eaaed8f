"""New tables into a stream that runs: what is captured and not tracked yet is tracked, copied at a position, and caught up."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..streaming.replica import Replica
from .reinit import new_tables

log = logging.getLogger(__name__)

#: Of a table (schema.name) its columns and key, and its rows with the position at which they were read.
Describe = Callable[[str], tuple[StructType, list[str]]]
Snapshot = Callable[[str], tuple[DataFrame, int]]


def hand_over_new(replica: Replica, captured: DataFrame, without_key: DataFrame, describe: Describe, snapshot: Snapshot) -> dict[str, str]:
    """The state of each table that was new, or whose copy an earlier run didn't finish; a table that fails stops no other.

    captured, without_key: schema_name, table_name. Tables without a key (`relations.tables_without_key`)
    are applied by full rows, whatever `describe` says of them; the others by their keys.
    """
    spark, key = replica.spark, ["schema_name", "table_name"]
    tracked = replica.tracked.names()
    done = spark.createDataFrame([tuple(t.split(".", 1)) for t in tracked if replica.state(t) != "copying"], "schema_name string, table_name string")
    due = new_tables(captured.select(*key).distinct(), done).join(without_key.select(*key).distinct().withColumn("keyless", F.lit(True)), key, "left")
    states = {}
    for r in due.orderBy(*key).toLocalIterator():  # a row for each table
        name = f"{r['schema_name']}.{r['table_name']}"
        try:
            schema, keys = describe(name)
            states[name] = replica.hand_over(name, schema, [] if r["keyless"] else keys, lambda name=name: snapshot(name))
        except Exception as e:
            log.exception("%s was not handed over", name)
            states[name] = f"failed: {type(e).__name__}: {e}"
    return states
