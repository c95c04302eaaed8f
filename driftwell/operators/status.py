"""Status: sections of all databases put together, health, and one-line renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import kv_quote, stream_name

# The sections of a status record, and the words for its health and level below.
SECTIONS = ["subscription", "slots", "lag", "tables", "sequences", "drift"]


def merge_status(databases: DataFrame, prefix: str, subscriptions: DataFrame, slots: DataFrame, lag: DataFrame) -> DataFrame:
    """database with arrays of its subscription, slot and lag rows, matched by the derived stream name."""
    out = databases.withColumn("_name", stream_name(prefix, F.col("database")))
    for section, rows, key in (("subscription", subscriptions, "subname"), ("slots", slots, "slot_name"), ("lag", lag, "application_name")):
        grouped = rows.groupBy(F.col(key).alias("_name")).agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(section))
        out = out.join(grouped, "_name", "left").withColumn(section, F.coalesce(section, F.array().cast(grouped.schema[section].dataType)))
    return out.drop("_name")


def health(error: Column, n_subscriptions: Column, n_slots: Column, n_active: Column, mismatches: Column, lag_text: Column) -> Column:
    """The first that holds: error, no replication, slot inactive, warning, ok."""
    behind = ~F.coalesce(lag_text, F.lit("")).isin("", "0 bytes")
    return (
        F.when(error, "error").when((n_slots == 0) | (n_subscriptions == 0), "no replication").when(n_active == 0, "slot inactive")
        .when((mismatches > 0) | behind, "warning").otherwise("ok")
    )


def level(health_text: Column) -> Column:
    return F.when(health_text == "error", "err").when(health_text == "ok", "ok").otherwise("warn")


def line(database: Column, section: str, **values: Column) -> Column:
    """`db=… section=… key=value …`; values are rendered by the caller."""
    parts = [F.concat(F.lit("db="), kv_quote(database)), F.lit(f"section={section}")]
    parts += [F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("None"))) for k, v in values.items()]
    return F.concat_ws(" ", *parts)


def _lines(rows: DataFrame, section: str, **names: str) -> DataFrame:
    """database and a line of the named columns (key=column), values quoted where they must be."""
    return rows.select("database", line(F.col("database"), section, **{k: kv_quote(F.col(c).cast("string")) for k, c in names.items()}).alias("line"))


def subscription_lines(rows: DataFrame) -> DataFrame:
    """The apply workers: those of single tables last."""
    return _lines(rows.orderBy("database", F.col("relid").isNull().desc(), "subname"), "subscription", name="subname", pid="pid", received_lsn="received_lsn", latest_end_lsn="latest_end_lsn", lag="lag")


def slot_lines(rows: DataFrame) -> DataFrame:
    return _lines(rows, "slot", name="slot_name", type="slot_type", active="active", restart_lsn="restart_lsn", confirmed_flush_lsn="confirmed_flush_lsn", wal_status="wal_status")


def lag_lines(rows: DataFrame) -> DataFrame:
    return _lines(rows, "lag", app="application_name", state="state", sent_lsn="sent_lsn", replay_lsn="replay_lsn", write_lag="write_lag", replay_lag="replay_lag")


def collect_sections(databases: DataFrame, sections: dict[str, DataFrame | Exception]) -> DataFrame:
    """database, an array of rows for each section, errors (section → what went wrong).

    A section that could not be read is an Exception: it's empty for every database and named in `errors`.
    """
    out, errors = databases, []
    for name in SECTIONS:
        rows = sections.get(name)
        if rows is None or isinstance(rows, Exception):
            out = out.withColumn(name, F.array().cast("array<string>"))
            if rows is not None:
                errors += [F.lit(name), F.lit(f"{type(rows).__name__}: {rows}")]
            continue
        columns = [c for c in rows.columns if c != "database"]
        grouped = rows.groupBy("database").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(grouped, "database", "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return out.withColumn("errors", F.create_map(*errors) if errors else F.create_map().cast("map<string,string>"))


def render(status: DataFrame, sections: list[str] | None = None) -> DataFrame:
    """database, json of the chosen sections and of the errors."""
    chosen = [s for s in SECTIONS if sections is None or s in sections]
    return status.select("database", F.to_json(F.struct("database", *chosen, "errors")).alias("json"))


def totals(results: DataFrame) -> DataFrame:
    """rows, tables and failed tables of copies: key, rows (-1: failed)."""
    failed = F.col("rows") < 0
    return results.agg(
        F.coalesce(F.sum(F.when(~failed, F.col("rows"))), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_tables"),
        F.count(F.when(failed, 1)).alias("n_failed"),
    ).withColumn("n_rows_text", F.format_number("n_rows", 0))


def updated_count(report: DataFrame) -> DataFrame:
    """How many sequences a report of `sequences.reconcile` brought forward, and how many need attention."""
    return report.agg(F.count(F.when(F.col("status") == "updated", 1)).alias("n_updated"), F.count(F.when(F.col("status") == "target_ahead", 1)).alias("n_ahead"))


def table_lines(rows: DataFrame) -> DataFrame:
    """database, schema, source, target → line."""
    return rows.select(
        line(F.col("database"), "table", schema=F.col("schema"), source=F.col("source"), target=F.col("target"),
             match=F.when(F.col("source") == F.col("target"), "true").otherwise("false")).alias("line")
    )


def sequence_lines(rows: DataFrame) -> DataFrame:
    return rows.select(
        line(F.col("database"), "sequence", schema=F.col("schema"), sequence=F.col("sequence"), source=F.col("source_value"),
             target=F.col("target_value"), status=F.col("status")).alias("line")
    )


def drift_lines(rows: DataFrame) -> DataFrame:
    return rows.select(
        line(F.col("database"), "drift", type=kv_quote(F.col("object_type")), schema=F.col("schema"), table=F.col("table"),
             name=kv_quote(F.col("name")), drift=F.col("drift_type"), detail=kv_quote(F.col("detail"))).alias("line")
    )
