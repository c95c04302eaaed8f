"""What to do for streams that are not whole: a decision for each database."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

LOST_WINDOW = "DATA-LOSS WINDOW: changes since the lost position are not in the stream"


def decide(state: DataFrame) -> DataFrame:
    """database, issues_found, actions_taken, was_healthy.

    state: database, has_publication, slot_status (null if there is none), has_subscription,
    is_enabled, worker_running. A slot is whole if it is there and not `lost`.
    """
    slot_ok = F.coalesce(F.col("slot_status") != "lost", F.lit(False))
    sub, enabled, running = F.col("has_subscription"), F.col("is_enabled"), F.col("worker_running")
    text = lambda condition, value: F.when(condition, F.lit(value))
    issues = F.array_compact(F.array(
        text(~F.col("has_publication"), "publication not found on source"),
        text(F.col("slot_status").isNull(), "replication slot not found"),
        text(F.col("slot_status") == "lost", "replication slot is lost"),
        text(slot_ok & ~sub, "subscription not found on target"),
        text(slot_ok & sub & ~enabled, "subscription exists but is disabled"),
        text(slot_ok & sub & enabled & ~running, "apply worker is not running"),
        text(~slot_ok & sub, "subscription has no usable slot"),
        text(~slot_ok & ~sub, "subscription not found on target"),
        text(~slot_ok, LOST_WINDOW),
    ))
    actions = F.array_compact(F.array(
        text(~F.col("has_publication"), "recreate publication"),
        text(slot_ok & ~sub, "recreate subscription on the surviving slot"),
        text(slot_ok & sub & ~enabled, "enable subscription"),
        text(slot_ok & sub & enabled & ~running, "refresh subscription without copy"),
        text(~slot_ok & sub, "drop subscription"),
        text(F.col("slot_status") == "lost", "drop slot"),
        text(~slot_ok, "recreate subscription with a fresh slot"),
    ))
    return state.select("database", issues.alias("issues_found"), actions.alias("actions_taken"), (F.size(issues) == 0).alias("was_healthy"))


def new_tables(captured: DataFrame, tracked: DataFrame) -> DataFrame:
    """Captured tables that the stream does not track yet."""
    return captured.join(tracked, captured.columns, "left_anti")


def act(decided: DataFrame, handlers: dict[str, Callable[[str], object]]) -> dict[str, list[str]]:
    """Take the actions of each database in their order; what was done, by database.

    handlers: what each action does with a database. After a failure a database's later
    actions are left out, and the other databases go on.
    """
    done: dict[str, list[str]] = {}
    for r in decided.where(F.size("actions_taken") > 0).orderBy("database").toLocalIterator():
        done[r["database"]] = []
        for action in r["actions_taken"]:
            try:
                handlers[action](r["database"])
            except Exception:
                log.exception("%s: %s failed", r["database"], action)
                break
            done[r["database"]].append(action)
    return done
