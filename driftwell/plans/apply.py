"""Running what the frames say: statements in their order, several attempts, periodic work.

Statements come from DataFrames and run one by one on the side that `execute` reaches (a
JDBC connection, or `spark.sql` where the target is Spark's own catalog); their number is
that of catalog objects, never of rows.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import definitions as D
from ..functions import statements as S
from ..functions.names import qualified
from ..operators import drift
from ..operators import relations as R
from ..operators.dependency import in_order
from ..operators.keyed_diff import DIFFERENT, MISSING_ON_SOURCE, MISSING_ON_TARGET, only_left

log = logging.getLogger(__name__)
Execute = Callable[[str], object]

#: Passes over statements that may need each other, and attempts (with doubling delays) for a busy object.
PASSES, ATTEMPTS, FIRST_DELAY_S = 3, 5, 2.0


def in_passes(statements: Iterable[str], execute: Execute, passes: int = PASSES) -> dict[str, str]:
    """Run all; those that fail are tried again after the rest. What failed in the last pass, with its reason."""
    left, failed = list(statements), {}
    for _ in range(passes):
        failed = {}
        for statement in left:
            try:
                execute(statement)
            except Exception as e:
                failed[statement] = f"{type(e).__name__}: {e}"
        if not failed:
            return {}
        left = list(failed)
    for statement, reason in failed.items():
        log.warning("gave up on %s: %s", statement, reason)
    return failed


def with_delays(work: Callable[[], object], attempts: int = ATTEMPTS, first: float = FIRST_DELAY_S, busy: type[Exception] = TimeoutError, sleep: Callable[[float], None] = time.sleep):  # noqa: ANN201
    """work(), again after `first` seconds, twice that, and so on while the object is busy; the last failure is raised."""
    for attempt in range(attempts):
        try:
            return work()
        except busy:
            if attempt == attempts - 1:
                raise
            sleep(first * 2**attempt)


def every(seconds: float, work: Callable[[], object], stop: Callable[[], bool], sleep: Callable[[float], None] = time.sleep) -> int:
    """work() every so many seconds until told to stop; a failure is logged and ends nothing. How often it ran."""
    runs = 0
    while not stop():
        try:
            work()
        except Exception:
            log.exception("periodic work failed")
        runs += 1
        sleep(seconds)
    return runs


# What is made before the copy and after it, in this order.
PRE_COPY = ["schemas", "collations", "enums", "composites", "domains", "ranges", "sequences", "functions", "tables", "late_functions", "aggregates"]
POST_COPY = ["foreign_keys", "functions", "views", "late_functions", "triggers", "row_security", "policies"]


def stage(name: str, s: R.System, enums: DataFrame | None = None, version: int = 17) -> DataFrame | None:
    """schema_name, name, statement of one stage, to run in the order of the first two; None if the side has none of it."""
    c = F.col

    def of(rows: DataFrame, named: str, statement) -> DataFrame:  # noqa: ANN001
        return rows.select("schema_name", c(named).alias("name"), statement.alias("statement")).where("statement is not null")

    if name == "schemas":
        names = s["pg_namespace"].select(c("nspname").alias("schema_name"))
        names = names if s.schemas is None else names.where(c("schema_name").isin(s.schemas))
        return of(names, "schema_name", F.concat(F.lit("CREATE SCHEMA IF NOT EXISTS "), S.quote_ident(c("schema_name"))))
    if name == "collations":
        rows = R.collations(s, version)
        return of(rows, "coll_name", D.collation(*[c(x) for x in ("schema_name", "coll_name", "provider", "provider_locale", "collcollate", "collctype", "deterministic")]))
    if name == "enums":
        return None if enums is None else of(enums, "type_name", S.enum_type(c("schema_name"), c("type_name"), c("labels")))
    if name == "composites":
        return of(R.composite_types(s), "type_name", D.composite_type(c("schema_name"), c("type_name"), c("attributes")))
    if name == "domains":
        checks = F.transform("checks", lambda k: F.concat(F.lit("CONSTRAINT "), S.quote_ident(k["name"]), F.lit(" "), k["def"]))
        return of(R.domains(s), "type_name", S.domain(c("schema_name"), c("type_name"), c("base_type"), c("default_expr"), c("not_null"), checks))
    if name == "ranges":
        pair = lambda p: (c(f"{p}_schema"), c(f"{p}_name"))
        return of(R.range_types(s), "type_name", D.range_type(c("schema_name"), c("type_name"), c("subtype"), pair("collation"), pair("canonical"), pair("diff")))
    if name == "sequences":  # those of identity columns come with their tables
        return of(R.sequence_definitions(s).where("not is_identity"), "sequence_name", S.sequence({x: c(x) for x in ("schema_name", "sequence_name", "increment", "min", "max", "start", "cache", "cycle")}))
    if name in ("functions", "late_functions"):
        return of(R.functions(s), "func_name", c("func_def"))
    if name == "tables":
        rows = drift.by_depth(s.relations("rp").select("oid", "schema_name", "table_name"), s["pg_inherits"].select(c("inhrelid").alias("oid"), c("inhparent").alias("parent")))
        rows = rows.join(drift.table_definitions(s), ["schema_name", "table_name"])
        return rows.select("schema_name", F.concat(F.lpad(c("part_depth").cast("string"), 3, "0"), F.lit(" "), c("table_name")).alias("name"), c("ddl").alias("statement"))
    if name == "aggregates":
        return of(R.aggregates(s).where("aggkind = 'n'"), "agg_name", D.aggregate())
    if name == "foreign_keys":
        rows = R.constraints(s).where("constraint_type = 'f'")
        return of(rows, "constraint_name", D.add_constraint(c("schema_name"), c("table_name"), c("constraint_name"), c("constraint_def")))
    if name == "views":
        return of(R.views(s), "view_name", D.view(c("schema_name"), c("view_name"), c("relkind"), c("view_def"), exists=True))
    if name == "triggers":
        state = S.trigger_state(c("schema_name"), c("table_name"), c("trigger_name"), c("enabled"))
        return of(R.triggers(s), "trigger_name", F.concat_ws("; ", c("trigger_def"), state))
    if name == "row_security":
        alter = lambda on, word: F.when(on, F.concat(F.lit("ALTER TABLE "), qualified(c("schema_name"), c("table_name")), F.lit(f" {word} ROW LEVEL SECURITY")))
        both = F.concat_ws("; ", alter(c("rowsecurity"), "ENABLE"), alter(c("force_rowsecurity"), "FORCE"))
        return of(R.row_security(s).where("rowsecurity or force_rowsecurity"), "table_name", both)
    if name == "policies":
        return of(R.policies(s), "policy_name", S.policy(*[c(x) for x in ("schema_name", "table_name", "policy_name", "polcmd", "permissive", "roles", "using_expr", "check_expr")]))
    raise ValueError(f"no stage {name}")


#: The stages whose objects may need each other, and what says so.
NEEDS = {"views": (R.view_needs, "view_name"), "composites": (R.type_needs, "type_name"), "domains": (R.type_needs, "type_name"), "ranges": (R.type_needs, "type_name")}


def by_level(name: str, rows: DataFrame, s: R.System) -> DataFrame:
    """rows of a stage with `level` and `cycle`: made by level, each finds what it needs. Objects on a cycle have no level."""
    needs, named = NEEDS[name]
    found = needs(s).withColumnsRenamed({named: "name", f"needs_{named}": "needs_name"})
    return in_order(rows, ["schema_name", "name"], found)


def run_stages(names: list[str], s: R.System, execute: Execute, enums: DataFrame | None = None, version: int = 17) -> dict[str, dict[str, str]]:
    """Run stages in their order; for each the statements that failed.

    Tables' order is by depth first. Views and types go by what they need, where the catalog tells, in one
    pass; those on a cycle are reported with its members and not run.
    """
    failures: dict[str, dict[str, str]] = {}
    for name in names:
        rows = stage(name, s, enums, version)
        if rows is None:
            continue
        order, passes, failed = ["name", "schema_name"] if name == "tables" else ["schema_name", "name"], PASSES, {}
        if name in NEEDS and "pg_rewrite" in s.tables:
            rows, order, passes = by_level(name, rows, s).persist(), ["level", *order], 1
            for r in rows.where("level is null").toLocalIterator():
                members = ", ".join(f"{m['schema_name']}.{m['name']}" for m in r["cycle"] or [])
                failed[r["statement"]] = f"on a cycle: {members}" if members else "needs what is on a cycle"
            rows = rows.where("level is not null")
        failed |= in_passes([r["statement"] for r in rows.orderBy(*order).toLocalIterator()], execute, passes)
        if name == "functions" and "late_functions" in names:
            failed = {}  # those that need tables come again
        if failed:
            failures[name] = failed
    return failures


def table_structure(source: R.System, target: R.System) -> DataFrame:
    """place, schema_name, name, statement: tables that the target lacks, then columns, constraints (no foreign keys), unique indexes."""
    items = drift.report([drift.missing_tables(source, target), *drift.structure_drift(source, target)]).where(F.col("drift_type") == MISSING_ON_TARGET)
    foreign = F.contains("fix_ddl", F.lit("FOREIGN KEY")) & (F.col("object_type") == "constraint")
    unique = R.indexes(source).where("is_unique").select(F.col("schema_name").alias("schema"), F.col("table_name").alias("table"), F.col("index_name").alias("name"))
    kept = items.where(F.col("object_type").isin("table", "column", "constraint") & ~foreign)
    indexes = items.where("object_type = 'index'").join(unique, ["schema", "table", "name"], "left_semi").select(drift.COLUMNS)
    return kept.unionByName(indexes).select(F.col("section_no").alias("place"), F.col("schema").alias("schema_name"), "name", F.col("fix_ddl").alias("statement"))


@dataclass
class Applied:
    done: int = 0
    failed: dict[str, str] = field(default_factory=dict)


def apply_drift(items: DataFrame, execute: Execute, drop_extra: bool = False, refresh: Callable[[], object] | None = None) -> Applied:
    """Run the fixes of a report in their order; `refresh` (with a copy) follows if a table was made."""
    out, made = Applied(), False
    for r in drift.fixes(items, drop_extra).toLocalIterator():
        try:
            execute(r["fix_ddl"])
            out.done += 1
            made |= r["object_type"] == "table" and r["drift_type"] == MISSING_ON_TARGET
        except Exception as e:
            out.failed[r["fix_ddl"]] = f"{type(e).__name__}: {e}"
            log.warning("fix failed: %s: %s", r["fix_ddl"], e)
    if made and refresh is not None:
        refresh()
    return out


def ownership_changes(source: DataFrame, target: DataFrame, roles: DataFrame) -> DataFrame:
    """The owner fixes that can be run: other owner, known role, object on both sides."""
    return drift.owner_drift(source, target, roles).where("fix_ddl <> ''")


def privilege_additions(source: DataFrame, target: DataFrame, roles: DataFrame) -> DataFrame:
    """The grants that the target lacks and can be given; nothing is revoked."""
    return drift.privilege_drift(source, target, roles).where((F.col("drift_type").isin(MISSING_ON_TARGET, DIFFERENT)) & (F.col("fix_ddl") != "") & (F.col("drift_type") != MISSING_ON_SOURCE))


def setting_changes(source: DataFrame, target: DataFrame) -> DataFrame:
    """database, name, statement of settings that the target lacks or has otherwise; its own others stay."""
    gone = only_left(source, target, ["database", "name", "value"])
    return gone.select("database", "name", S.setting(F.col("database"), F.col("entry")).alias("statement"))


def capture_set(tables: DataFrame, version: int) -> DataFrame:
    """captured_as, schema_name, table_name: what a stream is told to capture. From version 15 on whole
    schemas (table_name empty), before that each publishable table."""
    if version >= 15:
        return tables.select(F.lit("schema").alias("captured_as"), "schema_name", F.lit("").alias("table_name")).distinct()
    return tables.select(F.lit("table").alias("captured_as"), "schema_name", "table_name")


def sync_new_tables(captured: DataFrame, tracked: DataFrame, create: DataFrame, execute: Execute, copy: Callable[[str, str], object], refresh: Callable[[], object]) -> list[str]:
    """Make and copy tables that are captured and not tracked yet, then refresh the stream. What was made.

    create: schema_name, table_name, ddl.
    """
    key, made = ["schema_name", "table_name"], []
    new = captured.select(key).join(tracked.select(key), key, "left_anti").join(create, key).orderBy(*key)
    for r in new.toLocalIterator():
        if not in_passes([r["ddl"]], execute, 1):
            copy(r["schema_name"], r["table_name"])
            made.append(f"{r['schema_name']}.{r['table_name']}")
    if made:
        refresh()
    return made


def visible_rows(rows: DataFrame, policies: list[dict], roles: list[str], command: str = "r") -> DataFrame:
    """rows that a role sees under row policies: any permissive policy lets a row through, each restrictive one must.

    policies: polcmd, permissive, roles, using_expr (SQL over the row's columns; null or empty holds).
    Without a permissive policy nothing is seen.
    """
    own = [p for p in policies if p["polcmd"] in (command, "*") and ("PUBLIC" in (p["roles"] or ["PUBLIC"]) or set(p["roles"]) & set(roles))]
    test = lambda p: F.coalesce(F.expr(p["using_expr"]), F.lit(False)) if p["using_expr"] else F.lit(True)
    seen, must = F.lit(False), F.lit(True)
    for p in own:
        if p["permissive"]:
            seen = seen | test(p)
        else:
            must = must & test(p)
    return rows.where(seen & must)
