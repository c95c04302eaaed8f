"""The drift report: one frame of items from all sections, in a fixed order, and the plan to mend it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import definitions as D
from ..functions import statements as S
from ..functions.names import normalize_ws, qualified
from . import relations as R
from .catalog import by_depth, missing_labels
from .view_meaning import ViewMeanings, same_views
from .keyed_diff import DIFFERENT, MISSING_ON_SOURCE, MISSING_ON_TARGET, only_left

COLUMNS = ["section_no", "object_type", "schema", "table", "name", "drift_type", "detail", "fix_ddl"]


def _same_keys(keys: list[str]) -> Column:
    """Keys and those named `_key` are the same; nulls equal nulls."""
    return reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))


def _items(rows: DataFrame, section: int | Column, object_type, schema, table, name, kind: str | Column, detail: Column | None = None, fix: Column | None = None) -> DataFrame:  # noqa: ANN001
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        F.lit(section).alias("section_no"), text(object_type).alias("object_type"), schema.alias("schema"), table.alias("table"),
        name.alias("name"), F.lit(kind).alias("drift_type"), F.coalesce(detail if detail is not None else F.lit(""), F.lit("")).alias("detail"), F.coalesce(fix if fix is not None else F.lit(""), F.lit("")).alias("fix_ddl"),
    )


def one_of_each(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The greatest `text` of each key: a left join of it repeats no row, and Spark leaves it out where the text isn't read."""
    return rows.groupBy(*keys).agg(F.max(text).alias(text))


def schema_drift(source: DataFrame, target: DataFrame) -> DataFrame:
    s = F.col("schema_name")
    return _items(only_left(source, target, ["schema_name"]), 1, "schema", F.lit(""), F.lit(""), s, MISSING_ON_TARGET, fix=F.concat(F.lit("CREATE SCHEMA IF NOT EXISTS "), S.quote_ident(s)))


def table_drift(source: DataFrame, target: DataFrame, create: DataFrame | None = None) -> DataFrame:
    """create: schema_name, table_name, ddl of the source's tables (optional)."""
    keys = ["schema_name", "table_name"]
    gone, extra = only_left(source, target, keys), only_left(target, source, keys)
    ddl = F.lit("")
    if create is not None:
        gone, ddl = gone.join(one_of_each(create, keys, "ddl"), keys, "left"), F.col("ddl")
    s, t = F.col("schema_name"), F.col("table_name")
    return _items(gone, 2, "table", s, t, t, MISSING_ON_TARGET, fix=ddl).unionByName(
        _items(extra, 3, "table", s, t, t, MISSING_ON_SOURCE, fix=F.concat(F.lit("DROP TABLE "), qualified(s, t)))
    )


def column_drift(source: DataFrame, target: DataFrame, partitions: DataFrame | None = None, definitions: DataFrame | None = None) -> DataFrame:
    """Columns of tables on both sides: missing, extra, or of another type. `partitions` are passed over: they follow their parents.

    definitions: the source's columns with all that defines them, where `source` has but their types.
    """
    table_key, key = ["schema_name", "table_name"], ["schema_name", "table_name", "column_name"]
    parts = ("column_name", "data_type", "not_null", "column_default", "is_generated", "identity", "identity_options", "collation_name", "collation_schema")
    # One full outer join, since each side is a join of many tables that would be made anew for every use.
    mine = source.select(*key, "data_type", F.lit(True).alias("_s"))
    theirs = target.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("data_type").alias("_type"), F.lit(True).alias("_t"))
    both = mine.join(theirs, _same_keys(key), "full_outer")
    both = both.select(*[F.when(F.col("_s"), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in key], "data_type", "_type", "_s", "_t")
    whole = Window.partitionBy(*table_key)
    common = both.withColumns({"_in_s": F.max("_s").over(whole), "_in_t": F.max("_t").over(whole)}).where("_in_s and _in_t").dropna(subset=table_key)
    kind = F.when(F.col("_t").isNull(), MISSING_ON_TARGET).when(F.col("_s").isNull(), MISSING_ON_SOURCE)
    kind = kind.when(F.col("column_name").isNotNull() & ~F.col("data_type").eqNullSafe(F.col("_type")), DIFFERENT)
    found = common.withColumn("_kind", kind).where("_kind is not null")
    if partitions is not None:
        found = found.join(partitions.select(table_key), table_key, "left_anti")
    s, t, c = (F.col(k) for k in key)
    kind = F.col("_kind")
    add = F.concat(F.lit("ALTER TABLE "), qualified(s, t), F.lit(" ADD COLUMN "), S.column_definition({k: F.col(k) for k in parts}))
    added = (source if definitions is None else definitions).select(*key, add.alias("_add"))
    found = found.join(one_of_each(added, key, "_add"), key, "left")
    mismatch = F.concat(F.lit("source has "), F.col("data_type"), F.lit(", target has "), F.col("_type"))
    section = F.when(kind == MISSING_ON_TARGET, 4).when(kind == MISSING_ON_SOURCE, 5).otherwise(6)
    return _items(found, section, "column", s, t, c, kind, F.when(kind == DIFFERENT, mismatch), F.when(kind == MISSING_ON_TARGET, F.col("_add")))


def named_drift(source: DataFrame, target: DataFrame, section: int, object_type: str, name: str, definition: str, fix: Column) -> DataFrame:
    """Indexes and constraints: by name, from the source's side."""
    missing = only_left(source, target, ["schema_name", "table_name", name])
    return _items(missing, section, object_type, F.col("schema_name"), F.col("table_name"), F.col(name), MISSING_ON_TARGET, F.col(definition), fix)


def enum_drift(source: DataFrame, target: DataFrame) -> DataFrame:
    """Types that the target lacks, and an item for each label that it lacks."""
    keys = ["schema_name", "type_name"]
    s, n = F.col("schema_name"), F.col("type_name")
    missing = only_left(source, target, keys)
    labels = missing_labels(source.join(target.select(keys), keys, "left_semi"), target, keys)
    return _items(missing, 9, "enum", s, F.lit(""), n, MISSING_ON_TARGET, fix=S.enum_type(s, n, F.col("labels"))).unionByName(
        _items(labels, 9, "enum", s, F.lit(""), n, DIFFERENT, F.concat(F.lit("missing label "), F.col("label")), S.enum_value(s, n, F.col("label")))
    )


def definition_drift(
    source: DataFrame, target: DataFrame, section: int, keys: list[str], object_type, compare: dict[str, Column], fix: Column,  # noqa: ANN001
    table: Column | None = None, replace: Column | None = None, name: Column | None = None,
) -> DataFrame:
    """Functions, triggers, policies, views: missing (fix), or with an unequal definition (replace, else fix).

    compare: name → expression; texts are compared with white space collapsed.
    """
    theirs = target.select(*[F.col(k).alias(f"_{k}") for k in keys], *[e.alias(f"_t_{k}") for k, e in compare.items()], F.lit(True).alias("_there"))
    differs = reduce(lambda x, y: x | y, (~e.eqNullSafe(F.col(f"_t_{k}")) for k, e in compare.items()))
    named = reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in keys))
    kind = F.when(F.col("_there").isNull(), MISSING_ON_TARGET).when(named & differs, DIFFERENT)
    found = source.join(theirs, _same_keys(keys), "left").withColumn("_kind", kind).where("_kind is not null")
    shown = name if name is not None else F.col(keys[-1])
    if replace is not None:
        fix = F.when(F.col("_kind") == DIFFERENT, replace).otherwise(fix)
    return _items(found, section, object_type, F.col("schema_name"), table if table is not None else F.lit(""), shown, F.col("_kind"), fix=fix)


def function_drift(source: DataFrame, target: DataFrame) -> DataFrame:
    """Functions by name and arguments, so that overloads stay apart."""
    keys = ["schema_name", "func_name", "func_args"]
    return definition_drift(source, target, 10, keys, "function", {"body": normalize_ws(F.col("func_def"))}, F.col("func_def"), name=F.col("func_name"))


def view_drift(source: DataFrame, target: DataFrame, kept_up: DataFrame | None = None, meanings: ViewMeanings | None = None) -> DataFrame:
    """Views by what they mean, with `meanings`, else by normalised text. kept_up: views of the source that another system keeps, which are passed over."""
    keys = ["schema_name", "view_name"]
    if meanings is not None:
        pairs = source.select(*keys, F.col("view_def").alias("source_def")).join(target.select(*keys, F.col("view_def").alias("target_def")), keys)
        alike = same_views(pairs, keys, meanings)
        # Those that mean the same count with the source's text on both sides.
        texts = alike.join(source.select(*keys, F.col("view_def").alias("_def")), keys)
        target = target.join(texts, keys, "left").withColumn("view_def", F.coalesce("_def", "view_def")).drop("_def")
    if kept_up is not None:
        source = source.join(kept_up.select(keys), keys, "left_anti")
    kind = F.when(F.col("relkind") == "m", "materialized_view").otherwise("view")
    make = lambda exists: D.view(F.col("schema_name"), F.col("view_name"), F.col("relkind"), F.col("view_def"), exists)
    return definition_drift(source, target, 14, keys, kind, {"def": normalize_ws(F.col("view_def"))}, make(False), replace=make(True))


def trigger_drift(source: DataFrame, target: DataFrame) -> DataFrame:
    s, t, n = F.col("schema_name"), F.col("table_name"), F.col("trigger_name")
    fix = F.concat_ws("; ", F.col("trigger_def"), S.trigger_state(s, t, n, F.col("enabled")))
    return definition_drift(
        source, target, 11, ["schema_name", "table_name", "trigger_name"], "trigger",
        {"def": normalize_ws(F.col("trigger_def")), "state": F.col("enabled")}, fix, table=t,
    )


def policy_drift(source: DataFrame, target: DataFrame) -> DataFrame:
    c = F.col
    compare = {
        "cmd": c("polcmd"), "permissive": c("permissive"), "roles": F.array_sort("roles"),
        "using": normalize_ws(c("using_expr")), "check": normalize_ws(c("check_expr")),
    }
    fix = S.policy(c("schema_name"), c("table_name"), c("policy_name"), c("polcmd"), c("permissive"), c("roles"), c("using_expr"), c("check_expr"))
    return definition_drift(source, target, 13, ["schema_name", "table_name", "policy_name"], "policy", compare, fix, table=c("table_name"))


def row_security_drift(source: DataFrame, target: DataFrame) -> DataFrame:
    """Flags that are on at the source and off at the target; tables that the target lacks are passed over."""
    keys = ["schema_name", "table_name"]
    both = source.join(target.select(*keys, F.col("rowsecurity").alias("_r"), F.col("force_rowsecurity").alias("_f")), keys)
    s, t = F.col("schema_name"), F.col("table_name")
    alter = lambda word: F.concat(F.lit("ALTER TABLE "), qualified(s, t), F.lit(f" {word} ROW LEVEL SECURITY"))
    on = _items(both.where("rowsecurity and not _r"), 12, "row_security", s, t, t, DIFFERENT, F.lit("row security is off"), alter("ENABLE"))
    force = _items(both.where("force_rowsecurity and not _f"), 12, "row_security", s, t, t, DIFFERENT, F.lit("row security is not forced"), alter("FORCE"))
    return on.unionByName(force)


def owner_drift(source: DataFrame, target: DataFrame, roles: DataFrame) -> DataFrame:
    """Objects on both sides with another owner; a fix only if the target knows the role."""
    keys = ["schema_name", "object_name", "kind", "func_args"]
    theirs = target.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("owner").alias("_owner"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = source.join(theirs, same & (F.col("owner") != F.col("_owner")))
    both = both.join(roles.select(F.col("rolname").alias("owner"), F.lit(True).alias("_known")), "owner", "left")
    s, n, k, a = (F.col(x) for x in keys)
    fix = F.when(F.col("_known"), S.owner_change(S.object_text(k, s, n, a), F.col("owner")))
    detail = F.concat(F.lit("source="), F.col("owner"), F.lit(", target="), F.col("_owner"))
    return _items(both, 15, F.concat(F.lit("ownership ("), k, F.lit(")")), s, F.when(k == "table", n).otherwise(""), n, DIFFERENT, detail, fix)


PRIVILEGE_KEY = ["acl_kind", "kind", "schema_name", "object_name", "func_args", "for_role", "objtype", "grantee", "privilege_type"]


def privilege_drift(source: DataFrame, target: DataFrame, roles: DataFrame) -> DataFrame:
    """Grants on one side only, and grants that differ in the grant option (reported once, as different)."""
    s, n, k, g, p = (F.col(x) for x in ("schema_name", "object_name", "kind", "grantee", "privilege_type"))
    known = roles.select(F.col("rolname").alias("grantee"), F.lit(True).alias("_known"))
    kind, name = F.concat(F.lit("privilege ("), k, F.lit(")")), F.concat_ws(":", g, p)
    table = F.when(k.isin("table", "view", "materialized_view", "sequence"), n).otherwise("")
    add = F.when(F.coalesce("_known", F.lit(False)) | (g == "PUBLIC"), S.privilege_change("GRANT"))
    theirs = target.select(*[F.col(x).alias(f"_{x}") for x in PRIVILEGE_KEY], F.col("is_grantable").alias("_g"))
    same = F.lit(True)
    for x in PRIVILEGE_KEY:
        same = same & F.col(x).eqNullSafe(F.col(f"_{x}"))
    missing = source.join(theirs, same, "left_anti").join(known, "grantee", "left")
    mine = source.select(*[F.col(x).alias(f"_{x}") for x in PRIVILEGE_KEY])
    extra = target.join(mine, same, "left_anti")
    option = source.join(theirs, same & (F.col("is_grantable") != F.col("_g"))).join(known, "grantee", "left")
    return (
        _items(missing, 16, kind, s, table, name, MISSING_ON_TARGET, fix=add)
        .unionByName(_items(option, 16, kind, s, table, name, DIFFERENT, F.lit("grant option differs"), add))
        .unionByName(_items(extra, 17, kind, s, table, name, MISSING_ON_SOURCE, fix=S.privilege_change("REVOKE")))
    )


def table_definitions(s: R.System) -> DataFrame:
    """schema_name, table_name, ddl of all tables: columns in order, or PARTITION OF."""
    parts = ("column_name", "data_type", "not_null", "column_default", "is_generated", "identity", "identity_options", "collation_name", "collation_schema")
    keys = ["schema_name", "table_name"]
    lines = R.columns(s).select(*keys, F.struct("ordinal", S.column_definition({k: F.col(k) for k in parts}).alias("line")).alias("l"))
    lines = lines.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]).alias("lines"))
    rows = R.partition_info(s).join(lines, keys, "left")
    lines = F.coalesce("lines", F.array().cast("array<string>"))
    return rows.select(*keys, "is_partition", D.table(F.col("schema_name"), F.col("table_name"), lines).alias("ddl"))


def full_definitions(s: R.System) -> DataFrame:
    """schema_name, table_name, ddl: the table, then its constraints and indexes by name; a partition has its parent's."""
    keys = ["schema_name", "table_name"]
    k, n = F.col("schema_name"), F.col("table_name")
    added = R.constraints(s).select(*keys, F.lit(1).alias("o"), F.col("constraint_name").alias("x"), D.add_constraint(k, n, F.col("constraint_name"), F.col("constraint_def")).alias("t"))
    added = added.unionByName(R.indexes(s).where("not is_primary").select(*keys, F.lit(2).alias("o"), F.col("index_name").alias("x"), F.col("index_def").alias("t")))
    added = added.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "x", "t"))), lambda a: a["t"]).alias("added"))
    rows = table_definitions(s).join(added, keys, "left")
    rest = F.when(~F.col("is_partition"), F.col("added"))
    return rows.select(*keys, F.array_join(F.concat(F.array("ddl"), F.coalesce(rest, F.array().cast("array<string>"))), ";\n").alias("ddl"))


def _schemas(s: R.System) -> DataFrame:
    names = s["pg_namespace"].select(F.col("nspname").alias("schema_name"))
    return names if s.schemas is None else names.where(F.col("schema_name").isin(s.schemas))


def _tables(s: R.System) -> DataFrame:
    return s.relations("rp").select("schema_name", "table_name")


def missing_tables(source: R.System, target: R.System) -> DataFrame:
    """Tables on one side only. Those that the target lacks come with their depth in `detail`, parents
    before partitions, and each makes its schema first where the target lacks that."""
    s, key = F.col("schema_name"), ["schema_name", "table_name"]
    lacking = only_left(_schemas(source), _schemas(target), ["schema_name"]).select("schema_name", F.lit(True).alias("_new"))
    first = F.when(F.col("_new"), F.concat(F.lit("CREATE SCHEMA IF NOT EXISTS "), S.quote_ident(s), F.lit("; "))).otherwise("")
    create = full_definitions(source).join(lacking, "schema_name", "left").select(*key, F.concat(first, F.col("ddl")).alias("ddl"))
    depths = by_depth(source.relations("rp").select("oid", *key), source["pg_inherits"].select(F.col("inhrelid").alias("oid"), F.col("inhparent").alias("parent")))
    depths = depths.groupBy(s.alias("schema"), F.col("table_name").alias("table")).agg(F.max("part_depth").alias("part_depth"))
    deep = F.when(F.col("drift_type") == MISSING_ON_TARGET, F.lpad(F.coalesce("part_depth", F.lit(0)).cast("string"), 3, "0")).otherwise("")
    return table_drift(_tables(source), _tables(target), create).join(depths, ["schema", "table"], "left").withColumn("detail", deep).select(COLUMNS)


def structure_drift(source: R.System, target: R.System) -> list[DataFrame]:
    """Columns, indexes and constraints of tables on both sides; partitions have their parents'."""
    s, t = F.col("schema_name"), F.col("table_name")
    partitions = R.partition_info(source).where("is_partition")
    add = D.add_constraint(s, t, F.col("constraint_name"), F.col("constraint_def"))
    named = named_drift(R.indexes(source), R.indexes(target), 7, "index", "index_name", "index_def", F.col("index_def")).unionByName(
        named_drift(R.constraints(source), R.constraints(target), 8, "constraint", "constraint_name", "constraint_def", add)
    )
    common = common_tables(_tables(source), _tables(target), partitions).select(s.alias("schema"), t.alias("table"))
    return [column_drift(R.attributes(source), R.attributes(target), partitions, R.columns(source)), named.join(common, ["schema", "table"], "left_semi")]


def detect_drift(source: R.System, target: R.System, enums: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Every section of the report, from the system tables of both sides, in the fixed order of sections.

    enums: schema_name, type_name, labels of both sides.
    """
    roles = target["pg_roles"].select("rolname").distinct()
    return report([
        schema_drift(_schemas(source), _schemas(target)),
        missing_tables(source, target),
        *structure_drift(source, target),
        *([enum_drift(*enums)] if enums else []),
        function_drift(R.functions(source), R.functions(target)),
        trigger_drift(R.triggers(source), R.triggers(target)),
        row_security_drift(R.row_security(source), R.row_security(target)),
        policy_drift(R.policies(source), R.policies(target)),
        view_drift(R.views(source), R.views(target)),
        owner_drift(R.owners(source), R.owners(target), roles),
        privilege_drift(R.privileges(source), R.privileges(target), roles),
    ])


def common_tables(source: DataFrame, target: DataFrame, partitions: DataFrame) -> DataFrame:
    """Tables that both sides have and that are no partitions."""
    key = ["schema_name", "table_name"]
    return source.join(target, key, "left_semi").join(partitions.select(key), key, "left_anti")


def report(sections: list[DataFrame]) -> DataFrame:
    """All items; sort by `ordered` to read them."""
    out = sections[0].select(COLUMNS)
    for s in sections[1:]:
        out = out.unionByName(s.select(COLUMNS))
    return out


def ordered() -> list[Column]:
    """The order to read items in: by section, missing tables by depth (their detail), then by name."""
    depth = F.when(F.col("object_type") == "table", F.col("detail")).otherwise("")
    return [F.col("section_no"), depth, *[F.col(c) for c in ("schema", "table", "name", "drift_type", "detail")]]


def fixes(items: DataFrame, drop_extra: bool = False) -> DataFrame:
    """The statements to run, in order: items without a fix are passed over, foreign keys come last,
    and what only the target has is dropped on demand."""
    chosen = items.where("fix_ddl <> ''")
    if not drop_extra:
        chosen = chosen.where(F.col("drift_type") != MISSING_ON_SOURCE)
    foreign = F.col("fix_ddl").contains("FOREIGN KEY")
    return chosen.select(foreign.cast("int").alias("is_fk"), *COLUMNS).orderBy("is_fk", *ordered())
