"""Semantics that the registered queries do not reach, on small frames."""

import pytest
from pyspark.sql import functions as F

from driftwell.functions import names as N
from driftwell.functions import statements as S
from driftwell.operators import bulk_copy, catalog, changes, drift, keyed_diff, sequences
from driftwell.plans import bootstrap, reinit


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_names(spark):
    assert one(spark, N.quote_ident(F.lit('a"b'))) == '"a""b"'
    assert one(spark, N.quote_literal(F.lit("it's"))) == "'it''s'"
    assert one(spark, N.safe_name(F.lit("my-app"))) == "my_app_431cf0"
    assert one(spark, N.safe_name(F.lit("plain"))) == "plain"
    assert one(spark, N.kv_quote(F.lit(None).cast("string"))) == '""'
    assert one(spark, N.kv_quote(F.lit('a "b"'))) == '"a \\"b\\""'
    assert one(spark, N.kv_quote(F.lit("plain"))) == "plain"
    assert one(spark, N.normalize_ws(F.lit("  a \n\t b "))) == "a b"
    assert int(one(spark, N.lsn_to_number(F.lit("1/A")))) == (1 << 32) + 10
    assert one(spark, N.hms(F.lit(3723))) == "01:02:03"
    assert one(spark, N.size_text(F.lit(512))) == "512 bytes"
    assert one(spark, N.size_text(F.lit(20480))) == "20 kB"


def test_statements(spark):
    c = {k: F.lit(v) for k, v in dict(column_name="id", data_type="bigint", not_null=True, column_default=None, is_generated=False, identity="a", identity_options=None, collation_name=None, collation_schema=None).items()}
    c = {k: v.cast("string") if k in ("column_default", "identity_options", "collation_name", "collation_schema") else v for k, v in c.items()}
    assert one(spark, S.column_definition(c)) == '"id" bigint GENERATED ALWAYS AS IDENTITY'
    assert one(spark, S.column_definition(c | {"identity": F.lit(""), "column_default": F.lit("nextval('s')")})) == "\"id\" bigint NOT NULL DEFAULT nextval('s')"
    assert one(spark, S.column_definition(c | {"identity": F.lit(""), "is_generated": F.lit(True), "column_default": F.lit("a + 1")})) == '"id" bigint GENERATED ALWAYS AS (a + 1) STORED'
    assert one(spark, S.column_definition(c | {"identity": F.lit(""), "collation_name": F.lit("C"), "collation_schema": F.lit("x")})) == '"id" bigint COLLATE "x"."C" NOT NULL'
    roles = F.array().cast("array<string>")
    assert one(spark, S.policy(*[F.lit(x) for x in "stp"], F.lit("r"), F.lit(True), roles, F.lit(""), F.lit(""))) == 'CREATE POLICY "p" ON "s"."t" AS PERMISSIVE FOR SELECT TO PUBLIC'
    assert one(spark, S.trigger_state(F.lit("s"), F.lit("t"), F.lit("g"), F.lit("O"))) is None
    assert one(spark, S.trigger_state(F.lit("s"), F.lit("t"), F.lit("g"), F.lit("D"))) == 'ALTER TABLE "s"."t" DISABLE TRIGGER "g"'
    assert one(spark, S.setting(F.lit("d"), F.lit("search_path=a, b"))) == 'ALTER DATABASE "d" SET "search_path" TO a, b'
    assert one(spark, S.setting(F.lit("d"), F.lit("x=a=b"))) == "ALTER DATABASE \"d\" SET \"x\" TO 'a=b'"


def test_keyed_diff_nulls(spark):
    s = spark.createDataFrame([(None, 1), (1, None), (2, 5)], "k int, v int")
    t = spark.createDataFrame([(None, 1), (1, None), (2, None)], "k int, v int")
    assert [tuple(r) for r in keyed_diff.keyed_diff(s, t, ["k"]).collect()] == [(2, "different", ["v"])]
    assert keyed_diff.summary_text(s.limit(0).selectExpr("'x' AS drift_type", "1 AS section_no")).first()[0] == "No drift detected"


@pytest.mark.parametrize("chunks", [1, 3, 4, 50])
def test_chunks_cover_all(spark, chunks):
    rows = spark.range(5, 42).withColumnRenamed("id", "k")
    plan = bulk_copy.chunk_plan(rows, "k", chunks).orderBy("chunk_no").collect()
    assert plan[0]["low"] == 5 and plan[-1]["high"] is None
    assert all(a["high"] == b["low"] for a, b in zip(plan, plan[1:]))
    tagged = bulk_copy.with_chunk(rows, "k", chunks)
    assert tagged.count() == 37 and tagged.agg(F.max("chunk_no")).first()[0] == len(plan) - 1


def test_copy_isolates_failures(spark, tmp_path):
    good = spark.range(10).withColumnRenamed("id", "k")
    bad = good.withColumn("k", F.raise_error(F.lit("no")).cast("long"))
    done = bulk_copy.copy_tables(spark, {"a": (good, f"{tmp_path}/a", ["k", "extra"]), "b": (bad, f"{tmp_path}/b", ["k"])})
    assert done == {"a": 10, "b": -1}


def test_sequences(spark):
    schema = "key string, last_value long, start_value long, readable boolean"
    s = spark.createDataFrame([("a", 9, 1, True), ("b", 3, 1, True), ("c", None, 1, False), ("d", 4, 1, True), ("e", None, 1, True)], schema)
    t = spark.createDataFrame([("a", 2, 1, True), ("b", 5, 1, True), ("c", 7, 1, True), ("e", None, 1, True), ("o", 3, 1, True)], schema)
    got = {r["key"]: (r["status"], r["new_value"]) for r in sequences.reconcile(s, t, 100).collect()}
    assert got == {"a": ("updated", 109), "b": ("target_ahead", None), "c": ("permission_denied", None), "e": ("ok", None)}
    assert {r["key"]: r["status"] for r in sequences.read_only_status(s, t).collect()} == {
        "a": "behind", "b": "target_ahead", "c": "permission_denied", "d": "missing_on_target", "e": "ok"
    }
    used = spark.createDataFrame([("o", 8)], "key string, max_id long")
    assert [tuple(r) for r in sequences.orphans(s, t, used).collect()] == [("o", 9, "orphaned_fixed")]
    assert [r["status"] for r in sequences.orphans(s, t, used.limit(0)).collect()] == ["orphaned_unknown"]


def test_changes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    log = spark.createDataFrame([(5, 0, "U", 1, "x"), (6, 0, "D", 2, None), (7, 0, "I", 3, "c"), (3, 0, "U", 2, "old")], "lsn long, seq long, op string, k int, v string")
    state = changes.apply_keyed(base, log, ["k"], after=4)
    assert sorted(tuple(r) for r in state.collect()) == [(1, "x"), (3, "c")]
    assert sorted(tuple(r) for r in changes.apply_keyed(state, log, ["k"], after=4).collect()) == [(1, "x"), (3, "c")]
    cut = log.unionByName(spark.createDataFrame([(6, 5, "T", None, None)], log.schema))
    assert [tuple(r) for r in changes.apply_keyed(base, cut, ["k"]).collect()] == [(3, "c")]
    rows = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    left = changes.apply_multiset(rows, rows.limit(0), spark.createDataFrame([(1,), (3,)], "x int"))
    assert sorted(r["x"] for r in left.collect()) == [1, 2]


def test_stream_restart_and_replay(spark, tmp_path):
    from driftwell.streaming.apply import ChangeTable, NotStreaming, Stream

    schema = "lsn long, seq long, op string, k int, v string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    write([(1, 0, "I", 1, "a"), (2, 0, "I", 2, "b"), (9, 0, "U", 5, "new")])
    table = ChangeTable(spark, f"{tmp_path}/table", spark.createDataFrame([], "k int, v string").schema, ["k"])
    assert table.read().isEmpty()
    stream = Stream(lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log"), table, f"{tmp_path}/at")
    with pytest.raises(NotStreaming):
        stream.wait_until_streaming()
    stream.enable()
    stream.query.awaitTermination()
    stream.wait_until_streaming()
    assert stream.is_streaming()
    write([(3, 0, "D", 1, None), (4, 0, "U", 2, "c"), (8, 0, "U", 5, "old")])  # the last is older than what is there
    stream.enable()
    stream.query.awaitTermination()
    rows = lambda: sorted(tuple(r) for r in table.read().collect())
    assert rows() == [(2, "c"), (5, "new")]
    table.compact()
    before = table.versions()
    assert rows() == [(2, "c"), (5, "new")]
    stream.drop()
    stream.enable()  # a replay from the start writes the same batches
    stream.query.awaitTermination()
    assert table.versions() == before and rows() == [(2, "c"), (5, "new")]
    write([(10, 0, "T", None, None), (11, 0, "I", 7, "after")])
    stream.enable()
    stream.query.awaitTermination()
    assert rows() == [(7, "after")]


def test_apply_plans(spark):
    from driftwell.plans import apply

    ran, fails = [], {"b": 1, "c": 9}

    def execute(statement):
        ran.append(statement)
        if fails.get(statement, 0) > 0:
            fails[statement] -= 1
            raise ValueError(statement)

    assert list(apply.in_passes(["a", "b", "c"], execute)) == ["c"] and ran == ["a", "b", "c", "b", "c", "c"]
    waits, calls = [], iter([TimeoutError, TimeoutError, None])

    def busy():
        if (e := next(calls)) is not None:
            raise e
        return "done"

    assert apply.with_delays(busy, sleep=waits.append) == "done" and waits == [2.0, 4.0]
    looks = iter([False, False, True])
    assert apply.every(1, lambda: 1 / 0, lambda: next(looks), lambda _: None) == 2
    items = spark.createDataFrame(
        [(8, "constraint", "s", "t", "k", "missing_on_target", "", "ADD FOREIGN KEY"), (2, "table", "s", "t", "t", "missing_on_target", "001", "CREATE t"), (2, "table", "s", "a", "a", "missing_on_target", "002", "CREATE a"),
         (3, "table", "s", "x", "x", "missing_on_source", "", "DROP x"), (5, "column", "s", "t", "z", "missing_on_source", "", "")],
        "section_no int, object_type string, schema string, table string, name string, drift_type string, detail string, fix_ddl string",
    )
    ran.clear()
    refreshed = []
    assert apply.apply_drift(items, ran.append, refresh=lambda: refreshed.append(1)).done == 3
    assert ran == ["CREATE t", "CREATE a", "ADD FOREIGN KEY"] and refreshed == [1]
    assert apply.apply_drift(items, ran.append, drop_extra=True).done == 4
    key = "schema_name string, table_name string"
    made = apply.sync_new_tables(spark.createDataFrame([("s", "a"), ("s", "b")], key), spark.createDataFrame([("s", "b")], key), spark.createDataFrame([("s", "a", "CREATE a")], key + ", ddl string"), ran.append, lambda *t: ran.append(t), lambda: ran.append("refresh"))
    assert made == ["s.a"] and ran[-3:] == ["CREATE a", ("s", "a"), "refresh"]


def test_stages_run_in_order(spark):
    from driftwell import catalog_queries
    from driftwell.plans import apply

    s, ran = catalog_queries.system(spark, "/root/testdata/sf0.001"), []
    assert apply.run_stages(["schemas", "tables"], s, ran.append) == {}
    assert ran[0].startswith("CREATE SCHEMA") and ran[-1].startswith("CREATE TABLE")
    place = {t.split('"')[3]: i for i, t in enumerate(ran) if t.startswith("CREATE TABLE")}
    children = [t for t in ran if "PARTITION OF" in t]
    assert children and all(place[t.split('"')[7]] < place[t.split('"')[3]] for t in children if t.split('"')[7] in place)
    only = [x for x in apply.PRE_COPY + apply.POST_COPY if x not in ("schemas", "tables", "enums")]
    assert all(not apply.stage(x, s).isEmpty() for x in only)


def test_repeated_rows_in_blocks(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 3), ("c", 1)], "x string, n long")
    got = {r["x"]: r["count"] for r in changes.repeated(rows, "n", block=4).groupBy("x").count().collect()}
    assert got == {"a": 10, "b": 3, "c": 1}


def test_status_sections(spark):
    from driftwell.operators import status

    dbs = spark.createDataFrame([("d",), ("e",)], "database string")
    tables = spark.createDataFrame([("d", "s", 3, 3)], "database string, schema string, source long, target long")
    got = {r["database"]: r for r in status.collect_sections(dbs, {"tables": tables, "lag": ValueError("no")}).collect()}
    assert len(got["d"]["tables"]) == 1 and got["e"]["tables"] == [] and got["d"]["errors"] == {"lag": "ValueError: no"}
    out = {r["database"]: r["json"] for r in status.render(status.collect_sections(dbs, {"tables": tables}), ["tables"]).collect()}
    assert out["d"] == '{"database":"d","tables":[{"schema":"s","source":3,"target":3}],"errors":{}}'
    copies = spark.createDataFrame([("a", 1200), ("b", -1)], "key string, rows long")
    assert tuple(status.totals(copies).first()) == (1200, 2, 1, "1,200")


def test_config(spark, tmp_path):
    from driftwell.config import load_config

    (tmp_path / "c.yaml").write_text("source: {host: a}\ntarget: {host: b}\nexclude_databases: [x]\n")
    cfg = load_config(f"{tmp_path}/c.yaml")
    assert cfg.source.host == "a" and cfg.exclude_databases == ["x"] and cfg.tables_at_once == 4
    found = spark.createDataFrame([("x", False), ("my-db", False), ("template1", True)], "datname string, datistemplate boolean")
    assert [tuple(r) for r in cfg.streams_of(cfg.databases_of(found)).collect()] == [("my-db", one(spark, N.stream_name("driftwell", F.lit("my-db"))))]
    assert [r["name"] for r in cfg.schemas_of(spark.createDataFrame([("s",), ("anon",)], "name string")).collect()] == ["s"]
    assert cfg.plan_of(spark.createDataFrame([("t", 1, 8192 * 8)], "key string, pages long, bytes long")).count() == 4
    (tmp_path / "d.yaml").write_text("source: {host: a}\ntarget: {host: b}\nno_such: 1\n")
    with pytest.raises(ValueError, match="no_such"):
        load_config(f"{tmp_path}/d.yaml")


def test_drift_sections(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    cols = "schema_name string, table_name string, column_name string, data_type string, not_null boolean, column_default string, is_generated boolean, identity string, identity_options string, collation_name string, collation_schema string"
    col = lambda name, kind: ("s", "t", name, kind, False, None, False, "", None, None, None)
    enum = "schema_name string, type_name string, labels array<string>"
    acl = "acl_kind string, kind string, schema_name string, object_name string, func_args string, for_role string, objtype string, grantee string, privilege_type string, is_grantable boolean"
    owner = "schema_name string, object_name string, kind string, func_args string, owner string"
    roles = make([("r1",)], "rolname string")
    view = "schema_name string, view_name string, relkind string, view_def string"
    items = drift.report([
        drift.schema_drift(make([("s",), ("n",)], "schema_name string"), make([("s",)], "schema_name string")),
        drift.column_drift(make([col("a", "int"), col("b", "text")], cols), make([col("a", "bigint"), col("z", "int")], cols)),
        drift.enum_drift(make([("s", "e", ["x", "y"])], enum), make([("s", "e", ["x"])], enum)),
        drift.view_drift(make([("s", "v", "v", "SELECT  1"), ("s", "w", "v", "SELECT 2"), ("s", "x", "m", "SELECT 4")], view), make([("s", "v", "v", "SELECT 1"), ("s", "w", "v", "SELECT 3"), ("s", "x", "m", "SELECT 5")], view)),
        drift.owner_drift(make([("s", "t", "table", None, "r1"), ("s", "u", "table", None, "r2"), ("s", "f", "function", "int", "r1"), ("s", "f", "function", "text", "r1")], owner), make([("s", "t", "table", None, "x"), ("s", "u", "table", None, "x"), ("s", "f", "function", "int", "x"), ("s", "f", "function", "text", "r1")], owner), roles),
        drift.privilege_drift(make([("relation", "view", "s", "t", None, None, None, "r1", "SELECT", False)], acl), make([("relation", "view", "s", "t", None, None, None, "r3", "SELECT", False)], acl), roles),
    ])
    got = [(r["section_no"], r["name"], r["drift_type"], r["fix_ddl"]) for r in items.orderBy(*drift.ordered()).collect()]
    assert got == [
        (1, "n", "missing_on_target", 'CREATE SCHEMA IF NOT EXISTS "n"'), (4, "b", "missing_on_target", 'ALTER TABLE "s"."t" ADD COLUMN "b" text'),
        (5, "z", "missing_on_source", ""), (6, "a", "different", ""), (9, "e", "different", "ALTER TYPE \"s\".\"e\" ADD VALUE IF NOT EXISTS 'y'"),
        (14, "w", "different", 'CREATE OR REPLACE VIEW "s"."w" AS SELECT 2'), (14, "x", "different", 'DROP MATERIALIZED VIEW IF EXISTS "s"."x"; CREATE MATERIALIZED VIEW "s"."x" AS SELECT 4'),
        (15, "f", "different", 'ALTER ROUTINE "s"."f"(int) OWNER TO "r1"'), (15, "t", "different", 'ALTER TABLE "s"."t" OWNER TO "r1"'),
        (15, "u", "different", ""), (16, "r1:SELECT", "missing_on_target", 'GRANT SELECT ON TABLE "s"."t" TO "r1"'),
        (17, "r3:SELECT", "missing_on_source", 'REVOKE SELECT ON TABLE "s"."t" FROM "r3"'),
    ]
    assert drift.fixes(items).where("drift_type = 'missing_on_source'").isEmpty()
    assert drift.fixes(items, drop_extra=True).where("drift_type = 'missing_on_source'").count() == 1


def test_functions_triggers_policies(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    fn = "schema_name string, func_name string, func_args string, func_def string"
    got = drift.function_drift(make([("s", "f", "", "F()\n a  b"), ("s", "f", "int", "x"), ("s", "g", "", "G()\n x")], fn), make([("s", "f", "", "F()\n a b"), ("s", "f", "int", "y")], fn)).collect()
    assert sorted((r["name"], r["drift_type"]) for r in got) == [("f", "different"), ("g", "missing_on_target")]
    tr = "schema_name string, table_name string, trigger_name string, trigger_def string, enabled string"
    got = drift.trigger_drift(make([("s", "t", "g", "D", "D")], tr), make([("s", "t", "g", "D", "O")], tr)).first()
    assert got["drift_type"] == "different" and got["fix_ddl"].endswith('DISABLE TRIGGER "g"')
    po = "schema_name string, table_name string, policy_name string, polcmd string, permissive boolean, roles array<string>, using_expr string, check_expr string"
    same = drift.policy_drift(make([("s", "t", "p", "r", True, ["b", "a"], "x", None)], po), make([("s", "t", "p", "r", True, ["a", "b"], "x", "")], po))
    assert same.isEmpty()
    rls = "schema_name string, table_name string, rowsecurity boolean, force_rowsecurity boolean"
    assert drift.row_security_drift(make([("s", "t", True, True)], rls), make([("s", "t", False, False)], rls)).count() == 2


def test_reinit_and_bootstrap(spark, tmp_path):
    state = spark.createDataFrame([("d", True, "reserved", True, True, True), ("e", False, None, False, False, False)], "database string, has_publication boolean, slot_status string, has_subscription boolean, is_enabled boolean, worker_running boolean")
    got = {r["database"]: r for r in reinit.decide(state).collect()}
    assert got["d"]["was_healthy"] and got["d"]["actions_taken"] == []
    assert got["e"]["actions_taken"] == ["recreate publication", "recreate subscription with a fresh slot"]
    log = []
    handlers = {"recreate publication": lambda d: log.append(d), "recreate subscription with a fresh slot": lambda d: 1 / 0}
    assert reinit.act(reinit.decide(state), handlers) == {"e": ["recreate publication"]} and log == ["e"]
    parent, child = spark.range(3).withColumnRenamed("id", "p"), spark.range(5).withColumnRenamed("id", "c")
    started = []
    db = bootstrap.Database("d", {"parent": parent, "child": child}, f"{tmp_path}/d", foreign_keys=[("child", ["c"], "parent", ["p"])], position=7, start_stream=started.append)
    out = bootstrap.bootstrap(spark, [db])[0]
    assert out.copied == {"parent": 3, "child": 5} and len(out.warnings) == 1 and started == [7]
    cleaned = []
    bad = bootstrap.Database("b", {"x": parent.withColumn("p", F.raise_error(F.lit("no")).cast("long"))}, f"{tmp_path}/b", cleanup=lambda: cleaned.append(1))
    busy = bootstrap.Database("s", {"parent": parent}, f"{tmp_path}/s", is_streaming=True, cleanup=lambda: cleaned.append(2))
    with pytest.raises(RuntimeError):
        bootstrap.bootstrap(spark, [bad, busy, db])
    assert cleaned == [1] and started == [7, 7]


def test_jdbc_round_trip(spark, tmp_path):
    from driftwell.sources.jdbc import Endpoint, is_unstable_host, read_query, read_ranges, write_table

    db = Endpoint("", url=f"jdbc:derby:{tmp_path}/db;create=true", driver="org.apache.derby.jdbc.EmbeddedDriver", session_init="")
    write_table(spark.range(100).withColumnRenamed("id", "k"), db, "moved")
    read = read_ranges(spark, db, "moved", "k", 0, 100, 4)
    assert read.rdd.getNumPartitions() == 4 and read.count() == 100
    assert read_query(spark, db, "SELECT count(*) AS n FROM moved").first()[0] == 100
    assert is_unstable_host("localhost") and not is_unstable_host("db1.example")
    assert "secret" not in str(Endpoint("h", password="secret")) + str(Endpoint("h", password="secret").masked())


def test_tree_cycle_is_an_error(spark):
    edges = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a")], "child string, parent string")
    assert {tuple(r) for r in catalog.tree_depths(edges).collect()} == {("r", 0), ("a", 1), ("b", 2)}
    turn = edges.unionByName(spark.createDataFrame([("a", "b")], "child string, parent string"))
    with pytest.raises(Exception, match="RECURSION"):
        catalog.tree_depths(turn, max_depth=4).collect()


def test_drift_makes_each_side_once(spark):
    """A side is a join of many system tables: what is looked for in it is found in one join, and what only fixes read is left out."""
    own = spark.range(4).selectExpr("concat('s', id div 9) schema_name", "concat('t', id div 9) table_name", "concat('c', id) column_name", "'int' data_type")
    rest = ", ".join(f"cast(null as {t}) {c}" for c, t in [("not_null", "boolean"), ("column_default", "string"), ("is_generated", "boolean"), *[(c, "string") for c in ("identity", "identity_options", "collation_name", "collation_schema")]])
    source, target = own.selectExpr("*", *rest.split(", ")), own.where("column_name <> 'c2'").selectExpr("*", *rest.split(", "))
    function = lambda body: spark.range(3).selectExpr("concat('s', id div 9) schema_name", "concat('f', id) func_name", "'' func_args", f"'{body}' func_def")
    for items, expected in ((drift.column_drift(source, target), [(4, "c2")]), (drift.function_drift(function("a"), function("b")), [(10, f"f{i}") for i in range(3)])):
        found = items.select("section_no", "name")
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2
        assert sorted(map(tuple, found.collect())) == expected
    assert drift.column_drift(source, target).first().fix_ddl.startswith("ALTER TABLE")
