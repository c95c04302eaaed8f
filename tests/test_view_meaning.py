"""Definitions of views by what they mean."""

import pytest

from driftwell.operators.drift import view_drift
from driftwell.operators.view_meaning import ViewMeanings, same_views, spark_type

COLUMNS = {("public", "t"): [("id", "integer"), ("name", "text"), ("at", "timestamp with time zone")], ("public", "u"): [("id", "integer"), ("name", "text"), ("at", "timestamp with time zone")], ("s", "Odd name"): [("id", "bigint")]}
BASE = "SELECT a.id, b.name FROM public.t a JOIN public.u b ON a.id = b.id WHERE a.id > 3 AND b.name = 'x'"


@pytest.fixture(scope="module")
def meanings(spark):
    return ViewMeanings(spark, COLUMNS)


@pytest.mark.parametrize(("other", "same"), [
    ("select x.id,\n  y.name from t x join u y on x.id = y.id where y.name = 'x' and x.id > 3;", True),
    ('SELECT "a"."id", "b"."name" FROM "public"."t" "a" JOIN "public"."u" "b" ON a.id = b.id WHERE a.id > 3 AND b.name = \'x\'', True),
    (BASE.replace("> 3", "> 4"), False), (BASE.replace("'x'", "'X'"), False), (BASE.replace("public.u b", "public.t b"), False),
    (BASE.replace("b.name FROM", "b.name AS title FROM"), False), (BASE.replace("JOIN", "LEFT JOIN"), False), (BASE.replace("a.id, b.name", "b.name, a.id"), False),
])
def test_meaning_counts(meanings, other, same):
    assert meanings.same(BASE, other) is same


def test_casts_as_the_server_writes_them(meanings):
    cast = "SELECT t.id FROM t WHERE t.name = ('x'::character varying)::text AND t.at > '2024-01-01'::timestamp with time zone"
    assert meanings.same(cast, cast.replace("t.", "q.").replace("FROM t", "FROM t q")) and not meanings.same(cast, cast.replace("2024", "2025"))


def test_what_cannot_be_analysed_is_text(meanings):
    odd = "SELECT id FROM ONLY t WHERE name ~~ 'x%'"
    assert meanings.same(odd, "SELECT  id\nFROM ONLY t WHERE name ~~ 'x%' ") and not meanings.same(odd, odd.replace("id", "name"))
    assert meanings.same('SELECT id FROM s."Odd name"', 'SELECT o.id FROM "s"."Odd name" o') and not meanings.same("SELECT id FROM gone", "SELECT g.id FROM gone g")


def test_drift_passes_over_equal_views(spark, meanings):
    schema = "schema_name string, view_name string, relkind string, view_def string"
    source = spark.createDataFrame([("s", "a", "v", BASE), ("s", "b", "v", BASE), ("s", "c", "m", BASE), ("s", "d", "v", None)], schema)
    target = spark.createDataFrame([("s", "a", "v", BASE.replace("a.", "q.").replace("t a", "t q")), ("s", "b", "v", BASE.replace("3", "5")), ("s", "d", "v", None)], schema)
    found = {(r.name, r.drift_type) for r in view_drift(source, target, meanings=meanings).collect()}
    assert found == {("b", "different"), ("c", "missing_on_target")}
    assert ("a", "different") in {(r.name, r.drift_type) for r in view_drift(source, target).collect()}


def test_types():
    assert [spark_type(t) for t in ("integer[]", "numeric(15,2)", "character varying(10)", "Boolean", "int")] == ["array<int>", "decimal(15,2)", "string", "boolean", "int"]


def test_one_pair_of_each_shape_is_analysed(spark, meanings, monkeypatch):
    make = lambda at, other: [(f"{at}{k}", f"SELECT a.id FROM t a WHERE a.id > {k} AND a.id < 50", other.format(k=k)) for k in range(10, 90)]
    rows = make("same", "SELECT b.id FROM t b WHERE b.id < 50 AND b.id > {k}") + make("other", "SELECT b.id FROM t b WHERE b.id < 50 AND b.id > 1{k}")
    rows += make("swapped", "SELECT b.id FROM t b WHERE b.id < {k} AND b.id > 50")  # at 50 that is no change
    quoted = "SELECT a.id FROM t a WHERE a.name {} 'x = {}'"
    rows += [("quoted", quoted.format("=", 5), quoted.format("= ", 6)), ("quoted too", quoted.format("=", 7), quoted.format("=  ", 7).replace("a.", "c.").replace("t a", "t c"))]
    rows += [("zero", "SELECT a.id FROM t a WHERE a.id > 5", "SELECT c.id FROM t c WHERE c.id > 05"), ("limit", "SELECT a.id FROM t a LIMIT 5", "SELECT a.id FROM t a LIMIT 6")]
    rows += [("sum", "SELECT a.id FROM t a WHERE a.id > 5 + 10", "SELECT a.id FROM t a WHERE a.id > 10 + 5"), ("other sum", "SELECT a.id FROM t a WHERE a.id > 6 + 10", "SELECT a.id FROM t a WHERE a.id > 20 + 5")]
    rows += [("no zero", "SELECT a.id FROM t a WHERE a.id > 6", "SELECT c.id FROM t c WHERE c.id > 05")]
    rows += [(f"spaces {x}", "SELECT a.id FROM t a WHERE a.name = 'p q'", f"SELECT c.id FROM t c WHERE c.name = 'p{x}q'") for x in (" ", "  ")]
    asked, same = [], meanings.same
    monkeypatch.setattr(meanings, "same", lambda a, b: asked.append((a, b)) or same(a, b))
    found = {r.name for r in same_views(spark.createDataFrame(rows, "name string, source_def string, target_def string"), ["name"], meanings).collect()}
    assert found == {n for n, a, b in rows if same(a, b)} and len(found) > 80 and len(asked) < 20
