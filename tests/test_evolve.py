"""Targets whose structure grows under their files."""

import pytest
from pyspark.sql.types import DataType

from driftwell.plans.evolve import EvolvingTable, Narrower, widens

STRUCTURE = "column string, kind string, default string"


def test_old_files_have_the_newest_structure(spark, tmp_path):
    t = EvolvingTable(spark, f"{tmp_path}/t")
    t.create(spark.createDataFrame([], "id int, mood string").schema, {"mood": ["sad", "ok"]})
    assert t.read().isEmpty()
    t.append(spark.createDataFrame([(1, "ok"), (2, None)], "id int, mood string"))
    assert t.evolve(spark.createDataFrame([("id", "bigint", None), ("n", "int", "40 + 2"), ("note", "string", None)], STRUCTURE), {"mood": ["sad", "ok", "glad"]}) == [
        "widen id to bigint", "add n int", "add note string", "labels of mood",
    ]
    again = EvolvingTable(spark, f"{tmp_path}/t")  # another process
    assert again.evolve(spark.createDataFrame([("id", "bigint", None)], STRUCTURE), {"mood": ["sad", "ok", "glad"]}) == []
    again.append(spark.createDataFrame([(1 << 40, "glad", 7)], "id bigint, mood string, n int"))
    assert sorted(map(tuple, t.read().collect())) == [(1, "ok", 42, None), (2, None, 42, None), (1 << 40, "glad", 7, None)]
    assert sorted(map(tuple, t.read(1).collect())) == [(1, "ok"), (2, None)]
    assert t.labels(1) == {"mood": ["sad", "ok"]} and t.read().schema == t.schema()


def test_nothing_is_lost(spark, tmp_path):
    t = EvolvingTable(spark, f"{tmp_path}/t")
    t.create(spark.createDataFrame([], "id bigint, mood string").schema, {"mood": ["sad", "ok"]})
    for kind in ("int", "date"):
        with pytest.raises(Narrower):
            t.widen("id", kind)
    for labels in (["sad"], ["ok", "sad"], ["sad", "fine"]):
        with pytest.raises(Narrower):
            t.grow_labels("mood", labels)
    with pytest.raises(ValueError, match="no label"):
        t.append(spark.createDataFrame([(1, "odd")], "id bigint, mood string"))
    with pytest.raises(ValueError, match="no column"):
        t.append(spark.createDataFrame([(1,)], "other int"))
    with pytest.raises(Narrower):
        t.append(spark.createDataFrame([("x",)], "id string"))
    with pytest.raises(ValueError, match="is there"):
        t.add_column("id", "int")
    assert t.read().isEmpty() and t.version() == 1


@pytest.mark.parametrize(("old", "new", "fits"), [("int", "bigint", True), ("bigint", "int", False), ("decimal(10,2)", "decimal(12,4)", True), ("decimal(10,2)", "decimal(10,4)", False), ("float", "double", True), ("date", "string", True)])
def test_widening(spark, old, new, fits):
    assert widens(DataType.fromDDL(old), DataType.fromDDL(new)) is fits


def test_files_that_were_given_up_are_not_read(spark, tmp_path):
    t = EvolvingTable(spark, f"{tmp_path}/t")
    t.create(spark.createDataFrame([], "id int").schema)
    spark.range(3).selectExpr("cast(id as int) as id").write.parquet(f"{tmp_path}/t/data/v000001-dead")
    assert t.read().isEmpty()
