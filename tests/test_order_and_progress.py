"""Levels of what needs what, streamed high-water marks, and the progress of streams as frames."""

import random

import pytest

from driftwell.operators import status
from driftwell.operators.dependency import levels
from driftwell.plans import apply
from driftwell.streaming import high_water
from driftwell.streaming.progress import ProgressListener


def placed(spark, nodes, edges):
    found = levels(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "node string, needs string"))
    return {r.node: r.level if r.level is not None else list(r.cycle) if r.cycle else None for r in found.collect()}


def test_levels_are_the_longest_ways_and_cycles_have_their_members(spark):
    edges = [("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("d", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("z", "a"), ("s", "s"), ("e", "gone"), ("b", "a")]
    assert placed(spark, "abcdxyzwse", edges) == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 0, "x": list("xyz"), "y": list("xyz"), "z": list("xyz"), "w": None, "s": ["s"]}
    assert placed(spark, "ab", []) == {"a": 0, "b": 0}


def test_random_graphs(spark):
    rng = random.Random(1)
    nodes = [f"n{k:02d}" for k in range(30)]
    edges = [(nodes[i], nodes[j]) for i in range(30) for j in range(i) if rng.random() < 0.12]
    deep = {}
    for k, n in enumerate(nodes):
        deep[n] = max((deep[b] + 1 for a, b in edges if a == n), default=0)
    assert placed(spark, nodes, edges) == deep and max(deep.values()) > 3


def test_views_are_made_in_one_pass(spark, monkeypatch):
    """Ten views, each of which reads the one before: every statement finds what it needs at its first attempt."""
    names = [f"v{9 - k}" for k in range(10)]  # against the order of names
    rows = spark.createDataFrame([("s", n, n) for n in names] + [("s", "loop1", "loop1"), ("s", "loop2", "loop2")], "schema_name string, name string, statement string")
    pairs = [("s", b, "s", a) for a, b in zip(names, names[1:])] + [("s", "loop1", "s", "loop2"), ("s", "loop2", "s", "loop1")]
    needs = spark.createDataFrame(pairs, "schema_name string, view_name string, needs_schema_name string, needs_view_name string")
    monkeypatch.setattr(apply, "stage", lambda *a: rows)
    monkeypatch.setitem(apply.NEEDS, "views", (lambda s: needs, "view_name"))
    system = type("S", (), {"tables": {"pg_rewrite": None}})()
    ran = []
    failed = apply.run_stages(["views"], system, ran.append)
    assert ran == names and set(failed["views"]) == {"loop1", "loop2"} and "s.loop1, s.loop2" in failed["views"]["loop1"]


@pytest.mark.parametrize("margin", [0, 10])
def test_marks_rise_and_a_restart_writes_nothing_twice(spark, tmp_path, margin):
    put = lambda rows: spark.createDataFrame(rows, "k string, v long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    target, wrote = {"a": 5}, []

    def write(rows, batch):
        for r in rows.collect():
            wrote.append((r.key, r.new_value))
            target[r.key] = r.new_value

    def run():
        stream = spark.readStream.schema("k string, v long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        read = lambda: spark.createDataFrame(list(target.items()), "key string, last_value long")
        high_water.keep_up(stream, "k", "v", read, write, f"{tmp_path}/at", margin).awaitTermination()

    put([("a", 3), ("b", 7), ("b", None)])
    run()
    assert sorted(wrote) == [("b", 7 + margin)]
    run()
    put([("a", 30), ("b", 2)])
    put([("a", 29)])
    run()
    assert sorted(wrote) == sorted([("b", 7 + margin), ("a", 30 + margin)]) and target == {"a": 30 + margin, "b": 7 + margin}


def test_progress_of_streams(spark, tmp_path):
    listener = ProgressListener()
    assert listener.subscriptions(spark).isEmpty()
    spark.range(10).repartition(2).write.parquet(f"{tmp_path}/in")
    spark.streams.addListener(listener)
    try:
        source = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        going = source().writeStream.queryName("d_one").format("noop").option("checkpointLocation", f"{tmp_path}/1").start()
        going.processAllAvailable()
        done = source().writeStream.queryName("d_two").format("noop").option("checkpointLocation", f"{tmp_path}/2").trigger(availableNow=True).start()
        done.awaitTermination()
        listener.wait_until_ended([str(done.runId)])
        seen = {r.subname: r for r in listener.subscriptions(spark).collect()}
        assert seen["d_one"].received == seen["d_two"].received == 10 and seen["d_one"].enabled and not seen["d_two"].enabled and seen["d_one"].pid == str(going.runId)
        going.stop()
        listener.wait_until_ended([str(going.runId)])
    finally:
        spark.streams.removeListener(listener)
    sections = status.collect_sections(spark.createDataFrame([("one",), ("two",), ("three",)], "database string"), listener.sections(spark, "d_"))
    found = {r.database: r for r in sections.collect()}
    assert found["one"].lag[0].state == "stopped" and found["two"].slots[0].wal_status == "reserved" and found["three"].subscription == []
    with pytest.raises(TimeoutError):
        listener.wait_until_ended(["none"], seconds=0.2)
