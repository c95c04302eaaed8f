"""Streamed tables and replicas: repetition, races, restarts, order and hand-over."""

import random
from collections import Counter

import pytest

from driftwell.operators.changes import last_changes
from driftwell.streaming.apply import Stream, start_apply
from driftwell.sources.marks import Marks
from driftwell.streaming.replica import CATCHING_UP, COPYING, IN_STEP, NotInStep, Replica, one_stream
from driftwell.streaming.tables import ChangeTable, RowTable, table_for

KEYED = "lsn long, seq long, op string, k int, v string"
COMMITS = "lsn long, prev long, n long"


def schema(spark, text="k int, v string"):
    return spark.createDataFrame([], text).schema


def test_marks_are_put_once(spark, tmp_path):
    marks = Marks(spark, f"{tmp_path}/marks")
    assert marks.names() == [] and marks.put("a-1", {"x": 1}) and not marks.put("a-1", {"x": 2})
    assert marks.get("a-1") == {"x": 1} and marks.names() == ["a-1"] and marks.names("b") == []
    marks.remove("a-1")
    assert not marks.has("a-1")


@pytest.mark.parametrize("keys", [["k"], []])
def test_compact_again_and_again(spark, tmp_path, keys):
    table = table_for(spark, f"{tmp_path}/t", schema(spark), keys)
    assert isinstance(table, ChangeTable if keys else RowTable) and table.read().isEmpty() and not table.compact()
    add = lambda batch, *rows: table.append(spark.createDataFrame(list(rows), KEYED), batch)
    add(0, (1, 0, "I", 1, "a"), (2, 0, "I", 2, "b"))
    add(1, (3, 0, "D", 1, "a"))
    rows = lambda **at: sorted(tuple(r) for r in table.read(**at).collect())
    assert rows() == [(2, "b")] and rows(batch=0) == [(1, "a"), (2, "b")] and rows(position=1) == [(1, "a")]
    assert table.compact() and not table.compact() and not table.compact()
    assert rows() == [(2, "b")]
    add(1, (9, 0, "I", 9, "again"))  # a batch that comes again changes nothing
    assert rows() == [(2, "b")]
    add(2, (4, 0, "I", 3, "c"))
    assert table.compact() and rows() == [(2, "b"), (3, "c")]
    assert table.vacuum(grace=3600.0) == 0
    assert table.vacuum(grace=0.0) > 0 and rows() == [(2, "b"), (3, "c")]
    add(0, (1, 0, "I", 1, "a"))  # nor does one that was compacted away
    assert rows() == [(2, "b"), (3, "c")]
    with pytest.raises(ValueError, match="compacted"):
        table.read(batch=0)


def test_a_batch_that_stopped_is_written_anew(spark, tmp_path):
    table = ChangeTable(spark, f"{tmp_path}/t", schema(spark), ["k"])
    half = spark.createDataFrame([(1, 0, "I", 1, "half")], KEYED)
    table._logged(half).write.parquet(f"{tmp_path}/t/{table._name('batch', 0)}")  # the driver died before the mark
    assert table.read().isEmpty() and table.versions() == []
    table.append(spark.createDataFrame([(1, 0, "I", 1, "whole")], KEYED), 0)
    assert [tuple(r) for r in table.read().collect()] == [(1, "whole")]


def test_keyless_rows(spark, tmp_path):
    """Random inserts, deletes, updates and a truncate on full rows, in batches of any order, against a counter."""
    rng = random.Random(2)
    state, log, lsn = Counter(), [], 0
    for _ in range(400):
        lsn += 1
        row = (rng.randrange(4), rng.choice(["a", "b", None]))
        op = rng.choice("IIIIDU")
        if lsn == 200:
            state.clear()
            log.append((lsn, 0, "T", None, None, None))
        elif op == "I" or not state[row]:
            state[row] += 1
            log.append((lsn, 0, "I", *row, None))
        elif op == "D":
            state[row] -= 1
            log.append((lsn, 0, "D", *row, None))
        else:
            new = (rng.randrange(4), "n")
            state[row] -= 1
            state[new] += 1
            log.append((lsn, 0, "U", *new, row))
    rng.shuffle(log)
    table = RowTable(spark, f"{tmp_path}/t", schema(spark))
    for batch in range(5):
        table.append(spark.createDataFrame(log[batch::5], KEYED + ", before struct<k: int, v: string>"), batch)
    rows = lambda: Counter(tuple(r) for r in table.read().collect())
    assert rows() == +state
    assert table.compact() and rows() == +state
    table.append(spark.createDataFrame([(500, 0, "T", None, None, None), (501, 0, "I", 7, "x", None), (501, 1, "I", 7, "x", None)], KEYED + ", before struct<k: int, v: string>"), 5)
    assert rows() == Counter({(7, "x"): 2})


def replica_log(seed=1, commits=60):
    """Changes of a keyed and a keyless table in commits, and each table's state after each commit."""
    rng = random.Random(seed)
    keyed, rows, log, records, states = {}, Counter(), {"a": [], "b": []}, [], {0: ({}, Counter())}
    for lsn in range(1, commits + 1):
        n = rng.randrange(0, 5)
        for seq in range(n):
            if rng.random() < 0.5:
                k = rng.randrange(8)
                op = "D" if k in keyed and rng.random() < 0.3 else "U" if k in keyed else "I"
                log["a"].append((lsn, seq, op, k, f"{lsn}"))
                keyed.pop(k, None) if op == "D" else keyed.update({k: f"{lsn}"})
            else:
                row = (rng.randrange(3), "r")
                op = "D" if rows[row] and rng.random() < 0.4 else "I"
                log["b"].append((lsn, seq, op, *row))
                rows[row] += 1 if op == "I" else -1
        records.append((lsn, lsn - 1, n))
        states[lsn] = (dict(keyed), +rows)
    return log, records, states


def as_batch(spark, a, b, commits):
    return one_stream({"a": spark.createDataFrame(a, KEYED), "b": spark.createDataFrame(b, KEYED)}, spark.createDataFrame(commits, COMMITS))


def test_every_epoch_is_a_commit(spark, tmp_path):
    """Changes and commit records come in random batches: each epoch shows both tables as they were after one commit."""
    log, records, states = replica_log()
    rng = random.Random(4)
    late = lambda rows: sorted(rows, key=lambda r: r[0] + rng.randrange(25))
    a, b, commits = late(log["a"]), late(log["b"]), late(records)
    replica = Replica(spark, f"{tmp_path}/r")
    replica.track("a", schema(spark), ["k"], copied=False)
    replica.track("b", schema(spark), [], copied=False)
    cut = lambda rows, i, n: rows[len(rows) * i // n : len(rows) * (i + 1) // n]
    seen = []
    for batch in range(6):
        replica.append(as_batch(spark, cut(a, batch, 6), cut(b, batch, 6), cut(commits, batch, 6)), batch)
        if batch == 3:
            replica = Replica(spark, f"{tmp_path}/r")  # a new process
            replica.append(as_batch(spark, a, b, commits), 3)  # a batch that comes again
            assert replica.compact() == 2
        seen.append(replica.position())
    assert seen == sorted(seen) and seen[-1] == 60 and 0 < seen[2] < 60
    for epoch, position in [*enumerate(seen)][3:]:
        assert dict(map(tuple, replica.read("a", epoch).collect())) == states[position][0]
        assert Counter(map(tuple, replica.read("b", epoch).collect())) == states[position][1]
    assert replica.compact() == 2 and replica.compact() == 0
    assert replica.vacuum(0.0) > 0 and dict(map(tuple, replica.read("a").collect())) == states[60][0]


def test_nothing_is_settled_beyond_a_missing_commit(spark, tmp_path):
    replica = Replica(spark, f"{tmp_path}/r", position=10)
    replica.track("a", schema(spark), ["k"], copied=False)
    add = lambda batch, a, commits: replica.append(as_batch(spark, a, [], commits), batch)
    assert replica.latest() is None and replica.position() == 10 and replica.read("a").isEmpty()
    add(0, [(13, 0, "I", 3, "z")], [(13, 12, 1)])  # 12 hasn't come
    assert replica.position() == 10 and replica.read("a").isEmpty()
    add(1, [(11, 0, "I", 1, "x")], [(11, 10, 2)])  # one change of 11 is missing
    assert replica.position() == 10
    add(2, [(11, 1, "I", 2, "y")], [])
    assert replica.position() == 11 and replica.read("a").count() == 2
    add(3, [], [(12, 11, 0)])
    assert replica.position() == 13 and replica.read("a").count() == 3


@pytest.mark.parametrize("keys", [["k"], []])
def test_hand_over(spark, tmp_path, keys):
    """A copy at each position meets a stream that is behind, at or beyond it: each change counts once."""
    log, records, states = replica_log(seed=6, commits=30)
    which, part = (0, "a") if keys else (1, "b")
    plain = lambda rows: dict(map(tuple, rows.collect())) if keys else Counter(map(tuple, rows.collect()))
    of = lambda low, high: [[r for r in rows if low < r[0] <= high] for rows in (log["a"], log["b"], records)]
    for position, streamed in ((10, 20), (20, 10), (15, 15)):
        root = f"{tmp_path}/{position}"
        Replica(spark, root).track(part, schema(spark), keys)
        replica = Replica(spark, root)
        replica.append(as_batch(spark, *of(0, streamed)), 0)
        assert replica.state(part) == COPYING
        with pytest.raises(NotInStep):
            replica.read(part)
        then = states[position][which]
        snapshot = spark.createDataFrame(list(then.items()) if keys else list(then.elements()), schema(spark))
        state = replica.hand_over(part, schema(spark), keys, lambda s=snapshot, p=position: (s, p))
        assert state == (CATCHING_UP if streamed < position else IN_STEP)
        replica = Replica(spark, root)
        assert replica.hand_over(part, schema(spark), keys, lambda: pytest.fail("it was copied")) == state
        if streamed >= position:
            assert plain(replica.read(part)) == states[streamed][which]
        replica.append(as_batch(spark, *of(streamed, 30)), 1)
        assert replica.state(part) == IN_STEP and plain(replica.read(part)) == states[30][which]
        assert replica.compact() == 1 and plain(replica.read(part)) == states[30][which]
        assert [tuple(r) for r in replica.states().collect()] == [(part, IN_STEP, position, 30)]


def test_a_replica_in_a_stream_restarts(spark, tmp_path):
    log, records, states = replica_log(seed=8, commits=20)
    frames = {"a": (log["a"], KEYED), "b": (log["b"], KEYED), "commits": (records, COMMITS)}

    def write(low, high):
        for name, (rows, columns) in frames.items():
            spark.createDataFrame([r for r in rows if low < r[0] <= high], columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    def changes():
        read = lambda name: spark.readStream.schema(frames[name][1]).parquet(f"{tmp_path}/{name}")
        return one_stream({"a": read("a"), "b": read("b")}, read("commits"))

    write(10, 20)
    replica = Replica(spark, f"{tmp_path}/r")
    replica.track("a", schema(spark), ["k"], copied=False)
    start_apply(changes(), replica, f"{tmp_path}/at").awaitTermination()
    assert replica.position() == 0
    write(0, 10)
    stream = Stream(changes, Replica(spark, f"{tmp_path}/r"), f"{tmp_path}/at")
    stream.enable()
    stream.query.awaitTermination()
    assert replica.position() == 20 and dict(map(tuple, replica.read("a").collect())) == states[20][0]
    stream.drop()
    assert replica.latest() is None
    stream.enable()
    stream.query.awaitTermination()
    assert dict(map(tuple, replica.read("a").collect())) == states[20][0]


def test_last_changes_after_a_truncate(spark):
    rows = spark.createDataFrame([(1, 0, "I", 1, "a"), (2, 0, "T", None, None), (2, 1, "I", 2, "b")], KEYED)
    assert [r.k for r in last_changes(rows, ["k"]).collect()] == [2]


def test_new_tables_are_handed_over_by_their_identity(spark, tmp_path):
    """Captured and untracked tables are copied; a copy that failed is tried again; keyless ones go by full rows."""
    from driftwell.plans.handover import hand_over_new

    replica, broken = Replica(spark, f"{tmp_path}/r"), {"s.b"}
    names = lambda *tables: spark.createDataFrame([("s", t) for t in tables], "schema_name string, table_name string")

    def snapshot(name):
        if name in broken:
            raise OSError("gone")
        return spark.createDataFrame([(1, name), (1, name)][: 1 if name == "s.a" else 2], schema(spark)), 5

    run = lambda *tables: hand_over_new(replica, names(*tables), names("b"), lambda name: (schema(spark), ["k"]), snapshot)
    assert run("a", "b") == {"s.a": CATCHING_UP, "s.b": "failed: OSError: gone"}
    assert isinstance(replica.table("s.a"), ChangeTable) and isinstance(replica.table("s.b"), RowTable) and replica.state("s.b") == COPYING
    broken.clear()
    assert run("a", "b", "c") == {"s.b": CATCHING_UP, "s.c": CATCHING_UP} and run("a", "b", "c") == {}
    commits = spark.createDataFrame([(n, n - 1, int(n == 6)) for n in range(1, 7)], COMMITS)
    log = spark.createDataFrame([(6, 0, "I", 1, "s.b")], KEYED)
    replica.append(one_stream({"s.b": log}, commits), 0)
    assert replica.state("s.c") == IN_STEP and replica.read("s.b").count() == 3 and replica.read("s.a").count() == 1
