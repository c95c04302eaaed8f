"""Even chunks of any key, and copies that are resumed."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from driftwell.operators import bulk_copy
from driftwell.operators.key_ranges import KeyRange, file_groups, key_ranges, read_key_ranges, with_range
from driftwell.plans.bootstrap import CopyFailed, Database, bootstrap, move
from driftwell.plans.journal import Chunk, CopyJournal, chunks_of_database, chunks_of_files, chunks_of_frame
from driftwell.sources.jdbc import Endpoint, write_table


def test_skewed_keys_in_even_chunks(spark, tmp_path):
    rows = spark.range(1000).union(spark.createDataFrame([(10**9,)], "id long"))
    ranges = key_ranges(rows, ["id"], 8)
    assert len(ranges) == 8 and ranges[0].low is None and ranges[-1].high is None
    sizes = [rows.where(r.column()).count() for r in ranges]
    assert sum(sizes) == 1001 and max(sizes) <= 1.3 * 1001 / 8
    assert [r["count"] for r in with_range(rows, ranges).groupBy("chunk_no").count().orderBy("chunk_no").collect()] == sizes
    written = bulk_copy.copy_in_ranges(rows, f"{tmp_path}/c", ["id"], 8)
    assert sorted(r.n for r in written.collect()) == sorted(sizes)
    plan = spark._jvm.PythonSQLUtils.explainString(spark.read.parquet(f"{tmp_path}/c").where(ranges[1].column())._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(id" in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_keys_of_several_columns_and_nulls(spark, seed):
    """Every row is in one range, rows with nulls too, whatever the types; ranges are in order."""
    rng = random.Random(seed)
    pick = lambda: (rng.choice(["a'b", "b", "é", None, "c d"]), rng.choice([None, datetime.date(2024, 1, rng.randrange(1, 28))]), rng.randrange(50))
    rows = spark.createDataFrame([pick() for _ in range(600)], "s string, d date, n int")
    ranges = key_ranges(rows, ["s", "d", "n"], 5)
    assert len(ranges) == 5
    tagged = with_range(rows, ranges).withColumn("held", sum((r.column().cast("int") for r in ranges), F.lit(0)))
    assert tagged.where("held <> 1").isEmpty()
    for k, r in enumerate(ranges):
        assert rows.where(r.column()).count() == tagged.where(F.col("chunk_no") == k).count() == rows.where(r.sql().replace('"', "`")).count()


def test_few_rows_and_one_key(spark):
    assert key_ranges(spark.range(0), ["id"], 4) == [KeyRange(("id",), None, None)]
    hot = spark.range(100).select(F.lit(7).alias("id"))
    assert sum(hot.where(r.column()).count() for r in key_ranges(hot, ["id"], 4)) == 100
    assert KeyRange(("id",), None, None).sql() == "1 = 1"


def test_ranges_of_a_database(spark, tmp_path):
    at = Endpoint("", url=f"jdbc:derby:{tmp_path}/db;create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", session_init="")
    rows = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("id"), (F.col("id") % 9).alias("kind"))
    write_table(rows, at, "t", "overwrite")  # Spark quotes the names of the columns it makes
    ranges = key_ranges(rows, ["kind", "id"], 5)
    parallel = read_key_ranges(spark, at, "t", ranges)
    assert parallel.rdd.getNumPartitions() == 5 and sorted(map(tuple, parallel.collect())) == sorted(map(tuple, rows.collect()))
    journal = CopyJournal(spark, f"{tmp_path}/j")
    done = journal.copy("s", "t", chunks_of_database(spark, at, "t", ranges))
    assert done.rows == 1000 and done.read == [f"{k:06d}" for k in range(5)] and journal.read("s", "t").distinct().count() == 1000


def test_files_in_groups(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(f"{tmp_path}/t")
    groups = file_groups(spark, f"{tmp_path}/t", 3)
    assert len(groups) == 3 and sum(map(len, groups)) == 7
    done = CopyJournal(spark, f"{tmp_path}/j").copy("s", "t", chunks_of_files(spark, f"{tmp_path}/t", 3))
    assert done.rows == 1000 and len(done.read) == 3


def test_a_rerun_copies_the_rest(spark, tmp_path):
    rows, reads, broken = spark.range(400).withColumn("v", F.col("id") * 2), [], {"000002", "000003"}

    def counted(chunk):
        def read():
            reads.append(chunk.name)
            if chunk.name in broken:
                raise OSError("lost")
            return chunk.read()

        return Chunk(chunk.name, read)

    chunks = [counted(c) for c in chunks_of_frame(rows, ["id"], 5)]
    make = lambda: Database("d", {"t": rows, "u": rows}, "", snapshot="s1", journal=CopyJournal(spark, f"{tmp_path}/j"), chunks={"t": chunks})
    started = []
    with pytest.raises(CopyFailed):
        move(spark, make())
    journal = CopyJournal(spark, f"{tmp_path}/j")
    assert journal.current() is None and len(journal.chunks_in("s1", "t")) == 3
    with pytest.raises(ValueError, match="published"):
        journal.table("t")
    reads.clear()
    broken.clear()
    db = make()
    db.start_stream = started.append
    assert bootstrap(spark, [db])[0].copied == {"t": 400, "u": 400}
    assert sorted(reads) == ["000002", "000003"] and started == [0]
    assert journal.current() == "s1" and journal.table("t").agg(F.sum("v")).first()[0] == 2 * sum(range(400))
    reads.clear()
    move(spark, make())
    assert reads == []
    # Another snapshot copies all again, and takes the place of the first when it is whole.
    db = make()
    db.snapshot, db.chunks = "s2", {}
    db.tables = {t: df.where("id < 10") for t, df in db.tables.items()}
    move(spark, db)
    assert journal.current() == "s2" and journal.table("u").count() == 10
    journal.forget("s1")
    with pytest.raises(ValueError, match="published"):
        journal.forget("s2")


def test_a_chunk_that_stopped_before_its_mark_counts_for_nothing(spark, tmp_path):
    journal = CopyJournal(spark, f"{tmp_path}/j")
    spark.range(5).write.parquet(f"{tmp_path}/j/s/t/all-dead")
    assert journal.chunks_in("s", "t") == []
    assert journal.copy("s", "t", [Chunk("all", lambda: spark.range(3))]).rows == 3 and journal.read("s", "t").count() == 3
