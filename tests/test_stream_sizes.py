"""What one task of a stream holds: files, changes and sums are dealt, with the same rows."""

from pyspark.sql import functions as F

from driftwell import stream_queries as Q
from driftwell.streaming import tables
from driftwell.streaming.tables import RowTable

LOG = "lsn long, seq long, op string, k int, v string"


def test_a_part_comes_in_several_files_in_few_batches(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        rows = spark.range(0, 40000, 1, 4).select(F.col("id").alias("lsn"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        Q._files(rows, f"{tmp_path}/log", ["lsn < 20000", "lsn >= 20000"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    written = spark.read.parquet(f"{tmp_path}/log")
    per_file = written.groupBy(F.input_file_name()).count().collect()
    assert len(per_file) > 2 and max(r[1] for r in per_file) < 20000 and written.exceptAll(rows).isEmpty() and written.count() == 40000
    seen = []
    stream = Q._streamed(spark, f"{tmp_path}/log", rows.schema, 2).writeStream.foreachBatch(lambda b, _: seen.append(b.count()))
    stream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 2 and sum(seen) == 40000


def test_rows_are_appended_without_being_kept(spark, tmp_path):
    table = RowTable(spark, f"{tmp_path}/t", spark.createDataFrame([], "k int, v string").schema)
    logged = table._logged(spark.createDataFrame([(1, 0, "I", 1, "a"), (1, 0, "I", 1, "a"), (2, 0, "D", 1, "a")], LOG))
    assert "Exchange" not in logged._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.n for r in logged.collect()) == [-1, 1, 1]


def test_sums_of_many_rows_are_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SUM_ROWS", 100)
    table = RowTable(spark, f"{tmp_path}/t", spark.createDataFrame([], "k int, v string").schema)
    every = spark.range(0, 3000, 1, 2).select(F.col("id").alias("lsn"), F.col("id").alias("seq"), F.lit("I").alias("op"), F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).cast("int").alias("k"), F.lit("v").alias("v"))
    table.append(every, 0)
    table.append(every.where("k % 2 = 1").withColumn("op", F.lit("D")).where("lsn % 4 = 1").withColumn("lsn", F.col("lsn") + 5000), 1)
    plan = table._summed(table.changes())._jdf.queryExecution().executedPlan().toString()
    assert "_deal" in plan and "REPARTITION_BY_NUM" in plan
    found = {r.k: r.n for r in table.read().groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found[7] == 1500 and 2001 not in found and found[2003] == 1 and len(found) == 751 and table.compact()
    assert table.read().count() == 1500 + 750
