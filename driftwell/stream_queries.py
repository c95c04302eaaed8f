"""The registered queries of streams: whole tables come as files in any order, are applied batch by batch, and read back."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .operators import changes as C
from .operators import status
from .operators.integrity import foreign_key_violations
from .registry import query
from .sources.tables import shared_path, table
from .streaming import high_water, progress
from .streaming.apply import start_apply
from .streaming.replica import Replica, one_stream
from .streaming.tables import table_for

#: Orders that one commit takes in, with their lines; files that a table's changes come in, at least, and the rows that one holds, at most.
COMMIT_ORDERS, FILES, FILE_ROWS = 256, 6, 1_000_000


def _commit(key: str):  # noqa: ANN202
    return F.floor(F.col(key) / COMMIT_ORDERS).cast("long") + 1


def _files(rows: DataFrame, path: str, parts: list[str], by: str = "lsn") -> None:
    """Files for each condition, which come in this order: one where there are few rows, else as many as their bytes ask for."""
    for part in parts:
        rows.where(part).hint("rebalance", by).write.mode("append").parquet(path)


def _enough(rows: DataFrame, files: int) -> int:
    """How many files, if none may hold more than FILE_ROWS."""
    return max(files, -(-rows.count() // FILE_ROWS))


def _streamed(spark: SparkSession, path: str, schema: StructType, batches: int) -> DataFrame:
    """The files that are there, and those that come later, in about so many batches as the first are cut into."""
    files = len(spark.read.schema(schema).parquet(path).inputFiles())
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(path)


def _commits(logs: list[DataFrame]) -> DataFrame:
    """lsn, prev, n of the commits of some logs. Positions without a change are commits of none."""
    counts = logs[0].select("lsn")
    for log in logs[1:]:
        counts = counts.unionByName(log.select("lsn"))
    counts = counts.groupBy("lsn").agg(F.count(F.lit(1)).alias("n"))
    last = counts.agg(F.max("lsn")).first()[0] or 0
    every = counts.sparkSession.range(1, last + 1).withColumnRenamed("id", "lsn")
    return every.join(counts, "lsn", "left").select("lsn", (F.col("lsn") - 1).alias("prev"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _ranges(last: int, order: list[int]) -> list[str]:
    """Conditions that cut the positions into len(order) ranges, in this order."""
    size = -(-(last + 1) // len(order))
    return [f"lsn >= {k * size} AND lsn < {(k + 1) * size}" for k in order]


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT 'orders' AS table_name, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS keys, 0 AS violations FROM orders WHERE o_orderkey % 11 <> 0
UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT), 0 FROM l WHERE l_orderkey % 11 <> 0""")
def r14_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines come in commits, and some go again; at no epoch is there a line without its order.

    Each table's files come in an order of their own, so most batches have lines whose orders come later.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    last = orders.agg(F.max(_commit("o_orderkey"))).first()[0]
    logs = {}
    for name, rows, key in (("orders", orders, "o_orderkey"), ("lineitem", lines, "l_orderkey")):
        at = F.lit(0) if name == "orders" else F.col("l_linenumber")
        made = rows.select(_commit(key).alias("lsn"), (F.col(key) * 10 + at).cast("long").alias("seq"), F.lit("I").alias("op"), *rows.columns)
        gone = made.where(F.col(key) % 11 == 0).withColumns({"lsn": F.col("lsn") + last, "op": F.lit("D")})  # later, order and lines in one commit
        logs[name] = made.unionByName(gone)
    commits, path = _commits(list(logs.values())), {t: shared_path(spark, f"{t}-log") for t in ("orders", "lineitem", "commits")}
    _files(logs["orders"], path["orders"], _ranges(2 * last, [0, 2, 1, 3, 5, 4]))
    _files(logs["lineitem"], path["lineitem"], _ranges(2 * last, [1, 0, 3, 2, 4, 5]))
    _files(commits, path["commits"], _ranges(2 * last, [0, 1, 2, 4, 3, 5]))
    replica = Replica(spark, shared_path(spark, "replica"))
    replica.track("orders", orders.schema, ["o_orderkey"], copied=False)
    replica.track("lineitem", lines.schema, [], copied=False)  # lines may be the same
    stream = one_stream({t: _streamed(spark, path[t], logs[t].schema, FILES) for t in logs}, _streamed(spark, path["commits"], commits.schema, FILES))
    start_apply(stream, replica, shared_path(spark, "replica-checkpoint")).awaitTermination()
    bad = None
    for epoch in range(replica.latest() + 1):
        found = foreign_key_violations(replica.read("lineitem", epoch), replica.read("orders", epoch), ["l_orderkey"], ["o_orderkey"]).agg(F.count(F.lit(1)).alias("n"))
        bad = found if bad is None else bad.unionByName(found)
    violations = bad.agg(F.max("n").cast("int").alias("violations"))
    replica.compact()
    counts = [
        replica.read(t).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(key).alias("keys")).select(F.lit(t).alias("table_name"), "n_rows", "keys")
        for t, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"))
    ]
    return counts[0].unionByName(counts[1]).crossJoin(F.broadcast(violations))  # a row for each of two tables


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, 'copying, catching up, in step' AS states
FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT o_orderkey + 10000000, o_totalprice, 'copying, catching up, in step' FROM orders WHERE o_orderkey % 3 = 0""")
def r11_hand_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders join a stream that runs: changes before, at and after the copy's position come in files of any order, and a restart in between."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    key, c = F.col("o_orderkey"), _commit("o_orderkey")
    last = orders.agg(F.max(c)).first()[0]
    change = lambda rows, lsn, op: rows.select(lsn.alias("lsn"), key.alias("seq"), F.lit(op).alias("op"), "o_orderkey", "o_totalprice")
    raised = orders.where(key % 5 == 0).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    log = change(raised, c, "U").unionByName(change(orders.where(key % 7 == 0), c + last, "D"))
    log = log.unionByName(change(orders.where(key % 3 == 0).withColumn("o_orderkey", key + 10000000), F.pmod(key, F.lit(2 * last)) + 1, "I"))
    commits, path = _commits([log]), {t: shared_path(spark, f"{t}-log") for t in ("orders", "commits")}
    position, ranges = last, _ranges(2 * last, [2, 0, 1, 5, 3, 4])  # the copy is taken within the third range
    root, checkpoint, schema = shared_path(spark, "replica"), shared_path(spark, "replica-checkpoint"), orders.schema

    def run(parts: int) -> Replica:
        """A new process: what it knows is in the folder and the checkpoint."""
        replica = Replica(spark, root)
        stream = one_stream({"orders": _streamed(spark, path["orders"], log.schema, parts)}, _streamed(spark, path["commits"], commits.schema, parts))
        start_apply(stream, replica, checkpoint).awaitTermination()
        return Replica(spark, root)

    Replica(spark, root).track("orders", schema, ["o_orderkey"])
    for part in ranges[:2]:
        _files(log, path["orders"], [part])
        _files(commits, path["commits"], [part])
    replica = run(2)
    states = [replica.state("orders")]
    at_position = C.apply_keyed(orders, log.where(F.col("lsn") <= position), ["o_orderkey"])
    states.append(replica.hand_over("orders", schema, ["o_orderkey"], lambda: (at_position, position)))
    for part in ranges[2:]:
        _files(log, path["orders"], [part])
        _files(commits, path["commits"], [part])
    replica = run(len(ranges))
    states.append(replica.state("orders"))
    return replica.read("orders").withColumn("states", F.lit(", ".join(states)))


@query("""
WITH b AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
d AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2)
SELECT l_orderkey, l_returnflag FROM (SELECT b.l_orderkey, b.l_returnflag, unnest(range(b.n - coalesce(d.n, 0))) AS i
  FROM b LEFT JOIN d ON b.l_orderkey = d.l_orderkey AND b.l_returnflag = d.l_returnflag)""")
def r14_stream_keyless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without a key: inserts and deletes of full rows come as files in any order, deletes before their inserts too."""
    lines = table(spark, sf_dir, "lineitem")
    columns = ["l_orderkey", "l_returnflag"]
    place = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    change = lambda rows, op, later: rows.select((_commit("l_orderkey") + later).alias("lsn"), place.alias("seq"), F.lit(op).alias("op"), *columns)
    log = change(lines, "I", 0).unionByName(change(lines.where("l_linenumber = 1"), "D", 1))
    at = shared_path(spark, "lines-log")
    log.repartition(_enough(log, FILES), "seq").write.parquet(at)
    target = table_for(spark, shared_path(spark, "lines"), lines.select(*columns).schema, [])
    start_apply(_streamed(spark, at, log.schema, FILES // 2), target, shared_path(spark, "lines-checkpoint")).awaitTermination()
    target.compact()
    return target.read()


@query("SELECT c_nationkey AS key, max(c_custkey) AS value_after, TRUE AS only_forward FROM customer GROUP BY 1")
def x07_streamed_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's greatest customer number, brought forward on the target while customers come in files of any order, with a restart."""
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    at, written, checkpoint = shared_path(spark, "customers"), shared_path(spark, "marks"), shared_path(spark, "marks-checkpoint")
    first = customers.where("c_custkey % 7 = 0").groupBy(F.col("c_nationkey").alias("key")).agg(F.max("c_custkey").alias("last_value"))
    first.withColumn("batch", F.lit(-1).cast("long")).write.parquet(written)

    def targets() -> DataFrame:
        return spark.read.parquet(written).groupBy("key").agg(F.max("last_value").alias("last_value"))

    def write(rows: DataFrame, batch: int) -> None:
        rows.select("key", F.col("new_value").alias("last_value"), F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(written)

    customers.limit(0).write.parquet(at)
    for batches, parts in ((3, ["c_custkey % 4 = 3", "c_custkey % 4 = 0"]), (5, ["c_custkey % 4 = 2", "c_custkey % 4 = 1"])):
        _files(customers, at, parts, "c_custkey")
        high_water.keep_up(_streamed(spark, at, customers.schema, batches), "c_nationkey", "c_custkey", targets, write, checkpoint).awaitTermination()
    rows = spark.read.parquet(written)
    later = rows.select(F.col("key").alias("k"), F.col("last_value").alias("v"), F.col("batch").alias("b"))
    back = rows.join(later, (F.col("key") == F.col("k")) & (F.col("b") > F.col("batch")) & (F.col("v") <= F.col("last_value")), "left_semi")
    return rows.groupBy("key").agg(F.max("last_value").alias("value_after")).withColumn("only_forward", F.lit(back.isEmpty()))


@query("""
SELECT 'customer' AS database, count(*) AS received, 'stopped' AS state, 'reserved' AS wal_status, FALSE AS failed FROM customer
UNION ALL SELECT 'nation', 0, 'failed', 'lost', TRUE UNION ALL SELECT 'orders', count(*), 'stopped', 'reserved', FALSE FROM orders""")
def m03_stream_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams that run to their end and one that fails, as a listener saw them, in the sections of a status."""
    names, listener = ["customer", "nation", "orders"], progress.ProgressListener()

    def apply(name: str):  # noqa: ANN202
        def taken(batch: DataFrame, batch_id: int) -> None:
            if name == "nation":
                raise OSError("the target is gone")
            batch.write.format("noop").mode("overwrite").save()

        return taken

    spark.streams.addListener(listener)
    try:
        started = []
        for name in names:
            at, rows = shared_path(spark, name), table(spark, sf_dir, name)
            rows.repartition(_enough(rows, 3)).write.parquet(at)
            writer = _streamed(spark, at, rows.schema, 2).writeStream.queryName(f"move_{name}").foreachBatch(apply(name))
            started.append(writer.option("checkpointLocation", shared_path(spark, f"{name}-checkpoint")).trigger(availableNow=True).start())
        for query_ in started:
            try:
                query_.awaitTermination()
            except StreamingQueryException:
                pass  # the listener has the reason
        listener.wait_until_ended([str(q.runId) for q in started])
    finally:
        spark.streams.removeListener(listener)
    found = status.collect_sections(spark.createDataFrame([(n,) for n in names], "database string"), listener.sections(spark, "move_"))
    return found.select(
        "database", F.col("subscription")[0]["received"].alias("received"), F.col("lag")[0]["state"].alias("state"),
        F.col("slots")[0]["wal_status"].alias("wal_status"), F.contains(F.coalesce(F.col("subscription")[0]["error"], F.lit("")), F.lit("the target is gone")).alias("failed"),
    )
