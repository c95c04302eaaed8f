"""Sharding with size-tiered compaction and a versioned manifest.

* `append` writes an arrival as small immutable shards; existing files are never touched.
* `compact` merges runs of similarly sized shards: shards fall into tiers by the power of
  `fan_in` of their size, and a tier with `fan_in` shards or more is rewritten into files
  of about `target_bytes`. Rewriting reads and writes without a shuffle.
* Each change is committed by putting the next manifest in place with one rename that
  fails if the version exists; readers see the old or the new list of shards, never a mix.
  A writer that lost the race raises CommitConflict, and its files are not listed.

The manifest is a table (one row a shard), so its size and the tiers are worked out by
Spark; the driver holds the paths of one merge (MERGE_SHARDS, the smallest first; merges
follow each other until no tier is due), and those of the shards that are read. `vacuum`
deletes the folders that no kept version lists and no writer is at work on: a writer leaves a
note before its first file and takes it away after its commit, and `vacuum` reads folders,
notes and versions in this order, so what it finds without a note is committed or was given
up. Notes older than ABANDONED_S count as given up. Renames must be atomic (HDFS, local
disks); an object store needs a committer that makes them so.

Defined results: every row appended is read back once, as it was, repeated rows and nulls
too; an empty arrival commits a version without new shards; any columns are kept.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import fresh_path

TARGET_BYTES = 128 << 20
FAN_IN = 4
#: Rows of an arrival's shards, at most.
SHARD_ROWS = 4096
#: Shards of one merge, at most.
MERGE_SHARDS = 10_000
#: Seconds after which a writer that has not committed is given up.
ABANDONED_S = 24 * 3600.0
_MANIFEST = "path string, bytes long, tier int, added long"


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(
        self, spark: SparkSession, root: str, *, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, shard_rows: int = SHARD_ROWS
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.shard_rows = target_bytes, fan_in, shard_rows
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _version_path(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:010d}"

    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        at = self._path(f"{self.root}/manifest")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max([int(n[1:]) for n in names if n.startswith("v")], default=0)

    def shards(self, version: int | None = None) -> DataFrame:
        """The manifest of a version: path, bytes, tier, added (the version that wrote the shard)."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(self._version_path(version))

    def _tier(self):  # noqa: ANN202
        return F.floor(F.log(float(self.fan_in), F.greatest(F.col("bytes"), F.lit(1)).cast("double"))).cast("int")

    def _files(self, folder: str, version: int) -> DataFrame:
        """The data files of a folder, listed by Spark's file source without opening them."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
        return files.select("path", F.col("length").alias("bytes")).withColumn("tier", self._tier()).withColumn(
            "added", F.lit(version).cast("long")
        )

    def _commit(self, manifest: DataFrame, version: int) -> int:
        """Put version + 1 in place, if nobody has."""
        draft = f"{self.root}/drafts/{fresh_path(self.spark, 'm').rsplit('/', 1)[1]}"
        manifest.coalesce(1).write.parquet(draft)
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        final = self._path(self._version_path(version + 1))
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        never_over = sc._gateway.new_array(hadoop.Options.Rename, 0)  # a rename that fails if the version is there
        if self.version() > version:
            raise CommitConflict(f"version {version + 1} exists")
        try:
            files.rename(self._path(draft), final, never_over)
        except Exception as e:
            if self._fs.exists(final):
                raise CommitConflict(f"version {version + 1} exists") from e
            raise
        return version + 1

    @contextmanager
    def _new_folder(self, prefix: str) -> Iterator[str]:
        """The name of a folder that no vacuum takes away inside the block."""
        folder = fresh_path(self.spark, prefix).rsplit("/", 1)[1]
        note = self._path(f"{self.root}/writing/{folder}")
        self._fs.create(note, False).close()
        yield folder
        self._fs.delete(note, False)  # stays if the block fails: its files are given up with it

    def append(self, arrival: DataFrame) -> int:
        """Write an arrival as small shards and commit them; returns the new version."""
        version = self.version()
        with self._new_folder("a") as folder:
            arrival.write.option("maxRecordsPerFile", self.shard_rows).parquet(f"{self.root}/data/{folder}")
            return self._commit(self.shards(version).unionByName(self._files(f"{self.root}/data/{folder}", version + 1)), version)

    def compact(self) -> int:
        """Merge tiers until none has `fan_in` shards below the target size; returns the version."""
        while True:
            version = self.version()
            shards = self.shards(version)
            small = shards.where(F.col("bytes") < self.target_bytes // 2)
            tiers = small.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
            due = tiers.where(F.col("n") >= self.fan_in).orderBy("tier").first()
            if due is None:
                return version
            merged = small.where(F.col("tier") == due["tier"]).orderBy("bytes", "path").limit(MERGE_SHARDS).select("path", "bytes").collect()
            files = max(1, math.ceil(sum(r["bytes"] for r in merged) / self.target_bytes))
            rows = self.spark.read.parquet(*[r["path"] for r in merged])
            left = shards.join(self.spark.createDataFrame([(r["path"],) for r in merged], "path string"), "path", "left_anti")
            with self._new_folder("c") as folder:
                rows.coalesce(files).write.parquet(f"{self.root}/data/{folder}")
                self._commit(left.unionByName(self._files(f"{self.root}/data/{folder}", version + 1)), version)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        paths = [r["path"] for r in self.shards(version).select("path").orderBy("path").toLocalIterator()]
        if not paths:
            raise ValueError("this version has no shards")
        return self.spark.read.parquet(*paths)

    def _in_work(self) -> set[str]:
        """The folders that writers are at work on."""
        at, now = self._path(f"{self.root}/writing"), time.time()
        notes = self._fs.listStatus(at) if self._fs.exists(at) else []
        return {n.getPath().getName() for n in notes if now - n.getModificationTime() / 1000 < ABANDONED_S}

    def vacuum(self, versions: int = 1) -> int:
        """Delete the folders that none of the last `versions` versions lists, but for those in work; how many went."""
        at = self._path(f"{self.root}/data")
        folders = [s.getPath() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        in_work, last = self._in_work(), self.version()
        live = set(in_work)
        for v in range(max(1, last - versions + 1), last + 1):
            folder = F.element_at(F.split("path", "/"), -2)
            live |= {r["f"] for r in self.shards(v).select(folder.alias("f")).distinct().collect()}  # a row for each arrival or merge
        gone = [path for path in folders if path.getName() not in live]
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)


#: Arrivals that the query deals its table into.
ARRIVALS = 4


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """documents arrive in parts as small shards, are compacted, and are read back through the manifest."""
    store, docs = ShardStore(spark, fresh_path(spark, "shards")), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
    store.compact()
    store.vacuum()
    return store.read().select(
        "doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


OP2_SQL = "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents"
