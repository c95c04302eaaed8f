"""MinHash near-dedup by tensored banding: table keys are pairs of smaller keys.

Documents link when 100 * |A and B| >= 80 * |A or B| over their distinct 4-word shingles.

1. One pass makes each row's set (64-bit shingle hashes), a 128-bit digest of it and its small
   keys: two collections of SIDE keys, each of WIDTH minhashes. Rows with one digest are a class;
   only classes go on.
2. A table's key is a key of the first collection with one of the second, so SIDE * SIDE tables of
   2 * WIDTH minhashes each need 2 * SIDE * WIDTH minhashes in all: 120, where banding without
   tensoring computes 2400. Two sets of similarity s meet in a table unless one collection has no
   key in common: 2 * (1 - s ** WIDTH) ** SIDE at most, 1.2e-6 at s = 0.8 and 1.1e-8 at 0.85.
3. A table's bucket has two members only where both small keys are shared, so small keys are counted
   first (a class sends each once; what is shared is told by a minimum and a maximum, which combine before
   the shuffle) and pairs are formed of shared keys alone: a document that resembles no other forms none.
4. Buckets are compared in blocks, never as rows of all pairs: `jaccard_join.linked_in_lists`. Few tables come
   first, then more, then all: what the first connect is one component in the others' buckets, a bucket
   of one component is done, and keys that only one component has form no pairs any more. Of tables whose
   buckets hold the same members one is enough. Candidates pass a parity bitmap and are then
   verified on their full sets, so a link that is reported is one.

Defined results: a text with fewer words than a shingle is one shingle of all its words; null and
wordless texts have an empty set, link with nothing and are their own component; repeated rows are
copies; rows with a null id get the smallest non-null id of their component; a text of any length is
worked on whole (its set is held by one task, sliced by SLICE_BYTES otherwise); an empty table gives
an empty result; columns besides id and text may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard_join import ROWS, _mix, _utf8, linked_in_lists, set_digest, sets_of, shingle_sets
from .workspace import located, numbered, release, scratch, sized, sliced, stored, without_rows, written

SHINGLE, SHARE = 4, 80
#: Small keys of a collection, and minhashes of a small key.
SIDE, WIDTH = 20, 3
_SEED = np.uint64(0xA0761D6478BD642F)


def _hashes(count: int) -> tuple[np.ndarray, np.ndarray]:
    """A mask and an odd factor for each minhash."""
    at = np.arange(1, count + 1, dtype=np.uint64)
    return _mix(at * _SEED), _mix(at + _SEED) | np.uint64(1)


def small_keys(sets: list[np.ndarray], side: int = SIDE, width: int = WIDTH) -> np.ndarray:
    """2 * side keys of each set (none of them may be empty); those of the second collection come after the first's."""
    masks, factors = _hashes(2 * side * width)
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    keys = np.empty((len(sets), 2 * side), np.uint64)
    for k in range(2 * side):
        key = np.full(len(sets), k + 1, np.uint64)
        for j in range(k * width, (k + 1) * width):
            key = _mix(key * _SEED + np.minimum.reduceat((flat ^ masks[j]) * factors[j], starts))
        keys[:, k] = key
    return keys


def sketched(rows: DataFrame, side: int = SIDE, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """_row, id, n (set size), digest, digest2, keys; the last three are null for the empty set."""
    kind = rows.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS, 2):
            sets = shingle_sets(_utf8(batch.column(2)), shingle)
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            digests = [set_digest(s) if len(s) else (0, 0) for s in sets]
            keys = np.zeros((len(sets), 2 * side), np.uint64)
            if len(full):
                keys[full] = small_keys([sets[i] for i in full.tolist()], side, width)
            places = pa.array(np.arange(len(sets) + 1) * 2 * side, pa.int32())
            lists = pa.ListArray.from_arrays(places, pa.array(keys.reshape(-1).view(np.int64)), mask=pa.array(n == 0))
            halves = [pa.array(np.array([d[k] for d in digests], np.int64), mask=n == 0) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), *halves, lists], ["_row", "id", "n", "digest", "digest2", "keys"])

    return stored(rows.mapInArrow(sketch, f"_row long, id {kind}, n long, digest long, digest2 long, keys array<long>"), "sketched", keep=True)


#: How many tables of the diagonal come first, and then: all that pair a key with the one of its number.
FIRST_TABLES = 4


def shared_keys(small: DataFrame, side: int = SIDE) -> DataFrame:
    """cls, a, b: of each class the keys (k, key) of both collections that another component has, too, if there are
    some of both. small: cls, component, k, key."""
    shared = small.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    held = small.drop("component").join(sized(stored(shared.select("key"), "shared-keys")), "key")
    of = lambda own: F.array_compact(F.collect_list(F.when(own, F.struct("k", "key"))))  # noqa: E731  of a class: `side` at most
    both = held.groupBy("cls").agg(of(F.col("k") < side).alias("a"), of(F.col("k") >= side).alias("b"))
    return stored(both.where((F.size("a") > 0) & (F.size("b") > 0)), "held-keys")


def tensored(held: DataFrame, side: int = SIDE) -> DataFrame:
    """i, j (the table's keys), token, cls: the tables' entries of the classes of `shared_keys`."""
    pairs = held.select("cls", "b", F.explode("a").alias("a")).select("cls", "a", F.explode("b").alias("b"))
    return pairs.select(F.col("a.k").alias("i"), (F.col("b.k") - side).alias("j"), F.xxhash64("a.key", "b.key").alias("token"), "cls")


def different_buckets(tables: DataFrame) -> DataFrame:
    """The entries of buckets with several members, and of those with the same members one (told by two 64-bit hashes of them)."""
    members = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"s{k}") for k in (1, 2)]
    buckets = tables.groupBy("token").agg(F.count(F.lit(1)).alias("m"), *members).where("m > 1")
    return tables.join(buckets.groupBy("m", "s1", "s2").agg(F.min("token").alias("token")).select("token"), "token", "left_semi")


def linked_in_tables(held: DataFrame, sets: DataFrame, share: int, side: int = SIDE) -> DataFrame:
    """cls, component of the classes that link, by few tables first; held: see `shared_keys`.

    A bucket is in one component unless both of its keys are in several, so before each further step only keys that
    components share are left.
    """
    labels, nothing = None, F.lit(0).cast("long")
    for some in ((F.col("i") == F.col("j")) & (F.col("i") < FIRST_TABLES), F.col("i") == F.col("j"), F.lit(True)):
        if labels is not None:
            small = held.select("cls", F.explode(F.concat("a", "b")).alias("p")).select("cls", "p.k", "p.key").join(labels, "cls", "left")
            held = shared_keys(small.withColumn("component", F.coalesce("component", "cls")), side)
        lists = different_buckets(stored(tensored(held, side).where(some), "tensored")).join(sets.select("cls", "n"), "cls")
        lists = stored(lists.select("token", "cls", "n", nothing.alias("own"), nothing.alias("place")), "tables")
        found = linked_in_lists(lists, sets, share, labels)
        labels = stored(found, "linked") if labels is None else found
    return labels


def find_near(docs: DataFrame, *, share: int = SHARE, shingle: int = SHINGLE, side: int = SIDE, width: int = WIDTH) -> DataFrame:
    """_row, id, n_shingles, component_id, component (of classes; null for the empty set) for each row of docs."""
    written(docs)
    rows = numbered(docs, F.col("doc_id").alias("id"), "text")
    with scratch(docs.sparkSession):
        member = sketched(rows, side, width, shingle)
        found = member.where("digest is not null")
        classes = stored(
            found.groupBy("digest", "digest2").agg(F.min("_row").alias("cls"), F.max("n").alias("n"), F.min("id").alias("least")), "classes", keep=True
        )
        small = classes.join(found.select(F.col("_row").alias("cls"), "keys"), "cls").select("cls", F.posexplode("keys").alias("k", "key"))
        held = shared_keys(small.withColumn("component", F.col("cls")), side)
        release(docs.sparkSession)
        sets = sets_of(rows, held.select(F.col("cls").alias("_row")), shingle)
        linked = stored(linked_in_tables(held, sets, share, side), "linked", keep=True)
    named = classes.join(linked, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("digest", "digest2", "component", "component_id")
    columns = ["_row", "id", F.col("n").alias("n_shingles")]
    empty = member.where("digest is null").select(*columns, F.col("id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return found.join(named, ["digest", "digest2"]).select(*columns, "component_id", "component").unionByName(empty)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component, the smallest id's first; rows without words all stay."""
    written(docs)
    with scratch(docs.sparkSession):
        near = stored(find_near(docs, **options), "near").where("component is not null")
        first = near.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "_row")).alias("first"))
        dropped = near.join(first, "component").where(F.col("_row") != F.col("first._row"))
        dropped = stored(dropped.select("_row"), "near-copies", keep=True)
    return without_rows(docs, dropped)


def op11_minhash(spark, sf_dir: str) -> DataFrame:
    docs = located(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return find_near(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
reach AS (SELECT x AS id, y AS r FROM links UNION SELECT reach.id, links.y FROM reach JOIN links ON reach.r = links.x),
least_id AS (SELECT id, min(r) AS r FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(r, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(r, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_id ON least_id.id = d.doc_id
"""
