"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Documents link when 100 * |A and B| >= 75 * |A or B| over their distinct 5-word shingles.

1. One pass makes each row's set (64-bit hashes) and a 128-bit digest of it. Rows with the same
   digest are one class; only classes are joined. A second one makes packed entries of the
   shingles for step 2, which are never written but by its shuffle.
2. A global count of shingles over a sample of the hash space, the same for all sets, finds
   the sets that can have a partner at all: a partner shares 3/4 of a set, so of the
   sampled shingles all but a quarter of the set must occur in another set. What is local
   to a task is counted there; a shingle sends one entry a task at most, however common.
3. The sets that remain are joined by size. A small set is enumerated: two small sets link
   only if they have equal subsets of a fixed size (the overlap that their sizes ask for),
   so equal subset hashes make the candidates. For larger sets inverted lists are scanned,
   over the part of each set that any partner must meet. The boundary is the size at which
   the subsets of the sets up to it and the list entries that the others meet are fewest,
   both counted from the data.
4. A list is never expanded into rows of pairs. Its members are compared by their parity
   bitmaps inside tasks, in pairs of blocks of bounded size, where they are not in one
   component yet, and each goes on with its first 16 likely partners of a block; with 16
   times as many each turn where there are more. Links merge components; a list ends when
   one component is left or all its likely pairs have gone on; only members of pairs that have
   not stay in it. Every pair that is skipped
   is connected already, so the components are exactly those of all links, and a list
   ends within log16(BLOCK_SETS) + 1 turns. The comparison of bitmaps is quadratic in a list's
   members outside its components; the rows are not.
5. Links are counted inside components, in pairs of blocks of bounded size: a pair of blocks
   sends one count for each of its sets, so no pair of documents is ever a row.

Candidates pass the parity bitmap (sets that differ in more bits than their sizes allow can't
link) and are then verified on whole sets. Shingle hashes are 64-bit: two different shingles
of one pair of documents collide with a probability under 1e-13.

Defined results: a text with fewer words than a shingle is one shingle of all its words;
null and wordless texts have an empty set, link with nothing and are their own component;
repeated rows are copies (links by the set, as any other); rows with a null id get the
smallest non-null id of their component; a row's links are the other rows that it links
with, copies too; columns besides id and text may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .workspace import located, numbered, release, scratch, sized, sliced, stored, without_rows, written

SHINGLE, SHARE = 5, 75
#: Share of the hash space that step 2 counts, in 1/1024; sets up to FULL_SIZE are counted whole.
SAMPLE, FULL_SIZE = 358, 64
#: Entries that a task holds before it packs them, and that it sorts at once.
TASK_ENTRIES = 500_000
#: Rows whose sets a task makes at once.
ROWS = 128
#: Sizes that step 3 may enumerate; beyond, a set has more subsets than any table has rows.
MOST_ENUMERATED = 64
#: Cross-component pairs left in lists, for each set and at least, at which all likely ones of the rest go on at once.
REST_PAIRS, REST_LEAST = 1, 50_000
#: Likely partners of a member that go on in the first turn, and how many times more in each turn; the pairs that a task compares at once.
MORE_LEADS, TASK_PAIRS = 16, 1 << 16
#: Entries of short lists that a task compares together; parity bitmaps that a join broadcasts.
GROUP_ENTRIES, PARITIES = 1 << 14, 100_000
#: Words of the parity bitmap.
PARITY = 16
#: Sets (of a list's, too) and shingles of a block of a component, about; sets of small components that a task counts together.
BLOCK_SETS, BLOCK_SHINGLES, TASK_SETS = 1024, 400_000, 512
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    from xxhash import xxh3_64_intdigest

    known: dict[bytes, int] = {}
    hashes: list[int] = []
    lengths = []
    for text in texts:
        words = text.lower().split()  # bytes: lower-cases A-Z, splits at [\x20\x09-\x0D]
        lengths.append(len(words))
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxh3_64_intdigest(w)
            hashes.append(h)
    flat = np.array(hashes, np.uint64)
    rolled = np.zeros(len(flat), np.uint64)
    for k in range(n):
        part = flat[k:] if k else flat
        rolled[: len(part)] = _mix(rolled[: len(part)] + part * _K[0] + np.uint64(k + 1))
    out, at = [], 0
    for length in lengths:
        if length >= n:
            out.append(np.unique(rolled[at : at + length - n + 1]))
        elif length:
            x = np.zeros(1, np.uint64)
            for k in range(length):
                x = _mix(x + flat[at + k : at + k + 1] * _K[0] + np.uint64(k + 1))
            out.append(_mix(x + np.uint64(length)))
        else:
            out.append(np.empty(0, np.uint64))
        at += length
    return out


def set_digest(tokens: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _counted(s: np.ndarray) -> int:
    return len(s) if len(s) <= FULL_SIZE else int(np.count_nonzero((s >> np.uint64(54)) < SAMPLE))


_BLOB = np.dtype([("token", "<u4"), ("digest", "<i8")])


def _packed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    t, d, c = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(t, kind="stable")
    t, d, c = t[order], d[order], c[order]
    new = np.concatenate([[True], t[1:] != t[:-1]])[: len(t)]
    size = np.diff(np.append(np.flatnonzero(new), len(t)))
    shared = np.repeat(size > 1, size)
    credit, n = np.unique(d[shared & c], return_counts=True)
    # Entries that are not counted for their own set still tell others; 0 stands for "some other set".
    kept = ~shared | new
    t, d = t[kept], np.where(shared | ~c, 0, d)[kept]
    bucket = ((t >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    blob = np.empty(len(t), _BLOB)
    blob["token"], blob["digest"] = (t & np.uint64(0xFFFFFFFF))[order], d[order]
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(edges))
    credits = np.empty(len(credit), _BLOB)
    credits["token"], credits["digest"] = n, credit
    data = [*[blob[edges[b] : edges[b + 1]].tobytes() for b in full], credits.tobytes()]
    own = -1 - (int(credit[0]) % buckets if len(credit) else 0)  # credits are dealt over as many buckets below 0
    return pa.RecordBatch.from_arrays([pa.array(np.append(full, own)), pa.array(data, pa.binary())], ["bucket", "entries"])


def shingled(rows: DataFrame) -> DataFrame:
    """_row, id, n (set size), counted (shingles that step 2 counts), digest, digest2 (null for the empty set)."""
    kind = rows.schema["id"].dataType.simpleString()

    def sets_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS, 2):
            sets = shingle_sets(_utf8(batch.column(2)))
            n = np.array([len(s) for s in sets], np.int64)
            digests = [set_digest(s) for s in sets]
            halves = [pa.array(np.array([d[k] for d in digests], np.int64), mask=n == 0) for k in (0, 1)]
            columns = [batch.column(0), batch.column(1), pa.array(n), pa.array(np.array([_counted(s) for s in sets], np.int64)), *halves]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "id", "n", "counted", "digest", "digest2"])

    return rows.mapInArrow(sets_of_rows, f"_row long, id {kind}, n long, counted long, digest long, digest2 long")


def shingle_entries(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket, entries: blobs of (shingle, set) by bucket of the hash space.

    A shingle that several sets of the task hold is settled here: the sets get credit (buckets below 0), and one
    entry without a set says that it is shared. These are the most bytes that the join makes, so they are not
    written: a pass of its own over the texts sends them straight into the shuffle.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in sliced(batches, ROWS, 2):
            for s in shingle_sets(_utf8(batch.column(2))):
                digest = set_digest(s)
                if not len(s) or digest in seen:
                    continue
                seen.add(digest)
                sampled = (s >> np.uint64(54)) < SAMPLE
                if 3 * len(s) > 4 * FULL_SIZE:  # no set that is counted whole can be its partner
                    s, counted = s[sampled], None
                else:
                    counted = sampled if len(s) > FULL_SIZE else None
                held.append((s, np.full(len(s), digest[0], np.int64), np.ones(len(s), bool) if counted is None else counted))
                size += len(s)
                if size >= TASK_ENTRIES:
                    yield _packed(held, buckets)
                    held, size = [], 0
        if held:
            yield _packed(held, buckets)

    return rows.mapInArrow(entries, "bucket long, entries binary")


def _shared(token: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests, and how many of their shingles another set holds as well (or an entry says so)."""
    order = np.lexsort((digest, token))
    token, digest = token[order], digest[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (digest[1:] != digest[:-1])])[: len(token)]  # copies of a set once
    token, digest = token[new], digest[new]
    first = np.concatenate([[True], token[1:] != token[:-1]])[: len(token)]
    size = np.diff(np.append(np.flatnonzero(first), len(token)))
    told = np.add.reduceat(digest == 0, np.flatnonzero(first)) > 0 if len(token) else np.zeros(0, bool)
    hit = np.repeat(told | (size > 1), size) & (digest != 0)
    return np.unique(digest[hit], return_counts=True)


def credits(blobs: DataFrame) -> DataFrame:
    """digest, credit: how many counted shingles of a set occur in another set (never too few)."""

    def settled(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_buffer(), _BLOB) for x in table.column("entries")]
        if table.column("bucket")[0].as_py() < 0:
            e = np.concatenate(blobs)
            return pa.table({"digest": e["digest"].copy(), "credit": e["token"].astype(np.int64)})
        parts = 1 + sum(map(len, blobs)) // TASK_ENTRIES
        out = []
        for k in range(parts):
            own = [b[b["token"] % parts == k] for b in blobs] if parts > 1 else blobs
            digest, n = _shared(np.concatenate([b["token"] for b in own]), np.concatenate([b["digest"] for b in own]))
            out.append(pa.table({"digest": digest, "credit": n.astype(np.int64)}))
        return pa.concat_tables(out)

    return blobs.groupBy("bucket").applyInArrow(settled, "digest long, credit long").groupBy("digest").agg(F.sum("credit").alias("credit"))


def chosen_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of `shingled`, their classes, and the _row of the classes that can have a partner."""
    with scratch(rows.sparkSession):
        member = stored(shingled(rows), "members", keep=2)
        classes = stored(
            member.where("digest is not null").groupBy("digest", "digest2").agg(
                F.min("_row").alias("cls"), F.max("n").alias("n"), F.max("counted").alias("counted"), F.min("id").alias("least"),
                F.count(F.lit(1)).alias("copies"),
            ),
            "classes", keep=2,
        )
        credit = credits(shingle_entries(rows, max(64, 4 * rows.rdd.getNumPartitions())))
        # Of the counted shingles all but a quarter of the set, at most, are in a partner.
        possible = classes.join(credit, "digest", "left").where(F.coalesce("credit", F.lit(0)) >= F.col("counted") - F.floor(F.col("n") / 4))
        return member, classes, stored(possible.select(F.col("cls").alias("_row")), "possible", keep=1)


def sets_of(rows: DataFrame, chosen: DataFrame, n: int = SHINGLE) -> DataFrame:
    """cls, n, tokens, p0 ... (parity bitmap) of the rows whose number is in `chosen`."""
    chosen = rows.join(sized(chosen), "_row").select("_row", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS, 1):
            found = shingle_sets(_utf8(batch.column(1)), n)
            offsets = np.cumsum([0, *map(len, found)])
            flat = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
            bits = np.zeros((len(found), 64 * PARITY), np.uint8)
            for i, s in enumerate(found):
                bits[i] = np.bincount((s % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
            words = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
                 *[pa.array(np.ascontiguousarray(words[:, k])) for k in range(PARITY)]],
                ["cls", "n", "tokens", *parity],
            )

    parity = [f"p{k}" for k in range(PARITY)]
    return stored(chosen.mapInArrow(sets, "cls long, n long, tokens array<long>, " + ", ".join(f"{p} long" for p in parity)), "candidate-sets")


def least_overlap(s: int, t: int) -> int:
    """The smallest overlap with which sets of sizes s and t link."""
    return -(-SHARE * (s + t) // (100 + SHARE))


def partner_sizes(s: int) -> range:
    return range(-(-SHARE * s // 100), 100 * s // SHARE + 1)


def subset_cost(s: int) -> int:
    """How many subsets a set of this size enumerates."""
    return sum(comb(s, least_overlap(s, t)) for t in partner_sizes(s) if least_overlap(s, t) <= s)


def boundary(entries: DataFrame, sets: DataFrame) -> int:
    """The size up to which sets are enumerated: subsets made and list entries met are fewest together."""
    few = F.col("n") <= MOST_ENUMERATED
    lists = entries.groupBy("token").agg(F.count(F.lit(1)).alias("m"))
    met = entries.where(few).join(lists, "token").groupBy("n").agg(F.sum("m").alias("met"))
    by_size = sets.where(few).groupBy("n").agg(F.count(F.lit(1)).alias("sets")).join(met, "n", "left")
    rows = by_size.collect()  # a row for each size, MOST_ENUMERATED at most
    cost = {0: sum(r["met"] or 0 for r in rows)}
    for size in range(1, MOST_ENUMERATED + 1):
        cost[size] = cost[size - 1] + sum(r["sets"] * subset_cost(size) - (r["met"] or 0) for r in rows if r["n"] == size)
    return min(cost, key=lambda size: (cost[size], size))


def _small_lists(sets: DataFrame, limit: int) -> DataFrame:
    """token, cls, n: equal subsets of small sets, as lists."""

    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, n, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                out = []
                for t in partner_sizes(n):
                    size = least_overlap(n, t)
                    if t > limit or size > min(n, t):
                        continue
                    for subset in combinations(sorted(tokens), size):
                        key = np.array([min(n, t), max(n, t), *subset], np.int64).tobytes()
                        out.append(int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), *[pa.array([x] * len(out), pa.int64()) for x in (cls, n)]], ["token", "cls", "n"])

    return sets.where(F.col("n") <= limit).select("cls", "n", "tokens").mapInArrow(subsets, "token long, cls long, n long")


def _entries(sets: DataFrame) -> DataFrame:
    """token, cls, n, own, place: the shingles of each set that any partner of it must meet.

    Shingles are ordered by how many sets hold them. A partner shares at least one of the
    first n - ceil(3n/4) + 1; those that only one set holds (`own`, in thousandths of the set)
    use up places and make no entry.
    """
    postings = sets.select("cls", "n", F.explode("tokens").alias("token"))
    held = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = postings.join(held, "token")
    places = F.col("n") - F.ceil(F.col("n") * SHARE / 100) + 1
    ordered = shared.groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("by_df"))
    alone = F.col("n") - F.size("by_df")
    left = (places - alone).cast("int")
    entries = ordered.where(left > 0).select(
        "cls", "n", alone.alias("alone"), F.posexplode(F.slice("by_df", F.lit(1), left)).alias("i", "p")
    ).select(
        F.col("p.token").alias("token"), "cls", "n", F.floor(F.col("alone") * 1000 / F.col("n")).alias("own"),
        (F.col("alone") + F.col("i")).alias("place"),
    )
    out = stored(entries, "entries")
    release(sets.sparkSession)  # of the postings' shuffles, the largest of the join
    return out


def _scanned_lists(entries: DataFrame) -> DataFrame:
    """The entries that can matter in their lists.

    Where the first shared shingle has place i (from 0) in a set of n, at most n - i shingles
    are shared, so an entry stays only if that is enough for the smallest partner in its list.
    """
    least = entries.groupBy("token").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1")
    partner = F.greatest("least", F.ceil(F.col("n") * SHARE / 100))
    return entries.join(least, "token").where(_within("n", "place", "n", partner)).drop("least", "m")


def _overlap(a, b, share: int = SHARE):  # noqa: ANN001, ANN202
    """least_overlap, of columns."""
    return F.ceil((a + b) * share / (100 + share) - 1e-9)


def _within(n: str, place: str, a, b, share: int = SHARE):  # noqa: ANN001, ANN202
    """Whether a set whose first shared shingle has this place can reach the overlap that sizes a and b ask for."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.col(place) <= F.col(n) - _overlap(a, b, share)


def verified(pairs: DataFrame, sets: DataFrame, share: int = SHARE) -> DataFrame:
    """Of pairs (a, b) of classes, those that link: their sets have `share` percent in common.

    Only sets that are in a pair are sent.
    """
    pairs = stored(pairs, "pairs")
    sets = sets.join(sized(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()), "cls", "left_semi")

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("cls").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    both = sized(pairs).join(side("b", "n", "tokens"), "b").join(side("a", "n", "tokens"), "a")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(common * 100 >= share * (F.col("a_n") + F.col("b_n") - common)).select("a", "b")


def _likely_in_lists(table: pa.Table, share: int, turn: int, most: int | None) -> pa.Table:
    """a, b: the first `most` likely partners of each member of the group's lists among those before it (of i, for j); and
    a (b is null) and token of the members of those pairs that did not go on, since a member has more.

    Before the first turn's members come those with the fewest shingles of their own, later ones have an order of each turn's.
    """
    token, cls, n, own, place, component, part = (table.column(c).to_numpy() for c in ("token", "cls", "n", "own", "place", "component", "part"))
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    order = np.lexsort((cls, _mix(cls.view(np.uint64) + np.uint64(turn)) if turn else own, part, token))
    token, cls, n, place, component, part = (x[order] for x in (token, cls, n, place, component, part))
    words = [table.column(f"p{k}").to_numpy()[order] for k in range(PARITY)]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    start = np.repeat(first, np.diff(np.append(first, len(token))))
    if i == j:
        end = np.arange(len(token))
    else:
        before = np.repeat(np.add.reduceat(part == i, first, dtype=np.int64), np.diff(np.append(first, len(token))))
        end = np.where(part == j, start + before, start)
    count = end - start
    total = np.concatenate([[0], np.cumsum(count)])
    pairs, more, at = [], [], 0
    while at < len(token):
        to = max(at + 1, int(np.searchsorted(total, total[at] + TASK_PAIRS, side="right")) - 1)
        a = np.repeat(np.arange(at, to), count[at:to])
        b = np.arange(len(a)) - np.repeat(total[at:to] - total[at], count[at:to]) + np.repeat(start[at:to], count[at:to])
        at = to
        fit = component[a] != component[b]
        a, b = a[fit], b[fit]
        overlap = -(-share * (n[a] + n[b]) // (100 + share))
        fit = (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * share) & (place[a] <= n[a] - overlap) & (place[b] <= n[b] - overlap)
        a, b = a[fit], b[fit]
        differ = np.zeros(len(a), np.int64)
        for word in words:
            differ += np.bitwise_count((word[a] ^ word[b]).view(np.uint64))
        fit = differ * (100 + share) <= (100 - share) * (n[a] + n[b])
        a, b = a[fit], b[fit]
        if most is not None:
            late = np.arange(len(a)) - np.searchsorted(a, a) >= most
            more.append(np.unique(np.concatenate([a[late], b[late]])))
            a, b = a[~late], b[~late]
        pairs.append(np.stack([np.minimum(cls[a], cls[b]), np.maximum(cls[a], cls[b])]))
    pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
    more = np.unique(np.concatenate(more)) if more else np.empty(0, np.int64)
    columns = zip((*pairs, None), (cls[more], None, token[more]))
    columns = [pa.concat_arrays([pa.nulls(size, pa.int64()) if x is None else pa.array(x, pa.int64()) for x, size in zip(c, (pairs.shape[1], len(more)))]) for c in columns]
    return pa.table(columns, ["a", "b", "token"])


def likely_in_lists(lists: DataFrame, sets: DataFrame, share: int, turn: int, most: int | None, entries: int) -> DataFrame:
    """a, b, token: see `_likely_in_lists`. lists: token, cls, n, own, place, component, m (members of the list); `entries` in all."""
    parity = sets.select("cls", *[f"p{k}" for k in range(PARITY)])
    parts = F.ceil(F.col("m") / BLOCK_SETS).cast("int")
    # Short lists share tasks; a pair of blocks of a longer one is a group of its own.
    unit = F.when(F.col("m") <= BLOCK_SETS, F.pmod(F.xxhash64("token"), F.lit(max(64, entries // GROUP_ENTRIES)))).otherwise(F.col("token"))
    dealt = lists.withColumn("part", F.pmod(F.xxhash64("cls"), parts).cast("int")).select(
        unit.alias("unit"), "token", "cls", "n", "own", "place", "component", "part", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")
    ).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other")
    group = dealt.join(sized(parity, PARITIES), "cls").groupBy("unit", "i", "j")
    return group.applyInArrow(lambda table: _likely_in_lists(table, share, turn, most), "a long, b long, token long")


def link_components(sets: DataFrame) -> DataFrame:
    """cls, component (a class) for the classes that link with others."""
    entries = _entries(sets)
    limit = boundary(entries, sets)
    lists = _scanned_lists(entries.where(F.col("n") >= min(partner_sizes(limit + 1))))  # with the small sets that a large one may link with
    if limit:
        nothing = F.lit(0).cast("long")
        small = _small_lists(sets, limit).distinct()
        lists = lists.unionByName(small.select("token", "cls", "n", nothing.alias("own"), nothing.alias("place")))
    return linked_in_lists(stored(lists, "lists"), sets)


def linked_in_lists(lists: DataFrame, sets: DataFrame, share: int = SHARE, labels: DataFrame | None = None) -> DataFrame:
    """cls, component (a class) for the classes of lists (token, cls, n, own, place) that link with a member of one of theirs.

    Members get more partners by turns; see step 4. `labels`: what is known to be connected, as a result of this function.
    """
    n_sets = sets.count()
    links = None if labels is None else labels.select(F.col("cls").alias("a"), F.col("component").alias("b")).where("a <> b")
    for turn in range(64):  # a turn with as many partners as a block has members leaves nothing
        if labels is None:
            tagged = lists.withColumn("component", F.col("cls"))
        else:
            tagged = lists.join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        # A list with one component is done. The rest: how many pairs are left.
        by_part = tagged.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
        state = by_part.groupBy("token").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("squares"))
        state = stored(state.where("parts > 1").select("token", "m", "squares"), "list-states")
        entries, rest = state.agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("squares")) / 2)).first()
        if rest is None:
            break
        most = None if rest <= max(REST_PAIRS * n_sets, REST_LEAST) else MORE_LEADS ** (turn + 1)
        open_lists = stored(tagged.join(state.select("token", "m"), "token"), "open-lists")
        likely = stored(likely_in_lists(open_lists, sets, share, turn, most, entries), "likely-pairs")
        new = stored(verified(likely.where("b is not null").select("a", "b").distinct(), sets, share), "new-links")
        if not new.isEmpty():
            links = new if links is None else stored(links.unionByName(new), "links")
            labels = stored(components(links).withColumnRenamed("id", "cls"), "components")
        release(sets.sparkSession)
        more = likely.where("b is null").select("token", F.col("a").alias("cls")).distinct()
        if most is None or more.isEmpty():
            break
        lists = open_lists.join(more, ["token", "cls"], "left_semi").select("token", "cls", "n", "own", "place")
    if labels is None:
        return sets.select("cls", F.col("cls").alias("component")).limit(0)
    return labels


def _counted_links(table: pa.Table) -> pa.Table:
    """cls, links of one pair of blocks (i, j), for each component in it."""
    component, cls, copies, part = (table.column(c).to_numpy() for c in ("component", "cls", "copies", "part"))
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    lists = table.column("tokens").combine_chunks()
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    n = np.diff(offsets)
    links = np.zeros(len(cls))
    order = np.argsort(component, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(component[order]) != 0, [True]]))
    for at, to in zip(edges, edges[1:]):
        own = order[at:to]
        rows = [own[part[own] == i], own[part[own] == j]]
        if not len(rows[0]) or not len(rows[1]):
            continue
        where = np.concatenate(rows) if i != j else rows[0]
        token = np.concatenate([flat[offsets[r] : offsets[r + 1]] for r in where])
        owner = np.repeat(np.arange(len(where)), n[where])
        _, token = np.unique(token, return_inverse=True)
        by_token = np.argsort(token, kind="stable")
        token, owner = token[by_token], owner[by_token]
        common = np.zeros((len(rows[0]), len(rows[1])))
        b = slice(0 if i == j else len(rows[0]), None)
        for low in range(0, int(token[-1]) + 1, 1024):
            here = slice(*np.searchsorted(token, [low, low + 1024]))
            held = np.zeros((len(where), 1024), np.float32)
            held[owner[here], token[here] - low] = 1
            common += held[: len(rows[0])] @ held[b].T
        linked = common * (100 + SHARE) >= SHARE * (n[rows[0]][:, None] + n[rows[1]][None, :])
        if i == j:
            np.fill_diagonal(linked, False)
        links[rows[0]] += linked @ copies[rows[1]]
        if i != j:
            links[rows[1]] += linked.T @ copies[rows[0]]
    return pa.table({"cls": cls, "links": links.astype(np.int64)})


def count_links(sets: DataFrame, linked: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, links: for each class of `linked` how many rows of other classes it links with."""
    size = sets.join(linked, "cls").groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("k") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    size = stored(size.select("component", parts.alias("parts")), "component-sizes")
    own = sets.select("cls", "tokens").join(linked, "cls").join(classes.select("cls", "copies"), "cls").join(size, "component")
    own = own.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    buckets = max(64, size.count() // TASK_SETS)
    # Components of one block share tasks; a pair of blocks of a larger one is a group of its own.
    group = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("component"), F.lit(buckets))).otherwise(F.col("component"))
    units = own.select("component", "cls", "copies", "part", "tokens", group.alias("unit"), other).select(
        "unit", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "component", "cls", "copies", "part", "tokens"
    )
    counted = units.groupBy("unit", "i", "j").applyInArrow(_counted_links, "cls long, links long")
    return counted.groupBy("cls").agg(F.sum("links").alias("links"))


def find_near(docs: DataFrame, *, links: bool = True) -> DataFrame:
    """_row, id, n_shingles, component_id, component (of classes; null for the empty set) and n_links for each row of docs.

    Without `links` they are not counted.
    """
    written(docs)
    rows = numbered(docs, F.col("doc_id").alias("id"), "text")
    with scratch(docs.sparkSession):
        member, classes, possible = chosen_rows(rows)
        sets = sets_of(rows, possible)
        linked = stored(link_components(sets), "linked", keep=True)
        counts = stored(count_links(sets, linked, classes), "link-counts", keep=True) if links else None
    named = classes.join(linked, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("digest", "digest2", "cls", "copies", "component", "component_id")
    columns = ["_row", "id", F.col("n").alias("n_shingles"), "component_id", "component"]
    if links:
        named = named.join(counts, "cls", "left")
        columns.append((F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = member.join(named.drop("cls"), ["digest", "digest2"]).select(*columns)
    empty = member.where("digest is null").select(
        "_row", "id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(None).cast("long").alias("component"),
        *[F.lit(0).cast("long").alias("n_links")] * links,
    )
    return found.unionByName(empty)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, the smallest id's first; rows without words all stay."""
    written(docs)
    with scratch(docs.sparkSession):
        near = stored(find_near(docs, links=False), "near").where("component is not null")
        key = F.struct(F.col("id").isNull().alias("no_id"), "id", "_row")
        first = near.groupBy("component").agg(F.min(key).alias("first"))
        dropped = near.join(first, "component").where(F.col("_row") != F.col("first._row"))
        dropped = stored(dropped.select("_row"), "near-copies", keep=True)
    return without_rows(docs, dropped)


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = located(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return find_near(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
reach AS (SELECT x AS id, y AS r FROM links UNION SELECT reach.id, links.y FROM reach JOIN links ON reach.r = links.x),
least_id AS (SELECT id, min(r) AS r FROM reach GROUP BY id),
partners AS (SELECT x, count(*) AS k FROM links GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(r, d.doc_id)) AS component_id,
       CAST(coalesce(k, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_id ON least_id.id = d.doc_id LEFT JOIN partners ON x = d.doc_id
"""
