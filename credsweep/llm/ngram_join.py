"""N-gram Jaccard join by count vectors and R-trees.

A text's set are its distinct word shingles, as 64-bit hashes.  Sets meet under
keys: with the shingles in one global order, rare ones first, two sets that are
alike enough share one of the first few.  The shingles of a set are also hashed
into groups, and the group counts are a point.  The sets of a key stand in an
R-tree of their points; a key with no more sets than a leaf holds is a tree of
one leaf, and such leaves are looked at many at a time.  The overlap of
two sets, or of a set and all sets under a node, is at most the sum of the
coordinate minima, so subtrees fall away; the sets that are left in pairs are
joined, and a larger tree hands on fewer joins than it has sets.  The few sets
that are joined so are sent to a place of their own each cluster, once, and
verified there on the shingles themselves, with a tree again (``linking``).

No pairs are made within groups of copies.  Equal sets are one class, pairs that
are in one component by then are passed over, and only links leave a place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsweep.llm import linking
from credsweep.llm.common import read, small_batches, written
from credsweep.llm.linking import Likeness
from credsweep.llm.shingles import shingle_sets

#: Hash groups of a point, between these; in a set's own vector some four shingles fall into one, in a place's tree two of a usual set's.
FEWEST, MOST = 16, 1 << 14
TREE_MOST = 1024
#: Keys with more sets are dealt over pairs of blocks.
BLOCK = 1024
#: Rows of keys that are looked at together, and pairs of points.
ROWS, PAIRS = 20_000, 1 << 16
#: The sketch of shingle frequencies: 2^22 counters, in slots of this many.
SKETCH_BITS, SLOT = 22, 8192
#: Sets under a leaf of an R-tree, and children of an inner node.
LEAF = 16


# ---------------------------------------------------------------- frequencies


def frequency_levels(docs: DataFrame, size: int, text_col: str) -> np.ndarray:
    """For each of 2^22 hash buckets how far its shingles' frequency stands above or below the mean, in eighths of a doubling.

    Counts cover all shingles.  They only order the shingles, so that texts don't
    meet under a passage that very many share; any order gives the same links.
    Each task adds up its own counters, which then meet slot by slot; levels of
    one byte come to the driver, 4 MB whatever the table's size.
    """
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in it:
            for s in shingle_sets(batch.column(0), size):
                np.add.at(total, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        slots = total.reshape(-1, SLOT)
        used = np.flatnonzero(slots.any(axis=1))
        yield _slot_rows(used, slots[used], slots[used].sum(axis=1, dtype=np.int64))

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in it:
            for slot, raw in zip(batch.column("slot").to_pylist(), batch.column("counts").to_pylist()):
                x = np.frombuffer(raw, np.int32 if len(raw) == 4 * SLOT else np.int64).astype(np.int64)
                total[slot] = total[slot] + x if slot in total else x
        yield _slot_rows(np.array(list(total), int), list(total.values()), [int(x.sum()) for x in total.values()])

    kind = "slot int, counts binary, total long"
    sums = written(small_batches(docs.select(F.col(text_col).alias("text"))).mapInArrow(count, kind).repartition("slot").mapInArrow(add, kind), "counts")
    mean = (sums.agg(F.sum("total")).first()[0] or 0) / (1 << SKETCH_BITS)

    def levels(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [np.rint(8 * np.log2((np.frombuffer(raw, np.int64) + 1) / (mean + 1))) for raw in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("slot"), pa.array([np.clip(x, -120, 120).astype(np.int8).tobytes() for x in found], pa.binary())], ["slot", "levels"])

    rows = sums.mapInArrow(levels, "slot int, levels binary").toArrow()
    out = np.zeros(((1 << SKETCH_BITS) // SLOT, SLOT), np.int8)
    for slot, raw in zip(rows.column("slot").to_pylist(), rows.column("levels")):
        out[slot] = np.frombuffer(raw.as_buffer(), np.int8)
    return out.ravel()


def _slot_rows(slots, counts, totals) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array([np.ascontiguousarray(c).tobytes() for c in counts], pa.binary()), pa.array(totals, pa.int64())],
                                      ["slot", "counts", "total"])


# ---------------------------------------------------------------- R-trees


class RTree:
    """Points packed into leaves by the order of their widest coordinates; every node has the maxima of its points."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        order = np.arange(len(points))
        self.order = self._pack(order)
        self.levels = []
        tops = np.array([points[self.order[i:i + LEAF]].max(axis=0) for i in range(0, len(order), LEAF)])
        while True:
            self.levels.append(tops)
            if len(tops) == 1:
                break
            tops = np.array([tops[i:i + LEAF].max(axis=0) for i in range(0, len(tops), LEAF)])

    def _pack(self, rows: np.ndarray) -> np.ndarray:
        """Sort-tile: halves along the widest coordinate until a leaf is left."""
        if len(rows) <= LEAF:
            return rows
        x = self.points[rows]
        dim = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
        rows = rows[np.argsort(x[:, dim], kind="stable")]
        half = max(LEAF, len(rows) // 2 // LEAF * LEAF)
        return np.concatenate([self._pack(rows[:half]), self._pack(rows[half:])])

    def query(self, point: np.ndarray, least: np.ndarray, low: int) -> np.ndarray:
        """Rows whose summed minima with the point reach their ``least``; ``low`` is the smallest of these."""
        nodes = np.zeros(1, int)
        for tops in reversed(self.levels):
            nodes = nodes[nodes < len(tops)]
            nodes = nodes[np.minimum(tops[nodes], point).sum(axis=1) >= low]
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        rows = self.order[nodes[nodes < len(self.order)]]
        return rows[np.minimum(self.points[rows], point).sum(axis=1) >= least[rows]]


def count_vectors(n: np.ndarray, shingles: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The sets of a place as points: how many of a set's shingles fall into each group, by their low bits."""
    groups = min(max(FEWEST, 1 << (int(np.median(n)) // 2).bit_length()), TREE_MOST)
    at = owner * groups + (shingles & np.uint64(groups - 1)).astype(np.int64)
    return np.bincount(at, minlength=len(n) * groups).reshape(len(n), groups).astype(np.int32)


def tree_bound(like: Likeness) -> linking.Bound:
    """Finds the sets of a place whose points leave an overlap with one that is large enough."""
    def of(n: np.ndarray, shingles: np.ndarray, owner: np.ndarray) -> Callable[[int], np.ndarray]:
        points = count_vectors(n, shingles, owner)
        tree = RTree(points)

        def near(i: int) -> np.ndarray:
            # the sets stand by size, so those that are left are no smaller
            least = like.overlap(n, n[i])
            return np.sort(tree.query(points[i], least, int(like.overlap(n[i], n[i]))))

        return near

    return of


# ---------------------------------------------------------------- places of keys


def packed_vector(shingles: np.ndarray) -> bytes:
    """A set's count vector: bytes a count, then the counts by group.

    The groups are the shingles' low bits, a power of two of them, so a longer
    vector folds into a shorter one.
    """
    groups = min(max(FEWEST, 1 << (len(shingles) // 4).bit_length()), MOST)
    counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    width = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts.reshape(-1, groups).sum(axis=0)


def may_be_alike(x: np.ndarray, y: np.ndarray, like: Likeness) -> bool:
    """Whether the summed minima of two count vectors, at the groups of the shorter, reach the overlap of alike sets."""
    groups = min(len(x), len(y))
    return np.minimum(folded(x, groups), folded(y, groups)).sum() >= like.overlap(x.sum(), y.sum())


def place_joins(cls: np.ndarray, side: np.ndarray, vectors: list[np.ndarray], like: Likeness) -> list[tuple[int, int]]:
    """Joins the sets of a place that may be alike, directly or by others.

    The tree's points are the vectors folded to the shortest of the place; what
    it finds is bounded once more by the vectors themselves.  With sets of two
    sides only pairs across them count.
    """
    n = np.array([v.sum() for v in vectors])
    order = np.argsort(n, kind="stable")
    cls, side, n, vectors = cls[order], side[order], n[order], [vectors[i] for i in order.tolist()]
    groups = min(max(FEWEST, 64), min(map(len, vectors)))
    tree = RTree(np.array([folded(v, groups) for v in vectors], np.int32))
    last = np.searchsorted(n, n * 100 // like.percent, side="right")
    two = side.any() and not side.all()
    comp = np.arange(len(cls))
    for i in range(len(cls)):
        if last[i] <= i + 1:
            continue
        rows = tree.query(tree.points[i], like.overlap(n, n[i]), int(like.overlap(n[i], n[i])))
        rows = rows[(rows > i) & (rows < last[i])]
        rows = rows[comp[rows] != comp[i]]
        if two:
            rows = rows[side[rows] != side[i]]
        for r in rows.tolist():
            if comp[r] != comp[i] and may_be_alike(vectors[i], vectors[r], like):
                comp[comp == comp[r]] = comp[i]
    return linking.stars(cls, np.arange(len(cls)), comp)


def leaf_joins(run: np.ndarray, cls: np.ndarray, raw: list[bytes], like: Likeness) -> list[tuple[int, int]]:
    """Pairs that may be alike of the sets of each run, all runs being trees of one leaf.

    Points are compared at the groups of the shorter one, all pairs of one length at a time.
    """
    length = np.array([(len(x) - 1) // x[0] for x in raw])
    points: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by groups: rows, then their points
    n, where = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
    for groups in np.unique(length).tolist():
        rows = np.flatnonzero(length == groups)
        found = np.array([vector(raw[i]) for i in rows.tolist()], np.int32)
        points[groups], n[rows], where[rows] = (rows, found), found.sum(axis=1), np.arange(len(rows))
    a, b = [], []
    for d in range(1, LEAF):
        i = np.flatnonzero(run[d:] == run[:-d])
        a.append(i)
        b.append(i + d)
    a, b = np.concatenate(a), np.concatenate(b)
    near = (100 * np.minimum(n[a], n[b]) >= like.percent * np.maximum(n[a], n[b])) & (cls[a] != cls[b])
    a, b = a[near], b[near]
    swap = cls[a] > cls[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    first = np.unique(np.stack([cls[a], cls[b]], axis=1), axis=0, return_index=True)[1] if len(a) else np.zeros(0, int)
    a, b = a[first], b[first]
    out = []
    for groups in np.unique(np.minimum(length[a], length[b])).tolist():
        for at in np.array_split(of := np.flatnonzero(np.minimum(length[a], length[b]) == groups), 1 + len(of) * groups // (PAIRS * 64)):
            x, y = (_points(points, length[r], where[r], groups) for r in (a[at], b[at]))
            alike = np.minimum(x, y).sum(axis=1) >= like.overlap(n[a[at]], n[b[at]])
            out += zip(cls[a[at]][alike].tolist(), cls[b[at]][alike].tolist())
    return out


def _points(points: dict[int, tuple[np.ndarray, np.ndarray]], length: np.ndarray, where: np.ndarray, groups: int) -> np.ndarray:
    """Some rows' points, folded to ``groups``."""
    out = np.zeros((len(length), groups), np.int32)
    for own in np.unique(length).tolist():
        rows = length == own
        out[rows] = points[own][1][where[rows]].reshape(int(rows.sum()), -1, groups).sum(axis=1)
    return out


def meetings_by_tree(sets: DataFrame, like: Likeness) -> DataFrame:
    """Pairs that join sets which share a key and may be alike, or that others join so."""
    keyed = sets.where(F.size("keys") > 0).select("cls", "n", F.explode("keys").alias("key"))
    rows = written(_shared(keyed.repartition("key").sortWithinPartitions("key", "n", "cls"), like), "shared")
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK).select("key", F.ceil(F.col("k") / (BLOCK // 2)).cast("int").alias("blocks"))
    sized = rows.join(crowded, "key", "left")
    usual = sized.where("blocks IS NULL").select(F.col("key").alias("place"), F.lit(0).alias("side"), "cls")
    split = sized.where("blocks IS NOT NULL").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("place"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cls")
    vectors = sets.where("vec IS NOT NULL").select("cls", "vec").dropDuplicates(["cls"])
    placed = usual.union(split).join(vectors, "cls").repartition("place").sortWithinPartitions("place", "cls")
    most = ROWS

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def looked_at(rows: list[tuple]) -> pa.RecordBatch:
            place, cls, side = (np.array([r[k] for r in rows], np.int64) for k in range(3))
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            ends = np.append(starts[1:], len(rows))
            out, leaf = [], np.ones(len(rows), bool)
            for s, e in zip(starts.tolist(), ends.tolist()):
                if e - s > LEAF or side[s:e].any():
                    leaf[s:e] = False
                    one = np.unique(cls[s:e], return_index=True)[1] + s
                    out += place_joins(cls[one], side[one], [vector(rows[i][3]) for i in one.tolist()], like)
            at = np.flatnonzero(leaf)
            if len(at) > 1:
                out += leaf_joins(place[at], cls[at], [rows[i][3] for i in at.tolist()], like)
            return linking.pair_rows(out)

        for batch in it:
            held += zip(*(batch.column(c).to_pylist() for c in ("place", "cls", "side", "vec")))
            if len(held) >= most:  # all but the last place, which may go on
                cut = next((i for i in range(len(held) - 1, 0, -1) if held[i][0] != held[i - 1][0]), 0)
                if cut:
                    yield looked_at(held[:cut])
                    held = held[cut:]
        if held:
            yield looked_at(held)

    return placed.mapInArrow(batches, "a long, b long").distinct()


def _shared(rows: DataFrame, like: Likeness) -> DataFrame:
    """The rows ``key, cls`` of sets that share a key with one of a size that allows a link; they stream by key and size.

    If two sets of a key are near enough in size, so are the neighbours between them.
    """
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, and whether it was handed on
        for batch in it:
            if not batch.num_rows:
                continue
            key, cls, n = batch.column("key").to_numpy(), batch.column("cls").to_numpy(), batch.column("n").to_numpy().astype(np.int64)
            if held:
                key, cls, n = np.append(held[0], key), np.append(held[1], cls), np.append(held[3], n)
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            passed = bool(held and held[2])
            key, cls, n = key[fresh], cls[fresh], n[fresh]
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = (key[1:] == key[:-1]) & (100 * n[:-1] >= like.percent * n[1:])
            out = same[:-1] | same[1:]
            held = key[-1], cls[-1], bool(out[-1]) or passed and len(key) == 1, n[-1]
            if passed:
                out[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(cls[out])], ["key", "cls"])

    return rows.select("key", "cls", "n").mapInArrow(batches, "key long, cls long")


# ---------------------------------------------------------------- the join


def classes(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, text_hash, cls, n_shingles, component, component_id``.

    Texts link when the Jaccard similarity of their sets of ``size``-word
    shingles is at least ``percent`` / 100; ``component_id`` is the smallest id
    reachable by links, ``component`` the smallest class (null for an empty set),
    ``cls`` the hash of the set.  Equal sets are linked, but
    an empty set (null or blank text) with nothing: its row is its own component.
    Repeated rows and repeated ids are rows like others; a null id is never the
    smallest unless there is no other.  An empty table gives no rows.
    """
    like = Likeness(percent)
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, size, text_col))

    def keys(s: np.ndarray) -> np.ndarray:
        order = np.argsort(levels.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
        return s[order[:like.prefix(len(s))]]

    sets = written(linking.described(docs, size, keys, id_col, text_col, packed_vector), "sets")
    return linking.classed(docs, sets, size, like, tree_bound(like), id_col, text_col, meetings_by_tree)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under 5-word shingles and a similarity of 0.8."""
    return classes(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest id.

    Of rows that repeat its id within the component one stays.  Texts without
    words stay, as do rows with a null id whose component has no other id.
    """
    kept = classes(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = kept.groupBy(F.col("doc_id").alias("id__k"), "component", F.when(F.col("component").isNull(), F.col("text_hash")).alias("blank__k")) \
        .agg(F.min("text_hash").alias("hash__k"), F.max("n_shingles").alias("n__k")).select("id__k", "hash__k", "n__k")
    rows = docs.withColumn("hash__d", F.xxhash64("text")).join(one, F.col("doc_id").eqNullSafe(F.col("id__k")) & (F.col("hash__d") == F.col("hash__k")))
    each = F.when((F.col("n__k") == 0) | F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return rows.withColumn("each__k", each).dropDuplicates(["id__k", "hash__k", "each__k"]).select(*docs.columns)
