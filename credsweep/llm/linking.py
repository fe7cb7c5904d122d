"""Links between sets that are alike, given keys under which they meet.

Whoever calls this gives each set some keys, such that alike sets share one.  Sets
that share a key (and whose sizes allow it) belong to one cluster, so each link
lies within a cluster.  A cluster is one place: each of its sets is sent there
once, pairs are compared on the sets themselves, those that are in one component
by then are passed over, and only links leave the place, fewer than it has sets.
So no pair of a group of copies is ever a row.

A cluster too large for a place is dealt over pairs of blocks, a place each, if
that sends a set to few places.  A still larger one is dealt by key: one round
links its sets to hubs, keys whose sets then are in one component need nothing
more, and the sets of the others meet by key (or, for a key with too many, by
pairs of blocks) in places of the same kind.  Every pair that shares a key and
isn't in one component by then meets in some place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsweep.llm.common import small_batches, written
from credsweep.llm.components import components
from credsweep.llm.shingles import set_hash, shingle_sets

#: Sets, and shingles of sets, that meet in one place.
BLOCK, LIMIT = 2048, 1 << 20
#: The most blocks of a cluster; a set goes to as many places.
MOST_BLOCKS = 32
#: Keys that a task puts in order before it hands them on.
KEYS = 1 << 19
#: Buckets of document ids by which the texts of few documents are picked before they are shuffled.
PICKS = 1 << 20

#: Finds among the sets of a place those that may be alike to one: (sizes, shingles, owners) -> (row -> rows).
Bound = Callable[[np.ndarray, np.ndarray, np.ndarray], Callable[[int], np.ndarray]]


class Likeness:
    """100 |A ∩ B| >= percent |A ∪ B|, and what follows from it."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def overlap(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The least intersection of alike sets of n and m shingles."""
        return -(-(n + m) * self.percent // (100 + self.percent))

    def prefix(self, n: int) -> int:
        """So many first shingles of a set hold one of any alike set's first ones."""
        return n - -(-n * self.percent // 100) + 1

    def index_prefix(self, n: int) -> int:
        """So many do if the other set is no smaller."""
        return n - -(-2 * n * self.percent // (100 + self.percent)) + 1


# ---------------------------------------------------------------- clusters

#: Either a pair, or a key with the smallest and largest of some sets that hold it and one of their classes.
MET = "a long, b long, key long, cls long, low int, high int"


def _met_rows(a, b, key, cls, low, high) -> pa.RecordBatch:
    pairs, keys = len(a), len(key)
    none = lambda n: pa.nulls(n, pa.int64())
    join = lambda x, y: pa.concat_arrays([x, y])
    return pa.RecordBatch.from_arrays([
        join(pa.array(a, pa.int64()), none(keys)), join(pa.array(b, pa.int64()), none(keys)), join(none(pairs), pa.array(key, pa.int64())),
        join(none(pairs), pa.array(cls, pa.int64())), join(pa.nulls(pairs, pa.int32()), pa.array(low, pa.int32())),
        join(pa.nulls(pairs, pa.int32()), pa.array(high, pa.int32()))], ["a", "b", "key", "cls", "low", "high"])


def meetings_by_key(sets: DataFrame, like: Likeness) -> DataFrame:
    """Pairs that join the sets of each key, where sizes allow a link.

    A task first joins what it holds, so a key that very many sets share gives
    one row for each of its batches; then rows stream by key and size.
    """
    most = KEYS

    def local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def joined() -> pa.RecordBatch:
            cls, n, key = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((cls, n, key))
            cls, n, key = cls[order], n[order], key[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (100 * n[:-1] < like.percent * n[1:])
            heads = np.flatnonzero(new)
            head = cls[heads[np.cumsum(new) - 1]]
            rest = ~new & (cls != head)
            pairs = np.unique(np.stack([head[rest], cls[rest]], axis=1), axis=0) if rest.any() else np.zeros((0, 2), np.int64)
            return _met_rows(pairs[:, 0], pairs[:, 1], key[heads], cls[heads], n[heads], n[np.append(heads[1:], len(key)) - 1])

        for batch in it:
            keys = batch.column("keys")
            many = np.diff(keys.offsets.to_numpy())
            held.append((np.repeat(batch.column("cls").to_numpy(), many), np.repeat(batch.column("n").to_numpy().astype(np.int64), many), keys.flatten().to_numpy()))
            count += int(many.sum())
            if count >= most:
                yield joined()
                held, count = [], 0
        if count:
            yield joined()

    def runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, high, head = None, 0, 0
        for batch in it:
            pair = np.asarray(batch.column("key").is_null())
            a, b = (batch.column(c).filter(pa.array(pair)).to_numpy().tolist() for c in "ab")
            key, cls, low, top = (batch.column(c).filter(pa.array(~pair)).to_numpy() for c in ("key", "cls", "low", "high"))
            if len(key):
                # most keys are one row: they are passed over unless a batch's edge cuts them
                same = np.zeros(len(key) + 1, bool)
                same[1:-1] = key[1:] == key[:-1]
                same[0], same[-1] = key[0] == at, True
                for i in np.flatnonzero(same[:-1] | same[1:]).tolist():
                    if key[i] == at and 100 * high >= like.percent * int(low[i]):
                        high = max(high, int(top[i]))
                        if cls[i] != head:
                            a.append(head)
                            b.append(int(cls[i]))
                    else:
                        at, high, head = key[i], int(top[i]), int(cls[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = small_batches(sets).select("cls", "n", "keys").where(F.size("keys") > 0).mapInArrow(local, MET)
    return rows.repartition(F.coalesce("key", "a")).sortWithinPartitions("key", "low", "cls").mapInArrow(runs, "a long, b long") \
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# ---------------------------------------------------------------- places


def place_links(cls: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], like: Likeness, bound: Bound | None) -> list[tuple[int, int]]:
    """Links that join the sets of one place as all links among them would, from one set of a component to the others.

    ``comp`` numbers the component that each set is in so far.  With sets of two
    sides only pairs across them count.
    """
    n = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")
    cls, comp, side, n = cls[order], comp[order].copy(), side[order], n[order]
    before = comp.copy()
    flat = np.concatenate([sets[i] for i in order.tolist()])
    starts = np.concatenate([[0], np.cumsum(n)])
    ids = np.unique(flat, return_inverse=True)[1]
    near = bound(n, flat, np.repeat(np.arange(len(n)), n)) if bound else None
    two = side.any() and not side.all()
    here = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    last = np.searchsorted(n, n * 100 // like.percent, side="right")
    for i in range(len(cls)):
        rows = np.arange(i + 1, last[i])
        if near is not None and len(rows):
            rows = near(i)
            rows = rows[(rows > i) & (rows < last[i])]
        rows = rows[comp[rows] != comp[i]]
        if two:
            rows = rows[side[rows] != side[i]]
        if not len(rows):
            continue
        here[ids[starts[i]:starts[i + 1]]] = True
        if len(rows) > (last[i] - i) // 2:  # read straight through
            first = rows[0]
            common = np.add.reduceat(here[ids[starts[first]:starts[rows[-1] + 1]]], starts[first:rows[-1] + 1] - starts[first], dtype=np.int64)[rows - first]
        else:
            places = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows.tolist()])
            common = np.add.reduceat(here[ids[places]], np.concatenate([[0], np.cumsum(n[rows])[:-1]]), dtype=np.int64)
        here[ids[starts[i]:starts[i + 1]]] = False
        for r in rows[100 * common >= like.percent * (n[i] + n[rows] - common)].tolist():
            if comp[r] != comp[i]:
                comp[comp == comp[r]] = comp[i]
    return stars(cls, before, comp)


def stars(cls: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple[int, int]]:
    """Links from one class of each component to one of every other component that it is made of."""
    order = np.lexsort((cls, before, after))
    cls, before, after = cls[order], before[order], after[order]
    heads = np.flatnonzero(np.concatenate([[True], (after[1:] != after[:-1]) | (before[1:] != before[:-1])]))
    first: dict[int, int] = {}
    return [(first[a], c) for a, c in zip(after[heads].tolist(), cls[heads].tolist()) if first.setdefault(a, c) != c]


def _linked(placed: DataFrame, size: int, like: Likeness, bound: Bound | None) -> DataFrame:
    """The links of all places: rows ``place, side, cls, comp, text``."""
    rows = placed.repartition("place").sortWithinPartitions("place", "cls")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def closed() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            cls, found = np.array(list(held), np.int64), list(held.values())
            return place_links(cls, np.array([x[0] for x in found]), np.array([x[1] for x in found]), [x[2] for x in found], like, bound)

        for batch in it:
            out = []
            for place, cls, comp, side, s in zip(*(batch.column(c).to_pylist() for c in ("place", "cls", "comp", "side")), shingle_sets(batch.column("text"), size)):
                if place != at:
                    out += closed()
                    at, held = place, {}
                # a class that was given another text of the same id is passed over; its own row is there too
                if cls not in held and set_hash(s) == cls:
                    held[cls] = comp, side, s
            yield pair_rows(out)
        yield pair_rows(closed())

    return rows.mapInArrow(batches, "a long, b long")


def pair_rows(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], ["a", "b"])


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``wanted`` rows (with ``one``: a document's id and text hash) and that document's text."""
    wanted = wanted.select("*", F.col("one.doc_id").alias("id__"), F.col("one.text_hash").alias("hash__")).drop("one")
    # at most PICKS small numbers, whatever the tables' sizes: most other texts are never shuffled
    pick = lambda c: F.pmod(F.xxhash64(c), F.lit(PICKS))
    picks = wanted.select(pick("id__").alias("pick")).distinct()
    rows = docs.select(F.col(id_col).alias("id__d"), F.xxhash64(F.col(text_col)).alias("hash__d"), F.col(text_col).alias("text")) \
        .join(F.broadcast(picks), pick("id__d") == F.col("pick"), "left_semi")
    return rows.join(wanted, F.col("id__d").eqNullSafe(F.col("id__")) & (F.col("hash__d") == F.col("hash__"))).drop("id__", "hash__", "id__d", "hash__d")


def links(docs: DataFrame, sets: DataFrame, reps: DataFrame, size: int, like: Likeness, bound: Bound | None, id_col: str, text_col: str,
          meetings: Callable[[DataFrame, Likeness], DataFrame] = meetings_by_key) -> DataFrame:
    """Links that give the same components as all links between alike sets.

    ``sets`` has ``cls, n, keys`` (rows may repeat a class, with or without its
    keys), ``reps`` each class's ``n`` and ``one`` document.  ``meetings`` makes
    the pairs (a, b) that join the clusters.
    """
    clusters = components(written(meetings(sets, like), "met")).withColumnRenamed("node", "cls")
    members = written(clusters.join(reps.select("cls", "n", "one"), "cls"), "members")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n").cast("long")).alias("shingles"))
    large = written(sizes.where((F.col("k") > BLOCK) | (F.col("shingles") > LIMIT) & (F.col("k") > 2)).select("label", _blocks().alias("blocks")), "large")
    if large.isEmpty():
        small, huge = members, None
    else:
        small = members.join(large, "label", "left_anti")
        huge = large.where(F.col("blocks") > MOST_BLOCKS).select("label")
    placed = small.select(F.col("label").alias("place"), F.lit(0).alias("side"), "cls", F.col("cls").alias("comp"), "one")
    if huge is not None:
        placed = placed.union(_block_pairs(members.join(large.where(F.col("blocks") <= MOST_BLOCKS), "label").withColumn("comp", F.col("cls")), "label"))
    found = written(_linked(_texts(docs, placed, id_col, text_col), size, like, bound), "linked")
    if huge is None or huge.isEmpty():
        return found
    return found.union(_dealt_links(docs, sets, members.join(huge, "label", "left_semi"), size, like, bound, id_col, text_col))


def _blocks() -> Column:
    """Blocks of ``k`` sets with so many ``shingles``, two of which fit a place."""
    return F.ceil(F.greatest(2 * F.col("k") / BLOCK, 2 * F.col("shingles") / LIMIT)).cast("int")


def _block_pairs(rows: DataFrame, group: str) -> DataFrame:
    """Rows (``cls, comp, one``) of a group dealt over pairs of its ``blocks``, each pair a place."""
    return rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select(F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")).alias("place"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cls", "comp", "one")


# ---------------------------------------------------------------- clusters too large for a place


def _dealt_links(docs: DataFrame, sets: DataFrame, members: DataFrame, size: int, like: Likeness, bound: Bound | None, id_col: str, text_col: str) -> DataFrame:
    """The links of clusters that are too large for a place."""
    keyed = sets.where(F.size("keys") > 0).select("cls", F.explode("keys").alias("key"))
    rows = written(keyed.join(members.select("cls", "n", "one"), "cls").groupBy("key", "cls").agg(F.first("n").alias("n"), F.first("one").alias("one")), "keyed")

    def labelled(links: DataFrame | None) -> DataFrame:
        if links is None:
            return rows.withColumn("comp", F.col("cls"))
        return rows.join(components(links).withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("label", "cls")).drop("label")

    # each set and the first, in an order of its own, of the sets that it shares a key with
    first = F.struct(F.xxhash64("cls", F.lit(1)).alias("at"), "cls", "n", "one")
    hubs = rows.groupBy("key").agg(F.min(first).alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "hub")
    near = (F.col("n") * 100 >= F.col("hub.n") * like.percent) & (F.col("hub.n") * 100 >= F.col("n") * like.percent)
    pairs = rows.join(hubs, "key").where((F.col("cls") != F.col("hub.cls")) & near).groupBy("cls").agg(F.min("hub").alias("hub"), F.first("one").alias("one"))
    # a place for each set and its hub
    each = F.explode(F.array(F.struct("cls", "one"), F.struct(F.col("hub.cls").alias("cls"), F.col("hub.one").alias("one")))).alias("x")
    placed = pairs.select(F.col("cls").alias("place"), F.lit(0).alias("side"), each).select("place", "side", "x.cls", F.col("x.cls").alias("comp"), "x.one")
    found = written(_linked(_texts(docs, placed, id_col, text_col), size, like, None), "hubs")

    left = labelled(found)
    mixed = left.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n").cast("long")).alias("shingles")) \
        .where("lo != hi").select("key", "k", "shingles")
    left = written(left.join(mixed, "key"), "mixed")
    total = left.agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n").cast("long")).alias("shingles")).first()
    parts = 1 + max(total["k"] * 2 // BLOCK, (total["shingles"] or 0) * 2 // LIMIT)
    hot = (F.col("k") > BLOCK) | (F.col("shingles") > LIMIT) & (F.col("k") > 2)
    usual = left.where(~hot).select(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("place"), F.lit(0).alias("side"), "cls", "comp", "one")
    placed = usual.union(_block_pairs(left.where(hot).withColumn("blocks", _blocks()), "key")).groupBy("place", "side", "cls", "comp").agg(F.first("one").alias("one"))
    return found.union(written(_linked(_texts(docs, placed, id_col, text_col), size, like, bound), "linked"))


# ---------------------------------------------------------------- components of documents


def classed(docs: DataFrame, sets: DataFrame, size: int, like: Likeness, bound: Bound | None = None, id_col: str = "doc_id", text_col: str = "text",
            meetings: Callable[[DataFrame, Likeness], DataFrame] = meetings_by_key) -> DataFrame:
    """One row a document: ``doc_id, text_hash, cls, n_shingles, component, component_id``.

    ``sets`` has one row a document: ``doc_id, text_hash, cls, n, keys`` and what ``meetings`` needs.
    """
    reps = written(sets.where("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.min("doc_id").alias("smallest"), F.first("n").alias("n")), "reps")
    final = components(links(docs, sets, reps, size, like, bound, id_col, text_col, meetings)).withColumnRenamed("node", "cls")
    grouped = reps.join(final, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    smallest = grouped.groupBy("label").agg(F.min("smallest").alias("component_id"))
    named = grouped.join(smallest, "label").select("cls", F.col("label").alias("component"), "component_id")
    return sets.select("doc_id", "text_hash", "cls", F.col("n").cast("long").alias("n_shingles")).join(named, "cls", "left") \
        .select("doc_id", "text_hash", "cls", "n_shingles", "component", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def described(docs: DataFrame, size: int, keys: Callable[[np.ndarray], np.ndarray], id_col: str, text_col: str, vector: Callable[[np.ndarray], bytes] | None = None) -> DataFrame:
    """One row a document for ``classed``: id, hash of the text, class (hash of its set), set size, the set's keys and with ``vector`` its vector (``vec``).

    A set that a task has met before gives no keys and no vector again.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]).add("text_hash", "long").add("cls", "long").add("n", "integer").add("keys", T.ArrayType(T.LongType()))
    if vector:
        schema = schema.add("vec", "binary")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in it:
            cls, n, found, vec = [], [], [], []
            for s in shingle_sets(batch.column("text"), size):
                c = set_hash(s)
                cls.append(c)
                n.append(len(s))
                again = c in met or not len(s)
                found.append(np.zeros(0, np.int64) if again else keys(s).view(np.int64))
                vec.append(None if again or not vector else vector(s))
                met.add(c)
            if len(met) > 1 << 19:  # only spares rows, so it may be forgotten
                met = set()
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(cls, pa.int64()), pa.array(n, pa.int32()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(vec, pa.binary())] if vector else [])], schema.names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return small_batches(rows).mapInArrow(batches, schema)


def components_sql(percent: int) -> str:
    """DuckDB SQL for documents' components: ``doc_id, n_shingles, component_id`` (ids must not repeat)."""
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, y FROM reached r JOIN ways ON x = other)
SELECT r.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id"""
