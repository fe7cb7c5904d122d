"""Approximate nearest neighbours by cross-polytope hashing.

A vector of unit length is rotated at random (three rounds of sign flips and a
fast Hadamard transform) and hashed to the nearest signed axis; a code joins
several such hashes.  A query probes, in each of several tables, every code whose
loss stays under a bound: the loss of a code is what its axes fall short of the
query's own.  Members and queries of one code meet in one place, where distances
to the original vectors are computed exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credsweep.llm.common import read, written

#: A place of a bucket takes about this many members and this many queries; larger buckets are dealt over several places.
MEMBERS, QUERIES = 4096, 2048
#: Queries that a task holds partial results for before it hands them on.
HELD = 20_000
#: Queries of the sample that the probing bound is fitted on.
SAMPLE = 128


def is_usable(vec: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vec) > 0) & ~F.exists(vec, lambda x: F.coalesce(bad(x), F.lit(True))) & F.exists(vec, lambda x: x != 0), F.lit(False))


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows under a pseudo-random rotation: sign flips and Hadamard transforms, three times."""
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x, h = x * s, 1
        while h < x.shape[1]:
            y = x.reshape(len(x), -1, 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), -1)
            h *= 2
        x = x / math.sqrt(h)
    return x


def axes(vectors: np.ndarray, table: int, bits: int) -> Iterator[np.ndarray]:
    """For each hash of a table's code the values on its signed axes; together they have ``bits`` bits.

    A full hash of d dimensions (padded to a power of two) has 2d axes; the last
    one uses as many as the bits that are left.
    """
    width = 1 << (vectors.shape[1] - 1).bit_length()
    unit = np.zeros((len(vectors), width))
    unit[:, :vectors.shape[1]] = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # against overflow of the norm
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    full, k = width.bit_length(), 0
    while bits > 0:
        r = max(1, min(bits, full))
        x = rotated(unit, 1_000_003 * table + k)[:, :1 << (r - 1)]
        yield np.concatenate([x, -x], axis=1)
        bits -= r
        k += 1


def codes(vectors: np.ndarray, table: int, bits: int) -> np.ndarray:
    """Each vector's code in a table."""
    out = np.zeros(len(vectors), dtype=np.int64)
    for y in axes(vectors, table, bits):
        out = out * y.shape[1] + y.argmax(axis=1)
    return out


def losses(query: np.ndarray, code: np.ndarray, table: int, bits: int) -> np.ndarray:
    """The loss of each code for the query beside it."""
    out, rest, hashes = np.zeros(len(code)), code.copy(), list(axes(query, table, bits))
    for y in reversed(hashes):
        out += y.max(axis=1) - y[np.arange(len(code)), rest % y.shape[1]]
        rest //= y.shape[1]
    return out


def probes(query: np.ndarray, table: int, bits: int, bound: float) -> Iterator[np.ndarray]:
    """For each query the codes whose loss is at most the bound."""
    hashes = [y.max(axis=1, keepdims=True) - y for y in axes(query, table, bits)]
    for i in range(len(query)):
        code, loss = np.zeros(1, dtype=np.int64), np.zeros(1)
        for h in hashes:
            loss = (loss[:, None] + h[i]).ravel()
            code = (code[:, None] * len(h[i]) + np.arange(len(h[i]))).ravel()[loss <= bound]
            loss = loss[loss <= bound]
        yield code


def nearest(q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and exact distances of its ``k`` nearest members, ties to smaller ids.

    A matrix product picks the members that can be among them, with a margin for
    its rounding; their distances are then computed from differences.
    """
    norms = np.einsum("ij,ij->i", m, m)
    rough = norms - 2 * q @ m.T
    margin = 1e-9 * (norms.max() + np.einsum("ij,ij->i", q, q).max())
    for i in range(len(q)):
        r = rough[i]
        near = np.flatnonzero(r <= np.partition(r, k - 1)[k - 1] + margin) if len(r) > k else np.arange(len(r))
        dist = np.sqrt(((m[near] - q[i]) ** 2).sum(axis=1))
        order = np.lexsort((ids[near], dist))[:k]
        yield ids[near][order], dist[order]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of a batch, apart for each number of dimensions."""
    dims = batch.column("vec").value_lengths().to_numpy()
    for d in np.unique(dims):
        part = batch.filter(pa.array(dims == d))
        yield part.column("id"), _matrix(part.column("vec"))


class Best:
    """The k nearest so far of several queries, within one task."""

    def __init__(self, k: int) -> None:
        self.k, self.found = k, {}

    def add(self, query: int, ids: np.ndarray, dist: np.ndarray) -> None:
        if query in self.found:
            old_ids, old = self.found[query]
            ids, first = np.unique(np.concatenate([old_ids, ids]), return_index=True)
            dist = np.concatenate([old, dist])[first]
            order = np.lexsort((ids, dist))[:self.k]
            ids, dist = ids[order], dist[order]
        self.found[query] = ids, dist

    def take(self) -> pa.RecordBatch:
        queries = [q for q, (ids, _) in self.found.items() for _ in ids]
        out = pa.RecordBatch.from_arrays([
            pa.array(queries, pa.int64()), pa.array(np.concatenate([np.zeros(0, int), *(x[0] for x in self.found.values())]), pa.int64()),
            pa.array(np.concatenate([np.zeros(0), *(x[1] for x in self.found.values())]), pa.float64())], ["query", "id", "dist"])
        self.found = {}
        return out


FOUND = "query long, id long, dist double"
BUCKET = ["dims", "table", "code"]


def _hashed(rows: DataFrame, tables: int, bits: int) -> DataFrame:
    """Every row once a table, with its code."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for ids, x in _by_length(batch):
                for t in range(tables):
                    yield _bucket_rows(x.shape[1], t, codes(x, t, bits), ids, x, np.arange(len(x)))

    return rows.mapInArrow(batches, "dims int, table int, code long, id long, vec array<double>")


def _probing(rows: DataFrame, tables: int, bits: int, bound: float) -> DataFrame:
    """Every query once for each code that it probes."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for ids, x in _by_length(batch):
                for t in range(tables):
                    for i, code in enumerate(probes(x, t, bits, bound)):
                        for at in range(0, len(code), 4096):
                            part = code[at:at + 4096]
                            yield _bucket_rows(x.shape[1], t, part, ids, x, np.full(len(part), i))

    return rows.mapInArrow(batches, "dims int, table int, code long, id long, vec array<double>")


def _bucket_rows(dims: int, table: int, code: np.ndarray, ids: pa.Array, x: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    n = len(code)
    vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x[rows].ravel()))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, dims), pa.int32()), pa.array(np.full(n, table), pa.int32()), pa.array(code, pa.int64()), ids.take(pa.array(rows)), vec],
        ["dims", "table", "code", "id", "vec"])


def _meet(members: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest members of each query over the buckets that they share.

    A bucket with many members or queries is dealt over several places, each pair
    of parts in one of them, so a hot bucket is no single task's work.
    """
    def parts(rows: DataFrame, most: int, name: str) -> DataFrame:
        return rows.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most) \
            .select(*BUCKET, F.ceil(F.col("n") / most).cast("int").alias(name))

    many = parts(members, MEMBERS, "pm").join(parts(queries, QUERIES, "pq"), BUCKET, "full")

    def dealt(rows: DataFrame, own: str, other: str, kind: int) -> DataFrame:
        rows = rows.join(many, BUCKET, "left")
        mine = F.pmod(F.xxhash64("id"), F.coalesce(F.col(own), F.lit(1)))
        theirs = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        rows = rows.withColumn("mine", mine.cast("int")).withColumn("theirs", theirs)
        m, q = ("mine", "theirs") if kind else ("theirs", "mine")
        return rows.select(*BUCKET, F.col(m).alias("m"), F.col(q).alias("q"), F.lit(kind).alias("kind"), "id", "vec")

    place = [*BUCKET, "m", "q"]
    rows = dealt(queries, "pq", "pm", 0).union(dealt(members, "pm", "pq", 1)).repartition(*place).sortWithinPartitions(*place, "kind")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at, asked, asking = Best(k), None, [], []
        for batch in it:
            keys = np.stack([batch.column(c).to_numpy() for c in [*place, "kind"]], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                here, kind = tuple(keys[a][:-1]), keys[a][-1]
                if here != at:
                    at, asked, asking = here, [], []
                if kind == 0 or asked:
                    part = batch.slice(a, b - a)
                    ids, x = part.column("id").to_numpy(), _matrix(part.column("vec"))
                    if kind == 0:
                        asked.append(ids)
                        asking.append(x)
                    else:
                        if len(asked) > 1:
                            asked, asking = [np.concatenate(asked)], [np.concatenate(asking)]
                        for q, (near, dist) in zip(asked[0], nearest(asking[0], ids, x, k)):
                            best.add(int(q), near, dist)
                        if len(best.found) > HELD:
                            yield best.take()
        yield best.take()

    return _nearest_rows(rows.mapInArrow(batches, FOUND), k)


def _nearest_rows(found: DataFrame, k: int) -> DataFrame:
    near = Window.partitionBy("query").orderBy("dist", "id")
    return found.groupBy("query", "id").agg(F.min("dist").alias("dist")).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)


def _scan(queries: list[tuple[int, np.ndarray]], members: DataFrame, k: int) -> DataFrame:
    """Exact search of a few queries over all members, a batch at a time."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in it:
            for ids, x in _by_length(batch):
                mine = [(i, v) for i, v in queries if len(v) == x.shape[1]]
                if mine:
                    for (i, _), (near, dist) in zip(mine, nearest(np.stack([v for _, v in mine]), ids.to_numpy(), x, k)):
                        best.add(i, near, dist)
        yield best.take()

    return _nearest_rows(members.mapInArrow(batches, FOUND), k)


def probing_bound(members: DataFrame, queries: DataFrame, tables: int, bits: int, k: int, share: float) -> float:
    """The loss under which ``share`` of the true neighbours of a sample of queries are met.

    The sample is the ``SAMPLE`` queries with the smallest hashes.  Their true
    neighbours come from an exact scan of all members; at most SAMPLE x k of them
    reach the driver.
    """
    sample = [(r["id"], np.array(r["vec"])) for r in queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    if not sample:
        return 0.0
    found = _scan(sample, members, k).join(members.select("id", "vec"), "id").select("query", "id", "vec").collect()
    at = dict(sample)
    least = []
    for d in {len(v) for v in at.values()}:
        mine = [r for r in found if len(at[r["query"]]) == d and r["id"] != r["query"]]
        if mine:
            q, m = np.stack([at[r["query"]] for r in mine]), np.stack([np.array(r["vec"]) for r in mine])
            least += list(np.min([losses(q, codes(m, t, bits), t, bits) for t in range(tables)], axis=0))
    return float(np.quantile(least, share)) + 1e-9 if least else 0.0


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
           tables: int = 8, bits: int | None = None, share: float = 0.97) -> DataFrame:
    """The ``k`` nearest rows of each query row but itself: ``query_id, rank, vec_id, score``.

    Score: Euclidean distance in double precision between the original vectors;
    nearest first, ties to the smaller id.  ``bits`` is the length of a code, by
    default such that a bucket holds some 64 vectors.  Vectors that are null,
    empty, zero or hold null or non-finite components take no part, nor do null
    ids; vectors of different lengths never meet; an empty table gives no rows.
    Ids should be unique: rows that share one are one row to the search.

    Of equal vectors only the ``k + 1`` smallest ids can be found, so no more are
    indexed; equal queries are searched once.  All others are indexed.  A query
    that finds fewer than ``k`` probes every code of the first table, so it has
    ``k`` unless there are fewer rows.
    """
    base = vectors.where(F.col(id_col).isNotNull() & is_usable(F.col(vec_col))) \
        .select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("asks"))
    same = Window.partitionBy("vec").orderBy("id")
    members = written(base.select("id", "vec").withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n"), "members")
    asking = written(base.where("asks").select("id", "vec"), "asking")
    queries = written(asking.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"), "queries")
    if bits is None:
        bits = min(24, max(3, round(math.log2(max(members.count(), 1) / 64 + 1))))
    bound = probing_bound(members, queries, tables, bits, k + 1, share)
    index = _hashed(members, tables, bits)
    found = written(_meet(index, _probing(queries, tables, bits, bound), k + 1), "found")
    few = queries.join(found.groupBy("query").count().where(F.col("count") > k).select(F.col("query").alias("id")), "id", "left_anti")
    again = _meet(_hashed(members, 1, bits), _probing(few, 1, bits, float("inf")), k + 1)
    first = found.join(again.select("query").distinct(), "query", "left_anti")
    found = first.select("query", "id", "dist").union(again.select("query", "id", "dist"))
    # back from each distinct query vector to its rows, without the row itself
    rows = asking.withColumnRenamed("id", "query_id").join(queries.withColumnRenamed("id", "query"), "vec").select("query_id", "query") \
        .join(found, "query").where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))
    return rows.select("query_id", rank.alias("rank"), F.col("id").alias("vec_id"), F.col("dist").alias("score")).where(F.col("rank") <= k)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector, among all."""
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
