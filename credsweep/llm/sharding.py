"""Sharding by a k-d tree over row metadata.

The rows are points: one coordinate for each metadata column.  A node with m
shards to make is split at the weighted quantile floor(m/2)/m (the weighted
median for even m) of its widest dimension, until every leaf is one shard.  The
quantiles of all nodes of a level are found together by distributed histograms,
refined until the bin that holds the quantile is light, so the driver sees at
most 2^15 sums a node and never a row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsweep.llm.common import read, running_total, written

#: A coordinate's bits: the value, then a hash of the id that sets rows of one value apart.
VALUE_BITS, TIE_BITS, NUMBER_BITS = 20, 20, 6
#: Bits that each histogram resolves: the first one covers all dimensions, the others the chosen one.
ROUNDS = (11, 14, 15)
#: A bin this light against a mean shard ends the search for a split.
LIGHT = 0.002


@dataclass
class Node:
    """A node of the tree: the shards it holds, and how it is split if it is."""

    first: int
    shards: int
    dim: int = 0
    cut: int = 0
    parts: list["Node"] = field(default_factory=list)


def category(col: Column) -> Column:
    """Value of a categorical column: its hash, so that equal values share a place."""
    return F.shiftrightunsigned(F.xxhash64(col), 64 - VALUE_BITS)


def scaled(col: Column, low: float, high: float) -> Column:
    """Value of a numeric column: its place between the table's smallest and largest; null at the low end."""
    width = (high - low) or 1.0
    return F.coalesce(((col.cast("double") - F.lit(low)) / F.lit(width) * F.lit(float(2**VALUE_BITS - 1))).cast("long"), F.lit(0))


def place(root: Node, dims: list[str], names: dict[int, int]) -> Column:
    """The deepest node made so far that a row falls into, by its number in ``names`` (-1: not there)."""
    if not root.parts:
        return F.lit(names.get(root.first, -1))
    return F.when(F.col(dims[root.dim]) < F.lit(root.cut), place(root.parts[0], dims, names)).otherwise(place(root.parts[1], dims, names))


def kd_tree(points: DataFrame, dims: list[str], weight: str, shards: int, total: int) -> Node:
    """The tree over ``points``, whose ``dims`` are longs of VALUE_BITS + TIE_BITS bits."""
    root = Node(0, shards)
    level = [root]
    while level := [n for n in level if n.shards > 1]:
        _split(points, dims, weight, root, level, LIGHT * total / shards)
        for n in level:
            half = n.shards // 2
            n.parts = [Node(n.first, half), Node(n.first + half, n.shards - half)]
        level = [p for n in level for p in n.parts]
    return root


def _split(points: DataFrame, dims: list[str], weight: str, root: Node, level: list[Node], light: float) -> None:
    """Chooses the dimension and the cut of every node of one level."""
    placed = points.withColumn("node", place(root, dims, {n.first: i for i, n in enumerate(level)})).where("node >= 0")
    below = VALUE_BITS + TIE_BITS - ROUNDS[0]  # bits not yet resolved
    first = placed.select("node", weight, F.posexplode(F.array(*[F.shiftright(d, below) for d in dims])).alias("dim", "bin"))
    sums = _sums(first, weight)
    open_: dict[int, tuple[int, float]] = {}  # node -> leading bits of the bin that holds the quantile, weight wanted within it
    for i, n in enumerate(level):
        mine = sums[sums["node"] == i]
        if len(mine):
            spans = [np.ptp(mine["bin"][mine["dim"] == d]) for d in range(len(dims))]
            n.dim = int(np.argmax(spans))
            mine = mine[mine["dim"] == n.dim]
            _narrow(n, i, mine, mine["w"].sum() * (n.shards // 2) / n.shards, 0, below, light, open_)
    for bits in ROUNDS[1:]:
        if not open_:
            break
        lookup = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("node") + 1)
        x = F.element_at(F.array(*map(F.col, dims)), lookup([n.dim + 1 for n in level]).cast("int"))
        prefix = lookup([open_[i][0] if i in open_ else -1 for i in range(len(level))])
        inside = placed.withColumn("x", x).where(F.shiftright("x", below) == prefix)
        below -= bits
        sums = _sums(inside.select("node", weight, F.lit(0).alias("dim"), F.shiftright("x", below).alias("bin")), weight)
        for i, (before, goal) in list(open_.items()):
            del open_[i]
            _narrow(level[i], i, sums[sums["node"] == i], goal, before, below, light, open_)


def _sums(rows: DataFrame, weight: str) -> np.ndarray:
    """Weight by node, dimension and bin: at most 2^15 bins a node, whatever the table's size."""
    t = rows.groupBy("node", "dim", "bin").agg(F.sum(weight).alias("w")).toArrow()
    out = np.zeros(t.num_rows, dtype=[("node", int), ("dim", int), ("bin", int), ("w", int)])
    for name in out.dtype.names:
        out[name] = t.column(name).to_numpy()
    return np.sort(out, order=["node", "dim", "bin"])


def _narrow(n: Node, i: int, bins: np.ndarray, goal: float, before: int, below: int, light: float, open_: dict) -> None:
    """Sets the cut if the bin that holds the quantile is light or cannot be divided; else leaves it open."""
    upto = np.cumsum(bins["w"])
    k = min(int(np.searchsorted(upto, goal)), len(bins) - 1)
    rest = goal - (upto[k] - bins["w"][k])
    if below and bins["w"][k] > light:
        open_[i] = int(bins["bin"][k]), float(rest)
    else:  # either side of the bin, whichever comes nearer to the goal
        n.cut = (int(bins["bin"][k]) + (rest > bins["w"][k] - rest)) << below


def kd_shards(docs: DataFrame, shards: int | None = 40, target_bytes: int | None = None, id_col: str = "doc_id",
              text_col: str = "text", categories: tuple[str, ...] = ("lang", "source"), overhead: int = 16) -> DataFrame:
    """A shard for every row, the shards' bytes nearly equal: ``doc_id, size, text_crc32, shard, slot``.

    ``shards`` fixes their number; else it is that of leaves of ``target_bytes``.
    Size is the text's UTF-8 bytes plus ``overhead`` (null text: the overhead
    alone, checksum 0).  Dimensions: the ``categories``, the logarithm of the
    size and the id.  Rows of one value are set apart by a hash of id and text, rows
    that repeat both by their number, so a hot value, a group of copies or a
    repeated id can be split anywhere.  ``slot`` numbers a shard's rows from 0 without gaps; repeated rows
    get slots of their own.  Null ids and categories are values like others; an
    empty table gives no rows.
    """
    n_bytes = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    # rows of one id and text differ in the last bits only, by their number in the written table
    at = F.shiftleft(F.xxhash64(F.col(id_col), F.col(text_col)), NUMBER_BITS).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(2**NUMBER_BITS - 1)))
    rows = written(docs.select(
        F.col(id_col).alias("doc_id"), (n_bytes + overhead).alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        at.alias("at"), *[category(F.col(c)).alias(f"v_{i}") for i, c in enumerate(categories)]), "points")
    seen = rows.agg(F.max("size"), F.min(F.col("doc_id").cast("double")), F.max(F.col("doc_id").cast("double")), F.sum("size")).first()
    if shards is None:
        shards = max(1, math.ceil((seen[3] or 0) / target_bytes))
    values = {f"v_{i}": F.col(f"v_{i}") for i in range(len(categories))}
    values["v_size"] = scaled(F.log2(F.col("size").cast("double")), 0.0, math.log2(seen[0] or 2))
    if seen[1] is not None:
        values["v_id"] = scaled(F.col("doc_id"), seen[1], seen[2])
    tie = F.col("at").bitwiseAND(F.lit(2**TIE_BITS - 1))
    dims = [v.replace("v_", "d_") for v in values]
    points = rows.select("doc_id", "size", "text_crc32", "at", *[F.shiftleft(v.cast("long"), TIE_BITS).bitwiseOR(tie).alias(d) for d, v in zip(dims, values.values(), strict=True)])
    root = kd_tree(points, dims, "size", shards, seen[3] or 0)
    placed = points.withColumn("shard", place(root, dims, {i: i for i in range(shards)}).cast("int")).drop(*dims)
    return running_total(placed, ["shard"], ["at", "doc_id", "text_crc32", "size"], F.lit(1), "slot", buckets=256).drop("at")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    placed = kd_shards(read(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
