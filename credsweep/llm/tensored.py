"""MinHash near-duplicates with tensored banding.

Two collections hold M tuples of A minhashes each.  A table's key is made of one
tuple of the first and one of the second, so M * M tables, each of 2 A minhashes,
take 2 M A of them instead of 2 M * M * A: about a square root.  Two sets of
similarity s share a key unless all tuples of one collection differ:
(1 - (1 - s^A)^M)^2, which is 0.99998 for A = 3, M = 12 at 0.85.  Sets that share
a key are compared on their shingles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsweep.llm import linking
from credsweep.llm.common import read, written
from credsweep.llm.shingles import mix

#: Minhashes of a tuple, and tuples of a collection.
A, M = 3, 12
#: Shingles that are hashed at a time.
PART = 1 << 15
_TURN = np.uint64(0x9E3779B97F4A7C15)


class TensoredBands:
    """The keys of a set, for tuples of ``a`` minhashes and collections of ``m`` tuples."""

    def __init__(self, a: int = A, m: int = M) -> None:
        self.a, self.m = a, m
        rng = np.random.default_rng(20240611)
        # shingles are well mixed 64-bit hashes: times an odd number, turned and times another they stand in another order
        self.factors = rng.integers(1, 1 << 62, (2, 2 * m * a, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.tables = mix(np.arange(1, m * m + 1, dtype=np.uint64)).reshape(m, m)

    def minhashes(self, shingles: np.ndarray) -> np.ndarray:
        """The least hash of a set under each of 2 m a functions."""
        out = np.full(2 * self.m * self.a, np.uint64((1 << 64) - 1))
        for i in range(0, len(shingles), PART):
            x = shingles[i:i + PART] * self.factors[0]
            x ^= x >> np.uint64(32)
            x *= self.factors[1]
            out = np.minimum(out, x.min(axis=1))
        return out

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """The set's m * m keys."""
        tuples = np.zeros(2 * self.m, np.uint64)
        for column in self.minhashes(shingles).reshape(2 * self.m, self.a).T:
            tuples = mix(tuples * _TURN + column)
        return mix(tuples[:self.m, None] * _TURN + tuples[self.m:] + self.tables).ravel()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85, a: int = A, m: int = M, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, text_hash, cls, n_shingles, component, component_id, kept``.

    Texts link when the Jaccard similarity of their sets of ``size``-word
    shingles is at least ``percent`` / 100, confirmed on the full sets;
    ``component_id`` is the smallest id reachable by links and ``kept`` tells the
    documents with that id.  Equal sets are linked (``cls`` is their hash), but an
    empty set (null or blank text) with nothing: its row is its own component and
    stays.  A null id is never the smallest unless there is no other, and then
    counts as kept; repeated rows and ids are rows like others; an empty table
    gives no rows.  The tables hold each set's keys, m * m numbers, once a task.
    """
    like = linking.Likeness(percent)
    sets = written(linking.described(docs, size, TensoredBands(a, m).keys, id_col, text_col), "sets")
    return linking.classed(docs, sets, size, like, None, id_col, text_col).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under 5-word shingles and a similarity of 0.85, and whether it is the one to keep."""
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
