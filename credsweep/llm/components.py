"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsweep.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node that has a link: the smallest node that it can reach.

    Every node has a parent, at first the smallest of itself and its neighbours.
    A round looks at the parents' parents of a node's neighbours and hangs the
    node, and the node's parent, under the smallest of them; so whole trees are
    hung up at once, and rounds grow with the logarithm of a path's length.
    Minima are aggregated before each shuffle, so a node with very many links is
    no single task's work; each round's parents are a table in the shared folder.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where(F.col(a) != F.col(b))
    both = written(both.union(both.select(F.col("other").alias("node"), F.col("node").alias("other"))), "links")

    def risen(parents: DataFrame) -> DataFrame:
        """``parents`` (node, parent) with each parent's parent."""
        return parents.join(parents.select(F.col("node").alias("parent"), F.col("parent").alias("top")), "parent")

    first = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("parent")), "parents")
    state = written(risen(first), "tops")
    while True:
        near = both.join(state.select(F.col("node").alias("other"), "top"), "other").groupBy("node").agg(F.min("top").alias("near"))
        seen = state.join(near, "node")
        lower = seen.select("node", F.least("near", "top").alias("low")).union(seen.select("parent", "near")) \
            .groupBy("node").agg(F.min("low").alias("low"))
        parents = written(state.join(lower, "node").select("node", F.least("parent", "low").alias("parent"), F.col("top").alias("was")), "parents")
        after = written(risen(parents.select("node", "parent")).join(parents.select("node", "was"), "node"), "tops")
        if after.where(F.col("top") != F.col("was")).isEmpty():
            return after.select("node", F.col("top").alias("label"))
        state = after.select("node", "parent", "top")
