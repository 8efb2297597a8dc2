"""Connected components of an edge table, by alternating star contraction in DataFrame operations.

Each round halves what is left of long paths: in a large star every larger neighbour of a node is tied to the node's
smallest neighbour, in a small star the smaller ones are. Rounds are written to the shared folder, so lineage stays
short; only three numbers a round (the count and two hashes of all edges, which tell whether any changed) reach the
driver. Minima are pre-aggregated before the shuffle and joined back, so that a hub's edges can be split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(pairs: DataFrame, low: str, high: str) -> DataFrame:
    """Edges (a, b) with a < b, of (node, other) pairs: ``high`` filters what is tied to the least of each node."""
    least = pairs.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
    tied = pairs.join(least, "node").where(high)
    return tied.select(F.col("least").alias("a"), F.col(low).alias("b")).where("a < b")


def _mark(edges: DataFrame) -> tuple:
    """Tells one set of edges from another, whatever the order of rows."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (columns a, b, any order): component is its smallest node.

    Null ends and loops are left out; repeated edges count once. No edges give no rows. Raises if ``max_rounds``
    rounds do not settle the components (they need about the logarithm of the longest path).
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    mark = _mark(e)
    for _ in range(max_rounds):
        both = e.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("other")))
        large = _star(both, "other", "other > node").distinct()
        down = large.select(F.col("b").alias("node"), F.col("a").alias("other"))
        least = down.groupBy("node").agg(F.min("other").alias("least"))
        tied = down.join(least, "node")
        small = tied.select(F.col("least").alias("a"), F.col("other").alias("b")).unionByName(least.select(F.col("least").alias("a"), F.col("node").alias("b"))).where("a < b").distinct()
        small = written(small, "edges")
        e, before, mark = small, mark, _mark(small)
        if mark == before:
            members = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
            return members.unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
