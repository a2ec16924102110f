"""Connected components of a stored edge list, by alternating large and small stars.

Every step is an aggregate and a join over the edges, written to the shared folder: no node's
neighbours are gathered in one place, and a lost executor costs a reread. The number of steps grows
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import stored


def _linked(both: DataFrame, larger: bool) -> DataFrame:
    """Neighbours of each node u that are larger (or else not larger) than u, linked to u's least neighbour or u itself."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    side = both.filter("v > u" if larger else "v < u")
    out = side.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not larger:  # the node itself goes to its least neighbour too
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, root) for each node on an edge of `edges` (a, b: longs); root is the least node that it reaches."""
    now = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, f"{name}-0")
    mark, turn = None, 0
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark, turn = seen, turn + 1
        swapped = now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(swapped)
        stars = _linked(both, larger=True)
        down = stars.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        now = stored(_linked(down, larger=False), folder, f"{name}-{turn}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
