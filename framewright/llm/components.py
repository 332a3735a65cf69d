"""Connected components of any size, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few


def _to_least(edges: DataFrame, rows: int) -> DataFrame:
    """Every neighbour's edge to the least of a node and its neighbours: u, v, least."""
    least = cut(few(edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")), rows))
    # Both sides are exchanged for this join alone, so AQE splits a node with very many neighbours.
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """The least node reachable from each node of the edges (u, v): node, root.

    Two alternating steps turn any graph into stars. Each round is written to the shared
    checkpoint folder; the number of rounds grows with the logarithm of the longest path.
    Null ends and loops are left out; without edges there are no rows.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), anew=True)
    mark, n = None, now.count()
    now = few(now, n)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        large = cut(few(large, 2 * n))
        near = _to_least(large, n)
        small = near.select(F.col("v").alias("u"), F.col("least").alias("v")).union(near.select("u", F.col("least").alias("v")))
        now = cut(few(small.where("u <> v").distinct(), n), anew=True)
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
