"""Connected components of an edge list, by alternating star contraction.

Each round links every node's larger neighbours to its smallest neighbour
(large star), then every node's smaller neighbours likewise (small star).
Rounds needed grow with the logarithm of the longest path. Neighbourhoods are
never gathered: a round takes a minimum with map-side combine and joins it
back, both sides being plain scans that AQE can split at hot nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _star(edges: DataFrame, name: str) -> DataFrame:
    """(u, v) rows -> each v linked to the least of u and its neighbours; u too."""
    least = stage(edges.groupBy("u").agg(F.min("v").alias("m")), f"{name}-min")
    least = least.select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Edges (a, b) of longs -> (node, root): root is the smallest node reachable.
    Nodes without an edge to another node are not listed."""
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .distinct(), "cc")

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    seen = state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "cc-large").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), "cc-l")
        star = _star(large, "cc-small")
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            star.select("u", F.col("m").alias("v"))).where("u <> v")
        now = stage(small.distinct(), "cc")
        after = state(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
