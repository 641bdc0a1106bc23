"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueframe.llm.common import cut


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)``: the smallest node reachable
    from each node that has an edge to another one.

    Each round joins every edge to the smallest neighbour of its end, which
    takes partial aggregates and one shuffled join; nothing is gathered by
    node, so a hub costs no more than its edges.  Rounds grow with the
    logarithm of the longest path.  Self-loops and repeated edges are allowed;
    no edges give no rows.  Nulls are dropped.
    """
    star = cut(
        edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
        .where("a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = star.unionByName(star.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        # Large star: each larger neighbour of a node goes to the node's minimum.
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # Small star: the smaller neighbours of a node, and itself, go to the least of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        star = cut(small.unionByName(least.select("v", F.col("m").alias("u"))).distinct())
        now = star.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = star.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return star.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)
