"""Connected components by alternating large-star and small-star steps, each a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.session import Cut


def _lowest(pairs: DataFrame) -> DataFrame:
    """For each ``u`` the smallest of it and its ``v``; partial sums keep a hub's edges out of one task."""
    return pairs.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("m"))


def connected_components(edges: DataFrame, cut: Cut, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, comp)`` for every node with an edge to another; ``comp`` is the component's smallest node.

    Edges may repeat, come in either direction or be loops; those with a null end are left out. No edges give no rows.
    """
    edges = edges.select(F.col(left).alias("_a"), F.col(right).alias("_b"))
    edges = edges.filter("_a <> _b").select(F.greatest("_a", "_b").alias("u"), F.least("_a", "_b").alias("v")).distinct()
    now, seen = cut.write(edges), None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.join(_lowest(large), "u").select(F.col("v"), F.col("m"), F.col("u"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = cut.write(small)
        mark = after.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        cut.drop(now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
