"""Connected components by alternating large and small stars (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of any one ordered type -> ``(node, root)``, root the smallest node reachable.

    Nodes without an edge to another node are not returned.  Null ends and loops are
    ignored; repeated edges count once.  Each round aggregates to one minimum per node before it
    joins, so a hub of any degree is pre-aggregated on the map side, and the join that
    brings the minimum back is one Spark may split by skew.  Rounds grow with the
    logarithm of the longest path.  Every round is a written table.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur = scratch.put(e)
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked to the least of u and its neighbours
        both = _both(cur)
        # stored, so that the join reads two plain exchanges and a hub's rows can be split
        least = scratch.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u")
        seen = scratch.put(large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"),
                                                       (F.col("m") != F.col("u")).alias("moved")))
        # small star: u and its smaller neighbours are linked to the least of them
        down = seen.where("u <> v").select("u", "v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        star = (down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        nxt = scratch.put(star)
        # a forest of stars: no edge moved, and each node has one parent
        moved = seen.where("moved").limit(1).count()
        done = not moved and not nxt.groupBy("u").count().where("count > 1").limit(1).count() and not (
            nxt.select(F.col("v").alias("u")).join(nxt.select("u"), "u", "left_semi").limit(1).count())
        scratch.drop(cur, least, seen)
        cur = nxt
        if done:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
