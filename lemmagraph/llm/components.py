"""Connected components of an edge list, by alternating large-star and small-star steps.

Each step keeps the components and moves every node nearer to the smallest node of its component; after
O(log^2 n) rounds only stars remain. A round is two aggregations (combined before the shuffle) and two joins
on the node, so a hub is a skewed join key that adaptive execution splits, never a group in one task.
Lineage is cut with a checkpoint in the shared folder after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Columns node, root: for every node that occurs in an edge the smallest node it reaches.

    Loops, repeated edges and edges with a null end are ignored; an empty edge list gives an empty result.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    e = cut(e.distinct())
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        e = cut(small.distinct())
        now = _state(e)
        if now == state:
            break
        state = now
    tips = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return tips.unionByName(tips.select(F.col("root").alias("node"), "root").distinct())
