"""Connected components by repeated contraction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of an edge, the smallest node it reaches.

    Each round maps every node to the best of itself and its neighbours, the one of
    most edges and then the first by a hash seeded with the round, and once more
    along that map; the edges are carried over to the images and repeats and loops
    go. A star is gone in one round, and on a path the hash makes the number of
    nodes fall by a constant share however the ids are ordered, so rounds grow with
    the logarithm of the longest path. A node with very many edges is only a key of
    a partial aggregate and of joins that adaptive execution splits. Rounds are
    written as tables: a checkpoint keeps the constraints of its plan, which double
    with every round. Null ends, loops and repeated edges mean nothing; without
    edges the result is empty.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    left = scratch(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    maps, seed = [], 0
    while not left.isEmpty():
        seed += 1
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        degree = both.groupBy("u").agg(F.count("*").alias("d"))
        other = both.join(degree.withColumnRenamed("u", "v"), "v")
        best = other.groupBy("u").agg(F.count("*").alias("d"), F.max(F.struct("d", F.xxhash64("v", F.lit(seed)).alias("h"), "v")).alias("m"))
        own = F.struct("d", F.xxhash64("u", F.lit(seed)).alias("h"), F.col("u").alias("v"))
        step = scratch(best.select("u", F.greatest(own, "m")["v"].alias("w")))
        ahead = step.select(F.col("u").alias("w"), F.col("w").alias("x"))
        step = scratch(step.join(ahead, "w").select("u", F.col("x").alias("w")))
        maps.append(step)
        to_v = step.select(F.col("u").alias("v"), F.col("w").alias("wv"))
        moved = left.join(step, "u").join(to_v, "v").select(F.col("w").alias("u"), F.col("wv").alias("v")).where("u <> v")
        left = scratch(moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if not maps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    label = maps[0].select(F.col("u").alias("node"), F.col("w").alias("at"))
    for step in maps[1:]:
        label = label.join(step.select(F.col("u").alias("at"), "w"), "at", "left").select("node", F.coalesce("w", "at").alias("at"))
    label = scratch(label)
    # as a table, so that the join has only exchanges below it, which adaptive execution can split
    least = scratch(label.groupBy("at").agg(F.min("node").alias("component")))
    return label.join(least, "at").select("node", "component")
