"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mitoloom.llm.shared import cut, free_finished


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) links in, (node, root) out: root is the smallest node of the component; roots are included.

    Null ends and self links are ignored; no rows give no rows. Each round is a few keyed aggregates and joins
    whose output is checkpointed; only two numbers a round reach the driver. Stars converge in two rounds.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)
    for turn in range(rounds if before[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        # large star: every larger neighbour of u moves to the smallest of u and its neighbours
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(lowest, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u <> v").distinct())
        after = _state(edges)
        if turn % 3 == 2:
            free_finished(edges.sparkSession)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not converge")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))
