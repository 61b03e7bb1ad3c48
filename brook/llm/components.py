"""Connected components by alternating large-star and small-star steps, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node it reaches) for all nodes on an edge of ``edges`` (a, b: long).

    Each step keeps, for every node, only edges to the smallest neighbour; the edge set is written to the shared
    folder after each round.  Self edges and repeated edges do no harm; no edges give no rows.
    """
    spark = edges.sparkSession
    now = stored(spark, edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours go to the smallest one
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours and the node itself go to the smallest one
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        now = stored(spark, moved.filter("u <> v").distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).groupBy("node").agg(F.min("component").alias("component"))
