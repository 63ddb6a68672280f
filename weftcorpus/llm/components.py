"""Connected components of an edge table, by alternating large and small stars.

Each round is two shuffles of the edges, aggregated before they move; the rounds
are written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftcorpus.llm.common import drop, written


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex has one smaller neighbour at most and that has none: then v is the root of u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("x").agg(F.sum("up").alias("ups"), F.max("root").alias("root")).where("ups > 1 OR (ups = 1 AND root = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every end of edges (a, b): root is the smallest vertex that v reaches. The number of
    rounds grows with the square of the logarithm of a component's size."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        if _stars(now):
            return now.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(now.select("v", F.col("v").alias("root")).distinct())
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(root.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "edges")
        drop(now)
        now = after
