"""Connected components by alternating star contraction, a few Spark jobs a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.base import checkpoint


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``edges`` (a, b: longs).

    Large star: every node sends its larger neighbours to its smallest one; small star: its
    smaller ones and itself. Neighbourhoods are never gathered: their minimum is an aggregate
    that comes back by a join, whose skewed keys the adaptive planner splits. Each round ends
    in the shared checkpoint folder. Self loops and repeated edges do no harm.
    """
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = checkpoint(small.select("e.a", "e.b").where("a <> b").distinct())
        # settled when every node points at one smaller node that points nowhere
        roots = new.select("b").distinct()
        if new.join(roots.withColumnRenamed("b", "a"), "a", "left_semi").isEmpty() and new.groupBy("a").count().where("count > 1").isEmpty():
            nodes = new.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
        now = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")
