"""Iterative set algorithms whose rounds are Spark jobs cut by checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.plans.session import checkpoint
from stepfold.plans.skew import lookup

#: Pairs that one task may go through in order.
FEW_PAIRS = 65_536


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of (a, b): node, component = smallest node of the component.

    Each round takes the smallest label among a node's neighbours, then follows the label
    one step on, so long chains halve. A hub's edges are pre-aggregated and split by lookup.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    ).distinct()
    both = checkpoint(both)
    labels = checkpoint(both.groupBy("node").agg(F.least(F.min("other"), F.min("node")).alias("component")))
    for _ in range(max_rounds):
        near = lookup(both, labels.withColumnRenamed("node", "other"), ["other"])
        near = near.groupBy("node").agg(F.min("component").alias("__c"))
        new = labels.join(near, "node").select("node", F.col("component").alias("__old"), F.least("component", "__c").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("__j"))
        new = lookup(new, jump, ["component"]).select("node", "__old", F.least("component", F.coalesce("__j", "component")).alias("component"))
        new = checkpoint(new)
        if new.where("component <> __old").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def greedy_matching(pairs: DataFrame, few: int = FEW_PAIRS) -> DataFrame:
    """Disjoint pairs a greedy pass over (sim desc, a, b) would take.

    A pair that is the best one left at both ends is certain to be taken, so every round
    takes all of those and drops their neighbours; the best pair left always qualifies.
    The last ``few`` pairs are gone through in order by one task.
    """
    left = checkpoint(pairs.select("a", "b", "sim"))
    taken = None
    best = F.struct((-F.col("sim")).alias("s"), F.col("a").alias("x"), F.col("b").alias("y"))
    while left.count() > few:
        ends = left.select(F.explode(F.array("a", "b")).alias("node"), best.alias("r"))
        top = ends.groupBy("node").agg(F.min("r").alias("r"))
        sure = top.groupBy("r").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        sure = checkpoint(sure.select(F.col("r.x").alias("a"), F.col("r.y").alias("b"), (-F.col("r.s")).alias("sim")))
        taken = sure if taken is None else taken.unionByName(sure)
        gone = sure.select(F.explode(F.array("a", "b")).alias("node"))
        rest = left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti")
        left = checkpoint(rest.join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b", "sim"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set = set()
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                keep.append(a not in met and b not in met)
                if keep[-1]:
                    met |= {a, b}
            yield batch.filter(pa.array(keep, pa.bool_()))

    last = left.repartition(1).sortWithinPartitions(F.desc("sim"), "a", "b").mapInArrow(walk, left.schema)
    return last if taken is None else taken.unionByName(last)
