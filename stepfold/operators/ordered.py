"""Merging a batch of operations into a library in their order, a block of operations at a time.

One by one, an operation sees the library that the operations before it have left: an addition
takes in the up to k items most similar to it, which go, and its result is an item that later
ones may take in. A round decides the next block of operations. All tasks look up, among the
items alive before the block, a multiple of k items for each of its operations; these and the
items that the block makes are all that it can take in, so one task goes through the block in
order. Where an operation may need an item that was not looked up, as too many of its own went
to the operations before it, the block ends before it and the next ones are shorter, with more
items for each: one of up to ``LEAST`` operations always goes through. So the
rounds grow with the number of operations, whatever touches what.

A task holds one block of operations and at most ``LOOKED * k`` items beside it. Decisions are
written down by round; every ``FOLD`` rounds they are taken into the library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.operators import balls as B
from stepfold.operators.similarity import DIGITS, block_topk
from stepfold.plans.session import checkpoint, scratch
from stepfold.plans.skew import top_k

#: Operations in a block at most and at least; items looked up for a block, as a multiple of k;
#: rounds after which the library is written anew.
OPS, LEAST, LOOKED, FOLD = 512, 64, 4096, 8
PLAN = "op_id long, action string, node long, taken array<long>, embedding array<double>"


def plan_ordered_merges(existing: DataFrame, ops: DataFrame, threshold: float = 0.70, k: int = 10, *, report: list | None = None) -> DataFrame:
    """op_id, action, node, taken, embedding: what each operation does in its place.

    ``existing``: id (long, not negative), embedding. ``ops``: op_id (long, not negative: the
    order), option, modified_from, embedding. Modifying an item that is still there replaces it
    when all is done (action replace, node the item); anything else adds. An addition becomes
    item ``node`` = largest id + 1 + op_id; with similar items (``taken``, most similar first,
    ties by number) the action is merge and its vector the mean of all. ``report`` gets the
    number of rounds.
    """
    spark = existing.sparkSession
    vectors = F.col("embedding").cast("array<double>").alias("embedding")
    library = checkpoint(existing.select(F.col("id").cast("long").alias("node"), vectors))
    target = F.when(F.col("option") == "modify", F.col("modified_from").cast("long")).alias("target")
    ops = checkpoint(ops.select(F.col("op_id").cast("long").alias("op_id"), target, vectors))
    top = library.agg(F.coalesce(F.max("node") + 1, F.lit(0))).first()[0]
    folder = scratch(spark, "merges")
    read = lambda rounds: spark.read.schema(PLAN).parquet(*[f"{folder}/{r}" for r in rounds])
    last, size, n, recent = -1, OPS, 0, []
    while True:
        block = checkpoint(ops.where(F.col("op_id") > last).orderBy("op_id").limit(size))
        asked = block.count()
        if not asked:
            break
        alive = library
        if recent:
            made = read(recent)
            gone = made.select(F.explode("taken").alias("node"))
            alive = library.unionByName(made.where("action <> 'replace'").select("node", "embedding")).join(F.broadcast(gone), "node", "left_anti")
        ahead = k * max(1, LOOKED // size)
        hits = block_topk(block.select(F.col("op_id").alias("id"), "embedding"), alive.select(F.col("node").alias("id"), "embedding"), ahead, threshold)
        hits = checkpoint(hits)
        found = hits.groupBy(F.col("query_id").alias("op_id")).agg(F.array_sort(F.collect_list(F.struct("rn", "item_id", "sim"))).alias("l"))
        found = block.join(found, "op_id", "left").select("op_id", "target", "embedding", F.col("l.item_id").alias("near"), F.col("l.sim").alias("sims"))
        needed = hits.select(F.col("item_id").alias("node")).union(block.select("target").where("target IS NOT NULL")).distinct()
        items = alive.join(F.broadcast(needed), "node", "left_semi").withColumnRenamed("node", "op_id")
        both = found.withColumn("op", F.lit(True)).unionByName(items.withColumn("op", F.lit(False)), allowMissingColumns=True)
        both.repartition(1).mapInArrow(_decide(top, threshold, k, ahead), PLAN).write.parquet(f"{folder}/{n}")
        done, last = read([n]).agg(F.count(F.lit(1)), F.max("op_id")).first()
        recent.append(n)
        n += 1
        size = min(OPS, 2 * size) if done == asked else max(LEAST, done)
        if len(recent) == FOLD:
            made = read(recent)
            gone = made.select(F.explode("taken").alias("node"))
            library = checkpoint(library.unionByName(made.where("action <> 'replace'").select("node", "embedding")).join(F.broadcast(gone), "node", "left_anti"))
            recent = []
    if report is not None:
        report.append(n)
    return spark.read.schema(PLAN).parquet(f"{folder}/*") if n else spark.createDataFrame([], PLAN)


def _decide(top: int, threshold: float, k: int, ahead: int):
    """The block in order: op rows have their ``ahead`` nearest items of before, the other rows
    are these items and the targets that are there. Ends before an operation that may need more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo, vector = [], {}
        for batch in batches:
            flat = [None if x is None else x.values.to_numpy(zero_copy_only=False) for x in map(_valid, batch.column("embedding"))]
            names, is_op = batch.column("op_id").to_pylist(), batch.column("op").to_pylist()
            target, near, sims = (batch.column(c).to_pylist() for c in ("target", "near", "sims"))
            for i, name in enumerate(names):
                if is_op[i]:
                    todo.append((name, target[i], flat[i], near[i] or [], sims[i] or []))
                else:
                    vector[name] = flat[i]
        todo.sort(key=lambda o: o[0])
        gone, out = set(), []
        width = max((len(o[2]) for o in todo if o[2] is not None), default=0)
        units, made = np.zeros((len(todo), width)), []
        for op, target, own, near, sims in todo:
            if target is not None and target in vector and target not in gone:
                out.append((op, "replace", target, [], own))
                continue
            best = []
            if own is not None:
                best = [(-s, x) for x, s in zip(near, sims) if x not in gone]
                new = np.round(units[: len(made)] @ B.unit(own[None])[0], DIGITS)
                best += [(-new[j], made[j]) for j in np.flatnonzero(new >= threshold) if made[j] not in gone]
                best = sorted(best)[:k]
                # items that were not looked up come after the last one that was
                if len(near) == ahead and (len(best) < k or best[-1] > (-sims[-1], near[-1])):
                    break
            taken = [x for _, x in best]
            total = own
            for x in taken:
                total = total + vector[x]
            mean = total / (len(taken) + 1) if taken else own
            if mean is not None:
                units[len(made)] = B.unit(mean[None])[0]
                made.append(top + op)
            gone.update(taken)
            vector[top + op] = mean
            out.append((op, "merge" if taken else "add", top + op, taken, mean))
        if out:
            op, action, node, taken, mean = zip(*out)
            kinds = pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())
            columns = op, action, node, taken, [None if m is None else m.tolist() for m in mean]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["op_id", "action", "node", "taken", "embedding"])

    return run


def _valid(x: pa.Scalar) -> pa.Scalar | None:
    return x if x.is_valid else None


def roots(taken: DataFrame, max_rounds: int = 64) -> DataFrame:
    """node, root: where each item that was taken in ended up, by doubling (node, into)."""
    now = checkpoint(taken.select("node", F.col("into").alias("root")))
    for _ in range(max_rounds):
        on = now.select(F.col("node").alias("root"), F.col("root").alias("__next"))
        new = checkpoint(now.join(on, "root", "left").select("node", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")))
        if new.where("__moved").isEmpty():
            return new.select("node", "root")
        now = new.select("node", "root")
    raise RuntimeError("a chain of merges did not end")


def apply_ordered_merges(existing: DataFrame, ops: DataFrame, plan: DataFrame) -> DataFrame:
    """The library after the batch: id, text, embedding. A merged item has the texts of all it
    took in, by number; replacing takes the last operation's text and vector, if the item is
    still there. ``existing``: id, text, embedding; ``ops``: op_id, text."""
    library = existing.select(F.col("id").cast("long").alias("node"), "text", F.col("embedding").cast("array<double>").alias("embedding"))
    made = plan.where("action <> 'replace'").join(ops.select(F.col("op_id").cast("long").alias("op_id"), "text"), "op_id")
    every = library.unionByName(made.select("node", "text", "embedding"))
    end = roots(plan.select(F.explode("taken").alias("node"), F.col("node").alias("into")))
    texts = every.select("node", "text").join(end, "node", "left").withColumn("root", F.coalesce("root", "node"))
    texts = texts.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("node", "text"))).alias("l"))
    texts = texts.select(F.col("root").alias("node"), F.concat_ws("\n\n", F.transform("l", lambda x: x["text"])).alias("text"))
    last = top_k(plan.where("action = 'replace'"), ["node"], [F.desc("op_id")], 1)
    last = last.join(ops.select(F.col("op_id").cast("long").alias("op_id"), F.col("text").alias("__text")), "op_id").select("node", "__text", F.col("embedding").alias("__embedding"))
    left = every.drop("text").join(texts, "node").join(last, "node", "left")
    return left.select(F.col("node").alias("id"), F.coalesce("__text", "text").alias("text"), F.coalesce("__embedding", "embedding").alias("embedding"))
