"""Ranking texts by BM25 over posting lists, with bounds instead of scores where they suffice.

Postings. The (document, weight) pairs of each query term are sorted by weight and cut into
blocks of ``BLOCK`` by a range partitioning over (term, weight): the list of a term that every
document holds fills as many tasks as it needs, and each block knows its largest weight.

Ranking. (1) A query's rarest terms name a few likely documents, which are scored in full; the
k-th best of them is a floor, as the k-th best of all documents is no lower. (2) Its terms of the smallest bounds, as many as cannot reach the
floor together, only add to documents that some other term has found; a block of another
term is left out where its largest weight and the bounds of all other terms stay below the
floor. What is left meets the query in an equi-join on the term and is summed by (query,
document). (3) Documents whose sum and the bounds of the terms put aside reach the floor look
these terms up by (document, term). No query meets a document with which it shares no term,
and a query's frequent terms don't list their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfold.plans.session import checkpoint
from stepfold.plans.skew import top_k

#: Postings in a block.
BLOCK = 1024
#: Postings, as a multiple of k, that a query's rarest terms supply for its floor, about.
SEED = 32
#: Documents scored in full for the floor, as a multiple of k.
TRIED = 4
#: What summing in another order and rounding before the ranking may change.
SLACK = 2e-9


def terms_of(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def weights(terms: DataFrame, docs: DataFrame, k1: float, b: float) -> DataFrame:
    """term, doc_id, w: the BM25 weight of every given term in every document that holds it. A row
    with ``copies`` stands for so many documents."""
    copies = F.col("copies") if "copies" in docs.columns else F.lit(1)
    d = docs.select("doc_id", copies.cast("long").alias("copies"), terms_of(F.col("text")).alias("t")).withColumn("len", F.size("t"))
    # the empty term stands for the document itself, so that one pass over the texts counts both
    each = F.concat(F.array(F.lit("")), F.coalesce("t", F.array().cast("array<string>")))
    words = d.select("doc_id", "copies", "len", F.explode(each).alias("term")).join(terms.unionByName(terms.sparkSession.createDataFrame([("",)], "term string")), "term", "left_semi")
    both = checkpoint(words.groupBy("doc_id", "copies", "len", "term").agg(F.count(F.lit(1)).alias("tf")))
    rows = F.col("tf") * F.col("copies")
    n, total, measured = both.where("term = ''").agg(F.sum(rows), F.sum(F.col("len") * rows), F.sum(F.when(F.col("len").isNotNull(), rows))).first()
    n, avg = n or 0, total / measured if total else None
    tf = both.where("term <> ''")
    df = tf.groupBy("term").agg(F.sum("copies").alias("df"))
    idf = df.select("term", F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    w = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(float(avg or 1))))
    return tf.join(idf, "term").select("term", "doc_id", w.alias("w"))


def pack(posts: DataFrame, block: int = BLOCK) -> DataFrame:
    """term, most, docs, ws: postings in blocks of falling weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut(rows: pa.RecordBatch) -> pa.RecordBatch:
            codes = rows.column("term").dictionary_encode().indices.to_numpy()
            new = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            starts = np.concatenate([np.arange(a, z, block) for a, z in zip(new, [*new[1:], len(rows)])])
            offsets = pa.array(np.append(starts, len(rows)).astype(np.int32))
            ends = pa.array(starts)
            return pa.RecordBatch.from_arrays(
                [rows.column("term").take(ends), rows.column("w").take(ends), pa.ListArray.from_arrays(offsets, rows.column("doc_id")), pa.ListArray.from_arrays(offsets, rows.column("w"))],
                names=["term", "most", "docs", "ws"],
            )

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 32 * block:
                yield cut(pa.concat_batches(held))
                held.clear()
        if held and sum(map(len, held)):
            yield cut(pa.concat_batches(held))

    order = ["term", F.desc("w"), "doc_id"]
    ids = posts.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("most", T.DoubleType()), T.StructField("docs", T.ArrayType(ids)), T.StructField("ws", T.ArrayType(T.DoubleType()))])
    return posts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _spread(blocks: DataFrame, *keep: str) -> DataFrame:
    each = blocks.select(*keep, F.explode(F.arrays_zip("docs", "ws")).alias("p"))
    return each.select(*keep, F.col("p.docs").alias("doc_id"), F.col("p.ws").alias("w"))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, *, k1=0.9, b=0.4, digits: int = 12, block: int = BLOCK, report: list | None = None) -> DataFrame:
    """k best documents per query by BM25 (query_id, doc_id, score, rn). Query terms count
    once. ``queries`` has query_id, text; ``docs`` has doc_id, text. Documents that share no
    term with a query are not ranked for it. Scores are rounded to ``digits`` before ranking,
    ties go to the smaller doc_id. ``docs`` may have copies: how many documents a row stands for. A null text counts as a document but not in the mean length. ``report`` gets the rows that queries and blocks make."""
    q = checkpoint(queries.select("query_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).distinct())
    blocks = checkpoint(pack(weights(q.select("term").distinct(), docs, k1, b), block))
    lists = blocks.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max("most").alias("top"))
    qt = q.join(lists, "term")
    rarest = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    seed = qt.withColumn("__before", F.coalesce(F.sum("df").over(rarest), F.lit(0))).where(F.col("__before") < SEED * k)
    part = _spread(seed.select("query_id", "term").join(blocks, "term"), "query_id").groupBy("query_id", "doc_id").agg(F.sum("w").alias("w"))
    likely = top_k(part, ["query_id"], [F.desc("w"), F.col("doc_id")], TRIED * k).select("query_id", "doc_id")
    tried = likely.join(q, "query_id").join(_spread(blocks, "term"), ["doc_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum("w").alias("w"))
    kth = top_k(tried, ["query_id"], [F.desc("w")], k).where(F.col("rn") == k).select("query_id", F.col("w").alias("floor"))
    # terms in the order of their bounds: those whose running sum stays below the floor are put aside
    upward = Window.partitionBy("query_id").orderBy("top", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = qt.join(kth, "query_id", "left").withColumns({"floor": F.coalesce("floor", F.lit(0.0)) - SLACK, "__sum": F.sum("top").over(upward), "__all": F.sum("top").over(Window.partitionBy("query_id"))})
    ranked = checkpoint(ranked.withColumn("aside", F.col("__sum") < F.col("floor")))
    lookup = ranked.where("aside").select("query_id", "term")
    bound = ranked.groupBy("query_id").agg(F.first("floor").alias("floor"), F.coalesce(F.max(F.when(F.col("aside"), F.col("__sum"))), F.lit(0.0)).alias("rest"))
    finders = ranked.where("not aside").select("query_id", "term", (F.col("floor") - F.col("__all") + F.col("top")).alias("__least"))
    met = finders.join(blocks, "term").where(F.col("most") >= F.col("__least"))
    sums = _spread(met, "query_id").groupBy("query_id", "doc_id").agg(F.sum("w").alias("w"))
    found = checkpoint(sums.join(bound, "query_id").where(F.col("w") + F.col("rest") >= F.col("floor")).select("query_id", "doc_id", "w"))
    if report is not None:
        report += [met.select(F.size("docs").alias("n")), found, qt]
    asked = found.select("query_id", "doc_id").join(lookup, "query_id")
    more = asked.join(_spread(blocks, "term"), ["doc_id", "term"]).select("query_id", "doc_id", "w")
    full = found.unionByName(more).groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), digits).alias("score"))
    return top_k(full, ["query_id"], [F.desc("score"), F.col("doc_id")], k)
