"""A training corpus from raw documents: five stages, each reading what the one before wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Stages keep whatever their operator does not decide against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.llm import base, decontaminate, langid, mixing, simhash, substrings
from stepfold.plans.session import configure, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence."""
    return langid.predict(docs, langid.fit(docs)).where(~F.col("rejected")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id (nulls last), then
    the smallest hash of the text and of the row. Ids need not tell rows apart."""
    row = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("__text"), row.alias("__row"))
    named = simhash.near_duplicates(hashed, carry=("__text", "__row"))
    least = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__text", "__row")).alias("m"))
    stay = least.select(F.col("m.doc_id").alias("__id"), F.col("m.__row").alias("__stay"))
    kept = docs.withColumn("__row", row)
    kept = kept.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__stay")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__row"]).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents have; a text with no word left goes."""
    left = substrings.deduplicate(docs)
    some = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    left = left.where(some).withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return left.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    found = decontaminate.contamination(docs, base.table(spark, sf_dir, "benchmark")).where("contaminated")
    bad = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken so that sources meet their target weights."""
    return mixing.mix_plan(docs).drop("copy_no")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
]
#: Gradient descent and component contraction have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    configure(spark)
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
