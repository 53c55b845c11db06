"""Shared by the corpus operators: tables, expressions, bounded batches, checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepfold.plans.session import checkpoint  # noqa: F401

#: Rows per Arrow batch: texts of 100 kB stay far below an executor's memory.
BATCH_ROWS = 512
#: Text bytes worked on at a time inside a Python task.
CHUNK_BYTES = 4 << 20
#: ASCII white space, the separator of words in every contract.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Where all characters are ASCII, lower() is that, and much faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, separator: str = SPACE) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def sample_by_label(rows: DataFrame, label: str, n: int) -> DataFrame:
    """At most ``n`` distinct (doc_id, label) of every label, those with the smallest hashes.

    A hash threshold from the label's count first leaves about 4 n rows of it, so that what
    is then ranked does not grow with the table or its number of tasks.
    """
    rows = rows.select("doc_id", label)
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed(label, "__of")
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = rows.withColumn("__u", u).join(counts, F.col(label) == F.col("__of")).where(F.col("__u") * F.col("__n") < 4.0 * n)
    few = few.select("doc_id", label, "__u").distinct()
    order = Window.partitionBy(label).orderBy("__u", "doc_id")
    return few.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= n).select("doc_id", label)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        sizes = [len(x) if x is not None else 0 for x in (v.as_buffer() for v in batch.column(column))]
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
