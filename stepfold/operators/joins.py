"""Lookups, reconciliations and checked column unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.functions.normalize import prefixed_id
from stepfold.plans.skew import first_per_group, lookup, match, rename_keys


def sample_lookup(samples: DataFrame, *, doc_id="doc_id", benchmark="benchmark_name", order="ord") -> DataFrame:
    """Every sample under its raw id and its benchmark-prefixed id; the first sample wins."""
    full = prefixed_id(F.col(doc_id), F.col(benchmark))
    keys = F.array_distinct(F.array(F.trim(F.col(doc_id).cast("string")), full))
    d = samples.withColumn("key", F.explode(keys))
    return first_per_group(d, ["key"], [order])


def infer_benchmark(df: DataFrame, table: DataFrame, sidecar: DataFrame, known: Sequence[str], *, key="sample_id") -> DataFrame:
    """Own field, then lookup, then sidecar metadata, then id prefix, then unknown."""
    t = table.select(F.col("key").alias(key), F.col("benchmark_name").alias("__look"))
    s = sidecar.select(key, F.col("benchmark_name").alias("__side"))
    d = lookup(lookup(df, t, [key]), s, [key])
    prefix = F.coalesce(*[F.when(F.lower(key).startswith(b), b) for b in known])
    filled = [F.nullif(F.col(c), F.lit("")) for c in ("benchmark", "__look", "__side")]
    return d.withColumn("benchmark", F.coalesce(*filled, prefix, F.lit("unknown"))).drop("__look", "__side")


def expected_vs_actual(samples: DataFrame, outputs: DataFrame, *, benchmark="benchmark") -> DataFrame:
    """Expected, output and missing counts of benchmarks on either side."""
    a = samples.groupBy(benchmark).agg(F.count(F.lit(1)).alias("expected"))
    b = outputs.groupBy(benchmark).agg(F.count(F.lit(1)).alias("output"))
    d = a.join(b, benchmark, "full").na.fill(0, ["expected", "output"])
    return d.withColumn("missing", F.greatest(F.col("expected") - F.col("output"), F.lit(0)))


def select_by_membership(outputs: DataFrame, samples: DataFrame, targets: Sequence[str], *, include_ambiguous=False, key="sample_id", benchmark="benchmark") -> DataFrame:
    """Marks outputs whose id belongs to a target benchmark and to no other one."""
    hit = F.col(benchmark).isin(list(targets))
    m = samples.groupBy(key).agg(F.max(hit).alias("__in"), F.max(~hit).alias("__out"))
    d = lookup(outputs, m, [key])
    reason = (
        F.when(F.col("__in").isNull(), "unknown_id")
        .when(~F.col("__in"), "not_target")
        .when(F.col("__out") & F.lit(not include_ambiguous), "ambiguous_id")
        .otherwise("")
    )
    return d.withColumns({"selected": reason == "", "reason": reason}).drop("__in", "__out")


def merge_columns(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Columns of two tables on one key; both must have the same keys, and shared columns must
    agree, NaN and NULL included, and keys must have the same types. Anything else is an error."""
    on = list(on)
    for k in on:  # else the join would cast one side before anything is compared
        if left.schema[k].dataType != right.schema[k].dataType:
            raise TypeError(f"key {k} is {left.schema[k].dataType.simpleString()} in one table and {right.schema[k].dataType.simpleString()} in the other")
    shared = [c for c in right.columns if c in left.columns and c not in on]
    r = right.withColumnsRenamed({c: f"__r_{c}" for c in shared})
    sides = left.withColumn("__left", F.lit(True)), rename_keys(r, on).withColumn("__right", F.lit(True))
    d = sides[0].join(sides[1], match(on), "full")
    lost = F.raise_error(F.lit("a key is in one of the two tables only")).cast("boolean")
    d = d.where(F.when(F.col("__left") & F.col("__right"), True).otherwise(lost))
    checked = {
        c: F.when(F.col(c).eqNullSafe(F.col(f"__r_{c}")), F.col(c)).otherwise(
            F.raise_error(F.lit(f"column {c} differs between the two tables")).cast(left.schema[c].dataType)
        )
        for c in shared
    }
    keep = [checked[c].alias(c) if c in checked else F.col(c) for c in left.columns]
    new = [c for c in right.columns if c not in left.columns]
    return d.select(*keep, *new)


def catalog_join(products: DataFrame, attributes: DataFrame, reviews: DataFrame, *, key="asin", missing: str = "DUMMY_ATTR") -> DataFrame:
    """Products with their attributes (a placeholder when none) and review, if any."""
    d = products.join(attributes, key, "left").join(reviews, key, "left")
    return d.withColumn("attributes", F.coalesce("attributes", F.array(F.lit(missing))))
