"""Contamination flags, quarantine and completeness checks over samples and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.functions.text import any_marker
from stepfold.plans.skew import beside, first_per_group

# Markers of a refused tool result and of an exhausted quota.
REFUSED_MARKERS = [
    "api request failed with status 403", "status 403", "403 client error", "http 403", '"code":"403"',
    '"code": "403"', "'code': '403'",
]
QUOTA_MARKERS = [
    "you do not have enough money", "package quota", "not enough money", "insufficient quota",
    "insufficient balance", "quota", "billing", "余额", "余额不足",
]


def flag_error_scored(rollouts: DataFrame, threshold: float = 1.0, *, sample="sample_id", order="path") -> DataFrame:
    """Samples whose error answer was scored as right: one row each, its first rollout."""
    bad = F.lower(F.trim(F.coalesce("final_answer", F.lit("")))).startswith("error") & (F.col("accuracy_score") >= threshold)
    return first_per_group(rollouts.where(bad), [sample], [order]).withColumn("reason", F.lit("error_scored"))


def flag_text_patterns(files: DataFrame, patterns: Sequence[str], *, sample="sample_id", text="text") -> DataFrame:
    """Samples with any file line containing a pattern, ignoring case."""
    hit = any_marker(F.lower(F.col(text)), [p.lower() for p in patterns])
    return files.where(hit).select(sample).distinct().withColumn("reason", F.lit("text_pattern"))


def flag_quota_403(events: DataFrame, tools: Sequence[str], *, loose=False, keys=("sample_id", "rollout_id")) -> DataFrame:
    """Trajectories in which a target tool's own result was refused for quota; loose also
    takes a target tool and such an error on different lines."""
    low = F.lower(F.coalesce("tool_error", F.coalesce("tool_result", F.lit(""))))
    refused = any_marker(low, REFUSED_MARKERS) & any_marker(low, QUOTA_MARKERS)
    target = F.col("tool_name").isin(list(tools))
    d = events.select(*keys, target.alias("t"), (target & refused).alias("own"), refused.alias("any"))
    g = d.groupBy(*keys).agg(F.max("own").alias("own"), (F.max("t") & F.max("any")).alias("apart"))
    keep = F.col("own") | F.col("apart") if loose else F.col("own")
    return g.where(keep).select(*keys, F.lit("quota_403").alias("reason"))


def flag_multi_doc(events: DataFrame, *, distinct=False, keys=("sample_id", "rollout_id"), doc="doc_id") -> DataFrame:
    """Trajectories holding more than one document header, or more than one distinct one."""
    per = events.where(F.col(doc).isNotNull()).groupBy(*keys, doc).agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy(*keys).agg(F.sum("n").alias("entries"), F.count(F.lit(1)).alias("documents"))
    return g.where(F.col("documents" if distinct else "entries") > 1).withColumn("reason", F.lit("multi_doc"))


def flag_with_source(samples: DataFrame, outputs: DataFrame, benchmark: str, *, key="doc_id") -> tuple[DataFrame, DataFrame]:
    """Outputs of the benchmark's samples that have a source, and such samples without one."""
    has = F.exists("source", lambda s: F.trim(s) != "")
    ids = samples.where((F.col("benchmark_name") == benchmark) & has).select(key).distinct()
    return outputs.join(ids, key, "left_semi"), ids.join(outputs.select(key), key, "left_anti")


def quarantine(df: DataFrame, flags: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Clean rows, and flagged rows with all their reasons. Nothing is deleted."""
    reasons = flags.groupBy(key).agg(F.concat_ws(",", F.array_sort(F.collect_set("reason"))).alias("reasons"))
    return df.join(reasons.select(key), key, "left_anti"), df.join(reasons, key)


def profile_samples(samples: DataFrame, *, key="doc_id", tag="<image>") -> DataFrame:
    """One row: duplicate ids and rows, empty problems and solutions, image mismatches."""
    empty = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    none = F.coalesce(F.size("images"), F.lit(0)) <= 0
    facts = samples.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(none).alias("without_images"), F.count_if(empty("problem")).alias("empty_problem"),
        F.count_if(empty("solution")).alias("empty_solution"), F.count_if(none & F.contains("problem", F.lit(tag))).alias("placeholder_without_image"),
    )
    dup = samples.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dup = dup.agg(F.count(F.lit(1)).alias("duplicate_ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"))
    return beside(facts, dup)


def completion_status(rollouts: DataFrame, turns: DataFrame, n: int, *, sample="sample_id", rollout="rollout_id") -> DataFrame:
    """A sample is complete when n rollouts have metrics and at least one turn."""
    d = rollouts.join(turns, [sample, rollout], "left")
    good = F.col("completed") & (F.coalesce("turns", F.lit(0)) > 0)
    g = d.groupBy(sample).agg(F.count_if(good).alias("good_rollouts"))
    return g.withColumn("complete", F.col("good_rollouts") >= n)
