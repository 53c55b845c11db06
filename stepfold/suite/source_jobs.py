"""Round trips of the given tables through the file formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.operators.memory import snapshot
from stepfold.plans import views as V
from stepfold.plans.session import scratch
from stepfold.sources import files as S
from stepfold.suite.registry import query


@query("record_files_round_trip", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS benchmark_name, md5(text) AS problem FROM documents
UNION ALL SELECT 'b' || item_id, 'bench', md5(text) FROM benchmark""")
def _(spark, sf):
    path = scratch(spark, "records")
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("benchmark_name"), F.col("text").alias("problem"))
    docs.select(F.struct("*").alias("env_kwargs")).write.json(f"{path}/a.jsonl")
    items = V.table(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("doc_id"), F.col("text").alias("problem"))
    items.write.parquet(f"{path}/b.parquet")
    d = S.read_specs(spark, [f"none={path}/a.jsonl", f"bench={path}/b.parquet"])
    return d.select("doc_id", "benchmark_name", F.md5("problem").alias("problem"))


@query("dataset_manifest", "SELECT lang, count(*) AS records, '{\"seed\": 42}' AS extra FROM documents GROUP BY lang")
def _(spark, sf):
    return S.write_dataset(V.table(spark, sf, "documents"), scratch(spark, "dataset"), "jsonl", ["lang"], {"seed": 42})


@query("api_timing_files", """SELECT kind, endpoint, count(*) AS n, CAST(sum(prompt) AS BIGINT) AS prompt_tokens, max(value) AS latency_max FROM (
  SELECT event_type AS kind, 'ep' || (user_id % 8) AS endpoint, event_id % 1000 AS prompt, value FROM events) GROUP BY kind, endpoint""")
def _(spark, sf):
    path = scratch(spark, "timings")
    t = V.api_timings(spark, sf)
    t.select("timestamp", F.col("kind").alias("request_kind"), "endpoint", F.col("latency_sec").alias("latency"), "status_code", "prompt_tokens").write.json(path)
    d = S.read_api_timings(spark, path)
    return d.groupBy("kind", "endpoint").agg(F.count(F.lit(1)).alias("n"), F.sum("prompt_tokens").alias("prompt_tokens"), F.max("latency_sec").alias("latency_max"))


@query("generation_dump", "SELECT CAST(turn AS BIGINT) AS step, count(*) AS n, count(DISTINCT conv_id) AS convs FROM conversations GROUP BY turn")
def _(spark, sf):
    path = scratch(spark, "dump")
    S.write_generation_dump(V.messages(spark, sf).select("conv_id", F.col("text").alias("output"), F.col("turn").alias("step")), path)
    d = spark.read.schema("conv_id long, output string, step long").json(path)
    return d.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("convs"))


@query("library_snapshots", "SELECT CAST(b AS BIGINT) AS batch_idx, count(*) AS n FROM embeddings, (SELECT unnest([0, 1]) AS b) GROUP BY b")
def _(spark, sf):
    path = scratch(spark, "snapshots")
    lib = V.items(spark, sf)
    for b in (0, 1):
        snapshot(lib, path, b)
    return spark.read.parquet(path).groupBy(F.col("batch_idx").cast("long").alias("batch_idx")).agg(F.count(F.lit(1)).alias("n"))


@query("trajectory_files", """SELECT 's' || (conv_id % 8) AS sample_id, 'rollout_' || (conv_id // 8 % 2) AS rollout_id, count(*) AS events, CAST(sum(length(text)) AS BIGINT) AS chars,
  count(*) FILTER (role = 'assistant') AS visits FROM conversations GROUP BY 1, 2""")
def _(spark, sf):
    path = scratch(spark, "logs")
    c = V.table(spark, sf, "conversations")
    rows = c.select(F.expr("concat('s', conv_id % 8)").alias("s"), F.expr("concat('rollout_', (conv_id div 8) % 2)").alias("r"), F.col("turn").alias("turn_idx"), F.col("text").alias("text_output"),
                    F.when(F.col("role") == "assistant", "visit").alias("tool_name"))
    rows.repartition("s", "r").write.partitionBy("s", "r").json(path)
    d = S.read_trajectories(spark, path, "*.json")
    return d.groupBy("sample_id", "rollout_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.length("text_output")).cast("long").alias("chars"), F.count("tool_name").alias("visits"))


@query("rollout_metrics_files", """SELECT 's' || l_orderkey % 32 AS sample_id, 'rollout_' || l_linenumber AS rollout_id, CAST(l_linenumber AS BIGINT) AS rollout_idx,
  CASE WHEN l_linenumber <= 5 THEN CAST(max(l_quantity) AS DOUBLE) END AS accuracy_score, l_linenumber <= 5 AS completed,
  CASE WHEN l_linenumber > 5 THEN 'missing *.json' ELSE '' END AS error FROM lineitem GROUP BY l_orderkey % 32, l_linenumber""")
def _(spark, sf):
    path = scratch(spark, "metrics")
    lines = V.table(spark, sf, "lineitem").select(
        F.expr("concat('s', l_orderkey % 32)").alias("sample_id"), F.expr("concat('rollout_', l_linenumber)").alias("rollout_id"), "l_linenumber", "l_quantity")
    best = lines.where("l_linenumber <= 5").groupBy(F.col("sample_id").alias("s"), F.col("rollout_id").alias("r")).agg(F.max("l_quantity").cast("double").alias("accuracy_score"))
    best.repartition("s", "r").write.partitionBy("s", "r").json(path)
    t = lines.select("sample_id", "rollout_id")
    d = S.read_rollout_metrics(spark, path, t, "*.json")
    return d.select("sample_id", "rollout_id", "rollout_idx", "accuracy_score", "completed", "error")


@query("skill_bank_file", """SELECT CASE WHEN item_id % 4 = 3 THEN 'mistake' WHEN item_id % 4 = 0 THEN 'general' ELSE 'task' END AS kind,
  CASE item_id % 4 WHEN 1 THEN 'alpha_bank' WHEN 2 THEN 'beta' END AS category, 'k' || item_id AS skill_id, CASE WHEN item_id % 4 = 3 THEN NULL ELSE md5(text) END AS principle,
  CASE WHEN item_id % 4 = 3 THEN md5(text) END AS description FROM benchmark""")
def _(spark, sf):
    path = scratch(spark, "bank")
    b = V.table(spark, sf, "benchmark").select((F.col("item_id") % 4).alias("p"), F.concat(F.lit("k"), F.col("item_id").cast("string")).alias("id"), F.md5("text").alias("t"))
    skills = lambda p: F.collect_list(F.when(F.col("p") == p, F.struct(F.col("id").alias("skill_id"), F.col("id").alias("title"), F.col("t").alias("principle"))))
    bank = b.agg(skills(0).alias("general_skills"), skills(1).alias("a"), skills(2).alias("b"),
                 F.collect_list(F.when(F.col("p") == 3, F.struct(F.col("id").alias("mistake_id"), F.col("t").alias("description")))).alias("common_mistakes"))
    bank = bank.select("general_skills", F.create_map(F.lit("Alpha Bank"), "a", F.lit("beta"), "b").alias("task_specific_skills"), "common_mistakes")
    bank.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return S.read_skill_bank(spark, path).select("kind", "category", "skill_id", "principle", "description")


@query("experience_library_file", "SELECT 'E' || item_id AS exp_id, CAST(item_id AS BIGINT) AS exp_no, md5(text) AS text FROM benchmark")
def _(spark, sf):
    path = scratch(spark, "experiences")
    S.write_experiences(V.table(spark, sf, "benchmark").select(F.concat(F.lit("E"), F.col("item_id").cast("string")).alias("exp_id"), "text"), path)
    return S.read_experiences(spark, path).select("exp_id", "exp_no", F.md5("text").alias("text"))
