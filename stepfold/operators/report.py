"""Evaluation and reporting aggregations over rollouts, events, timings and metric logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.operators.votes import bootstrap_at_n, majority_at_n, majority_exact, majority_value, powers_of_two  # noqa: F401
from stepfold.plans.skew import beside, group_values, lookup, match, rank, rename_keys, running, top_k


def one(n: str = "n") -> Column:
    return F.count(F.lit(1)).alias(n)


def pass_at_k(rollouts: DataFrame, ks: Sequence[int], *, keys=("sample_id",), index="rollout_idx", score="accuracy_score", success=1.0):
    """pass@k and average@k of each sample over its first k scored rollouts by number; a k
    above the number of rollouts uses all of them."""
    d = top_k(rollouts.where(F.col(score).isNotNull()), list(keys), [F.col(index).asc()], max(ks))
    aggs = []
    for k in ks:
        s = F.when(F.col("rn") <= k, F.col(score))
        aggs += [F.max((s >= success).cast("double")).alias(f"pass@{k}"), F.avg(s).alias(f"average@{k}")]
    return d.groupBy(*keys).agg(*aggs, F.count(score).alias("scored"), F.max(score).alias("best"))


def dataset_pass_at_k(rollouts: DataFrame, max_k: int, *, keys=("sample_id",), index="rollout_idx", score="accuracy_score", success=1.0):
    """Mean pass@k and average@k over the samples that have at least k rollouts."""
    d = top_k(rollouts.where(F.col(score).isNotNull()), list(keys), [F.col(index).asc()], max_k)
    d = d.select(*keys, score, "rn", F.explode(F.sequence("rn", F.lit(max_k))).alias("k"))
    per = d.groupBy(*keys, "k").agg(
        one("n"), F.max((F.col(score) >= success).cast("double")).alias("p"), F.avg(score).alias("a")
    )
    return per.where("n = k").groupBy("k").agg(
        one("samples"), F.round(F.avg("p"), 4).alias("pass_at_k"), F.round(F.avg("a"), 4).alias("average_at_k")
    )


def top_counts(df: DataFrame, by: Sequence[str], name: str, limit: int = 5, out: str = "top") -> DataFrame:
    """'name:count, ...' of the most frequent names per group; ties by name."""
    counts = df.where(F.col(name).isNotNull()).groupBy(*by, name).agg(one("__n"))
    best = top_k(counts, list(by), [F.desc("__n"), F.col(name)], limit, "__r") if by else \
        counts.orderBy(F.desc("__n"), name).limit(limit).withColumn("__r", -F.col("__n"))
    item = F.struct("__r", F.concat(F.col(name), F.lit(":"), F.col("__n").cast("string")).alias("s"))
    packed = F.array_sort(F.collect_list(item))
    return best.groupBy(*by).agg(F.array_join(F.transform(packed, lambda x: x["s"]), ", ").alias(out))


def _rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole)


def benchmark_report(rollouts: DataFrame, expected: DataFrame | None = None, *, k: int = 2, overall: bool = False, total: str | None = None) -> DataFrame:
    """About twenty figures per benchmark (or in total) from one row per rollout.

    ``overall``: one row for all. ``total``: rows for each benchmark and one of this name for all,
    from one pass: as in grouping sets, every row counts for its benchmark and for the total.

    ``rollouts`` has sample_id, rollout_idx, benchmark, accuracy_score, completed, turns,
    tool_calls, failure_type and tools (one name or NULL); ``expected`` has benchmark,
    expected_samples.
    """
    if total is not None:
        levels = lambda df: df.withColumn("benchmark", F.explode(F.array("benchmark", F.lit(total))))
        rollouts = levels(rollouts)
        if expected is not None:
            expected = levels(expected).groupBy("benchmark").agg(F.sum("expected_samples").alias("expected_samples"))
    elif overall:
        rollouts = rollouts.withColumn("benchmark", F.lit("all"))
        if expected is not None:
            expected = expected.agg(F.sum("expected_samples").alias("expected_samples")).select(F.lit("all").alias("benchmark"), "expected_samples")
    ok = F.coalesce(F.col("accuracy_score") >= 1.0, F.lit(False))
    r = rollouts.withColumn("__ok", ok)
    per = pass_at_k(r, [1, k], keys=["benchmark", "sample_id"])
    sample = per.groupBy("benchmark").agg(
        one("completed_samples"),
        F.count_if(F.col("best") >= 1.0).alias("successful_samples"),
        F.avg("pass@1").alias("pass_at_1"), F.avg("average@1").alias("average_at_1"),
        F.avg(f"pass@{k}").alias("pass_at_k"), F.avg(f"average@{k}").alias("average_at_k"),
    )
    ids = r.groupBy("benchmark", "sample_id").agg(F.lit(1)).groupBy("benchmark").agg(one("output_samples"))
    roll = r.groupBy("benchmark").agg(
        one("total_rollouts"), F.count_if("completed").alias("completed_rollouts"),
        F.count_if("__ok").alias("successful_rollouts"), F.count_if(~F.col("__ok")).alias("failed_rollouts"),
        F.avg("accuracy_score").alias("rollout_accuracy_mean"), F.avg("turns").alias("assistant_turns_mean"),
        F.sum("tool_calls").alias("tool_calls_total"), F.avg("tool_calls").alias("tool_calls_mean"),
        F.avg((F.col("tool_calls") > 0).cast("double")).alias("tool_call_rate"),
    )
    tools = top_counts(r, ["benchmark"], "tools", out="top_tools")
    fails = r.where(~F.col("__ok")).withColumn("f", F.coalesce(F.nullif("failure_type", F.lit("")), F.lit("unknown")))
    out = roll
    for part in (sample, ids, tools, top_counts(fails, ["benchmark"], "f", out="top_failure_types")):
        out = out.join(part, "benchmark", "left")
    if expected is not None:
        out = out.join(expected, "benchmark", "full")
        gap = F.greatest(F.col("expected_samples") - F.coalesce("output_samples", F.lit(0)), F.lit(0))
        out = out.withColumn("missing_samples", F.when(F.col("expected_samples") > 0, gap))
    return out.withColumns(
        {
            "sample_success_rate": _rate(F.col("successful_samples"), F.col("completed_samples")),
            "rollout_success_rate": _rate(F.col("successful_rollouts"), F.col("completed_rollouts")),
        }
    )


def failure_report(rollouts: DataFrame, by: Sequence[str] = (), *, examples: int = 5, order: str = "event_id") -> DataFrame:
    """Count, share among the failed and example ids of each failure type."""
    by = list(by)
    failed = rollouts.where(~F.coalesce(F.col("accuracy_score") >= 1.0, F.lit(False)))
    failed = failed.withColumn("failure_type", F.coalesce(F.nullif("failure_type", F.lit("")), F.lit("unknown")))
    keys = [*by, "failure_type"]
    counts = failed.groupBy(*keys).agg(one("count"))
    total = counts.groupBy(*by).agg(F.sum("count").alias("__t"))
    if by:
        counts = counts.join(total, by)
    else:
        counts = counts.withColumn("__t", total.scalar())
    shown = top_k(failed.select(*keys, "sample_id", order), keys, [F.col(order)], examples)
    packed = F.array_sort(F.collect_list(F.struct("rn", "sample_id")))
    shown = shown.groupBy(*keys).agg(F.array_join(F.transform(packed, lambda x: x["sample_id"]), ", ").alias("examples"))
    out = counts.withColumn("ratio", F.col("count") / F.col("__t")).drop("__t").join(shown, keys)
    return out.orderBy(*by, F.desc("count"), "failure_type")


def turn_tool_counts(events: DataFrame, keys=("sample_id", "rollout_id"), tool: Column | None = None) -> DataFrame:
    tool = F.col("tool_name") if tool is None else tool
    spoken = F.col("turn_idx").isNotNull() & (F.trim(F.coalesce("text_output", F.lit(""))) != "")
    return events.groupBy(*keys).agg(
        F.count_if(spoken).alias("turns"), F.count(tool).alias("tool_calls"),
        (F.coalesce(F.max("turn_idx"), F.lit(-1)) + 1).alias("turns_by_index"),
    )


def tool_report(events: DataFrame, by: Sequence[str], keys=("sample_id", "rollout_id")) -> DataFrame:
    """Totals and rates of tool use per group; events carry tool and error_type (or NULL)."""
    by = list(by)
    per = events.groupBy(*by, *keys).agg(F.count("tool").alias("calls"), F.count("error_type").alias("errors"))
    out = per.groupBy(*by).agg(
        one("rollouts"), F.sum("calls").alias("tool_calls"), F.avg("calls").alias("tool_calls_mean"),
        F.avg((F.col("calls") > 0).cast("double")).alias("call_rate"), F.sum("errors").alias("tool_errors"),
        F.try_divide(F.sum("errors"), F.sum("calls")).alias("error_rate"),
    )
    bad = events.where(F.col("error_type").isNotNull())
    for name, src, col in (("top_tools", events, "tool"), ("top_error_tools", bad, "tool"), ("top_error_types", bad, "error_type")):
        out = out.join(top_counts(src, by, col, 8, name), by, "left")
    return out


def sft_potential(rollouts: DataFrame, by: Sequence[str] = (), threshold: float = 1.0) -> DataFrame:
    """Training samples the successful rollouts would give: their turns, or one for a final
    answer without turns."""
    ok = F.coalesce(F.col("accuracy_score") >= threshold, F.lit(False))
    usable = F.when(F.col("turns") > 0, F.col("turns")).when(F.coalesce("final_answer", F.lit("")) != "", 1).otherwise(0)
    d = rollouts.withColumns({"__ok": ok, "__u": F.when(ok, usable)})
    per = d.groupBy(*by, "sample_id").agg(F.max("__ok").alias("s"), F.max("completed").alias("c"), one("n"))
    sample = per.groupBy(*by).agg(
        one("samples"), F.count_if("c").alias("completed_samples"), F.count_if("s").alias("success_samples"),
        F.max("n").alias("rollouts_per_sample_max"),
    )
    roll = d.groupBy(*by).agg(
        one("rollouts"), F.count_if("completed").alias("completed_rollouts"), F.count_if("__ok").alias("successful_rollouts"),
        F.coalesce(F.sum("__u"), F.lit(0)).alias("estimated_sft_samples"),
        F.round(F.avg("__u"), 4).alias("sft_samples_per_success_mean"),
        F.sum(F.when(F.col("__ok"), F.col("tool_calls"))).alias("tool_calls_in_successful"),
    )
    out = roll.join(sample, list(by)) if by else beside(roll, sample)
    return out.withColumn("pass_at_k", F.round(F.col("success_samples") / F.col("samples"), 6))


def quantiles(df: DataFrame, by: Sequence[str], value: str, named: dict[str, float], interpolate: bool = False) -> DataFrame:
    """Exact quantiles per group without holding a group's values in one buffer: values are
    counted first, then located by their running count."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(one("__c"))
    d = running(counts, by, [value], value, __cum=F.col("__c"))
    totals = counts.groupBy(*by).agg(F.sum("__c").alias("__n"))
    d = d.withColumn("__n", totals.scalar()) if not by else lookup(d, totals, by)
    aggs, pick = [], lambda cond: F.min(F.when(cond, F.col(value)))
    for name, p in named.items():
        if interpolate:
            at = (F.col("__n") - 1) * F.lit(p)
            aggs += [
                pick(F.col("__cum") > F.floor(at)).alias(f"__lo_{name}"),
                pick(F.col("__cum") > F.ceil(at)).alias(f"__hi_{name}"),
                F.max(at - F.floor(at)).alias(f"__w_{name}"),
            ]
        else:
            aggs.append(pick(F.col("__cum") >= F.greatest(F.ceil(F.col("__n") * F.lit(p)), F.lit(1))).alias(name))
    out = d.groupBy(*by).agg(*aggs)
    if interpolate:
        mix = {n: F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__w_{n}") for n in named}
        out = out.withColumns(mix).select(*by, *named)
    return out


def latency_report(timings: DataFrame, by: str, *, interpolate: bool = False) -> DataFrame:
    """Requests, failures, mean and p50/p95 latency, token means. Nearest-rank quantiles and
    failures by error_type or status; the interpolating form reads a status text instead."""
    d = timings.withColumn(by, F.coalesce(by, F.lit("unknown")))
    if interpolate:
        s = F.lower(F.coalesce(F.col("status_code").cast("string"), F.lit("")))
        code = s.try_cast("int")
        bad = (
            F.when(s.isin("ok", "success", "200"), False)
            .when(~s.isin("", "none"), F.when(code.isNotNull(), code >= 400).otherwise(s.isin("error", "failed", "timeout")))
            .otherwise(F.col("error_type").isNotNull())
        )
    else:
        bad = (F.coalesce("error_type", F.lit("")) != "") | (F.coalesce(F.col("status_code").cast("double"), F.lit(200.0)) >= 400)
    base = d.groupBy(by).agg(
        one("requests"), F.count_if(bad).alias("failures"), F.avg("latency_sec").alias("latency_mean"),
        F.avg("prompt_tokens").alias("prompt_tokens_mean"), F.avg("completion_tokens").alias("completion_tokens_mean"),
    )
    q = quantiles(d, [by], "latency_sec", {"latency_p50": 0.5, "latency_p95": 0.95}, interpolate)
    return base.join(q, by, "left")


def endpoint_report(timings: DataFrame, *, by="endpoint", latency="latency_sec", ttft="ttft_sec") -> DataFrame:
    """Latency figures of the successful requests and the failure rate, four decimals."""
    ok = timings.where("ok")
    rate = F.try_divide(F.sum(F.when(F.col("ok"), F.col("completion_tokens"))),
                        F.sum(F.when(F.col("ok") & F.col("completion_tokens").isNotNull(), F.col(latency))))
    base = timings.groupBy(by).agg(
        one("requests"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"),
        F.round(F.avg((~F.col("ok")).cast("double")), 4).alias("failure_rate"), F.round(rate, 4).alias("tokens_per_sec"),
    )
    for col, name in ((latency, "latency"), (ttft, "ttft")):
        q = quantiles(ok, [by], col, {f"{name}_p50": 0.5, f"{name}_p95": 0.95})
        base = base.join(q.select(by, *[F.round(c, 4).alias(c) for c in q.columns[1:]]), by, "left")
    return base


def success_by_episode(steps: DataFrame, *, traj="traj_uid", step="step", keep=("data_source",)) -> DataFrame:
    """won at the last active step of each trajectory; one partial aggregation."""
    active = steps.where("active")
    return active.groupBy(traj).agg(
        F.max_by(F.col("won").cast("double"), step).alias("success"), *[F.max_by(c, step).alias(c) for c in keep]
    )


def success_rates(episodes: DataFrame, *by) -> DataFrame:
    return episodes.groupBy(*by).agg(one("episodes"), F.avg("success").alias("success_rate"))


def episode_stats(steps: DataFrame, *, traj="traj_uid", reward="reward", tool="tool_calling") -> DataFrame:
    """Episode reward, length and tool calls over active steps, on the active rows only."""
    return group_values(
        steps.where("active"), [traj], episode_reward=F.sum(reward), episode_length=F.count(F.lit(1)), episode_tools=F.sum(tool)
    )


def batch_metrics(tokens: DataFrame, episodes: DataFrame, *, row="row_id", mask="mask", max_len: int) -> DataFrame:
    """One row of score, reward, advantage, return, value, length and episode figures."""
    m = F.col(mask) != 0
    per = tokens.groupBy(row).agg(F.sum("score").alias("score"), F.sum("reward").alias("reward"), F.count_if(m).alias("len"))
    names = ("mean", "max", "min")
    fns = (F.avg, F.max, F.min)
    seq = per.agg(
        *[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in ("score", "reward", "len") for f, n in zip(fns, names)],
        F.avg((F.col("len") == max_len).cast("double")).alias("clip_ratio"),
    )
    tok = tokens.agg(
        *[f(F.when(m, F.col(c)).cast("double")).alias(f"{c}_{n}") for c in ("adv", "ret", "value") for f, n in zip(fns, names)]
    )
    epi = episodes.agg(
        *[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in ("episode_reward", "episode_length") for f, n in zip(fns, names)],
        F.avg("episode_tools").alias("episode_tools_mean"),
    )
    return beside(beside(seq, tok), epi)


def timing_metrics(timings: DataFrame, tokens: DataFrame) -> DataFrame:
    """Seconds and ms per token of each stage: generation over response tokens, others over
    all. ``tokens`` is one row (prompt_tokens, response_tokens)."""
    t = tokens.select(F.struct("prompt_tokens", "response_tokens")).scalar()
    d = timings.withColumn("__t", t)
    per = F.when(F.col("name") == "gen", F.col("__t.response_tokens")).otherwise(F.col("__t.prompt_tokens") + F.col("__t.response_tokens"))
    known = F.col("name").isin("gen", "ref", "values", "adv", "update_critic", "update_actor")
    return d.select("name", "seconds", F.when(known, F.try_divide(F.col("seconds") * 1000, per)).alias("ms_per_token"))


def throughput(tokens: DataFrame, step_seconds: float, gpus: int) -> DataFrame:
    total = F.sum("total_tokens")
    return tokens.agg(total.alias("total_tokens"), (total / (step_seconds * gpus)).alias("tokens_per_gpu_second"))


def reduce_metrics(log: DataFrame, by: Sequence[str] = (), *, name="name", value="value") -> DataFrame:
    n = F.col(name)
    v = F.when(n.contains("max"), F.max(value)).when(n.contains("min"), F.min(value)).otherwise(F.avg(value))
    return log.groupBy(*by, name).agg(v.alias("reduced"))


def best_worst_at_n(df: DataFrame, keys: Sequence[str], value: str, ns: Sequence[int] | None = None) -> DataFrame:
    """Exact mean and std of the best and worst of n draws with replacement.

    P(max <= v) = (share of values <= v)^n, so one running count over the distinct values
    gives every n. Without ns: 2, 4, ... and the group size.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull()).groupBy(*keys, v.alias("__v")).agg(one("__c"))
    d = running(counts, keys, ["__v"], "__v", __cum=F.col("__c"))
    totals = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    if ns is None:
        totals = totals.withColumn("__ns", powers_of_two(F.col("__n")))
    else:
        totals = totals.withColumn("__ns", F.array(*[F.lit(int(n)).cast("long") for n in ns]))
    d = lookup(d, totals, keys, "inner").withColumn("n", F.explode("__ns"))
    le, lt = F.col("__cum") / F.col("__n"), (F.col("__cum") - F.col("__c")) / F.col("__n")
    p_max = F.pow(le, F.col("n")) - F.pow(lt, F.col("n"))
    p_min = F.pow(1 - lt, F.col("n")) - F.pow(1 - le, F.col("n"))
    out = d.groupBy(*keys, "n").agg(
        *[F.sum(F.pow("__v", F.lit(e)) * p).alias(f"__{w}{e}") for w, p in (("b", p_max), ("w", p_min)) for e in (1, 2)]
    )
    sd = lambda w: F.sqrt(F.greatest(F.col(f"__{w}2") - F.col(f"__{w}1") * F.col(f"__{w}1"), F.lit(0.0)))
    return out.select(*keys, "n", F.col("__b1").alias("best_mean"), sd("b").alias("best_std"),
                      F.col("__w1").alias("worst_mean"), sd("w").alias("worst_std"))


def validation_report(df: DataFrame, *, source="data_source", prompt="prompt", value="score", vote: str | None = None) -> DataFrame:
    """mean@N, std@N, best and worst@{2,4,..,N} per prompt, then means over the prompts. With
    ``vote`` also the mean and std of the majority vote's value, maj@{2,4,..,N}/mean and /std."""
    keys = [source, prompt]
    base = df.groupBy(*keys).agg(one("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    tag = lambda p, n: F.concat(F.lit(p), F.col(n).cast("string"))
    pair = lambda name, c: F.struct(name.alias("metric"), c.alias("value"))
    flat = base.select(source, F.explode(F.array(
        pair(tag("mean@", "n"), F.col("mean")), pair(tag("std@", "n"), F.when(F.col("n") > 1, F.col("std"))))).alias("m"))
    bw = best_worst_at_n(df, keys, value)
    cols = {"best@": "best_mean", "worst@": "worst_mean"}
    bw = bw.select(source, F.explode(F.array(*[pair(tag(p, "n"), F.col(c)) for p, c in cols.items()])).alias("m"))
    flat = flat.unionByName(bw)
    if vote is not None:
        won = majority_exact(df, keys, vote=vote, value=value, most=None)
        both = [pair(F.concat(tag("maj@", "n"), F.lit(f"/{c}")), F.col(f"maj_{c}")) for c in ("mean", "std")]
        flat = flat.unionByName(won.select(source, F.explode(F.array(*both)).alias("m")))
    d = flat.select(source, "m.metric", "m.value").where("value IS NOT NULL")
    return d.groupBy(source, "metric").agg(F.avg("value").alias("value"))


def source_scores(steps: DataFrame, *, source="data_source", traj="traj_uid", step="step", score="score", tool="tool_calling") -> DataFrame:
    """Score mean over all rows of a source, tool calls over distinct trajectories."""
    rows = steps.groupBy(source).agg(F.avg(score).alias("test_score"))
    per = steps.groupBy(traj).agg(F.min_by(F.struct(F.col(source), F.col(tool)), step).alias("r"))
    tools = per.groupBy(F.col(f"r.{source}").alias(source)).agg(F.avg(f"r.{tool}").alias("tool_call_mean"))
    return rows.join(tools, source, "left")


def offline_eval(df: DataFrame, *, source="data_source", row="row_id", score="score", scores: str | None = None) -> DataFrame:
    """Mean score of each row's responses, then the mean per source. One record per response,
    or one per row with an array of ``scores``."""
    if scores is not None:
        total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
        per = df.select(source, F.try_divide(total, F.size(scores)).alias("__m"))
    else:
        per = df.groupBy(source, row).agg(F.avg(score).alias("__m"))
    return per.groupBy(source).agg(F.avg("__m").alias("test_score"))


def eval_suite(log: DataFrame) -> DataFrame:
    """Benchmark rows of each run from its latest validation: (run, step, name, value) in."""
    run = F.lower("run")
    last = log.groupBy("run").agg(F.max("step").alias("__s"))
    d = log.join(rename_keys(last, ["run"]), match(["run"])).where("step = __s")
    bench = F.coalesce(
        F.nullif(F.regexp_extract("name", r"^val/(.+)/test_score$", 1), F.lit("")),
        F.nullif(F.regexp_extract("name", r"^val/(.+)/tool_call_count/mean$", 1), F.lit("")),
        F.nullif(F.regexp_extract("name", r"^val/(.+)_success_rate$", 1), F.lit("")),
    )
    pick = lambda suffix: F.max(F.when(F.col("name").endswith(suffix), F.col("value")))
    return (
        d.withColumn("benchmark", bench).where("benchmark IS NOT NULL").groupBy("run", "benchmark")
        .agg(pick("/test_score").alias("test_score"), pick("_success_rate").alias("success_rate"),
             pick("/tool_call_count/mean").alias("tool_call_mean"))
        .withColumns({
            "model": F.when(run.startswith("base_"), "base").when(run.startswith("sft_"), "sft").when(run.startswith("rl_"), "rl").otherwise("unknown"),
            "skill": F.when(run.contains("with_skill"), "with_skill").otherwise("no_skill"),
        })
    )


def eval_overall(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run", "model", "skill").agg(
        one("benchmarks"), F.avg("test_score").alias("macro_test_score"),
        F.avg("success_rate").alias("macro_success_rate"), F.avg("tool_call_mean").alias("tool_call_mean"),
    )


def macro_average(df: DataFrame, *, candidates=("score", "accuracy", "overall_score")) -> DataFrame:
    have = [F.col(c).cast("double") for c in candidates if c in df.columns]
    return df.agg(F.avg(F.coalesce(*have)).alias("macro_average"))


# Metric names tried in order for each reported figure.
STEP_FIGURES = {
    "reward_mean": ["episode/reward/mean", "critic/rewards/mean", "critic/score/mean"],
    "actor_loss": ["actor/pg_loss", "actor/loss"],
    "ppo_kl": ["actor/ppo_kl", "actor/kl_loss", "actor/reward_kl_penalty"],
}


def recent_steps(log: DataFrame, n: int = 20, *, step="step", metrics="metrics") -> DataFrame:
    """The last n logged steps with fallback metric names and the mean of all test scores."""
    last = log.orderBy(F.desc(step)).limit(n)
    figures = [F.coalesce(*[F.col(metrics)[m] for m in ms]).alias(k) for k, ms in STEP_FIGURES.items()]
    tests = F.map_values(F.map_filter(metrics, lambda k, v: k.endswith("/test_score")))
    mean = F.try_divide(F.aggregate(tests, F.lit(0.0), lambda a, x: a + x), F.size(tests))
    return last.select(step, *figures, mean.alias("mean_test_score"))


def bank_summary(skills: DataFrame) -> DataFrame:
    """Skills per kind and category with subtotals and the grand total."""
    return skills.rollup("kind", "category").agg(one("n"), F.sum("words").alias("words"))


def run_summary(results: DataFrame) -> DataFrame:
    return results.agg(one("n"), F.round(F.avg("accuracy_score"), 4).alias("mean_accuracy"), F.round(F.avg("turns"), 2).alias("mean_turns"))
