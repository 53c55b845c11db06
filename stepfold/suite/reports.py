"""Queries over evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.functions import classify as C
from stepfold.operators import grading as G
from stepfold.operators import report as P
from stepfold.plans import views as V
from stepfold.plans.views import EVENT_LOG_SQL, RESPONSES_SQL, ROLLOUTS_SQL, STEPS_SQL, TIMINGS_SQL, TOKENS_SQL
from stepfold.suite.registry import q6, query, r6
from stepfold.suite.text_jobs import FAILURE_SQL

_PASSK_SQL = """scored AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY rollout_idx) AS rn
  FROM rollouts WHERE accuracy_score IS NOT NULL),
per AS (SELECT sample_id, any_value(benchmark) AS benchmark, max(CASE WHEN rn = 1 THEN CASE WHEN accuracy_score >= 1 THEN 1 ELSE 0 END END) AS p1,
  avg(accuracy_score) FILTER (rn = 1) AS a1, max(CASE WHEN rn <= 4 THEN CASE WHEN accuracy_score >= 1 THEN 1 ELSE 0 END END) AS p4,
  avg(accuracy_score) FILTER (rn <= 4) AS a4, count(*) FILTER (rn <= 4) AS scored,
  max(accuracy_score) FILTER (rn <= 4) AS best FROM scored GROUP BY sample_id)"""


def _rollouts(spark, sf):
    r = G.label_failures(V.rollouts(spark, sf))
    return r.withColumn("tools", F.when(F.col("tool_calls") > 0, F.concat(F.lit("t"), F.col("tool_calls").cast("string"))))


_R_SQL = f"""{ROLLOUTS_SQL}, labelled AS (SELECT *, {FAILURE_SQL} AS failure_type, coalesce(accuracy_score >= 1, false) AS ok,
  CASE WHEN tool_calls > 0 THEN 't' || tool_calls END AS tools FROM rollouts)"""


@query("pass_at_k", f"""WITH {ROLLOUTS_SQL}, {_PASSK_SQL}
SELECT sample_id, CAST(p1 AS DOUBLE) AS pass_1, {q6('a1')} AS average_1, CAST(p4 AS DOUBLE) AS pass_4, {q6('a4')} AS average_4 FROM per""")
def _(spark, sf):
    d = P.pass_at_k(V.rollouts(spark, sf), [1, 4])
    return d.select("sample_id", F.col("pass@1").alias("pass_1"), r6("average@1").alias("average_1"),
                    F.col("pass@4").alias("pass_4"), r6("average@4").alias("average_4"))


@query("dataset_pass_at_k", f"""WITH {ROLLOUTS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY rollout_idx) AS rn
  FROM rollouts WHERE accuracy_score IS NOT NULL),
k AS (SELECT k, sample_id, count(*) AS n, max(CASE WHEN accuracy_score >= 1 THEN 1 ELSE 0 END) AS p, avg(accuracy_score) AS a
  FROM s, (SELECT unnest(range(1, 9)) AS k) WHERE rn <= k GROUP BY k, sample_id)
SELECT k, count(*) AS samples, {q6('round(avg(p), 4)')} AS pass_at_k, {q6('round(avg(a), 4)')} AS average_at_k FROM k WHERE n = k GROUP BY k""")
def _(spark, sf):
    d = P.dataset_pass_at_k(V.rollouts(spark, sf), 8)
    return d.select(F.col("k").cast("long"), "samples", r6("pass_at_k").alias("pass_at_k"), r6("average_at_k").alias("average_at_k"))


def _report_sql(bench: str, expected: str) -> str:
    def top(col, where):
        return f"""(SELECT string_agg({col} || ':' || n, ', ' ORDER BY n DESC, {col}) FROM (SELECT {col}, count(*) AS n FROM l x
          WHERE x.b = roll.b AND {col} IS NOT NULL AND {where} GROUP BY {col} ORDER BY n DESC, {col} LIMIT 5))"""

    return f"""WITH {_R_SQL}, {_PASSK_SQL}, l AS (SELECT *, {bench} AS b FROM labelled), sp AS (SELECT *, {bench} AS b FROM per),
roll AS (SELECT b, count(*) AS total_rollouts, count(*) FILTER (completed) AS completed_rollouts, count(*) FILTER (ok) AS successful_rollouts,
  count(*) FILTER (NOT ok) AS failed_rollouts, avg(accuracy_score) AS acc, avg(turns) AS turns, CAST(sum(tool_calls) AS BIGINT) AS tool_calls_total,
  avg(CASE WHEN tool_calls > 0 THEN 1 ELSE 0 END) AS rate, count(DISTINCT sample_id) AS output_samples FROM l GROUP BY b),
s AS (SELECT b, count(*) AS completed_samples, count(*) FILTER (best >= 1) AS successful_samples, avg(p1) AS p1, avg(a4) AS a4, avg(p4) AS p4 FROM sp GROUP BY b)
SELECT roll.b AS benchmark, total_rollouts, completed_rollouts, successful_rollouts, failed_rollouts, {q6('acc')} AS rollout_accuracy_mean,
  {q6('turns')} AS assistant_turns_mean, tool_calls_total, {q6('rate')} AS tool_call_rate, output_samples, completed_samples, successful_samples,
  {q6('p1')} AS pass_at_1, {q6('p4')} AS pass_at_k, {q6('a4')} AS average_at_k, {top('tools', 'true')} AS top_tools,
  {top('failure_type', 'NOT ok')} AS top_failure_types, CAST(greatest({expected} - output_samples, 0) AS BIGINT) AS missing_samples,
  {q6('successful_samples / completed_samples')} AS sample_success_rate, {q6('successful_rollouts / completed_rollouts')} AS rollout_success_rate
FROM roll JOIN s ON roll.b = s.b"""


def _report(spark, sf, **level):
    cust = V.table(spark, sf, "customer")
    expected = cust.groupBy(F.concat(F.lit("bench_"), (F.col("c_custkey") % 5).cast("string")).alias("benchmark"))
    expected = expected.agg(F.count(F.lit(1)).alias("expected_samples"))
    d = P.benchmark_report(_rollouts(spark, sf), expected, k=4, **level)
    longs = ["total_rollouts", "completed_rollouts", "successful_rollouts", "failed_rollouts", "tool_calls_total", "output_samples",
             "completed_samples", "successful_samples", "missing_samples"]
    dbl = ["rollout_accuracy_mean", "assistant_turns_mean", "tool_call_rate", "pass_at_1", "pass_at_k", "average_at_k",
           "sample_success_rate", "rollout_success_rate"]
    return d.select("benchmark", *longs, *[r6(c).alias(c) for c in dbl], "top_tools", "top_failure_types")


@query("benchmark_report", _report_sql("benchmark", "(SELECT count(*) FROM customer WHERE 'bench_' || (c_custkey % 5) = roll.b)"))
def _(spark, sf):
    return _report(spark, sf)


@query("overall_report", _report_sql("'all'", "(SELECT count(*) FROM customer)"))
def _(spark, sf):
    return _report(spark, sf, overall=True)


@query("report_with_total", "SELECT * FROM (" + _report_sql("benchmark", "(SELECT count(*) FROM customer WHERE 'bench_' || (c_custkey % 5) = roll.b)")
       + ") UNION ALL SELECT * FROM (" + _report_sql("'all'", "(SELECT count(*) FROM customer)") + ")")
def _(spark, sf):
    return _report(spark, sf, total="all")


def _failure_sql(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    return f"""WITH {_R_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY {cols}failure_type ORDER BY event_id) AS rn FROM labelled WHERE NOT ok),
g AS (SELECT {cols}failure_type, count(*) AS count, string_agg(sample_id, ', ' ORDER BY rn) FILTER (rn <= 5) AS examples FROM f GROUP BY {cols}failure_type)
SELECT {cols}failure_type, count, examples, {q6(f'count / sum(count) OVER ({part})')} AS ratio FROM g"""


@query("failure_report", _failure_sql(""))
def _(spark, sf):
    return P.failure_report(_rollouts(spark, sf)).withColumn("ratio", r6("ratio"))


@query("failure_report_by_benchmark", _failure_sql("benchmark"))
def _(spark, sf):
    return P.failure_report(_rollouts(spark, sf), ["benchmark"]).withColumn("ratio", r6("ratio"))


@query("turn_tool_counts", f"""WITH {EVENT_LOG_SQL}
SELECT sample_id, rollout_id, count(*) FILTER (turn_idx IS NOT NULL AND trim(text_output) <> '') AS turns, count(tool_name) AS tool_calls,
  coalesce(max(turn_idx), -1) + 1 AS turns_by_index FROM event_log GROUP BY sample_id, rollout_id""")
def _(spark, sf):
    return P.turn_tool_counts(V.event_log(spark, sf))


@query("tool_report", f"""WITH {EVENT_LOG_SQL}, e AS (SELECT *, CASE WHEN tool_error IS NOT NULL THEN 'web_search' ELSE tool_name END AS tool,
  CASE WHEN tool_error LIKE '%403%' THEN 'http_403' WHEN tool_error LIKE '%404%' THEN 'http_404' WHEN tool_error LIKE '%429%' THEN 'http_429'
    WHEN tool_error ILIKE '%timed out%' THEN 'timeout' WHEN tool_error IS NOT NULL THEN 'unknown_error' END AS et FROM event_log),
p AS (SELECT rollout_id, sample_id, count(tool) AS c, count(et) AS x FROM e GROUP BY rollout_id, sample_id),
t AS (SELECT rollout_id, string_agg(tool || ':' || n, ', ' ORDER BY n DESC, tool) AS s FROM (SELECT rollout_id, tool, count(*) AS n FROM e WHERE tool IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT rollout_id, string_agg(et || ':' || n, ', ' ORDER BY n DESC, et) AS s FROM (SELECT rollout_id, et, count(*) AS n FROM e WHERE et IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT p.rollout_id, count(*) AS rollouts, CAST(sum(c) AS BIGINT) AS tool_calls, {q6('avg(c)')} AS tool_calls_mean,
  {q6('avg(CASE WHEN c > 0 THEN 1 ELSE 0 END)')} AS call_rate, CAST(sum(x) AS BIGINT) AS tool_errors, {q6('sum(x) / sum(c)')} AS error_rate,
  any_value(t.s) AS top_tools, any_value(u.s) AS top_error_types FROM p JOIN t USING (rollout_id) JOIN u USING (rollout_id) GROUP BY p.rollout_id""")
def _(spark, sf):
    from stepfold.functions.parse import event_tool_name

    e = V.event_log(spark, sf)
    e = e.withColumns({"tool": event_tool_name(F.col("raw")),
                       "error_type": F.when(F.col("tool_error").isNotNull(), C.classify_tool_error(F.col("tool_error")))})
    d = P.tool_report(e, ["rollout_id"], ("sample_id",))
    return d.select("rollout_id", "rollouts", "tool_calls", "tool_errors", "top_tools", "top_error_types",
                    *[r6(c).alias(c) for c in ("tool_calls_mean", "call_rate", "error_rate")])


@query("sft_potential", f"""WITH {ROLLOUTS_SQL}, u AS (SELECT *, accuracy_score >= 1 AS ok, CASE WHEN accuracy_score >= 1 THEN CASE WHEN turns > 0 THEN turns
  WHEN final_answer <> '' THEN 1 ELSE 0 END END AS usable FROM rollouts),
p AS (SELECT benchmark, sample_id, bool_or(coalesce(ok, false)) AS s, bool_or(completed) AS c, count(*) AS n FROM u GROUP BY benchmark, sample_id),
q AS (SELECT benchmark, count(*) AS samples, count(*) FILTER (c) AS completed_samples, count(*) FILTER (s) AS success_samples, max(n) AS rollouts_per_sample_max FROM p GROUP BY benchmark)
SELECT benchmark, count(*) AS rollouts, count(*) FILTER (completed) AS completed_rollouts, count(*) FILTER (ok) AS successful_rollouts,
  CAST(coalesce(sum(usable), 0) AS BIGINT) AS estimated_sft_samples, {q6('round(avg(usable), 4)')} AS sft_samples_per_success_mean,
  CAST(sum(tool_calls) FILTER (ok) AS BIGINT) AS tool_calls_in_successful, any_value(samples) AS samples, any_value(completed_samples) AS completed_samples,
  any_value(success_samples) AS success_samples, any_value(rollouts_per_sample_max) AS rollouts_per_sample_max,
  {q6('round(any_value(success_samples) / any_value(samples), 6)')} AS pass_at_k FROM u JOIN q USING (benchmark) GROUP BY benchmark""")
def _(spark, sf):
    d = P.sft_potential(V.rollouts(spark, sf), ["benchmark"])
    return d.withColumns({c: r6(c) for c in ("sft_samples_per_success_mean", "pass_at_k")})


def _lat_sql(fn, by, bad):
    return f"""WITH {TIMINGS_SQL} SELECT {by}, count(*) AS requests, count(*) FILTER ({bad}) AS failures, {q6('avg(latency_sec)')} AS latency_mean,
  {q6('avg(prompt_tokens)')} AS prompt_tokens_mean, {q6('avg(completion_tokens)')} AS completion_tokens_mean,
  {q6(f'{fn}(latency_sec, 0.5)')} AS latency_p50, {q6(f'{fn}(latency_sec, 0.95)')} AS latency_p95 FROM timings GROUP BY {by}"""


_LAT = ["latency_mean", "prompt_tokens_mean", "completion_tokens_mean", "latency_p50", "latency_p95"]


@query("latency_report", _lat_sql("quantile_disc", "kind", "error_type IS NOT NULL OR status_code >= 400"))
def _(spark, sf):
    return P.latency_report(V.api_timings(spark, sf), "kind").withColumns({c: r6(c) for c in _LAT})


@query("latency_report_by_endpoint", _lat_sql("quantile_disc", "endpoint", "status_code >= 400"))
def _(spark, sf):
    return P.latency_report(V.api_timings(spark, sf), "endpoint").withColumns({c: r6(c) for c in _LAT})


@query("latency_report_interpolated", _lat_sql("quantile_cont", "endpoint", "status_code >= 400"))
def _(spark, sf):
    return P.latency_report(V.api_timings(spark, sf), "endpoint", interpolate=True).withColumns({c: r6(c) for c in _LAT})


@query("endpoint_report", f"""WITH {TIMINGS_SQL}, t AS (SELECT *, status_code < 400 AS ok, latency_sec / 4 AS ttft FROM timings)
SELECT endpoint, count(*) AS requests, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures,
  {q6('round(avg(CASE WHEN ok THEN 0 ELSE 1 END), 4)')} AS failure_rate,
  {q6('round(sum(completion_tokens) FILTER (ok) / sum(latency_sec) FILTER (ok), 4)')} AS tokens_per_sec,
  {q6('round(quantile_disc(latency_sec, 0.5) FILTER (ok), 4)')} AS latency_p50, {q6('round(quantile_disc(latency_sec, 0.95) FILTER (ok), 4)')} AS latency_p95,
  {q6('round(quantile_disc(ttft + 1e-7, 0.5) FILTER (ok), 4)')} AS ttft_p50, {q6('round(quantile_disc(ttft + 1e-7, 0.95) FILTER (ok), 4)')} AS ttft_p95
FROM t GROUP BY endpoint""")
def _(spark, sf):
    t = V.api_timings(spark, sf).withColumns({"ok": F.col("status_code") < 400, "ttft_sec": F.col("latency_sec") / 4 + 1e-7})
    d = P.endpoint_report(t)
    return d.withColumns({c: r6(c) for c in d.columns if d.schema[c].dataType.simpleString() == "double"})


_EPI_SQL = "epi AS (SELECT traj_uid, arg_max(won, step) AS won, any_value(data_source) AS data_source FROM steps WHERE active GROUP BY traj_uid)"


@query("success_by_episode", f"""WITH {STEPS_SQL}, {_EPI_SQL}
SELECT data_source, count(*) AS episodes, {q6('avg(CASE WHEN won THEN 1 ELSE 0 END)')} AS success_rate FROM epi GROUP BY data_source""")
def _(spark, sf):
    d = P.success_rates(P.success_by_episode(V.steps(spark, sf)), "data_source")
    return d.withColumn("success_rate", r6("success_rate"))


@query("episode_stats", f"""WITH {STEPS_SQL} SELECT traj_uid, step, {q6('sum(reward) OVER t')} AS episode_reward, count(*) OVER t AS episode_length,
  CAST(sum(tool_calling) OVER t AS BIGINT) AS episode_tools FROM steps WHERE active WINDOW t AS (PARTITION BY traj_uid)""")
def _(spark, sf):
    d = P.episode_stats(V.steps(spark, sf))
    return d.select("traj_uid", "step", r6("episode_reward").alias("episode_reward"), "episode_length", "episode_tools")


@query("batch_metrics", f"""WITH {TOKENS_SQL}, {STEPS_SQL}, r AS (SELECT sum(reward) AS s, sum(reward) AS w, count(*) FILTER (mask = 1) AS n FROM tokens GROUP BY row_id),
e AS (SELECT sum(reward) AS er, count(*) AS el, sum(tool_calling) AS et FROM steps WHERE active GROUP BY traj_uid)
SELECT {', '.join(f"{q6(f'(SELECT {f}({c}) FROM r)')} AS {a}_{n}" for c, a in (('s', 'score'), ('w', 'reward'), ('n', 'len')) for f, n in (('avg', 'mean'), ('max', 'max'), ('min', 'min')))},
  {q6('(SELECT avg(CASE WHEN n = 7 THEN 1 ELSE 0 END) FROM r)')} AS clip_ratio,
  {', '.join(f"{q6(f'(SELECT {f}({c}) FROM tokens WHERE mask = 1)')} AS {a}_{n}" for c, a in (('adv', 'adv'), ('reward', 'ret'), ('value', 'value')) for f, n in (('avg', 'mean'), ('max', 'max'), ('min', 'min')))},
  {', '.join(f"{q6(f'(SELECT {f}({c}) FROM e)')} AS episode_{a}_{n}" for c, a in (('er', 'reward'), ('el', 'length')) for f, n in (('avg', 'mean'), ('max', 'max'), ('min', 'min')))},
  {q6('(SELECT avg(et) FROM e)')} AS episode_tools_mean""")
def _(spark, sf):
    t = V.tokens(spark, sf).withColumns({"score": F.col("reward"), "ret": F.col("reward")})
    epi = V.steps(spark, sf).where("active").groupBy("traj_uid").agg(
        F.sum("reward").alias("episode_reward"), F.count(F.lit(1)).alias("episode_length"), F.sum("tool_calling").alias("episode_tools"))
    d = P.batch_metrics(t, epi, max_len=7)
    return d.select(*[r6(c).alias(c) for c in d.columns])


@query("timing_metrics", f"""WITH {TIMINGS_SQL}, t AS (SELECT sum(prompt_tokens) AS p, sum(completion_tokens) AS c FROM timings),
s AS (SELECT CASE kind WHEN 'view' THEN 'gen' WHEN 'click' THEN 'ref' ELSE 'step' END AS name, sum(latency_sec) AS seconds FROM timings GROUP BY 1)
SELECT name, {q6('seconds')} AS seconds, {q6("CASE name WHEN 'gen' THEN seconds * 1000 / c WHEN 'ref' THEN seconds * 1000 / (p + c) END")} AS ms_per_token FROM s, t""")
def _(spark, sf):
    t = V.api_timings(spark, sf)
    name = F.when(F.col("kind") == "view", "gen").when(F.col("kind") == "click", "ref").otherwise("step")
    stages = t.groupBy(name.alias("name")).agg(F.sum("latency_sec").alias("seconds"))
    tok = t.agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("response_tokens"))
    d = P.timing_metrics(stages, tok)
    return d.select("name", r6("seconds").alias("seconds"), r6("ms_per_token").alias("ms_per_token"))


@query("throughput", f"""WITH {TIMINGS_SQL} SELECT CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens,
  {q6('sum(prompt_tokens + completion_tokens) / (2.0 * 4)')} AS tokens_per_gpu_second FROM timings""")
def _(spark, sf):
    t = V.api_timings(spark, sf).select((F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))
    return P.throughput(t, 2.0, 4).withColumn("tokens_per_gpu_second", r6("tokens_per_gpu_second"))


@query("reduce_metrics", """WITH m AS (SELECT CASE event_type WHEN 'view' THEN 'len/max' WHEN 'click' THEN 'len/min' WHEN 'error' THEN 'minmax' ELSE event_type END AS name, value FROM events)
SELECT name, (round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 6) + 0.0) AS reduced FROM m GROUP BY name""")
def _(spark, sf):
    k = F.col("event_type")
    name = F.when(k == "view", "len/max").when(k == "click", "len/min").when(k == "error", "minmax").otherwise(k)
    d = P.reduce_metrics(V.table(spark, sf, "events").select(name.alias("name"), "value"))
    return d.select("name", (F.round("reduced", 6) + F.lit(0.0)).alias("reduced"))


_BW_SQL = """v AS (SELECT uid, score, rank() OVER (PARTITION BY uid ORDER BY score) - 1 AS lt, count(*) OVER (PARTITION BY uid ORDER BY score) AS le,
  count(*) OVER (PARTITION BY uid) AS n FROM responses),
d AS (SELECT DISTINCT uid, score, lt / n AS lt, le / n AS le, n AS size FROM v)"""


@query("best_worst_at_n", f"""WITH {RESPONSES_SQL}, {_BW_SQL}, k AS (SELECT *, unnest([3, 8]) AS n FROM d),
m AS (SELECT uid, n, sum(score * (pow(le, n) - pow(lt, n))) AS b1, sum(score * score * (pow(le, n) - pow(lt, n))) AS b2,
  sum(score * (pow(1 - lt, n) - pow(1 - le, n))) AS w1, sum(score * score * (pow(1 - lt, n) - pow(1 - le, n))) AS w2 FROM k GROUP BY uid, n)
SELECT uid, CAST(n AS BIGINT) AS n, {q6('b1')} AS best_mean, (round(sqrt(greatest(b2 - b1 * b1, 0)) + 2.718281e-9, 4) + 0.0) AS best_std, {q6('w1')} AS worst_mean,
  (round(sqrt(greatest(w2 - w1 * w1, 0)) + 2.718281e-9, 4) + 0.0) AS worst_std FROM m""")
def _(spark, sf):
    d = P.best_worst_at_n(V.responses(spark, sf), ["uid"], "score", [3, 8])
    sd = {c: F.round(F.col(c) + 2.718281e-9, 4) + F.lit(0.0) for c in ("best_std", "worst_std")}
    return d.withColumns({**{c: r6(c) for c in ("best_mean", "worst_mean")}, **sd})


@query("majority_value", f"""WITH {RESPONSES_SQL}, c AS (SELECT uid, data_source, count(*) AS n, min(row_id) AS o, arg_min(score, row_id) AS v FROM responses GROUP BY uid, data_source),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, o) AS rn FROM c)
SELECT uid, {q6('v')} AS majority FROM r WHERE rn = 1""")
def _(spark, sf):
    d = P.majority_value(V.responses(spark, sf), ["uid"], vote="data_source", value="score", order="row_id")
    return d.withColumn("majority", r6("majority"))


def _draws_sql(n: str, rounds: int) -> str:
    """Every draw of the bootstrap with the row it takes."""
    return f"""pos AS (SELECT uid, row_id, score, data_source AS pred, row_number() OVER (PARTITION BY uid ORDER BY row_id) AS pos FROM responses),
sizes AS (SELECT uid, count(*) AS size FROM pos GROUP BY uid), ask AS (SELECT uid, size, unnest({n}) AS n FROM sizes),
hashed AS (SELECT uid, n, b, j, CAST('0x' || substr(md5('42:' || uid || ':' || n || ':' || b || ':' || j), 1, 12) AS BIGINT) % size + 1 AS pos
  FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM (SELECT *, unnest(range(1, {rounds + 1})) AS b FROM ask))),
drawn AS (SELECT uid, n, b, j, score, pred FROM hashed JOIN pos USING (uid, pos))"""


@query("bootstrap_at_n", f"""WITH {RESPONSES_SQL}, {_draws_sql('[2, 5]', 20)}, per AS (SELECT uid, n, b, max(score) AS h, min(score) AS l FROM drawn GROUP BY ALL)
SELECT uid, CAST(n AS BIGINT) AS n, {q6('avg(h)')} AS best_mean, {q6('stddev_pop(h)')} AS best_std, {q6('avg(l)')} AS worst_mean, {q6('stddev_pop(l)')} AS worst_std FROM per GROUP BY uid, n""")
def _(spark, sf):
    d = P.bootstrap_at_n(V.responses(spark, sf), ["uid"], "score", [2, 5], rounds=20, order="row_id")
    return d.withColumns({c: r6(c) for c in ("best_mean", "best_std", "worst_mean", "worst_std")})


@query("majority_exact", f"""WITH {RESPONSES_SQL}, c AS (SELECT uid, data_source AS p, count(*) / sum(count(*)) OVER (PARTITION BY uid) AS share, avg(score) AS m, avg(score * score) AS s FROM responses GROUP BY uid, data_source),
e AS (SELECT uid, x.share * y.share * z.share * w.share AS chance, [x.p, y.p, z.p, w.p] AS votes FROM c x JOIN c y USING (uid) JOIN c z USING (uid) JOIN c w USING (uid)),
k AS (SELECT uid, chance, votes, list_transform(votes, lambda v: len(list_filter(votes, lambda o: o = v))) AS n FROM e),
won AS (SELECT uid, votes[list_position(n, list_max(n))] AS p, chance FROM k),
g AS (SELECT won.uid, sum(chance * m) AS m, sum(chance * s) AS s FROM won JOIN c ON won.uid = c.uid AND won.p = c.p GROUP BY won.uid)
SELECT uid, CAST(4 AS BIGINT) AS n, {q6('m')} AS maj_mean, (round(sqrt(greatest(s - m * m, 0)) + 2.718281e-9, 4) + 0.0) AS maj_std FROM g""")
def _(spark, sf):
    d = P.majority_exact(V.responses(spark, sf), ["uid"], [4], vote="data_source", value="score")
    return d.withColumns({"maj_mean": r6("maj_mean"), "maj_std": F.round(F.col("maj_std") + 2.718281e-9, 4) + F.lit(0.0)})


@query("majority_at_n", f"""WITH {RESPONSES_SQL}, {_draws_sql('[3]', 16)},
v AS (SELECT uid, b, pred, count(*) AS c, min(j) AS j, arg_min(score, j) AS score FROM drawn GROUP BY uid, b, pred),
w AS (SELECT uid, b, score, row_number() OVER (PARTITION BY uid, b ORDER BY c DESC, j) AS rn FROM v)
SELECT uid, {q6('avg(score)')} AS maj_mean, {q6('stddev_pop(score)')} AS maj_std FROM w WHERE rn = 1 GROUP BY uid""")
def _(spark, sf):
    d = P.majority_at_n(V.responses(spark, sf), ["uid"], 3, rounds=16, vote="data_source", value="score", order="row_id")
    return d.select("uid", r6("maj_mean").alias("maj_mean"), r6("maj_std").alias("maj_std"))


@query("validation_report", f"""WITH {RESPONSES_SQL}, {_BW_SQL}, p AS (SELECT uid, count(*) AS n, avg(score) AS m, stddev_pop(score) AS s FROM responses GROUP BY uid),
nn AS (SELECT uid, n AS size, unnest(list_distinct(list_append(list_filter([2, 4, 8, 16, 32, 64], lambda x: x < n), n))) AS n FROM p WHERE n > 1),
b AS (SELECT nn.uid, nn.n, sum(score * (pow(le, nn.n) - pow(lt, nn.n))) AS bm, sum(score * (pow(1 - lt, nn.n) - pow(1 - le, nn.n))) AS wm
  FROM nn JOIN d ON nn.uid = d.uid GROUP BY nn.uid, nn.n),
u AS (SELECT 'mean@' || n AS metric, m AS v FROM p UNION ALL SELECT 'std@' || n, s FROM p WHERE n > 1
  UNION ALL SELECT 'best@' || n, bm FROM b UNION ALL SELECT 'worst@' || n, wm FROM b)
SELECT 'orders' AS data_source, metric, {q6('avg(v)')} AS value FROM u GROUP BY metric""")
def _(spark, sf):
    d = V.responses(spark, sf).select(F.lit("orders").alias("data_source"), F.col("uid").alias("prompt"), "score")
    return P.validation_report(d).withColumn("value", r6("value"))


@query("validation_report_votes", f"""WITH {RESPONSES_SQL}, {_BW_SQL}, p AS (SELECT uid, count(*) AS n, avg(score) AS m, stddev_pop(score) AS s FROM responses GROUP BY uid),
nn AS (SELECT uid, n AS size, unnest(list_distinct(list_append(list_filter(list_transform(range(1, 62), lambda i: CAST(1 AS BIGINT) << i), lambda x: x < n), n))) AS n FROM p WHERE n > 1),
b AS (SELECT nn.uid, nn.n, sum(score * (pow(le, nn.n) - pow(lt, nn.n))) AS bm, sum(score * (pow(1 - lt, nn.n) - pow(1 - le, nn.n))) AS wm
  FROM nn JOIN d ON nn.uid = d.uid GROUP BY nn.uid, nn.n),
c AS (SELECT uid, label, count(*) AS c, avg(score) AS m, avg(score * score) AS s FROM responses GROUP BY uid, label),
two AS (SELECT uid, coalesce(max(c) FILTER (label = 1), 0) AS cx, coalesce(max(m) FILTER (label = 1), 0) AS mx, coalesce(max(s) FILTER (label = 1), 0) AS sx,
  coalesce(max(c) FILTER (label = 0), 0) AS cy, coalesce(max(m) FILTER (label = 0), 0) AS my, coalesce(max(s) FILTER (label = 0), 0) AS sy FROM c GROUP BY uid),
t AS (SELECT uid, n, size, unnest(range(0, n + 1)) AS i FROM nn),
q AS (SELECT *, CASE WHEN (cx = 0 AND i > 0) OR (cy = 0 AND i < n) THEN 0.0
    ELSE exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(greatest(cx, 1) / size) + (n - i) * ln(greatest(cy, 1) / size)) END AS chance,
  CASE WHEN 2 * i > n THEN 1.0 WHEN 2 * i = n THEN 0.5 ELSE 0.0 END AS x FROM t JOIN two USING (uid)),
g AS (SELECT uid, n, sum(chance * (x * mx + (1 - x) * my)) AS m, sum(chance * (x * sx + (1 - x) * sy)) AS s FROM q GROUP BY uid, n),
u AS (SELECT 'mean@' || n AS metric, m AS v FROM p UNION ALL SELECT 'std@' || n, s FROM p WHERE n > 1
  UNION ALL SELECT 'best@' || n, bm FROM b UNION ALL SELECT 'worst@' || n, wm FROM b
  UNION ALL SELECT 'maj@' || n || '/mean', m FROM g UNION ALL SELECT 'maj@' || n || '/std', sqrt(greatest(s - m * m, 0)) FROM g)
SELECT 'orders' AS data_source, metric, (round(avg(v) + 2.718281e-9, 5) + 0.0) AS value FROM u GROUP BY metric""")
def _(spark, sf):
    d = V.responses(spark, sf).select(F.lit("orders").alias("data_source"), F.col("uid").alias("prompt"), "score", "label")
    return P.validation_report(d, vote="label").withColumn("value", F.round(F.col("value") + 2.718281e-9, 5) + F.lit(0.0))


@query("source_scores", f"""WITH {STEPS_SQL}, f AS (SELECT * FROM steps WHERE step = 1)
SELECT s.data_source, {q6('avg(s.reward)')} AS test_score, {q6('(SELECT avg(tool_calling) FROM f WHERE f.data_source = s.data_source)')} AS tool_call_mean
FROM steps s GROUP BY s.data_source""")
def _(spark, sf):
    d = P.source_scores(V.steps(spark, sf), score="reward")
    return d.withColumns({c: r6(c) for c in ("test_score", "tool_call_mean")})


@query("offline_eval", f"""WITH {TOKENS_SQL}, r AS (SELECT row_id, avg(reward) AS m FROM tokens GROUP BY row_id)
SELECT o_orderpriority AS data_source, {q6('avg(m)')} AS test_score FROM r JOIN orders ON row_id = o_orderkey GROUP BY o_orderpriority""")
def _(spark, sf):
    from stepfold.plans.skew import lookup

    t = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_discount").alias("score"))
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("data_source"))
    return P.offline_eval(lookup(t, o, ["row_id"], "inner")).withColumn("test_score", r6("test_score"))


_RUN = "CASE user_id % 4 WHEN 0 THEN 'base_with_skill' WHEN 1 THEN 'SFT_no_skill' WHEN 2 THEN 'rl_x' ELSE 'other' END"
_SUITE_SQL = f"""log AS (SELECT {_RUN} AS run, event_id // 500 AS step, user_id % 3 AS b, event_type, value FROM events),
l AS (SELECT * FROM (SELECT *, max(step) OVER (PARTITION BY run) AS s FROM log) WHERE step = s),
rows AS (SELECT run, 'b' || b AS benchmark, CASE WHEN lower(run) LIKE 'base_%' THEN 'base' WHEN lower(run) LIKE 'sft_%' THEN 'sft' WHEN lower(run) LIKE 'rl_%' THEN 'rl' ELSE 'unknown' END AS model,
  CASE WHEN run LIKE '%with_skill%' THEN 'with_skill' ELSE 'no_skill' END AS skill, max(value) FILTER (event_type = 'view') AS test_score,
  max(value) FILTER (event_type = 'click') AS success_rate, max(value) FILTER (event_type = 'purchase') AS tool_call_mean
  FROM l WHERE event_type IN ('view', 'click', 'purchase') GROUP BY run, b)"""


def _suite_log(spark, sf):
    u, b = F.col("user_id"), F.concat(F.lit("val/b"), (F.col("user_id") % 3).cast("string"))
    run = F.when(u % 4 == 0, "base_with_skill").when(u % 4 == 1, "SFT_no_skill").when(u % 4 == 2, "rl_x").otherwise("other")
    k = F.col("event_type")
    name = (F.when(k == "view", F.concat(b, F.lit("/test_score"))).when(k == "click", F.concat(b, F.lit("_success_rate")))
            .when(k == "purchase", F.concat(b, F.lit("/tool_call_count/mean"))).otherwise("actor/loss"))
    return V.table(spark, sf, "events").select(run.alias("run"), F.floor(F.col("event_id") / 500).alias("step"), name.alias("name"), "value")


@query("eval_suite", f"WITH {_SUITE_SQL} SELECT run, benchmark, model, skill, test_score, success_rate, tool_call_mean FROM rows")
def _(spark, sf):
    return P.eval_suite(_suite_log(spark, sf))


@query("eval_suite_overall", f"""WITH {_SUITE_SQL} SELECT run, model, skill, count(*) AS benchmarks, {q6('avg(test_score)')} AS macro_test_score,
  {q6('avg(success_rate)')} AS macro_success_rate, {q6('avg(tool_call_mean)')} AS tool_call_mean FROM rows GROUP BY run, model, skill""")
def _(spark, sf):
    d = P.eval_overall(P.eval_suite(_suite_log(spark, sf)))
    return d.withColumns({c: r6(c) for c in ("macro_test_score", "macro_success_rate", "tool_call_mean")})


@query("macro_average", f"""WITH b AS (SELECT p_brand, avg(p_size) FILTER (p_size < 10) AS score, avg(p_size) AS accuracy FROM part GROUP BY p_brand)
SELECT {q6('avg(coalesce(score, accuracy))')} AS macro_average FROM b""")
def _(spark, sf):
    b = V.table(spark, sf, "part").groupBy("p_brand").agg(
        F.avg(F.when(F.col("p_size") < 10, F.col("p_size"))).alias("score"), F.avg("p_size").alias("accuracy"))
    return P.macro_average(b).select(r6("macro_average").alias("macro_average"))


@query("recent_steps", f"""WITH s AS (SELECT event_id // 10 AS step, avg(value) FILTER (event_type = 'view') AS e, avg(value) AS c, max(value) AS kl,
  avg(value) FILTER (event_type = 'click') AS t FROM events GROUP BY 1)
SELECT step, {q6('coalesce(e, c)')} AS reward_mean, {q6('kl')} AS ppo_kl, {q6('t')} AS mean_test_score FROM s ORDER BY step DESC LIMIT 20""")
def _(spark, sf):
    k, v = F.col("event_type"), F.col("value")
    g = V.table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 10).alias("step")).agg(
        F.avg(F.when(k == "view", v)).alias("e"), F.avg(v).alias("c"), F.max(v).alias("kl"), F.avg(F.when(k == "click", v)).alias("t"))
    m = F.map_filter(F.create_map(F.lit("episode/reward/mean"), "e", F.lit("critic/rewards/mean"), "c", F.lit("actor/kl_loss"), "kl",
                                  F.lit("val/x/test_score"), "t"), lambda _, x: x.isNotNull())
    d = P.recent_steps(g.select("step", m.alias("metrics")))
    return d.select("step", *[r6(c).alias(c) for c in ("reward_mean", "ppo_kl", "mean_test_score")])


@query("bank_summary", r"""SELECT source AS kind, lang AS category, count(*) AS n, CAST(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) AS BIGINT) AS words
FROM documents GROUP BY ROLLUP (source, lang)""")
def _(spark, sf):
    from stepfold.functions.text import word_count

    d = V.table(spark, sf, "documents").select(F.col("source").alias("kind"), F.col("lang").alias("category"), word_count(F.col("text")).alias("words"))
    return P.bank_summary(d)


@query("run_summary", f"""WITH {ROLLOUTS_SQL} SELECT count(*) AS n, {q6('round(avg(accuracy_score), 4)')} AS mean_accuracy, {q6('round(avg(turns), 2)')} AS mean_turns FROM rollouts""")
def _(spark, sf):
    d = P.run_summary(V.rollouts(spark, sf))
    return d.select("n", r6("mean_accuracy").alias("mean_accuracy"), r6("mean_turns").alias("mean_turns"))
