"""Streams run over the given tables into written tables, and their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.plans import views as V
from stepfold.plans.session import scratch
from stepfold.streaming import streams as S
from stepfold.suite.registry import q6, query, r6

_T_SQL = "t AS (SELECT ts, event_type AS kind, value, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad FROM events), top AS (SELECT max(ts) AS m FROM events)"


def _stream_timings(spark, sf):
    return _timings(S.read_table_stream(spark, sf, "events"))


def _timings(ev):
    return ev.select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("kind"), F.col("value").alias("latency_sec"),
        F.concat(F.lit("ep"), (F.col("user_id") % 8).cast("string")).alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), F.lit(None).cast("string").alias("error_type"), "event_id")


def _window_sql(starts: str) -> str:
    return f"""WITH {_T_SQL}, w AS (SELECT kind, value, bad, {starts} AS start FROM t)
SELECT CAST(epoch(start) AS BIGINT) AS start, kind, count(*) AS requests, CAST(sum(bad) AS BIGINT) AS failures, {q6('avg(value)')} AS latency_mean,
  quantile_disc(value, 0.5) AS latency_p50, quantile_disc(value, 0.95) AS latency_p95 FROM w, top WHERE start + INTERVAL 1 HOUR <= m - INTERVAL 10 MINUTE GROUP BY start, kind"""


def _latency(d):
    return d.select(F.col("start").cast("long").alias("start"), "kind", "requests", "failures", r6("latency_mean").alias("latency_mean"), "latency_p50", "latency_p95")


@query("stream_latency_tumbling", _window_sql("time_bucket(INTERVAL 1 HOUR, ts)"))
def _(spark, sf):
    return _latency(S.drain(S.stream_latency(_stream_timings(spark, sf), "1 hour")))


@query("stream_latency_sliding", _window_sql("unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE])"))
def _(spark, sf):
    return _latency(S.drain(S.stream_latency(_stream_timings(spark, sf), "1 hour", "30 minutes")))


def _log_stream(ev):
    k = F.col("event_type")
    return ev.select(F.col("user_id").cast("string").alias("sample_id"), "ts", "event_id",
                     F.when(k.isin("view", "click"), F.col("event_id") % 7).alias("turn_idx"), F.when(k.isin("purchase", "signup"), k).alias("tool_name"))


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM e),
g AS (SELECT user_id, sid, min(ts) AS s, max(ts) AS m, count(*) AS events, count(*) FILTER (event_type IN ('view', 'click')) AS turns, count(*) FILTER (event_type IN ('purchase', 'signup')) AS tools FROM s GROUP BY user_id, sid)
SELECT CAST(user_id AS VARCHAR) AS sample_id, CAST(floor(epoch(s)) AS BIGINT) AS start, events, turns, tools FROM g WHERE m + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _(spark, sf):
    d = S.drain(S.stream_sessions(_log_stream(S.read_table_stream(spark, sf, "events")), "3 hours"))
    return d.select("sample_id", F.col("start").cast("long").alias("start"), "events", "turns", "tools")


@query("stream_dedup", "SELECT CAST(user_id AS VARCHAR) AS sample_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def _(spark, sf):
    ev = S.read_table_stream(spark, sf, "events")
    twice = ev.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))
    d = S.drain(S.stream_dedup(twice, ["event_id"]).select(F.col("user_id").cast("string").alias("sample_id"), "event_type"))
    return d.groupBy("sample_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("endpoint_health", """WITH t AS (SELECT 'ep' || (user_id % 8) AS endpoint, event_id, epoch(ts) AS t, event_type = 'error' AS bad, ts FROM events),
l AS (SELECT *, max(CASE WHEN bad THEN t END) OVER (PARTITION BY endpoint ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM t)
SELECT endpoint, event_id, coalesce(t - last < 600, false) AS unhealthy FROM l""")
def _(spark, sf):
    return S.endpoint_health(_timings(V.table(spark, sf, "events")), 600.0)


@query("stream_endpoint_health", """WITH f AS (SELECT 'ep' || (user_id % 8) AS endpoint, epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'error'),
g AS (SELECT *, lag(t) OVER w AS p, lead(t) OVER w AS n FROM f WINDOW w AS (PARTITION BY endpoint ORDER BY t))
SELECT endpoint, t AS at_ms, false AS healthy FROM g WHERE p IS NULL OR t - p >= 600000
UNION ALL SELECT endpoint, t + 600000, true FROM g WHERE CASE WHEN n IS NULL THEN t + 600000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events) - 60000 ELSE n - t >= 600000 END""")
def _(spark, sf):
    return S.drain(S.stream_endpoint_health(_stream_timings(spark, sf), 600.0))


_KL_SQL = """l AS (SELECT 'r' || (user_id % 4) AS run, event_id AS step, ln(1 + greatest(least(value / 20.0 - 1, 0.2), -0.2) * 8 / 10000) AS f FROM events)"""


def _kl_log(ev):
    return ev.select(F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("run"), F.col("event_id").alias("step"), F.col("value").alias("kl"), F.lit(8).alias("n_steps"))


_KL = f"WITH {_KL_SQL} SELECT run, step, {q6('0.2 * exp(sum(f) OVER (PARTITION BY run ORDER BY step))')} AS value FROM l"


@query("kl_controller", _KL)
def _(spark, sf):
    d = S.kl_controller(_kl_log(V.table(spark, sf, "events")), 0.2, 20.0, 10000.0)
    return d.select("run", "step", r6("value").alias("value"))


@query("stream_kl_controller", _KL)
def _(spark, sf):
    d = S.drain(S.stream_kl_controller(_kl_log(S.read_table_stream(spark, sf, "events")), 0.2, 20.0, 10000.0))
    return d.select("run", "step", r6("value").alias("value"))


def _queues(ev):
    return ev.select(F.concat(F.lit("q"), (F.col("user_id") % 3).cast("string")).alias("queue"), "event_id")


@query("fill_batches", """WITH r AS (SELECT 'q' || (user_id % 3) AS queue, event_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id % 3) AS n FROM events)
SELECT queue, event_id, (rn - 1) // 32 AS batch, ((rn - 1) // 32 + 1) * 32 <= n AS "full" FROM r""")
def _(spark, sf):
    return S.fill_batches(_queues(V.table(spark, sf, "events")), 32)


@query("stream_fill_batches", """WITH r AS (SELECT 'q' || (user_id % 3) AS queue, event_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS rn FROM events)
SELECT queue, event_id, (rn - 1) // 32 AS batch, rn % 32 = 0 AS closes FROM r""")
def _(spark, sf):
    return S.drain(S.stream_fill_batches(_queues(S.read_table_stream(spark, sf, "events")), 32))


@query("stream_fill_flush", """WITH r AS (SELECT 'q' || (user_id % 3) AS queue, count(*) AS n FROM events GROUP BY 1),
b AS (SELECT queue, n, unnest(range(0, (n + 32) // 33)) AS batch FROM r)
SELECT queue, batch, least(33, n - 33 * batch) AS rows, n - 33 * batch < 33 AS "final" FROM b""")
def _(spark, sf):
    d = S.stream_fill_flush(_queues(S.read_table_stream(spark, sf, "events")), 33, 5.0)
    d = S.run_until_idle(d, scratch(spark, "flush"), 5.0)
    return d.groupBy("queue", "batch", "final").agg(F.countDistinct("event_id").alias("rows")).select("queue", "batch", "rows", "final")


@query("stream_enrich", """SELECT doc_id, CASE lang WHEN 'de' THEN 'europe' ELSE 'asia' END AS task_type,
  contains(lang, 'de') AS europe FROM documents""")
def _(spark, sf):
    s = S.read_table_stream(spark, sf, "documents").select(
        "doc_id", F.lit("").alias("problem"), F.when(F.col("lang") == "de", "europe").otherwise("asia").alias("category"))
    d = S.drain(S.stream_enrich(s, V.skills(spark, sf), fields=["category"]))
    return d.select("doc_id", "task_type", F.contains("skill_text", F.lit("### Europe Skills")).alias("europe"))


@query("stream_experience_upsert", """WITH lib AS (SELECT vec_id AS no, embedding FROM embeddings WHERE label < 5),
s AS (SELECT o.vec_id AS op, no, list_cosine_similarity(CAST(o.embedding AS DOUBLE[]), CAST(lib.embedding AS DOUBLE[])) AS sim FROM embeddings o, lib WHERE o.label >= 5),
r AS (SELECT op, no, row_number() OVER (PARTITION BY op ORDER BY sim DESC, no) AS rn FROM s WHERE sim >= 0.35),
taken AS (SELECT no, min(op) AS op FROM r WHERE rn <= 10 GROUP BY no),
older AS (SELECT op, string_agg('t' || no, chr(10) || chr(10) ORDER BY no) AS t FROM taken GROUP BY op)
SELECT no AS exp_no, 't' || no AS text FROM lib WHERE no NOT IN (SELECT no FROM taken)
UNION ALL SELECT (SELECT max(no) FROM lib) + row_number() OVER (ORDER BY vec_id), concat_ws(chr(10) || chr(10), t, 'n' || vec_id)
FROM embeddings LEFT JOIN older ON op = vec_id WHERE label >= 5""")
def _(spark, sf):
    path = scratch(spark, "library")
    e = V.items(spark, sf)
    lib = e.where("kind < 5").select(F.col("id").alias("exp_no"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), "embedding")
    lib.write.parquet(f"{path}/version=0")
    # one batch, however many files: each batch writes the whole library, and later ones would find what earlier ones added
    ops = S.read_table_stream(spark, sf, "embeddings", None).where("label >= 5").select(
        F.col("vec_id").alias("op_id"), F.lit("add").alias("option"), F.lit(None).cast("long").alias("modified_from"),
        F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("text"), "embedding")
    q = ops.writeStream.foreachBatch(S.experience_upserter(path, 0.35)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    # the library after the last micro batch
    last = q.lastProgress
    newest = max((p["batchId"] for p in q.recentProgress if p["numInputRows"] > 0), default=-1) if last else -1
    return spark.read.parquet(f"{path}/version={newest + 1}").select("exp_no", "text")
