"""The driver tables as the canonical trajectory tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.plans.skew import lookup, rank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STEP_ORDER = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per agent step: an order is a trajectory, a customer is a prompt group."""
    items = table(spark, sf_dir, "lineitem")
    items = rank(items, ["l_orderkey"], STEP_ORDER, "l_linenumber", "step")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority", "o_orderstatus"
    )
    return lookup(items, orders, ["l_orderkey"], "inner").select(
        F.col("o_custkey").alias("uid"),
        F.col("l_orderkey").alias("traj_uid"),
        "step",
        F.round(F.col("l_discount") * 10, 2).alias("reward"),
        F.concat("l_returnflag", "l_linestatus").alias("anchor_obs"),
        (F.col("l_linestatus") == "F").alias("active"),
        (F.col("l_returnflag") != "R").alias("is_action_valid"),
        (F.col("l_quantity") > 40).cast("long").alias("tool_calling"),
        F.col("o_orderpriority").alias("data_source"),
        (F.col("l_tax") > 0.04).alias("won"),
    )


STEPS_SQL = """steps AS (
  SELECT o_custkey AS uid, l_orderkey AS traj_uid,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey,
      l_suppkey, l_extendedprice) AS step,
    round(l_discount * 10, 2) AS reward, l_returnflag || l_linestatus AS anchor_obs,
    l_linestatus = 'F' AS active, l_returnflag <> 'R' AS is_action_valid,
    CAST(l_quantity > 40 AS BIGINT) AS tool_calling, o_orderpriority AS data_source,
    l_tax > 0.04 AS won
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of (row, token) arrays: an order is a response, a line is a token."""
    items = table(spark, sf_dir, "lineitem")
    items = rank(items, ["l_orderkey"], STEP_ORDER, "l_linenumber", "pos")
    return items.select(
        F.col("l_orderkey").alias("row_id"),
        "pos",
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("mask"),
        F.col("l_discount").alias("reward"),
        F.col("l_tax").alias("value"),
        (-F.col("l_tax")).alias("old_logp"),
        (-F.col("l_discount")).alias("logp"),
        (-(F.col("l_discount") + F.col("l_tax")) / 2).alias("ref_logp"),
        (F.col("l_quantity") / 10 - 2.5).alias("adv"),
    )


TOKENS_SQL = """tokens AS (
  SELECT l_orderkey AS row_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey,
      l_suppkey, l_extendedprice) AS pos,
    CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS mask, l_discount AS reward,
    l_tax AS value, -l_tax AS old_logp, -l_discount AS logp,
    -(l_discount + l_tax) / 2 AS ref_logp, l_quantity / 10 - 2.5 AS adv
  FROM lineitem)"""


def round_half(c: Column, digits: int) -> Column:
    """Rounded as DuckDB rounds a double: the product with a power of ten to the nearest whole
    number, halves away from zero. Spark's round looks at the shortest decimal form instead, so 1.005
    becomes 1.01 there, and 1.0 here, as its double times 100 lies below 100.5."""
    scaled = F.abs(c * 10.0**digits)
    whole = F.floor(scaled)
    return F.signum(c) * (whole + (scaled - whole >= 0.5).cast("long")) / 10.0**digits


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored response per order, grouped by customer."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("uid"),
        F.col("o_orderkey").alias("row_id"),
        round_half(F.col("o_totalprice") / 100000, 2).alias("score"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("label"),
        F.col("o_orderpriority").alias("data_source"),
    )


RESPONSES_SQL = """responses AS (
  SELECT o_custkey AS uid, o_orderkey AS row_id, round(o_totalprice / 100000, 2) AS score,
    CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
    o_orderpriority AS data_source
  FROM orders)"""


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rollouts of a user's sample, in time order; error rows are incomplete."""
    ev = table(spark, sf_dir, "events")
    ev = rank(ev, ["user_id"], ["ts", "event_id"], F.col("ts").cast("timestamp").cast("double"), "rollout_idx")
    kind = F.col("event_type")
    return ev.select(
        F.col("user_id").cast("string").alias("sample_id"),
        "rollout_idx",
        F.concat(F.lit("bench_"), (F.col("user_id") % 5).cast("string")).alias("benchmark"),
        F.when(kind == "error", None)
        .when(kind == "purchase", 1.0)
        .when(kind == "click", 0.5)
        .otherwise(0.0)
        .alias("accuracy_score"),
        F.when(kind == "signup", "Error: reached max turns")
        .when(kind == "view", "a wrong answer")
        .when(kind == "click", "")
        .otherwise(kind)
        .alias("final_answer"),
        F.when(kind == "error", "API attempts failed").otherwise("").alias("error"),
        (kind != "error").alias("completed"),
        F.col("value").cast("long").alias("turns"),
        (F.col("event_id") % 4).alias("tool_calls"),
        F.col("props"),
        F.col("event_id"),
    )


ROLLOUTS_SQL = """rollouts AS (
  SELECT CAST(user_id AS VARCHAR) AS sample_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rollout_idx,
    'bench_' || CAST(user_id % 5 AS VARCHAR) AS benchmark,
    CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5
      ELSE 0.0 END::DOUBLE AS accuracy_score,
    CASE event_type WHEN 'signup' THEN 'Error: reached max turns' WHEN 'view' THEN 'a wrong answer'
      WHEN 'click' THEN '' ELSE event_type END AS final_answer,
    CASE WHEN event_type = 'error' THEN 'API attempts failed' ELSE '' END AS error,
    event_type <> 'error' AS completed, CAST(trunc(value) AS BIGINT) AS turns,
    event_id % 4 AS tool_calls, props, event_id
  FROM events)"""


def api_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("kind"),
        F.concat(F.lit("ep"), (F.col("user_id") % 8).cast("string")).alias("endpoint"),
        F.col("value").alias("latency_sec"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.when(F.col("event_type") == "error", "http").alias("error_type"),
        (F.col("event_id") % 1000).alias("prompt_tokens"),
        (F.col("event_id") % 97).alias("completion_tokens"),
        F.col("event_id"),
    )


TIMINGS_SQL = """timings AS (
  SELECT ts AS "timestamp", event_type AS kind, 'ep' || CAST(user_id % 8 AS VARCHAR) AS endpoint,
    value AS latency_sec, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
    CASE WHEN event_type = 'error' THEN 'http' END AS error_type,
    event_id % 1000 AS prompt_tokens, event_id % 97 AS completion_tokens, event_id
  FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as benchmark samples; the quality label, where present, is the solution."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return lookup(docs, labels, ["doc_id"]).select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("doc_id").alias("ord"),
        F.col("source").alias("benchmark_name"),
        F.col("text").alias("problem"),
        F.col("quality").cast("string").alias("solution"),
        "lang",
        "n_chars",
    )


SAMPLES_SQL = """samples AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.doc_id AS ord, d.source AS benchmark_name,
    d.text AS problem, CAST(l.quality AS VARCHAR) AS solution, d.lang, d.n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalog products: type, brand and name words form the category path."""
    part = table(spark, sf_dir, "part")
    words = F.split(F.lower("p_name"), " ")
    return part.select(
        F.concat(F.lit("B"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("asin"),
        F.lower("p_type").alias("category"),
        F.col("p_type").alias("query"),
        F.concat_ws(" › ", "p_type", "p_brand", F.element_at(words, 1)).alias("product_category"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("$"), F.format_string("%.2f", "p_retailprice")).alias("pricing"),
        words.alias("attributes"),
        F.col("p_size").alias("size"),
        F.col("p_brand").alias("brand"),
        F.col("p_partkey").alias("ord"),
        F.col("p_retailprice").alias("price"),
    )


PRODUCTS_SQL = """products AS (
  SELECT 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS asin, lower(p_type) AS category,
    p_type AS query,
    p_type || ' › ' || p_brand || ' › ' || string_split(lower(p_name), ' ')[1] AS product_category,
    p_name AS name, '$' || printf('%.2f', p_retailprice) AS pricing,
    string_split(lower(p_name), ' ') AS attributes, p_size AS size, p_brand AS brand,
    p_partkey AS ord, p_retailprice AS price
  FROM part)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded library items; the label is the item kind."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("kind"), "embedding"
    )


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation messages wrapped as model responses of six kinds, with a gold answer."""
    t, turn, conv = F.col("text"), F.col("turn"), F.col("conv_id")
    kind = (conv + turn) % 6
    n = turn.cast("string")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(kind == 0, "search_qa").when(kind <= 2, "contains").when(kind == 3, "gsm8k")
        .when(kind == 4, "choice").otherwise("format").alias("data_source"),
        F.when(kind == 0, F.concat(F.lit("<think>x</think><answer> "), t, F.lit(" </answer>")))
        .when(kind == 1, F.concat(F.lit("Final Answer: "), t))
        .when(kind == 2, t)
        .when(kind == 3, F.concat(t, F.lit(" 12 so #### $1,23"), n, F.lit(" dollars")))
        .when(kind == 4, F.concat(F.lit("ANSWER: $"), F.char(65 + conv % 4), F.lit(" "), t))
        .otherwise(F.concat(F.lit("<think>"), t, F.lit("</think> so \\boxed{"), n, F.lit("} done")))
        .alias("response"),
        F.when(kind == 0, F.when(conv % 2 == 0, F.concat(F.lit("The "), t, F.lit("!"))).otherwise("none"))
        .when(kind <= 2, F.when(turn % 2 == 0, F.lower(t)).otherwise("zzz"))
        .when(kind == 3, F.concat(F.lit("123"), (turn % 4).cast("string")))
        .when(kind == 4, "A")
        .otherwise("")
        .alias("gold"),
        "text",
    )


GRADED_SQL = """graded AS (
  SELECT conv_id, turn, text,
    CASE kind WHEN 0 THEN 'search_qa' WHEN 1 THEN 'contains' WHEN 2 THEN 'contains' WHEN 3 THEN 'gsm8k'
      WHEN 4 THEN 'choice' ELSE 'format' END AS data_source,
    CASE kind WHEN 0 THEN '<think>x</think><answer> ' || text || ' </answer>'
      WHEN 1 THEN 'Final Answer: ' || text WHEN 2 THEN text
      WHEN 3 THEN text || ' 12 so #### $1,23' || CAST(turn AS VARCHAR) || ' dollars'
      WHEN 4 THEN 'ANSWER: $' || chr(CAST(65 + conv_id % 4 AS INTEGER)) || ' ' || text
      ELSE '<think>' || text || '</think> so \\boxed{' || CAST(turn AS VARCHAR) || '} done' END AS response,
    CASE kind WHEN 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'The ' || text || '!' ELSE 'none' END
      WHEN 1 THEN CASE WHEN turn % 2 = 0 THEN lower(text) ELSE 'zzz' END
      WHEN 2 THEN CASE WHEN turn % 2 = 0 THEN lower(text) ELSE 'zzz' END
      WHEN 3 THEN '123' || CAST(turn % 4 AS VARCHAR) WHEN 4 THEN 'A' ELSE '' END AS gold
  FROM (SELECT *, (conv_id + turn) % 6 AS kind FROM conversations))"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as appended trajectory log lines: texts, tool results and tool errors."""
    kind, eid = F.col("event_type"), F.col("event_id")
    code = (400 + eid % 30).cast("string")
    d = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("sample_id"),
        F.concat(F.lit("rollout_"), (eid % 2).cast("string")).alias("rollout_id"),
        eid.alias("line_no"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind.isin("view", "click"), eid % 7).alias("turn_idx"),
        F.when(kind == "view", F.concat(F.lit("step "), F.col("props"))).when(kind == "click", " ").alias("text_output"),
        F.when(kind == "purchase", "web_search").when(kind == "signup", "visit").alias("tool_name"),
        F.when(kind == "purchase", F.concat(F.lit("result "), F.col("value").cast("string"))).alias("tool_result"),
        F.when(kind == "error", F.concat(F.lit("HTTP "), code, F.when(eid % 3 == 0, " Timed out, quota").otherwise("")))
        .alias("tool_error"),
        F.when(eid % 5 == 0, F.concat(F.lit("doc_"), (eid % 3).cast("string"))).alias("doc_id"),
    )
    fields = [
        F.col("turn_idx"), F.col("text_output"), F.col("tool_name"),
        F.when(F.col("tool_error").isNotNull(), F.struct(F.lit("web_search").alias("tool_name"), F.col("tool_error").alias("error")))
        .alias("tool_error"),
    ]
    return d.withColumn("raw", F.to_json(F.struct(*fields)))


EVENT_LOG_SQL = """event_log AS (
  SELECT CAST(user_id AS VARCHAR) AS sample_id, 'rollout_' || CAST(event_id % 2 AS VARCHAR) AS rollout_id,
    event_id AS line_no, ts,
    CASE WHEN event_type IN ('view', 'click') THEN event_id % 7 END AS turn_idx,
    CASE event_type WHEN 'view' THEN 'step ' || props WHEN 'click' THEN ' ' END AS text_output,
    CASE event_type WHEN 'purchase' THEN 'web_search' WHEN 'signup' THEN 'visit' END AS tool_name,
    CASE WHEN event_type = 'purchase' THEN 'result ' || CAST(value AS VARCHAR) END AS tool_result,
    CASE WHEN event_type = 'error' THEN 'HTTP ' || CAST(400 + event_id % 30 AS VARCHAR) ||
      CASE WHEN event_id % 3 = 0 THEN ' Timed out, quota' ELSE '' END END AS tool_error,
    CASE WHEN event_id % 5 = 0 THEN 'doc_' || CAST(event_id % 3 AS VARCHAR) END AS doc_id
  FROM events)"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as one ChatML prompt, its last message as the output."""
    m = table(spark, sf_dir, "conversations")
    line = F.struct("turn", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")).alias("s"))
    g = m.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(line)).alias("l"), F.max_by("text", "turn").alias("output")
    )
    return g.select("conv_id", F.array_join(F.transform("l", lambda x: x["s"]), "").alias("prompt"), "output")


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skill bank from the nations: two regions general, two task categories, one of mistakes."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    no, reg = F.col("n_nationkey"), F.col("n_regionkey")
    return n.select(
        F.when(reg <= 1, "general").when(reg <= 3, "task").otherwise("mistake").alias("kind"),
        F.when((reg > 1) & (reg <= 3), F.lower(F.replace("r_name", F.lit(" "), F.lit("_")))).alias("category"),
        no.cast("long").alias("ord"),
        F.concat(
            F.when((reg <= 1) & (no % 2 == 0), "dyn_").when(reg <= 1, "gen_").when(reg <= 3, "task_").otherwise("err_"),
            F.lpad(no.cast("string"), 3, "0")).alias("skill_id"),
        F.col("n_name").alias("title"),
        F.concat(F.lit("p "), "n_name").alias("principle"),
        F.when(no % 3 != 0, F.col("r_name")).otherwise("").alias("when_to_apply"),
        F.concat(F.lit("d "), "n_name").alias("description"),
        F.when(no % 3 != 1, F.concat(F.lit("h "), "n_name")).otherwise("").alias("how_to_avoid"),
    )


SKILLS_SQL = """skills AS (
  SELECT CASE WHEN n_regionkey <= 1 THEN 'general' WHEN n_regionkey <= 3 THEN 'task' ELSE 'mistake' END AS kind,
    CASE WHEN n_regionkey IN (2, 3) THEN lower(replace(r_name, ' ', '_')) END AS category, CAST(n_nationkey AS BIGINT) AS ord,
    CASE WHEN n_regionkey <= 1 AND n_nationkey % 2 = 0 THEN 'dyn_' WHEN n_regionkey <= 1 THEN 'gen_' WHEN n_regionkey <= 3 THEN 'task_'
      ELSE 'err_' END || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS skill_id,
    n_name AS title, 'p ' || n_name AS principle, CASE WHEN n_nationkey % 3 <> 0 THEN r_name ELSE '' END AS when_to_apply,
    'd ' || n_name AS description, CASE WHEN n_nationkey % 3 <> 1 THEN 'h ' || n_name ELSE '' END AS how_to_avoid
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
