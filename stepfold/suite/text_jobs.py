"""Queries that score, parse and label whole text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.functions import classify as C
from stepfold.functions import parse as P
from stepfold.functions import text as T
from stepfold.operators import grading as G
from stepfold.plans import views as V
from stepfold.plans.views import EVENT_LOG_SQL, GRADED_SQL, PRODUCTS_SQL, ROLLOUTS_SQL
from stepfold.suite.registry import as_text, q6, query, r6


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _norm_sql(c: str) -> str:
    """QA normalisation written as tokens: drop punctuation, split, drop articles."""
    bare = f"translate(lower({c}), {_sq(T.PUNCTUATION)}, '')"
    words = f"list_filter(regexp_split_to_array({bare}, '\\s+'), lambda w: w NOT IN ('a', 'an', 'the', ''))"
    return f"array_to_string({words}, ' ')"


def _alnum_sql(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9一-鿿]+', ' ', 'g'))"


_LAST = "nullif(regexp_extract_all(response, '(?s)<answer>(.*?)</answer>', 1), [])[-1]"
_FIRST = """trim(CASE WHEN regexp_matches(response, '(?is)<answer>(.*?)</answer>')
    THEN regexp_extract(response, '(?is)<answer>(.*?)</answer>', 1)
  WHEN regexp_matches(response, '(?is)final\\s+answer\\s*[:：]\\s*(.+)')
    THEN regexp_extract(response, '(?is)final\\s+answer\\s*[:：]\\s*(.+)', 1)
  WHEN regexp_matches(response, '(?is)answer\\s*[:：]\\s*(.+)')
    THEN regexp_extract(response, '(?is)answer\\s*[:：]\\s*(.+)', 1) ELSE response END)"""


@query("answer_extraction", f"""WITH {GRADED_SQL}
SELECT conv_id, turn, trim({_LAST}) AS last_tag, {_FIRST} AS first_answer FROM graded""")
def _(spark, sf):
    r = F.col("response")
    return V.graded(spark, sf).select(
        "conv_id", "turn", T.last_answer_tag(r).alias("last_tag"), T.first_answer(r).alias("first_answer")
    )


@query("answer_normalization", f"""SELECT doc_id, md5({_norm_sql('text')}) AS qa, md5({_alnum_sql('text')}) AS alnum
FROM documents""")
def _(spark, sf):
    t = F.col("text")
    return V.table(spark, sf, "documents").select(
        "doc_id", F.md5(T.normalize_answer_qa(t)).alias("qa"), F.md5(T.normalize_answer_alnum(t)).alias("alnum")
    )


@query("exact_and_sub_match", f"""WITH {GRADED_SQL}
SELECT conv_id, turn, {_norm_sql('text')} = {_norm_sql('gold')} OR {_norm_sql('text')} = {_norm_sql("text || '.'")} AS em,
  contains({_norm_sql('text')}, {_norm_sql('gold')}) AS sub FROM graded""")
def _(spark, sf):
    golds = F.array(F.col("gold"), F.concat("text", F.lit(".")))
    return V.graded(spark, sf).select(
        "conv_id", "turn", T.exact_match(F.col("text"), golds).alias("em"),
        T.sub_match(F.col("text"), F.array("gold")).alias("sub"),
    )


_GRADES = f"""CASE data_source
  WHEN 'search_qa' THEN CASE WHEN {_LAST} IS NULL THEN 0 WHEN {_norm_sql(_LAST)} = {_norm_sql('gold')} THEN 1 ELSE 0 END
  WHEN 'contains' THEN CASE WHEN {_alnum_sql(_FIRST)} = '' OR {_alnum_sql('gold')} = '' THEN 0
    WHEN contains({_alnum_sql(_FIRST)}, {_alnum_sql('gold')}) OR contains({_alnum_sql('gold')}, {_alnum_sql(_FIRST)})
    THEN 1 ELSE 0 END
  WHEN 'gsm8k' THEN CASE WHEN replace(replace(regexp_extract(response, '#### (\\$?-?[0-9.,]+)', 1), ',', ''), '$', '') = gold
    AND regexp_matches(response, '#### -?[0-9.,]+') THEN 1 ELSE 0 END
  WHEN 'choice' THEN CASE WHEN regexp_extract(response, '(?i)Answer[ \\t]*:[ \\t]*\\$?([A-D])', 1) = gold THEN 1 ELSE 0 END
  ELSE CASE WHEN regexp_full_match(response, '(?s)<think>.*</think>.*\\\\boxed\\{{.*\\}}.*') THEN 1 ELSE 0 END END"""


@query("grade_responses", f"""WITH {GRADED_SQL}
SELECT conv_id, turn, data_source, CAST({_GRADES} AS DOUBLE) AS score FROM graded""")
def _(spark, sf):
    return G.grade_responses(V.graded(spark, sf)).select("conv_id", "turn", "data_source", "score")


@query("grade_by_source", f"""WITH {GRADED_SQL}, s AS (SELECT data_source, {_GRADES} AS score FROM graded)
SELECT data_source, count(*) AS n, {q6('avg(score)')} AS mean_score FROM s GROUP BY data_source""")
def _(spark, sf):
    d = G.grade_responses(V.graded(spark, sf))
    return d.groupBy("data_source").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score")).alias("mean_score"))


@query("score_gsm8k_flexible", f"""WITH {GRADED_SQL}, a AS (
  SELECT conv_id, turn, gold, list_filter(regexp_extract_all(response, '(-?[0-9.,]+)', 1),
    lambda x: x NOT IN ('', '.')) AS nums FROM graded)
SELECT conv_id, turn, nums[-1] AS answer, CASE WHEN len(nums) = 0 THEN 0.0::DOUBLE
  WHEN nums[-1] = gold THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS score FROM a""")
def _(spark, sf):
    r, g = F.col("response"), F.col("gold")
    return V.graded(spark, sf).select(
        "conv_id", "turn", T.gsm8k_answer(r, "flexible").alias("answer"),
        T.score_gsm8k(r, g, "flexible", 0.1).alias("score"),
    )


@query("score_blend", f"""WITH {GRADED_SQL}
SELECT conv_id, turn, {q6('''0.9 * CASE WHEN gold = lower(text) THEN 1 ELSE 0 END + 0.1 * CASE WHEN
  starts_with(response, '<think>') AND contains(response, '</think> so \\boxed{') THEN 1 ELSE 0 END''')} AS score FROM graded""")
def _(spark, sf):
    acc = (F.col("gold") == F.lower("text")).cast("double")
    return V.graded(spark, sf).select(
        "conv_id", "turn", r6(T.blend(acc, T.score_format(F.col("response")))).alias("score")
    )


_MARKS = " OR ".join(f"contains(lower(cand), {_sq(m)})" for m in T.NON_ANSWER_MARKERS)


@query("concrete_answers", f"""WITH {ROLLOUTS_SQL}, {GRADED_SQL}, u AS (
  SELECT 'rollout' AS src, event_id AS id, final_answer AS response FROM rollouts
  UNION ALL SELECT 'graded', conv_id * 100 + turn, response FROM graded),
a AS (SELECT src, id, trim(response) AS t, trim(coalesce(
    trim(nullif(regexp_extract_all(response, '(?is)<answer>\\s*(.*?)\\s*</answer>', 1), [])[-1]),
    CASE WHEN regexp_matches(response, '(?is)(?:final\\s+answer|answer)\\s*[:：]\\s*(.+)') THEN
      regexp_extract(response, '(?is)(?:final\\s+answer|answer)\\s*[:：]\\s*(.+)', 1) END, response)) AS cand FROM u),
r AS (SELECT *, CASE WHEN t = '' OR cand = '' THEN {_sq(T.EMPTY_REASON)}
  WHEN starts_with(lower(t), 'error:') OR starts_with(lower(cand), 'error:') THEN {_sq(T.ERROR_REASON)}
  WHEN {_MARKS} THEN {_sq(T.MARKER_REASON)} ELSE '' END AS reason FROM a)
SELECT src, id, CASE WHEN reason = '' THEN cand END AS answer, reason FROM r""")
def _(spark, sf):
    a = V.rollouts(spark, sf).select(F.lit("rollout").alias("src"), F.col("event_id").alias("id"), F.col("final_answer").alias("r"))
    g = V.graded(spark, sf).select(F.lit("graded").alias("src"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("response").alias("r"))
    d = a.unionByName(g).withColumn("c", T.concrete_answer(F.col("r")))
    return d.select("src", "id", "c.answer", "c.reason")


@query("overlong_penalty", f"""SELECT doc_id, {q6('least(-(n_chars - (4000 - 1000)) / 1000.0 * 0.5, 0)')} AS penalty FROM documents""")
def _(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id", r6(T.overlong_penalty(F.col("n_chars"), 4000, 1000, 0.5)).alias("penalty")
    )


_ACTS_SQL = """acts AS (SELECT conv_id, turn, CASE (conv_id + turn) % 4
    WHEN 0 THEN '<think>go</think><action> ' || text || ' </action>'
    WHEN 1 THEN '<action>' || text || '</action>' WHEN 2 THEN '<think>' || text || '</think> no tag'
    ELSE '<think>x</think><action>门' || text || '</action>' END AS response, text FROM conversations)"""


def _acts(spark, sf):
    t, k = F.col("text"), (F.col("conv_id") + F.col("turn")) % 4
    return V.messages(spark, sf).select(
        "conv_id", "turn", "text",
        F.when(k == 0, F.concat(F.lit("<think>go</think><action> "), t, F.lit(" </action>")))
        .when(k == 1, F.concat(F.lit("<action>"), t, F.lit("</action>")))
        .when(k == 2, F.concat(F.lit("<think>"), t, F.lit("</think> no tag")))
        .otherwise(F.concat(F.lit("<think>x</think><action>门"), t, F.lit("</action>"))).alias("response"),
    )


@query("validate_actions", f"""WITH {_ACTS_SQL}
SELECT conv_id, turn, (conv_id + turn) % 4 = 0 AS valid, CASE (conv_id + turn) % 4 WHEN 0 THEN trim(lower(text))
  WHEN 1 THEN trim(lower(text)) WHEN 2 THEN right(lower(response), 30) ELSE '门' || trim(lower(text)) END AS action
FROM acts""")
def _(spark, sf):
    d = G.validate_actions(_acts(spark, sf), "household")
    return d.select("conv_id", "turn", F.col("is_action_valid").alias("valid"), "action")


@query("validate_search_actions", """WITH a AS (SELECT *, (conv_id + turn) % 4 AS k FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN '<search>' || trim(text) || '</search>' WHEN 1 THEN '<answer>' || trim(text) || '</answer>'
  WHEN 2 THEN '<search>' || trim(text) || '</search>' ELSE '' END AS action, k < 2 AS valid FROM a""")
def _(spark, sf):
    t, k = F.col("text"), (F.col("conv_id") + F.col("turn")) % 4
    r = (
        F.when(k == 0, F.concat(F.lit("hm <search> "), t, F.lit("</search> tail")))
        .when(k == 1, F.concat(F.lit("<Answer>"), t, F.lit("</answer>")))
        .when(k == 2, F.concat(F.lit("<search>"), t, F.lit("</search><answer>b</answer>")))
        .otherwise(t)
    )
    d = G.validate_actions(V.messages(spark, sf).withColumn("response", r), "search")
    return d.select("conv_id", "turn", "action", F.col("is_action_valid").alias("valid"))


@query("valid_action_ratio", f"""WITH {_ACTS_SQL}
SELECT turn, {q6('avg(CASE WHEN (conv_id + turn) % 4 = 0 THEN 1 ELSE 0 END)')} AS valid_action_ratio FROM acts GROUP BY turn""")
def _(spark, sf):
    from stepfold.operators.advantage import valid_action_ratio

    d = valid_action_ratio(G.validate_actions(_acts(spark, sf), "household"), ["turn"])
    return d.select("turn", r6("valid_action_ratio").alias("valid_action_ratio"))


def _calls(spark, sf):
    k, ident = (F.col("conv_id") + F.col("turn")) % 7, F.col("conv_id").cast("string")
    t = F.col("text")
    r = (
        F.when(k == 0, F.concat(t, F.lit('<tool_call>{"name": "web_search", "arguments": {"q": "'), ident, F.lit('"}}</tool_call>')))
        .when(k == 1, F.concat(F.lit('<tool>{"tool_name": "visit", "parameters": {"q": "'), ident, F.lit('"}}</tool>'), t))
        .when(k == 2, F.concat(F.lit('x ```json\n{"tool": "zoom", "args": {"q": "'), ident, F.lit('"}}\n``` '), t))
        .when(k == 3, F.concat(F.lit("<tool_call>{broken "), ident, F.lit("</tool_call>"), t))
        .when(k == 4, F.concat(F.lit("<function=visit><parameter=q> "), ident, F.lit(" </parameter></function>"), t))
        .when(k == 5, F.concat(F.lit("<answer>"), t, F.lit("</answer>")))
        .otherwise(F.concat(F.lit('Action: zoom({"q": "'), ident, F.lit('"})')))
    )
    return P.extract_tool_calls(V.messages(spark, sf).withColumn("response", r), "response")


@query("extract_tool_calls", """WITH a AS (SELECT *, (conv_id + turn) % 7 AS k FROM conversations)
SELECT conv_id, turn, CASE k WHEN 3 THEN 'error' WHEN 5 THEN 'answer' ELSE 'tool_call' END AS type,
  CASE k WHEN 0 THEN 'web_search' WHEN 1 THEN 'visit' WHEN 2 THEN 'zoom' WHEN 4 THEN 'visit' WHEN 6 THEN 'zoom' END AS name,
  CASE WHEN k IN (0, 1, 2, 4, 6) THEN CAST(conv_id AS VARCHAR) END AS q,
  CASE k WHEN 3 THEN '{broken ' || CAST(conv_id AS VARCHAR) WHEN 5 THEN trim(text) END AS content FROM a""")
def _(spark, sf):
    return _calls(spark, sf).select("conv_id", "turn", "type", "name", F.col("arguments")["q"].alias("q"), "content")


@query("event_tool_names", f"""WITH {EVENT_LOG_SQL}
SELECT line_no, CASE WHEN tool_error IS NOT NULL THEN 'web_search' ELSE tool_name END AS tool FROM event_log""")
def _(spark, sf):
    return V.event_log(spark, sf).select("line_no", P.event_tool_name(F.col("raw")).alias("tool"))


@query("tool_error_types", f"""WITH {EVENT_LOG_SQL}
SELECT CASE WHEN tool_error LIKE '%403%' THEN 'http_403' WHEN tool_error LIKE '%404%' THEN 'http_404'
  WHEN tool_error LIKE '%429%' THEN 'http_429' WHEN tool_error ILIKE '%timed out%' THEN 'timeout'
  ELSE 'unknown_error' END AS error_type, count(*) AS n
FROM event_log WHERE tool_error IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    d = V.event_log(spark, sf).where("tool_error IS NOT NULL")
    return d.groupBy(C.classify_tool_error(F.col("tool_error")).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


FAILURE_SQL = """CASE WHEN error <> '' THEN 'api_timeout_or_network'
  WHEN contains(lower(final_answer), 'max turns') THEN 'max_turns' ELSE 'incorrect_answer' END"""


@query("label_failures", f"""WITH {ROLLOUTS_SQL}
SELECT event_id, {FAILURE_SQL} AS failure_type FROM rollouts""")
def _(spark, sf):
    return G.label_failures(V.rollouts(spark, sf)).select("event_id", "failure_type")


@query("trajectory_snippets", f"""WITH {EVENT_LOG_SQL}, t AS (
  SELECT *, coalesce(nullif(text_output, ''), nullif(tool_error, ''), CASE WHEN tool_name IS NOT NULL THEN concat_ws(' ', tool_name, tool_result) END) AS piece FROM event_log),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, rollout_id ORDER BY line_no) AS rn FROM t WHERE piece IS NOT NULL)
SELECT sample_id, rollout_id, string_agg(piece, chr(10) ORDER BY rn) AS snippet FROM r WHERE rn <= 6
GROUP BY sample_id, rollout_id""")
def _(spark, sf):
    return G.trajectory_snippets(V.event_log(spark, sf), first=6, cut=500)


def _first_sql(c, rules, default):
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains({c}, {_sq(w)})" for w in words) + f" THEN {_sq(label)}"
        for label, words in rules
    )
    return f"CASE {arms} ELSE {default} END"


@query("task_categories", f"""WITH g AS (SELECT doc_id, lower(text) AS t, source, lang FROM documents)
SELECT doc_id,
  CASE WHEN contains(t, 'look at') AND contains(t, 'under') THEN 'look_at_obj_in_light' WHEN contains(t, 'clean') THEN 'clean'
    WHEN contains(t, 'heat') THEN 'heat' WHEN contains(t, 'cool') THEN 'cool'
    WHEN contains(t, 'examine') OR contains(t, 'find') THEN 'examine' ELSE 'pick_and_place' END AS household,
  {_first_sql('t', C.SHOPPING, "'other'")} AS shop, {_first_sql('t', C.SHOPPING_MEMORIES, "'other'")} AS shop_memory,
  CASE WHEN lang = 'en' THEN CASE WHEN {' OR '.join(f"contains(t, {_sq(w)})" for w in C.COMPARISON_WORDS)} THEN 'comparison'
    ELSE 'multi_hop_reasoning' END WHEN lang = 'de' THEN 'entity_attribute_lookup' ELSE 'direct_retrieval' END AS search
FROM g""")
def _(spark, sf):
    t = F.col("text")
    src = F.when(F.col("lang") == "en", "musique").when(F.col("lang") == "de", "popqa").otherwise("nq")
    return V.table(spark, sf, "documents").select(
        "doc_id", C.classify_household(t).alias("household"), C.classify_shopping(t).alias("shop"),
        C.classify_shopping(t, memories=True).alias("shop_memory"), C.classify_search(t, src).alias("search"),
    )


_VERBS = ["go to", "take", "put", "open", "turn on", "look"]


@query("planning_patterns", f"""WITH w AS (
  SELECT conv_id, turn, CASE turn % 6 {' '.join(f"WHEN {i} THEN {_sq(v)}" for i, v in enumerate(_VERBS))} END || ' ' || text AS a
  FROM conversations),
k AS (SELECT conv_id, turn, {_first_sql('lower(a)', C.PLAN_WORDS, 'NULL')} AS kind FROM w),
f AS (SELECT conv_id, kind, min(turn) AS t FROM k WHERE kind IS NOT NULL GROUP BY conv_id, kind)
SELECT conv_id, string_agg(kind, ' → ' ORDER BY t) AS pattern FROM f GROUP BY conv_id""")
def _(spark, sf):
    from stepfold.operators.memory import plan_patterns

    verb = F.element_at(F.array(*[F.lit(v) for v in _VERBS]), (F.col("turn") % 6 + 1).cast("int"))
    m = V.messages(spark, sf).withColumn("action", F.concat(verb, F.lit(" "), "text"))
    return plan_patterns(m, "conv_id", "turn").select("conv_id", "pattern")


@query("trajectory_mistakes", f"""WITH w AS (
  SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'go to x' ELSE 'go ' || role END AS a FROM conversations),
n AS (SELECT conv_id, count(*) AS n, count(DISTINCT a) AS d, count(*) FILTER (contains(a, 'go to')) AS g FROM w GROUP BY conv_id)
SELECT conv_id, coalesce(nullif(array_to_string(list_filter([
  CASE WHEN n <> d THEN {_sq(C.REPEATED)} END, CASE WHEN g > n * 0.5 THEN {_sq(C.WANDERED)} END,
  CASE WHEN conv_id % 2 = 0 AND n < 5 THEN replace({_sq(C.STOPPED)}, '%s', CAST(n AS VARCHAR)) END],
  lambda x: x IS NOT NULL), '|'), ''), 'Failed to complete task: find ' || CASE WHEN conv_id % 2 = 0 THEN 'Two' ELSE 'one' END
  || '. Consider different approach.') AS mistakes FROM n""")
def _(spark, sf):
    from stepfold.operators.memory import trajectory_mistakes

    cid = F.col("conv_id")
    m = V.messages(spark, sf).withColumns({
        "action": F.when(cid % 3 == 0, "go to x").otherwise(F.concat(F.lit("go "), "role")),
        "task": F.concat(F.lit("find "), F.when(cid % 2 == 0, "Two").otherwise("one")),
    })
    return trajectory_mistakes(m, "conv_id").select("conv_id", as_text("mistakes").alias("mistakes"))


@query("render_trajectories", """SELECT conv_id, string_agg('**' || role || '**: ' || text || chr(10) || chr(10), '' ORDER BY turn)
  || '**Final Answer**: ' || max(turn) || chr(10) AS rendered FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    from stepfold.operators.records import render_trajectories

    m = V.messages(spark, sf)
    final = m.groupBy("conv_id").agg(F.max("turn").cast("string").alias("final_answer"))
    return render_trajectories(m, final)


@query("steps_from_transcripts", """WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations),
n AS (SELECT conv_id, count(*) FILTER (role = 'user') AS nu, count(*) FILTER (role = 'assistant') AS na FROM conversations GROUP BY conv_id),
z AS (SELECT u.conv_id, u.k AS step, trim(u.text) AS observation, trim(a.text) AS action
  FROM r u JOIN r a ON u.conv_id = a.conv_id AND u.k = a.k AND u.role = 'user' AND a.role = 'assistant'),
f AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS p
  FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, arg_max(text, turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, step, observation, action FROM z
UNION ALL SELECT f.conv_id, 1, p, '' FROM f JOIN n USING (conv_id) WHERE nu = 0 OR na = 0
UNION ALL SELECT l.conv_id, CASE WHEN nu = 0 OR na = 0 THEN 2 ELSE least(nu, na) + 1 END, '', t FROM l JOIN n USING (conv_id)""")
def _(spark, sf):
    return P.steps_from_transcripts(V.transcripts(spark, sf))


@query("task_descriptions", """SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN
  trim(string_split(text, chr(10))[1]) ELSE text END AS task FROM conversations""")
def _(spark, sf):
    t = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Hi.\nYour task is to: "), "text")).otherwise(F.col("text"))
    return V.messages(spark, sf).select("conv_id", "turn", P.task_description(t).alias("task"))


@query("product_colors_and_sizes", f"""WITH {PRODUCTS_SQL}
SELECT asin, {_first_sql('lower(name)', [(x, [x]) for x in C.COLORS], "'not_matched'")} AS color,
  CASE WHEN size % 3 = 0 THEN 'large' WHEN size % 3 = 1 THEN '(.*)inch' ELSE 'numeric_size' END AS size,
  {q6('price')} AS low, CASE WHEN size % 2 = 0 THEN {q6('price')} ELSE {q6('price')} + 10 END AS high
FROM products""")
def _(spark, sf):
    n, s = F.lower("name"), F.col("size").cast("string")
    raw = F.when(F.col("size") % 3 == 0, F.concat(F.lit("large "), s)).when(F.col("size") % 3 == 1, F.concat(s, F.lit(" inch"))).otherwise(s)
    more = F.concat("pricing", F.lit(" to $"), F.format_string("%.2f", F.col("price") + 10))
    p = C.parse_price(F.when(F.col("size") % 2 == 0, F.col("pricing")).otherwise(more))
    return V.products(spark, sf).select(
        "asin", C.normalize_color(n, F.lit("not_matched")).alias("color"), C.normalize_size(raw).alias("size"),
        r6(F.element_at(p, 1)).alias("low"), r6(F.element_at(p, -1)).alias("high"),
    )


@query("format_passages", """WITH p AS (SELECT doc_id // 3 AS g, doc_id, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id) AS i, text FROM documents)
SELECT g, trim(string_agg('Doc ' || i || ' (Title: ' || string_split(text, chr(10))[1] || ')' || chr(10) ||
  array_to_string(string_split(text, chr(10))[2:], chr(10)), chr(10) || chr(10) ORDER BY i), ' ' || chr(10)) AS passages FROM p GROUP BY g""")
def _(spark, sf):
    d = V.table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 3).alias("g"))
    docs = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    return d.agg(P.format_passages(docs).alias("passages"))
