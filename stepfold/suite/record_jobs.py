"""Queries that normalise samples and build training records."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.functions import normalize as N
from stepfold.functions import text as T
from stepfold.operators import records as R
from stepfold.plans import views as V
from stepfold.plans.views import SAMPLES_SQL, STEPS_SQL
from stepfold.suite.registry import as_text, query

_BENCH = "CASE WHEN doc_id % 3 = 0 THEN ' MM-BrowseComp' WHEN doc_id % 3 = 1 THEN '__Tir--Bench' ELSE 'a__b ' END"
_BENCH_OUT = "CASE WHEN doc_id % 3 = 0 THEN 'mmbrowsecomp' WHEN doc_id % 3 = 1 THEN 'tirbench' ELSE 'a_b' END"
_RAW = "CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'tirbench_' || doc_id ELSE ' ' || doc_id END"


def _docs(spark, sf):
    return V.table(spark, sf, "documents")


def _case(m, *vals):
    """Choose by doc_id modulo: every row gets one of the shapes."""
    out = None
    for i, v in enumerate(vals[:-1]):
        hit = F.col("doc_id") % m == i
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out.otherwise(vals[-1])


def _bench():
    return _case(3, " MM-BrowseComp", "__Tir--Bench", "a__b ")


def _raw():
    ident = F.col("doc_id").cast("string")
    return _case(4, F.lit(""), F.concat(F.lit("tirbench_"), ident), F.concat(F.lit(" "), ident))


_ID_SQL = f"""CASE WHEN trim({_RAW}) = '' THEN {_BENCH_OUT} WHEN starts_with(trim({_RAW}), {_BENCH_OUT} || '_') THEN trim({_RAW})
  ELSE {_BENCH_OUT} || '_' || trim({_RAW}) END"""


@query("benchmark_names_and_ids", f"SELECT doc_id, {_BENCH_OUT} AS bench, {_ID_SQL} AS full_id FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", N.normalize_benchmark(_bench()).alias("bench"), N.prefixed_id(_raw(), _bench()).alias("full_id")
    )


@query("rewrite_ids", f"""SELECT ord, src || '_' || ord AS doc_id, CASE WHEN ord % 2 = 0 THEN CAST(ord AS VARCHAR) END AS original_doc_id,
  ord % 2 = 0 AS changed FROM (SELECT doc_id AS ord, source AS src FROM documents)""")
def _(spark, sf):
    d = _docs(spark, sf).select(F.col("doc_id").alias("ord"), F.col("source").alias("benchmark_name"))
    ident = F.col("ord").cast("string")
    full = F.concat("benchmark_name", F.lit("_"), ident)
    d = d.withColumn("doc_id", F.when(F.col("ord") % 2 == 0, ident).otherwise(full))
    return R.rewrite_ids(d).select("ord", "doc_id", "original_doc_id", "changed")


@query("normalize_samples", """SELECT doc_id AS ord, 'tirbench_' || CASE WHEN doc_id % 3 = 0 THEN printf('tirbench_%04d', doc_id)[10:]
    ELSE CAST(doc_id AS VARCHAR) END AS doc_id, 'tirbench' AS benchmark_name, text AS problem, source AS solution,
  CASE lang WHEN 'fr' THEN 'ocr' WHEN 'en' THEN 'maze' ELSE 'refcoco' END AS task
FROM documents WHERE lang <> 'es'""")
def _(spark, sf):
    d = _docs(spark, sf).select(
        F.col("doc_id").alias("ord"),
        F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("problem"),
        F.when(F.col("doc_id") % 2 == 1, F.col("text")).alias("question"),
        F.col("source").alias("answer"),
        F.when(F.col("lang") == "fr", " OCR").alias("_tirbench_task"),
        F.when(F.col("lang") == "en", "maze").when(F.col("lang") == "de", "refcoco").otherwise("unlisted").alias("category"),
    )
    out = R.normalize_samples(d, "tirbench", order="ord")
    return out.select("ord", "doc_id", "benchmark_name", "problem", "solution", "task")


@query("normalize_samples_by_turn", """SELECT doc_id AS ord, 'visualtoolbench_' || doc_id AS doc_id, text AS problem, lang AS solution,
  'unknown' AS prompt_category FROM documents WHERE lang = 'en'""")
def _(spark, sf):
    d = _docs(spark, sf).select(
        F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("lang") == "en", " Single-Turn").otherwise("multi-turn").alias("turncase"), F.lit("Hybrid_Tool_Reasoning").alias("eval_focus"),
        F.array("text", "source").alias("turn_prompts"), F.array("lang").alias("turn_golden_answers"),
    )
    out = R.normalize_samples(d, "visualtoolbench", order="ord")
    return out.select("ord", "doc_id", "problem", "solution", "prompt_category")


@query("flatten_images", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '|' || 'a.png' ELSE url || '|b.png|c.png' END AS images FROM pages""")
def _(spark, sf):
    even = F.col("page_id") % 2 == 0
    imgs = N.flatten_images(
        single=F.col("url"), many=F.when(even, F.array(F.lit("a.png"), F.lit(" "))),
        structs=F.when(~even, F.array(
            F.struct(F.lit("b.png").alias("image"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("url")),
            F.struct(F.lit(None).cast("string").alias("image"), F.lit(None).cast("string").alias("path"), F.lit("c.png").alias("url")))),
    )
    return V.table(spark, sf, "pages").select("page_id", as_text(imgs).alias("images"))


@query("repair_paths", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN './img/' || page_id || '.png' ELSE 'other/' || page_id END AS path FROM pages""")
def _(spark, sf):
    ident, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    raw = (
        F.when(k == 0, F.concat(F.lit("benchmark\\x\\"), "url"))
        .when(k == 1, F.concat(F.lit("./benchmark\\MM-BrowseComp\\img\\"), ident, F.lit(".png")))
        .otherwise(F.concat(F.lit(" other\\"), ident))
    )
    return V.table(spark, sf, "pages").select("page_id", N.repair_path(raw).alias("path"))


@query("local_url_keys", r"""WITH u AS (SELECT page_id, url, split_part(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '', 1) AS x,
  regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages),
p AS (SELECT *, list_filter(string_split(url_decode(path), '/'), lambda s: s <> '') AS parts FROM u)
SELECT page_id, array_to_string(list_concat([replace(host, ':', '_')], parts[:-2], [
  coalesce(nullif(regexp_replace(coalesce(parts[-1], ''), '(.)\.[^.]+$', '\1'), ''), 'image') || '_' || sha256(url)[:16] ||
  CASE WHEN regexp_matches(lower(coalesce(parts[-1], '')), '.\.(jpg|jpeg|png|webp|bmp|gif)$') THEN regexp_extract(lower(parts[-1]), '\.[^.]+$')
    ELSE '.png' END]), '/') AS local_key FROM p""")
def _(spark, sf):
    broken = F.regexp_replace("url", "^https://", "https:/")
    return R.localize_urls(V.table(spark, sf, "pages").withColumn("url", broken)).select("page_id", "local_key")


@query("append_source_urls", f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN trim('See ' || upper(url)) ELSE 'No link' END || chr(10) || chr(10) ||
  '{N.SOURCE_HEADING.strip()}' || chr(10) || CASE WHEN page_id % 2 = 0 THEN '1. http://x.test/' || page_id
  ELSE '1. ' || url || chr(10) || '2. http://x.test/' || page_id END AS problem FROM pages""")
def _(spark, sf):
    p = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("See "), F.upper("url"))).otherwise("No link")
    other = F.concat(F.lit("http://x.test/"), F.col("page_id").cast("string"))
    return V.table(spark, sf, "pages").select(
        "page_id", N.append_source_urls(p, F.array(F.col("url"), F.lit(" "), F.col("url"), other)).alias("problem")
    )


_SFT_SQL = f"""{SAMPLES_SQL}, f AS (SELECT * FROM samples WHERE coalesce(trim(solution), '') <> '')"""


@query("extract_problem_and_solution", """WITH c AS (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS u, max(turn) AS n
  FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'Q' || conv_id ELSE trim(u, ' ' || chr(10)) END AS problem, CAST(n AS VARCHAR) AS solution FROM c""")
def _(spark, sf):
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    d = V.messages(spark, sf).groupBy("conv_id").agg(m.alias("messages"), F.max("turn").alias("label"))
    d = d.withColumns({"problem": F.lit(" "), "question": F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Q"), "conv_id"))})
    return d.select("conv_id", R.extract_problem(d).alias("problem"), R.extract_solution(d).alias("solution"))


@query("build_sft_records", f"""WITH {_SFT_SQL}
SELECT ord, md5('SYSTEM:' || chr(10) || '{R.SYSTEM_PROMPT}' || chr(10) || chr(10) || 'USER:' || chr(10) || trim(problem, ' ' || chr(10) || chr(9))) AS prompt,
  '<answer>' || solution || '</answer>' AS response, benchmark_name FROM f""")
def _(spark, sf):
    d = R.build_sft_records(V.samples(spark, sf), order="ord")
    return d.select(F.col("extra_info.index").alias("ord"), F.md5("prompt").alias("prompt"), "response", "extra_info.benchmark_name")


@query("build_rl_records", f"""WITH {SAMPLES_SQL}
SELECT ord, benchmark_name AS data_source, md5('{R.SYSTEM_PROMPT}' || chr(10) || chr(10) || '{R.SKILL_HEADING}' || chr(10) || 'S' || lang) AS system,
  md5(problem) AS "user", coalesce(solution, '') AS ground_truth FROM samples""")
def _(spark, sf):
    s = V.samples(spark, sf).withColumn("skill_text", F.concat(F.lit("S"), "lang"))
    d = R.build_rl_records(s, order="ord", skill_text="skill_text")
    return d.select(
        F.col("extra_info.index").alias("ord"), "data_source", F.md5(F.col("prompt")[0]["content"]).alias("system"),
        F.md5(F.col("prompt")[1]["content"]).alias("user"), "reward_model.ground_truth",
    )


@query("preset_gsm8k", f"""SELECT doc_id AS idx, md5(text || ' ' || '{R.GSM8K_INSTRUCTION.replace("'", "''")}') AS prompt,
  CAST(1000 + n_chars AS VARCHAR) AS gold FROM documents""")
def _(spark, sf):
    n = F.format_number(F.col("n_chars") + 1000, 0)
    d = _docs(spark, sf).select("doc_id", F.col("text").alias("question"), F.concat(F.lit("so #### "), n).alias("answer"))
    out = R.map_instruction_dataset(d, "gsm8k", order="doc_id", split="train", data_source="gsm8k")
    return out.select(F.col("extra_info.index").alias("idx"), F.md5(F.col("prompt")[0]["content"]).alias("prompt"), F.col("reward_model.ground_truth").alias("gold"))


@query("preset_hellaswag", r"""SELECT doc_id AS idx, md5(replace(regexp_replace(replace(trim(source || ': ' || 'A [title]' || ' ' ||
  upper(left(text, 1)) || lower(text[2:]), ' ' || chr(10)), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ')) AS prompt, lang AS gold
FROM documents WHERE lang IN ('en', 'fr')""")
def _(spark, sf):
    d = _docs(spark, sf).select(
        "doc_id", F.lit("A [title]").alias("ctx_a"), F.col("text").alias("ctx_b"), F.col("source").alias("activity_label"),
        F.when(F.col("lang").isin("en", "fr"), F.col("lang")).otherwise("").alias("label"),
    )
    out = R.map_instruction_dataset(d, "hellaswag", order="doc_id", split="val", data_source="hellaswag")
    return out.select(F.col("extra_info.index").alias("idx"), F.md5(F.col("prompt")[0]["content"]).alias("prompt"), F.col("reward_model.ground_truth").alias("gold"))


@query("preset_multiple_choice", """WITH o AS (SELECT doc_id, unnest([0, 1, 2, 3]) AS i FROM documents),
h AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY md5('5:' || doc_id || ':' || i)) AS pos FROM o)
SELECT doc_id AS idx, chr(CAST(64 + max(pos) FILTER (i = 0) AS INTEGER)) AS gold,
  string_agg('opt' || i, ',' ORDER BY pos) AS options FROM h GROUP BY doc_id""")
def _(spark, sf):
    d = _docs(spark, sf).select(
        "doc_id", F.lit("opt0").alias("correct"), *[F.lit(f"opt{i}").alias(f"wrong{i}") for i in (1, 2, 3)]
    )
    out = R.shuffled_choices(d, F.col("doc_id"), F.col("correct"), [F.col(f"wrong{i}") for i in (1, 2, 3)], 5)
    return out.select(F.col("doc_id").alias("idx"), F.col("gold_letter").alias("gold"), as_text("choices", ",").alias("options"))


@query("preset_other_sources", f"""SELECT doc_id AS idx, p AS preset, md5(text || CASE p WHEN 'math' THEN ' {R.MATH_INSTRUCTION.replace("'", "''")}'
  WHEN 'geo3k' THEN ' {R.GEO_INSTRUCTION}' ELSE '' END) AS prompt, source AS gold
FROM documents, (SELECT unnest(['math', 'geo3k', 'aime', 'search_qa']) AS p)""")
def _(spark, sf):
    d = _docs(spark, sf).select(
        "doc_id", F.col("text").alias("problem"), F.col("text").alias("question"), F.col("source").alias("gold"),
        F.col("source").alias("answer"), F.col("source").alias("golden_answer"),
    )
    out = None
    for p in ("math", "geo3k", "aime", "search_qa"):
        m = R.map_instruction_dataset(d, p, order="doc_id", split="train", data_source=p)
        m = m.select(F.col("extra_info.index").alias("idx"), F.lit(p).alias("preset"),
                     F.md5(F.col("prompt")[0]["content"]).alias("prompt"), F.col("reward_model.ground_truth").alias("gold"))
        out = m if out is None else out.unionByName(m)
    return out


@query("date_window", """SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY o_orderpriority""")
def _(spark, sf):
    import datetime as dt

    o = R.filter_date_window(V.table(spark, sf, "orders"), "o_orderdate", dt.datetime(1996, 1, 1), dt.datetime(1997, 1, 1))
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def _pairs(spark, sf):
    return _docs(spark, sf).select("doc_id", F.col("text").alias("prompt"), F.col("source").alias("chosen"), F.col("lang").alias("rejected"))


@query("preference_sft", """SELECT doc_id, md5(text) AS prompt, CAST(i AS BIGINT) AS ord, CASE i WHEN 0 THEN source ELSE lang END AS response
FROM documents, (SELECT unnest([0, 1]) AS i)""")
def _(spark, sf):
    d = R.preference_records(_pairs(spark, sf), "sft", order="doc_id")
    return d.select("doc_id", F.md5("prompt").alias("prompt"), F.col("ord").cast("long"), "response")


@query("preference_rm_split", """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= CAST(round_even(count(*) OVER () * 0.75, 0) AS BIGINT)
  THEN 'train' ELSE 'test' END AS split FROM documents""")
def _(spark, sf):
    return R.preference_records(_pairs(spark, sf), "rm", order="doc_id").select("doc_id", "split")


@query("token_estimates", r"""SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS est, len(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS words FROM documents""")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", T.estimate_tokens(F.col("text")).alias("est"), T.word_count(F.col("text")).alias("words"))


@query("truncate_tokens", """WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, array_to_string(CASE WHEN len(w) > 7 THEN w[-7:] ELSE list_concat(list_resize(CAST([] AS VARCHAR[]), 7 - len(w), '<p>'), w) END, ' ') AS l,
  array_to_string(CASE WHEN len(w) > 7 THEN w[:7] ELSE list_concat(w, list_resize(CAST([] AS VARCHAR[]), 7 - len(w), '<p>')) END, ' ') AS r,
  array_to_string(CASE WHEN len(w) > 7 THEN list_concat(w[:3], w[-4:]) ELSE w END, ' ') AS m FROM w""")
def _(spark, sf):
    w = F.split("text", " ")
    return _docs(spark, sf).select(
        "doc_id", as_text(N.truncate_tokens(w, 7, "left", "<p>"), " ").alias("l"),
        as_text(N.truncate_tokens(w, 7, "right", "<p>", pad_left=False), " ").alias("r"),
        as_text(N.truncate_tokens(w, 7, "middle"), " ").alias("m"),
    )


@query("filter_overlong", r"""SELECT doc_id FROM documents WHERE len(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) <= 300""")
def _(spark, sf):
    return R.filter_overlong(_docs(spark, sf).withColumnRenamed("text", "prompt"), 300).select("doc_id")


@query("align_placeholders", """SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN '<image> <image>' || chr(10) || text
  WHEN 1 THEN 'x<image>' || text || chr(10) || '<image>' ELSE '<image>' || text || '<image>y' END) AS aligned FROM documents""")
def _(spark, sf):
    t = _case(3, F.col("text"), F.concat(F.lit("x<image>"), "text"), F.concat(F.lit("<image>"), "text", F.lit("<image>y<image>")))
    return _docs(spark, sf).select("doc_id", F.md5(N.align_placeholders(t, F.lit(2))).alias("aligned"))


_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"


@query("loss_spans", f"""WITH w AS (SELECT conv_id, turn, role, {_WORDS} AS n FROM conversations)
SELECT conv_id, turn, CAST(sum(n) OVER c - n AS BIGINT) AS start, CAST(sum(n) OVER c AS BIGINT) AS "end",
  CAST(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS BIGINT) AS loss_mask
FROM w WINDOW c AS (PARTITION BY conv_id ORDER BY turn)""")
def _(spark, sf):
    d = R.loss_spans(V.messages(spark, sf))
    return d.select("conv_id", "turn", "start", "end", F.col("loss_mask").cast("long"))


@query("sft_masks", """WITH o AS (SELECT p_partkey, p_size % 7 AS p, p_size % 5 + 1 AS r FROM part)
SELECT p_partkey, array_to_string(list_transform(range(0, 12), lambda i: CASE WHEN i = least(p + r, 12) - 1 THEN 0
  WHEN p > 1 AND i < p - 1 THEN 0 WHEN i < p + r THEN 1 ELSE 0 END), '') AS mask FROM o""")
def _(spark, sf):
    p, r = F.col("p_size") % 7, F.col("p_size") % 5 + 1
    att = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when(i < p + r, 1).otherwise(0))
    mask = N.sft_mask(att, p, r)
    return V.table(spark, sf, "part").select("p_partkey", as_text(F.transform(mask, lambda x: x.cast("string")), "").alias("mask"))


@query("concat_for_rm", """WITH w AS (SELECT doc_id, string_split(text, ' ') AS p, [source, lang] AS c, [lang] AS r FROM documents),
j AS (SELECT doc_id, list_concat(p, c)[:8] AS c, list_concat(p, r)[:8] AS r FROM w)
SELECT doc_id, array_to_string(list_resize(c, 8, ''), ' ') AS chosen, array_to_string(list_resize(r, 8, ''), ' ') AS rejected,
  CAST(len(c) AS BIGINT) AS n_chosen, CAST(len(r) AS BIGINT) AS n_rejected FROM j""")
def _(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.split("text", " ").alias("prompt"), F.array("source", "lang").alias("chosen"), F.array("lang").alias("rejected"))
    d = R.concat_for_rm(d, 8)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("doc_id", as_text("chosen_ids", " ").alias("chosen"), as_text("rejected_ids", " ").alias("rejected"),
                    total("chosen_mask").alias("n_chosen"), total("rejected_mask").alias("n_rejected"))


_CUT = "CASE WHEN length({0}) > {1} THEN rtrim(left({0}, {1} - 3)) || '...' ELSE {0} END"
_SQ = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def _sec(c, n):
    return _CUT.format(_SQ.format(c), n)


@query("markdown_sections", f"""WITH p AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text || chr(10) || chr(10) || source, '\\n\\s*\\n'),
    lambda x: trim(x) <> ''))  AS body, generate_subscripts(list_filter(regexp_split_to_array(text || chr(10) || chr(10) || source, '\\n\\s*\\n'),
    lambda x: trim(x) <> ''), 1) AS i FROM documents WHERE doc_id % 2 = 1)
SELECT doc_id, CAST(i AS BIGINT) AS ord, printf('Memory %02d', i) AS title, {_sec('body', 10**9)} AS principle FROM p
UNION ALL SELECT doc_id, 1, 'T one', {_sec('text', 10**9)} FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 2, 'T two', {_sec("text || '!'", 10**9)} FROM documents WHERE doc_id % 2 = 0""")
def _(spark, sf):
    md = _case(2, F.concat(F.lit("# T  one \n"), "text", F.lit("\n### none\n\n## T two\n"), "text", F.lit("!")),
               F.concat("text", F.lit("\n\n"), "source"))
    return R.markdown_sections(_docs(spark, sf).select("doc_id", md.alias("text")))


@query("collapse_generations", f"""WITH {STEPS_SQL}, k AS (SELECT * FROM steps WHERE NOT (won AND anchor_obs = 'AF'))
SELECT traj_uid, count(*) AS num_steps, min(step) AS first_step, max(step) AS last_step,
  string_agg(anchor_obs, '|' ORDER BY step) AS outputs FROM k GROUP BY traj_uid""")
def _(spark, sf):
    s = V.steps(spark, sf)
    out = F.when(F.col("anchor_obs") == "AF", "").otherwise(F.col("anchor_obs"))
    d = s.select("traj_uid", "step", F.col("won").alias("finished"), out.alias("output"), F.col("anchor_obs").alias("obs"))
    g = R.collapse_generations(d)
    return g.select("traj_uid", "num_steps", F.col("first.step").alias("first_step"), F.col("last.step").alias("last_step"),
                    as_text(F.transform("steps", lambda x: x["obs"])).alias("outputs"))
