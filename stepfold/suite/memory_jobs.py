"""Queries over joins, similarity search, skill banks and experience libraries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stepfold.operators import joins as J
from stepfold.operators import memory as M
from stepfold.operators import ordered as N
from stepfold.operators import postings as P
from stepfold.operators import similarity as X
from stepfold.plans import views as V
from stepfold.plans.views import ROLLOUTS_SQL, SAMPLES_SQL, SKILLS_SQL
from stepfold.suite.registry import as_text, q6, query, r6

_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_DOT = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("sample_lookup", """WITH s AS (SELECT doc_id % 400 AS id, source AS b, doc_id AS ord FROM documents),
k AS (SELECT CAST(id AS VARCHAR) AS key, b, ord FROM s UNION ALL SELECT b || '_' || id, b, ord FROM s)
SELECT key, arg_min(b, ord) AS benchmark_name, min(ord) AS ord FROM k GROUP BY key""")
def _(spark, sf):
    d = V.table(spark, sf, "documents").select(
        (F.col("doc_id") % 400).cast("string").alias("doc_id"), F.col("source").alias("benchmark_name"), F.col("doc_id").alias("ord"))
    return J.sample_lookup(d).select("key", "benchmark_name", "ord")


@query("infer_benchmark", f"""WITH {ROLLOUTS_SQL}, r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'own' END AS own,
  CASE WHEN event_id % 3 = 0 THEN 'srcx_' || sample_id ELSE sample_id END AS sample_id FROM rollouts),
l AS (SELECT CAST(doc_id AS VARCHAR) AS key, source AS b FROM documents WHERE lang = 'en'), s AS (SELECT CAST(doc_id AS VARCHAR) AS key, lang AS b FROM documents)
SELECT event_id, coalesce(own, l.b, s.b, CASE WHEN starts_with(sample_id, 'srcx') THEN 'srcx' END, 'unknown') AS benchmark
FROM r LEFT JOIN l ON sample_id = l.key LEFT JOIN s ON sample_id = s.key""")
def _(spark, sf):
    r = V.rollouts(spark, sf).select(
        "event_id", F.when(F.col("event_id") % 7 == 0, "own").alias("benchmark"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("srcx_"), "sample_id")).otherwise(F.col("sample_id")).alias("sample_id"))
    d = V.table(spark, sf, "documents").withColumn("key", F.col("doc_id").cast("string"))
    table = d.where("lang = 'en'").select("key", F.col("source").alias("benchmark_name"))
    side = d.select(F.col("key").alias("sample_id"), F.col("lang").alias("benchmark_name"))
    return J.infer_benchmark(r, table, side, ["srcx", "srcy"]).select("event_id", "benchmark")


@query("expected_vs_actual", """WITH a AS (SELECT source AS b, count(*) AS n FROM documents GROUP BY 1),
o AS (SELECT CASE WHEN quality = 1 THEN source ELSE 'extra' END AS b, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT coalesce(a.b, o.b) AS benchmark, coalesce(a.n, 0) AS expected, coalesce(o.n, 0) AS output, greatest(coalesce(a.n, 0) - coalesce(o.n, 0), 0) AS missing
FROM a FULL JOIN o ON a.b = o.b""")
def _(spark, sf):
    d = V.table(spark, sf, "documents").withColumnRenamed("source", "benchmark")
    o = d.join(V.table(spark, sf, "labels"), "doc_id").withColumn("benchmark", F.when(F.col("quality") == 1, F.col("benchmark")).otherwise("extra"))
    return J.expected_vs_actual(d, o)


@query("select_by_membership", """WITH m AS (SELECT l_partkey AS k, bool_or(l_returnflag = 'R') AS i, bool_or(l_returnflag <> 'R') AS o FROM lineitem GROUP BY 1)
SELECT p_partkey, CASE WHEN i IS NULL THEN 'unknown_id' WHEN NOT i THEN 'not_target' WHEN o THEN 'ambiguous_id' ELSE '' END AS reason
FROM part LEFT JOIN m ON p_partkey = k""")
def _(spark, sf):
    out = V.table(spark, sf, "part").select("p_partkey", F.col("p_partkey").alias("sample_id"))
    s = V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("sample_id"), F.col("l_returnflag").alias("benchmark"))
    return J.select_by_membership(out, s, ["R"]).select("p_partkey", "reason")


@query("merge_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    return J.merge_columns(o.select("o_orderkey", "o_custkey", "o_orderstatus"), o.select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_orderkey"])


@query("catalog_join", """WITH a AS (SELECT l_partkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS a FROM lineitem WHERE l_discount > 0.08 GROUP BY 1),
r AS (SELECT l_partkey, max(l_quantity) AS r FROM lineitem WHERE l_tax > 0.07 GROUP BY 1)
SELECT p_partkey, coalesce(a, 'DUMMY_ATTR') AS attributes, r AS review FROM part LEFT JOIN a ON p_partkey = a.l_partkey LEFT JOIN r ON p_partkey = r.l_partkey""")
def _(spark, sf):
    p, li = V.table(spark, sf, "part"), V.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "asin")
    a = li.where("l_discount > 0.08").groupBy("asin").agg(F.array_sort(F.collect_set("l_returnflag")).alias("attributes"))
    r = li.where("l_tax > 0.07").groupBy("asin").agg(F.max("l_quantity").alias("review"))
    d = J.catalog_join(p.select(F.col("p_partkey").alias("asin")), a, r)
    return d.select(F.col("asin").alias("p_partkey"), as_text("attributes").alias("attributes"), "review")


def _topk_sql(part, extra, k, metric=_COS, where=""):
    return f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id{extra}, {metric} AS sim FROM embeddings a, embeddings b {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id{part} ORDER BY sim DESC, item_id) AS rn FROM s WHERE sim >= 0.1)
SELECT query_id, item_id, {q6('sim')} AS sim, rn FROM r WHERE rn <= {k}"""


@query("cosine_topk", _topk_sql("", "", 5, where="WHERE a.vec_id <> b.vec_id"))
def _(spark, sf):
    e = V.items(spark, sf)
    d = X.similarity_topk(e, e, 5, min_sim=0.1, exclude_self=True)
    return d.select("query_id", "item_id", r6("sim").alias("sim"), F.col("rn").cast("long"))


@query("cosine_topk_by_kind", _topk_sql(", kind", ", b.label AS kind", 2))
def _(spark, sf):
    e = V.items(spark, sf)
    d = X.similarity_topk(e, e, 2, min_sim=0.1, by_kind=True)
    return d.select("query_id", "item_id", r6("sim").alias("sim"), F.col("rn").cast("long"))


@query("retrieve_embedding", _topk_sql(", kind", ", b.label // 5 AS kind", 6))
def _(spark, sf):
    e = V.items(spark, sf)
    d = M.retrieve_embedding(e, e.withColumn("kind", F.floor(F.col("kind") / 5)), 6, 0.1)
    return d.select("query_id", "item_id", r6("sim").alias("sim"), F.col("rn").cast("long"))


@query("cosine_pairs", f"""WITH e AS (SELECT min(vec_id) AS id, embedding FROM embeddings GROUP BY embedding)
SELECT a.id AS a, b.id AS b, {q6(_COS)} AS sim FROM e a JOIN e b ON a.id < b.id AND {_COS} >= 0.25
UNION ALL SELECT e.id, v.vec_id, 1.0 FROM embeddings v JOIN e ON v.embedding = e.embedding AND v.vec_id <> e.id""")
def _(spark, sf):
    return X.similar_pairs(V.items(spark, sf), 0.25).select("a", "b", r6("sim").alias("sim"))


@query("dense_batch_topk", f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, b.label AS kind, {_DOT} AS sim FROM embeddings a, embeddings b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rn FROM s)
SELECT query_id, item_id, kind, {q6('sim')} AS sim, rn FROM r WHERE rn <= 3""")
def _(spark, sf):
    e = V.items(spark, sf)
    d = X.dense_batch_topk(e, e, 3, ["kind"])
    return d.select("query_id", "item_id", "kind", r6("sim").alias("sim"), F.col("rn").cast("long"))


def bm25_sql(queries: str, docs: str, k: int) -> str:
    split = r"list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda t: t <> '')"
    return f"""q AS (SELECT DISTINCT query_id, unnest({split}) AS term FROM ({queries})),
d AS (SELECT doc_id, {split} AS t FROM ({docs})), st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avg FROM d),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * len / avg))) AS score
  FROM q JOIN tf USING (term) JOIN dfs USING (term), st GROUP BY query_id, doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rn FROM sc)
SELECT query_id, doc_id, {q6('score')} AS score, rn FROM rk WHERE rn <= {k}"""


@query("bm25_topk", "WITH " + bm25_sql("SELECT item_id AS query_id, text FROM benchmark", "SELECT doc_id, text FROM documents", 5))
def _(spark, sf):
    q = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    d = P.bm25_topk(q, V.table(spark, sf, "documents").select("doc_id", "text"), 5, digits=9)
    return d.select("query_id", "doc_id", r6("score").alias("score"), F.col("rn").cast("long"))


# ---- skill bank ---------------------------------------------------------------------------

_BANK_SQL = f"""{SKILLS_SQL}, cat AS (SELECT *, CASE WHEN lang = 'de' THEN 'europe' WHEN lang = 'en' THEN 'asia'
  WHEN contains(lower(problem), 'asia') THEN 'asia' WHEN contains(lower(problem), 'europe') THEN 'europe' ELSE 'asia' END AS task_type FROM samples),
gd AS (SELECT count(*) AS n FROM skills WHERE kind = 'general' AND skill_id LIKE 'dyn%'),
g AS (SELECT skill_id, title, principle, ord, CASE WHEN skill_id LIKE 'dyn%' THEN 0 ELSE 1 END AS s,
  row_number() OVER (PARTITION BY skill_id LIKE 'dyn%' ORDER BY ord) AS rn FROM skills WHERE kind = 'general'),
gk AS (SELECT * FROM g, gd WHERE s = 0 OR rn <= greatest(7 - n, 0)),
mk AS (SELECT *, row_number() OVER (ORDER BY ord) AS rn FROM skills WHERE kind = 'mistake')"""


def _samples(spark, sf):
    return V.samples(spark, sf).withColumn("category", F.when(F.col("lang") == "de", "Europe!").when(F.col("lang") == "en", "asia").otherwise(F.col("lang")))


@query("resolve_category", f"WITH {SAMPLES_SQL}, {_BANK_SQL} SELECT ord, task_type FROM cat")
def _(spark, sf):
    d = M.resolve_category(_samples(spark, sf), V.skills(spark, sf), fields=["task", "category"])
    return d.select("ord", "task_type")


@query("retrieve_template", f"""WITH {SAMPLES_SQL}, {_BANK_SQL}
SELECT ord, (SELECT string_agg(skill_id, '|' ORDER BY s, ord) FROM gk) AS general,
  CASE task_type WHEN 'asia' THEN (SELECT string_agg(skill_id, '|' ORDER BY ord) FROM skills WHERE category = 'asia')
    ELSE (SELECT string_agg(skill_id, '|' ORDER BY ord) FROM skills WHERE category = 'europe') END AS task_skills,
  (SELECT string_agg(skill_id, '|' ORDER BY rn) FROM mk WHERE rn <= 5) AS mistakes FROM cat""")
def _(spark, sf):
    s = V.skills(spark, sf)
    d = M.retrieve_template(M.resolve_category(_samples(spark, sf), s, fields=["category"]), s, 7)
    ids = lambda c: as_text(F.transform(c, lambda x: x["skill_id"]))
    return d.select("ord", ids("general").alias("general"), ids("task_skills").alias("task_skills"), ids("mistakes").alias("mistakes"))


_NL = "chr(10)"


@query("inject_skills", f"""WITH {SAMPLES_SQL}, {_BANK_SQL}, t AS (SELECT category, string_agg('- **' || title || '**: ' || principle ||
  CASE WHEN when_to_apply <> '' THEN {_NL} || '  _Apply when: ' || when_to_apply || '_' ELSE '' END, {_NL} ORDER BY ord) AS t FROM skills WHERE kind = 'task' GROUP BY category)
SELECT ord, task_type, '### General Principles' || {_NL} || (SELECT string_agg('- **' || title || '**: ' || principle, {_NL} ORDER BY s, ord) FROM gk) || {_NL} || {_NL} ||
  '### ' || CASE task_type WHEN 'asia' THEN 'Asia' ELSE 'Europe' END || ' Skills' || {_NL} || t || {_NL} || {_NL} || '### Mistakes to Avoid' || {_NL} ||
  (SELECT string_agg('- **Don''t**: ' || description || CASE WHEN how_to_avoid <> '' THEN {_NL} || '  **Instead**: ' || how_to_avoid ELSE '' END, {_NL} ORDER BY rn) FROM mk WHERE rn <= 5) AS skill_text
FROM cat JOIN t ON task_type = t.category""")
def _(spark, sf):
    d = M.inject_skills(_samples(spark, sf), V.skills(spark, sf), k=7, fields=["category"])
    return d.select("ord", "task_type", "skill_text")


@query("skill_texts", """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || '. ' || p_type ELSE p_name || '. ' || p_brand || '. ' || p_type END AS text FROM part""")
def _(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"), F.when(F.col("p_size") <= 25, F.col("p_brand")).otherwise(" ").alias("principle"), F.col("p_type").alias("when_to_apply"))
    return p.select("p_partkey", M.skill_text(p).alias("text"))


def _part_skills(spark, sf):
    p = V.table(spark, sf, "part")
    return p.select(F.concat(F.lit("s_"), F.col("p_size").cast("string")).alias("skill_id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("ord"))


@query("add_skills", """WITH b AS (SELECT DISTINCT 's_' || s_nationkey AS skill_id FROM supplier), n AS (SELECT 's_' || p_size AS skill_id, p_name AS title, p_partkey AS ord FROM part)
SELECT skill_id, 'bank' AS title FROM b UNION ALL SELECT skill_id, arg_min(title, ord) FROM n WHERE skill_id NOT IN (SELECT skill_id FROM b) GROUP BY skill_id""")
def _(spark, sf):
    b = V.table(spark, sf, "supplier").select(F.concat(F.lit("s_"), F.col("s_nationkey").cast("string")).alias("skill_id")).distinct()
    return M.add_skills(b.withColumn("title", F.lit("bank")), _part_skills(spark, sf)).select("skill_id", "title")


@query("remove_skill", "SELECT count(*) AS n FROM part WHERE p_size <> 7")
def _(spark, sf):
    return M.remove_skill(_part_skills(spark, sf), "s_7").agg(F.count(F.lit(1)).alias("n"))


@query("next_dyn_ids", f"""WITH {SKILLS_SQL}, m AS (SELECT max(CAST(skill_id[5:] AS BIGINT)) AS m FROM skills WHERE skill_id LIKE 'dyn_%'),
n AS (SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn FROM part)
SELECT 'dyn_' || lpad(CAST(m + rn AS VARCHAR), 3, '0') AS skill_id, p_name AS title FROM n, m WHERE rn <= 4""")
def _(spark, sf):
    return M.next_dyn_ids(_part_skills(spark, sf), V.skills(spark, sf), 4).select("skill_id", "title")


_FAIL_SQL = """f AS (SELECT conv_id, max(turn) AS t, count(*) FILTER (role = 'user') AS u FROM conversations GROUP BY conv_id),
z AS (SELECT conv_id, CASE WHEN t % 2 = 0 THEN 'even' ELSE 'odd' END AS task_type, CASE WHEN u > 2 THEN 1.0 ELSE 0.0 END AS score FROM f)"""


def _episodes(spark, sf):
    g = V.messages(spark, sf).groupBy("conv_id").agg(F.max("turn").alias("t"), F.count_if(F.col("role") == "user").alias("u"))
    return g.select("conv_id", F.when(F.col("t") % 2 == 0, "even").otherwise("odd").alias("task_type"), F.when(F.col("u") > 2, 1.0).otherwise(0.0).alias("score"))


@query("update_trigger", f"""WITH {_FAIL_SQL}, l AS (SELECT string_agg(task_type, ',' ORDER BY task_type) AS l FROM (SELECT task_type, avg(score) AS r FROM z GROUP BY 1) WHERE r < 0.9)
SELECT conv_id, task_type, l AS low_success_tasks, 'train' AS target_split FROM z, l WHERE score <= 0 AND l IS NOT NULL ORDER BY conv_id LIMIT 10""")
def _(spark, sf):
    d = M.update_trigger(_episodes(spark, sf), 0.9, order="conv_id")
    return d.select("conv_id", "task_type", "low_success_tasks", "target_split")


@query("failure_context", f"""WITH {_FAIL_SQL}, {SKILLS_SQL}, p AS (SELECT conv_id FROM z WHERE score <= 0 ORDER BY conv_id LIMIT 5),
s AS (SELECT c.conv_id, turn, role, text, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn DESC) AS rn FROM conversations c JOIN p USING (conv_id))
SELECT conv_id, string_agg('  Action: ' || role || chr(10) || '  Observation: ' || left(text, 200), chr(10) ORDER BY turn) AS trajectory,
  (SELECT string_agg(CASE WHEN kind = 'task' THEN '[' || category || '] ' || title ELSE title END, '; ' ORDER BY kind, ord) FROM skills WHERE kind <> 'mistake') AS existing_titles
FROM s WHERE rn <= 5 GROUP BY conv_id""")
def _(spark, sf):
    failed = _episodes(spark, sf).where("score <= 0")
    steps = V.messages(spark, sf).select("conv_id", F.col("turn").alias("step"), F.col("role").alias("action"), F.col("text").alias("observation"))
    d = M.failure_context(failed, steps, V.skills(spark, sf), traj="conv_id", order="conv_id")
    return d.select("conv_id", "trajectory", "existing_titles")


# ---- experience library -------------------------------------------------------------------


@query("retrieve_multi", f"""WITH s AS (SELECT a.vec_id // 4 AS task_id, a.vec_id % 4 AS ord, b.vec_id AS item_id, a.vec_id AS q, {_COS} AS sim FROM embeddings a, embeddings b),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, item_id) AS rn FROM s WHERE sim >= 0.1),
f AS (SELECT *, row_number() OVER (PARTITION BY task_id, item_id ORDER BY ord, rn) AS f FROM r WHERE rn <= 4)
SELECT task_id, item_id, ord, rn FROM f WHERE f = 1""")
def _(spark, sf):
    e = V.items(spark, sf)
    sub = e.select(F.floor(F.col("id") / 4).alias("task_id"), (F.col("id") % 4).alias("ord"), "id", "embedding")
    return M.retrieve_multi(sub, e, 4, 0.1).select("task_id", "item_id", "ord", F.col("rn").cast("long"))


@query("retrieval_diagnostics", f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {_COS} AS sim FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rn FROM s WHERE sim >= 0.33),
g AS (SELECT query_id, count(*) AS hits, string_agg(printf('%.4f', round(sim, 4)), ',' ORDER BY rn) FILTER (rn <= 5) AS top_scores FROM r WHERE rn <= 8 GROUP BY query_id)
SELECT vec_id AS query_id, coalesce(hits, 0) AS hits, coalesce(top_scores, '') AS top_scores FROM embeddings LEFT JOIN g ON vec_id = query_id""")
def _(spark, sf):
    e = V.items(spark, sf)
    return M.retrieval_diagnostics(X.similarity_topk(e, e, 8, min_sim=0.33, exclude_self=True), e)


def _ops(spark, sf):
    e = V.items(spark, sf)
    ops = e.where("kind >= 8").select(F.col("id").alias("op_id"), F.when(F.col("id") % 3 == 0, "modify").otherwise("add").alias("option"),
                                      F.when(F.col("id") % 3 == 0, F.col("id") - 1).alias("modified_from"), "embedding")
    return e.where("kind < 8"), ops


@query("merge_candidates", f"""WITH ex AS (SELECT * FROM embeddings WHERE label < 8), o AS (SELECT vec_id AS op_id, vec_id % 3 = 0 AND vec_id - 1 IN (SELECT vec_id FROM ex) AS rep, embedding FROM embeddings WHERE label >= 8),
s AS (SELECT a.op_id, b.vec_id AS item_id, {_COS} AS sim FROM o a, ex b WHERE NOT a.rep), r AS (SELECT *, row_number() OVER (PARTITION BY op_id ORDER BY sim DESC, item_id) AS rn FROM s WHERE sim >= 0.3)
SELECT op_id, 'merge' AS action, item_id, {q6('sim')} AS sim FROM r WHERE rn <= 10
UNION ALL SELECT op_id, 'replace', op_id - 1, NULL FROM o WHERE rep
UNION ALL SELECT op_id, 'add', NULL, NULL FROM o WHERE NOT rep AND op_id NOT IN (SELECT op_id FROM r)""")
def _(spark, sf):
    return M.merge_candidates(*_ops(spark, sf), 0.3).withColumn("sim", r6("sim"))


@query("plan_merges", f"""WITH RECURSIVE ex AS (SELECT * FROM embeddings WHERE label < 8),
o AS (SELECT vec_id AS op_id, embedding FROM embeddings WHERE label >= 8 AND NOT (vec_id % 3 = 0 AND vec_id - 1 IN (SELECT vec_id FROM ex))),
s AS (SELECT a.op_id, b.vec_id AS item_id, {_COS} AS sim FROM o a, ex b),
r AS (SELECT *, row_number() OVER (PARTITION BY op_id ORDER BY sim DESC, item_id) AS rn FROM s WHERE sim >= 0.3),
e AS (SELECT 'op:' || op_id AS x, 'item:' || item_id AS y FROM r WHERE rn <= 10 UNION ALL SELECT 'op:' || a.op_id, 'op:' || b.op_id FROM o a JOIN o b ON a.op_id < b.op_id AND {_COS} >= 0.3),
n AS (SELECT x, y FROM e UNION SELECT y, x FROM e UNION SELECT x, x FROM e UNION SELECT y, y FROM e),
reach AS (SELECT x, y FROM n UNION SELECT reach.x, n.y FROM reach JOIN n ON reach.y = n.x)
SELECT x AS node, min(y) AS component FROM reach GROUP BY x""")
def _(spark, sf):
    return M.plan_merges(*_ops(spark, sf), 0.3)


@query("ordered_merges")
def _(spark, sf):
    plan = N.plan_ordered_merges(*_ops(spark, sf), 0.3)
    return plan.select("op_id", "action", "node", as_text("taken").alias("taken"))


@query("ordered_merge_library")
def _(spark, sf):
    existing, ops = _ops(spark, sf)
    text = lambda d, c: d.withColumn("text", F.concat(F.lit("t"), F.col(c).cast("string")))
    plan = N.plan_ordered_merges(existing, ops, 0.3)
    return N.apply_ordered_merges(text(existing, "id"), text(ops, "op_id"), plan).select("id", "text")


@query("reduce_to_limit")
def _(spark, sf):
    lib = V.items(spark, sf).select(F.col("id").alias("exp_no"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), "embedding")
    return M.reduce_to_limit(lib, 480, 0.2).select("exp_no", "text")


@query("reduce_to_limit_round", f"""WITH RECURSIVE n AS (SELECT count(*) - 480 AS over, max(vec_id) AS top FROM embeddings),
reps AS (SELECT min(vec_id) AS id, embedding FROM embeddings GROUP BY embedding),
same AS (SELECT vec_id, r.id, row_number() OVER (PARTITION BY r.id ORDER BY vec_id) AS rn FROM embeddings e JOIN reps r ON e.embedding = r.embedding),
p AS (SELECT a.id AS a, b.id AS b, {_COS} AS sim FROM reps a JOIN reps b ON a.id < b.id AND {_COS} >= 0.2
  UNION SELECT id, vec_id, 1.0 FROM same WHERE vec_id <> id
  UNION SELECT x.vec_id, y.vec_id, 1.0 FROM same x JOIN same y ON x.id = y.id AND x.rn % 2 = 1 AND y.rn = x.rn + 1 WHERE x.vec_id <> x.id),
best AS (SELECT a, b, sim, row_number() OVER (ORDER BY sim DESC, a, b) AS rn FROM p QUALIFY rn <= (SELECT over FROM n)),
g AS (SELECT 0 AS i, []::BIGINT[] AS used, []::BIGINT[] AS won UNION ALL
  SELECT i + 1, CASE WHEN list_contains(used, a) OR list_contains(used, b) THEN used ELSE list_concat(used, [a, b]) END,
    CASE WHEN list_contains(used, a) OR list_contains(used, b) THEN won ELSE list_append(won, rn) END FROM g JOIN best ON rn = i + 1),
last AS (SELECT used, won FROM g ORDER BY i DESC LIMIT 1)
SELECT vec_id AS exp_no, 't' || vec_id AS text FROM embeddings, last WHERE NOT list_contains(used, vec_id)
UNION ALL SELECT (SELECT top FROM n) + row_number() OVER (ORDER BY sim DESC, a, b), 't' || a || chr(10) || chr(10) || 't' || b FROM best, last WHERE list_contains(won, rn)""")
def _(spark, sf):
    lib = V.items(spark, sf).select(F.col("id").alias("exp_no"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), "embedding")
    return M.reduce_to_limit(lib, 480, 0.2, rounds=1).select("exp_no", "text")


@query("apply_refine_ops", """WITH l AS (SELECT p_partkey AS no, p_name AS text FROM part),
ops AS (SELECT s_suppkey AS op_no, CASE WHEN s_suppkey % 3 = 0 THEN 'delete' ELSE 'merge' END AS option, s_suppkey * 2 AS a, s_suppkey * 2 + 1 AS b, s_name AS text FROM supplier),
e AS (SELECT op_no, option, text, a AS no FROM ops UNION ALL SELECT op_no, option, text, b FROM ops WHERE option = 'merge'),
v AS (SELECT op_no, option, e.text AS text, count(*) AS n FROM e JOIN l USING (no) GROUP BY op_no, option, e.text), g AS (SELECT * FROM v WHERE option = 'delete' OR n >= 2),
f AS (SELECT no, text FROM l WHERE no NOT IN (SELECT no FROM e JOIN g USING (op_no)) UNION ALL SELECT (SELECT max(no) FROM l) + 1 + op_no, text FROM g WHERE option = 'merge')
SELECT 'E' || (row_number() OVER (ORDER BY no) - 1) AS exp_id, text FROM f""")
def _(spark, sf):
    lib = V.table(spark, sf, "part").select(F.concat(F.lit("E"), F.col("p_partkey").cast("string")).alias("exp_id"), F.col("p_name").alias("text"))
    k = F.col("s_suppkey")
    ids = F.array(F.concat(F.lit("E"), (k * 2).cast("string")), F.concat(F.lit("E"), (k * 2 + 1).cast("string")))
    ops = V.table(spark, sf, "supplier").select(k.alias("op_no"), F.when(k % 3 == 0, "delete").otherwise("merge").alias("option"),
                                                F.when(k % 3 == 0, F.slice(ids, 1, 1)).otherwise(ids).alias("ids"), F.col("s_name").alias("text"))
    return M.apply_refine_ops(lib, ops)


@query("renumber_by_string", "SELECT 'E' || (row_number() OVER (ORDER BY CAST(p_partkey AS VARCHAR)) - 1) AS exp_id, p_brand AS text FROM part")
def _(spark, sf):
    return M.renumber(V.table(spark, sf, "part").select(F.col("p_partkey").alias("exp_no"), F.col("p_brand").alias("text")), order="string")


@query("used_experiences", """WITH w AS (SELECT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)
SELECT o AS sample_id, p AS exp_id FROM a WHERE (o, p) IN (SELECT o, p FROM w) OR o NOT IN (SELECT o FROM w)""")
def _(spark, sf):
    li = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("exp_id"), "l_returnflag")
    # hardly a pair repeats: repeats are told by the order the join needs anyway, not by a table of a task's pairs
    same = Window.partitionBy("sample_id", "exp_id").orderBy("exp_id")
    pairs = li.select("sample_id", "exp_id", F.lag(F.lit(1)).over(same).alias("before")).where("before IS NULL").drop("before")
    return M.used_experiences(pairs, li.where("l_returnflag = 'R'"))


_HOUSE = """CASE WHEN contains(g, 'look at') AND contains(g, 'under') THEN 'look_at_obj_in_light' WHEN contains(g, 'clean') THEN 'clean' WHEN contains(g, 'heat') THEN 'heat'
  WHEN contains(g, 'cool') THEN 'cool' WHEN contains(g, 'examine') OR contains(g, 'find') THEN 'examine' WHEN contains(g, 'put') THEN 'pick_and_place' END"""


@query("categorize_memories", f"""WITH m AS (SELECT lower(text) || CASE doc_id % 3 WHEN 0 THEN ' heat it' WHEN 1 THEN ' put it' ELSE '' END AS g, coalesce(quality, 0) AS q FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT {_HOUSE} AS category, q FROM m)
SELECT category, count(*) FILTER (q = 1) AS success, count(*) FILTER (q <> 1) AS failure FROM c WHERE category IS NOT NULL GROUP BY category""")
def _(spark, sf):
    return M.categorize_memories(_memories(spark, sf), "household")


def _memories(spark, sf):
    d = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id", "left")
    k = F.col("doc_id") % 3
    goal = F.concat("text", F.when(k == 0, " heat it").when(k == 1, " put it").otherwise(""))
    return d.select(F.col("doc_id").alias("ord"), goal.alias("goal"), F.when(F.coalesce("quality", F.lit(0)) == 1, "Success").otherwise("Other").alias("outcome"),
                    F.col("source").alias("data_source"), F.col("lang").alias("category"))


@query("pattern_digest", """WITH r AS (SELECT lang AS category, CASE WHEN coalesce(quality, 0) = 1 THEN 'Success' ELSE 'Other' END AS outcome, doc_id, source,
  row_number() OVER (PARTITION BY lang, coalesce(quality, 0) = 1 ORDER BY doc_id) AS rn FROM documents LEFT JOIN labels USING (doc_id))
SELECT category, outcome, string_agg('{"goal":"g' || doc_id || '","data_source":"' || source || '","steps":["a","b"],"planning_pattern":"","mistakes":["x","y","z"]}', '|' ORDER BY rn) AS patterns
FROM r WHERE rn <= 10 GROUP BY category, outcome""")
def _(spark, sf):
    lit = lambda *v: F.array(*[F.lit(x) for x in v])
    m = _memories(spark, sf).withColumns({"goal": F.concat(F.lit("g"), F.col("ord").cast("string")), "steps": lit("a", "b"),
                                          "planning_pattern": F.lit(None).cast("string"), "mistakes": lit("x", "y", "z", "w")})
    return M.pattern_digest(m).select("category", "outcome", as_text("patterns").alias("patterns"))


@query("trajectory_to_memory", """WITH f AS (SELECT conv_id, max(turn) AS t, count(*) AS n, count(DISTINCT role) AS d, count(*) FILTER (role = 'user') AS u FROM conversations GROUP BY conv_id)
SELECT conv_id, 'mem_' || sha256(CAST(conv_id AS VARCHAR))[:8] AS memory_id, CASE WHEN t % 2 = 0 THEN 'Success' ELSE 'Failure' END AS outcome,
  'Env task: goal' || CASE WHEN t % 2 = 0 THEN '. Solved successfully.' ELSE '. Failed.' END AS description, CASE WHEN t % 2 = 0 THEN n END AS steps,
  CASE WHEN t % 2 = 0 THEN CASE WHEN u > 0 THEN 'Use' ELSE 'Unknown pattern' END END AS pattern,
  CASE WHEN t % 2 = 0 THEN '' WHEN n <> d THEN 'Repeated the same action multiple times without making progress' ELSE 'Failed to complete task: goal. Consider different approach.' END AS mistakes FROM f""")
def _(spark, sf):
    from stepfold.plans.skew import group_values

    m = group_values(V.messages(spark, sf), ["conv_id"], t=F.max("turn"))
    m = m.select("conv_id", "turn", F.col("role").alias("action"), F.col("text").alias("observation"), F.lit("goal").alias("task"), (F.col("t") % 2 == 0).alias("success"))
    d = M.trajectory_to_memory(m, traj="conv_id", step="turn", environment="Env")
    return d.select("conv_id", "memory_id", "tags.outcome", F.col("contextual_description").alias("description"),
                    F.when(F.col("content.refined_trajectory").isNotNull(), F.size("content.refined_trajectory")).cast("long").alias("steps"),
                    F.col("content.strategic_guidelines.planning_pattern").alias("pattern"),
                    as_text("content.strategic_guidelines.mistakes_to_avoid").alias("mistakes"))


@query("retrieve_examples", f"""WITH m AS (SELECT *, label < 6 AS ok, 'pattern ' || label AS p, length('memory text ' || repeat('x', CAST(vec_id % 900 AS INTEGER))) // 4 AS cost FROM embeddings),
s AS (SELECT a.vec_id AS q, b.vec_id AS item_id, b.ok, b.p, b.cost, {_COS} AS sim FROM embeddings a, m b),
r AS (SELECT *, row_number() OVER (PARTITION BY q, ok ORDER BY sim DESC, item_id) AS rn FROM s WHERE sim >= 0.15),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, p ORDER BY rn) AS f FROM r WHERE ok AND rn <= 8) WHERE f = 1),
u AS (SELECT q, 'examples' AS section, rn, item_id, sim, sum(cost) OVER (PARTITION BY q ORDER BY rn) AS used, 1200 AS lim FROM r WHERE ok AND rn <= 8
  UNION ALL SELECT q, 'mistakes', rn, item_id, sim, sum(cost) OVER (PARTITION BY q ORDER BY rn), 300 FROM r WHERE NOT ok AND rn <= 4
  UNION ALL SELECT q, 'general', rn, item_id, sim, sum(length(p) // 4) OVER (PARTITION BY q ORDER BY rn), 500 FROM g)
SELECT q AS query_id, section, rn, item_id, {q6('sim')} AS sim FROM u WHERE used <= lim""")
def _(spark, sf):
    e = V.items(spark, sf)
    m = e.select("id", "embedding", (F.col("kind") < 6).alias("success"), F.concat(F.lit("pattern "), F.col("kind").cast("string")).alias("pattern"),
                 F.concat(F.lit("memory text "), F.repeat(F.lit("x"), (F.col("id") % 900).cast("int"))).alias("text"))
    d = M.retrieve_examples(e.select("id", "embedding"), m, k=8, min_sim=0.15)
    return d.select("query_id", "section", F.col("rn").cast("long"), "item_id", r6("sim").alias("sim"))


@query("ingest_skill_outputs", """SELECT doc_id AS out_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE 't' || doc_id END AS title, doc_id % 3 = 2 AS parse_error FROM documents""")
def _(spark, sf):
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    text = (F.when(k == 0, F.concat(F.lit('Sure: [{"title": "t'), i, F.lit('", "principle": "p"}, {"title": "only"}] ok')))
            .when(k == 1, F.concat(F.lit('```json\n[{"skill_id": "a", "title": "t'), i, F.lit('", "principle": "p", "when_to_apply": "w"}]\n```')))
            .otherwise(F.concat(F.lit("no list, just "), "text")))
    text = F.when(k == 2, F.regexp_replace(text, r"[\[\]]", "")).otherwise(text)
    d = M.ingest_skill_outputs(V.table(spark, sf, "documents").select(F.col("doc_id").alias("out_id"), text.alias("text")))
    return d.select("out_id", "title", "parse_error")


@query("ingest_experience_ops", """SELECT doc_id AS out_id, 1::BIGINT AS op_no, CASE doc_id % 3 WHEN 1 THEN 'modify' ELSE 'add' END AS option, 'use ' || source AS experience,
  CASE doc_id % 3 WHEN 1 THEN 'E4' END AS modified_from FROM documents
UNION ALL SELECT doc_id, 2, 'add', 'two', NULL FROM documents WHERE doc_id % 3 = 0""")
def _(spark, sf):
    k, s = F.col("doc_id") % 3, F.col("source")
    text = (F.when(k == 0, F.concat(F.lit('```json\n[{"option": "new", "tip": "use '), s, F.lit('"}, {"text": ""}, {"exp": "two"}, {"exp": "three"}]\n```')))
            .when(k == 1, F.concat(F.lit('{"operations": [{"action": "modify", "id": "E4", "content": "use '), s, F.lit('"}]}')))
            .otherwise(F.concat(F.lit('{"experience": "use '), s, F.lit('"}'))))
    d = M.ingest_experience_ops(V.table(spark, sf, "documents").select(F.col("doc_id").alias("out_id"), text.alias("text")))
    return d.select("out_id", F.col("op_no").cast("long"), "option", "experience", "modified_from")
