"""Queries over data-quality flags and the product catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.operators import catalog as K
from stepfold.operators import quality as Q
from stepfold.plans import views as V
from stepfold.plans.views import EVENT_LOG_SQL, PRODUCTS_SQL, ROLLOUTS_SQL
from stepfold.suite.memory_jobs import bm25_sql
from stepfold.suite.registry import q6, query, r6


@query("flag_error_scored", f"""WITH {ROLLOUTS_SQL} SELECT sample_id, min(event_id) AS path, 'error_scored' AS reason FROM rollouts
WHERE starts_with(lower(final_answer), 'error') AND accuracy_score >= 0 GROUP BY sample_id""")
def _(spark, sf):
    r = V.rollouts(spark, sf).withColumn("path", F.col("event_id"))
    return Q.flag_error_scored(r, 0.0).select("sample_id", "path", "reason")


@query("flag_text_patterns", """SELECT DISTINCT source AS sample_id, 'text_pattern' AS reason FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'copyright')""")
def _(spark, sf):
    d = V.table(spark, sf, "documents").withColumnRenamed("source", "sample_id")
    return Q.flag_text_patterns(d, ["License", "Copyright"])


_Q_SQL = """q AS (SELECT sample_id, rollout_id, coalesce(tool_name, CASE WHEN tool_error IS NOT NULL THEN 'web_search' END) = 'web_search' AS t,
  coalesce(contains(tool_error, 'HTTP 403') AND contains(tool_error, 'quota'), false) AS r FROM event_log)"""


def _tool_events(spark, sf):
    e = V.event_log(spark, sf)
    return e.withColumn("tool_name", F.coalesce("tool_name", F.when(F.col("tool_error").isNotNull(), "web_search")))


@query("flag_quota_403", f"""WITH {EVENT_LOG_SQL}, {_Q_SQL} SELECT sample_id, rollout_id, 'quota_403' AS reason FROM q GROUP BY sample_id, rollout_id HAVING bool_or(t AND r)""")
def _(spark, sf):
    return Q.flag_quota_403(_tool_events(spark, sf), ["web_search"])


@query("flag_quota_403_loose", f"""WITH {EVENT_LOG_SQL}, {_Q_SQL} SELECT sample_id, 'quota_403' AS reason FROM (SELECT event_log.sample_id, tool_name = 'visit' AS t,
  contains(tool_error, 'HTTP 403') AND contains(tool_error, 'quota') AS r FROM event_log) GROUP BY sample_id HAVING bool_or(t) AND bool_or(r)""")
def _(spark, sf):
    return Q.flag_quota_403(_tool_events(spark, sf), ["visit"], loose=True, keys=("sample_id",))


@query("flag_multi_doc", f"""WITH {EVENT_LOG_SQL} SELECT sample_id, rollout_id, count(doc_id) AS entries, count(DISTINCT doc_id) AS documents, 'multi_doc' AS reason FROM event_log
GROUP BY sample_id, rollout_id HAVING count(DISTINCT doc_id) > 1""")
def _(spark, sf):
    d = Q.flag_multi_doc(V.event_log(spark, sf), distinct=True)
    return d.select("sample_id", "rollout_id", "entries", "documents", "reason")


@query("flag_with_source", """SELECT doc_id, quality IS NOT NULL AS has_output FROM documents LEFT JOIN labels USING (doc_id) WHERE source = 'src3' AND lang <> 'fr'""")
def _(spark, sf):
    s = V.table(spark, sf, "documents").select("doc_id", F.col("source").alias("benchmark_name"), F.array(F.lit(" "), F.when(F.col("lang") != "fr", "http://x").otherwise("")).alias("source"))
    hit, miss = Q.flag_with_source(s, V.table(spark, sf, "labels"), "src3")
    return hit.select("doc_id", F.lit(True).alias("has_output")).unionByName(miss.select("doc_id", F.lit(False).alias("has_output")))


@query("quarantine", """WITH f AS (SELECT doc_id, string_agg(r, ',' ORDER BY r) AS reasons FROM (SELECT doc_id, 'toxic' AS r FROM labels WHERE toxic = 1 UNION SELECT doc_id, 'low' FROM labels WHERE quality = 0) GROUP BY doc_id)
SELECT doc_id, reasons FROM documents LEFT JOIN f USING (doc_id)""")
def _(spark, sf):
    lab = V.table(spark, sf, "labels")
    flags = lab.where("toxic = 1").select("doc_id", F.lit("toxic").alias("reason")).unionByName(lab.where("quality = 0").select("doc_id", F.lit("low").alias("reason")))
    clean, bad = Q.quarantine(V.table(spark, sf, "documents").select("doc_id"), flags, "doc_id")
    return clean.withColumn("reasons", F.lit(None).cast("string")).unionByName(bad)


@query("profile_samples", """WITH s AS (SELECT l_partkey AS id, CASE WHEN l_tax > 0.07 THEN ' ' WHEN l_tax > 0.05 THEN '<image> x' ELSE 'x' END AS p, CASE WHEN l_discount > 0.09 THEN NULL ELSE 'y' END AS s, l_quantity > 10 AS img FROM lineitem),
d AS (SELECT count(*) AS n FROM s GROUP BY id HAVING count(*) > 1)
SELECT count(*) AS rows, count(*) FILTER (NOT img) AS without_images, count(*) FILTER (trim(p) = '') AS empty_problem, count(*) FILTER (s IS NULL) AS empty_solution,
  count(*) FILTER (NOT img AND contains(p, '<image>')) AS placeholder_without_image, (SELECT count(*) FROM d) AS duplicate_ids, CAST((SELECT sum(n) FROM d) AS BIGINT) AS duplicate_rows FROM s""")
def _(spark, sf):
    t = F.col("l_tax")
    s = V.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("doc_id"), F.when(t > 0.07, " ").when(t > 0.05, "<image> x").otherwise("x").alias("problem"),
        F.when(F.col("l_discount") <= 0.09, "y").alias("solution"), F.when(F.col("l_quantity") > 10, F.array(F.lit("a.png"))).otherwise(F.array().cast("array<string>")).alias("images"))
    return Q.profile_samples(s)


@query("completion_status", f"""WITH {EVENT_LOG_SQL}, t AS (SELECT sample_id, rollout_id, count(*) FILTER (trim(text_output) <> '') AS turns, bool_or(doc_id = 'doc_1') AS completed FROM event_log GROUP BY 1, 2)
SELECT sample_id, count(*) FILTER (completed AND turns > 0) AS good_rollouts, count(*) FILTER (completed AND turns > 0) >= 2 AS complete FROM t GROUP BY sample_id""")
def _(spark, sf):
    from stepfold.operators.report import turn_tool_counts

    e = V.event_log(spark, sf)
    r = e.groupBy("sample_id", "rollout_id").agg(F.max(F.col("doc_id") == "doc_1").alias("completed"))
    return Q.completion_status(r, turn_tool_counts(e).select("sample_id", "rollout_id", "turns"), 2)


# ---- catalog ------------------------------------------------------------------------------


def _catalog(spark, sf):
    p = V.products(spark, sf)
    opts = F.create_map(F.lit("Size"), F.array(F.concat(F.lit(" "), F.col("size").cast("string"), F.lit("/L")), (F.col("size") + 1).cast("string")), F.lit("color"), F.array(F.upper(F.element_at("attributes", 1))))
    return p.withColumns({"options": opts, "small_description": F.concat(F.lit("Bullet "), "brand"), "full_description": F.lower("category"), "query": F.concat(F.lit(" "), "query")})


@query("clean_products", f"""WITH {PRODUCTS_SQL} SELECT asin, trim(lower(query)) AS query, upper(attributes[1]) = upper(attributes[1]) AS ok,
  size || ' | l' || ';' || (size + 1) AS sizes, attributes[1] AS color, 'Bullet ' || brand AS bullet FROM products""")
def _(spark, sf):
    c = _catalog(spark, sf)
    both = c.unionByName(c.withColumns({"name": F.lit("later"), "ord": F.col("ord") + 10_000_000})).withColumn("bullet_brand", F.col("brand"))
    d = K.clean_products(both)
    return d.select("asin", "query", (F.col("name") != "later").alias("ok"), F.array_join(F.col("options")["size"], ";").alias("sizes"),
                    F.array_join(F.col("options")["color"], ";").alias("color"), F.col("bullets")[0].alias("bullet"))


_DOC_SQL = "lower(name || ' ' || category || ' Bullet ' || brand || ' color: ' || attributes[1] || ', and size: ' || size || ' | l, ' || (size + 1))"


@query("product_documents", f"WITH {PRODUCTS_SQL} SELECT asin, {_DOC_SQL} AS contents FROM products")
def _(spark, sf):
    return K.product_documents(K.clean_products(_catalog(spark, sf)))


@query("assign_prices", f"""WITH {PRODUCTS_SQL} SELECT asin, {q6('''CASE size % 3 WHEN 0 THEN 100 WHEN 1 THEN price
  ELSE price + 50 * (CAST('0x' || md5('9:' || asin)[:8] AS BIGINT) / 4294967296.0) END''')} AS price FROM products""")
def _(spark, sf):
    k = F.col("size") % 3
    pricing = F.when(k == 0, F.array().cast("array<double>")).when(k == 1, F.array("price")).otherwise(F.array(F.col("price"), F.col("price") + 50))
    d = K.assign_prices(V.products(spark, sf).withColumn("pricing", pricing), 9)
    return d.select("asin", r6("price").alias("price"))


@query("attribute_index", f"WITH {PRODUCTS_SQL} SELECT DISTINCT unnest(attributes) AS attribute, asin FROM products")
def _(spark, sf):
    return K.attribute_index(V.products(spark, sf))


@query("facet_search", f"""WITH {PRODUCTS_SQL} SELECT asin FROM products WHERE list_contains(attributes, 'ring') AND category = 'small' AND query = 'SMALL'""")
def _(spark, sf):
    return K.facet_search(V.products(spark, sf), attribute="ring", category="small", query="SMALL").select("asin")


@query("keyword_search", f"""WITH {PRODUCTS_SQL}, docs AS (SELECT asin AS doc_id, {_DOC_SQL} AS text FROM products),
  qs AS (SELECT DISTINCT p_name || ' ' || p_type AS query_id, p_name || ' ' || p_type AS text FROM part), """ + bm25_sql("SELECT * FROM qs", "SELECT * FROM docs", 3))
def _(spark, sf):
    name = F.concat("p_name", F.lit(" "), "p_type")
    qs = V.table(spark, sf, "part").select(name.alias("query_id"), name.alias("text")).distinct()
    d = K.keyword_search(qs, K.product_documents(K.clean_products(_catalog(spark, sf))), 3)
    return d.select("query_id", "doc_id", r6("score").alias("score"), F.col("rn").cast("long"))


STOP_WORDS = ["the", "of", "and", "in", "on"]


def _tfidf_sql(n):
    toks = r"list_filter(regexp_extract_all(lower(text), '[\pL\pN_]+'), lambda w: length(w) > 1 AND w NOT IN ('the', 'of', 'and', 'in', 'on') AND NOT regexp_full_match(w, '0|[1-9]\d{0,2}'))"
    gram = "t" if n == 1 else "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"
    return f"""WITH k AS (SELECT doc_id, source AS category, {toks} AS t FROM documents), g AS (SELECT doc_id, category, unnest({gram}) AS term FROM k),
tf AS (SELECT doc_id, category, term, count(*) AS tf FROM g GROUP BY ALL), tm AS (SELECT category, term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY ALL),
kept AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY total DESC, term) AS r FROM tm), sz AS (SELECT source AS category, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT tf.doc_id, tf.category, tf.term, n, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN kept ON tf.category = kept.category AND tf.term = kept.term AND r <= 1000 JOIN sz ON tf.category = sz.category),
s AS (SELECT *, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS s FROM w), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, term) AS r FROM s)
SELECT category, term, count(*) AS products, {q6('count(*) / max(n)')} AS share FROM b WHERE r <= 5 GROUP BY category, term"""


def _tfidf(spark, sf, n):
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("asin"), F.col("source").alias("category"), "text")
    return K.tfidf_attributes(d, n, stop_words=STOP_WORDS, max_features=1000).withColumn("share", r6("share"))


@query("tfidf_unigrams", _tfidf_sql(1))
def _(spark, sf):
    return _tfidf(spark, sf, 1)


@query("tfidf_bigrams", _tfidf_sql(2))
def _(spark, sf):
    return _tfidf(spark, sf, 2)


def _goal_products(spark, sf):
    p = V.products(spark, sf)
    opts = F.create_map(F.lit("size"), F.array(F.col("size").cast("string"), (F.col("size") + 1).cast("string")), F.lit("color"), F.array(F.element_at("attributes", 1), F.lit("teal")))
    return p.withColumns({"options": opts, "instruction": F.concat(F.lit("find "), "name"), "price": F.col("size") * 25.0})


_GOAL_SQL = f"""{PRODUCTS_SQL}, o AS (SELECT *, unnest([attributes[1], 'teal']) AS c FROM products), oo AS (SELECT *, unnest([size, size + 1]) AS z FROM o),
pr AS (SELECT *, size * 25.0 AS gp, CAST(floor(size * 25.0 / 10) AS BIGINT) + 1 AS rung, [1, 2, 3, 2, 3, 3][CAST(floor(CAST('0x' || md5('0:' || asin)[:8] AS BIGINT) / 4294967296.0 * 6) AS BIGINT) + 1] AS u FROM oo),
go AS (SELECT *, 'color: ' || c AS oc, 'size: ' || z AS oz, CASE WHEN 99 - rung >= 1 THEN (rung + least(u, 99 - rung)) * 10.0::DOUBLE ELSE 1000000.0::DOUBLE END AS price_upper FROM pr),
ac AS (SELECT a, count(*) AS c FROM (SELECT unnest(attributes) AS a FROM go) GROUP BY a)"""


@query("synthesize_goals", f"""WITH {_GOAL_SQL}
SELECT asin || '|' || oc || '|' || oz AS goal_id, 'find ' || name || ' with ' || oc || ', and ' || oz || CASE WHEN price_upper < 1000000 THEN ', and price lower than ' || printf('%.2f', price_upper) || ' dollars' ELSE '' END AS goal_text,
  CAST(price_upper AS DOUBLE) AS price_upper, {q6('((SELECT 1 / c FROM ac WHERE a = attributes[1]) + (SELECT 1 / c FROM ac WHERE a = attributes[2])) / 2')} AS weight FROM go""")
def _(spark, sf):
    d = K.synthesize_goals(_goal_products(spark, sf))
    return d.select("goal_id", "goal_text", "price_upper", r6("weight").alias("weight"))


@query("purchase_reward", f"""WITH {PRODUCTS_SQL}, p AS (SELECT l_partkey, l_suppkey, CAST(l_quantity * 40 AS DOUBLE) AS price FROM lineitem),
j AS (SELECT g.category AS goal_category, p.price, g.size * 25.0 AS cap, g.attributes AS ga, b.attributes AS ba, g.size AS gz, b.size AS bz, g.query = b.query AS qm, g.brand = b.brand AS bm,
  len(list_intersect(list_distinct(g.attributes), list_distinct(b.attributes))) / len(list_distinct(g.attributes)) AS title, g.product_category AS gc, b.product_category AS bc, b.name AS bn
  FROM p JOIN products g ON g.ord = l_partkey JOIN products b ON b.ord = l_suppkey),
s AS (SELECT *, len(list_filter(ga, lambda x: list_contains(ba, x) OR contains(bn, x))) AS na, CASE WHEN gz = bz THEN 1 ELSE 0 END AS no, CASE WHEN price <= cap THEN 1 ELSE 0 END AS ok,
  len(list_intersect(list_distinct(string_split(gc, ' › ')), list_distinct(string_split(bc, ' › ')))) >= 2 AS cm FROM j),
r AS (SELECT *, CASE WHEN title = 0 THEN 0.0 WHEN title < 0.1 THEN 0.1 WHEN NOT (qm OR cm OR title > 0.2) THEN 0.5 ELSE 1.0 END AS rt FROM s)
SELECT goal_category, count(*) AS purchases, {q6('avg((na + no + ok) / (len(ga) + 2) * rt)')} AS mean_reward, {q6('avg(rt)')} AS mean_type FROM r GROUP BY goal_category""")
def _(spark, sf):
    p = V.products(spark, sf)
    size = F.array(F.concat(F.lit("n"), F.col("size").cast("string")))
    goals = p.select(F.col("ord").alias("goal_id"), F.col("category").alias("goal_category"), F.col("query").alias("goal_query"), F.col("product_category").alias("goal_product_category"),
                     F.col("name").alias("goal_name"), F.col("attributes").alias("goal_attributes"), size.alias("goal_options"), (F.col("size") * 25.0).alias("price_upper"))
    bought = p.select(F.col("ord").alias("product_id"), "query", "product_category", "name", "attributes", size.alias("options"), F.col("name").alias("full_text"))
    li = V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("goal_id"), F.col("l_suppkey").alias("product_id"), (F.col("l_quantity") * 40).alias("price"))
    d = K.purchase_reward(li, goals, bought)
    return d.groupBy("goal_category").agg(F.count(F.lit(1)).alias("purchases"), r6(F.avg("reward")).alias("mean_reward"), r6(F.avg("r_type")).alias("mean_type"))
