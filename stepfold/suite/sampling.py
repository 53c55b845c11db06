"""Queries over splits, mixes, row algebra and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.operators import sample as S
from stepfold.plans import views as V
from stepfold.plans.views import RESPONSES_SQL, STEPS_SQL
from stepfold.suite.registry import as_text, q6, query, r6


@query("stable_shuffle", """SELECT doc_id, row_number() OVER (ORDER BY md5('42:all:' || doc_id), doc_id) AS position FROM documents""")
def _(spark, sf):
    return S.stable_shuffle(V.table(spark, sf, "documents"), 42, "all").select("doc_id", "position")


@query("strata_candidates", """WITH a AS (SELECT count(*) AS n FROM documents GROUP BY source, lang), b AS (SELECT count(*) AS n FROM documents GROUP BY lang)
SELECT 0::BIGINT AS ord, 'source,lang' AS keys, count(*) AS labels, min(n) AS smallest FROM a UNION ALL SELECT 1, 'lang', count(*), min(n) FROM b""")
def _(spark, sf):
    d = S.strata_candidates(V.table(spark, sf, "documents"), [["source", "lang"], ["lang"]])
    return d.withColumn("ord", F.col("ord").cast("long"))


@query("stratified_split", """WITH c AS (SELECT doc_id, source || '||' || lang AS label, count(*) OVER (PARTITION BY source, lang) AS n,
  row_number() OVER (PARTITION BY source, lang ORDER BY md5('42:' || source || '||' || lang || ':' || doc_id), doc_id) AS rn FROM documents)
SELECT doc_id, label, CASE WHEN rn <= greatest(1, least(CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT), n - 1)) THEN 'test' ELSE 'train' END AS split FROM c""")
def _(spark, sf):
    d = S.stratified_split(V.table(spark, sf, "documents"), ["source", "lang"])
    return d.select("doc_id", "label", "split")


@query("split_manifest", """WITH c AS (SELECT row_number() OVER (ORDER BY md5('42:all:' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents)
SELECT 'all' AS label, count(*) AS "all", count(*) FILTER (rn > CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT)) AS train,
  count(*) FILTER (rn <= CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT)) AS test FROM c""")
def _(spark, sf):
    keys = S.choose_strata(V.table(spark, sf, "documents"), [["doc_id"]])
    return S.split_manifest(S.stratified_split(V.table(spark, sf, "documents"), keys), "label")


@query("global_val_split", """WITH z AS (SELECT source, count(*) AS n, floor(count(*) * 0.05::DOUBLE) AS base, count(*) * 0.05::DOUBLE - floor(count(*) * 0.05::DOUBLE) AS rem FROM documents GROUP BY source),
t AS (SELECT greatest(1, CAST(round_even(sum(n) * 0.05::DOUBLE, 0) AS BIGINT)) - sum(base) AS spare FROM z),
k AS (SELECT source, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, source DESC) <= (SELECT spare FROM t) THEN 1 ELSE 0 END AS take FROM z),
r AS (SELECT doc_id, d.source, take, row_number() OVER (PARTITION BY d.source ORDER BY md5('42:global-val:' || d.source || ':' || doc_id), doc_id) AS rn
  FROM documents d JOIN k ON d.source = k.source)
SELECT doc_id, source, CASE WHEN rn <= take THEN 'global_val' ELSE 'train_core' END AS split FROM r""")
def _(spark, sf):
    d = S.global_val_split(V.table(spark, sf, "documents"), benchmark="source")
    return d.select("doc_id", "source", "split")


_SQRT_SQL = """z AS (SELECT o_orderstatus AS source, count(*) AS n FROM orders GROUP BY o_orderstatus),
s AS (SELECT source, n, greatest(n, CAST(round_even(sqrt(n::DOUBLE * (SELECT max(n) FROM z)), 0) AS BIGINT)) AS m FROM z)"""


@query("sqrt_sizes", f"""WITH {_SQRT_SQL} SELECT source, n AS original_count, m AS expanded_count, {q6('m / sum(m) OVER ()')} AS sampling_probability FROM s""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "source")
    d = S.sqrt_sizes(o, benchmark="source")
    return d.withColumn("sampling_probability", r6("sampling_probability"))


@query("expand_sqrt", """WITH z AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
s AS (SELECT lang, n, greatest(n, CAST(round_even(sqrt(n::DOUBLE * (SELECT max(n) FROM z)), 0) AS BIGINT)) AS m FROM z),
r AS (SELECT doc_id, d.lang, n, m, row_number() OVER (PARTITION BY d.lang ORDER BY md5('42:sqrt:' || d.lang || ':' || doc_id), doc_id) AS rn FROM documents d JOIN s ON d.lang = s.lang)
SELECT doc_id, lang, m // n + CASE WHEN rn <= m % n THEN 1 ELSE 0 END AS copies FROM r""")
def _(spark, sf):
    d = S.expand_sqrt(V.table(spark, sf, "documents"), benchmark="lang")
    return d.groupBy("doc_id", "lang").agg(F.count("copy").alias("copies"))


@query("mix_benchmarks", """SELECT src, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM (SELECT source AS src, doc_id AS k FROM documents UNION ALL SELECT 'bench', item_id FROM benchmark
  UNION ALL SELECT 'conv', conv_id FROM conversations) GROUP BY src""")
def _(spark, sf):
    a = V.table(spark, sf, "documents").select(F.col("source").alias("src"), F.col("doc_id").alias("k"))
    b = V.table(spark, sf, "benchmark").select(F.lit("bench").alias("src"), F.col("item_id").alias("k"), "text")
    c = V.messages(spark, sf).select(F.lit("conv").alias("src"), F.col("conv_id").alias("k"))
    return S.mix([a, b, c]).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


@query("round_robin_failures", f"""WITH {RESPONSES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY data_source ORDER BY score, row_id) AS round FROM responses WHERE score < 0.4)
SELECT row_id, data_source, round FROM r ORDER BY round, data_source LIMIT 12""")
def _(spark, sf):
    d = S.round_robin_failures(V.responses(spark, sf), k=12, category="data_source", reward="score", order="row_id")
    return d.select("row_id", "data_source", F.col("round").cast("long"))


def _uniform_sql(extra):
    return f"""WITH {STEPS_SQL}, g AS (SELECT *, min(CASE WHEN won THEN 1 ELSE 0 END) OVER t AS lo, max(CASE WHEN won THEN 1 ELSE 0 END) OVER t AS hi, count(*) OVER t AS n
  FROM steps WINDOW t AS (PARTITION BY traj_uid)) SELECT traj_uid, step FROM g WHERE lo <> hi {extra}"""


@query("drop_uniform_groups", _uniform_sql(""))
def _(spark, sf):
    s = V.steps(spark, sf).withColumn("w", F.col("won").cast("int"))
    return S.drop_uniform_groups(s, group="traj_uid", reward="w").select("traj_uid", "step")


@query("drop_uniform_groups_keep_single", _uniform_sql("OR n = 1"))
def _(spark, sf):
    s = V.steps(spark, sf).withColumn("w", F.col("won").cast("int"))
    return S.drop_uniform_groups(s, group="traj_uid", reward="w", keep_singletons=True).select("traj_uid", "step")


@query("fill_to_target", f"""WITH {RESPONSES_SQL}, g AS (SELECT uid, min(row_id // 100) AS b FROM responses GROUP BY uid ORDER BY b, uid LIMIT 200)
SELECT uid, count(*) AS n FROM responses WHERE uid IN (SELECT uid FROM g) GROUP BY uid""")
def _(spark, sf):
    d = V.responses(spark, sf).withColumn("batch", F.floor(F.col("row_id") / 100))
    return S.fill_to_target(d, 200).groupBy("uid").agg(F.count(F.lit(1)).alias("n"))


@query("dedup_first", """SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_partkey, l_suppkey""")
def _(spark, sf):
    d = V.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return S.dedup_first(d, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"]).select("l_partkey", "l_suppkey", "l_orderkey")


def _history_sql(line):
    return f"""WITH h AS (SELECT conv_id, turn + 1 AS step, {line} AS line FROM conversations),
w AS (SELECT conv_id, step, list(line) OVER (PARTITION BY conv_id ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l FROM h)
SELECT conv_id, step, md5(array_to_string(l, chr(10))) AS history, len(l) AS valid_length FROM w"""


def _history(spark, sf, style):
    m = V.messages(spark, sf).select("conv_id", (F.col("turn") + 1).alias("step"), F.col("text").alias("obs"), F.col("role").alias("action"))
    d = S.recent_history(m, 3, traj="conv_id", style=style)
    return d.select("conv_id", "step", F.md5("history").alias("history"), "valid_length")


@query("recent_history", _history_sql("""'[Observation ' || (turn + 1) || ': ''' || text || ''', Action ' || (turn + 1) || ': ''' || role || ''']'"""))
def _(spark, sf):
    return _history(spark, sf, "brackets")


@query("recent_history_steps", _history_sql("'Step ' || (turn + 1) || ':' || role || ' ' || text || chr(10)"))
def _(spark, sf):
    return _history(spark, sf, "steps")


@query("token_budget_prefix", """WITH c AS (SELECT source, doc_id, sum(length(text) // 4) OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS used FROM documents)
SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM c WHERE used <= 2000""")
def _(spark, sf):
    d = S.token_budget_prefix(V.table(spark, sf, "documents"), 2000, keys=["source"], order=[F.col("n_chars"), F.col("doc_id")], at=F.col("n_chars"))
    return d.select("source", "doc_id", "used")


@query("pad_to_divisor", """WITH n AS (SELECT count(*) AS n FROM orders), p AS (SELECT n, (64 - n % 64) % 64 AS pad FROM n),
r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)
SELECT o_orderkey, rn AS position, false AS padded FROM r UNION ALL SELECT o_orderkey, rn + n, true FROM r, p WHERE rn <= pad""")
def _(spark, sf):
    return S.pad_to_divisor(V.table(spark, sf, "orders").select("o_orderkey"), 64, order="o_orderkey")


def _adjust_sql(n, keep):
    return f"""WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('3:{n}:' || o_orderkey), o_orderkey) AS r, count(*) OVER () AS n FROM orders) {keep}"""


@query("adjust_by_deleting", _adjust_sql("delete", "SELECT o_orderkey FROM h WHERE r > n % 64"))
def _(spark, sf):
    return S.adjust_to_divisor(V.table(spark, sf, "orders").select("o_orderkey"), 64, "delete", seed=3, key="o_orderkey")


@query("adjust_by_copying", _adjust_sql("copy", "SELECT o_orderkey FROM h UNION ALL SELECT o_orderkey FROM h WHERE r <= (64 - n % 64) % 64"))
def _(spark, sf):
    return S.adjust_to_divisor(V.table(spark, sf, "orders").select("o_orderkey"), 64, "copy", seed=3, key="o_orderkey")


_RN = "r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders)"


@query("repeat_interleaved", f"WITH {_RN} SELECT o_orderkey, (rn - 1) * 3 + k + 1 AS position FROM r, (SELECT unnest([0, 1, 2]) AS k)")
def _(spark, sf):
    return S.repeat_rows(V.table(spark, sf, "orders").select("o_orderkey"), 3, order="o_orderkey")


@query("repeat_tiled", f"WITH {_RN} SELECT o_orderkey, k * n + rn AS position FROM r, (SELECT unnest([0, 1, 2]) AS k)")
def _(spark, sf):
    return S.repeat_rows(V.table(spark, sf, "orders").select("o_orderkey"), 3, order="o_orderkey", interleave=False)


@query("repeat_by_count", """WITH t AS (SELECT o_orderkey, o_custkey % 4 AS t, sum(o_custkey % 4) OVER (ORDER BY o_orderkey) AS e FROM orders)
SELECT o_orderkey, CAST(e - t + k AS BIGINT) AS position FROM t, (SELECT unnest([1, 2, 3]) AS k) WHERE k <= t""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("t"))
    return S.repeat_by(o, "t", order="o_orderkey").drop("t")


@query("chunk_rows", """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders),
a AS (SELECT o_orderkey, rn, n FROM p UNION ALL SELECT o_orderkey, rn + n, n FROM p WHERE rn <= (7 - n % 7) % 7)
SELECT CAST((rn - 1) // ((n + (7 - n % 7) % 7) // 7) AS BIGINT) AS chunk, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM a GROUP BY 1""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("k"))
    d = S.chunk_rows(o, 7, order="o_orderkey", padding=True)
    return d.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("s"))


@query("fold_and_unfold", f"""WITH {_RN} SELECT (rn - 1) // 4 AS fold, (rn - 1) % 4 AS part, o_orderkey AS k FROM r""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("k"))
    d = S.unfold(S.fold(o, 4, order="o_orderkey"), ["k"])
    return d.select("fold", F.col("part").cast("long"), "k")


@query("unfold_column_chunks", """SELECT p_partkey, CAST(k AS BIGINT) AS part, CASE k WHEN 0 THEN p_name || '|' || p_brand ELSE p_type || '|' || p_size END AS obs, p_name AS label
FROM part, (SELECT unnest([0, 1]) AS k)""")
def _(spark, sf):
    p = V.table(spark, sf, "part")
    d = p.select("p_partkey", F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("obs"), F.col("p_name").alias("label"))
    d = S.unfold_column_chunks(d, 2, ["obs"])
    return d.select("p_partkey", F.col("part").cast("long"), as_text("obs").alias("obs"), "label")


_SNAKE = """b AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS p FROM documents),
s AS (SELECT doc_id, n_chars, CASE WHEN (p // 8) % 2 = 0 THEN p % 8 ELSE 7 - p % 8 END AS part FROM b)"""


@query("balanced_partitions", f"WITH {_SNAKE} SELECT doc_id, part FROM s")
def _(spark, sf):
    return S.balanced_partitions(V.table(spark, sf, "documents"), 8, length="n_chars", key="doc_id").select("doc_id", "part")


@query("balanced_blocks")
def _(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "n_chars")
    return S.balanced_blocks(d, 8, length="n_chars", key="doc_id").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("tokens"))


@query("length_imbalance", f"""WITH {_SNAKE}, c AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // (count(*) OVER () // 8) AS c, n_chars FROM documents),
x AS (SELECT sum(n_chars) AS s FROM c GROUP BY c), y AS (SELECT sum(n_chars) AS s FROM s GROUP BY part)
SELECT CAST(min(x.s) AS BIGINT) AS min, CAST(max(x.s) AS BIGINT) AS max, CAST(max(x.s) - min(x.s) AS BIGINT) AS minmax_diff, {q6('sum(x.s) / 8')} AS mean,
  CAST((SELECT min(s) FROM y) AS BIGINT) AS balanced_min, CAST((SELECT max(s) FROM y) AS BIGINT) AS balanced_max FROM x""")
def _(spark, sf):
    d = S.balanced_partitions(V.table(spark, sf, "documents"), 8, length="n_chars", key="doc_id")
    out = S.length_imbalance(d, 8, order="doc_id", length="n_chars")
    return out.withColumn("mean", r6("mean"))


@query("micro_batches", """WITH c AS (SELECT CAST(ceil(least(count(*), ceil(sum(n_chars) / 50000)) / 4) * 4 AS BIGINT) AS k FROM documents),
b AS (SELECT doc_id, k, row_number() OVER (ORDER BY n_chars DESC, md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS p FROM documents, c)
SELECT doc_id, CASE WHEN (p // k) % 2 = 0 THEN p % k ELSE k - 1 - p % k END AS micro_batch FROM b""")
def _(spark, sf):
    d = S.micro_batches(V.table(spark, sf, "documents"), 50000, length="n_chars", key="doc_id", divisor=4)
    return d.select("doc_id", "micro_batch")


@query("sample_generations", "SELECT doc_id FROM documents ORDER BY md5('42:' || text), text LIMIT 10")
def _(spark, sf):
    d = V.table(spark, sf, "documents").withColumnRenamed("text", "input")
    return S.sample_generations(d, 10, 42).select("doc_id")


@query("paginate", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 25 OFFSET 50")
def _(spark, sf):
    return S.paginate(V.table(spark, sf, "part").select("p_partkey", "p_retailprice"), 3, 25, order=["p_retailprice", "p_partkey"])


@query("concat_batches", """SELECT CAST(b AS BIGINT) AS batch, count(*) AS n FROM (SELECT 0 AS b, item_id FROM benchmark UNION ALL SELECT 1, doc_id FROM documents) GROUP BY b""")
def _(spark, sf):
    a, b = V.table(spark, sf, "benchmark").select("text"), V.table(spark, sf, "documents").select("text")
    return S.concat_batches([a, b]).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("missing_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, sf):
    return S.missing_ids(V.table(spark, sf, "documents"), V.table(spark, sf, "labels"), "doc_id")


@query("ambiguous_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(spark, sf):
    return S.ambiguous_ids(V.table(spark, sf, "documents"), V.table(spark, sf, "labels"), "doc_id")


@query("library_diff", """WITH n AS (SELECT doc_id, quality FROM labels)
SELECT d.doc_id, CASE WHEN n.doc_id IS NULL THEN 'deleted' ELSE 'updated' END AS change FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id
WHERE n.doc_id IS NULL OR quality = 0 UNION ALL SELECT 1000000000 + item_id, 'new' FROM benchmark""")
def _(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "text")
    new = d.join(V.table(spark, sf, "labels"), "doc_id")
    new = new.select("doc_id", F.when(F.col("quality") == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    added = V.table(spark, sf, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("doc_id"), "text")
    return S.library_diff(d, new.unionByName(added), key="doc_id")
