"""Queries over group-relative learning signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.operators import advantage as A
from stepfold.plans import views as V
from stepfold.plans.views import RESPONSES_SQL, STEPS_SQL, TOKENS_SQL
from stepfold.suite.registry import q6, query, r6

RETURNS_SQL = """rets AS (
  SELECT a.traj_uid, a.step, sum(pow(0.9, b.step - a.step) * b.reward) AS returns
  FROM steps a JOIN steps b ON a.traj_uid = b.traj_uid AND b.step >= a.step
  GROUP BY a.traj_uid, a.step)"""


@query("discounted_returns", f"""WITH {STEPS_SQL}, {RETURNS_SQL}
SELECT traj_uid, step, {q6('returns')} AS returns FROM rets""")
def _(spark, sf):
    d = A.discounted_returns(V.steps(spark, sf), 0.9)
    return d.select("traj_uid", "step", r6("returns").alias("returns"))


def flagship(spark, sf):
    d = A.discounted_returns(V.steps(spark, sf), 0.9)
    d = A.gigpo_advantage(d, score="reward", weight=0.5)
    return d.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg("returns")).alias("mean_return"),
        r6(F.sum(F.abs("episode_adv"))).alias("abs_episode_adv"),
        r6(F.sum(F.abs("step_adv"))).alias("abs_step_adv"),
        r6(F.max("adv")).alias("max_adv"),
    )


GIGPO_SQL = f"""{STEPS_SQL}, {RETURNS_SQL}, full_steps AS (
  SELECT s.*, r.returns,
    s.reward - CASE WHEN count(*) OVER g = 1 THEN 0 ELSE avg(s.reward) OVER g END AS episode_adv,
    r.returns - avg(r.returns) OVER o AS step_adv
  FROM steps s JOIN rets r ON s.traj_uid = r.traj_uid AND s.step = r.step
  WINDOW g AS (PARTITION BY uid), o AS (PARTITION BY uid, anchor_obs))"""

query("gigpo_group_summary", f"""WITH {GIGPO_SQL}
SELECT uid, count(*) AS n, {q6('avg(returns)')} AS mean_return,
  {q6('sum(abs(episode_adv))')} AS abs_episode_adv, {q6('sum(abs(step_adv))')} AS abs_step_adv,
  {q6('max(episode_adv + 0.5 * step_adv)')} AS max_adv
FROM full_steps GROUP BY uid""")(flagship)


@query("gigpo_advantage", f"""WITH {GIGPO_SQL}
SELECT traj_uid, step, {q6('episode_adv')} AS episode_adv, {q6('step_adv')} AS step_adv,
  {q6('episode_adv + step_adv')} AS adv FROM full_steps""")
def _(spark, sf):
    d = A.discounted_returns(V.steps(spark, sf), 0.9)
    d = A.advantage(d, estimator="gigpo", score="reward")
    return d.select("traj_uid", "step", *[r6(c).alias(c) for c in ("episode_adv", "step_adv", "adv")])


@query("step_advantage_std", f"""WITH {STEPS_SQL}
SELECT traj_uid, step, {q6('''CASE WHEN count(*) OVER o = 1 THEN 0
  ELSE (reward - avg(reward) OVER o) / (stddev_samp(reward) OVER o + 1e-6) END''')} AS adv
FROM steps WINDOW o AS (PARTITION BY uid, anchor_obs)""")
def _(spark, sf):
    d = A.normalized_advantage(V.steps(spark, sf), group=["uid", "anchor_obs"], score="reward", own_mean=True)
    return d.select("traj_uid", "step", r6("adv").alias("adv"))


def _group_sql(expr: str) -> str:
    return f"WITH {RESPONSES_SQL} SELECT row_id, {q6(expr)} AS adv FROM responses WINDOW g AS (PARTITION BY uid)"


@query("grpo_advantage", _group_sql("""CASE WHEN count(*) OVER g = 1 THEN score / (1 + 1e-6)
  ELSE (score - avg(score) OVER g) / (stddev_samp(score) OVER g + 1e-6) END"""))
def _(spark, sf):
    return A.advantage(V.responses(spark, sf), estimator="grpo").select("row_id", r6("adv").alias("adv"))


@query("grpo_advantage_once_per_trajectory", f"""WITH {STEPS_SQL}, firsts AS (
  SELECT uid, CASE WHEN count(*) = 1 THEN 0 ELSE avg(reward) END AS m,
    CASE WHEN count(*) = 1 THEN 1 ELSE stddev_samp(reward) END AS sd
  FROM steps WHERE step = 1 GROUP BY uid)
SELECT traj_uid, step, {q6('(reward - m) / (sd + 1e-6)')} AS adv FROM steps JOIN firsts USING (uid)""")
def _(spark, sf):
    d = V.steps(spark, sf).withColumn("first", F.col("step") == 1)
    d = A.normalized_advantage(d, score="reward", once="first")
    return d.select("traj_uid", "step", r6("adv").alias("adv"))


@query("grpo_advantage_no_std", _group_sql(
    "score - CASE WHEN count(*) OVER g = 1 THEN 0 ELSE avg(score) OVER g END"))
def _(spark, sf):
    d = A.normalized_advantage(V.responses(spark, sf), std=False)
    return d.select("row_id", r6("adv").alias("adv"))


@query("population_advantage", _group_sql("""CASE WHEN stddev_pop(score) OVER g <= 1e-8 THEN 0
  ELSE (score - avg(score) OVER g) / stddev_pop(score) OVER g END"""))
def _(spark, sf):
    d = A.advantage(V.responses(spark, sf), estimator="population")
    return d.select("row_id", r6("adv").alias("adv"))


@query("passk_advantage", f"""WITH {RESPONSES_SQL}, r AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC) AS rn,
    count(*) OVER (PARTITION BY uid) AS n FROM responses),
t AS (SELECT uid, max(score) FILTER (rn = 1) AS s1, max(score) FILTER (rn = 2) AS s2,
  stddev_samp(score) AS sd FROM r WHERE n > 1 GROUP BY uid)
SELECT row_id, {q6('CASE WHEN rn = 1 AND n > 1 THEN (s1 - s2) / (sd + 1e-6) ELSE 0 END')} AS adv
FROM r LEFT JOIN t USING (uid)""")
def _(spark, sf):
    return A.passk_advantage(V.responses(spark, sf)).select("row_id", r6("adv").alias("adv"))


@query("rloo_advantage", _group_sql("""CASE WHEN count(*) OVER g = 1 THEN score ELSE
  (score - avg(score) OVER g) * count(*) OVER g / (count(*) OVER g - 1) END"""))
def _(spark, sf):
    return A.rloo_advantage(V.responses(spark, sf)).select("row_id", r6("adv").alias("adv"))


WHITE_SQL = """m AS (SELECT sum(v * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS n FROM w),
k AS (SELECT any_value(mean) AS mean,
  sum(mask * pow(v - mean, 2)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var
  FROM w, m)"""


@query("masked_whiten", f"""WITH {TOKENS_SQL}, w AS (SELECT *, reward AS v FROM tokens), {WHITE_SQL}
SELECT row_id, pos, {q6('(v - mean) / sqrt(var + 1e-8)')} AS whitened,
  {q6('(v - mean) / sqrt(var + 1e-8) + mean')} AS unshifted FROM w, k""")
def _(spark, sf):
    d = A.whiten(V.tokens(spark, sf), "reward", "mask")
    d = A.whiten(d, "reward", "mask", shift_mean=False, out="unshifted")
    return d.select("row_id", "pos", r6("whitened").alias("whitened"), r6("unshifted").alias("unshifted"))


@query("masked_moments", f"""WITH {TOKENS_SQL}, w AS (SELECT *, reward AS v FROM tokens), {WHITE_SQL}
SELECT CAST(n AS DOUBLE) AS n, {q6('k.mean')} AS mean, {q6('var')} AS var FROM k, m""")
def _(spark, sf):
    d = A.masked_stats(V.tokens(spark, sf), F.col("reward"), F.col("mask"))
    return d.select("n", r6("mean").alias("mean"), r6("var").alias("var"))


@query("reinforce_pp_baseline", f"""WITH {TOKENS_SQL}, {RESPONSES_SQL},
g AS (SELECT uid, CASE WHEN count(*) = 1 THEN 0 ELSE avg(score) END AS base FROM responses GROUP BY uid),
c AS (SELECT row_id, score - base AS c FROM responses JOIN g USING (uid)),
w AS (SELECT t.row_id, pos, mask, c * mask AS v FROM tokens t JOIN c USING (row_id)),
per AS (SELECT sum(v * mask) AS s, sum(v * v * mask) AS q, sum(mask) AS n FROM w GROUP BY row_id),
m AS (SELECT sum(s) / (sum(n) + 1e-8) AS mean, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM per),
k AS (SELECT mean, (q - 2 * mean * s + mean * mean * n) / (n + 1e-8) * n / (n - 1) AS var FROM m)
SELECT row_id, pos, {q6('(v - (SELECT mean FROM k)) / sqrt((SELECT var FROM k) + 1e-8) * mask')} AS adv FROM w""")
def _(spark, sf):
    d = A.reinforce_pp_baseline(V.tokens(spark, sf), V.responses(spark, sf))
    return d.select("row_id", "pos", r6("adv").alias("adv"))


@query("reinforce_pp", f"""WITH {TOKENS_SQL}, s AS (SELECT *, sum(1 - mask) OVER (
  PARTITION BY row_id ORDER BY pos) AS seg FROM tokens),
w AS (SELECT a.row_id, a.pos, any_value(a.mask) AS mask,
  sum(pow(0.9, b.pos - a.pos) * b.reward) AS v
  FROM s a JOIN s b ON a.row_id = b.row_id AND a.seg = b.seg AND b.pos >= a.pos
  GROUP BY a.row_id, a.pos), {WHITE_SQL}
SELECT row_id, pos, {q6('v')} AS returns, {q6('(v - mean) / sqrt(var + 1e-8) * mask')} AS adv
FROM w, k""")
def _(spark, sf):
    d = A.advantage(V.tokens(spark, sf), 0.9, estimator="reinforce_pp")
    return d.select("row_id", "pos", r6("returns").alias("returns"), r6("adv").alias("adv"))


@query("remax_advantage", f"""WITH {TOKENS_SQL}, {RESPONSES_SQL}, s AS (
  SELECT row_id, pos, mask, sum(reward * mask) OVER (PARTITION BY row_id ORDER BY pos
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS returns FROM tokens)
SELECT s.row_id, pos, {q6('returns')} AS returns, {q6('returns - score * mask')} AS adv
FROM s JOIN responses r ON s.row_id = r.row_id""")
def _(spark, sf):
    base = V.responses(spark, sf).select("row_id", F.col("score").alias("baseline"))
    d = A.remax_advantage(V.tokens(spark, sf), base)
    return d.select("row_id", "pos", r6("returns").alias("returns"), r6("adv").alias("adv"))


@query("gae", f"""WITH {TOKENS_SQL}, d AS (SELECT *, reward + 0.99 * coalesce(lead(value) OVER (
  PARTITION BY row_id ORDER BY pos), 0) - value AS delta FROM tokens),
w AS (SELECT a.row_id, a.pos, any_value(a.mask) AS mask, any_value(a.value) AS value,
  sum(pow(0.99 * 0.95, b.pos - a.pos) * b.delta) AS v
  FROM d a JOIN d b ON a.row_id = b.row_id AND b.pos >= a.pos GROUP BY a.row_id, a.pos), {WHITE_SQL}
SELECT row_id, pos, {q6('v + value')} AS returns, {q6('(v - mean) / sqrt(var + 1e-8)')} AS adv
FROM w, k""")
def _(spark, sf):
    d = A.gae(V.tokens(spark, sf), 0.99, 0.95)
    return d.select("row_id", "pos", r6("returns").alias("returns"), r6("adv").alias("adv"))


@query("step_groups_exact", f"""WITH {STEPS_SQL}
SELECT uid, anchor_obs, count(*) AS n, CAST(1 AS BIGINT) AS groups FROM steps GROUP BY uid, anchor_obs""")
def _(spark, sf):
    d = A.step_groups(V.steps(spark, sf)).groupBy("uid", "anchor_obs", "step_group")
    d = d.agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("uid", "anchor_obs").agg(F.sum("n").alias("n"), F.count("step_group").alias("groups"))


@query("step_group_sizes", f"""WITH {STEPS_SQL}, z AS (
  SELECT count(*) AS size FROM steps GROUP BY uid, anchor_obs),
g AS (SELECT unnest(range(1, (SELECT max(size) FROM z) + 1)) AS size)
SELECT g.size, count(z.size) AS count, {q6('count(z.size) / (SELECT count(*) FROM z)')} AS proportion,
  {q6('(SELECT avg(size) FROM z)')} AS mean_size
FROM g LEFT JOIN z USING (size) GROUP BY g.size""")
def _(spark, sf):
    d = A.step_group_sizes(V.steps(spark, sf))
    return d.select("size", "count", r6("proportion").alias("proportion"), r6("mean_size").alias("mean_size"))


@query("place_reward", f"""WITH {TOKENS_SQL}, {RESPONSES_SQL}, l AS (
  SELECT *, max(CASE WHEN mask <> 0 THEN pos END) OVER (PARTITION BY row_id) AS last_pos,
    count(*) OVER (PARTITION BY row_id) AS len FROM tokens)
SELECT l.row_id, pos, {q6('CASE WHEN pos = last_pos THEN score / len ELSE 0 END')} AS placed
FROM l JOIN responses r ON l.row_id = r.row_id""")
def _(spark, sf):
    from stepfold.plans.skew import group_values, lookup

    t = group_values(V.tokens(spark, sf), ["row_id"], len=F.count(F.lit(1)))
    score = V.responses(spark, sf).select("row_id", F.col("score").alias("episode_reward"))
    d = A.place_reward(lookup(t, score, ["row_id"], "inner"), length="len")
    return d.select("row_id", "pos", r6("placed").alias("placed"))


@query("invalid_action_penalty", f"""WITH {STEPS_SQL}
SELECT data_source, {q6("sum(reward - CASE WHEN is_action_valid THEN 0 ELSE 0.1 END)")} AS reward,
  {q6('avg(CASE WHEN is_action_valid THEN 1 ELSE 0 END)')} AS valid_action_ratio
FROM steps GROUP BY data_source""")
def _(spark, sf):
    s = V.steps(spark, sf)
    d = A.invalid_action_penalty(s, 0.1).groupBy("data_source").agg(
        r6(F.sum("reward")).alias("reward"),
        r6(F.avg(F.col("is_action_valid").cast("double"))).alias("valid_action_ratio"),
    )
    return d


def _kl_sql(kind):
    d = "(old_logp - ref_logp)"
    return {
        "k1": d, "abs": f"abs{d}", "k2": f"0.5 * {d} * {d}",
        "k3": f"greatest(least(exp(-{d}) + {d} - 1, 10), -10)",
    }[kind]


@query("kl_estimates", f"""WITH {TOKENS_SQL}
SELECT row_id, {', '.join(f"{q6(f'sum({_kl_sql(k)})')} AS {k}" for k in ('k1', 'abs', 'k2', 'k3'))}
FROM tokens GROUP BY row_id""")
def _(spark, sf):
    o, r = F.col("old_logp"), F.col("ref_logp")
    return V.tokens(spark, sf).groupBy("row_id").agg(
        *[r6(F.sum(A.kl_estimate(o, r, k))).alias(k) for k in ("k1", "abs", "k2", "k3")]
    )


@query("kl_penalized_reward", f"""WITH {TOKENS_SQL}
SELECT row_id, pos, {q6(f"reward - 0.2 * {_kl_sql('k3')} * mask")} AS penalized FROM tokens""")
def _(spark, sf):
    d = A.kl_penalized_reward(V.tokens(spark, sf), 0.2, "k3")
    return d.select("row_id", "pos", r6("penalized").alias("penalized"))


@query("mean_sequence_kl", f"""WITH {TOKENS_SQL}, r AS (
  SELECT sum({_kl_sql('abs')} * mask) / (sum(mask) + 1e-8) AS k FROM tokens GROUP BY row_id)
SELECT {q6('avg(k)')} AS mean_kl FROM r""")
def _(spark, sf):
    d = A.mean_sequence_kl(A.kl_penalized_reward(V.tokens(spark, sf), 0.2, "abs"))
    return d.select(r6("mean_kl").alias("mean_kl"))


@query("agg_loss", f"""WITH {TOKENS_SQL}, r AS (
  SELECT sum(adv * mask) AS s, sum(mask) AS n FROM tokens GROUP BY row_id)
SELECT 'token-mean' AS mode, {q6('sum(adv * mask) / (sum(mask) + 1e-8)')} AS loss FROM tokens
UNION ALL SELECT 'seq-mean-token-sum', {q6('avg(s)')} FROM r
UNION ALL SELECT 'seq-mean-token-mean', {q6('avg(s / nullif(n, 0))')} FROM r
UNION ALL SELECT 'seq-mean-token-sum-norm', {q6('sum(s) / (SELECT max(pos) FROM tokens)')} FROM r""")
def _(spark, sf):
    t = V.tokens(spark, sf)
    modes = ["token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"]
    parts = [
        A.agg_loss(t, F.col("adv"), F.col("mask"), m).select(F.lit(m).alias("mode"), r6("loss").alias("loss"))
        for m in modes
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_RATIO = "exp(logp - old_logp)"
_CLIP_SQL = f"""c AS (SELECT *, {_RATIO} AS ratio, -adv * {_RATIO} AS l1,
  -adv * greatest(0.98, least({_RATIO}, 1.02)) AS l2 FROM tokens)"""


def _mm(e):
    return q6(f"sum(({e}) * mask) / (sum(mask) + 1e-8)")


@query("clip_diagnostics", f"""WITH {TOKENS_SQL}, {_CLIP_SQL}
SELECT {_mm('CASE WHEN adv < 0 THEN least(-adv * 3.0, greatest(l1, l2)) ELSE greatest(l1, l2) END')} AS pg_loss,
  {_mm('CASE WHEN l2 > l1 THEN 1 ELSE 0 END')} AS clip_frac,
  {_mm('CASE WHEN greatest(l1, l2) > -adv * 3.0 AND adv < 0 THEN 1 ELSE 0 END')} AS clip_frac_low,
  {_mm('old_logp - logp')} AS ppo_kl FROM c""")
def _(spark, sf):
    d = A.clip_diagnostics(V.tokens(spark, sf), low=0.02, high=0.02)
    return d.select(*[r6(c).alias(c) for c in d.columns])


@query("sequence_ratio", f"""WITH {TOKENS_SQL}, g AS (
  SELECT row_id, exp(least(sum((logp - old_logp) * mask) / greatest(sum(mask), 1), 10.0)) AS r
  FROM tokens GROUP BY row_id)
SELECT row_id, pos, {q6('r')} AS seq_ratio,
  {q6('greatest(-adv * r, -adv * greatest(0.98, least(r, 1.02)))')} AS objective
FROM tokens JOIN g USING (row_id)""")
def _(spark, sf):
    d = A.sequence_ratio(V.tokens(spark, sf), 0.02, 0.02)
    return d.select("row_id", "pos", r6("seq_ratio").alias("seq_ratio"), r6("objective").alias("objective"))


@query("value_diagnostics", f"""WITH {TOKENS_SQL}, v AS (SELECT *, value * 2 AS p, reward AS r,
  greatest(value - 0.02, least(value * 2, value + 0.02)) AS b FROM tokens)
SELECT {_mm('greatest(pow(p - r, 2), pow(b - r, 2))')} AS value_loss,
  {_mm('CASE WHEN pow(b - r, 2) > pow(p - r, 2) THEN 1 ELSE 0 END')} AS clip_frac,
  {q6('1 - var_samp(r - value) FILTER (mask = 1) / (var_samp(r) FILTER (mask = 1) + 1e-5)')} AS explained_var
FROM v""")
def _(spark, sf):
    t = V.tokens(spark, sf).withColumns({"pred": F.col("value") * 2, "returns": F.col("reward")})
    d = A.value_diagnostics(t, 0.02)
    return d.select(*[r6(c).alias(c) for c in d.columns])


@query("prob_drift", f"""WITH {TOKENS_SQL}, d AS (
  SELECT abs(exp(logp) - exp(old_logp)) AS d FROM tokens WHERE mask = 1)
SELECT {q6('max(d)')} AS diff_max, {q6('avg(d)')} AS diff_mean, {q6('stddev_samp(d)')} AS diff_std FROM d""")
def _(spark, sf):
    d = A.prob_drift(V.tokens(spark, sf))
    return d.select(*[r6(c).alias(c) for c in d.columns])


@query("rloo_multi_source", f"""WITH {TOKENS_SQL}, t AS (
  SELECT *, row_id // 4 AS g, CASE WHEN pos = max(pos) OVER (PARTITION BY row_id) THEN 1 ELSE 0 END AS last_mask
  FROM tokens),
ma AS (SELECT g, sum(m) AS s FROM (SELECT g, row_id, avg(reward) AS m FROM t WHERE mask = 1 GROUP BY g, row_id) GROUP BY g),
mb AS (SELECT g, sum(m) AS s FROM (SELECT g, row_id, avg(value) AS m FROM t WHERE last_mask = 1 GROUP BY g, row_id) GROUP BY g),
r AS (SELECT t.*, (CASE WHEN mask = 1 THEN 0.7 * (reward * 4 / 3.0 - ma.s / 3) ELSE 0 END
  + CASE WHEN last_mask = 1 THEN 0.3 * (value * 4 / 3.0 - mb.s / 3) ELSE 0 END) * mask AS rr
  FROM t LEFT JOIN ma USING (g) LEFT JOIN mb USING (g)),
w AS (SELECT row_id, pos, mask, sum(rr) OVER (PARTITION BY row_id ORDER BY pos
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM r), {WHITE_SQL}
SELECT row_id, pos, {q6('v')} AS returns, {q6('(v - mean) / sqrt(var + 1e-8)')} AS adv FROM w, k""")
def _(spark, sf):
    from stepfold.plans.skew import group_values

    t = group_values(V.tokens(spark, sf), ["row_id"], top=F.max("pos"))
    t = t.withColumns(
        {"g": F.floor(F.col("row_id") / 4), "last_mask": (F.col("pos") == F.col("top")).cast("int")}
    )
    d = A.rloo_multi_source(t, {"reward": ("mask", 0.7), "value": ("last_mask", 0.3)}, 4, group="g")
    return d.select("row_id", "pos", r6("returns").alias("returns"), r6("adv").alias("adv"))


_GRADED = "CASE WHEN data_source < '2' THEN 1.0 WHEN data_source < '4' THEN 0.5 ELSE 0.0 END"


@query("pairwise_accuracy", f"""WITH {RESPONSES_SQL}, r AS (SELECT uid, row_id, score, {_GRADED} AS l FROM responses),
p AS (SELECT a.uid, a.l - b.l AS dl, a.score - b.score AS ds FROM r a JOIN r b
  ON a.uid = b.uid AND a.row_id < b.row_id),
g AS (SELECT uid, sum(CASE WHEN (ds > 0) = (dl > 0) THEN abs(dl) ELSE 0 END) / nullif(sum(abs(dl)), 0) AS acc
  FROM p GROUP BY uid)
SELECT uid, {q6('coalesce(acc, 0.5)')} AS accuracy FROM g""")
def _(spark, sf):
    label = F.when(F.col("data_source") < "2", 1.0).when(F.col("data_source") < "4", 0.5).otherwise(0.0)
    d = A.pairwise_accuracy(V.responses(spark, sf).withColumn("label", label))
    return d.select("uid", r6("accuracy").alias("accuracy"))


@query("abs_accuracy", f"""WITH {RESPONSES_SQL}
SELECT data_source, {q6('avg(CASE WHEN sign(score - 2) = sign(label * 2 - 1) THEN 1 ELSE 0 END)')} AS abs_accuracy
FROM responses GROUP BY data_source""")
def _(spark, sf):
    d = V.responses(spark, sf).withColumn("score", F.col("score") - 2)
    return A.abs_accuracy(d, "data_source").withColumn("abs_accuracy", r6("abs_accuracy"))


@query("preference_pairs", f"""WITH p AS (
  SELECT o_orderkey // 2 AS pair_id, o_orderkey % 2 AS ord, round(o_totalprice / 100000, 0) AS score,
    -o_totalprice / 500000 AS logp, -o_custkey / 1000.0 AS ref FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, ord) AS rn FROM p),
j AS (SELECT a.pair_id, a.ord AS chosen, (a.logp - b.logp) - (a.ref - b.ref) AS h
  FROM r a JOIN r b ON a.pair_id = b.pair_id AND a.rn = 1
    AND b.rn = (SELECT max(rn) FROM r c WHERE c.pair_id = b.pair_id))
SELECT pair_id, chosen, {q6('0.9 * ln(1 + exp(-0.1 * h)) + 0.1 * ln(1 + exp(0.1 * h))')} AS loss,
  {q6('pow(h - 5, 2)')} AS ipo FROM j""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 2).alias("pair_id"),
        (F.col("o_orderkey") % 2).alias("ord"),
        F.round(F.col("o_totalprice") / 100000, 0).alias("score"),
        (-F.col("o_totalprice") / 500000).alias("logp"),
        (-F.col("o_custkey") / 1000.0).alias("ref_logp"),
    )
    p = A.dpo_loss(A.preference_pairs(o), 0.1, smoothing=0.1).withColumnRenamed("loss", "sig")
    p = A.dpo_loss(p, 0.1, "ipo")
    return p.select("pair_id", F.col("chosen.ord").alias("chosen"), r6("sig").alias("loss"), r6("loss").alias("ipo"))


@query("resample_weights", f"""WITH {RESPONSES_SQL}, e AS (SELECT max(score) AS hi, min(score) AS lo FROM responses)
SELECT row_id, {q6('pow(abs(score), 2) + 1e-8')} AS w_pow,
  {q6('CASE WHEN score = hi OR score = lo THEN 1.0 ELSE 0.0 END + 1e-8')} AS w_ends,
  {q6('CASE WHEN score = hi THEN 0.4 ELSE 0.1 END + 1e-8')} AS w_top FROM responses, e""")
def _(spark, sf):
    d = A.resample_weights(V.responses(spark, sf), out="w_pow")
    d = A.resample_weights(d, "max_min", out="w_ends")
    d = A.resample_weights(d, "max_random", out="w_top")
    return d.select("row_id", *[r6(c).alias(c) for c in ("w_pow", "w_ends", "w_top")])


@query("resample_draws", f"""WITH {RESPONSES_SQL}, w AS (SELECT row_id, pow(abs(score), 2) + 1e-8 AS w FROM responses),
c AS (SELECT row_id, w, sum(w) OVER (ORDER BY row_id) AS c, sum(w) OVER () AS t FROM w),
d AS (SELECT row_id AS draw, CAST('0x' || md5('7:' || row_id)[:12] AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM responses)
SELECT draw, row_id, {q6('w')} AS weight FROM d JOIN c ON u >= (c - w) / t AND u < c / t""")
def _(spark, sf):
    return A.resample(V.responses(spark, sf), 7).select("draw", "row_id", r6("weight").alias("weight"))


@query("softmean_center", f"""WITH {RESPONSES_SQL}, c AS (
  SELECT (ln(sum(exp(score * 0.5 - (SELECT max(score) * 0.5 FROM responses)))) + max(score) * 0.5
    - ln(count(*))) / 0.5 AS c FROM responses)
SELECT row_id, {q6('score - c')} AS centered FROM responses, c""")
def _(spark, sf):
    d = A.softmean_center(V.responses(spark, sf), 0.5)
    return d.select("row_id", r6("centered").alias("centered"))


@query("step_groups_similar")
def _(spark, sf):
    from stepfold.operators.cluster import similar_step_groups

    p = V.table(spark, sf, "part").select(F.col("p_type").alias("uid"), F.col("p_name").alias("anchor_obs"), F.col("p_partkey").alias("ord"))
    return similar_step_groups(p, 0.7).select("ord", "step_group")


@query("sql_functions", r"""SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+'),
  lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')) AS qa, source || '_' || doc_id AS full_id FROM documents""")
def _(spark, sf):
    from stepfold.functions.udf import register_sql_functions

    register_sql_functions(spark)
    docs = V.table(spark, sf, "documents")
    return spark.sql("SELECT doc_id, md5(normalize_answer_qa(text)) AS qa, prefixed_id(CAST(doc_id AS STRING), source) AS full_id FROM {docs}", docs=docs)


@query("markdown_table_function", "SELECT doc_id, CAST(1 AS BIGINT) AS ord, 'T' AS title, md5(trim(text, ' ' || chr(10))) AS body FROM documents")
def _(spark, sf):
    from stepfold.functions.udf import register_sql_functions

    register_sql_functions(spark)
    docs = V.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("# T\n"), "text", F.lit("\n# empty")).alias("md"))
    return spark.sql("SELECT doc_id, CAST(s.ord AS BIGINT) AS ord, s.title, md5(s.body) AS body FROM {docs}, LATERAL markdown_sections(md) AS s", docs=docs)


@query("user_scorers", """SELECT conv_id, turn, CAST(length(text) % 7 AS DOUBLE) AS one, CAST(turn AS DOUBLE) AS batch,
  CASE WHEN turn = 0 THEN 0.0::DOUBLE ELSE round(1.0::DOUBLE / turn, 6) END AS safe, turn = 0 AS failed FROM conversations""")
def _(spark, sf):
    from stepfold.functions import udf as U
    from stepfold.operators.grading import grade_responses

    one = U.register_scorer("len7", lambda source, s, truth, extra, base: (len(s) % base, "note"), base=7)
    batch = U.register_batch_scorer("truths", lambda ss, truths: [float(t) for t in truths])
    safe = U.safe_score(lambda s, truth: {"score": 1 / int(truth)})
    m = V.messages(spark, sf).withColumns({"gold": F.col("turn").cast("string"), "data_source": F.lit("len7")})
    d = grade_responses(m, response="text", scorers={"len7": one}).withColumn("s", safe(F.col("text"), F.col("gold")))
    return d.select("conv_id", "turn", F.col("score").alias("one"), batch(F.col("text"), F.col("gold")).alias("batch"),
                    F.round("s.score", 6).alias("safe"), F.col("s.error").isNotNull().alias("failed"))
