"""Group-relative learning signals over step, response and token tables.

All arithmetic is in doubles. A group statistic is added with ``group_values`` (one
shuffle), a time recurrence with ``discounted`` (one shuffle), a whole-table statistic as a
scalar subquery over a partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.plans.skew import discounted, drop_keys, group_values, has_hot, match, rank, rename_keys, running


def _once(score: str, once: str | None) -> Column:
    """Score that counts in group statistics: every row, or rows flagged by ``once``."""
    return F.col(score) if once is None else F.when(F.col(once), F.col(score))


def discounted_returns(df, gamma, *, traj="traj_uid", step="step", reward="reward", out="returns"):
    """R_t = r_t + gamma * R_{t+1} along each trajectory."""
    return discounted(df, [traj], step, gamma, **{out: F.col(reward)})


def normalized_advantage(
    df, *, group=("uid",), score="score", std=True, eps=1e-6, own_mean=False, once=None, out="adv", hot=None
):
    """(s - mean) / (sample std + eps). A group of one has std 1 and mean 0, or its own
    score as the mean when ``own_mean``. ``hot``: as in ``group_values``."""
    s = _once(score, once)
    d = group_values(df, list(group), hot=hot, __mean=F.avg(s), __sd=F.stddev_samp(s), __cnt=F.count(s))
    alone = F.col("__cnt") <= 1
    mean = F.when(alone, F.col(score) if own_mean else F.lit(0.0)).otherwise(F.col("__mean"))
    adv = F.col(score) - mean
    if std:
        adv = adv / (F.when(alone, 1.0).otherwise(F.col("__sd")) + eps)
    return d.withColumn(out, adv).drop("__mean", "__sd", "__cnt")


def population_advantage(df, *, group=("uid",), score="score", eps=1e-8, out="adv"):
    """(s - mean) / population std; zero for the group when the std is at most eps."""
    d = group_values(df, list(group), __mean=F.avg(score), __sd=F.stddev_pop(score))
    adv = F.try_divide(F.col(score) - F.col("__mean"), F.col("__sd"))
    return d.withColumn(out, F.when(F.col("__sd") <= eps, 0.0).otherwise(adv)).drop("__mean", "__sd")


def passk_advantage(df, *, group="uid", score="score", std=True, eps=1e-6, out="adv"):
    """Only the best row gets best - second best, over the std; a tie for best gives zero, and
    so does a group of one, which has no second best."""
    d = group_values(
        df, [group], __max=F.max(score), __sd=F.stddev_samp(score), __cnt=F.count(score)
    )
    best = F.col(score) == F.col("__max")
    d = group_values(
        d, [group], __ties=F.count_if(best), __next=F.max(F.when(~best, F.col(score)))
    )
    gain = F.col("__max") - F.col("__next")
    if std:
        gain = gain / (F.col("__sd") + eps)
    adv = (
        F.when((F.col("__cnt") > 1) & best & (F.col("__ties") == 1), gain)
        .otherwise(0.0)
    )
    return d.withColumn(out, adv.cast("double")).drop("__max", "__sd", "__cnt", "__ties", "__next")


def rloo_advantage(df, *, group="uid", score="score", out="adv"):
    """Leave-one-out baseline; a group of one keeps its score."""
    d = group_values(df, [group], __mean=F.avg(score), __cnt=F.count(score))
    k = F.try_divide(F.col("__cnt"), F.col("__cnt") - 1)
    adv = F.when(F.col("__cnt") > 1, F.col(score) * k - F.col("__mean") * k)
    return d.withColumn(out, adv.otherwise(F.col(score))).drop("__mean", "__cnt")


def masked_stats(df: DataFrame, value: Column, mask: Column) -> DataFrame:
    """One row (n, mean, var) over rows whose 0/1 mask is set; var is Bessel-corrected."""
    inside = F.when(mask != 0, value)
    s = df.agg(
        F.count(inside).cast("double").alias("n"),
        F.coalesce(F.sum(inside), F.lit(0.0)).alias("s"),
        F.avg(inside).alias("m"),
        F.var_pop(inside).alias("v"),
    )
    n, mean = F.col("n"), F.col("s") / (F.col("n") + 1e-8)
    var = (n * F.col("v") + n * F.pow(F.col("m") - mean, 2)) / (n + 1e-8) * F.try_divide(n, n - 1)
    bad = F.raise_error(F.lit("masked variance needs at least two selected rows"))
    return s.select("n", mean.alias("mean"), F.when(n < 2, bad.cast("double")).otherwise(var).alias("var"))


def masked_mean(value: Column, mask: Column) -> Column:
    return (F.sum(value * mask) / (F.sum(mask) + 1e-8)).cast("double")


def whiten(df, value: str, mask: str, *, shift_mean=True, out="whitened"):
    """(v - mean) / sqrt(var + 1e-8) with the whole table's masked moments."""
    stats = masked_stats(df, F.col(value), F.col(mask))
    both = stats.select(F.struct("mean", "var")).scalar()
    d = df.withColumn("__w", both)
    w = (F.col(value) - F.col("__w.mean")) / F.sqrt(F.col("__w.var") + 1e-8)
    if not shift_mean:
        w = w + F.col("__w.mean")
    return d.withColumn(out, w).drop("__w")


def reinforce_pp_baseline(tokens, scores, *, row="row_id", group="uid", score="score", mask="mask"):
    """Group-centred response score on every token of the response, whitened over all tokens."""
    from stepfold.plans.skew import lookup

    centred = normalized_advantage(scores, group=[group], score=score, std=False, out="__c")
    d = lookup(tokens, centred.select(row, "__c"), [row], "inner")
    d = d.withColumn("__c", F.col("__c") * F.col(mask))
    d = whiten(d, "__c", mask, out="adv")
    return d.withColumn("adv", F.col("adv") * F.col(mask)).drop("__c")


def reinforce_pp(df, gamma, *, row="row_id", pos="pos", reward="reward", mask="mask"):
    """Token-reverse discounted sum whose carry is cut after every unmasked position."""
    d = running(df, [row], [pos], pos, __seg=1 - F.col(mask))
    d = discounted(d, [row, "__seg"], pos, gamma, returns=F.col(reward)).drop("__seg")
    d = whiten(d, "returns", mask, out="adv")
    return d.withColumn("adv", F.col("adv") * F.col(mask))


def remax_advantage(df, baselines, *, row="row_id", pos="pos", reward="reward", mask="mask"):
    """Suffix sum of masked reward, and the same minus the response's baseline."""
    from stepfold.plans.skew import lookup

    d = lookup(df, baselines, [row])
    d = discounted(d, [row], pos, 1.0, returns=F.col(reward) * F.col(mask))
    return d.withColumn("adv", F.col("returns") - F.col("baseline") * F.col(mask)).drop("baseline")


def gae(df, gamma, lam, *, row="row_id", pos="pos", reward="reward", value="value", mask="mask"):
    """Generalised advantage estimation.

    With g = gamma*lam and S the g-discounted suffix sum,
    A = S(r) - S(V) + gamma * (S(V) - V) / g, since the last factor is the g-discounted sum
    of the values one step on. returns = A + V before whitening.
    """
    g = gamma * lam
    d = discounted(df, [row], pos, g, __sr=F.col(reward), __sv=F.col(value))
    if g == 0:
        nxt = df.select(row, (F.col(pos) - 1).alias(pos), F.col(value).alias("__nv"))
        d = d.join(rename_keys(nxt, [row, pos]), match([row, pos]), "left")
        d = drop_keys(d, [row, pos])
        ahead = F.coalesce(F.col("__nv"), F.lit(0.0)) * gamma
    else:
        ahead = (F.col("__sv") - F.col(value)) * (gamma / g)
    d = d.withColumn("raw_adv", F.col("__sr") - F.col("__sv") + ahead).drop("__sr", "__sv", "__nv")
    d = d.withColumn("returns", F.col("raw_adv") + F.col(value))
    return whiten(d, "raw_adv", mask, out="adv")


def step_groups(df, *, group="uid", obs="anchor_obs", out="step_group"):
    """Cluster id of equal observations inside a prompt group."""
    key = F.to_json(F.struct(F.col(group).alias("g"), F.col(obs).alias("o")))
    return df.withColumn(out, F.sha2(key, 256))


def gigpo_advantage(
    df, *, group="uid", obs="anchor_obs", score="score", step_score="returns", weight=1.0, std=False
):
    """Episode advantage inside the prompt group plus weight * step advantage inside the
    group of equal observations."""
    hot = has_hot(df, [group])
    d = normalized_advantage(df, group=[group], score=score, std=std, out="episode_adv", hot=hot)
    # the parts of groups that are not hot are not hot either
    d = normalized_advantage(
        d, group=[group, obs], score=step_score, std=std, own_mean=True, out="step_adv", hot=None if hot else False
    )
    return d.withColumn("adv", F.col("episode_adv") + weight * F.col("step_adv"))


def step_group_sizes(df, *, group="uid", obs="anchor_obs"):
    """How many step groups have each size, for every size from 1 to the largest."""
    sizes = df.groupBy(group, obs).agg(F.count(F.lit(1)).alias("size"))
    hist = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("count"))
    total = hist.agg(F.sum("count"), F.max("size"), F.sum(F.col("size") * F.col("count")))
    total = total.toDF("groups", "largest", "rows")
    grid = total.select("groups", "rows", F.explode(F.sequence(F.lit(1), "largest")).alias("size"))
    return grid.join(hist, "size", "left").select(
        F.col("size").cast("long"),
        F.coalesce("count", F.lit(0)).alias("count"),
        (F.coalesce("count", F.lit(0)) / F.col("groups")).alias("proportion"),
        (F.col("rows") / F.col("groups")).alias("mean_size"),
    )


ESTIMATORS: dict[str, Callable[..., DataFrame]] = {
    "grpo": normalized_advantage,
    "population": population_advantage,
    "passk": passk_advantage,
    "rloo": rloo_advantage,
    "reinforce_pp": reinforce_pp,
    "reinforce_pp_baseline": reinforce_pp_baseline,
    "remax": remax_advantage,
    "gae": gae,
    "gigpo": gigpo_advantage,
}


def advantage(df, *args, estimator: str, **params) -> DataFrame:
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator!r}; known: {sorted(ESTIMATORS)}")
    return ESTIMATORS[estimator](df, *args, **params)


def place_reward(tokens, *, row="row_id", pos="pos", mask="mask", reward="episode_reward", length=None):
    """Episode reward (optionally over the episode length) on the last valid token."""
    d = group_values(tokens, [row], __last=F.max(F.when(F.col(mask) != 0, F.col(pos))))
    r = F.col(reward) if length is None else F.col(reward) / F.col(length)
    return d.withColumn("placed", F.when(F.col(pos) == F.col("__last"), r).otherwise(0.0)).drop("__last")


def invalid_action_penalty(df, coef, *, valid="is_action_valid", columns=("reward",)):
    """Subtract coef from the given last-token scores and step rewards of invalid actions."""
    cost = coef * (1 - F.col(valid).cast("double"))
    return df.withColumns({c: F.col(c) - cost for c in columns})


def valid_action_ratio(df, by=(), *, valid="is_action_valid"):
    return df.groupBy(*by).agg(F.avg(F.col(valid).cast("double")).alias("valid_action_ratio"))


def kl_estimate(logp: Column, ref: Column, kind: str) -> Column:
    d = logp - ref
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return 0.5 * d * d
    if kind in ("low_var_kl", "k3"):
        back = ref - logp
        return F.greatest(F.least(F.exp(back) - back - 1, F.lit(10.0)), F.lit(-10.0))
    raise ValueError(f"unknown KL estimate {kind!r}")


def kl_penalized_reward(df, beta, kind="kl", *, reward="reward", logp="old_logp", ref="ref_logp", mask="mask"):
    kl = kl_estimate(F.col(logp), F.col(ref), kind) * F.col(mask)
    return df.withColumn("kl", kl).withColumn("penalized", F.col(reward) - beta * F.col("kl"))


def mean_sequence_kl(df, *, row="row_id", kl="kl", mask="mask"):
    """Mean over responses of the masked token mean of the KL."""
    per_row = df.groupBy(row).agg(masked_mean(F.col(kl), F.col(mask)).alias("k"))
    return per_row.agg(F.avg("k").alias("mean_kl"))


def agg_loss(df, value: Column, mask: Column, mode="token-mean", *, row="row_id", length: Column | None = None):
    """The four ways a masked token matrix becomes one number. ``length`` is the padded
    width, needed by seq-mean-token-sum-norm only."""
    if mode == "token-mean":
        return df.agg(masked_mean(value, mask).alias("loss"))
    sums = df.groupBy(row).agg(F.sum(value * mask).alias("s"), F.sum(mask).alias("n"))
    if mode == "seq-mean-token-sum":
        return sums.agg(F.avg("s").alias("loss"))
    if mode == "seq-mean-token-mean":
        return sums.agg(F.avg(F.try_divide("s", "n")).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        width = df.agg(F.max("pos")).scalar() if length is None else length
        return sums.agg(F.sum("s").alias("s")).select((F.col("s") / width).alias("loss"))
    raise ValueError(f"unknown loss aggregation {mode!r}")


def clip_columns(df, low=0.2, high=0.2, c=3.0, *, logp="logp", old="old_logp", adv="adv"):
    """Ratio, clipped objective with the dual clip for negative advantages, clip flags."""
    if c <= 1:
        raise ValueError("the dual-clip ratio must be above 1")
    a, ratio = F.col(adv), F.exp(F.col(logp) - F.col(old))
    d = df.withColumns({"ratio": ratio, "neg_kl": F.col(old) - F.col(logp)})
    d = d.withColumns(
        {
            "__l1": -a * F.col("ratio"),
            "__l2": -a * F.greatest(F.lit(1 - low), F.least(F.col("ratio"), F.lit(1 + high))),
        }
    )
    top, cap = F.greatest("__l1", "__l2"), -a * c
    return d.withColumns(
        {
            "objective": F.when(a < 0, F.least(cap, top)).otherwise(top),
            "clipped": (F.col("__l2") > F.col("__l1")).cast("double"),
            "clipped_low": ((top > cap) & (a < 0)).cast("double"),
        }
    ).drop("__l1", "__l2")


def clip_diagnostics(df, *by, mask="mask", **params):
    m = F.col(mask)
    d = clip_columns(df, **params)
    names = {"objective": "pg_loss", "clipped": "clip_frac", "clipped_low": "clip_frac_low", "neg_kl": "ppo_kl"}
    return d.groupBy(*by).agg(*[masked_mean(F.col(c), m).alias(n) for c, n in names.items()])


def sequence_ratio(df, low=0.2, high=0.2, *, row="row_id", logp="logp", old="old_logp", adv="adv", mask="mask"):
    """Sequence-level ratio and clipped objective on every token."""
    diff = (F.col(logp) - F.col(old)) * F.col(mask)
    d = group_values(df, [row], __s=F.sum(diff), __n=F.sum(mask))
    ratio = F.exp(F.least(F.col("__s") / F.greatest("__n", F.lit(1)), F.lit(10.0)))
    d = d.withColumn("seq_ratio", ratio).drop("__s", "__n")
    a, r = F.col(adv), F.col("seq_ratio")
    l1, l2 = -a * r, -a * F.greatest(F.lit(1 - low), F.least(r, F.lit(1 + high)))
    return d.withColumns({"objective": F.greatest(l1, l2), "clipped": (l2 > l1).cast("double")})


def value_diagnostics(df, clip=0.2, *, pred="pred", value="value", returns="returns", mask="mask"):
    """Clipped value loss, clip fraction and explained variance."""
    p, v, r, m = F.col(pred), F.col(value), F.col(returns), F.col(mask)
    bounded = F.greatest(v - clip, F.least(p, v + clip))
    l1, l2 = F.pow(p - r, 2), F.pow(bounded - r, 2)
    inside = lambda c: F.when(m != 0, c)
    return df.agg(
        masked_mean(F.greatest(l1, l2), m).alias("value_loss"),
        masked_mean((l2 > l1).cast("double"), m).alias("clip_frac"),
        (1 - F.var_samp(inside(r - v)) / (F.var_samp(inside(r)) + 1e-5)).alias("explained_var"),
    )


def prob_drift(df, *by, rollout="logp", actor="old_logp", mask="mask"):
    d = F.when(F.col(mask) != 0, F.abs(F.exp(F.col(rollout)) - F.exp(F.col(actor))))
    return df.groupBy(*by).agg(
        F.max(d).alias("diff_max"), F.avg(d).alias("diff_mean"), F.stddev_samp(d).alias("diff_std")
    )


def rloo_multi_source(df, sources: dict[str, tuple[str, float]], n: int, *, row="row_id", pos="pos", group="uid", mask="mask"):
    """Leave-one-out per reward source, weighted sum, suffix sum, whitening.

    ``sources`` maps a reward column to (mask column, weight); every group holds n responses.
    """
    # means of all sources by row, then their sums by group, in one aggregation each
    numbered = list(enumerate(sources.items()))
    shares = []
    for i, (col, (m, _)) in numbered:
        inside = F.when(F.col(m) != 0, F.col(col))
        shares.append((F.try_divide(F.avg(inside), F.count(inside)) * F.count_if(F.col(m) != 0)).alias(f"__g{i}"))
    rows = df.groupBy(group, row).agg(*shares)
    sums = rows.groupBy(group).agg(*[F.sum(f"__g{i}").alias(f"__g{i}") for i, _ in numbered])
    d = drop_keys(df.join(rename_keys(sums, [group]), match([group]), "left"), [group])
    total = F.lit(0.0)
    for i, (col, (m, weight)) in numbered:
        rloo = F.col(col) * (n / (n - 1)) - F.col(f"__g{i}") / (n - 1)
        total = total + F.when(F.col(m) != 0, rloo).otherwise(0.0) * weight
    d = d.withColumn("__r", total * F.col(mask))
    d = discounted(d, [row], pos, 1.0, returns=F.col("__r"))
    d = d.drop("__r", *[f"__g{i}" for i, _ in numbered])
    return whiten(d, "returns", mask, out="adv")


def pairwise_accuracy(df, *, group="uid", order="row_id", score="score", label="label"):
    """Share of the label differences inside a group that the scores order the same way.

    No pair is formed. Labels are ranked inside the group; two unlike ranks part at exactly
    one bit, the higher ones being equal. So a row is read once for each bit of the largest
    rank, and at each bit the rows with a one meet the count and sum of those with a zero:
    before them in (score, order) for the agreeing pairs, all of them for the total.
    """
    levels = rank(df.select(group, label).distinct(), [group], [label], name="__rk")
    levels = group_values(levels, [group], __top=F.max("__rk"))
    named = levels.select(F.col(group).alias("__k0"), F.col(label).alias("__k1"), "__rk", F.length(F.bin("__top")).alias("__bits"))
    d = df.join(named, match([group, label])).drop("__k0", "__k1")
    d = d.withColumn("__bit", F.explode(F.sequence(F.lit(0), F.col("__bits") - 1)))
    d = d.withColumns({"__node": F.expr("shiftright(__rk, __bit + 1)"), "__one": F.expr("shiftright(__rk, __bit) & 1") == 1, "__l": F.col(label).cast("double")})
    keys = [group, "__bit", "__node"]
    low = {"n": F.when(~F.col("__one"), F.lit(1)).otherwise(0), "s": F.when(~F.col("__one"), F.col("__l")).otherwise(0.0)}
    d = running(d, keys, [score, order], **{f"__b{k}": v for k, v in low.items()})
    d = group_values(d, keys, **{f"__a{k}": F.sum(v) for k, v in low.items()})
    per = d.where("__one").groupBy(group).agg(
        F.sum(F.col("__l") * F.col("__bn") - F.col("__bs")).alias("__hit"),
        F.sum(F.col("__l") * F.col("__an") - F.col("__as")).alias("__all"),
    )
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return groups.join(rename_keys(per, [group]), match([group]), "left").select(
        group, F.coalesce(F.try_divide("__hit", "__all"), F.lit(0.5)).alias("accuracy")
    )


def abs_accuracy(df, *by, score="score", label="label"):
    hit = F.signum(F.col(score)) == F.signum(F.col(label) * 2 - 1)
    return df.groupBy(*by).agg(F.avg(hit.cast("double")).alias("abs_accuracy"))


def preference_pairs(df, *, pair="pair_id", order="ord", score="score", logp="logp", ref="ref_logp"):
    """Chosen and rejected response of each pair; a tie goes to the first."""
    best = F.struct((-F.col(score)).alias("s"), F.col(order).alias("o"))
    row = F.struct(F.col(order).alias("ord"), F.col(logp).alias("logp"), F.col(ref).alias("ref"))
    return df.groupBy(pair).agg(F.min_by(row, best).alias("chosen"), F.max_by(row, best).alias("rejected"))


def dpo_loss(pairs, beta, kind="sigmoid", smoothing=0.0, reference_free=False):
    logits = F.col("chosen.logp") - F.col("rejected.logp")
    if not reference_free:
        logits = logits - (F.col("chosen.ref") - F.col("rejected.ref"))
    if kind == "sigmoid":
        nls = lambda x: F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
        loss = nls(beta * logits) * (1 - smoothing) + nls(-beta * logits) * smoothing
    elif kind == "ipo":
        loss = F.pow(logits - 1 / (2 * beta), 2)
    else:
        raise ValueError(f"unknown loss {kind!r}")
    return pairs.withColumn("loss", loss)


CELLS = 4096


def resample_weights(df, method="pow", power=2.0, *, score="score", out="weight"):
    s = F.col(score)
    if method == "pow":
        w = F.pow(F.abs(s), power)
    elif method in ("max_min", "max_random"):
        ends = df.agg(F.struct(F.max(score).alias("hi"), F.min(score).alias("lo"))).scalar()
        df = df.withColumn("__e", ends)
        hi = s == F.col("__e.hi")
        if method == "max_min":
            w = F.when(hi | (s == F.col("__e.lo")), 1.0).otherwise(0.0)
        else:
            w = F.when(hi, 0.4).otherwise(0.1)
    else:
        raise ValueError(f"unknown reweighting {method!r}")
    return df.withColumn(out, w + 1e-8).drop("__e")


def resample(df, seed: int, method="pow", power=2.0, *, order="row_id", score="score"):
    """As many draws with replacement as rows, by weight: inverse CDF of hash uniforms.

    Rows own slices of [0, 1); slices and draws meet on equi-join cells as narrow as one
    row's mean share, so a heavy slice spreads over many cells: first over blocks of
    CELLS, which go to tasks of their own, then over the cells of each.
    """
    weighted = resample_weights(df, method, power, score=score)
    total = weighted.agg(F.sum("weight"), F.count(F.lit(1))).toDF("w", "n")
    d = running(weighted, [], [order], order, __cum=F.col("weight"))
    d = d.withColumn("__t", total.select(F.struct("w", "n")).scalar())
    lo = (F.col("__cum") - F.col("weight")) / F.col("__t.w")
    d = d.withColumns({"__lo": lo, "__hi": F.col("__cum") / F.col("__t.w"), "__n": F.col("__t.n")})
    cell = lambda c: F.floor(c * F.col("__n"))
    d = d.withColumns({"__from": cell(F.col("__lo")), "__to": cell(F.col("__hi"))})
    block = lambda c: F.floor(F.col(c) / CELLS)
    d = d.withColumn("__block", F.explode(F.sequence(block("__from"), block("__to")))).repartition("__block")
    ends = F.greatest("__from", F.col("__block") * CELLS), F.least("__to", F.col("__block") * CELLS + CELLS - 1)
    d = d.withColumn("__cell", F.explode(F.sequence(*ends))).drop("__from", "__to", "__block")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(order))), 1, 12), 16, 10)
    u = u.cast("double") / float(1 << 48)
    n = df.agg(F.count(F.lit(1))).scalar()
    draws = df.select(F.col(order).alias("draw"), u.alias("__u"), n.alias("__m"))
    draws = draws.withColumn("__dc", F.floor(F.col("__u") * F.col("__m")))
    hit = (F.col("__cell") == F.col("__dc")) & (F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi"))
    out = draws.join(d, hit)
    return out.drop("__u", "__m", "__dc", "__t", "__lo", "__hi", "__n", "__cell", "__cum")


def softmean_center(df, beta, *, score="score", out="centered"):
    """r - (logsumexp(beta r) - ln n) / beta over the whole table; beta 0 is the mean."""
    if beta == 0:
        centre = df.agg(F.avg(score)).scalar()
    else:
        top = df.agg(F.max(F.col(score) * beta)).scalar()
        shifted = df.select(F.exp(F.col(score) * beta - top).alias("e"), top.alias("t"))
        lse = shifted.agg(F.log(F.sum("e")) + F.max("t") - F.log(F.count(F.lit(1))))
        centre = lse.scalar() / beta
    return df.withColumn("__c", centre).withColumn(out, F.col(score) - F.col("__c")).drop("__c")
