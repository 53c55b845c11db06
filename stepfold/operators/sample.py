"""Deterministic shuffles, splits, mixing, repeats, chunks and balanced row groups.

Whole-table positions come from ``rank`` with no keys, which numbers ranges of the order
value separately once a table is too large for one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfold.plans.session import checkpoint
from stepfold.plans.skew import (
    beside, first_per_group, group_values, hash_at, has_hot, lookup, rank, running, top_k,
)


def shuffle_hash(seed: int, salt: Column | str, doc_id: Column | str) -> Column:
    salt = F.lit(salt) if isinstance(salt, str) else salt
    ident = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.md5(F.concat_ws(":", F.lit(str(seed)), salt, ident.cast("string")))


def stable_shuffle(df: DataFrame, seed: int, salt: Column | str, *, keys: Sequence[str] = (), doc_id="doc_id", out="position") -> DataFrame:
    """Position of each row in hash order, inside its group or over the table."""
    d = df.withColumn("__h", shuffle_hash(seed, salt, doc_id))
    return rank(d, list(keys), ["__h", doc_id], hash_at(F.col("__h")), out).drop("__h")


def stratum(keys: Sequence[str]) -> Column:
    clean = [F.lower(F.trim(F.coalesce(F.col(k).cast("string"), F.lit("")))) for k in keys]
    return F.concat_ws("||", *[F.when(c == "", "unknown").otherwise(c) for c in clean])


def strata_candidates(df: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """Labels and smallest label count of each candidate key group."""
    out = None
    for i, keys in enumerate(groups):
        counts = df.groupBy(stratum(keys).alias("label")).agg(F.count(F.lit(1)).alias("n"))
        one = counts.agg(F.count(F.lit(1)).alias("labels"), F.min("n").alias("smallest"))
        one = one.select(F.lit(i).alias("ord"), F.lit(",".join(keys)).alias("keys"), "labels", "smallest")
        out = one if out is None else out.unionByName(one)
    return out


def choose_strata(df: DataFrame, groups: Sequence[Sequence[str]], min_count: int = 5) -> list[str] | None:
    """First key group with at least two labels, each frequent enough; one row per group
    reaches the driver."""
    for row in strata_candidates(df, groups).orderBy("ord").collect():
        if row.labels >= 2 and row.smallest >= min_count:
            return list(groups[row.ord])
    return None


def stratified_split(df: DataFrame, strata: Sequence[str] | None, *, ratio=0.2, seed=42, doc_id="doc_id") -> DataFrame:
    """Adds split = train|test: per label the first half-even rounded share in hash order,
    at least one row and not all; without strata the table is one label."""
    d = df.withColumn("label", stratum(strata) if strata else F.lit("all"))
    d = group_values(d, ["label"], __n=F.count(F.lit(1)))
    d = stable_shuffle(d, seed, F.col("label"), keys=["label"], doc_id=doc_id, out="__rn")
    size = F.bround(F.col("__n") * F.lit(ratio)).cast("long")
    size = F.greatest(F.lit(1), F.least(size, F.col("__n") - 1))
    if not strata:
        size = F.when(F.col("__n") > 1, size).otherwise(0)
    return d.withColumn("split", F.when(F.col("__rn") <= size, "test").otherwise("train")).drop("__n", "__rn")


def split_manifest(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("all"), F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") != "train").alias("test"),
    )


def global_val_split(df: DataFrame, *, ratio=0.05, seed=42, benchmark="benchmark_name", doc_id="doc_id") -> DataFrame:
    """Adds split = train_core|global_val: floors per benchmark, the rest by largest
    remainder (ties: name descending)."""
    from pyspark.sql import Window

    sizes = df.groupBy(benchmark).agg(F.count(F.lit(1)).alias("__n"))
    want = F.col("__n") * F.lit(ratio)
    sizes = sizes.withColumns({"__base": F.floor(want), "__rem": want - F.floor(want)})
    total = sizes.agg(F.sum("__n").alias("n"), F.sum("__base").alias("b"))
    target = F.when(F.col("n") > 1, F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(ratio)).cast("long"))).otherwise(0)
    spare = total.select(target - F.col("b")).scalar()
    # one row per benchmark reaches this ordering, never the samples
    w = Window.partitionBy((F.col("__base") < F.col("__n")).alias("__e")).orderBy(F.desc("__rem"), F.desc(benchmark))
    sizes = sizes.withColumns({"__i": F.row_number().over(w), "__sp": spare})
    extra = F.when((F.col("__base") < F.col("__n")) & (F.col("__i") <= F.col("__sp")), 1).otherwise(0)
    sizes = sizes.select(benchmark, (F.col("__base") + extra).alias("__take"))
    d = lookup(df, sizes, [benchmark])
    salt = F.concat(F.lit("global-val:"), F.col(benchmark))
    d = stable_shuffle(d, seed, salt, keys=[benchmark], doc_id=doc_id, out="__rn")
    return d.withColumn("split", F.when(F.col("__rn") <= F.col("__take"), "global_val").otherwise("train_core")).drop("__take", "__rn")


def sqrt_sizes(df: DataFrame, *, benchmark="benchmark_name") -> DataFrame:
    """Original and expanded size and sampling probability of each benchmark."""
    sizes = df.groupBy(benchmark).agg(F.count(F.lit(1)).alias("original_count"))
    top = sizes.agg(F.max("original_count")).scalar()
    want = F.bround(F.sqrt(F.col("original_count").cast("double") * top)).cast("long")
    sizes = sizes.withColumn("expanded_count", F.greatest("original_count", want))
    total = sizes.agg(F.sum("expanded_count")).scalar()
    return sizes.withColumn("sampling_probability", F.col("expanded_count") / total)


def expand_sqrt(df: DataFrame, *, seed=42, benchmark="benchmark_name", doc_id="doc_id") -> DataFrame:
    """Copies of each row so that a benchmark reaches sqrt(n * largest), cycling hash order."""
    d = lookup(df, sqrt_sizes(df, benchmark=benchmark).drop("sampling_probability"), [benchmark])
    d = stable_shuffle(d, seed, F.concat(F.lit("sqrt:"), F.col(benchmark)), keys=[benchmark], doc_id=doc_id, out="__rn")
    n, m = F.col("original_count"), F.col("expanded_count")
    copies = F.floor(m / n) + F.when(F.col("__rn") <= m % n, 1).otherwise(0)
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    return d.drop("original_count", "expanded_count", "__rn")


def mix(dfs: Sequence[DataFrame], strategy: str = "concat", **params) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    if strategy == "concat":
        return out
    if strategy == "sqrt_size":
        return expand_sqrt(out, **params)
    raise ValueError(f"unknown mixing strategy {strategy!r}")


def round_robin_failures(df: DataFrame, *, threshold=0.4, k=10, category="category", reward="reward", order="ord") -> DataFrame:
    """k failures, one per category in name order per round, lowest reward first."""
    bad = df.where(F.col(reward) < threshold).withColumn(category, F.coalesce(category, F.lit("unknown")))
    d = top_k(bad, [category], [F.col(reward), F.col(order)], k, "round")
    return d.orderBy("round", category).limit(k)


def drop_uniform_groups(df: DataFrame, *, group="uid", reward="reward", keep_singletons=False) -> DataFrame:
    d = group_values(df, [group], __lo=F.min(reward), __hi=F.max(reward), __n=F.count(F.lit(1)))
    keep = F.col("__lo") != F.col("__hi")
    if keep_singletons:
        keep = keep | (F.col("__n") == 1)
    return d.where(keep).drop("__lo", "__hi", "__n")


def fill_to_target(df: DataFrame, n_groups: int, *, batch="batch", group="uid") -> DataFrame:
    """Rows of the first n groups in (batch, group) order."""
    firsts = rank(df.groupBy(group).agg(F.min(batch).alias("__b")), [], ["__b", group], name="__rn").where(F.col("__rn") <= n_groups)
    return df.join(firsts.select(group), group, "left_semi")


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_group(df, keys, order)


def recent_history(steps: DataFrame, n: int, *, traj="traj_uid", step="step", obs="obs", action="action", style="brackets") -> DataFrame:
    """Rendering of each step's last n steps, itself included, and how many there were."""
    from pyspark.sql import Window

    num = F.col(step).cast("string")
    if style == "brackets":
        line = F.concat(F.lit("[Observation "), num, F.lit(": '"), obs, F.lit("', Action "), num, F.lit(": '"), action, F.lit("']"))
    else:
        line = F.concat(F.lit("Step "), num, F.lit(":"), action, F.lit(" "), obs, F.lit("\n"))
    d = steps.withColumn("__line", line)
    if not has_hot(d, [traj]):
        w = Window.partitionBy(traj).orderBy(step).rowsBetween(-(n - 1), 0)
        d = d.withColumn("__l", F.collect_list("__line").over(w))
        return d.select(*steps.columns, F.array_join("__l", "\n").alias("history"), F.size("__l").cast("long").alias("valid_length"))
    # a long trajectory: rows are numbered, and each is sent to the at most n rows it is visible from
    d = rank(d, [traj], [step], name="__rn")
    sent = d.select(F.col(traj).alias("__k0"), "__rn", "__line", F.explode(F.sequence(F.col("__rn"), F.col("__rn") + n - 1)).alias("__k1"))
    g = sent.groupBy("__k0", "__k1").agg(F.array_sort(F.collect_list(F.struct("__rn", "__line"))).alias("__l"))
    g = g.select("__k0", "__k1", F.transform("__l", lambda x: x["__line"]).alias("__l"))
    d = d.join(g, F.col(traj).eqNullSafe(F.col("__k0")) & (F.col("__rn") == F.col("__k1")))
    return d.select(*steps.columns, F.array_join("__l", "\n").alias("history"), F.size("__l").cast("long").alias("valid_length"))


def token_budget_prefix(df: DataFrame, budget: int, *, keys: Sequence[str], order: Sequence[Column], at: Column, text="text") -> DataFrame:
    """Items in order while their running token estimate stays inside the budget. Costs are
    not negative, so everything after the first overflow is over too."""
    d = running(df, keys, order, at, used=F.floor(F.length(text) / 4))
    return d.where(F.col("used") <= budget)


def _total(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def pad_to_divisor(df: DataFrame, divisor: int, *, order: str) -> DataFrame:
    """Appends first rows cyclically up to the next multiple; adds position and padded."""
    d = rank(df, [], [order], order, "__rn").withColumn("__n", _total(df))
    pad = F.pmod(-F.col("__n"), F.lit(divisor))
    copies = F.floor(pad / F.col("__n")) + F.when(F.col("__rn") <= pad % F.col("__n"), 1).otherwise(0)
    d = d.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), copies)))
    return d.withColumns(
        {"position": F.col("__rn") + F.col("__k") * F.col("__n"), "padded": F.col("__k") > 0}
    ).drop("__rn", "__n", "__k")


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("padded")).drop("padded")


def adjust_to_divisor(df: DataFrame, divisor: int, mode: str, *, seed=0, key: str) -> DataFrame:
    """Copies or deletes hash-chosen rows until the count divides; fewer than ``divisor``
    rows are chosen, so the chosen side is a bounded broadcast."""
    if mode not in ("copy", "delete"):
        raise ValueError(f"unknown mode {mode!r}")
    over = _total(df) % divisor
    chosen = df.select(key, shuffle_hash(seed, mode, key).alias("__h")).orderBy("__h", key).limit(divisor)
    chosen = top_k(chosen.withColumn("__g", F.lit(0)), ["__g"], [F.col("__h"), F.col(key)], divisor, "__r").withColumn("__over", over)
    need = F.col("__over") if mode == "delete" else F.pmod(-F.col("__over"), F.lit(divisor))
    chosen = chosen.where(F.col("__r") <= need).select(key)
    if mode == "delete":
        return df.join(F.broadcast(chosen), key, "left_anti")
    return df.unionByName(df.join(F.broadcast(chosen), key, "left_semi"))


def repeat_rows(df: DataFrame, n: int, *, order: str, interleave: bool = True) -> DataFrame:
    """n copies of each row: a a b b, or a b a b; adds position."""
    d = rank(df, [], [order], order, "__rn").withColumn("__n", _total(df))
    d = d.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    inter = (F.col("__rn") - 1) * n + F.col("__k") + 1
    tile = F.col("__k") * F.col("__n") + F.col("__rn")
    return d.withColumn("position", inter if interleave else tile).drop("__rn", "__n", "__k")


def repeat_by(df: DataFrame, times: str, *, order: str) -> DataFrame:
    """Each row as often as its own count says; adds position."""
    d = running(df, [], [order], order, __end=F.col(times).cast("long"))
    d = d.where(F.col(times) > 0).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    return d.withColumn("position", F.col("__end") - F.col(times) + F.col("__k")).drop("__end", "__k")


def chunk_rows(df: DataFrame, k: int, *, order: str, padding: bool = False) -> DataFrame:
    """k equal contiguous chunks by order; an error when k does not divide, unless padding."""
    d = df
    if padding:
        d = pad_to_divisor(df, k, order=order).drop(order).withColumnRenamed("position", order)
    d = rank(d, [], [order], order, "__rn").withColumn("__n", _total(d))
    size = F.col("__n") / k
    bad = F.raise_error(F.concat(F.lit(f"row count is not divisible by {k}: "), F.col("__n").cast("string"))).cast("long")
    chunk = F.when(F.col("__n") % k != 0, bad).otherwise(F.floor((F.col("__rn") - 1) / size))
    return d.withColumn("chunk", chunk).drop("__rn", "__n")


def fold(df: DataFrame, size: int, *, order: str) -> DataFrame:
    """Every ``size`` consecutive rows as one row of arrays."""
    d = rank(df, [], [order], order, "__rn").withColumn("fold", F.floor((F.col("__rn") - 1) / size))
    cols = [c for c in df.columns if c != order]
    packed = F.array_sort(F.collect_list(F.struct("__rn", *cols)))
    g = d.groupBy("fold").agg(packed.alias("__p"))
    return g.select("fold", *[F.transform("__p", lambda x: x[c]).alias(c) for c in cols])


def unfold(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    z = F.arrays_zip(*columns)
    rest = [c for c in df.columns if c not in columns]
    d = df.select(*rest, F.posexplode(z).alias("part", "__z"))
    return d.select(*rest, "part", *[F.col(f"__z.{c}").alias(c) for c in columns])


def unfold_column_chunks(df: DataFrame, n: int, split: Sequence[str]) -> DataFrame:
    """Splits array columns into n equal slices, one row each; other columns repeat."""
    rest = [c for c in df.columns if c not in split]
    d = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cut = lambda c: F.slice(c, (F.col("part") * F.size(c) / n + 1).cast("int"), (F.size(c) / n).cast("int"))
    return d.select(*rest, "part", *[cut(c).alias(c) for c in split])


def balanced_partitions(df: DataFrame, k: int, *, length="length", key="id", out="part") -> DataFrame:
    """Rows dealt to k groups of near-equal size and token sum: longest first, back and forth."""
    d = df.withColumn("__h", F.md5(F.col(key).cast("string")))
    at = -F.col(length) + hash_at(F.col("__h")) / float(1 << 33)
    d = rank(d, [], [F.desc(length), F.col("__h"), F.col(key)], at, "__rn")
    lap, slot = F.floor((F.col("__rn") - 1) / k), (F.col("__rn") - 1) % k
    return d.withColumn(out, F.when(lap % 2 == 0, slot).otherwise(k - 1 - slot)).drop("__h", "__rn")


def _differencing(block: pd.DataFrame, k: int, length: str, out: str) -> pd.DataFrame:
    """Largest differencing: merge the two most uneven partial divisions until one is left."""
    import heapq

    heap = []
    for i, n in enumerate(block[length].tolist()):
        sums = [(n, (i,))] + [(0, ())] * (k - 1)
        heapq.heappush(heap, (-n, i, sums))
    tie = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        pairs = zip(a, sorted(b, key=lambda s: s[0]))
        merged = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in pairs), key=lambda s: -s[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], tie, merged))
        tie += 1
    part = [0] * len(block)
    for g, (_, rows) in enumerate(heap[0][2]):
        for i in rows:
            part[i] = g
    return block.assign(**{out: part})


def balanced_blocks(df: DataFrame, k: int, *, length="length", key="id", out="part", block_rows: int = 2048) -> DataFrame:
    """Differencing inside blocks of at most ``block_rows`` rows of similar length mix; each
    block deals to all k groups, the heaviest block share going to a rotating group."""
    d = df.withColumn("__h", F.md5(F.col(key).cast("string")))
    d = rank(d, [], ["__h", F.col(key)], hash_at(F.col("__h")), "__rn")
    d = d.withColumn("__blk", F.floor((F.col("__rn") - 1) / block_rows)).drop("__h", "__rn")
    schema = T.StructType([*d.schema.fields, T.StructField(out, T.IntegerType())])

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        done = _differencing(pdf.sort_values([length, key], ascending=False).reset_index(drop=True), k, length, out)
        done[out] = (done[out] + int(pdf["__blk"].iloc[0])) % k
        return done

    return d.groupBy("__blk").applyInPandas(deal, schema).drop("__blk")


def micro_batches(df: DataFrame, max_tokens: int, *, length="length", key="id", min_count=1, divisor=1) -> DataFrame:
    """Number of micro batches from the token total, then balanced groups. The count is one
    number and decides the plan, so it is computed first."""
    row = micro_batch_count(df, max_tokens, length=length, min_count=min_count, divisor=divisor).first()
    return balanced_partitions(df, int(row.count_), length=length, key=key, out="micro_batch")


def micro_batch_count(df: DataFrame, max_tokens: int, *, length="length", min_count=1, divisor=1) -> DataFrame:
    n = F.count(F.lit(1))
    want = F.greatest(F.least(n, F.ceil(F.sum(length) / max_tokens)), F.lit(min_count).cast("long"))
    return df.agg((F.ceil(want / divisor) * divisor).alias("count_"))


def length_imbalance(df: DataFrame, k: int, *, order="id", length="length", part="part") -> DataFrame:
    """Token sums of k contiguous chunks against the balanced groups."""
    d = rank(df, [], [order], order, "__rn").withColumn("__n", _total(df))
    d = d.withColumn("__c", F.floor((F.col("__rn") - 1) / F.floor(F.col("__n") / k)))
    before = d.groupBy("__c").agg(F.sum(length).alias("s")).agg(
        F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("minmax_diff"), (F.sum("s") / k).alias("mean"))
    after = df.groupBy(part).agg(F.sum(length).alias("s")).agg(F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max"))
    return beside(before, after)


def sample_generations(df: DataFrame, n: int, seed: int, *, text="input") -> DataFrame:
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), text)), text).limit(n)


def paginate(df: DataFrame, page: int, size: int, *, order: Sequence[str], rows: int = 100_000, cuts: int = 128, report: list | None = None) -> DataFrame:
    """Rows (page - 1) * size .. page * size in ``order`` (ascending, nulls first; ties by a hash
    of the row).

    A directory narrows the table down to the page: up to ``cuts`` sampled keys cut it into
    ranges, one pass counts them, and only the ranges that hold the page go on, until they have
    no more than ``rows`` rows, which are sorted. No task gets the rows before the page, and
    nothing is shuffled but counts. A page within the first ``rows`` rows needs no directory:
    each task keeps its first rows up to the page's end. ``report`` gets the size of what was sorted.
    """
    key = F.struct(*order, F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]).alias("__row"))
    d, skip, most = df.withColumn("__key", key), (page - 1) * size, max(rows, 2 * size)
    if skip + size <= most:
        if report is not None:
            report.append(skip + size)
        return d.orderBy("__key").limit(skip + size).offset(skip).drop("__key")
    step = math.isqrt(cuts) + 1
    left, level = None, 0
    while left is None or left > most:
        level += 1
        some = d.select("__key").orderBy(F.rand(level)).limit(cuts)  # where it cuts, the page does not depend on
        at = checkpoint(some).agg(F.array_sort(F.collect_set("__key"))).scalar()
        # every step-th cut first, then those between two of them
        low = lambda a: F.size(F.filter(a, lambda s: s <= F.col("__key")))
        ranged = d.withColumn("__at", at).withColumn("__far", F.filter("__at", lambda s, i: i % step == 0))
        ranged = ranged.withColumn("__far", F.greatest(low("__far") - 1, F.lit(0)) * step)
        ranged = ranged.withColumn("__range", F.col("__far") + low(F.slice("__at", F.col("__far") + 1, step))).drop("__at", "__far")
        sizes = sorted((r["__range"], r["n"]) for r in ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect())
        total, before, held = sum(n for _, n in sizes), 0, []
        for name, n in sizes:
            if before < skip + size and before + n > skip:
                held.append((name, n, before))
            before += n
        if not held:
            left, d = 0, d.limit(0)
            break
        kept = sum(n for _, n, _ in held)
        d = ranged.where(F.col("__range").between(held[0][0], held[-1][0])).drop("__range")
        skip -= held[0][2]
        left = kept
        if kept == total > most:
            low, high = d.agg(F.min("__key"), F.max("__key")).first()
            if low == high:  # rows that are equal in all columns: any of them
                skip, left, d = 0, size, d.limit(size)
            elif len(held) > 1:  # a page over the end of such a run
                break
    if report is not None:
        report.append(left)
    return d.orderBy("__key").offset(skip).limit(size).drop("__key")


def concat_batches(dfs: Sequence[DataFrame]) -> DataFrame:
    out = None
    for i, d in enumerate(dfs):
        d = d.withColumn("batch", F.lit(i).cast("long"))
        out = d if out is None else out.unionByName(d)
    return out


def missing_ids(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(actual.select(key), key, "left_anti")


def ambiguous_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def library_diff(old: DataFrame, new: DataFrame, *, key="exp_id", text="text") -> DataFrame:
    """new, updated and deleted ids between two versions, by text hash."""
    a = old.select(key, F.sha2(text, 256).alias("__a"))
    b = new.select(key, F.sha2(text, 256).alias("__b"))
    d = a.join(b, key, "full")
    kind = F.when(F.col("__a").isNull(), "new").when(F.col("__b").isNull(), "deleted").when(F.col("__a") != F.col("__b"), "updated")
    return d.withColumn("change", kind).where("change IS NOT NULL").select(key, "change")
