"""Best, worst and majority of n draws with replacement: exact, and by a seeded bootstrap.

Exact majority. Draws fall into vote classes; the class drawn most often wins, and of several
the one drawn first. All orders of the draws are equally likely, so t classes that tie share
the win equally, and the value is that of a random row of the winner. The chance that a class
wins with m draws while t - 1 others tie is a coefficient of a product of polynomials, one
for each class, in the number of draws and the number of ties. Counts are written as Poisson
weights, whose product only has to be divided by the weight of n, so nothing overflows. Rows
are first aggregated to classes and classes to sizes; what a task folds is one array of
(size, number of classes of it), at most about sqrt(2 N) entries for a group of N rows. The work of
multiplying grows with (classes x n^3), so it is for up to ``EXACT`` draws and classes. Beyond, the product is
taken at roots of unity, where classes of a size are a power, and ties are an integral: the share 1 / t of t
that tie is the integral of y^(t - 1). Only counts with a chance over e^-60 of the likeliest one are gone
through, less than what doubles round away, so the work grows with (sizes x n), about.

Bootstrap. A draw is the md5 of (seed, group, iteration, draw), so any task can repeat it and
the number of partitions does not matter. A group of up to ``PACKED`` rows is one array, and its
draws are made and reduced in the task that holds it. The draws of a larger group meet its ranked
rows in a sorted equi-join on (group, position); they are never broadcast, as the planner, which
does not see that rows are spelled out, would have it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfold.plans.skew import exceeds, group_values, match, rank, rename_keys

#: Draws and classes up to which the product of polynomials is multiplied out.
EXACT = 64
#: Rows of a group that may lie in one array.
PACKED = 4096


def powers_of_two(size: Column) -> Column:
    """2, 4, ... below ``size``, and ``size`` itself; none for a single row."""
    top = F.ceil(F.log2(size.cast("double"))).cast("int")
    steps = F.transform(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), lambda i: F.least(F.pow(F.lit(2.0), i), size.cast("double")).cast("long"))
    return F.when(size > 1, F.array_distinct(steps)).otherwise(F.array().cast("array<long>"))


@lru_cache(maxsize=1 << 16)
def winning(sizes: tuple, classes: tuple, n: int) -> np.ndarray:
    """For each size, the chance that one of its classes wins n draws. It depends on the pattern
    of sizes alone, which few of many groups have to themselves, so a task's worker keeps it."""
    held, rows = np.array(classes, np.float64), np.array(sizes, np.float64)
    if n > EXACT or held.sum() > EXACT:
        return majority_chances(rows, held, n)
    return majority_moments(rows, held, np.diag(held), n) / held


def majority_moments(sizes: np.ndarray, classes: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """Sum over classes of P(class wins n draws) x its value, for each row of ``sums``.

    ``classes`` of them have ``sizes`` rows each, and their values add up to ``sums``.
    """
    rate = n * sizes / (sizes * classes).sum()
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    place = np.arange(n + 1)
    weight = np.exp(place * np.log(rate)[:, None] - rate[:, None] - logs)  # class size x draws
    out = np.zeros(len(sums))
    for m in range(1, n + 1):
        ties = n // m + 1
        without, won = np.zeros((ties, n + 1)), np.zeros((len(sums), ties, n + 1))
        without[0, 0] = 1
        for w, k, value in zip(weight, classes, (sums / classes).T):
            fewer = np.zeros((n + 1, n + 1))
            for i in range(m):
                fewer[place[: n + 1 - i], place[: n + 1 - i] + i] = w[i]

            def step(x: np.ndarray) -> np.ndarray:
                out = x @ fewer
                out[..., 1:, m:] += x[..., :-1, : n + 1 - m] * w[m]
                return out

            for _ in range(int(k)):
                ahead = step(won)
                ahead[:, :, m:] += value[:, None, None] * without[:, : n + 1 - m] * w[m]
                won, without = ahead, step(without)
        out += (won[:, :, n] / np.arange(1, ties + 1)).sum(axis=1)
    return out / np.exp(n * np.log(n) - n - logs[n])


def poisson(rate: float) -> tuple[int, np.ndarray]:
    """The first count, and the chances from it on, of the counts that are over e^-60 of the likeliest."""
    mode, reach = int(rate), int(11 * np.sqrt(rate)) + 45
    up = np.cumsum(np.log(rate / np.arange(mode + 1, mode + reach + 1)))
    down = np.cumsum(np.log(np.arange(mode, max(mode - reach, 0), -1) / rate))
    logs = np.concatenate([down[::-1], [0.0], up])
    keep = np.flatnonzero(logs > -60)
    chance = np.exp(logs[keep])
    return mode - len(down) + int(keep[0]), chance / chance.sum()


@lru_cache(maxsize=1 << 10)
def tie_nodes(degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in 0 to 1 and their weights, that integrate polynomials of the degree. For many
    they lie in panels that halve towards 1, as high powers do."""
    if degree < 64:
        at, weight = np.polynomial.legendre.leggauss(degree // 2 + 1)
        return (at + 1) / 2, weight / 2
    at, weight = np.polynomial.legendre.leggauss(24)
    ends = np.append(1 - 0.5 ** np.arange(degree.bit_length() + 1), 1.0)
    width = np.diff(ends)[:, None]
    return (ends[:-1, None] + width * (at + 1) / 2).ravel(), (width * weight / 2).ravel()


def majority_chances(sizes: np.ndarray, classes: np.ndarray, n: int) -> np.ndarray:
    """For each size, the chance that one of its classes wins n draws, for many draws or classes."""
    whole, every = (sizes * classes).sum(), int(classes.sum())
    if len(sizes) == 1:
        return 1 / classes
    first, total = poisson(n)
    # so many turns that no other likely number of draws comes to the same place
    turns = max(n - first, first + len(total) - 1 - n) + 1
    place = np.arange(turns // 2 + 1)
    fold = np.where((place == 0) | (2 * place == turns), 1.0, 2.0)
    root = np.exp(2j * np.pi * np.arange(turns) / turns)
    drawn = [poisson(n * s / whole) for s in sizes]
    least, most = max(1, -(-n // every), *(a for a, _ in drawn)), min(n, max(a + len(w) - 1 for a, w in drawn))
    below = np.zeros((len(sizes), len(place)), complex)  # of each size, the counts under m
    for i, (a, w) in enumerate(drawn):
        w = w[: max(least - a, 0)]
        below[i] = np.conj(np.fft.rfft(np.bincount(np.arange(a, a + len(w)) % turns, w, turns)))
    out, back = np.zeros(len(sizes)), np.conj(root[place * n % turns]) * fold / turns
    more = (classes - 1)[:, None]
    for m in range(least, most + 1):
        here = np.array([w[m - a] if 0 <= m - a < len(w) else 0.0 for a, w in drawn])
        turn = root[place * m % turns]
        tie, (at, weight) = here[:, None] * turn, tie_nodes(min(n // m, every) - 1)
        for y, share in zip(at, weight):
            f = below + y * tie
            ahead, behind = np.ones_like(f), np.ones_like(f)
            np.cumprod(f[:-1], axis=0, out=ahead[1:])
            behind[:-1] = np.cumprod(f[:0:-1], axis=0)[::-1]
            rest = np.where(more > 0, f ** more, 1).prod(axis=0)
            out += share * here * ((ahead * behind) @ (rest * turn * back)).real
        below += tie
    return out / total[n - first]


def majority_exact(df: DataFrame, keys: Sequence[str], ns: Sequence[int] | None = None, *, vote="pred", value="val", most: int | None = EXACT) -> DataFrame:
    """Exact mean and std of the majority value of n draws with replacement (maj_mean, maj_std).
    Without ``ns``: 2, 4, ... and the group size, as far as ``most`` (None: all). A null vote is a
    vote; rows without a value are not drawn."""
    keys = list(keys)
    if ns is not None and most is not None and max(ns) > most:
        raise ValueError(f"exact for up to {most} draws")
    v = F.col(value).cast("double")
    per = df.where(v.isNotNull()).groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("__c"), F.avg(v).alias("__m"), F.avg(v * v).alias("__s"))
    of = per.groupBy(*keys, "__c").agg(F.count(F.lit(1)).alias("__k"), F.sum("__m").alias("__m"), F.sum("__s").alias("__s"))
    packed = of.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__c", "__k", "__m", "__s"))).alias("__r"), F.sum(F.col("__c") * F.col("__k")).alias("__n"))
    wanted = F.array(*[F.lit(int(n)).cast("long") for n in ns]) if ns is not None else powers_of_two(F.col("__n"))
    wanted = wanted if ns is not None or most is None else F.filter(wanted, lambda n: n <= most)
    column = lambda c: F.transform("__r", lambda x: x[c].cast("double")).alias(c)
    each = packed.select(*keys, F.explode(wanted).alias("n"), *map(column, ("__c", "__k", "__m", "__s")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes = (batch.column(c).to_pylist() for c in ("__c", "__k"))
            chance = [winning(tuple(c), tuple(k), n) for c, k, n in zip(sizes, classes, batch.column("n").to_pylist())]
            m, flat = np.zeros((len(batch), 2)), np.concatenate(chance) if chance else np.zeros(0)
            of = np.repeat(np.arange(len(batch)), [len(c) for c in chance])
            for i, c in enumerate(("__m", "__s")):  # sums over the classes of a size, all equally likely
                m[:, i] = np.bincount(of, flat * batch.column(c).flatten().to_numpy(zero_copy_only=False), len(batch))
            sd = np.sqrt(np.maximum(m[:, 1] - m[:, 0] ** 2, 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*keys, "n")), pa.array(m[:, 0]), pa.array(sd)], names=[*keys, "n", "maj_mean", "maj_std"])

    schema = T.StructType([each.schema[c] for c in (*keys, "n")] + [T.StructField(c, T.DoubleType()) for c in ("maj_mean", "maj_std")])
    return each.mapInArrow(run, schema)


def drawn(df: DataFrame, keys: Sequence[str], ns: Sequence[int] | None, columns: Sequence[str], *, rounds: int, seed: int, order: str) -> DataFrame:
    """keys, n, __b, __j and ``columns`` of the row that draw __j of iteration __b takes."""
    keys = list(keys)

    def spell(groups: DataFrame) -> DataFrame:
        wanted = powers_of_two(F.col("__n")) if ns is None else F.array(*[F.lit(int(n)).cast("long") for n in ns])
        draws = groups.withColumn("n", F.explode(wanted)).withColumn("__b", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
        draws = draws.withColumn("__j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        name = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*keys, "n", "__b", "__j")])
        return draws.withColumn("__pos", F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long") % F.col("__n") + 1)

    def packed(rows: DataFrame) -> DataFrame:
        held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("__r"))
        draws = spell(held.withColumn("__n", F.size("__r").cast("long"))).withColumn("__r", F.col("__r")[(F.col("__pos") - 1).cast("int")])
        return draws.select(*keys, "n", "__b", "__j", *[F.col(f"__r.{c}").alias(c) for c in columns])

    def joined(rows: DataFrame) -> DataFrame:
        ranked = rank(rows, keys, [order], order, "__pos").select(*keys, "__pos", *columns)
        draws = spell(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
        return draws.hint("merge").join(rename_keys(ranked, [*keys, "__pos"]), match([*keys, "__pos"])).select(*keys, "n", "__b", "__j", *columns)

    if not exceeds(df, keys, PACKED):
        return packed(df)
    sized = group_values(df, keys, __n=F.count(F.lit(1)))
    return packed(sized.where(F.col("__n") <= PACKED)).unionByName(joined(sized.where(F.col("__n") > PACKED).drop("__n")))


def bootstrap_at_n(df: DataFrame, keys: Sequence[str], value: str, ns: Sequence[int] | None = None, *, rounds=1000, seed=42, order="ord") -> DataFrame:
    """Bootstrap mean and std of the best and worst of n draws with replacement. ``order`` is
    unique in a group; rows without a value are not drawn."""
    keys = list(keys)
    d = drawn(df.where(F.col(value).isNotNull()), keys, ns, [value], rounds=rounds, seed=seed, order=order)
    per = d.groupBy(*keys, "n", "__b").agg(F.max(value).alias("__h"), F.min(value).alias("__l"))
    return per.groupBy(*keys, "n").agg(*[f(c).alias(f"{w}_{s}") for w, c in (("best", "__h"), ("worst", "__l")) for s, f in (("mean", F.avg), ("std", F.stddev_pop))])


def majority_value(df: DataFrame, keys: Sequence[str], *, vote="pred", value="val", order="ord") -> DataFrame:
    """Value of the first row of the most frequent vote; on a tie the vote seen first."""
    per = df.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__o"), F.min_by(value, order).alias("__v"))
    return per.groupBy(*keys).agg(F.max_by("__v", F.struct("__n", -F.col("__o"))).alias("majority"))


def majority_at_n(df: DataFrame, keys: Sequence[str], n: int, *, rounds=1000, seed=42, vote="pred", value="val", order="ord") -> DataFrame:
    """Bootstrap mean and std of the majority value of n draws with replacement."""
    keys = list(keys)
    d = drawn(df, keys, [n], [vote, value], rounds=rounds, seed=seed, order=order).drop("n")
    per = majority_value(d, [*keys, "__b"], vote=vote, value=value, order="__j")
    return per.groupBy(*keys).agg(F.avg("majority").alias("maj_mean"), F.stddev_pop("majority").alias("maj_std"))
