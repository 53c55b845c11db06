"""Per-group values, ranks and running sums that survive a group holding a third of all rows.

A counting pass over the key columns (partial aggregation) tells whether any group exceeds
``hot_rows`` rows. Without one, an operator is a plain window, and Catalyst sees nothing
else. With one, its rows are never gathered in one task, and the result is the same:

* group values are an aggregation joined back to the rows; the adaptive planner splits the
  join's skewed keys;
* ranks and running sums sort all rows into sampled ranges of (keys, order) and add the
  totals of the ranges before, so a group spreads over as many ranges as it fills, however
  its order values are distributed and wherever its nulls stand.

Lookups are plain joins whose skewed keys the adaptive planner splits; null keys match nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.plans.session import checkpoint

RANGE_ROWS = 65_536


def hot_rows(df: DataFrame) -> int:
    """Rows above which a group is split (session setting ``stepfold.hotRows``)."""
    return int(df.sparkSession.conf.get("stepfold.hotRows", "1000000"))


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def match(keys: Sequence[str], prefix: str = "__k") -> Column:
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"{prefix}{i}"))
    return cond


def rename_keys(df: DataFrame, keys: Sequence[str], prefix: str = "__k") -> DataFrame:
    return df.withColumnsRenamed({k: f"{prefix}{i}" for i, k in enumerate(keys)})


def drop_keys(df: DataFrame, keys: Sequence[str], *extra: str, prefix: str = "__k") -> DataFrame:
    return df.drop(*[f"{prefix}{i}" for i in range(len(keys))], *extra)


def exceeds(df: DataFrame, keys: Sequence[str], rows: int) -> bool:
    """Whether a group has more than ``rows`` rows: one pass over the keys, partial counts first."""
    counted = df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return (counted.agg(F.max("__rows")).first()[0] or 0) > rows


def has_hot(df: DataFrame, keys: Sequence[str]) -> bool:
    """Streams are taken as not hot: a micro batch is bounded by its trigger."""
    return not df.isStreaming and exceeds(df, keys, hot_rows(df))


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint an input whose plan already shuffles; a plain scan is cheaper re-read."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return checkpoint(df) if re.search(r"Join|Aggregate|Window|Sort|Generate", plan) else df


def group_values(df: DataFrame, keys: Sequence[str], *, hot: bool | None = None, **aggs: Column) -> DataFrame:
    """Add group aggregates to every row: one shuffle on ``keys``, or with hot groups an
    aggregation joined back. ``hot`` tells whether there are any where the caller knows it."""
    keys = list(keys)
    if not (has_hot(df, keys) if hot is None else hot):
        w = Window.partitionBy(*keys)
        return df.withColumns({n: a.over(w) for n, a in aggs.items()})
    df = settle(df)
    stats = df.groupBy(*keys).agg(*[a.alias(f"__h_{n}") for n, a in aggs.items()])
    out = df.join(rename_keys(stats, keys), match(keys), "left")
    out = out.withColumns({n: F.col(f"__h_{n}") for n in aggs})
    return drop_keys(out, keys, *[f"__h_{n}" for n in aggs])


def lookup(df: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a dimension that is unique on ``keys``. Null keys match nothing. Skewed keys are
    split at run time (``configure`` has the planner do so even where it costs a shuffle)."""
    return df.join(dim, list(keys), how)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    at: Column | str | None = None,
    hot: bool | None = None,
    **values: Column,
) -> DataFrame:
    """Inclusive running sums of ``values`` inside each group (no keys: over the table).

    ``at`` is not needed: hot groups are cut along ``order`` itself. Rows that tie in
    ``order`` stay in one range, so give it a tie-breaker. ``hot`` tells whether there are
    hot groups where the caller knows it.
    """
    keys = list(keys)
    plain = not keys
    if plain:
        df, keys = df.withColumn("__all", F.lit(0)), ["__all"]
    if not (has_hot(df, keys) if hot is None else hot):
        w = Window.partitionBy(*keys).orderBy(*order)
        w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({n: F.sum(v).over(w) for n, v in values.items()}).drop("__all")
    # written down, so that a range keeps its rows when a task is run again
    d = checkpoint(df.repartitionByRange(*keys, *order).withColumn("__b", F.spark_partition_id()))
    totals = d.groupBy(*keys, "__b").agg(*[F.sum(v).alias(f"__t_{n}") for n, v in values.items()])
    # only groups that reach over a range's end have totals to carry: two a range at most
    spread = Window.partitionBy(*keys)
    totals = totals.withColumns({"__lo": F.min("__b").over(spread), "__hi": F.max("__b").over(spread)}).where("__lo < __hi")
    before = spread.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"__t_{n}": F.sum(f"__t_{n}").over(before) for n in values}).drop("__lo", "__hi")
    w = Window.partitionBy(*keys, "__b").orderBy(*order)
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({f"__r_{n}": F.sum(v).over(w) for n, v in values.items()})
    both = [*keys, "__b"]
    d = d.join(rename_keys(totals, both), match(both), "left")
    own, past = {n: F.col(f"__r_{n}") for n in values}, {n: F.col(f"__t_{n}") for n in values}
    d = d.withColumns({n: F.coalesce(own[n] + past[n], own[n], past[n]) for n in values})
    d = drop_keys(d, both, "__b", *[f"__{p}_{n}" for p in "tr" for n in values])
    return d.drop("__all")


def rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    at: Column | str | None = None,
    name: str = "rn",
) -> DataFrame:
    """``row_number`` inside each group (no keys: over the whole table) as a long."""
    if keys and not has_hot(df, keys):
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    return running(df, keys, order, at, **{name: F.lit(1).cast("long")})


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rn"):
    """First k rows per group. The rank filter becomes a per-task group limit before the
    shuffle, so no task receives more than k rows of a group from each upstream task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Whole first row of each group by ``order``: partial aggregation, no window."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[as_col(o).alias(f"o{i}") for i, o in enumerate(order)])
    row = F.min_by(F.struct(*[F.col(c) for c in rest]), by)
    return df.groupBy(*keys).agg(row.alias("__row")).select(*keys, "__row.*").select(*df.columns)


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row tables as one row: the right one is a scalar subquery, not a join."""
    row = right.select(F.struct(*right.columns)).scalar()
    return left.withColumn("__right", row).select(*left.columns, "__right.*")


def hash_at(hex_col: Column) -> Column:
    """Order position of a hex digest (its first 32 bits)."""
    return F.conv(F.substring(hex_col, 1, 8), 16, 10).cast("double")


def discounted(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    gamma: float,
    first: int = 1,
    **values: Column,
) -> DataFrame:
    """S_t = sum over j >= t of gamma^(j-t) * v_j along dense integer positions.

    Positions fall into blocks short enough that gamma^block stays above 1e-150; a block
    is one window group, and only the value at the head of the next block is carried in, so
    groups may be of any length. Without hot groups the next block is looked up in the same
    partition; with them (or where heads need a scan) heads are aggregated and joined.
    What lies further ahead weighs below 1e-100 of it, less than double rounding, unless
    the block length was bounded by RANGE_ROWS: then the heads get a scan of their own.
    """
    keys = list(keys)
    if gamma == 0:
        return df.withColumns(values)
    digits = -math.log10(gamma) if gamma < 1 else 0.0
    m = RANGE_ROWS if digits == 0 else max(1, min(RANGE_ROWS, int(150 / digits)))
    p = (F.col(pos) - first).cast("long")
    g = F.lit(float(gamma))

    def weigh(c: Column, off: Column) -> Column:
        return c if gamma == 1 else c * F.pow(g, off)

    d = df.withColumns({"__b": F.floor(p / m), "__o": p % m})
    w = Window.partitionBy(*keys, "__b").orderBy(F.desc(pos))
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {f"__r_{n}": F.sum(weigh(v, F.col("__o"))).over(w) for n, v in values.items()}
    down = (lambda c: c) if gamma == 1 else (lambda c: c / F.pow(g, F.col("__o")))
    scratch = ["__b", "__o", *[f"__{q}_{n}" for q in "tr" for n in values]]
    up = (lambda c: c) if gamma == 1 else (lambda c: c * F.pow(g, F.lit(m) - F.col("__o")))
    total = {n: down(F.col(f"__r_{n}")) + F.coalesce(up(F.col(f"__t_{n}")), F.lit(0.0)) for n in values}
    if digits * m >= 100 and not has_hot(df, keys):
        ahead = Window.partitionBy(*keys).orderBy("__b").rangeBetween(1, 1)
        carry = {f"__t_{n}": F.sum(weigh(v, F.col("__o"))).over(ahead) for n, v in values.items()}
        return d.withColumns(local).withColumns(carry).withColumns(total).drop(*scratch)
    heads = d.where(F.col("__b") >= 1).groupBy(*keys, "__b")
    heads = heads.agg(*[F.sum(weigh(v, F.col("__o"))).alias(f"__t_{n}") for n, v in values.items()])
    if digits * m < 100:
        heads = _scan_heads(heads, keys, gamma, m, list(values))
    heads = heads.withColumn("__b", F.col("__b") - 1)
    both = [*keys, "__b"]
    d = d.withColumns(local).join(rename_keys(heads, both), match(both), "left")
    return drop_keys(d.withColumns(total), both, *scratch)


def _scan_heads(heads: DataFrame, keys: list[str], gamma: float, m: int, names: list[str]):
    """The same suffix scan over block heads: one row per RANGE_ROWS input rows."""
    g = gamma**m
    if gamma == 1:
        w = Window.partitionBy(*keys).orderBy(F.desc("__b"))
        w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return heads.withColumns({f"__t_{n}": F.sum(f"__t_{n}").over(w) for n in names})
    m2 = max(1, int(150 / -math.log10(g)))
    h = heads.withColumns({"__s": F.floor(F.col("__b") / m2), "__u": F.col("__b") % m2})
    sums = [F.sum(F.col(f"__t_{n}") * F.pow(F.lit(g), F.col("__u"))).alias(f"__n_{n}") for n in names]
    nxt = h.where(F.col("__s") >= 1).groupBy(*keys, "__s").agg(*sums)
    nxt = rename_keys(nxt.withColumn("__s", F.col("__s") - 1), [*keys, "__s"])
    w = Window.partitionBy(*keys, "__s").orderBy(F.desc("__b"))
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scaled = {
        f"__t_{n}": F.sum(F.col(f"__t_{n}") * F.pow(F.lit(g), F.col("__u"))).over(w)
        / F.pow(F.lit(g), F.col("__u"))
        for n in names
    }
    h = h.withColumns(scaled).join(nxt, match([*keys, "__s"]), "left")
    carry = {
        f"__t_{n}": F.col(f"__t_{n}")
        + F.coalesce(F.col(f"__n_{n}") * F.pow(F.lit(g), F.lit(m2) - F.col("__u")), F.lit(0.0))
        for n in names
    }
    h = h.withColumns(carry)
    return drop_keys(h, [*keys, "__s"], "__s", "__u", *[f"__n_{n}" for n in names])
