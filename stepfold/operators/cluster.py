"""Step groups by text similarity: the greedy first-match clustering, in parallel rounds."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.plans.session import checkpoint
from stepfold.plans.skew import lookup, top_k

ROUND_ROWS = 500


def _first_match(text: str, reps: list[tuple[int, str]], threshold: float) -> int | None:
    for no, rep in reps:
        m = SequenceMatcher(None, text, rep)
        if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold:
            return no
    return None


def similar_step_groups(df: DataFrame, similarity: float = 0.95, *, group="uid", obs="anchor_obs", order="ord", round_rows: int = ROUND_ROWS) -> DataFrame:
    """Adds step_group: rows in order join the first cluster of their group whose first member
    is similar enough, else open one. The cluster is named by its first member's order.

    Equal observations always end in the cluster of their first occurrence, so only distinct
    ones are compared. Each round takes a group's first ``round_rows`` open observations,
    lets them open clusters among themselves in one task, and then compares all others of the
    group against those clusters in parallel. An observation left open matched none of the
    earlier clusters, as in one sequential pass. So no task holds a whole group.
    """
    if not 0 < similarity < 1:
        raise ValueError("similarity must be inside (0, 1)")
    distinct = df.groupBy(group, obs).agg(F.min(order).alias("ord"))
    left = checkpoint(distinct.select(F.col(group).alias("g"), F.col(obs).alias("o"), "ord"))
    gtype = left.schema["g"].dataType.simpleString()
    otype = left.schema["ord"].dataType.simpleString()

    def open_clusters(pdf: pd.DataFrame) -> pd.DataFrame:
        reps: list[tuple[int, str]] = []
        for row in pdf.sort_values("ord").itertuples():
            if _first_match(row.o, reps, similarity) is None:
                reps.append((row.ord, row.o))
        return pd.DataFrame({"g": pdf["g"].iloc[0], "no": [r[0] for r in reps], "rep": [r[1] for r in reps]})

    @F.pandas_udf(otype)
    def assign(text: pd.Series, reps: pd.Series) -> pd.Series:
        return pd.Series([_first_match(t, [(r["no"], r["rep"]) for r in rs], similarity) for t, rs in zip(text, reps)], dtype="Int64")

    done = None
    while not left.isEmpty():
        head = top_k(left, ["g"], [F.col("ord")], round_rows)
        reps = head.select("g", "o", "ord").groupBy("g").applyInPandas(open_clusters, f"g {gtype}, no {otype}, rep string")
        packed = reps.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("no", "rep"))).alias("reps"))
        d = lookup(left, packed, ["g"], "inner").withColumn("step_group", assign("o", "reps"))
        d = checkpoint(d.select("g", "o", "ord", "step_group"))
        part = d.where("step_group IS NOT NULL").select("g", "o", "step_group")
        done = part if done is None else done.unionByName(part)
        left = d.where("step_group IS NULL").select("g", "o", "ord")
    names = done.select(F.col("g").alias(group), F.col("o").alias(obs), "step_group")
    return lookup(df, names, [group, obs])
