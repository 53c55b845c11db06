"""Table jobs that score, validate and label whole response and event tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions import classify as C
from stepfold.functions import parse as P
from stepfold.functions import text as T

Scorer = Callable[[Column, Column], Column]


def default_scorers() -> dict[str, Scorer]:
    return {
        "search_qa": lambda r, g: T.score_qa(r, F.array(g)),
        "contains": T.score_contains,
        "gsm8k": T.score_gsm8k,
        "choice": T.score_choice,
        "format": lambda r, g: T.score_format(r),
    }


def grade_responses(
    df: DataFrame,
    *,
    source="data_source",
    response="response",
    gold="gold",
    scorers: Mapping[str, Scorer] | None = None,
) -> DataFrame:
    """Score each row with its source's scorer; an unknown source is an error."""
    table = {**default_scorers(), **(scorers or {})}
    out = None
    for name, fn in table.items():
        hit, value = F.col(source) == name, fn(F.col(response), F.col(gold))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    unknown = F.raise_error(F.concat(F.lit("no scorer for source "), F.coalesce(source, F.lit("NULL"))))
    return df.withColumn("score", out.otherwise(unknown.cast("double")))


def validate_actions(df: DataFrame, family: str, *, text="response") -> DataFrame:
    """Projected action and its validity for every turn."""
    c = F.col(text)
    p = P.project_search_action(c) if family == "search" else P.project_tagged_action(c, family)
    d = df.withColumn("__p", p)
    return d.withColumns({"action": F.col("__p.action"), "is_action_valid": F.col("__p.valid")}).drop("__p")


def label_failures(df: DataFrame, *, snippet: str | None = None, analysis: str | None = None) -> DataFrame:
    """failure_type of every rollout, from error, final answer, analysis and snippet."""
    opt = lambda c: F.col(c) if c else F.lit("")
    label = C.classify_failure(F.col("error"), F.col("final_answer"), opt(analysis), opt(snippet))
    return df.withColumn("failure_type", label)


def trajectory_snippets(events: DataFrame, keys=("sample_id", "rollout_id"), *, first: int | None = None, cut: int | None = None) -> DataFrame:
    """Texts, errors, tools and their results of each trajectory as one string; ``first`` pieces
    and ``cut`` characters of each where given."""
    from stepfold.plans.skew import rank, top_k

    text = F.coalesce(F.nullif("text_output", F.lit("")), F.nullif("tool_error", F.lit("")))
    has = events.where(text.isNotNull() | F.col("tool_name").isNotNull())
    order = [F.col("line_no")]
    d = rank(has, list(keys), order) if first is None else top_k(has, list(keys), order, first)
    piece = F.coalesce(text, F.concat_ws(" ", "tool_name", "tool_result"))
    piece = piece if cut is None else F.substring(piece, 1, cut)
    packed = F.array_sort(F.collect_list(F.struct("rn", piece.alias("p"))))
    return d.groupBy(*keys).agg(F.array_join(F.transform(packed, lambda x: x["p"]), "\n").alias("snippet"))
