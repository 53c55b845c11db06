"""Answer extraction, normalisation and scoring as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the ASCII punctuation characters removed by answer normalisation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE = r"(?U)\s+"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, NULL (not '') when the pattern is absent."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def last_answer_tag(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"(?s)<answer>(.*?)</answer>"), 1)
    return strip(F.element_at(F.when(F.size(found) > 0, found), -1))


def first_answer(c: Column) -> Column:
    tag = first_match(c, r"(?is)<answer>(.*?)</answer>")
    final = first_match(c, r"(?is)final\s+answer\s*[:：]\s*(.+)")
    plain = first_match(c, r"(?is)answer\s*[:：]\s*(.+)")
    return strip(F.coalesce(tag, final, plain, c))


def normalize_answer_qa(c: Column) -> Column:
    bare = F.translate(F.lower(c), PUNCTUATION, "")
    return squeeze(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def normalize_answer_alnum(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), "[^a-z0-9一-鿿]+", " "))


def exact_match(pred: Column, golds: Column) -> Column:
    p = normalize_answer_qa(pred)
    return F.coalesce(F.exists(golds, lambda g: normalize_answer_qa(g) == p), F.lit(False))


def sub_match(pred: Column, golds: Column) -> Column:
    p = normalize_answer_qa(pred)
    return F.coalesce(F.exists(golds, lambda g: F.contains(p, normalize_answer_qa(g))), F.lit(False))


def occurrences(c: Column, part: str) -> Column:
    return F.size(F.split(c, part)) - 1


def score_qa(c: Column, golds: Column, format_score: float = 0.0, score: float = 1.0) -> Column:
    answer = last_answer_tag(c)
    many = (occurrences(c, "<answer>") > 10) | (occurrences(c, "</answer>") > 10)
    return (
        F.when(answer.isNull(), 0.0)
        .when(exact_match(answer, golds), F.when(many, score / 4).otherwise(score))
        .otherwise(format_score)
    )


def score_contains(c: Column, gold: Column, mode: str = "contains") -> Column:
    p, g = normalize_answer_alnum(first_answer(c)), normalize_answer_alnum(gold)
    hit = p == g
    if mode == "contains":
        hit = hit | F.contains(p, g) | F.contains(g, p)
    return F.when((F.coalesce(p, F.lit("")) == "") | (F.coalesce(g, F.lit("")) == ""), 0.0).otherwise(
        hit.cast("double")
    )


def gsm8k_answer(c: Column, method: str = "strict") -> Column:
    if method == "strict":
        found = first_match(c, r"#### (-?[0-9.,]+)")
        return F.translate(found, ",$", "")
    numbers = F.filter(
        F.regexp_extract_all(c, F.lit(r"(-?[0-9.,]+)"), 1), lambda x: ~x.isin("", ".")
    )
    return F.element_at(F.when(F.size(numbers) > 0, numbers), -1)


def score_gsm8k(c: Column, gold: Column, method: str = "strict", format_score: float = 0.0) -> Column:
    a = gsm8k_answer(c, method)
    return F.when(a.isNull(), 0.0).when(a == gold, 1.0).otherwise(format_score)


def score_choice(c: Column, gold: Column) -> Column:
    got = first_match(c, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])")
    return F.coalesce((got == gold).cast("double"), F.lit(0.0))


def score_format(c: Column) -> Column:
    return c.rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z").cast("double")


def blend(accuracy: Column, fmt: Column, weight: float = 0.1) -> Column:
    return (1 - weight) * accuracy + weight * fmt


# Markers of a final answer that is no answer.
NON_ANSWER_MARKERS = [
    "<tool_call", "</tool_call>", '"tool_name"', '"name"', "code_interpreter", "web_search",
    "image_search", "visit", "zoom", "reached max turns", "without a definitive answer",
    "could not parse model response", "api attempts failed",
]
# Reasons reported for them.
EMPTY_REASON = "empty final answer"
ERROR_REASON = "final answer is an error"
MARKER_REASON = "final answer is a tool call, parser failure, or unfinished rollout"


def let(c: Column, fn) -> Column:
    """fn of a value that is computed once, however often fn uses it."""
    return F.element_at(F.transform(F.array(c), fn), 1)


def any_marker(c: Column, markers: list[str]) -> Column:
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(c, F.lit(m))
    return hit


def concrete_answer(c: Column) -> Column:
    """Struct (answer, reason): the answer is NULL when it is not concrete."""
    def candidate(text: Column) -> Column:
        tags = F.regexp_extract_all(text, F.lit(r"(?is)<answer>\s*(.*?)\s*</answer>"), 1)
        tag = F.element_at(F.when(F.size(tags) > 0, tags), -1)
        marked = first_match(text, r"(?is)(?:final\s+answer|answer)\s*[:：]\s*(.+)")
        head_error = F.lower(text).startswith("error:")
        return F.struct(text.alias("t"), head_error.alias("e"), strip(F.coalesce(tag, marked, text)).alias("c"))

    def judge(x: Column) -> Column:
        low = F.lower(x["c"])
        why = let(low, lambda v: (
            F.when(x["t"] == "", EMPTY_REASON).when(x["e"], ERROR_REASON).when(v == "", EMPTY_REASON)
            .when(v.startswith("error:"), ERROR_REASON).when(any_marker(v, NON_ANSWER_MARKERS), MARKER_REASON).otherwise("")))
        return let(why, lambda r: F.struct(F.when(r == "", x["c"]).alias("answer"), r.alias("reason")))

    return let(let(strip(F.coalesce(c, F.lit(""))), candidate), judge)


def overlong_penalty(length: Column, max_len: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - (max_len - buffer)) / buffer * factor, F.lit(0.0))


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def word_count(c: Column) -> Column:
    """Whitespace tokens."""
    t = squeeze(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")
