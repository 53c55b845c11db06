"""User scorers, the Markdown table function, and the text functions by name in SQL."""

from __future__ import annotations

import contextlib
import ctypes
import multiprocessing
import os
import signal
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfold.functions import classify as C
from stepfold.functions import normalize as N
from stepfold.functions import text as X

SCORERS: dict[str, Callable[..., Column]] = {}


def _plain(value) -> float:
    """A scorer may return a number, a tuple (its first part counts) or a dict with score."""
    if isinstance(value, (tuple, list)):
        value = value[0]
    if isinstance(value, dict):
        value = value["score"]
    return float(value)


def register_scorer(name: str, fn: Callable, **bound) -> Callable[..., Column]:
    """fn(data_source, solution_str, ground_truth, extra_info, **bound) as an Arrow-batched
    scorer usable in ``grade_responses``; the name is its data source."""
    @F.pandas_udf(T.DoubleType())
    def score(solution: pd.Series, truth: pd.Series) -> pd.Series:
        return pd.Series([_plain(fn(name, s, g, None, **bound)) for s, g in zip(solution, truth)])

    SCORERS[name] = lambda response, gold: score(response, gold)
    return SCORERS[name]


def register_batch_scorer(name: str, fn: Callable[[Sequence, Sequence], Sequence[float]], **bound) -> Callable[..., Column]:
    """fn(solutions, truths, **bound) called once per Arrow batch."""
    @F.pandas_udf(T.DoubleType())
    def score(solution: pd.Series, truth: pd.Series) -> pd.Series:
        return pd.Series([_plain(v) for v in fn(list(solution), list(truth), **bound)], dtype="float64")

    SCORERS[name] = lambda response, gold: score(response, gold)
    return SCORERS[name]


class Deadline:
    """Calls ``fn`` in a child process that is killed and replaced when a call takes too long."""

    def __init__(self, fn: Callable, seconds: float):
        self.fn, self.seconds, self.child = fn, seconds, None

    def _serve(self, pipe) -> None:
        with contextlib.suppress(OSError, AttributeError):  # Linux: the child ends with its parent, however that ends
            ctypes.CDLL(None).prctl(1, signal.SIGKILL)
        keep = pipe.fileno()
        os.closerange(3, keep)  # the worker's connections are not the child's
        os.closerange(keep + 1, 4096)
        with contextlib.suppress(EOFError):
            while True:
                args = pipe.recv()
                try:
                    pipe.send((_plain(self.fn(*args)), None))
                except Exception as e:  # noqa: BLE001 - any user error is a zero score
                    pipe.send((0.0, f"{type(e).__name__}: {e}"))

    def __call__(self, *args) -> tuple[float, str | None]:
        if self.child is None:
            fork = multiprocessing.get_context("fork")
            self.pipe, theirs = fork.Pipe()
            self.child = fork.Process(target=self._serve, args=(theirs,), daemon=True)
            self.child.start()
            theirs.close()
        try:
            self.pipe.send(args)
            if self.pipe.poll(self.seconds):
                return self.pipe.recv()
            why = f"TimeoutError: over {self.seconds:g} s"
        except (EOFError, OSError):
            why = "ChildProcessError: the scorer's process ended"
        self.close()
        return 0.0, why

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None


def safe_score(fn: Callable, timeout: float | None = None) -> Callable[..., Column]:
    """Struct (score, error): a failing scorer gives 0.0 and its message, the row stays. With
    ``timeout`` (seconds) so does one that takes longer, or whose process dies: calls run in one
    child process beside each task's worker, which is killed and replaced then, and goes with the task."""
    def direct(s, g) -> tuple[float, str | None]:
        try:
            return _plain(fn(s, g)), None
        except Exception as e:  # noqa: BLE001 - any user error is a zero score
            return 0.0, f"{type(e).__name__}: {e}"

    @F.pandas_udf("score double, error string")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        call = direct if timeout is None else Deadline(fn, timeout)
        try:
            for solution, truth in batches:
                yield pd.DataFrame([call(s, g) for s, g in zip(solution, truth)], columns=["score", "error"])
        finally:
            if timeout is not None:
                call.close()

    return score


@F.udtf(returnType="ord int, title string, body string")
class MarkdownSections:
    """Headed sections with a body, else blank-line paragraphs."""

    def eval(self, text: str) -> Iterator[tuple[int, str, str]]:
        import re

        text = (text or "").lstrip("﻿")
        heads = list(re.finditer(r"(?m)^#{1,6}[ \t]+(\S.*?)[ \t]*$", text))
        if heads:
            ends = [h.start() for h in heads[1:]] + [len(text)]
            found = [(h.group(1), text[h.end():e].strip()) for h, e in zip(heads, ends)]
        else:
            parts = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
            found = [(f"Memory {i:02d}", p) for i, p in enumerate(parts, 1)]
        for i, (title, body) in enumerate([f for f in found if f[1]], 1):
            yield i, title, body


# name -> (argument names, column function of those arguments)
SQL_FUNCTIONS: dict[str, tuple[list[str], Callable[..., Column]]] = {
    "last_answer_tag": (["t"], X.last_answer_tag),
    "first_answer": (["t"], X.first_answer),
    "normalize_answer_qa": (["t"], X.normalize_answer_qa),
    "normalize_answer_alnum": (["t"], X.normalize_answer_alnum),
    "score_contains": (["t", "gold"], X.score_contains),
    "score_gsm8k": (["t", "gold"], X.score_gsm8k),
    "score_choice": (["t", "gold"], X.score_choice),
    "score_format": (["t"], X.score_format),
    "estimate_tokens": (["t"], X.estimate_tokens),
    "classify_tool_error": (["t"], C.classify_tool_error),
    "classify_household": (["t"], C.classify_household),
    "classify_shopping": (["t"], C.classify_shopping),
    "classify_search": (["t", "source"], C.classify_search),
    "normalize_size": (["t"], C.normalize_size),
    "normalize_benchmark": (["t"], N.normalize_benchmark),
    "prefixed_id": (["t", "benchmark"], N.prefixed_id),
    "repair_path": (["t"], N.repair_path),
    "url_to_key": (["t"], N.url_to_key),
}


def _sql_body(spark: SparkSession, args: list[str], fn: Callable[..., Column]) -> str:
    """SQL text of the column expression. Backslashes double, since SQL literals escape them."""
    probe = spark.sql("SELECT " + ", ".join(f"CAST(NULL AS STRING) AS {a}" for a in args))
    plan = probe.select(fn(*[F.col(a) for a in args]).alias("body"))._jdf.queryExecution().analyzed()
    body = plan.projectList().apply(0).child().sql()
    return body


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Temporary SQL functions with native bodies (inlined by the optimizer), and the Markdown
    table function; returns the registered names."""
    done = []
    for name, (args, fn) in SQL_FUNCTIONS.items():
        params = ", ".join(f"{a} STRING" for a in args)
        body = _sql_body(spark, args, fn)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURN {body}")
        done.append(name)
    spark.udtf.register("markdown_sections", MarkdownSections)
    return [*done, "markdown_sections"]
