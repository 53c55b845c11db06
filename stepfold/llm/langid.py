"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of embeddings of its byte n-grams (letters folded, all else a space),
hashed into a fixed table; a linear layer gives the logits. Both are trained by stochastic
gradient descent on a sample bounded by ``per_label`` documents of each language. Because
the last layer is linear, table and layer collapse into one table of logits per bucket (its
size does not grow with the data), and a whole text of any length is a sum of lookups.
A temperature and a rejection threshold come from held-back sample rows.

Null texts and texts without a letter are ``und`` with score 0 and rejected; null languages
are not learned from. With no labelled row at all everything is ``und``. Equal scores go to
the language that sorts first. Repeated rows get equal results; further columns pass through,
and the four result columns replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfold.llm.base import chunks, sample_by_label, small_batches
from stepfold.llm.tokens import FOLDED, column_bytes, segment_sums

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
UNKNOWN = "und"
#: Documents of each language that the model is fitted on, at most.
PER_LABEL = 400
_MIX = np.uint32(0x9E3779B1)


@dataclass
class Model:
    labels: list[str]
    logits: np.ndarray  # bucket x label
    bias: np.ndarray
    temperature: float
    threshold: float


def _gram_buckets(raw: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at each position that has one."""
    h = np.full(max(0, len(raw) - n + 1), n, np.uint32)
    for k in range(n):
        h = h * np.uint32(257) + raw[k : len(raw) - n + 1 + k]
    return (h * _MIX) >> np.uint32(16)


def raw_scores(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean logits of each document."""
    total = np.zeros((len(offsets) - 1, len(model.labels)))
    count = np.zeros(len(offsets) - 1)
    start = offsets[:-1]
    for n in GRAMS:
        end = np.maximum(start, offsets[1:] - n + 1)
        total += segment_sums(model.logits[_gram_buckets(raw, n)], start, end)
        count += end - start
    return total / np.maximum(count, 1)[:, None] + model.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], width: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7, max_rejected: float = 0.001) -> Model:
    """Fit by plain SGD, one document a step; every fifth row is held back for calibration."""
    labels = sorted(set(langs))
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    of = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    docs = []
    for text, lang in zip(texts, langs):
        raw = FOLDED[np.frombuffer(text.encode(), np.uint8)]
        ids, n = np.unique(np.concatenate([_gram_buckets(raw, g) for g in GRAMS]), return_counts=True)
        if len(ids):
            docs.append((ids, (n / n.sum()).astype(np.float32), of[lang]))
    held, fit = docs[::5], [d for i, d in enumerate(docs) if i % 5] or docs
    table = rng.normal(0, 1, (BUCKETS, width)).astype(np.float32)
    layer, bias = np.zeros((width, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(fit)):
            ids, share, label = fit[i]
            mean = share @ table[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= step * np.outer(mean, p)
            bias -= step * p
            # shares are small, so embeddings move by the share of the largest
            table[ids] -= step * np.outer(share / share.max(), back)
    model = Model(labels, (table @ layer).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    if held:
        z = np.stack([share @ model.logits[ids] + bias for ids, share, _ in held]).astype(np.float64)
        y = np.array([label for *_, label in held])
        grid = np.geomspace(0.5, 20, 40)  # separable rows would drive it to 0
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
        if len(right):
            model.threshold = float(min(0.5, right[int(max_rejected * len(right))]))
    return model


def sample(docs: DataFrame, per_label: int = PER_LABEL) -> tuple[list[str], list[str]]:
    """At most ``per_label`` labelled texts of each language, chosen by a hash of the id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    few = sample_by_label(known, "lang", per_label).withColumnsRenamed({"doc_id": "__id", "lang": "__lang"})
    rows = known.join(F.broadcast(few), (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__lang")))
    got = sorted(((r[0], r[1], r[2]) for r in rows.select("doc_id", "lang", "text").collect()), key=lambda r: (r[1], r[0], r[2]))
    return [r[2] for r in got], [r[1] for r in got]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (calibrated) and rejected."""
    added = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}
    docs = docs.drop(*added)
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in added.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            text = batch.column("text")
            raw, offsets = column_bytes(text)
            raw = FOLDED[raw]
            ascii_letter = segment_sums((raw >= 0x61) & (raw < 0x7B), offsets[:-1], offsets[1:]) > 0
            letter = [bool(a) or any(c.isalpha() for c in t.as_py() or "") for a, t in zip(ascii_letter, text)]
            if model.labels:
                p = softmax(raw_scores(model, raw, offsets) / model.temperature)
                best = p.argmax(axis=1)
            else:
                p, best, letter = np.zeros((len(text), 1)), np.zeros(len(text), int), [False] * len(text)
            score = np.where(letter, p[np.arange(len(best)), best], 0.0)
            langs = [model.labels[b] if ok else UNKNOWN for b, ok in zip(best, letter)]
            out = [*batch.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(~np.array(letter, bool) | (score < model.threshold))]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, *added])

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, per_label: int = PER_LABEL) -> Model:
    return train(*sample(docs, per_label))
