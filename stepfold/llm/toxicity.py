"""Toxic spans by a linear-chain conditional random field, and document scores from them.

Labels exist for documents only. Tokens are labelled from them: in a bounded sample, words
and word beginnings that stand in toxic texts far more often than in clean ones are taken
greedily until they explain the toxic documents; tokens that have one in a toxic document
are the positive ones. The field has two states, hashed features of the word, its beginnings
and its ending, and a transition matrix, trained by gradient steps on exact forward-backward marginals.

A document's score is the marginal of its likeliest toxic token, put through a logistic calibration on the sample's document labels. Every token
of a text is tagged, whatever its length: the recursions run step by step over all documents
of a bounded chunk at once. Labels, language, source and id are never inputs of a score.

Null and empty texts have no tokens and get the calibrated score of none, with no spans. Null labels are
not learned from. If the sample has no toxic document all scores are 0. Repeated rows get
equal results; further columns pass through, the result columns replace any of the same name.
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
from stepfold.llm.tokens import FOLDED, column_bytes, letter_runs, span_hashes

BITS = 17
#: Lengths in bytes of word beginnings and endings that are features beside the word itself.
BEGINNINGS, ENDINGS = (4, 5, 6), (4,)
#: Log-odds of a text without tokens, and the smallest there are.
LEAST = -12.0
#: Documents of each class that the model is fitted on, at most.
PER_CLASS = 500


@dataclass
class Model:
    weights: np.ndarray  # feature x bucket
    bias: float
    trans: np.ndarray  # 2 x 2, log
    scale: float
    shift: float
    usable: bool


@dataclass
class Tokens:
    """Tokens of a chunk of documents, in order."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each document: its first token
    count: np.ndarray
    features: list[np.ndarray]  # 64-bit hashes; the first is the word's
    buckets: np.ndarray  # feature x token


def tokenize(raw: np.ndarray, offsets: np.ndarray) -> Tokens:
    raw = FOLDED[raw]
    start, end, doc = letter_runs(raw, offsets)
    spans = [(start, end)]
    spans += [(start, np.minimum(start + n, end)) for n in BEGINNINGS]
    spans += [(np.maximum(end - n, start), end) for n in ENDINGS]
    features = [span_hashes(raw, a, b) ^ np.uint64(k * 0x2545F4914F6CDD1D & (1 << 64) - 1) for k, (a, b) in enumerate(spans)]
    count = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    return Tokens(start, end, first, count, features, np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in features]))


def emissions(model: Model, t: Tokens) -> np.ndarray:
    return np.clip(sum(w[at] for w, at in zip(model.weights, t.buckets)) + model.bias, -30, 30)


def forward_backward(psi: np.ndarray, trans: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ratios of state 1 to state 0 of the forward and backward messages at every token.

    Documents are sorted by length so that a step works on those still running.
    """
    (t00, t01), (t10, t11) = np.exp(trans)
    alpha, beta = np.empty_like(psi), np.empty_like(psi)
    order = np.argsort(-count, kind="stable")
    begin, n = first[order], count[order]
    last = begin + n - 1
    steps = int(n[0]) if len(n) else 0
    running = len(n) - np.searchsorted(n[::-1], np.arange(steps), side="right")
    a = b = None
    for s in range(steps):
        m = running[s]
        at = begin[:m] + s
        a = psi[at] if s == 0 else psi[at] * (t01 + a[:m] * t11) / (t00 + a[:m] * t10)
        alpha[at] = a
        at = last[:m] - s
        if s == 0:
            b = np.ones(m)
        else:
            x = psi[at + 1] * b[:m]
            b = (t10 + t11 * x) / (t00 + t01 * x)
        beta[at] = b
    return alpha, beta


def marginals(model: Model, t: Tokens) -> np.ndarray:
    alpha, beta = forward_backward(np.exp(emissions(model, t)), model.trans, t.first, t.count)
    odds = alpha * beta
    return odds / (1 + odds)


def log_odds(p: np.ndarray, t: Tokens) -> np.ndarray:
    """Log-odds of a document's likeliest toxic token; LEAST for a text without tokens. (A
    noisy-or would let thousands of harmless tokens of a long text add up.)"""
    out = np.full(len(t.count), LEAST)
    some = t.count > 0
    if some.any():
        top = np.clip(np.maximum.reduceat(p, t.first[some]), 1e-9, 1 - 1e-9)
        out[some] = np.maximum(np.log(top) - np.log1p(-top), LEAST)
    return out


def toxic_features(t: Tokens, toxic: np.ndarray, ratio: float = 20.0, least: int = 3) -> np.ndarray:
    """Hashes of the words and word parts that explain the toxic documents, by greedy cover."""
    doc = np.repeat(np.arange(len(t.count)), t.count)
    pair = np.unique(np.stack([np.concatenate(t.features), np.tile(doc, len(t.features)).astype(np.uint64)], 1), axis=0)
    keys, of = np.unique(pair[:, 0], return_inverse=True)
    docs = pair[:, 1].astype(np.int64)
    n_toxic, n_clean = max(1, toxic.sum()), max(1, (~toxic).sum())
    hits = np.bincount(of, toxic[docs], len(keys))
    clean = np.bincount(of, ~toxic[docs], len(keys))
    good = (hits >= least) & (hits / n_toxic >= ratio * (clean + 0.2) / n_clean)
    keep = good[of] & toxic[docs]
    of, docs, still, chosen = of[keep], docs[keep], toxic.copy(), []
    while len(of):
        gain = np.bincount(of[still[docs]], minlength=len(keys)) - 5 * clean / n_clean * n_toxic
        best = int(gain.argmax())
        if gain[best] < max(least, 0.01 * n_toxic):
            break
        chosen.append(keys[best])
        still[docs[of == best]] = False
    # those of many toxic texts are taken too, although others cover their documents
    chosen = np.union1d(np.array(chosen, np.uint64), keys[good & (hits >= max(least, 0.05 * n_toxic))])
    return chosen.astype(np.uint64)


def distinct_texts(t: Tokens) -> np.ndarray:
    """First document of every set of near copies: those that share their smallest hash of
    three tokens in a row."""
    w = t.features[0]
    seen, keep = set(), np.zeros(len(t.count), bool)
    for d, (f, n) in enumerate(zip(t.first, t.count)):
        x = w[f : f + n]
        x = x if n < 3 else (x[:-2] * np.uint64(3) ^ x[1:-1]) * np.uint64(5) ^ x[2:]
        sign = int((x * np.uint64(0x9E3779B97F4A7C15)).min()) if n else 0
        keep[d] = sign not in seen
        seen.add(sign)
    return keep


def train(texts: list[str], toxic: list[int], epochs: int = 25, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Fit the field by Adagrad on the exact gradient, then the calibration."""
    n_features = 1 + len(BEGINNINGS) + len(ENDINGS)
    model = Model(np.zeros((n_features, 1 << BITS)), -4.0, np.zeros((2, 2)), 1.0, 0.0, any(toxic))
    if not model.usable:
        return model
    label = np.array(toxic, bool)
    pack = lambda x: column_bytes(pa.array(x, pa.string()))
    keep = distinct_texts(tokenize(*pack(texts)))
    texts, label = [x for x, k in zip(texts, keep) if k], label[keep]
    t = tokenize(*pack(texts))
    lexicon = toxic_features(t, label)
    doc = np.repeat(np.arange(len(t.count)), t.count)
    tags = np.any([np.isin(f, lexicon) for f in t.features], axis=0) & label[doc]
    unexplained = label & (np.bincount(doc, tags, len(label)) == 0)
    use = ~unexplained[doc]  # nothing is known of their tokens
    inner = np.ones(len(doc), bool)
    inner[t.first[t.count > 0]] = False  # tokens with one before them
    seen = np.zeros((2, 2))
    pairs = np.flatnonzero(inner & use)
    np.add.at(seen, (tags[pairs - 1].astype(int), tags[pairs].astype(int)), 1)
    history = np.full_like(model.weights, 1e-8)
    small = np.full(5, 1e-8)
    scale = 1 / max(1, tags.sum())
    for _ in range(epochs):
        psi = np.exp(emissions(model, t))
        alpha, beta = forward_backward(psi, model.trans, t.first, t.count)
        p = alpha * beta / (1 + alpha * beta)
        g = np.where(use, p - tags, 0.0) * scale
        for w, at, h in zip(model.weights, t.buckets, history):
            grad = np.bincount(at, g, len(w)) + decay * w
            h += grad**2
            w -= rate * grad / np.sqrt(h)
        a, x = alpha[pairs - 1], psi[pairs] * beta[pairs]
        joint = np.stack([np.ones_like(a), x, a, a * x], 1) * np.exp(model.trans).ravel()
        expected = (joint / joint.sum(axis=1, keepdims=True)).sum(axis=0)
        grads = np.append((expected - seen.ravel()) * scale + decay * model.trans.ravel(), g.sum())
        small += grads**2
        move = 0.2 * grads / np.sqrt(small)
        model.trans -= move[:4].reshape(2, 2)
        model.bias -= move[4]
    z = log_odds(marginals(model, t), t)
    model.scale, model.shift = calibrate(z, label)
    return model


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 100, ridge: float = 1.0) -> tuple[float, float]:
    """Logistic regression of the labels (smoothed, as classes may be separable) on the
    log-odds, by Newton steps of bounded length, pulled towards the identity."""
    x = np.stack([np.clip(z, LEAST, -LEAST), np.ones_like(z)], 1)
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y, (good + 1) / (good + 2), 1 / (bad + 2))
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - target) + ridge * (w - [1.0, 0.0])), -0.5, 0.5)
    return float(w[0]), float(w[1])


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[str], list[int]]:
    """At most ``per_class`` labelled texts of either class, chosen by a hash of the id."""
    labels = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = sample_by_label(labels, "toxic", per_class)
    got = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id").collect()
    got = sorted({(r["doc_id"], r["text"], r["toxic"]) for r in got})
    return [r[1] for r in got], [r[2] for r in got]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with score and spans (start, end in characters, p) of likely tokens."""
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
    added = {"score": T.DoubleType(), "spans": T.ArrayType(span)}
    docs = docs.drop(*added)
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in added.items()]])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            raw, offsets = column_bytes(batch.column("text"))
            t = tokenize(raw, offsets)
            if model.usable:
                p = marginals(model, t)
                value = 1 / (1 + np.exp(-np.clip(np.clip(log_odds(p, t), LEAST, -LEAST) * model.scale + model.shift, -30, 30)))
            else:
                p, value = np.zeros(len(t.start)), np.zeros(len(t.count))
            spans: list[list[dict]] = [[] for _ in t.count]
            for i in np.flatnonzero(p >= 0.5):
                d = int(np.searchsorted(t.first + t.count, i, side="right"))
                before = bytes(raw[offsets[d] : t.start[i]]).decode()
                word = bytes(raw[t.start[i] : t.end[i]]).decode()
                spans[d].append({"start": len(before), "end": len(before) + len(word), "p": float(p[i])})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), pa.array(spans, kind)], names=[*batch.schema.names, *added])

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return train(*sample(docs, labels, per_class))
