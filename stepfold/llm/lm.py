"""A log-bilinear language model that scores whole texts with normalised probabilities.

Counts. Every distinct token of all training documents is counted in a distributed pass
(per-task dictionaries of bounded size, then a sum by token); the table of counts grows
with the corpus and stays distributed. Only its most frequent tokens, ``HEAD`` at most, are
sent to the tasks.

Model. The next symbol is predicted from the three before it: their embeddings, each scaled
by a vector of its position, add up to a prediction that is compared with every symbol's
output embedding (log-bilinear). Symbols are the ``FREQUENT`` most frequent tokens and
``CLASSES`` classes of all other tokens by their ending. Scoring normalises over all symbols
with batched matrix products. A token of a class gets the class's probability times its share of the
class, (c + 0.5) over the class's sum, where unknown tokens of a class count as one symbol
of 0.5, so that probabilities add up to one.

Training is noise-contrastive estimation in numpy. A sample on the driver only gives the start;
then every training document is gone through in each of ``ROUNDS`` rounds. Their symbols (two
bytes a token) are dealt by a hash of the document into shards of about ``SHARD_TOKENS``, so a
shard is a random part of the corpus however the table is laid out. A task descends from the
common parameters through its shard, and an aggregation averages what the tasks arrive at,
weighted by their tokens. Noise is drawn from the symbols' counts in the whole corpus.

Tokens are the words between ASCII white space, A-Z in lower case, then one end. Null and
empty texts are one end. Repeated rows are scored once and all kept. Ties in frequency go to
the token that sorts first; the head ends at a count, so that ties are in it or out together. Without training documents counts are 0 and classes equally
likely. Only doc_id and text of the input are used.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.base import checkpoint, chunks, small_batches
from stepfold.llm.tokens import column_bytes

#: Most frequent tokens whose counts every task holds, at most.
HEAD = 1 << 16
FREQUENT, CLASSES, ORDER, WIDTH = 448, 64, 3, 24
#: Training documents that give the parameters the rounds over all of them start from, at most.
SAMPLE = 500
#: Passes over all training documents, each ending in an average of the parameters.
ROUNDS = 2
#: Tokens of a shard, about, and those a task has in memory at a time.
SHARD_TOKENS, HELD_SYMBOLS = 1 << 21, 1 << 19
#: Distinct tokens in a task's dictionary before it is emptied.
HELD_TOKENS = 400_000
#: Histories whose sums are made at a time: their rows stay in the cache.
BATCH_TOKENS = 1 << 8
#: Text bytes whose tokens are numbered together.
TEXT_BYTES = 2 << 20
#: Sums over all symbols that a task remembers, and histories looked up in them at a time.
SLOTS, LOOKED_UP = 1 << 21, 1 << 14
END = b""


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def numbered(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of a column of texts (the end is the first), each token's place among
    them in order, and the n + 1 offsets of the texts: what a token decides is found once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.cast(pa.string()).fill_null("")))
    coded = pa.concat_arrays([pa.array([""]), lists.flatten()]).dictionary_encode()
    code = coded.indices.to_numpy()[1:]
    word = code > 0
    offsets = np.concatenate([[0], np.cumsum(word)])[lists.offsets.to_numpy()] + np.arange(len(column) + 1)
    out = np.zeros(offsets[-1], np.int32)
    inside = np.ones(offsets[-1], bool)
    inside[offsets[1:] - 1] = False
    out[inside] = code[word]
    return coded.dictionary.cast(pa.binary()), out, offsets


def class_of(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % CLASSES


@lru_cache(maxsize=1)
def _class_of_ending() -> np.ndarray:
    """Classes of all endings of two bytes, then of one, then of none."""
    two = [bytes((a, b)) for a in range(256) for b in range(256)]
    return np.array([class_of(x) for x in (*two, *(bytes((a,)) for a in range(256)), b"")], np.int32)


def classes_of(names: pa.Array) -> np.ndarray:
    """``class_of`` every token of a column."""
    raw, at = column_bytes(names)
    sizes = np.diff(at)
    ending = np.full(len(names), (1 << 16) + 256)
    some, more = np.flatnonzero(sizes > 0), np.flatnonzero(sizes > 1)
    ending[some] = (1 << 16) + raw[at[some + 1] - 1].astype(np.int64)
    ending[more] = raw[at[more + 1] - 2].astype(np.int64) << 8 | raw[at[more + 1] - 1]
    return _class_of_ending()[ending]


def places(names: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of every token among the known ones, -1 for others."""
    return pc.index_in(names, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def summed(tables: list[pa.Table]) -> pa.Table:
    """token, c: the counts of several tables added up."""
    out = pa.concat_tables(tables).group_by("token", use_threads=False).aggregate([("c", "sum")])
    return pa.table({"token": out["token"], "c": out["c_sum"]}).combine_chunks()


def count_tokens(docs: DataFrame) -> DataFrame:
    """token (binary), c: occurrences in all of ``docs``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = seen = 0
        for batch in chunks(batches, "text", TEXT_BYTES):
            names, code, _ = numbered(batch.column("text"))
            held.append(pa.table({"token": names, "c": np.bincount(code, minlength=len(names))}))
            n += len(names)
            if n > max(HELD_TOKENS, 2 * seen):
                held = [summed(held)]
                n = seen = len(held[0])
                if n > HELD_TOKENS:
                    yield from held[0].to_batches()
                    held, n, seen = [], 0, 0
        if held:
            yield from summed(held).to_batches()

    part = docs.select("text").mapInArrow(run, "token binary, c long")
    return part.groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """What a task needs: counts of the head, symbol numbers, class sums, embeddings."""

    head: dict[bytes, int]
    symbols: dict[bytes, int]
    class_sums: np.ndarray
    total: int
    distinct: int
    context: np.ndarray  # position x (symbols + begin) x width
    output: np.ndarray  # width x symbols
    bias: np.ndarray

    def log_probs(self, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities."""
        return Scores(self)(before, symbol)


class Scores:
    """Normalised natural log-probabilities of symbols after their histories.

    A score is a sum over positions, so its exponential is a product of rows that are made once
    for each symbol at each position. The sums over all symbols of ``SLOTS`` histories are kept, each in
    the slot of its hash. Rows are shifted by their largest score; where a product still
    vanishes, the sum is made of the scores themselves.
    """

    def __init__(self, model: Model):
        self.parts = [np.matmul(c, model.output, dtype=np.float32) for c in model.context]
        self.parts[0] = self.parts[0] + model.bias.astype(np.float32)
        self.tops = [p.max(axis=1) for p in self.parts]
        self.rows = [np.exp(p - t[:, None]) for p, t in zip(self.parts, self.tops)]
        self.code = np.full(SLOTS, -1)
        self.sums = np.zeros(SLOTS)

    def log_sums(self, before: np.ndarray) -> np.ndarray:
        ones = np.ones(self.rows[0].shape[1], np.float32)
        out = np.empty(len(before))
        for a in range(0, len(before), BATCH_TOKENS):
            h = before[a : a + BATCH_TOKENS]
            e = self.rows[0].take(h[:, 0], axis=0)
            for j in range(1, ORDER):
                e *= self.rows[j].take(h[:, j], axis=0)
            s = (e @ ones).astype(np.float64)
            small = np.flatnonzero(s < 1e-20)
            s[small] = 1
            own = np.log(s) + sum(t[h[:, j]].astype(np.float64) for j, t in enumerate(self.tops))
            if len(small):
                x = sum(p[h[small, j]].astype(np.float64) for j, p in enumerate(self.parts))
                top = x.max(axis=1)
                own[small] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
            out[a : a + BATCH_TOKENS] = own
        return out

    def __call__(self, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = np.empty(len(symbol))
        for a in range(0, len(symbol), LOOKED_UP):
            h, y = before[a : a + LOOKED_UP], symbol[a : a + LOOKED_UP]
            code = h[:, 0].astype(np.int64)
            for j in range(1, ORDER):
                code = code * len(self.tops[0]) + h[:, j]
            slot = (code * 0x9E3779B1 >> 16) & (SLOTS - 1)
            sums = self.sums[slot]
            new = np.flatnonzero(self.code[slot] != code)
            sums[new] = self.log_sums(h[new])
            # a slot's code and sum are of the same history: where several share it, the last one stays in both
            self.code[slot[new]] = code[new]
            self.sums[slot[new]] = sums[new]
            out[a : a + LOOKED_UP] = sum(p[h[:, j], y].astype(np.float64) for j, p in enumerate(self.parts)) - sums
        return out


def histories(symbol: np.ndarray, first: np.ndarray, begin: int) -> np.ndarray:
    """For each position the ORDER symbols before it in its text, nearest first."""
    n = len(symbol)
    out = np.full((n, ORDER), begin, np.int32)
    last = np.append(first[1:], n)
    for j in range(ORDER):
        out[j + 1 :, j] = symbol[: max(n - j - 1, 0)]
        for d in range(j + 1):
            at = first + d
            out[at[at < last], j] = begin
    return out


class Numbers(dict):
    """Symbol of every token: the frequent ones are given, classes are found as they come."""

    def __init__(self, symbols: dict[bytes, int]):
        super().__init__(symbols)
        self.symbols = symbols

    def __missing__(self, token: bytes) -> int:
        if len(self) > HELD_TOKENS:
            self.clear()
            self.update(self.symbols)
        out = self[token] = self.symbols[token] if token in self.symbols else len(self.symbols) + class_of(token)
        return out


@dataclass
class Descent:
    """Parameters, Adagrad's sums of their squared gradients, and the noise distribution."""

    params: list[np.ndarray]  # words, scale, output, bias
    sums: list[np.ndarray]
    unigram: np.ndarray

    @classmethod
    def begin(cls, unigram: np.ndarray, rng: np.random.Generator) -> Descent:
        n = len(unigram)
        words = rng.normal(0, 0.1, (n + 1, WIDTH)).astype(np.float32)
        scale = np.full((ORDER, WIDTH), 0.5, np.float32)
        output = rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32)
        params = [words, scale, output, np.log(unigram).astype(np.float32)]
        return cls(params, [np.full_like(x, 1e-6) for x in params], unigram)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.params, *self.sums)])

    def moved_to(self, flat: np.ndarray) -> Descent:
        shapes = [x.shape for x in (*self.params, *self.sums)]
        ends = np.cumsum([int(np.prod(x)) for x in shapes])
        all_of = [x.reshape(shape).astype(np.float32) for x, shape in zip(np.split(flat, ends[:-1]), shapes)]
        return Descent(all_of[:4], all_of[4:], self.unigram)

    def run(self, symbol: np.ndarray, before: np.ndarray, rng: np.random.Generator, noise: int = 128, batch: int = 512, rate: float = 0.1) -> None:
        """One pass over all positions in random order; noise is shared by a batch."""
        (words, scale, output, bias), n_symbols = self.params, len(self.unigram)
        log_noise = np.log(noise * self.unigram).astype(np.float32)
        order = rng.permutation(len(symbol))
        chance = np.cumsum(self.unigram)
        shift = np.arange(ORDER) * (n_symbols + 1)
        for a in range(0, len(order), batch):
            at = order[a : a + batch]
            y, h = symbol[at], before[at]
            z = np.minimum(np.searchsorted(chance, rng.random(noise) * chance[-1], side="right"), n_symbols - 1)
            # rows of all positions in one table: a position's part starts at a multiple of the words
            key = (h + shift).T.ravel()
            q = (words * scale[:, None]).reshape(-1, WIDTH).take(key, axis=0).reshape(ORDER, -1, WIDTH).sum(axis=0)
            out_y, out_z = output.take(y, axis=0), output.take(z, axis=0)
            data = np.einsum("ij,ij->i", q, out_y) + (bias - log_noise)[y]
            false = q @ out_z.T
            false += (bias - log_noise)[z]
            g_data = -1 / (1 + np.exp(np.clip(data, -30, 30)))
            np.negative(false, out=false)
            with np.errstate(over="ignore"):  # an infinite one counts as such
                np.exp(false, out=false)
            false += 1
            g_false = np.reciprocal(false, out=false)
            g_q = g_false @ out_z
            g_q += g_data[:, None] * out_y
            to = np.concatenate([y, z])
            g_out = sums_by(to, np.concatenate([g_data[:, None] * q, g_false.T @ q]), n_symbols)
            g_bias = np.bincount(to, np.concatenate([g_data, g_false.sum(axis=0)]), n_symbols).astype(np.float32)
            # the gradients of words and of scales are made of the same sums by position and word
            by_word = sums_by(key, g_q, ORDER * (n_symbols + 1)).reshape(ORDER, -1, WIDTH)
            g_scale = np.einsum("jvw,vw->jw", by_word, words)
            g_words = np.einsum("jvw,jw->vw", by_word, scale)
            for param, total, grad in zip(self.params, self.sums, (g_words, g_scale, g_out, g_bias)):
                grad /= len(at)
                total += grad * grad
                param -= rate * grad / np.sqrt(total)

    def put(self, model: Model) -> Model:
        words, scale, output, bias = self.params
        model.context = np.stack([words * c for c in scale])
        model.output, model.bias = np.ascontiguousarray(output.T), bias
        return model


def sums_by(key: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each key below n; several keys' worth of the same rows may follow one
    another. Two numbers are added at a time, as one complex one."""
    order = np.argsort(key.astype(np.uint16), kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    out = np.zeros((n, rows.shape[1]), np.float32)
    pairs = rows.take(order % len(rows), axis=0).view(np.complex64)
    out[key[first]] = np.add.reduceat(pairs, first, axis=0).view(np.float32)
    return out


def start(texts: list[str], model: Model, unigram: np.ndarray | None = None, epochs: int = 3, seed: int = 3) -> Descent | None:
    """Noise-contrastive estimation on ``texts``; without them and ``unigram`` there is nothing to learn."""
    numbers = Numbers(model.symbols)
    each = [[numbers[x] for x in tokens(text)] for text in texts]
    symbol = np.array([s for own in each for s in own], np.int32)
    n_symbols = len(model.bias)
    if unigram is None:
        if not len(symbol):
            return None
        unigram = (np.bincount(symbol, minlength=n_symbols) + 0.5) / (len(symbol) + 0.5 * n_symbols)
    rng = np.random.default_rng(seed)
    now = Descent.begin(unigram, rng)
    before = histories(symbol, np.cumsum([0, *map(len, each)])[:-1], n_symbols)
    for _ in range(epochs if len(symbol) else 0):
        now.run(symbol, before, rng)
    return now


def train(texts: list[str], model: Model, epochs: int = 3) -> Model:
    """The model learnt from ``texts`` alone, in this process."""
    now = start(texts, model, epochs=epochs)
    return now.put(model) if now else model


def shards(docs: DataFrame, model: Model) -> DataFrame:
    """key, symbols: the symbols of every document (two bytes each), dealt evenly and at random.
    Rows without an id are dealt by their place, as many may share one text."""
    small_batches(docs.sparkSession)
    symbols = model.symbols
    known = pa.array(list(symbols), pa.binary())
    if ORDER * (len(model.bias) + 1) >= 1 << 16:
        raise ValueError("symbols are numbered in two bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", TEXT_BYTES):
            names, code, offsets = numbered(batch.column("text"))
            place = places(names, known)
            each = np.where(place < 0, len(symbols) + classes_of(names), place).astype(np.uint16)
            ends = (2 * offsets).astype(np.int32)
            out = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(each[code])])
            yield pa.RecordBatch.from_arrays([batch.column("key"), out], names=["key", "symbols"])

    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id()), "text").alias("key")
    n = max(1, -(-model.total // SHARD_TOKENS))
    rows = docs.select(key, "text").mapInArrow(run, "key long, symbols binary")
    return checkpoint(rows.repartition(n, "key").sortWithinPartitions("key", "symbols"))


def one_round(dealt: DataFrame, now: Descent, seed: int) -> Descent:
    """The average of where all shards lead from ``now``, weighted by tokens."""
    begin = len(now.unigram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, seen, rng = now.moved_to(now.flat()), 0, None
        held: list[np.ndarray] = []
        n_held = 0

        def learn() -> None:
            sizes = [len(x) for x in held]
            symbol = np.concatenate(held)
            mine.run(symbol, histories(symbol, np.cumsum([0, *sizes[:-1]]), begin), rng, noise=64, batch=1024)
            held.clear()

        for batch in batches:
            for key, symbols in zip(batch.column("key"), batch.column("symbols")):
                rng = rng or np.random.default_rng([seed, key.as_py() & (1 << 62) - 1])
                held.append(np.frombuffer(symbols.as_buffer(), np.uint16))
                seen += len(held[-1])
                n_held += len(held[-1])
                if n_held >= HELD_SYMBOLS:
                    learn()
                    n_held = 0
        if held:
            learn()
        if seen:
            v = mine.flat().astype(np.float64) * seen
            for a in range(0, len(v), 1 << 14):
                part = v[a : a + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part), dtype=np.int32)), pa.array(part), pa.array(np.full(len(part), seen, np.int64))], names=["i", "v", "n"])

    rows = dealt.mapInArrow(run, "i int, v double, n long").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).collect()
    flat = now.flat().astype(np.float64)
    flat[[r["i"] for r in rows]] = [r["v"] for r in rows]
    return now.moved_to(flat)


def frequent_tokens(counts: DataFrame, head: int) -> DataFrame:
    """The tokens above a count, the lowest of a grid of eighths of an octave that leaves at most
    ``head``. Unlike a sorted limit, no task sends more than its share of them."""
    step = F.floor(F.log2("c") * 8).cast("int")
    floor, held = None, 0
    for r in sorted(counts.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["k"]):
        held += r["n"]
        if held > head:
            break
        floor = r["k"]
    return counts.where(step >= floor) if floor is not None else counts.limit(0)


def fit(train_docs: DataFrame, counts: DataFrame, sample: int = SAMPLE, head: int = HEAD, frequent: int = FREQUENT, rounds: int = ROUNDS) -> Model:
    """Totals, head and class sums from the counts, the neural part from all training documents."""
    n = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    rows = frequent_tokens(counts, head).collect()
    known = {bytes(r["token"]): r["c"] for r in sorted(rows, key=lambda r: (-r["c"], bytes(r["token"])))}
    symbols = {t: i for i, t in enumerate(list(known)[:frequent])}
    by = F.pmod(F.crc32(F.when(F.octet_length("token") > 2, F.substring("token", -2, 2)).otherwise(F.col("token"))), F.lit(CLASSES))
    sums = np.zeros(CLASSES)
    for r in counts.groupBy(by.alias("k")).agg(F.sum(F.col("c") + 0.5).alias("s")).collect():
        sums[r["k"]] = r["s"]
    for t in symbols:
        sums[class_of(t)] -= known[t] + 0.5
    n_symbols = len(symbols) + CLASSES
    model = Model(known, symbols, sums, int(n["n"] or 0), int(n["v"] or 0), np.zeros((ORDER, n_symbols + 1, WIDTH), np.float32), np.zeros((WIDTH, n_symbols), np.float32), np.zeros(n_symbols, np.float32))
    few = train_docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = train_docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(few), "doc_id").collect()
    if not model.total:
        return model
    seen = np.array([*(known[t] for t in symbols), *sums]) + 0.5
    now = start([r["text"] for r in sorted(texts, key=lambda r: (r["doc_id"], r["text"]))], model, seen / seen.sum())
    dealt = shards(train_docs, model)
    for k in range(rounds):
        now = one_round(dealt, now, k)
    return now.put(model)


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score, a row for each of ``docs``.

    A task adds up what the head decides and emits one row per text and one per distinct rare
    token of a text; a join by token supplies the rare counts, a sum by text puts all together.
    """
    small_batches(docs.sparkSession)
    floor = log10(model.total + 0.5 * (model.distinct + 1))
    class_log = np.log10(model.class_sums + 0.5)
    n_words, begin = len(model.symbols), len(model.bias)
    head = pa.array(list(model.head), pa.binary())  # the frequent ones come first
    logs = np.array([log10(c + 0.5) for c in model.head.values()] + [0.0])  # the last for what is not in the head
    schema = "doc_id long, text_hash long, token binary, n long, rows long, n_tokens long, n_known long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for batch in chunks(batches, "text", TEXT_BYTES):
            k = batch.num_rows
            names, code, offsets = numbered(batch.column("text"))
            # what a token decides, for every distinct one
            place = places(names, head)
            own = np.flatnonzero((place >= 0) & (place < n_words))
            symbol_of = n_words + classes_of(names)
            share = logs[place] - class_log[symbol_of - n_words]
            symbol_of[own], share[own] = place[own], 0
            first = offsets[:-1]
            sizes = np.diff(offsets)
            known = np.add.reduceat((place >= 0).astype(np.int64)[code], first)
            base = np.add.reduceat(logs[place][code], first) - sizes * floor
            symbol = symbol_of[code]
            lp = scores(histories(symbol, first, begin), symbol)
            total = np.add.reduceat(share[code], first) + np.add.reduceat(lp, first) / np.log(10)
            hashes = np.array([xxhash.xxh64_intdigest(v.as_buffer() or b"") for v in batch.column("text")], np.uint64).view(np.int64)
            # the rare tokens of each text
            tail = np.flatnonzero((place < 0)[code])
            pair, n = np.unique(np.repeat(np.arange(k), sizes)[tail] * len(names) + code[tail], return_counts=True)
            at, rare = np.divmod(pair, len(names))
            # a text's own row carries a key with a space, which no token has
            keys = pa.concat_arrays([pa.array([b" %d" % h for h in hashes], pa.binary()), names.take(pa.array(rare))])
            both = np.concatenate([np.arange(k), at])
            zeros = np.zeros(len(at), np.int64)
            long = lambda a, b: pa.array(np.concatenate([a, b]).astype(np.int64))
            real = lambda a: pa.array(np.concatenate([a, zeros.astype(np.float64)]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(both)), pa.array(hashes[both]), keys, long(np.zeros(k), n), long(np.ones(k), zeros),
                    long(sizes, zeros), long(known, zeros), real(base), real(total),
                ],
                names=["doc_id", "text_hash", "token", "n", "rows", "n_tokens", "n_known", "base_score", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    joined = rows.join(counts.hint("shuffle_hash"), "token", "left")
    weight = F.log10(F.coalesce("c", F.lit(0)) + 0.5) * F.col("n")
    sums = joined.groupBy("doc_id", "text_hash").agg(
        F.sum("rows").alias("rows"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base_score") + weight).alias("base_score"), F.sum(F.col("score") + weight).alias("score"),
    )
    each = sums.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select(
        "doc_id", *[(F.col(c) / F.col("rows")).cast("long").alias(c) for c in ("n_tokens", "n_known")], F.lit(model.total).cast("long").alias("train_tokens"),
        *[(F.col(c) / F.col("rows")).alias(c) for c in ("base_score", "score")],
    )


def fit_and_score(docs: DataFrame, train_docs: DataFrame, **options) -> DataFrame:
    counts = checkpoint(count_tokens(train_docs))
    return score(docs, counts, fit(train_docs, counts, **options))
