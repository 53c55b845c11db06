"""Alignment of two tokenizers over the same bytes, by an associative monoid of fragments.

Both tokenizers cut a text's bytes into tokens. Where a token of each ends at the same byte
lies a cut; cuts divide the text into groups, and every A token of a group is linked with every
B token of it. A fragment describes the tokens that end within a range of bytes: those before
its first cut (open prefix), the groups between cuts (closed), those after its last cut (open
suffix); a range without a cut is an open prefix alone. Two neighbouring fragments compose: the
left suffix and the right prefix meet in one more closed group. Composition is associative and
closed groups never change again, so only the open ends of a fragment travel.

Jobs. (1) Texts are tokenised once, in stretches that end before the blank of a new word, where
neither tokenizer's tokens reach across; documents of up to ``chunk`` bytes are one fragment,
closed in place, and longer ones are written as byte-range chunks. (2) Chunks are dealt over
all tasks and become fragments. (3) ``fan`` neighbours at a time are composed, a reduction tree
of log(chunks) rounds whatever the table holds. (4) An id pair counts once a document; tasks
pre-aggregate, one shuffle adds up. The most frequent pairs, ``HEAD`` at most, are sent to the
tasks as three arrays; the others meet their counts in a join, the same way at every size. The
highest count of each A id is a table of at most the vocabulary's size. (5) The text of a long
document's groups is hashed piece after piece in order.

A group of very many tokens is linked by distinct ids with their multiplicities, in blocks; a
document that has one goes the way of the long ones, whatever its length.

Null and empty texts, and those whose tokens don't join up to the space and the text, have no
tokens: zeros and ''. Repeated rows are rows of their own and count as documents of their own.
Without rows the result is empty. Other columns are not read. Strings of special tokens are
plain text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.base import checkpoint, chunks
from stepfold.llm.bpe import byte_characters
from stepfold.llm.lm import frequent_tokens
from stepfold.plans.session import scratch

#: Keys in one block of the links of a group of very many tokens.
BLOCK = 1 << 20
#: Pairs whose counts every task holds, at most, and pairs pre-aggregated in a task.
HEAD, HELD = 1 << 19, 1 << 22
#: Bits of a B id in a pair's key.
B_BITS = 15
#: Fixed value: the split pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Sizes:
    """Bytes of a chunk of a long document, characters tokenised at a time, neighbouring fragments
    composed in one step of the tree, links of a group from which on distinct ids are counted."""

    chunk: int = 1 << 16
    stretch: int = 1 << 16
    fan: int = 16
    many: int = 1 << 12


_NEW_WORD = re.compile(r"\S(?= \S)")


class Pair:
    """Both tokenizers, the bytes of all their tokens, and decimal ids for the groups' text."""

    def __init__(self, a_path: str, b_path: str):
        to_byte = byte_characters()
        with open(a_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items()}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.a_bytes[i] = t
        n = self.b.get_piece_size()
        if n > 1 << B_BITS or len(self.a_bytes) > 1 << (32 - B_BITS):
            raise ValueError("ids of both tokenizers must fit in 32 bits together")
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        shown = [b",%d" % i for i in range(max(n, len(self.a_bytes)))]
        self.block = np.frombuffer(b"".join(shown), np.uint8)
        self.shown = np.array([len(x) for x in shown], np.int64)
        self.offset = np.cumsum(self.shown) - self.shown

    def tokens(self, text: str, stretch: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and of B; None if their bytes don't join up to the space and the text."""
        whole = " " + text
        ends = []
        if len(whole) > stretch:
            at = 0
            while len(whole) - at > stretch and (m := _NEW_WORD.search(whole, at + stretch)):
                ends.append(at := m.end())
        a_all, b_all = [], []
        for start, end in zip([0, *ends], [*ends, len(whole)]):
            part = whole[start:end]
            a, b = self.a.encode_ordinary(part), self.b.encode(part[1:])
            raw = part.encode()
            if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
                return None
            a_all.append(np.array(a, np.int64))
            b_all.append(np.array(b, np.int64))
        return (a_all[0], b_all[0]) if len(a_all) == 1 else (np.concatenate(a_all), np.concatenate(b_all))

    def text(self, a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The groups as text, each token after its separator, and where each group starts in it."""
        n_a, n_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[np.arange(len(a)) + first_b[ga]] = a
        ids[np.arange(len(b)) + (first_a + n_a)[gb]] = b
        mark[first_a + first_b], mark[first_a + first_b + n_a] = ord(";"), ord("|")
        size = self.shown[ids]
        ends = np.cumsum(size)
        begin = ends - size
        out = self.block[np.repeat(self.offset[ids] - begin, size) + np.arange(ends[-1] if len(ends) else 0)]
        out[begin] = mark
        return out, begin[first_a + first_b]


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    """Both tokenizers, once in each Python process."""
    return Pair(a_path, b_path)


def cut(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where both end, and the number of cuts before each A and each B token's last byte."""
    at = np.minimum(np.searchsorted(b_end, a_end), max(len(b_end) - 1, 0))
    hit = b_end[at] == a_end if len(b_end) else np.zeros(len(a_end), bool)
    hit_b = np.zeros(len(b_end), bool)
    hit_b[at[hit]] = True
    return a_end[hit], np.cumsum(hit) - hit, np.cumsum(hit_b) - hit_b


def link_keys(a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of every link (A id, B id) of the groups, and the group it is of."""
    n_b = np.bincount(gb, minlength=n)
    each = n_b[ga]
    total = np.cumsum(each)
    at_b = np.repeat((np.cumsum(n_b) - n_b)[ga] - (total - each), each) + np.arange(total[-1] if len(total) else 0)
    return np.repeat(a << B_BITS, each) | b[at_b], np.repeat(ga, each)


def many_links(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct link keys of one group of many tokens and how often each occurs, in blocks."""
    (ua, ca), (ub, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    rows = max(1, BLOCK // len(ub))
    for i in range(0, len(ua), rows):
        yield (ua[i : i + rows, None] << B_BITS | ub).ravel(), (ca[i : i + rows, None] * cb).ravel()


_ROW = "rid long, doc_id long, no int, whole boolean, n_a long, n_b long, n_groups long, n_links long, keys binary, times binary, groups_sha256 string, a binary, a_end binary, b binary, b_end binary"


def tokenise(docs: DataFrame, a_path: str, b_path: str, sizes: Sizes = Sizes()) -> DataFrame:
    """A row for every short document, aligned; rows of chunks for the others. Not remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(a_path, b_path)
        for batch in batches:
            for part in chunks([batch], "text", 1 << 20):
                yield from _aligned(own, part, sizes)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, _ROW)


def _aligned(own: Pair, part: pa.RecordBatch, sizes: Sizes) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    docs, a_parts, b_parts, at = [], [], [], 0
    for rid, doc, text in zip(part.column("rid").to_pylist(), part.column("doc_id").to_pylist(), part.column("text")):
        text = text.as_py()
        found = own.tokens(text, sizes.stretch) if text else None
        row = {"rid": rid, "doc_id": doc, "no": 0, "whole": True, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "keys": b"", "times": b"", "groups_sha256": ""}
        if found is None:
            out.append(row)
            continue
        a, b = found
        a_end, b_end = np.cumsum(own.a_size[a]), np.cumsum(own.b_size[b])
        long = a_end[-1] > sizes.chunk
        if not long:
            _, ga, gb = cut(a_end, b_end)
            long = int((np.bincount(ga) * np.bincount(gb)).max()) > sizes.many
        if long:
            for no in range(int(a_end[-1] - 1) // sizes.chunk + 1):
                low, high = no * sizes.chunk + 1, (no + 1) * sizes.chunk
                sa, sb = (slice(*np.searchsorted(e, [low, high + 1])) for e in (a_end, b_end))
                raw = {"a": a[sa].astype("<u4"), "a_end": a_end[sa], "b": b[sb].astype("<u4"), "b_end": b_end[sb]}
                out.append({**row, "no": no, "whole": False, "n_a": len(raw["a"]), "n_b": len(raw["b"]), **{k: v.tobytes() for k, v in raw.items()}})
            continue
        docs.append((row, len(a), len(b)))
        a_parts.append((a, a_end + at))
        b_parts.append((b, b_end + at))
        at += int(a_end[-1])
    if docs:
        (a, a_end), (b, b_end) = (tuple(map(np.concatenate, zip(*p))) for p in (a_parts, b_parts))
        cuts, ga, gb = cut(a_end, b_end)
        n = len(cuts)
        # the group each document starts with, and the document of each group
        first_a = np.cumsum([0, *(x for _, x, _ in docs)])
        start = np.append(ga[first_a[:-1]], n)
        doc_of = np.repeat(np.arange(len(docs)), np.diff(start))
        key, group = link_keys(a, ga, b, gb, n)
        per, times = np.unique(doc_of[group] << 32 | key, return_counts=True)
        in_doc = np.searchsorted(per, np.arange(len(docs) + 1) << 32)
        links = np.bincount(doc_of[group], minlength=len(docs))
        text, begin = own.text(a, ga, b, gb, n)
        begin = np.append(begin, len(text))
        keys, times = (per & 0xFFFFFFFF).astype("<u4"), times.astype("<u4")
        raw = text.tobytes()
        for d, (row, n_a, n_b) in enumerate(docs):
            s = slice(in_doc[d], in_doc[d + 1])
            sha = hashlib.sha256(raw[begin[start[d]] + 1 : begin[start[d + 1]]]).hexdigest()
            out.append({**row, "n_a": n_a, "n_b": n_b, "n_groups": int(start[d + 1] - start[d]), "n_links": int(links[d]), "keys": keys[s].tobytes(), "times": times[s].tobytes(), "groups_sha256": sha})
    yield _batch(out, _SCHEMA)


def _schema(**kinds: str) -> pa.Schema:
    of = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(k, of[v]) for k, v in kinds.items()])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{k: r.get(k) for k in schema.names} for r in rows], schema)


_SCHEMA = _schema(**dict(x.split() for x in _ROW.split(", ")))
#: Closed groups (is_open false) with their place, and the open ends of a fragment.
_PIECE = "rid long, is_open boolean, no int, at int, seam int, n_groups long, n_links long, keys binary, times binary, text binary, has_cut boolean, pa binary, pb binary, sa binary, sb binary"
_PIECES = _schema(**dict(x.split() for x in _PIECE.split(", ")))


def closed(own: Pair, rid: int, at: int, seam: int, a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, n: int, most: int) -> Iterator[dict]:
    """Rows of ``n`` closed groups: counts and text first, their link keys in blocks."""
    text, _ = own.text(a, ga, b, gb, n)
    n_a, n_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    many = n_a * n_b > most
    row = {"rid": rid, "is_open": False, "no": at, "at": at, "seam": seam}
    few_a, few_b = ~many[ga], ~many[gb]
    name = np.cumsum(~many) - 1
    key, _ = link_keys(a[few_a], name[ga[few_a]], b[few_b], name[gb[few_b]], int((~many).sum()))
    key, times = np.unique(key, return_counts=True)
    yield {**row, "n_groups": n, "n_links": int((n_a * n_b).sum()), "text": text.tobytes()[1:], "keys": key.astype("<u4").tobytes(), "times": times.astype("<i8").tobytes()}
    for g in np.flatnonzero(many):
        for key, times in many_links(a[ga == g], b[gb == g]):
            yield {**row, "keys": key.astype("<u4").tobytes(), "times": times.astype("<i8").tobytes()}


def _ids(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u4").astype(np.int64)


def fragment(own: Pair, row: dict, sizes: Sizes) -> Iterator[dict]:
    """Closed groups and open ends of one chunk. The start of a text is a cut."""
    a, b = _ids(row["a"]), _ids(row["b"])
    cuts, ga, gb = cut(np.frombuffer(row["a_end"], np.int64), np.frombuffer(row["b_end"], np.int64))
    n, low = len(cuts), 0 if row["no"] == 0 else 1
    inside_a, inside_b = (ga >= low) & (ga < n), (gb >= low) & (gb < n)
    if n > low:
        yield from closed(own, row["rid"], row["no"], 0, a[inside_a], ga[inside_a] - low, b[inside_b], gb[inside_b] - low, n - low, sizes.many)
    has_cut = n > 0 or low == 0
    before = (ga < low, gb < low) if has_cut else (ga >= 0, gb >= 0)
    after = (ga >= n, gb >= n) if has_cut else (ga < 0, gb < 0)
    ends = {k: x[m].astype("<u4").tobytes() for k, x, m in (("pa", a, before[0]), ("pb", b, before[1]), ("sa", a, after[0]), ("sb", b, after[1]))}
    yield {"rid": row["rid"], "is_open": True, "no": row["no"], "at": row["no"], "has_cut": has_cut, **ends}


def compose(own: Pair, rows: Iterator[dict], no: int, sizes: Sizes) -> Iterator[dict]:
    """Neighbouring fragments of one document as one, and the groups closed where they meet."""
    left: dict | None = None
    held: dict[str, list[bytes]] = {}
    for r in rows:
        if left is None:
            left, held = dict(r), {k: [r[k]] for k in ("pa", "pb", "sa", "sb")}
        elif not r["has_cut"]:
            ends = ("sa", "sb") if left["has_cut"] else ("pa", "pb")
            for k, x in zip(ends, (r["pa"], r["pb"])):
                held[k].append(x)
        elif not left["has_cut"]:
            for k, x in (("pa", r["pa"]), ("pb", r["pb"])):
                held[k].append(x)
            held["sa"], held["sb"] = [r["sa"]], [r["sb"]]
            left["has_cut"], left["at"] = True, r["at"]
        else:
            a, b = (_ids(b"".join(held[s]) + r[p]) for s, p in (("sa", "pa"), ("sb", "pb")))
            if len(a):
                yield from closed(own, r["rid"], left["at"], 1, a, np.zeros(len(a), np.int64), b, np.zeros(len(b), np.int64), 1, sizes.many)
            held["sa"], held["sb"] = [r["sa"]], [r["sb"]]
            left["at"] = r["at"]
    if left is not None:
        yield {**left, "no": no, **{k: b"".join(v) for k, v in held.items()}}


def reduce_fragments(parts: DataFrame, a_path: str, b_path: str, sizes: Sizes = Sizes()) -> DataFrame:
    """All closed groups of the long documents: fragments of their chunks, then the tree."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(a_path, b_path)
        for batch in batches:
            for i in range(len(batch)):
                for out in fragment(own, batch.slice(i, 1).to_pylist()[0], sizes):
                    yield _batch([out], _PIECES)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(a_path, b_path)
        rows = (r for batch in batches for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist())
        for (_, no), some in groupby(rows, key=lambda r: (r["rid"], r["no"] // sizes.fan)):
            for out in compose(own, some, no, sizes):
                yield _batch([out], _PIECES)

    top = parts.agg(F.max("no").alias("n")).first()["n"]
    every = checkpoint(parts.select("rid", "no", "a", "a_end", "b", "b_end").repartition("rid", "no").mapInArrow(make, _PIECE))
    done = every.where("not is_open")
    now = every.where("is_open")
    while top:  # one chunk is whole
        dealt = now.repartition("rid", F.floor(F.col("no") / sizes.fan)).sortWithinPartitions("rid", "no")
        now = checkpoint(dealt.mapInArrow(level, _PIECE))
        done, now, top = done.unionByName(now.where("not is_open")), now.where("is_open"), top // sizes.fan
    return done


def long_links(done: DataFrame) -> DataFrame:
    """rid, key, times: the distinct links of the long documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, keys, times in zip(*(batch.column(c).to_pylist() for c in ("rid", "keys", "times"))):
                key, n = np.frombuffer(keys, "<u4").astype(np.int64), np.frombuffer(times, "<i8")
                for i in range(0, len(key), 1 << 16):
                    k = key[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), rid)), pa.array(k), pa.array(n[i : i + (1 << 16)])], names=["rid", "key", "times"])

    rows = done.select("rid", "keys", "times").mapInArrow(run, "rid long, key long, times long")
    return rows.groupBy("rid", "key").agg(F.sum("times").alias("times"))


def long_hashes(done: DataFrame) -> DataFrame:
    """rid, groups_sha256 of the long documents; a document's text runs through one digest, piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r, t.as_py()) for batch in batches for r, t in zip(batch.column("rid").to_pylist(), batch.column("text")))
        for rid, some in groupby(rows, key=lambda r: r[0]):
            seen = hashlib.sha256()
            for k, (_, text) in enumerate(some):
                seen.update(b";" + text if k else text)
            yield pa.RecordBatch.from_arrays([pa.array([rid], pa.int64()), pa.array([seen.hexdigest()])], names=["rid", "groups_sha256"])

    pieces = done.where("text is not null").select("rid", "at", "seam", "text")
    return pieces.repartition("rid").sortWithinPartitions("rid", "at", "seam").mapInArrow(run, "rid long, groups_sha256 string")


def document_counts(short: DataFrame, long: DataFrame) -> DataFrame:
    """key, c, best: in how many documents a pair is linked, and whether no pair of its A id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        keys, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)

        def fold() -> None:
            nonlocal keys, n, size
            new, c = np.unique(np.concatenate(held), return_counts=True)
            every, weight = np.concatenate([keys, new]), np.concatenate([n, c])
            order = np.argsort(every, kind="stable")
            every, weight = every[order], weight[order]
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            keys, n = every[first], np.add.reduceat(weight, first)
            held.clear()
            size = 0

        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["key", "c"])
        for batch in batches:
            for x in batch.column("keys"):
                held.append(np.frombuffer(x.as_buffer(), "<u4"))
                size += len(held[-1])
                if size >= HELD:
                    fold()
                    if len(keys) >= HELD:
                        yield out()
                        keys, n = keys[:0], n[:0]
        if held:
            fold()
        yield out()

    part = short.where("n_a > 0").select("keys").mapInArrow(run, "key long, c long")
    counts = part.unionByName(long.select("key", F.lit(1).cast("long").alias("c"))).groupBy("key").agg(F.sum("c").alias("c"))
    counts = checkpoint(counts)
    most = counts.groupBy(F.shiftright("key", B_BITS).alias("__a")).agg(F.max("c").alias("__m"))  # at most a row for each A id
    joined = counts.join(F.broadcast(most), F.shiftright("key", B_BITS) == F.col("__a"))
    return checkpoint(joined.select("key", "c", (F.col("c") == F.col("__m")).alias("best")))


def align(docs: DataFrame, a_path: str, b_path: str, head: int = HEAD, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each of ``docs``."""
    spark = docs.sparkSession
    path = scratch(spark, "aligned")
    tokenise(docs, a_path, b_path, sizes).write.parquet(path)
    rows = spark.read.parquet(path)
    short, parts = rows.where("whole"), rows.where("not whole")
    done = reduce_fragments(parts, a_path, b_path, sizes)
    long = checkpoint(long_links(done))
    counts = document_counts(short, long)
    top = frequent_tokens(counts, head).toArrow()
    keys = top.column("key").to_numpy().astype(np.uint32)
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((keys[order], top.column("c").to_numpy()[order], top.column("best").to_numpy(zero_copy_only=False)[order]))
    schema = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, key long, times long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counted, is_best = known.value
        for batch in batches:
            for part in chunks([batch], "keys", 1 << 20):
                n = len(part)
                size = np.array([len(x.as_buffer()) // 4 for x in part.column("keys")], np.int64)
                key, times = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u4") for c in ("keys", "times"))
                doc = np.repeat(np.arange(n), size)
                at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
                best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
                t = times[hit].astype(np.int64)
                np.add.at(total, doc[hit], t * counted[at[hit]])
                np.add.at(best, doc[hit], t * is_best[at[hit]])
                rare = np.flatnonzero(~hit)
                none = lambda kind: pa.nulls(len(rare), kind)
                rid = part.column("rid").to_numpy()
                same = {c: pa.concat_arrays([part.column(c), none(part.column(c).type)]) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
                new = {"rid": pa.array(np.append(rid, rid[doc[rare]])), "key": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(key[rare].astype(np.int64))]), "times": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(times[rare].astype(np.int64))])}
                sums = {k: pa.concat_arrays([pa.array(v), none(pa.int64())]) for k, v in (("n_best", best), ("count_sum", total))}
                every = {**same, **new, **sums}
                yield pa.RecordBatch.from_arrays([every[f.split()[0]] for f in schema.split(", ")], names=[f.split()[0] for f in schema.split(", ")])

    scored = short.select("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times").mapInArrow(run, schema)
    few = scored.where("key is null").drop("key", "times")
    rare = scored.where("key is not null").select("rid", "key", "times").unionByName(long)
    joined = rare.join(counts, "key").select("rid", F.expr("if(best, times, 0)").alias("n_best"), (F.col("times") * F.col("c")).alias("count_sum"))
    pieces = [few, parts.select("rid", "doc_id", "n_a", "n_b"), done.where("n_groups is not null").select("rid", "n_groups", "n_links"), long_hashes(done), joined]
    every = pieces[0]
    for p in pieces[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    sums = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    total = every.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.coalesce(F.max("groups_sha256"), F.lit("")).alias("groups_sha256"))
    return total.drop("rid")
