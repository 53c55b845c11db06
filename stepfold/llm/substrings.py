"""Exact removal of long byte strings that an earlier document has, by sorting suffixes.

A byte goes when a string of ``length`` bytes covers it that also starts in a document with a
smaller id. Sorting every suffix of the corpus would shuffle it many times over, so only
some suffixes are sorted: in every window of ``length`` bytes the one start whose first
``lead`` bytes hash lowest (ties: the leftmost). Equal windows choose the same start, so
two documents share a window only if they share a chosen suffix start around it.

1. Whole texts that are exact copies of an earlier document's are settled by digest.
2. Chosen starts are dealt by their leading bytes' hash; starts seen in two documents or more
   are kept, about a fifth of them.
3. The kept suffixes, with the bytes of the windows they stand for, are range-partitioned by
   their leading bytes with sampled splitters. Each bucket sorts its suffixes and compares
   those with equal leading bytes window by window. The splitters cut between leading strings,
   never inside one, so no comparison crosses a boundary.
4. Covered windows return to their documents.

Documents are shuffled once, by id, and that exchange serves all passes. Lengths are UTF-8
bytes. Null texts are empty; texts shorter than ``length`` lose nothing. Null ids count as
one id after all others. Rows with the same id never remove from one another, whether their texts agree or not, and
are all kept. Further columns pass through; result columns replace any of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfold.llm.base import checkpoint, chunks, small_batches
from stepfold.llm.tokens import column_bytes

LENGTH = 50
LEAD = 20
#: One document in this many gives suffixes for the splitters.
SAMPLE_EVERY = 16
#: Buckets per shuffle partition.
BUCKETS = 4
#: Bytes hashed at a time; below 2^24, as a position takes 24 bits of a packed number.
BLOCK = 2 << 20
#: Bits of a start's hash that find repeated starts. What they find is compared byte by byte, so
#: fewer bits only cost false candidates; these keep them under 1 % up to 10^12 starts.
KEY = np.uint64((1 << 48) - 1)
LAST_ID = (1 << 63) - 1
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _gram_hashes(raw: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n bytes from each position on, by doubling."""
    size, level = 1, (raw.astype(np.uint64) + np.uint64(1)) * _A
    out, done = None, 0
    while True:
        if n & size:
            if out is None:
                out = level
            else:
                m = min(len(out), len(level) - done)
                out = ((out[:m] * _B) ^ (out[:m] >> np.uint64(31))) + level[done : done + m]
            done += size
        if size * 2 > n:
            break
        m = len(level) - size
        level = ((level[:m] * _B) ^ (level[:m] >> np.uint64(29))) + level[size:] * _C
        size *= 2
    return (out ^ (out >> np.uint64(32))) * _B


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def chosen_starts(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, lead: int = LEAD) -> tuple[np.ndarray, ...]:
    """Over documents laid end to end: first window, last window, chosen start, its hash and
    the document of every run of windows that choose the same start."""
    parts: list[tuple[np.ndarray, ...]] = []
    for a in range(0, max(1, len(raw) - length + 1), BLOCK):
        piece = raw[a : a + BLOCK + length - 1]
        if len(piece) < length:
            break
        h = _gram_hashes(piece, lead)
        packed = ((h >> np.uint64(24)) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        at = (_window_min(packed, length - lead + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        doc = np.searchsorted(offsets, np.arange(a, a + len(at)), side="right") - 1
        inside = np.flatnonzero(np.arange(a, a + len(at)) + length <= offsets[doc + 1])
        if not len(inside):
            continue
        at, doc = at[inside], doc[inside]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
        last = np.append(new[1:], len(at)) - 1
        parts.append((inside[new] + a, inside[last] + a, at[new] + a, h[at[new]], doc[new]))
    if not parts:
        zero = np.zeros(0, np.int64)
        return zero, zero, zero, zero.astype(np.uint64), zero
    return tuple(np.concatenate(x) for x in zip(*parts))


def _rank(raw: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of a suffix in the order of leading bytes: five of them, then the leading hash."""
    out = np.zeros(len(at), np.uint64)
    for k in range(5):
        out = (out << np.uint64(8)) | raw[at + k]
    return ((out << np.uint64(23)) | (key >> np.uint64(41))).astype(np.int64)


def _batch(names: list[str], *arrays: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(arrays), names=names)


def _starts(docs: DataFrame, length: int, lead: int) -> DataFrame:
    """key, did: every distinct chosen start of each of ``docs`` (did, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            raw, offsets = column_bytes(batch.column("text"))
            *_, key, doc = chosen_starts(raw, offsets, length, lead)
            key = key & KEY
            # a text that repeats itself gives each of its starts once
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else order
            yield _batch(["key", "did"], pa.array(key[new].view(np.int64)), pa.array(np.asarray(batch.column("did"))[doc[new]]))

    return docs.mapInArrow(run, "key long, did long")


def _splitters(docs: DataFrame, n: int, length: int, lead: int) -> list[int]:
    """Ranks that cut the suffixes of a sample of the documents into n even ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            raw, offsets = column_bytes(batch.column("text"))
            _, _, at, key, _ = chosen_starts(raw, offsets, length, lead)
            yield _batch(["rank"], pa.array(_rank(raw, at, key)))

    few = docs.where(F.pmod(F.xxhash64("did"), F.lit(SAMPLE_EVERY)) == 0).select("text").mapInArrow(run, "rank long")
    cuts = few.agg(F.percentile_approx("rank", [k / n for k in range(1, n)], 20 * n)).first()[0]
    return sorted(set(cuts or []))


def _repeated(starts: DataFrame) -> DataFrame:
    """did, key: the starts whose leading bytes are in two documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.asarray(b.column("key")), np.asarray(b.column("did"))) for b in batches]
        if not held:
            return
        key, did = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(key, kind="stable")
        key, did = key[order], did[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(first)
        many = np.minimum.reduceat(did, at) != np.maximum.reduceat(did, at)
        keep = np.repeat(many, np.diff(np.append(at, len(key))))
        key, did = key[keep], did[keep]
        for a in range(0, len(key), 1 << 16):
            yield _batch(["did", "key"], pa.array(did[a : a + (1 << 16)]), pa.array(key[a : a + (1 << 16)]))

    return starts.repartition("key").mapInArrow(run, "did long, key long")


def _suffixes(docs: DataFrame, cuts: list[int], length: int, lead: int) -> DataFrame:
    """bucket, did, no, place, more, bytes: the windows around each kept start. ``place`` is where
    they begin in the text, times 65536, plus where the start is in them; ``more`` are the
    other places (longs) where a text repeats them. ``docs`` has did, no, text and keys."""
    edges = np.array(cuts, np.int64)
    names = ["bucket", "did", "no", "place", "more", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            raw, offsets = column_bytes(batch.column("text"))
            lists = batch.column("keys")
            mine = np.asarray(lists.flatten()).view(np.uint64)
            of = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            s, e, at, key, doc = chosen_starts(raw, offsets, length, lead)
            mark = lambda k, d: k + d.astype(np.uint64) * _C
            keep = np.flatnonzero(np.isin(mark(key & KEY, doc), mark(mine, of)))
            s, e, at, key, doc = (x[keep] for x in (s, e, at, key, doc))
            text = raw.tobytes()
            for a in range(0, len(s), 1 << 13):
                z = slice(a, a + (1 << 13))
                place = (s[z] - offsets[doc[z]]) * 65536 + (at[z] - s[z])
                first: dict[tuple, int] = {}
                again: dict[int, list[int]] = {}
                cut, rows = [], []
                for k, (d, i, j, b) in enumerate(zip(doc[z].tolist(), s[z].tolist(), (e[z] + length).tolist(), at[z].tolist())):
                    piece = text[i:j]
                    n = first.setdefault((d, b - i, piece), len(rows))
                    if n < len(rows):
                        again.setdefault(n, []).append(int(place[k]))
                    else:
                        cut.append(piece)
                        rows.append(k)
                own = doc[z][rows]
                bucket = np.searchsorted(edges, _rank(raw, at[z][rows], key[z][rows])).astype(np.int32)
                more = [np.array(again[n], np.int64).tobytes() if n in again else None for n in range(len(rows))]
                yield _batch(
                    names, pa.array(bucket), pa.array(np.asarray(batch.column("did"))[own]), pa.array(np.asarray(batch.column("no"))[own]),
                    pa.array(place[rows]), pa.array(more, pa.binary()), pa.array(cut, pa.binary()),
                )

    return docs.mapInArrow(run, "bucket int, did long, no int, place long, more binary, bytes binary")


def compare(rows: list[tuple[bytes, int, int]], length: int) -> list[tuple[int, int, int]]:
    """Windows of suffixes with equal leading bytes that an earlier document has too.

    ``rows``: (bytes, did, tag) sorted by did. Returns (tag, start, end) covers within them.
    """
    out: list[tuple[int, int, int]] = []
    whole: dict[bytes, int] = {}
    seen: dict[bytes, int] = {}
    single = all(r[0] == rows[0][0] for r in rows)
    for text, did, tag in rows:
        if whole.setdefault(text, did) < did:
            out.append((tag, 0, len(text)))
            continue
        if single:
            continue
        begin = end = -1
        for i in range(len(text) - length + 1):
            if seen.setdefault(text[i : i + length], did) < did:
                if i > end:
                    if begin >= 0:
                        out.append((tag, begin, end))
                    begin = i
                end = i + length
        if begin >= 0:
            out.append((tag, begin, end))
    return out


def _covers(suffixes: DataFrame, length: int, lead: int) -> DataFrame:
    """did, no, start, end: covered stretches."""
    names = ["did", "no", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        did, no, place = (np.asarray(t.column(c)) for c in ("did", "no", "place"))
        start, at = place >> 16, place & 65535
        data = t.column("bytes").to_pylist()
        # one sort of the suffixes by their leading bytes, then by document
        heads = np.array([b[a : a + lead] for b, a in zip(data, at.tolist())], dtype=f"S{lead}") if data else np.zeros(0, f"S{lead}")
        order = np.lexsort((did, heads))
        heads = heads[order]
        edge = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1], [True]]))
        ids, more = did.tolist(), t.column("more").to_pylist()
        found: list[tuple[int, int, int]] = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b - a > 1 and did[order[a]] != did[order[b - 1]]:
                for i, x, y in compare([(data[i], ids[i], i) for i in order[a:b].tolist()], length):
                    found.append((i, start[i] + x, start[i] + y))
                    if more[i] is not None:
                        found += [(i, p + x, p + y) for p in (np.frombuffer(more[i], np.int64) >> 16).tolist()]
            if len(found) > 1 << 15:
                yield cut(found, did, no)
                found = []
        yield cut(found, did, no)

    def cut(found: list, did: np.ndarray, no: np.ndarray) -> pa.RecordBatch:
        f = np.array(found, np.int64).reshape(-1, 3)
        return _batch(names, pa.array(did[f[:, 0]]), pa.array(no[f[:, 0]]), pa.array(f[:, 1].astype(np.int32)), pa.array(f[:, 2].astype(np.int32)))

    return suffixes.repartition("bucket").mapInArrow(run, "did long, no int, start int, end int")


def spans_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted stretches joined where they overlap or touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def removed_spans(docs: DataFrame, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """All columns of ``docs`` with removed: array of (start, end) byte stretches to remove."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("removed")
    held = docs.withColumn("did", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))).drop("doc_id").withColumn("text_hash", F.xxhash64("text"))
    # whole copies: the smallest id of each digest; nothing but ids and digests moves
    prints = held.select("did", "text_hash", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).distinct()
    firsts = prints.groupBy("digest").agg(F.min("did").alias("first"))
    number = Window.partitionBy("did").orderBy("text_hash")
    ids = prints.join(firsts, "digest").select("did", "text_hash", (F.col("did") > F.col("first")).alias("is_copy"))
    ids = checkpoint(ids.withColumn("no", F.row_number().over(number)))
    ids_of = ids.withColumnsRenamed({"did": "__d", "text_hash": "__h"})
    # the texts are dealt by id once; what joins them by id only leaves them where they are
    own = held.repartition("did")
    same = (F.col("did") == F.col("__d")) & (F.col("text_hash").bitwiseXOR(F.col("__h")) == 0)
    # all columns go with the texts in every pass: were some pruned, it would be another exchange
    fresh = own.join(ids_of.where("not is_copy"), same).drop("__d", "__h", "is_copy")
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * BUCKETS
    cuts = _splitters(held.select("did", "text"), n, length, lead)
    kept = _repeated(_starts(fresh, length, lead)).groupBy("did").agg(F.collect_set("key").alias("keys"))
    covers = _covers(_suffixes(fresh.join(kept, "did"), cuts, length, lead), length, lead)
    spans = covers.groupBy("did", "no").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("removed"))
    marks = ids.join(spans, ["did", "no"], "left").where("is_copy or removed is not null")
    marks = marks.select(F.col("did").alias("__d"), F.col("text_hash").alias("__h"), F.col("is_copy").alias("copy"), "removed")
    out = own.join(marks, same, "left")
    size = F.octet_length(F.coalesce("text", F.lit("")))
    kind = "array<struct<start:int,end:int>>"
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), size.alias("end"))).cast(kind)
    removed = F.when(F.col("copy") & (size >= length), all_of_it).otherwise(F.coalesce("removed", F.array().cast(kind)))
    doc_id = F.when(F.col("did") == LAST_ID, None).otherwise(F.col("did")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return out.select(*[doc_id if c == "doc_id" else c for c in docs.columns], removed.alias("removed"))


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All columns of ``docs``, ``text`` being what is left, with n_bytes, n_removed, n_spans
    and kept_sha256 (of the bytes left, however the characters fall).

    A removed stretch may begin or end inside a character; ``text`` then also loses the
    rest of that character, as text must be valid.
    """
    added = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()}
    spans = removed_spans(docs.drop(*added))
    columns = [f for f in spans.schema.fields if f.name != "removed"]
    schema = T.StructType([*columns, *[T.StructField(n, t) for n, t in added.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, results = [], []
            lists = batch.column("removed")
            for text, spans in zip(batch.column("text"), lists):
                raw = (text.as_py() or "").encode()
                cuts = spans.values if spans.is_valid else None
                a, b = (np.asarray(cuts.field(k)) for k in (0, 1)) if cuts is not None and len(cuts) else (np.zeros(0, np.int32),) * 2
                a, b = spans_of(a, b)
                pieces, at = [], 0
                for x, y in zip(a.tolist(), b.tolist()):
                    pieces.append(raw[at:x])
                    at = y
                pieces.append(raw[at:])
                left = b"".join(pieces)
                results.append((len(raw), len(raw) - len(left), len(a), hashlib.sha256(left).hexdigest()))
                texts.append(text.as_py() if not len(a) else "".join(p.decode("utf-8", "ignore") for p in pieces))
            arrays = [pa.array(texts, pa.string()) if f.name == "text" else batch.column(f.name) for f in columns]
            arrays += [pa.array([r[i] for r in results], pa.string() if i == 3 else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return spans.mapInArrow(run, schema)
