"""SimHash near-duplicates linked by a binary trie self-join.

Fingerprints: 64 bits from the XXH64 of a text's word shingles, a bit being set where over
half of them have it. Equal fingerprints are one entry of the join, whatever their number.

Join: a binary trie over the fingerprints is joined with itself. Pairs of nodes descend
together; a pair that takes unlike branches spends one of the allowed differing bits, and a
pair that has spent more is pruned with everything below it. To distribute it, each
fingerprint enters one trie for each block of bits (bits + 1 blocks, each rotated to the
top): two fingerprints within ``bits`` agree on one block at least, so tries only descend
below equal top nodes, and those are the partition key. A top node with many fingerprints is
cut further into pairs of child nodes before it reaches a task. Links leave a task as a
spanning forest of what it saw; components are then contracted across tasks.

Null, empty and blank texts have fingerprint zero and are linked like any other. Fewer words than
a shingle: the whole sequence. Rows that share doc_id but not text are rows of their own.
A null doc_id takes part in links but never names a component unless all its members are
null. Repeated rows stay. Further columns pass through; result columns replace any of the
same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfold.llm.base import checkpoint, small_batches
from stepfold.llm.components import components

BITS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints below one pair of trie nodes that a task takes; larger ones are cut by CUT_BITS more bits.
NODE_ROWS = 50_000
CUT_BITS = 6
#: Node pairs traversed at a time.
FRONTIER = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = (ends - np.array([len(w) for w in words]))[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """All columns of ``docs`` with ``fp``, the fingerprint as a signed long."""
    docs = docs.drop("fp")
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], names=[*batch.schema.names, "fp"])

    return docs.mapInArrow(run, schema)


def _rotated(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def node_entries(fps: DataFrame, bits: int = BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """key, side, r (rotated), turn: the fingerprints of each pair of trie nodes to be joined.

    Side 0 meets itself; where a node was cut into unlike children, side 0 meets side 1.
    """
    edges = [round(k * 64 / (bits + 1)) for k in range(bits + 2)]
    parts = []
    for k in range(bits + 1):
        r = _rotated(F.col("fp"), edges[k])
        width = edges[k + 1] - edges[k]
        parts.append(fps.select(r.alias("r"), F.lit(edges[k]).alias("turn"), F.lit(width).alias("depth"), F.lit(0).alias("side"), F.lit(0).alias("spent"), F.shiftrightunsigned(r, 64 - width).alias("path")))
    level = parts[0]
    for p in parts[1:]:
        level = level.unionByName(p)
    level = level.withColumn("key", F.xxhash64("turn", "path")).drop("path")
    done = None
    while True:
        level = checkpoint(level)
        sizes = level.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        large = sizes.where((F.col("n") > node_rows)).select("key")
        if large.isEmpty() or level.where(F.col("depth") + CUT_BITS < 64).isEmpty():
            return level if done is None else done.unionByName(level)
        can = level.where(F.col("depth") + CUT_BITS < 64).join(F.broadcast(large), "key", "left_semi")
        rest = level.join(F.broadcast(large), "key", "left_anti").unionByName(level.where(F.col("depth") + CUT_BITS >= 64).join(F.broadcast(large), "key", "left_semi"))
        done = rest if done is None else done.unionByName(rest)
        # children: a fingerprint meets its own child node, and all others within the bits left
        child = F.expr(f"cast(shiftrightunsigned(shiftleft(r, depth), {64 - CUT_BITS}) as int)")
        masks = F.array(*[F.lit(m) for m in range(1 << CUT_BITS)])
        fits = F.filter(masks, lambda m: F.bit_count(m) + F.col("spent") <= bits)
        cut = can.withColumns({"c": child, "m": F.explode(fits)}).withColumn("other", F.col("c").bitwiseXOR(F.col("m")))
        # two sides meet once: pairs of unlike children within a node that met itself, or across its two sides
        lower = F.when(F.col("m") == 0, F.col("side")).when(F.col("spent") == 0, (F.col("c") > F.col("other")).cast("int")).otherwise(F.col("side"))
        first = F.when(F.col("side") == 0, F.col("c")).otherwise(F.col("other"))
        low = F.when(F.col("spent") == 0, F.least("c", "other")).otherwise(first)
        level = cut.select("r", "turn", (F.col("depth") + CUT_BITS).alias("depth"), lower.alias("side"), (F.col("spent") + F.bit_count("m")).alias("spent"), F.xxhash64("key", low, "m").alias("key"))


def trie_pairs(a: np.ndarray, b: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sorted distinct keys within ``bits``: a with itself, or a with b.

    Node pairs (ranges of the sorted arrays) descend bit by bit on a stack of bounded
    blocks; unlike branches spend a bit, overspent pairs are dropped.
    """
    same = b is None
    b = a if same else b
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = [], []
    stack = [(0, np.array([[0, len(a), 0, len(b), 0]], np.int64))]
    while stack:
        depth, f = stack.pop()
        if len(f) > FRONTIER:
            stack += [(depth, f[FRONTIER:]), (depth, f[:FRONTIER])]
            continue
        single = (f[:, 1] - f[:, 0] == 1) & (f[:, 3] - f[:, 2] == 1)
        done = f if depth == 64 else f[single]
        if len(done):
            i, j = done[:, 0], done[:, 2]
            near = np.bitwise_count(a[i] ^ b[j]) <= bits
            if same:
                near &= i < j
            left.append(i[near])
            right.append(j[near])
        f = f[~single] if depth < 64 else f[:0]
        if not len(f):
            continue
        shift = np.uint64(63 - depth)

        def middle(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            # the first key of the node with this bit set: keys share all bits above
            base = (x[lo] >> shift) | np.uint64(1)
            return np.clip(np.searchsorted(x, base << shift), lo, hi)

        m, n = middle(a, f[:, 0], f[:, 1]), middle(b, f[:, 2], f[:, 3])
        kids = []
        for one in (0, 1):
            for two in (0, 1):
                kid = np.stack([m if one else f[:, 0], f[:, 1] if one else m, n if two else f[:, 2], f[:, 3] if two else n, f[:, 4] + (one ^ two)], 1)
                ok = (kid[:, 0] < kid[:, 1]) & (kid[:, 2] < kid[:, 3]) & (kid[:, 4] <= bits)
                if same and one and not two:
                    # the mirror of (0, 1) where a node meets itself
                    ok &= ~((f[:, 0] == f[:, 2]) & (f[:, 1] == f[:, 3]))
                kids.append(kid[ok])
        stack.append((depth + 1, np.concatenate(kids)))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(left), cat(right)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the links a union-find keeps: a spanning forest."""
    root = list(range(n))
    keep = np.zeros(len(i), bool)
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            keep[k] = True
    return keep


def links(fps: DataFrame, bits: int = BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all within ``bits``."""
    small = node_entries(fps, bits, node_rows).select("key", "side", "turn", "r")
    dealt = small.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(key: np.ndarray, side: np.ndarray, turn: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
            fp = np.where(turn == 0, r, (r >> turn) | (r << ((np.uint64(64) - turn) % np.uint64(64))))
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            out_a, out_b = [], []
            for at in np.split(order, cuts):
                one, two = at[side[at] == 0], at[side[at] == 1]
                if len(at) < 2 or not len(one):
                    continue
                one = one[np.argsort(r[one])]
                two = two[np.argsort(r[two])]
                if len(at) == 2:
                    near = int(np.bitwise_count(r[at[0]] ^ r[at[1]])) <= bits
                    i, j = (at[:1], at[1:]) if near else (at[:0], at[:0])
                else:
                    i, j = trie_pairs(r[one], r[two] if len(two) else None, bits)
                    i, j = one[i], (two if len(two) else one)[j]
                out_a.append(i)
                out_b.append(j)
            i = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
            j = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
            distinct, number = np.unique(fp, return_inverse=True)
            keep = spanning(len(distinct), number[i], number[j])
            x, y = fp[i[keep]].astype(np.int64), fp[j[keep]].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        # whole keys only: what follows the last change of key waits for the next batch
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "side", "turn", "r")], 1)
            held.append(rows)
            if sum(map(len, held)) < NODE_ROWS:
                continue
            rows = np.concatenate(held)
            cut = int(np.flatnonzero(rows[:, 0] != rows[-1, 0])[-1]) + 1 if (rows[:, 0] != rows[-1, 0]).any() else 0
            if cut:
                x = rows[:cut]
                yield solve(x[:, 0], x[:, 1], x[:, 2].astype(np.uint64), x[:, 3].astype(np.uint64))
            held = [rows[cut:]]
        if held:
            x = np.concatenate(held)
            yield solve(x[:, 0], x[:, 1], x[:, 2].astype(np.uint64), x[:, 3].astype(np.uint64))

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, node_rows: int = NODE_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """All columns of ``docs`` with fp and component_id, the smallest doc_id reachable. With
    ``carry``, doc_id and these (small) columns only, and component, which tells components apart
    where ids are null or shared."""
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    marked = fingerprints(docs.drop("fp", "component_id"), shingle)
    only = checkpoint(marked.select("doc_id", *carry, "fp"))  # a few bytes a document: texts are read once
    first = only.groupBy("fp").agg(F.min("doc_id").alias("first"))
    first = checkpoint(first)
    groups = components(links(first.select("fp"), bits, node_rows))
    named = first.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "c").select("fp", "component_id", F.col("c").alias("component"))
    if carry:
        return only.join(ids, "fp").select("doc_id", *carry, "fp", "component_id", "component")
    if set(docs.columns) <= {"doc_id", "text"}:
        return only.join(ids, "fp").select("doc_id", "fp", "component_id")
    return marked.join(ids, "fp").select(*docs.drop("fp", "component_id").columns, "fp", "component_id")
