"""The trie of conversation prefixes, by ternary search trees over range shards.

Turns are dictionary-encoded: distinct (role, text) get ids in sorted order, so a conversation
is a string of ids that sorts as its turns do (12 bytes a turn: the id and the words of the
text, most significant byte first). Equal conversations become one entry before anything else:
runs of them are cut by (ids, conv_id), whatever their number, and packed by each task; the
digest of a group's members then takes in a few packed pieces in order.

Entries are dealt to range shards of about ``shard_bytes`` by sampled splitters. A shard inserts
its sorted entries median first into a ternary search tree (lower, equal and higher links; equal
leads to the next turn), walks it with a stack of its own and adds up, from the leaves,
members, smallest member, children, leaves and savings. Only nodes on the path of a shard's
first and last entry can lie in another shard as well. These boundary nodes, with what their
other children add up to, are merged ``fan`` shards at a time in a tree of rounds; a node that
no longer lies on the boundary is closed, and adds to its parent. Nodes below a boundary node
get the parent's smallest member by a join on (shard, node), so no parent with very many
children meets them in one task.

A conversation's ids are put together in one row (12 bytes a turn, the result has a row for
each of them); splitters look at the first ``SPLIT_TURNS`` turns only.

Rows without conv_id belong to no conversation. Null role or text count as empty. Turns of a
conversation are ordered by turn (null first), ties by role and text; repeated rows are turns of
their own. A table without conversations has no node. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.llm.base import checkpoint, words

#: Bytes of a turn in an encoded conversation.
UNIT = 12
#: Turns that decide the shard of a conversation.
SPLIT_TURNS = 256
#: Encoded bytes of a shard, about, and boundary trees merged by one task.
SHARD_BYTES, FAN = 4 << 20, 64
#: Characters of member ids packed in one piece; rows of an output batch.
PIECE, OUT_ROWS = 1 << 16, 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()


def encode(conversations: DataFrame) -> DataFrame:
    """conv_id, path (binary): every conversation as its turns' dictionary entries in order."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    digest = F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256))
    entries = rows.groupBy("role", "text").agg(F.lit(0)).orderBy("role", "text")
    entries = checkpoint(entries.select(digest.alias("entry"), F.monotonically_increasing_id().alias("id"), F.size(words(F.col("text"))).alias("n")))
    unit = F.concat(F.lpad(F.hex("id"), 16, "0"), F.lpad(F.hex(F.col("n").cast("long")), 8, "0"))
    turns = rows.select("conv_id", "turn", digest.alias("entry")).join(entries.select("entry", unit.alias("unit")), "entry")
    path = F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "unit"))), lambda x: x["unit"]), ""))
    return turns.groupBy("conv_id").agg(path.alias("path"))


def rebuild(encoded: DataFrame, every: int = 20, at_most: int = 4) -> DataFrame:
    """Conversations that start with the first h turns of conversation c - c % ``every`` and go on
    with their own turns after the first h, h = crc32(c) % ``at_most``."""
    base = F.col("conv_id") - F.col("conv_id") % every
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % at_most).cast("int") * UNIT
    heads = encoded.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("__base"), F.substring("path", 1, UNIT * at_most).alias("__head"))
    joined = encoded.withColumn("__base", base).join(heads, "__base", "left")
    none = F.lit(b"")
    start = F.coalesce(F.col("__head").substr(F.lit(1), h), none)
    return joined.select("conv_id", F.concat(start, F.col("path").substr(h + 1, F.octet_length("path"))).alias("path"))


def splitter(path: Column) -> Column:
    return path.substr(F.lit(1), F.lit(UNIT * SPLIT_TURNS))


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names))


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held.clear()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_PIECES = pa.schema([("path", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("members", pa.binary())])


def pieces(paths: DataFrame, shards: int) -> DataFrame:
    """path, conv_id (smallest), n, members (decimal ids, comma-joined): runs of equal conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> Iterator[tuple]:
            for path, some in groupby(_rows(batches, ("path", "conv_id")), key=lambda r: r[0]):
                first, ids, size = None, [], 0
                for _, c in some:
                    first = c if first is None else first
                    ids.append(b"%d" % c)
                    size += len(ids[-1]) + 1
                    if size >= PIECE:
                        yield path, first, len(ids), b",".join(ids)
                        first, ids, size = None, [], 0
                if ids:
                    yield path, first, len(ids), b",".join(ids)

        yield from _batches(packed(), _PIECES, 1 << 10)

    dealt = paths.repartitionByRange(shards, splitter(F.col("path")), "conv_id").sortWithinPartitions("path", "conv_id")
    return dealt.mapInArrow(run, "path binary, conv_id long, n long, members binary")


class Tree:
    """A ternary search tree over one shard's entries; node 0 is the textless root."""

    def __init__(self) -> None:
        self.unit: list[bytes] = [b""]
        self.lower, self.equal, self.higher = [-1], [-1], [-1]
        self.entry = [-1]

    def _node(self, unit: bytes) -> int:
        self.unit.append(unit)
        for x in (self.lower, self.equal, self.higher, self.entry):
            x.append(-1)
        return len(self.unit) - 1

    def path(self, path: bytes) -> list[int]:
        """The nodes of an entry, made where they are missing."""
        out, at = [0], 0
        unit = self.unit
        for i in range(0, len(path), UNIT):
            u, link, up = path[i : i + UNIT], self.equal, at
            at = link[up]
            while at >= 0 and unit[at] != u:
                link, up = (self.lower if u < unit[at] else self.higher), at
                at = link[up]
            if at < 0:
                at = link[up] = self._node(u)
            out.append(at)
        return out

    def insert_sorted(self, paths: list[bytes]) -> None:
        """Median first, so that every level of siblings is a balanced tree."""
        todo = [(0, len(paths))]
        while todo:
            a, b = todo.pop()
            if a < b:
                m = (a + b) // 2
                self.entry[self.path(paths[m])[-1]] = m
                todo += [(a, m), (m + 1, b)]

    def walk(self) -> Iterator[tuple[int, int, int]]:
        """node, parent, depth of every node, parents first."""
        yield 0, -1, 0
        todo = [(self.equal[0], 0, 1)]
        while todo:
            at, parent, depth = todo.pop()
            if at >= 0:
                yield at, parent, depth
                todo += [(self.lower[at], parent, depth), (self.higher[at], parent, depth), (self.equal[at], at, depth + 1)]


#: A node as a shard or a merge gives it. On the boundary: counts of what is closed below it.
_NODE = "edge boolean, shard int, is_first boolean, key binary, parent_key binary, depth long, words long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_KINDS = {"boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
_NODES = pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in _NODE.split(", "))])


def shard_nodes(shard: int, entries: list[tuple[bytes, int, int, str]]) -> Iterator[tuple]:
    """Rows of one shard's trie from its sorted entries (path, smallest member, members, digest)."""
    if not entries:
        return
    tree = Tree()
    paths = [e[0] for e in entries]
    tree.insert_sorted(paths)
    n = len(tree.unit)
    order, parent, depth = [], [0] * n, [0] * n
    for v, p, d in tree.walk():
        order.append(v)
        parent[v], depth[v] = p, d
    first, last = tree.path(paths[0]), tree.path(paths[-1])
    key: dict[int, bytes] = {}
    for nodes in (first, last):
        seen = hashlib.blake2b(digest_size=16)
        for v in nodes:
            seen.update(tree.unit[v])
            key[v] = seen.copy().digest()
    on_first = set(first)
    least: list[int | None] = [None] * n
    members, kids, leaves, saved = [0] * n, [0] * n, [0] * n, [0] * n
    for v in reversed(order):
        e = tree.entry[v]
        if e >= 0:
            members[v] += entries[e][2]
            least[v] = entries[e][1] if least[v] is None else min(least[v], entries[e][1])
        p = parent[v]
        if v not in key:
            leaves[v] = leaves[v] or 1
            saved[v] += (members[v] - 1) * int.from_bytes(tree.unit[v][8:], "big")
            kids[p] += 1
            leaves[p] += leaves[v]
            saved[p] += saved[v]
        if p >= 0:
            members[p] += members[v]
            least[p] = least[v] if least[p] is None else min(least[p], least[v])
    for v in order:
        p, e = parent[v], tree.entry[v]
        sha = entries[e][3] if e >= 0 else None
        values = (members[v], kids[v], leaves[v], saved[v])
        if v in key:
            yield True, shard, v in on_first, key[v], key.get(p), depth[v], int.from_bytes(tree.unit[v][8:], "big"), least[v], None, *values, sha
        else:
            yield False, shard, None, None, key.get(p), depth[v], None, least[v], None if p in key else least[p], *values, sha or NOTHING


def shards(packed: DataFrame, n: int) -> DataFrame:
    """Nodes of every range shard: closed ones, and partial ones on its boundary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = []
        for path, some in groupby(_rows(batches, ("path", "conv_id", "n", "members")), key=lambda r: r[0]):
            seen, least, total = hashlib.sha256(), None, 0
            for _, c, k, ids in some:
                seen.update(ids if least is None else b"," + ids)
                least = c if least is None else least
                total += k
            entries.append((path, least, total, seen.hexdigest()))
        yield from _batches(shard_nodes(TaskContext.get().partitionId(), entries), _NODES)

    dealt = packed.repartitionByRange(n, splitter(F.col("path"))).sortWithinPartitions("path", "conv_id")
    return dealt.mapInArrow(run, _NODE)


def merge(rows: Iterator[dict], group: int, top: bool) -> Iterator[tuple]:
    """Boundary trees of neighbouring shards as one: closed nodes, and the new boundary."""
    stack: list[dict] = []
    start = None

    def pop(still: bool) -> tuple:
        v = stack.pop()
        edge = not top and (still or v["is_first"])
        if not edge:
            v["n_leaves"] = v["n_leaves"] or 1
            v["saved_tokens"] += (v["n_convs"] - 1) * v["words"]
            v["ends_sha256"] = v["ends_sha256"] or NOTHING
            if stack:
                up = stack[-1]
                up["n_children"] += 1
                up["n_leaves"] += v["n_leaves"]
                up["saved_tokens"] += v["saved_tokens"]
        return tuple({**v, "edge": edge, "shard": group}[c] for c in _NODES.names)

    for r in rows:
        start = r["shard"] if start is None else start
        d = r["depth"]
        if d < len(stack) and stack[d]["key"] == r["key"]:
            v = stack[d]
            for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                v[c] += r[c]
            v["conv_id"] = min(v["conv_id"], r["conv_id"])
            v["ends_sha256"] = v["ends_sha256"] or r["ends_sha256"]
            continue
        while len(stack) > d:
            yield pop(False)
        stack.append({**r, "is_first": r["is_first"] and r["shard"] == start})
    while stack:
        yield pop(True)


def merge_round(edges: DataFrame, fan: int, top: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(_NODES.names, r)) for r in _rows(batches, tuple(_NODES.names)))
        for group, some in groupby(rows, key=lambda r: r["shard"] // fan):
            yield from _batches(merge(some, group, top), _NODES)

    dealt = edges.repartition(F.floor(F.col("shard") / fan)).sortWithinPartitions("shard", F.col("is_first").desc(), "depth")
    return checkpoint(dealt.mapInArrow(run, _NODE))


def prefix_trie(paths: DataFrame, shard_bytes: int = SHARD_BYTES, fan: int = FAN) -> DataFrame:
    """A row for each distinct prefix of ``paths`` (conv_id, path as ``encode`` gives it)."""
    paths = checkpoint(paths)
    size = paths.agg(F.sum(F.octet_length("path") + 24).alias("s")).first()["s"] or 0
    n = max(1, -(-size // shard_bytes))
    every = checkpoint(shards(checkpoint(pieces(paths, n)), n))
    boundary, low = every.where("edge"), every.where("not edge")
    left = every.agg(F.max("shard").alias("m")).first()["m"]
    done, edges = None, boundary
    while left is not None:
        top = left // fan == 0
        out = merge_round(edges, fan, top)
        closed = out.where("not edge")
        done = closed if done is None else done.unionByName(closed)
        edges, left = out.where("edge"), None if top else left // fan
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if done is None:
        return low.select(columns)
    named = done.select(F.col("key").alias("__key"), F.col("conv_id").alias("__up"))
    on_boundary = done.drop("parent_conv_id").join(named, F.col("parent_key") == F.col("__key"), "left").withColumnRenamed("__up", "parent_conv_id")
    of_shard = boundary.select(F.col("shard").alias("__shard"), F.col("key").alias("__key")).join(named, "__key")
    under = low.where("parent_key is not null").drop("parent_conv_id").join(of_shard, (F.col("shard") == F.col("__shard")) & (F.col("parent_key") == F.col("__key"))).withColumnRenamed("__up", "parent_conv_id")
    return low.where("parent_key is null").select(columns).unionByName(on_boundary.select(columns)).unionByName(under.select(columns))
