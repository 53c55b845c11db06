"""A metric-ball index over vectors: which blocks of items a query has to meet.

Build. Up to ``CENTRES`` sampled items are centres; every item goes to its nearest one. Items
sorted by (kind, centre, distance) are cut into blocks of at most ``block`` rows by a range
partitioning of all rows, so a centre that holds a third of them fills as many tasks as it
needs, and a block is a shell: a centre and the least and greatest distance of its items. The
packed blocks are written to the shared folder. Their directory (five numbers a block, that is
for every ``block`` items) is sent to the tasks.

Bound. For cosine, distance is the angle and the nearest that a shell can come to a query is
|angle to centre - shell|, so no item of it is more similar than the cosine of that; for the
inner product it is q . c + |q| r. Vectors without length have a block of their own.

Visit. A task goes through a batch of queries and gives, for each block that some of them must
meet, one row with just these queries. Rows meet the packed blocks in an equi-join and are
multiplied there. A query block never meets an item block that none of its queries needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfold.plans.session import checkpoint

#: Sampled centres, at most.
CENTRES = 2048
#: What rounding may take from an angle or an inner product.
SLACK = 1e-6
#: Bounds computed at a time: queries of a step times blocks.
BOUNDS = 1 << 22
#: Queries in one row for a block, at most.
Q_ROWS = 2048
#: Centre numbers of vectors without length, and of the smallest ids (for queries without length).
NO_LENGTH, LEAST = -1, -2


def matrix(vectors: pa.Array) -> np.ndarray:
    """The rows of a list column as doubles."""
    n = len(vectors)
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def lists(values: np.ndarray | pa.Array, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), values)


@dataclass
class Directory:
    """Where the blocks lie: kinds apart, blocks of a kind as arrays."""

    centres: np.ndarray
    cosine: bool
    kinds: list[tuple[object, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def near(self, q: np.ndarray) -> np.ndarray:
        """Angles to the centres, or inner products with them."""
        if not len(self.centres):
            return np.zeros((len(q), 1))
        dots = q @ self.centres.T
        return np.arccos(np.clip(dots, -1, 1)) if self.cosine else dots

    def bounds(self, near: np.ndarray, length: np.ndarray, centre: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The most that an item of each block can score with each query."""
        at = near[:, np.maximum(centre, 0)]
        if not self.cosine:
            return at + length[:, None] * high + SLACK
        gap = np.maximum(np.maximum(at - high, low - at) - SLACK, 0)
        out = np.cos(gap)
        out[:, centre == NO_LENGTH] = 0.0
        out[length == 0] = 0.0
        return out


@dataclass
class Balls:
    """packed: block, kind, centre, low, high, ids, flat."""

    packed: DataFrame
    directory: Directory


def _runs(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple]:
    """kind, centre, ids, vectors, distances of consecutive rows of one (kind, centre), at most ``block``."""
    key, held, size = None, [], 0
    for batch in batches:
        centre, kinds = batch.column("centre").to_numpy(), batch.column("kind").to_pylist()
        new = np.flatnonzero(np.append(True, (centre[1:] != centre[:-1]) | np.array([a != b for a, b in zip(kinds[1:], kinds)], bool))) if len(batch) else []
        for a, b in zip(new, [*new[1:], len(batch)]):
            mine = (kinds[a], int(centre[a]))
            if held and mine != key:
                yield *key, held
                held, size = [], 0
            key = mine
            while a < b:
                step = min(b - a, block - size)
                held.append(batch.slice(a, step))
                size, a = size + step, a + step
                if size == block:
                    yield *key, held
                    held, size = [], 0
    if held:
        yield *key, held


def build(items: DataFrame, *, cosine: bool = True, block: int = 4096, least: int = 0, centres: int = CENTRES) -> Balls:
    """Index of ``items`` (id, embedding, kind). ``least``: so many smallest ids of each kind are
    packed once more, as block LEAST, for queries that score the same with every item."""
    spark = items.sparkSession
    items = items.select("id", F.col("embedding").cast("array<double>").alias("embedding"), "kind").where("embedding is not null")
    n = items.count()
    few = items.orderBy(F.xxhash64("id"), "id").limit(max(1, min(centres, -(-4 * n // block)))).select("embedding").toArrow()
    points = matrix(few.column("embedding").combine_chunks()) if n else np.zeros((0, 0))
    points = np.unique(unit(points) if cosine else points, axis=0) if n else points
    if cosine:
        points = points[(points != 0).any(axis=1)] if n else points
    shared = spark.sparkContext.broadcast(points)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if not len(batch):
                continue
            v = matrix(batch.column("embedding"))
            if cosine:
                v = unit(v)
                centre, far = np.full(len(v), NO_LENGTH, np.int32), np.zeros(len(v))
                some = (v != 0).any(axis=1)
                if some.any():
                    dots = v[some] @ c.T
                    centre[some] = dots.argmax(axis=1)
                    far[some] = np.arccos(np.clip(dots.max(axis=1), -1, 1))
            else:
                square = (v * v).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (v @ c.T)
                centre = square.argmin(axis=1).astype(np.int32)
                far = np.sqrt(np.maximum(square.min(axis=1), 0)) + SLACK
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists(v.ravel(), [v.shape[1]] * len(v)), batch.column("kind"), pa.array(centre), pa.array(far)], names=["id", "embedding", "kind", "centre", "far"])

    kind = items.schema["kind"].dataType
    row = T.StructType([*items.schema.fields, T.StructField("centre", T.IntegerType()), T.StructField("far", T.DoubleType())])
    dealt = items.mapInArrow(assign, row)
    if least:
        first = F.row_number().over(_window("kind", "id"))
        low = items.withColumn("__rn", first).where(F.col("__rn") <= least).drop("__rn")
        dealt = dealt.unionByName(low.withColumns({"centre": F.lit(LEAST), "far": F.lit(0.0)}))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, no = TaskContext.get().partitionId(), 0
        for kind_of, centre, held in _runs(batches, block):
            rows = pa.concat_batches(held)
            order = np.argsort(np.asarray(rows.column("id").to_pylist()), kind="stable")
            rows = rows.take(pa.array(order))
            far = rows.column("far").to_numpy()
            name = LEAST if centre == LEAST else place << 32 | no
            no += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int64()), pa.array([kind_of], rows.column("kind").type), pa.array([centre], pa.int32()), pa.array([far.min()]), pa.array([far.max()]),
                 lists(rows.column("id"), [len(rows)]), lists(rows.column("embedding").flatten(), [len(rows.column("embedding").flatten())])],
                names=["block", "kind", "centre", "low", "high", "ids", "flat"],
            )

    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("kind", kind), T.StructField("centre", T.IntegerType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()),
        T.StructField("ids", T.ArrayType(items.schema["id"].dataType)), T.StructField("flat", T.ArrayType(T.DoubleType())),
    ])
    order = ["kind", "centre", "far", "id"]
    packed = checkpoint(dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, schema))
    known = packed.where(F.col("centre") != LEAST).select("block", "kind", "centre", "low", "high", F.size("ids").alias("n")).orderBy("block").toArrow()
    kinds: dict = {}
    for i, k in enumerate(known.column("kind").to_pylist()):
        kinds.setdefault(k, []).append(i)
    columns = [known.column(c).to_numpy() for c in ("block", "centre", "low", "high", "n")]
    return Balls(packed, Directory(points, cosine, [(k, *(c[at] for c in columns)) for k, at in kinds.items()]))


def _window(kind: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(kind).orderBy(order)


def visit(queries: DataFrame, balls: Balls, choose: Callable, *extra: str) -> DataFrame:
    """block, q_ids, q_flat: for every block the queries that ``choose`` sends there.

    choose(directory, vectors, lengths, near, first row, batch) yields (row, block) arrays.
    """
    shared = queries.sparkSession.sparkContext.broadcast(balls.directory)
    cosine = balls.directory.cosine
    most = max([1, *(len(k[1]) for k in balls.directory.kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = shared.value
        step = max(1, BOUNDS // most)
        for batch in batches:
            if not len(batch):
                continue
            v = matrix(batch.column("embedding"))
            v = unit(v) if cosine else v
            length = np.sqrt((v * v).sum(axis=1))
            rows, blocks = [], []
            for a in range(0, len(v), step):
                some = slice(a, a + step)
                for r, b in choose(directory, length[some], directory.near(v[some]), batch.slice(a, step)):
                    rows.append(r + a)
                    blocks.append(b)
            if not rows:
                continue
            rows, blocks = np.concatenate(rows), np.concatenate(blocks)
            order = np.lexsort((rows, blocks))
            rows, blocks = rows[order], blocks[order]
            cut = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
            for a, b in zip(cut, [*cut[1:], len(rows)]):
                for c in range(a, b, Q_ROWS):
                    mine = rows[c : min(b, c + Q_ROWS)]
                    flat = v[mine].ravel()
                    yield pa.RecordBatch.from_arrays([pa.array([blocks[a]], pa.int64()), lists(batch.column("id").take(pa.array(mine)), [len(mine)]), lists(flat, [len(flat)])], names=["block", "q_ids", "q_flat"])

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("q_ids", T.ArrayType(queries.schema["id"].dataType)), T.StructField("q_flat", T.ArrayType(T.DoubleType()))])
    vectors = queries.where("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"), *extra)
    return vectors.mapInArrow(run, schema)


def first_blocks(k: int) -> Callable:
    """The most promising blocks of each kind, until they hold ``k`` items; queries without
    length meet the smallest ids instead."""

    def choose(directory: Directory, length: np.ndarray, near: np.ndarray, _: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        none = np.flatnonzero(length == 0)
        if len(none):
            yield none, np.full(len(none), LEAST)
        some = np.flatnonzero(length > 0)
        for r, b, _ in _probe(directory, length, near, some, k):
            yield r, b

    return choose


def _probe(directory: Directory, length: np.ndarray, near: np.ndarray, some: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """row, block, place of the block among its kind."""
    for _, block, centre, low, high, n in directory.kinds:
        if not len(some):
            return
        bound = directory.bounds(near[some], length[some], centre, low, high)
        # among equal bounds the shell whose centre is nearest
        at = near[some][:, np.maximum(centre, 0)]
        rank = np.lexsort((at if directory.cosine else -at, -bound), axis=1)
        before = np.cumsum(n[rank], axis=1) - n[rank]
        r, c = np.nonzero(before < k)
        yield some[r], block[rank[r, c]], rank[r, c]


def other_blocks(k: int, floor: float | None, tau: str = "tau") -> Callable:
    """The blocks left that may hold an item as similar as the query's k-th best so far.
    Column ``tau``: array of (kind, sim) for the kinds in which k items are found."""

    def choose(directory: Directory, length: np.ndarray, near: np.ndarray, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        some = np.flatnonzero(length > 0)
        if not len(some):
            return
        known = [{x["kind"]: x["sim"] for x in t or []} for t in batch.column(tau).to_pylist()]
        seen = list(_probe(directory, length, near, some, k))
        for (kind, block, centre, low, high, _), (r, _, c) in zip(directory.kinds, seen):
            bound = directory.bounds(near[some], length[some], centre, low, high)
            least = np.array([known[i].get(kind, -np.inf) for i in some])
            if floor is not None:
                least = np.maximum(least, floor)
            need = bound >= (least - 1e-9)[:, None]
            need[np.searchsorted(some, r), c] = False
            r, c = np.nonzero(need)
            yield some[r], block[c]

    return choose
