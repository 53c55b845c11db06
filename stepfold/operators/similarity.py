"""Exact similarity search over a metric-ball index.

Few queries (``QUERY_BYTES``, measured) go to the items: every task holds their k best so far.
Otherwise both sides are packed into blocks, and each block of queries meets each block of items
in a cartesian product, whose tasks read two packed parts where they lie: no vector is shuffled
again, and a task, which may go through several parts of the items, gives only its k best per query. Pairs over a threshold are found in the same
way. ``index_topk`` finds the same over an index
(``stepfold.operators.balls``) with fewer products, where vectors cluster well; each visit
of a block is a copy of the query, so where they don't it shuffles the square of the table. Links
between components are a join of the index with itself, blocks against the shells within the
threshold's angle. A task returns only the k best of its block per query (or the pairs), never its product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count, product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfold.operators import balls as B
from stepfold.plans.session import checkpoint
from stepfold.plans.skew import lookup, top_k

#: Items in a block of the index; queries multiplied at a time.
I_BLOCK, Q_BLOCK = 4096, 1024
#: Bytes of items that a task of the cartesian product holds at a time; parts that its queries are cut into, and its tasks.
PART_BYTES, Q_PARTS = 64 << 20, 96
#: Parts that each side of a join of pairs is cut into, as long as they stay within PART_BYTES.
PAIR_PARTS = 24
#: Rows of a block in a join of pairs: each comes with every block of the other side.
PAIR_BLOCK = 16_384
#: Queries of up to so many bytes are sent to all tasks.
QUERY_BYTES = 4 << 20
#: Sampled vectors that tell how many pairs a similarity has, and pairs looked for, times those asked for.
PROBES, SPARE = 2048, 16
# Scores are rounded before ranking: copies of a document must tie however products are summed.
DIGITS = 12


def _best(sims: np.ndarray, k: int) -> list[np.ndarray]:
    """Columns of the k largest per row; equal values in column order."""
    n = sims.shape[1]
    if n <= k:
        return [np.arange(n)] * sims.shape[0]
    cut = np.partition(sims, n - k, axis=1)[:, n - k]
    out = []
    for row, c in zip(sims, cut):
        above = np.flatnonzero(row > c)
        out.append(np.concatenate([above, np.flatnonzero(row == c)[: k - len(above)]]))
    return out


def _without_self(sims: np.ndarray, q_ids: list, i_ids: list) -> None:
    """Queries don't find the item of their own id."""
    place: dict = {}
    for j, x in enumerate(i_ids):
        place.setdefault(x, []).append(j)
    for i, x in enumerate(q_ids):
        for j in place.get(x, ()):
            sims[i, j] = -np.inf


def _found_schema(queries: DataFrame, items: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", queries.schema["id"].dataType), T.StructField("item_id", items.schema["id"].dataType), T.StructField("sim", T.DoubleType()), T.StructField("kind", items.schema["kind"].dataType)])


def _hits(q_ids: pa.Array, i_ids: pa.Array, sims: np.ndarray, kind, kind_type: pa.DataType, k: int, floor: float) -> pa.RecordBatch | None:
    """The k best per row of ``sims`` at or over ``floor``; columns come in the order of ids."""
    cols = _best(sims, k)
    q_at, i_at = np.repeat(np.arange(len(sims)), [len(c) for c in cols]), np.concatenate(cols)
    found = sims[q_at, i_at]
    keep = (found >= floor) & np.isfinite(found)
    if not keep.any():
        return None
    n = int(keep.sum())
    return pa.RecordBatch.from_arrays([q_ids.take(pa.array(q_at[keep])), i_ids.take(pa.array(i_at[keep])), pa.array(found[keep]), pa.array([kind] * n, kind_type)], names=["query_id", "item_id", "sim", "kind"])


def _scan(queries: DataFrame, items: DataFrame, k: int, floor: float, cosine: bool, exclude_self: bool) -> DataFrame:
    """Every task goes through its items once and keeps k per query and kind."""
    rows = queries.select("id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null").toArrow()
    shared = queries.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if not len(held):
            return
        ids = held.column("id").combine_chunks()
        q_ids = ids.to_pylist()
        q = B.matrix(held.column("embedding").combine_chunks())
        q = B.unit(q) if cosine else q
        best: dict = {}
        kinds_type = id_type = None
        for batch in batches:
            id_type, kinds_type = batch.column("id").type, batch.column("kind").type
            names, of = batch.column("id").to_pylist(), batch.column("kind").to_pylist()
            order = np.argsort(np.asarray(names), kind="stable")
            groups: dict = {}
            for i in order:
                groups.setdefault(of[i], []).append(i)
            v = B.matrix(batch.column("embedding"))
            v = B.unit(v) if cosine else v
            for kind, at in groups.items():
                for a in range(0, len(at), I_BLOCK):
                    some = at[a : a + I_BLOCK]
                    own = [names[i] for i in some]
                    top = best.setdefault(kind, [(np.full((0,), -np.inf), [])] * len(q_ids))
                    for c in range(0, len(q), Q_BLOCK):
                        sims = np.round(q[c : c + Q_BLOCK] @ v[some].T, DIGITS)
                        if exclude_self:
                            _without_self(sims, q_ids[c : c + Q_BLOCK], own)
                        sims[sims < floor] = -np.inf
                        worst = np.array([t[0][-1] if len(t[0]) == k else -np.inf for t in top[c : c + Q_BLOCK]])
                        for r in np.flatnonzero(sims.max(axis=1) >= worst):
                            cols = _best(sims[r : r + 1], k)[0]
                            cols = cols[sims[r, cols] > -np.inf]
                            if len(cols):
                                old, old_ids = top[c + r]
                                both, both_ids = np.concatenate([old, sims[r, cols]]), old_ids + [own[j] for j in cols]
                                rank = sorted(range(len(both)), key=lambda j: (-both[j], both_ids[j]))[:k]
                                top[c + r] = both[rank], [both_ids[j] for j in rank]
        for kind, top in best.items():
            for c in range(0, len(top), Q_BLOCK):
                size = [len(t[0]) for t in top[c : c + Q_BLOCK]]
                if sum(size):
                    at = np.repeat(np.arange(c, c + len(size)), size)
                    found = [x for t in top[c : c + Q_BLOCK] for x in t[1]]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(at)), pa.array(found, id_type), pa.array(np.concatenate([t[0] for t in top[c : c + Q_BLOCK]])), pa.array([kind] * len(at), kinds_type)],
                        names=["query_id", "item_id", "sim", "kind"],
                    )

    vectors = items.select("id", F.col("embedding").cast("array<double>").alias("embedding"), "kind").where("embedding is not null")
    return vectors.mapInArrow(run, _found_schema(queries, items))


def _bytes(queries: DataFrame) -> int:
    return queries.agg(F.sum(F.size("embedding").cast("long") * 8 + 16)).first()[0] or 0


def block_topk(queries: DataFrame, items: DataFrame, k: int, min_sim: float) -> DataFrame:
    """k most similar items of a few queries (id, embedding), which all tasks get."""
    found = _scan(queries, items.withColumn("kind", F.lit(None).cast("int")), k, min_sim, True, False)
    return top_k(found.drop("kind"), ["query_id"], [F.desc("sim"), F.col("item_id")], k)


def _meet(visits: DataFrame, index: B.Balls, k: int, floor: float, exclude_self: bool, schema: T.StructType) -> DataFrame:
    """The k best of each block for the queries that meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                q_ids, i_ids = batch.column("q_ids")[i].values, batch.column("ids")[i].values
                q, v = (batch.column(c)[i].values.to_numpy().reshape(len(n), -1) for c, n in (("q_flat", q_ids), ("flat", i_ids)))
                for c in range(0, len(q), Q_BLOCK):
                    sims = np.round(q[c : c + Q_BLOCK] @ v.T, DIGITS)
                    some = q_ids.slice(c, Q_BLOCK)
                    if exclude_self:
                        _without_self(sims, some.to_pylist(), i_ids.to_pylist())
                    out = _hits(some, i_ids, sims, batch.column("kind")[i].as_py(), batch.column("kind").type, k, floor)
                    if out is not None:
                        yield out

    pairs = visits.join(index.packed, "block").select("q_ids", "q_flat", "ids", "flat", "kind")
    return pairs.mapInArrow(run, schema)


def index_topk(queries: DataFrame, items: DataFrame, k: int, *, floor: float | None, cosine: bool, exclude_self: bool, block: int | None = None, report: list | None = None) -> DataFrame:
    """The same search by two visits of the index. ``report`` gets both visits and the index."""
    keep = k + exclude_self
    # of equal vectors only the smallest ids can be among the k best
    few = checkpoint(top_k(items, ["embedding", "kind"], [F.col("id")], keep).drop("rn"))
    index = B.build(few, cosine=cosine, block=block or I_BLOCK, least=keep)
    schema, least = _found_schema(queries, items), -np.inf if floor is None else floor
    first = B.visit(queries, index, B.first_blocks(keep))
    found = checkpoint(top_k(_meet(first, index, k, least, exclude_self, schema), ["query_id", "kind"], [F.desc("sim"), F.col("item_id")], k))
    full = found.groupBy("query_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("sim")).where(F.col("n") == k)
    tau = full.groupBy("query_id").agg(F.collect_list(F.struct("kind", "sim")).alias("tau"))
    again = queries.select("id", "embedding").join(tau.withColumnRenamed("query_id", "id"), "id", "left")
    second = B.visit(again, index, B.other_blocks(keep, floor), "tau")
    if report is not None:
        report += [index, first, second]
    return found.drop("rn").unionByName(_meet(second, index, k, least, exclude_self, schema))


def _tiles(rows: DataFrame, parts: int, block: int, cosine: bool) -> DataFrame:
    """no, ids, flat (doubles as bytes), kind: ``parts`` parts of blocks of up to ``block`` rows of one kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        number = count(TaskContext.get().partitionId() << 32)

        def cut(kind, some: list[tuple]) -> pa.RecordBatch:
            ids = pa.concat_arrays([i for i, _ in some])
            flat = np.concatenate([v for _, v in some]).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([next(number)]), B.lists(ids, [len(ids)]), pa.array([flat]), pa.array([kind], kinds)], names=["no", "ids", "flat", "kind"])

        for batch in batches:
            v, kinds, of = B.matrix(batch.column("embedding")), batch.column("kind").type, {}
            v = B.unit(v) if cosine else v
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                of.setdefault(kind, []).append(i)
            for kind, at in of.items():
                some = held.setdefault(kind, [])
                while at:
                    room = block - sum(len(i) for i, _ in some)
                    some.append((batch.column("id").take(pa.array(at[:room])), v[at[:room]]))
                    at = at[room:]
                    if sum(len(i) for i, _ in some) == block:
                        yield cut(kind, some)
                        some.clear()
        for kind, some in held.items():
            if some:
                yield cut(kind, some)

    schema = T.StructType([T.StructField("no", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("flat", T.BinaryType()), T.StructField("kind", rows.schema["kind"].dataType)])
    vectors = rows.select("id", F.col("embedding").cast("array<double>").alias("embedding"), "kind").where("embedding is not null")
    return checkpoint(vectors.repartitionByRange(parts, "kind", "id").mapInArrow(run, schema))


def _reaching(q: np.ndarray, v: np.ndarray, cut: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and product of the pairs at or over their row's ``cut``, and with ``first`` among
    the row's so many largest. Single precision finds them, with what it may err by to spare."""
    length, most = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1)).max(initial=0)
    single = length.max(initial=0) * most < 1e30
    sims = q.astype(np.float32) @ v.astype(np.float32).T if single else q @ v.T
    spare = 2.0 ** (-23 if single else -50) * (q.shape[1] + 2) * length * most + 2 * 10.0**-DIGITS
    if 0 < first < len(v):
        np.nan_to_num(sims, copy=False, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        cut = np.maximum(cut, np.partition(sims, len(v) - first, axis=1)[:, len(v) - first] - spare)
    r, c = np.divmod(np.flatnonzero(sims >= (cut - spare).astype(sims.dtype)[:, None]), len(v))
    exact = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", q[r[a : a + I_BLOCK]], v[c[a : a + I_BLOCK]]) for a in range(0, len(r), I_BLOCK)]])
    keep = np.isfinite(exact)
    return r[keep], c[keep], exact[keep]


class _Best:
    """The ``keep`` best items of each query of a block so far; ties: smaller id."""

    def __init__(self, rows: int, keep: int, floor: float):
        self.sims, self.ids, self.floor = np.full((rows, keep), -np.inf), None, floor

    def meet(self, q: np.ndarray, v: np.ndarray, ids: np.ndarray) -> None:
        keep = self.sims.shape[1]
        r, c, found = _reaching(q, v, np.maximum(self.sims[:, -1], self.floor), 0 if self.ids is not None else keep)
        found = np.round(found, DIGITS)
        good = found >= np.maximum(self.sims[:, -1], self.floor)[r]
        r, c, found = r[good], c[good], found[good]
        if self.ids is None:
            self.ids = np.empty(self.sims.shape, ids.dtype)
        rows = np.unique(r)
        old, place = np.nonzero(self.sims[rows] > -np.inf)
        row, sim, name = np.append(rows[old], r), np.append(self.sims[rows][old, place], found), np.append(self.ids[rows][old, place], ids[c])
        order = np.lexsort((np.unique(name, return_inverse=True)[1] if name.dtype == object else name, -sim, row))
        row, sim, name = row[order], sim[order], name[order]
        at = np.arange(len(row)) - np.searchsorted(row, row)
        top = at < keep
        self.sims[rows] = -np.inf
        self.sims[row[top], at[top]], self.ids[row[top], at[top]] = sim[top], name[top]


def tile_topk(queries: DataFrame, items: DataFrame, k: int, *, floor: float | None, cosine: bool, exclude_self: bool, block: int | None = None, parts: tuple[int, int] | None = None) -> DataFrame:
    """The k best (at least) per query and kind of each task. A task goes through several parts of the
    items for its queries, so that what is shuffled does not grow with the number of parts."""
    keep, least = k + exclude_self, -np.inf if floor is None else floor
    # of equal vectors only the smallest ids can be among the k best
    few = checkpoint(top_k(items, ["embedding", "kind"], [F.col("id")], keep).drop("rn"))
    q_parts, i_parts = parts or (min(Q_PARTS, -(-queries.count() // Q_BLOCK) or 1), -(-_bytes(few) // PART_BYTES) or 1)
    q = _tiles(queries.withColumn("kind", F.lit(None).cast("int")), q_parts, min(block or Q_BLOCK, Q_BLOCK), cosine).select(F.col("no").alias("q_no"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))
    tiles = _tiles(few, i_parts, block or I_BLOCK, cosine).select("ids", "flat", "kind")
    schema = _found_schema(queries, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}  # ids and the best so far; a block of queries comes with all items of a part, then with those of the next part
        for batch in batches:
            types = batch.column("ids").type.value_type, batch.column("kind").type
            for i in range(len(batch)):
                no = batch.column("q_no")[i].as_py()
                if no not in held:
                    ids = batch.column("q_ids")[i].values
                    held[no] = ids.take(pa.array(np.arange(len(ids)))), {}  # a copy, so that the batch is let go
                own, best = held[no]
                vectors = np.frombuffer(batch.column("q_flat")[i].as_buffer(), np.float64).reshape(len(own), -1)
                names = batch.column("ids")[i].values
                v = np.frombuffer(batch.column("flat")[i].as_buffer(), np.float64).reshape(len(names), -1)
                kind = batch.column("kind")[i].as_py()
                if kind not in best:
                    best[kind] = _Best(len(own), keep, least)
                best[kind].meet(vectors, v, names.to_numpy(zero_copy_only=False))
        for own, best in held.values():
            for kind, b in best.items():
                r, c = np.nonzero(b.sims > -np.inf)
                q_ids, i_ids = own.take(pa.array(r)), pa.array(b.ids[r, c], types[0])
                out = pa.RecordBatch.from_arrays([q_ids, i_ids, pa.array(b.sims[r, c]), pa.array([kind] * len(r), types[1])], names=["query_id", "item_id", "sim", "kind"])
                if exclude_self and len(r):
                    other = np.array([x != y for x, y in zip(q_ids.to_pylist(), i_ids.to_pylist())], bool)
                    out = out.filter(pa.array(other))
                if len(out):
                    yield out

    met = q.hint("shuffle_replicate_nl").crossJoin(tiles)
    # the product's parts lie by part of the queries: neighbours in one task share it
    return (met.coalesce(max(q_parts, Q_PARTS)) if q_parts * i_parts > max(q_parts, Q_PARTS) else met).mapInArrow(run, schema)


def similarity_topk(
    queries: DataFrame, items: DataFrame, k: int, *, min_sim: float | None = None, by_kind=False, metric="cosine", exclude_self=False
) -> DataFrame:
    """k most similar items per query (per kind if asked): query_id, item_id, [kind], sim,
    rn. Items below min_sim go before the cut. Ties: smaller item id. ``queries`` has id and
    embedding, ``items`` also kind if by_kind. Rows without a vector are not searched."""
    items = items.select("id", "embedding", "kind" if by_kind else F.lit(None).cast("int").alias("kind"))
    queries = queries.select("id", "embedding")
    if _bytes(queries) <= QUERY_BYTES:
        found = _scan(queries, items, k, -np.inf if min_sim is None else min_sim, metric == "cosine", exclude_self)
    else:
        found = tile_topk(queries, items, k, floor=min_sim, cosine=metric == "cosine", exclude_self=exclude_self)
    kind = ["kind"] if by_kind else []
    return top_k(found.select("query_id", "item_id", "sim", *kind), ["query_id", *kind], [F.desc("sim"), F.col("item_id")], k)


def _representatives(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first of equal vectors (id, embedding, kind), and a link from it to each of the others."""
    reps = items.groupBy("embedding").agg(F.min("id").alias("rep"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    links = lookup(items, reps, ["embedding"], "inner").where((F.col("id") != F.col("rep")) & (norm > 0))
    links = links.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    return reps.select(F.col("rep").alias("id"), "embedding", F.lit(None).cast("int").alias("kind")), links


def _piles(directory: B.Directory, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """Blocks that the directory alone shows to be connected: a number for each such pile of
    blocks (-1: none), and for each block another one of its pile, all of whose items are near
    all of its own (-1: none). Only blocks half as wide as the threshold's angle count."""
    _, block, centre, _, high, _ = directory.kinds[0]
    pile, near = np.full(len(block), -1), np.full(len(block), -1)
    tight = np.flatnonzero((centre >= 0) & (2 * (high + B.SLACK) <= angle))
    if not len(tight):
        return pile, near
    names, first = np.unique(centre[tight], return_index=True)
    head = tight[first]  # the first block of each centre
    wide = np.zeros(len(names))
    of = np.searchsorted(names, centre[tight])
    np.maximum.at(wide, of, high[tight])
    c = directory.centres[names]
    sure = np.arccos(np.clip(c @ c.T, -1, 1)) + wide[:, None] + wide + 3 * B.SLACK <= angle
    label = np.full(len(names), -1)
    for i in range(len(names)):
        if label[i] < 0:
            label[i], todo = i, [i]
            while todo:
                at = todo.pop()
                new = np.flatnonzero(sure[at] & (label < 0))
                label[new], near[head[new]] = i, block[head[at]]
                todo += new.tolist()
    pile[tight] = label[of]
    rest = tight != head[of]
    near[tight[rest]] = block[head[of[rest]]]
    return pile, near


def _range_join(index: B.Balls, threshold: float, piles: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Each block as queries, with the blocks from itself on (by number) that its items reach
    within the threshold's angle, and those items: every pair of items meets in one place.
    With ``piles`` only the numbers of blocks, and those of one pile meet in a tree."""
    shared = index.packed.sparkSession.sparkContext.broadcast(index.directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = shared.value
        _, block, centre, low, high, _ = directory.kinds[0]
        for batch in batches:
            for i in range(len(batch)):
                own, ids = batch.column("block")[i].as_py(), batch.column("ids")[i].values
                v = batch.column("flat")[i].values.to_numpy().reshape(len(ids), -1)
                length = np.sqrt((v * v).sum(axis=1))
                step = max(1, B.BOUNDS // len(block))
                need = []
                for a in range(0, len(v), step):
                    bound = directory.bounds(directory.near(v[a : a + step]), length[a : a + step], centre, low, high)
                    need.append((bound >= threshold - 1e-9) & (block >= own))
                need = np.concatenate(need)
                if piles is not None:
                    pile, near = piles
                    me = int(np.searchsorted(block, own))
                    if pile[me] >= 0:
                        need[:, pile == pile[me]] = False
                        need[:, block == near[me]] = True
                for j in np.flatnonzero(need.any(axis=0)):
                    at = np.arange(0) if piles is not None else np.arange(len(ids)) if block[j] == own else np.flatnonzero(need[:, j])
                    flat = v[at].ravel()
                    yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([block[j]], pa.int64()), B.lists(ids.take(pa.array(at)), [len(at)]), B.lists(flat, [len(flat)])], names=["q_block", "block", "q_ids", "q_flat"])

    schema = T.StructType([T.StructField("q_block", T.LongType()), T.StructField("block", T.LongType()), *[T.StructField(n, index.packed.schema[of].dataType) for n, of in (("q_ids", "ids"), ("q_flat", "flat"))]])
    return index.packed.select("block", "ids", "flat").mapInArrow(run, schema)


def _pairs(vectors: DataFrame, threshold: float, others: DataFrame | None = None, *, block: int | None = None) -> DataFrame:
    """All pairs a < b at or over the threshold: of two of the vectors, or of one of them and one of ``others``."""
    alone = others is None

    def cut(rows: DataFrame) -> DataFrame:
        parts = max(min(PAIR_PARTS, -(-rows.count() // (block or I_BLOCK))), -(-_bytes(rows) // PART_BYTES), 1)
        return _tiles(rows, parts, block or PAIR_BLOCK, True).drop("kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                q_ids, i_ids = batch.column("q_ids")[i].values, batch.column("ids")[i].values
                q, v = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(len(n), -1) for c, n in (("q_flat", q_ids), ("flat", i_ids)))
                own = alone and batch.column("q_no")[i].as_py() == batch.column("no")[i].as_py()
                for a, c in product(range(0, len(q), Q_BLOCK), range(0, len(v), I_BLOCK)):
                    some = q[a : a + Q_BLOCK]
                    if own and a >= c + I_BLOCK:  # a block with itself is the same rows
                        continue
                    r, j, sims = _reaching(some, v[c : c + I_BLOCK], np.full(len(some), float(threshold)))
                    keep = (sims >= threshold) & ((r + a < j + c) if own else True)
                    if keep.any():
                        yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(r[keep] + a)), i_ids.take(pa.array(j[keep] + c)), pa.array(sims[keep])], names=["a", "b", "sim"])

    ident = vectors.schema["id"].dataType
    schema = T.StructType([T.StructField("a", ident), T.StructField("b", ident), T.StructField("sim", T.DoubleType())])
    tiles = cut(vectors)
    left = tiles.select(*[F.col(c).alias(f"q_{c}") for c in tiles.columns]).hint("shuffle_replicate_nl")
    met = left.join(tiles, F.col("q_no") <= F.col("no")) if alone else left.crossJoin(cut(others))
    return met.mapInArrow(run, schema).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")


def similar_pairs(items: DataFrame, threshold: float, *, block: int | None = None) -> DataFrame:
    """All pairs a < b of distinct vectors with cosine >= threshold (a, b, sim), and a link
    from the smallest id of equal vectors to each of its copies (sim 1). A group of n copies
    gives n - 1 links, not n^2 pairs, and its first id stands for it in the other pairs. Blocks
    meet in a cartesian product of the packed table with itself, each two once."""
    vectors, links = _representatives(items)
    return _pairs(checkpoint(vectors), threshold, block=block).unionByName(links)


@dataclass
class Closest:
    """All ``pairs`` (a, b, sim) at or over ``cut``."""

    pairs: DataFrame
    cut: float


def _reach(vectors: DataFrame, threshold: float) -> Callable[[int], float]:
    """Gives for a number of pairs a similarity that about so many reach, at least the threshold:
    an estimate by the pairs that sampled vectors make with all vectors."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(PROBES).select("id", "embedding").toArrow()
    shared = vectors.sparkSession.sparkContext.broadcast(rows)
    steps = np.concatenate([np.linspace(threshold, 1, 1000, endpoint=False), 1 - np.geomspace(1e-6, 1e-1, 500)])
    steps = np.unique(np.maximum(steps, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = shared.value, np.zeros(len(steps), np.int64)
        names = held.column("id").to_pylist()
        q = B.unit(B.matrix(held.column("embedding").combine_chunks())).astype(np.float32)
        for batch in batches:
            v, ids = B.unit(B.matrix(batch.column("embedding"))).astype(np.float32), batch.column("id").to_pylist()
            for a in range(0, len(v), I_BLOCK):
                sims = q @ v[a : a + I_BLOCK].T
                _without_self(sims, names, ids[a : a + I_BLOCK])
                n += np.bincount(np.searchsorted(steps, sims[sims >= threshold], "right") - 1, minlength=len(steps))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(steps))), pa.array(n)], names=["step", "n"])

    found = vectors.select("id", "embedding").mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy("step")
    counts = found.toArrow().column("n").to_numpy()
    # a pair is met from either side
    over = np.cumsum(counts[::-1])[::-1] * (vectors.count() / max(1, len(rows)) / 2)

    def cut(most: int) -> float:
        enough = np.flatnonzero(over >= most)
        return float(steps[enough[-1]]) if len(enough) else float(threshold)

    return cut


def closest_pairs(vectors: DataFrame, threshold: float, most: int, known: Closest | None = None, *, few: int = I_BLOCK) -> Closest:
    """All pairs of ``vectors`` (id, embedding, fresh; no two equal) down to a similarity that at least ``most``
    of them reach, so that it holds the ``most`` best (all over the threshold, if there are fewer). The
    similarity is estimated for ``SPARE`` times as many; if the pairs found are too few, they are searched
    again with a lower one. ``known`` holds the pairs of those that are not ``fresh``: if they reach far
    enough, only the fresh ones meet all others. Up to ``few`` vectors are not worth an estimate."""
    vectors = vectors.where("embedding IS NOT NULL").withColumn("kind", F.lit(None).cast("int"))
    if threshold >= 1 or vectors.count() <= few:
        return Closest(_pairs(vectors, threshold), threshold)
    if most <= 0:  # all are copies, and only what is as similar may come before some of them
        return Closest(checkpoint(_pairs(vectors, 1.0)), 1.0)
    reach = _reach(vectors, threshold)
    if known is not None and (known.cut <= threshold or known.cut <= reach(2 * most)):
        fresh, rest = vectors.where("fresh"), vectors.where("NOT fresh")
        pairs = checkpoint(known.pairs.unionByName(_pairs(fresh, known.cut)).unionByName(_pairs(fresh, known.cut, rest)))
        if known.cut <= threshold or pairs.count() >= most:
            return Closest(pairs, known.cut)
    want = SPARE * most
    cut = reach(want)
    while True:
        pairs = checkpoint(_pairs(vectors, cut))
        if cut <= threshold or pairs.count() >= most:
            return Closest(pairs, cut)
        want *= SPARE
        cut = reach(want) if reach(want) < cut else float(threshold)


def _labels(near: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric relation: the smallest row reachable."""
    n = len(near)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            label[i] = i
            todo = [i]
            while todo:
                new = np.flatnonzero(near[todo].any(axis=0) & (label < 0))
                label[new] = i
                todo = new.tolist()
    return label


def similar_links(items: DataFrame, threshold: float, *, block: int | None = None) -> DataFrame:
    """Links (a, b) with the same connected components as ``similar_pairs``, but no more than a
    few for each item: a block of the index links each of its items once, and two blocks give one
    link for each pair of their components that touch. Blocks of a pile of near-copies are one
    component each and meet in a tree, so a pile gives about as many links as it has items."""
    vectors, copies = _representatives(items)
    index = B.build(vectors, block=block or I_BLOCK)
    copies = copies.select("a", "b")
    if not index.directory.kinds:
        return copies
    ident = items.schema["id"].dataType
    angle = float(np.arccos(np.clip(threshold, -1, 1)))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids = batch.column("ids")[i].values
                v = batch.column("flat")[i].values.to_numpy().reshape(len(ids), -1)
                close = 2 * (batch.column("high")[i].as_py() + B.SLACK) <= angle and batch.column("centre")[i].as_py() >= 0
                label = np.zeros(len(ids), np.int64) if close else _labels(v @ v.T >= threshold)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, 1) for c in ("block", "centre", "high", "ids", "flat")), B.lists(label, [len(label)])],
                    names=["block", "centre", "high", "ids", "flat", "labels"],
                )

    fields = [index.packed.schema[c] for c in ("block", "centre", "high", "ids", "flat")]
    labelled = checkpoint(index.packed.select("block", "centre", "high", "ids", "flat").mapInArrow(inside, T.StructType([*fields, T.StructField("labels", T.ArrayType(T.LongType()))])))
    own = labelled.select(F.posexplode("labels").alias("i", "label"), "ids").where("i <> label")
    own = own.select(F.col("ids")[F.col("label").cast("int")].alias("a"), F.col("ids")[F.col("i")].alias("b"))

    shared = items.sparkSession.sparkContext.broadcast(index.directory.centres)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            for i in range(len(batch)):
                ids = [batch.column(c)[i].values for c in ("q_ids", "ids")]
                q, v = (batch.column(c)[i].values.to_numpy().reshape(len(n), -1) for c, n in zip(("q_flat", "flat"), ids))
                of = [batch.column(c)[i].values.to_numpy() for c in ("q_labels", "labels")]
                met: dict[tuple[int, int], tuple[int, int]] = {}
                c1, c2, h1, h2 = (batch.column(c)[i].as_py() for c in ("q_centre", "centre", "q_high", "high"))
                if min(c1, c2) >= 0 and h1 + h2 + np.arccos(np.clip(centres[c1] @ centres[c2], -1, 1)) + 3 * B.SLACK <= angle:
                    # every item of the one is near every item of the other
                    met = {(0, x): (0, int(x)) for x in np.unique(of[1])} | {(x, 0): (int(x), 0) for x in np.unique(of[0])}
                    q = q[:0]
                for c in range(0, len(q), Q_BLOCK):
                    r, j = np.nonzero(q[c : c + Q_BLOCK] @ v.T >= threshold)
                    both = of[0][r + c] * len(v) + of[1][j]
                    _, first = np.unique(both, return_index=True)
                    for f in first:
                        met.setdefault((int(of[0][r[f] + c]), int(of[1][j[f]])), (int(r[f] + c), int(j[f])))
                if met:
                    yield pa.RecordBatch.from_arrays([ids[0].take(pa.array([x for x, _ in met.values()])), ids[1].take(pa.array([y for _, y in met.values()]))], names=["a", "b"])

    reach = _range_join(index, threshold, _piles(index.directory, angle)).where("q_block <> block").select("q_block", "block")
    left = labelled.select(*[F.col(c).alias(f"q_{c}") for c in labelled.columns])
    met = reach.join(left, "q_block").join(labelled, "block")
    met = met.mapInArrow(across, T.StructType([T.StructField("a", ident), T.StructField("b", ident)]))
    return own.unionByName(met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(copies)


def dense_batch_topk(queries: DataFrame, docs: DataFrame, k: int, payload: list[str]) -> DataFrame:
    """Inner-product top-k, then the payload of the hits by join on the document id."""
    hits = similarity_topk(queries, docs, k, metric="dot")
    body = docs.select(F.col("id").alias("item_id"), *payload)
    return lookup(hits, body, ["item_id"])
