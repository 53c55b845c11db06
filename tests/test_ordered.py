"""Merging in order against a one-by-one loop."""

import numpy as np
import pytest

from stepfold.operators import ordered as O
from stepfold.operators import similarity as S
from stepfold.plans import views as V
from stepfold.suite import QUERIES
from tests.oracle import DATA


def one_by_one(existing, ops, threshold, k):
    """existing: {id: vector}; ops: (op, option, modified_from, vector). Decisions, the library's
    members and vectors, and how many operations long the longest chain of merges is."""
    unit = lambda v: v / n if (n := np.sqrt((v * v).sum())) > 0 else v * 0
    library = {i: ([i], np.array(v, float)) for i, v in existing.items()}
    top = max(existing, default=-1) + 1
    plan, swaps, depth = {}, {}, {}
    for op, option, target, v in sorted(ops, key=lambda o: o[0]):
        v = np.array(v, float)
        if option == "modify" and target in existing and target in library:
            plan[op] = ("replace", target, [])
            swaps[target] = (op, v)
            continue
        sims = {i: round(float(unit(v) @ unit(x)), S.DIGITS) for i, (_, x) in library.items()}
        near = sorted((i for i in sims if sims[i] >= threshold), key=lambda i: (-sims[i], i))[:k]
        members, total = [top + op], v
        for i in near:
            total = total + library[i][1]
            members += library.pop(i)[0]
        depth[top + op] = 1 + max((depth.get(i, 0) for i in near), default=0)
        library[top + op] = (sorted(members), total / (len(near) + 1))
        plan[op] = ("merge" if near else "add", top + op, near)
    swapped = {i: o for i, o in swaps.items() if i in library}
    return plan, {i: m for i, (m, _) in library.items()}, swapped, max(depth.values(), default=0)


def batch(rng, n, n_ops, dim, spread):
    centres = rng.normal(size=(6, dim))
    v = (centres[rng.integers(0, 6, n + n_ops)] + spread * rng.normal(size=(n + n_ops, dim))).astype("float32").astype(float)
    existing = {i * 2: v[i].tolist() for i in range(n)}
    ops = []
    for j in range(n_ops):
        modify = rng.random() < 0.3
        ops.append((j * 3, "modify" if modify else "add", int(rng.integers(0, 2 * n + 4)) if modify else None, v[n + j].tolist()))
    return existing, ops


@pytest.mark.parametrize("seed,n,n_ops,dim,spread,threshold,k,slices", [(1, 30, 25, 4, 0.3, 0.7, 10, False), (2, 20, 40, 3, 0.8, 0.8, 2, False), (3, 0, 30, 3, 0.5, 0.9, 10, True), (4, 25, 30, 8, 2.0, 0.3, 3, False)])
def test_equals_one_by_one(spark, monkeypatch, seed, n, n_ops, dim, spread, threshold, k, slices):
    if slices:
        monkeypatch.setattr(S, "QUERY_BYTES", -1)
    existing, ops = batch(np.random.default_rng(seed), n, n_ops, dim, spread)
    e = spark.createDataFrame([(i, f"t{i}", v) for i, v in existing.items()], "id long, text string, embedding array<float>")
    o = spark.createDataFrame([(a, b, c, d, f"o{a}") for a, b, c, d in ops], "op_id long, option string, modified_from long, embedding array<float>, text string").repartition(3)
    plan, library, swapped, chain = one_by_one(existing, ops, threshold, k)
    report = []
    made = O.plan_ordered_merges(e, o, threshold, k, report=report)
    assert {r.op_id: (r.action, r.node, list(r.taken)) for r in made.collect()} == plan
    assert chain >= 2 and report[0] <= len(ops) + 1
    top = max(existing, default=-1) + 1
    text = lambda i: f"t{i}" if i < top else f"o{i - top}"
    want = {i: f"o{swapped[i][0]}" if i in swapped else "\n\n".join(map(text, m)) for i, m in library.items()}
    assert {r.id: r.text for r in O.apply_ordered_merges(e, o, made).collect()} == want


def test_independent_operations_settle_at_once(spark):
    """A hundred additions that are near nothing: no decision changes."""
    eye = np.eye(100)
    o = spark.createDataFrame([(i, "add", None, eye[i].tolist()) for i in range(100)], "op_id long, option string, modified_from long, embedding array<float>")
    e = spark.createDataFrame([], "id long, embedding array<float>")
    report = []
    assert {r.action for r in O.plan_ordered_merges(e, o, 0.7, report=report).collect()} == {"add"}
    assert report == [1]


def test_query(spark):
    sf = f"{DATA}/sf0.001"
    rows = [(r.id, list(map(float, r.embedding)), r.kind) for r in V.items(spark, sf).collect()]
    existing = {i: v for i, v, k in rows if k < 8}
    ops = [(i, "modify" if i % 3 == 0 else "add", i - 1 if i % 3 == 0 else None, v) for i, v, k in rows if k >= 8]
    plan, library, swapped, _ = one_by_one(existing, ops, 0.3, 10)
    got = {r.op_id: (r.action, r.node, r.taken) for r in QUERIES["ordered_merges"](spark, sf).collect()}
    assert got == {o: (a, n, "|".join(map(str, t))) for o, (a, n, t) in plan.items()}
    top = max(existing) + 1
    want = {i: f"t{swapped[i][0]}" if i in swapped else "\n\n".join(f"t{x if x < top else x - top}" for x in m) for i, m in library.items()}
    assert {r.id: r.text for r in QUERIES["ordered_merge_library"](spark, sf).collect()} == want


def _frames(spark, existing, ops):
    e = spark.createDataFrame(list(existing.items()), "id long, embedding array<double>")
    return e, spark.createDataFrame(ops, "op_id long, option string, modified_from long, embedding array<double>")


def test_a_chain_takes_no_more_rounds(spark):
    """Sixty operations, each near the result of the one before: one block, not sixty rounds."""
    turn = [[float(np.cos(0.02 * i)), float(np.sin(0.02 * i))] for i in range(60)]
    ops = [(i, "add", None, v) for i, v in enumerate(turn)]
    plan, _, _, chain = one_by_one({}, ops, 0.7, 10)
    report = []
    made = O.plan_ordered_merges(*_frames(spark, {}, ops), 0.7, report=report)
    assert {r.op_id: (r.action, r.node, list(r.taken)) for r in made.collect()} == plan
    assert chain == 60 and report == [1]


@pytest.mark.parametrize("size,least,looked", [(16, 2, 16), (4, 1, 4)])
def test_blocks_end_before_items_run_out(spark, monkeypatch, size, least, looked):
    """Equal vectors: every operation wants the same items, more than were looked up for it."""
    for name, value in (("OPS", size), ("LEAST", least), ("LOOKED", looked), ("FOLD", 2)):
        monkeypatch.setattr(O, name, value)
    rng = np.random.default_rng(9)
    existing = {i: [1.0, 0.0, 0.0] if i < 50 else rng.normal(size=3).tolist() for i in range(60)}
    ops = [(j, "modify" if j % 5 == 0 else "add", j if j % 5 == 0 else None, [1.0, 0.0, 0.0] if j % 4 else rng.normal(size=3).tolist()) for j in range(24)]
    plan, library, swapped, _ = one_by_one(existing, ops, 0.6, 3)
    made = O.plan_ordered_merges(*_frames(spark, existing, ops), 0.6, 3)
    assert {r.op_id: (r.action, r.node, list(r.taken)) for r in made.collect()} == plan
