"""Exact majorities against enumeration, the bootstrap against the exact values."""

from collections import Counter
from fractions import Fraction
from itertools import product
from math import comb

import numpy as np
import pytest

from stepfold.operators import report as P
from stepfold.operators import votes as V


def by_enumeration(rows, n):
    """Mean and std over all sequences of n rows."""
    got = []
    for draw in product(rows, repeat=n):
        count = Counter(p for p, _ in draw)
        best = max(count.values())
        winner = next(p for p, _ in draw if count[p] == best)
        got.append(next(v for p, v in draw if p == winner))
    return np.mean(got), np.std(got)


GROUPS = {
    "one": [("a", 1.0)], "same": [("a", 0.5), ("a", 1.5), ("a", 2.5)], "split": [("a", 1.0), ("b", 0.0)],
    "three": [("a", 1.0), ("b", 0.0), ("c", 5.0), ("a", 2.0)], "null": [(None, 1.0), ("b", 0.25), (None, 3.0), ("c", -1.0), ("b", 0.75)],
}


def frame(spark):
    rows = [(k, p, v, i) for k, g in GROUPS.items() for i, (p, v) in enumerate(g)]
    return spark.createDataFrame([*rows, ("one", "z", None, 9)], "k string, pred string, val double, ord long")


def test_majority_by_enumeration(spark):
    ns = [1, 2, 3, 4, 5]
    got = {(r.k, r.n): (r.maj_mean, r.maj_std) for r in V.majority_exact(frame(spark), ["k"], ns).collect()}
    assert set(got) == {(k, n) for k in GROUPS for n in ns}
    for (k, n), pair in got.items():
        assert pair == pytest.approx(by_enumeration(GROUPS[k], n), abs=1e-9)


@pytest.mark.parametrize("n", [1, 7, 40, 64])
def test_chances_add_up(n):
    sizes, classes = np.array([1.0, 2.0, 5.0, 30.0]), np.array([6.0, 3.0, 2.0, 1.0])
    assert V.majority_moments(sizes, classes, classes[None, :], n) == pytest.approx(1, abs=1e-9)


def test_steps_up_to_the_size(spark):
    d = spark.createDataFrame([("k", str(i % 3), float(i)) for i in range(11)] + [("s", "a", 1.0)], "k string, pred string, val double")
    assert sorted(r.n for r in V.majority_exact(d, ["k"]).collect()) == [2, 4, 8, 11]
    assert sorted(r.n for r in V.majority_exact(d, ["k"], most=8).collect()) == [2, 4, 8]
    with pytest.raises(ValueError):
        V.majority_exact(d, ["k"], [100])
    assert V.majority_exact(d.limit(0), ["k"]).collect() == []


def test_bootstrap_repeats_and_approaches(spark):
    d = spark.createDataFrame([("k", str(i % 3), float(i * i % 17), i) for i in range(12)], "k string, pred string, val double, ord long")
    run = lambda df: {r.n: tuple(r) for r in V.bootstrap_at_n(df, ["k"], "val", [2, 8], rounds=3000, order="ord").collect()}
    once, again = run(d.coalesce(1)), run(d.repartition(200))
    assert {n: pytest.approx(t[2:], abs=1e-9) for n, t in once.items()} == {n: t[2:] for n, t in again.items()}
    assert run(d.where("true")) != {r.n: tuple(r) for r in V.bootstrap_at_n(d, ["k"], "val", [2, 8], rounds=3000, seed=1, order="ord").collect()}
    exact = {r.n: tuple(r) for r in P.best_worst_at_n(d, ["k"], "val", [2, 8]).collect()}
    for n in (2, 8):
        assert once[n][2:] == pytest.approx(exact[n][2:], abs=0.35)
    won = V.majority_at_n(d, ["k"], 5, rounds=3000).first()
    want = V.majority_exact(d, ["k"], [5]).first()
    assert (won.maj_mean, won.maj_std) == pytest.approx((want.maj_mean, want.maj_std), abs=0.35)


def test_report_has_majorities(spark):
    rows = [("s", p, x, v) for p, g in (("q1", "three"), ("q2", "split")) for x, v in GROUPS[g]]
    d = spark.createDataFrame(rows, "data_source string, prompt string, pred string, score double")
    got = {r.metric: r.value for r in P.validation_report(d, vote="pred").collect()}
    both = [by_enumeration(GROUPS[g], 2) for g in ("three", "split")]
    assert got["maj@2/mean"] == pytest.approx(np.mean([m for m, _ in both])) and got["maj@2/std"] == pytest.approx(np.mean([s for _, s in both]))
    assert got["maj@4/mean"] == pytest.approx(by_enumeration(GROUPS["three"], 4)[0])
    assert {k: v for k, v in got.items() if not k.startswith("maj")} == {r.metric: r.value for r in P.validation_report(d).select("*").collect()}


def test_draws_are_not_broadcast(spark, monkeypatch):
    d = spark.range(300).selectExpr("id % 20 AS k", "id AS ord", "id * 0.5 AS val").union(spark.sql("SELECT NULL, 1000L, 3.5D")).union(spark.sql("SELECT NULL, 1001L, 4.5D"))
    run = lambda: V.bootstrap_at_n(d, ["k"], "val", [2, 5], rounds=40, order="ord")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    packed = run()
    want = rows(packed)
    assert "Join" not in plan(packed) and len(want) == 42
    for most in (0, 5):  # all groups joined; the group of two packed, the others joined
        monkeypatch.setattr(V, "PACKED", most)
        got = run()
        assert "SortMergeJoin" in plan(got) and "BroadcastHashJoin" not in plan(got) and rows(got) == want


def test_chances_are_kept_by_pattern(monkeypatch):
    calls, real = [], V.majority_moments
    monkeypatch.setattr(V, "majority_moments", lambda *a: calls.append(a) or real(*a))
    V.winning.cache_clear()
    sizes, classes, sums = (1.0, 2.0, 5.0), (3.0, 1.0, 2.0), np.array([[3.5, -1.0, 0.25], [9.0, 1.0, 2.0]])
    for _ in range(50):
        got = sums @ V.winning(sizes, classes, 8)
    assert len(calls) == 1
    assert got == pytest.approx(real(np.array(sizes), np.array(classes), sums, 8), abs=1e-12)


def test_chances_of_many_draws():
    """As multiplied out, as the binomial of two classes, and of many classes of a size."""
    for sizes, classes in (([1.0, 2.0, 5.0, 30.0], [6.0, 3.0, 2.0, 1.0]), ([3.0, 4.0], [1.0, 1.0]), ([1.0, 7.0], [50.0, 2.0])):
        s, c = np.array(sizes), np.array(classes)
        for n in (1, 2, 7, 64, 90):
            assert V.majority_chances(s, c, n) == pytest.approx(V.majority_moments(s, c, np.diag(c), n) / c, abs=1e-12)
    for a, b, n in ((70, 80, 128), (900, 1100, 2000)):
        want = sum(comb(n, i) * a**i * b ** (n - i) * (2 if 2 * i > n else 2 * i == n) for i in range(n + 1))
        assert V.majority_chances(np.array([a, b]), np.ones(2), n)[0] == pytest.approx(float(Fraction(want, 2 * (a + b) ** n)), abs=1e-12)
    many = V.winning((1.0, 2.0), (1e5, 1e5), 2)
    assert many == pytest.approx((1 / 3e5, 2 / 3e5), abs=1e-12) and V.winning((3.0,), (400.0,), 1200) == pytest.approx(1 / 400)


@pytest.mark.parametrize("degree", [0, 5, 63, 64, 1000, 10**6])
def test_shares_of_ties(degree):
    at, weight = V.tie_nodes(degree)
    for t in {0, degree // 3, degree}:
        assert (weight * at**t).sum() * (t + 1) == pytest.approx(1, abs=1e-9)


def test_report_votes_in_groups_of_any_size(spark, tmp_path):
    """Groups of more rows than are multiplied out report all their draws, as the SQL does."""
    import duckdb

    from stepfold.suite import ORACLES, QUERIES

    rng, rows = np.random.default_rng(3), []
    for uid, size, share in ((1, 1500, 0.5), (2, 130, 0.52), (3, 65, 1.0), (4, 9, 0.4), (5, 1, 0.0)):
        rows += [(uid, len(rows) + i, float(rng.integers(100, 50_000_000)) / 100, "F" if rng.random() < share else "O", "1") for i in range(size)]
    d = spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_totalprice double, o_orderstatus string, o_orderpriority string")
    d.write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.metric: r.value for r in QUERIES["validation_report_votes"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = {m: v for _, m, v in con.execute(ORACLES["validation_report_votes"]).fetchall()}
    assert got == pytest.approx(want, abs=1e-9) and {"maj@1024/mean", "maj@1500/std", "maj@130/mean", "maj@65/mean", "best@1024"} <= set(got)
