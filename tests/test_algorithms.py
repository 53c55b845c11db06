"""Iterative and hash-driven operators against brute force on small tables."""

from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfold.operators import advantage as A
from stepfold.operators import memory as M
from stepfold.operators import sample as S
from stepfold.operators.cluster import similar_step_groups
from stepfold.operators.similarity import similar_pairs, similarity_topk
from stepfold.plans.iterate import components, greedy_matching


def vectors(spark, n, dim=6, seed=0):
    v = np.random.default_rng(seed).normal(size=(n, dim)).astype("float32")
    v[n // 2] = v[1]
    rows = [(i, v[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<float>"), v.astype("float64")


def cosines(v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return u @ u.T


def test_topk_over_many_blocks(spark, monkeypatch):
    from stepfold.operators import similarity

    monkeypatch.setattr(similarity, "Q_BLOCK", 7)
    monkeypatch.setattr(similarity, "I_BLOCK", 5)
    df, v = vectors(spark, 40)
    c = np.round(cosines(v), similarity.DIGITS)
    got = {(r.query_id, r.rn): r.item_id for r in similarity_topk(df, df, 4, min_sim=0.0, exclude_self=True).collect()}
    want = {}
    for i in range(40):
        best = sorted((-c[i, j], j) for j in range(40) if j != i and c[i, j] >= 0)[:4]
        want |= {(i, n + 1): j for n, (_, j) in enumerate(best)}
    assert got == want
    pairs = {(r.a, r.b) for r in similar_pairs(df, 0.5).collect()}
    rep = {i: (1 if i == 20 else i) for i in range(40)}
    assert pairs == {(i, j) for i in range(40) for j in range(i + 1, 40) if (c[i, j] >= 0.5 and rep[i] == i and rep[j] == j) or (i, j) == (1, 20)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 40), (40, 45), (60, 61)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 45: 40, 50: 40, 60: 60, 61: 60}


def greedy(pairs):
    used, out = set(), []
    for s, a, b in sorted((-s, a, b) for a, b, s in pairs):
        if a not in used and b not in used:
            used |= {a, b}
            out.append((a, b))
    return out


def test_greedy_matching(spark):
    df, v = vectors(spark, 30, 3)
    c = cosines(v)
    pairs = [(i, j, float(c[i, j])) for i in range(30) for j in range(i + 1, 30) if c[i, j] >= 0.2]
    got = {(r.a, r.b) for r in greedy_matching(spark.createDataFrame(pairs, "a long, b long, sim double")).collect()}
    assert got == set(greedy(pairs))


def test_reduce_to_limit(spark):
    df, _ = vectors(spark, 24, 3)
    lib = df.select(F.col("id").alias("exp_no"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), "embedding")
    out = M.reduce_to_limit(lib, 15, 0.3, rounds=5).collect()
    assert len(out) >= 15 and len({r.exp_no for r in out}) == len(out)
    assert sorted(p for r in out for p in r.text.split("\n\n")) == sorted(f"t{i}" for i in range(24))
    assert M.reduce_to_limit(lib, 30).count() == 24


def test_reduce_to_limit_pairs_copies(spark):
    """Six equal items give three pairs in a round, not one."""
    one = lambda k: [1.0 if i == k else 0.0 for i in range(21)]
    rows = [(i, f"t{i}", one(20 if i < 6 else i - 6)) for i in range(26)]
    lib = spark.createDataFrame(rows, "exp_no long, text string, embedding array<float>")
    assert M.reduce_to_limit(lib, 4, rounds=1).count() == 23


def test_plan_merges(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    ops = spark.createDataFrame(
        [(10, "add", None, [1.0, 0.1]), (11, "modify", 2, [1.0, 0.0]), (12, "modify", 9, [-1.0, 0.0]), (13, "add", None, [1.0, 0.2])],
        "op_id long, option string, modified_from long, embedding array<float>")
    cand = {(r.op_id, r.action, r.item_id) for r in M.merge_candidates(e, ops).collect()}
    assert cand == {(10, "merge", 1), (11, "replace", 2), (12, "add", None), (13, "merge", 1)}
    assert {r.node: r.component for r in M.plan_merges(e, ops).collect()} == {n: "item:1" for n in ("item:1", "op:10", "op:13")}


@pytest.mark.parametrize("round_rows", [3, 500])
def test_similar_step_groups(spark, round_rows):
    words = ["go to desk 1", "go to desk 2", "take lamp", "take lamp 1", "open box", "go to desk 1", "take a lamp", "open boxes", "zzz"]
    rows = [(u, i, w) for u in ("g", "h") for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "uid string, ord long, anchor_obs string")
    want, reps = {}, []
    for i, w in enumerate(words):
        hit = next((n for n, r in reps if SequenceMatcher(None, w, r).ratio() >= 0.8), None)
        if hit is None:
            reps.append((i, w))
            hit = i
        want[i] = hit
    got = {(r.uid, r.ord): r.step_group for r in similar_step_groups(df, 0.8, round_rows=round_rows).collect()}
    assert got == {(u, i): n for u in ("g", "h") for i, n in want.items()}
    with pytest.raises(ValueError):
        similar_step_groups(df, 1.0)


def test_balanced_blocks_not_worse_than_dealing(spark):
    n = np.random.default_rng(3).integers(1, 300, size=200).tolist()
    df = spark.createDataFrame(list(enumerate(n)), "id long, length long")
    def spread(d):
        s = [r.s for r in d.groupBy("part").agg(F.sum("length").alias("s")).collect()]
        return max(s) - min(s)
    exact, dealt = S.balanced_blocks(df, 6), S.balanced_partitions(df, 6)
    assert exact.count() == dealt.count() == 200
    assert spread(exact) <= spread(dealt)
    mb = S.micro_batches(df, 3000)
    assert mb.select("micro_batch").distinct().count() == -(-sum(n) // 3000)
    assert {r.id for r in mb.collect()} == set(range(200))


def test_resample_follows_the_weights(spark):
    df = spark.createDataFrame([(i, 3.0 if i == 5 else 0.0 if i < 100 else 1.0) for i in range(400)], "row_id long, score double")
    d = A.resample(df, 1).collect()
    assert len(d) == 400 and len({r.draw for r in d}) == 400
    assert all(r.row_id == 5 or r.row_id >= 100 for r in d)
    again = {r.draw: r.row_id for r in A.resample(df.repartition(7), 1).collect()}
    assert again == {r.draw: r.row_id for r in d}


def test_splits_partition_the_table(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("doc_id"), (F.col("id") % 7).cast("string").alias("benchmark_name"))
    d = S.global_val_split(df)
    assert d.count() == 500 and d.where("split = 'global_val'").count() == 25


def test_stream_health_matches_batch(spark, tmp_path):
    from stepfold.streaming import streams as ST

    rows = [("a", 0, 500), ("a", 5, 200), ("a", 8, 500), ("a", 30, 500), ("b", 3, 200), ("a", 400, 200), ("b", 400, 200)]
    df = spark.createDataFrame([(e, i, c) for i, (e, _, c) in enumerate(rows)], "endpoint string, event_id long, status_code int")
    secs = {i: t for i, (_, t, _) in enumerate(rows)}
    ts = F.create_map(*[x for k, v in secs.items() for x in (F.lit(k), F.lit(v))])
    df = df.withColumns({"timestamp": F.timestamp_seconds(ts[F.col("event_id").cast("int")] + 1000), "error_type": F.lit(None).cast("string")})
    batch = {r.event_id: r.unhealthy for r in ST.endpoint_health(df, 10.0).collect()}
    assert batch == {0: False, 1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = sorted((r.endpoint, r.at_ms - 1_000_000, r.healthy) for r in ST.drain(ST.stream_endpoint_health(stream, 10.0)).collect())
    assert got == [("a", 0, False), ("a", 18000, True), ("a", 30000, False), ("a", 40000, True)]


def test_stream_folds_continue_across_batches(spark, tmp_path):
    from stepfold.streaming import streams as ST

    log = spark.range(1, 41).select(F.lit("r").alias("run"), F.col("id").alias("step"), (F.col("id") % 5).cast("double").alias("kl"), F.lit(8).alias("n_steps"))
    for i in range(4):
        log.where(F.col("step").between(i * 10 + 1, i * 10 + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.step: r.value for r in ST.drain(ST.stream_kl_controller(stream, 0.2, 2.0, 1000.0)).collect()}
    want = {r.step: r.value for r in ST.kl_controller(log, 0.2, 2.0, 1000.0).collect()}
    assert got == pytest.approx(want)


def test_stream_flush_comes_once_also_after_a_restart(spark, tmp_path):
    """Five rows, batches of three: two are held, survive a stop, and come as the final batch."""
    import time

    from stepfold.streaming import streams as ST

    def feed(lo, hi):
        spark.range(lo, hi).select(F.lit("q").alias("queue"), F.col("id").alias("event_id")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def start():
        source = spark.readStream.schema("queue string, event_id long").parquet(str(tmp_path / "in"))
        d = ST.stream_fill_flush(source, 3, 6.0)
        return d.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out/data")).option("checkpointLocation", str(tmp_path / "out/state")).start()

    def written():
        d = spark.read.schema("queue string, event_id long, batch long, final boolean").parquet(str(tmp_path / "out/data"))
        return {(b, f): sorted(r.event_id for r in rows) for (b, f), rows in groups(d).items()}

    def groups(d):
        out = {}
        for r in d.collect():
            out.setdefault((r.batch, r.final), []).append(r)
        return out

    def wait_for(n):
        end = time.time() + 60
        while len(written()) < n and time.time() < end:
            time.sleep(0.5)

    feed(0, 5)
    q = start()
    wait_for(1)
    first = written()
    q.stop()
    assert list(first) == [(0, False)] and len(first[0, False]) == 3
    q = start()  # nothing new: the timer of the first run is due
    wait_for(2)
    time.sleep(8)  # no second flush
    both = written()
    assert set(both) == {(0, False), (1, True)} and sorted(both[0, False] + both[1, True]) == [0, 1, 2, 3, 4]
    feed(5, 8)
    wait_for(3)
    q.stop()
    assert written() == {**both, (2, False): [5, 6, 7]}


def test_deep_pages(spark):
    """Any page equals the sorted table's, and only a small part of the table is sorted."""
    rows = [((i * 7919) % 1000 if i % 50 else None, f"n{i % 13}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b string, c long").repartition(5)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    for page, size in ((1, 10), (150, 20), (7, 100), (300, 10), (301, 10), (31, 97), (1, 5000)):
        report = []
        got = [tuple(r) for r in S.paginate(df, page, size, order=["a", "b", "c"], rows=60, cuts=8, report=report).collect()]
        assert got == want[(page - 1) * size : page * size]
        assert report[0] <= max(60, 2 * size)
    same = spark.createDataFrame([(1, "x")] * 500 + [(2, "y")] * 500, "a long, b string")
    page = lambda n: [tuple(r) for r in S.paginate(same, n, 100, order=["a"], rows=50, cuts=4).collect()]
    assert page(2) == [(1, "x")] * 100 and page(6) == [(2, "y")] * 100 and page(11) == []
    assert [tuple(r) for r in S.paginate(same, 2, 450, order=["a"], rows=50, cuts=4).collect()] == [(1, "x")] * 50 + [(2, "y")] * 400
    assert S.paginate(df.limit(0), 1, 5, order=["a"]).collect() == []


def endless(s, truth):
    import os
    import time

    if s == "loop":
        while True:
            pass
    if s == "sleep":
        time.sleep(100)
    if s == "die":
        os._exit(3)
    return len(s) / int(truth)


def test_scorer_with_a_deadline(spark):
    import psutil

    from stepfold.functions import udf as U

    call = U.Deadline(endless, 0.5)
    assert call("ab", 2) == (1.0, None)
    child = call.child.pid
    assert call("loop", 1) == (0.0, "TimeoutError: over 0.5 s") and not psutil.pid_exists(child)
    assert call("ab", 0)[1].startswith("ZeroDivisionError") and call("abcd", 2) == (2.0, None)
    child = call.child.pid
    call.close()
    assert not psutil.pid_exists(child)
    texts = ["a", "loop", "bb", "die", "ccc", "sleep", "dddd", None]
    df = spark.createDataFrame([(i, t, "1") for i, t in enumerate(texts)], "i long, t string, g string").coalesce(1)
    score = U.safe_score(endless, timeout=1.0)
    got = {r.i: (r.s.score, (r.s.error or "").split(":")[0]) for r in df.select("i", score("t", "g").alias("s")).collect()}
    assert got == {0: (1.0, ""), 1: (0.0, "TimeoutError"), 2: (2.0, ""), 3: (0.0, "ChildProcessError"), 4: (3.0, ""), 5: (0.0, "TimeoutError"), 6: (4.0, ""), 7: (0.0, "TypeError")}
    me = [p for p in psutil.process_iter(["cmdline", "ppid"]) if "pyspark.daemon" in " ".join(p.info["cmdline"] or [])]
    assert all(c.status() == psutil.STATUS_ZOMBIE or not c.children() for p in me for c in p.children())


def test_failure_runs_by_pieces():
    from stepfold.streaming.streams import failure_runs

    rng = np.random.default_rng(1)
    for _ in range(200):
        t = rng.integers(0, 300, rng.integers(0, 40))
        runs = np.zeros((0, 2), np.int64)
        for part in np.array_split(t, 3):
            runs = failure_runs(runs, part, 7)
        want = []
        for x in sorted(t.tolist()):
            if want and x - want[-1][1] < 7:
                want[-1][1] = x
            else:
                want.append([x, x])
        assert runs.tolist() == want


def test_reduce_to_limit_joins_pairs_once(spark, monkeypatch):
    seen, real = [], M.greedy_matching
    monkeypatch.setattr(M, "greedy_matching", lambda best: seen.append(best._jdf.queryExecution().optimizedPlan().toString()) or real(best))
    rows = [(i, f"t{i}", [1.0, 0.0] if i < 5 else [0.0, 1.0 + i]) for i in range(8)]
    lib = spark.createDataFrame(rows, "exp_no long, text string, embedding array<float>")
    out = M.reduce_to_limit(lib, 1, 0.9, rounds=1).collect()
    assert len(seen) == 1 and seen[0].count("MapInArrow") == 1 and "LeftAnti" not in seen[0]
    assert sorted(r.text for r in out) == ["t0\n\nt1", "t2\n\nt3", "t4", "t5\n\nt6", "t7"]


def test_stream_folds_give_their_rows_in_pieces(spark, tmp_path):
    """More rows of a run and queue than are given at a time, out of order: as in the batch forms."""
    from stepfold.streaming import streams as ST

    n = ST.OUT_ROWS + 5000
    log = spark.range(n).select(F.lit("r").alias("run"), F.lit("q").alias("queue"), ((F.col("id") * 7919) % n).alias("step"), (F.col("id") % 5).cast("double").alias("kl"), F.lit(8).alias("n_steps"))
    log.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    got = {r.step: r.value for r in ST.drain(ST.stream_kl_controller(stream(), 0.2, 2.0, 1e6)).collect()}
    assert got == pytest.approx({r.step: r.value for r in ST.kl_controller(log, 0.2, 2.0, 1e6).collect()})
    rows = ST.drain(ST.stream_fill_batches(stream(), 32, order="step")).collect()
    assert sorted((r.step, r.batch, r.closes) for r in rows) == [(i, i // 32, i % 32 == 31) for i in range(n)]


def test_stream_flush_is_not_cut(spark, tmp_path):
    """Full batches of a part come together, and a stream that is not through by the deadline fails
    instead of giving what it has."""
    from stepfold.streaming import streams as ST

    class Held:
        def __init__(self):
            self.v = None

        exists = lambda self: self.v is not None
        get = lambda self: self.v

        def update(self, v):
            self.v = v

    buffer = ST.FillBuffer(3, 1000, "event_id")
    buffer.held, buffer.done = Held(), Held()
    buffer.handle = type("H", (), {"listTimers": lambda self: [], "registerTimer": lambda self, at: None})()
    buffer.held.put = buffer.held.update
    clock = type("C", (), {"getCurrentProcessingTimeInMs": lambda self: 0})()
    import pandas as pd

    parts = [pd.DataFrame({"event_id": range(0, 7)}), pd.DataFrame({"event_id": range(7, 11)})]
    out = list(buffer.handleInputRows(("q",), iter(parts), clock))
    assert len(out) == 2 and [(r.event_id, r.batch) for d in out for r in d.itertuples()] == [(i, i // 3) for i in range(9)]
    assert buffer.held.v == [(9,), (10,)] and buffer.done.v == (3,)

    spark.range(5).select(F.lit("q").alias("queue"), F.col("id").alias("event_id")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("queue string, event_id long").parquet(str(tmp_path / "in"))
    with pytest.raises(TimeoutError):
        ST.run_until_idle(ST.stream_fill_flush(source, 3, 60.0), str(tmp_path / "out"), 60.0, most_sec=2.0)


def test_scores_round_as_in_sql(spark, tmp_path):
    """Prices whose hundred-thousandth looks like a tie in decimal and is none as a double."""
    import duckdb

    from stepfold.plans import views as V

    prices = [14500.0, 28500.0, 57500.0, 100500.0, 101500.0, 150000.0, 200499.99, 1001.91]
    rows = [(i, i, p, "F", "1-URGENT") for i, p in enumerate(prices)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderpriority string").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.row_id: r.score for r in V.responses(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == dict(con.execute(f"WITH {V.RESPONSES_SQL} SELECT row_id, score FROM responses").fetchall())


def test_first_pages_need_no_directory(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("a"))
    report = []
    page = S.paginate(df, 3, 25, order=["a"], rows=1000, cuts=8, report=report)
    assert [r.a for r in page.collect()] == list(range(50, 75)) and report == [75]
    assert "TakeOrderedAndProject" in page._jdf.queryExecution().executedPlan().toString()


def test_gigpo_reads_its_steps_once(spark, monkeypatch):
    from stepfold.operators import advantage
    from stepfold.plans import skew

    asked = []
    count = skew.exceeds
    monkeypatch.setattr(skew, "exceeds", lambda df, keys, rows: asked.append(list(keys)) or count(df, keys, rows))
    rows = [(1, t, s, float(s % 3), "ab"[s % 2]) for t, n in ((1, 7000), (2, 3)) for s in range(1, n + 1)]
    steps = spark.createDataFrame(rows, "uid long, traj_uid long, step long, reward double, anchor_obs string")
    returns = advantage.discounted_returns(steps, 0.9)
    got = {(r["traj_uid"], r["step"]): r["returns"] for r in returns.collect()}
    ahead = 0.0
    for s in range(7000, 0, -1):  # more than two blocks
        ahead = s % 3 + 0.9 * ahead
        assert abs(got[1, s] - ahead) < 1e-9
    out = advantage.gigpo_advantage(returns, score="reward")
    assert asked == [["traj_uid"], ["uid"]]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_used_pairs_are_not_held_in_a_table(spark):
    from stepfold.suite import QUERIES
    from tests.oracle import DATA

    plan = QUERIES["used_experiences"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # the samples that have a rewrite


def test_candidates_are_searched_once_and_unnamed_items_are_not_looked_up(spark, monkeypatch):
    from stepfold.operators import similarity as X

    e = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "id long, embedding array<float>")
    rows = [(i, "add" if i % 3 else None, None if i % 2 else i, [float(i % 5), -1.0 if i % 4 == 0 else 1.0]) for i in range(30)]
    ops = spark.createDataFrame(rows, "op_id long, option string, modified_from long, embedding array<float>")
    monkeypatch.setattr(X, "QUERY_BYTES", -1)
    plan = M.merge_candidates(e, ops, 0.9)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r.op_id for r in plan.collect()} == set(range(30))  # also those without an option


@pytest.mark.parametrize("broadcast, range_rows", [("-1", 65_536), ("10485760", 65_536), ("10485760", 1)])
def test_library_upsert(spark, tmp_path, monkeypatch, broadcast, range_rows):
    from stepfold.streaming import streams as ST

    monkeypatch.setattr(ST, "RANGE_ROWS", range_rows)
    path = str(tmp_path / "library")
    lib = [(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0]), (5, "c", [-1.0, 0.0])]
    spark.createDataFrame(lib, "exp_no long, text string, embedding array<float>").write.parquet(f"{path}/version=0")
    ops = [(10, "add", None, "p", [1.0, 0.1]), (11, "modify", 2, "q", [0.0, 2.0]), (12, None, 5, "r", [0.0, -1.0]), (12, "add", None, "s", [0.0, -2.0]),
           (13, "modify", 99, "t", [1.0, -0.1]), (None, "add", None, "u", [1.0, 1.0])]
    ops = spark.createDataFrame(ops, "op_id long, option string, modified_from long, text string, embedding array<float>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        for _ in range(2):  # a replay writes the same version
            ST.experience_upserter(path, 0.9)(ops, 0)
            got = [(r.exp_no, r.text) for r in spark.read.parquet(f"{path}/version=1").orderBy("exp_no").collect()]
            assert got == [(2, "q"), (5, "c"), (6, "a\n\np"), (7, "r"), (8, "s"), (9, "t")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_library_upsert_takes_all_files_as_one_batch(spark, con, tmp_path):
    """A batch per 64 files would find what an earlier one added, and write the library each time."""
    import duckdb

    from stepfold.suite import ORACLES, QUERIES
    from tests.oracle import DATA

    d = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").where("vec_id % 5 = 0")
    d.repartition(70).write.parquet(str(tmp_path / "embeddings.parquet"))
    own = duckdb.connect()
    own.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = set(own.execute(ORACLES["stream_experience_upsert"]).fetchall())
    got = {(r.exp_no, r.text) for r in QUERIES["stream_experience_upsert"](spark, str(tmp_path)).collect()}
    assert got == want


def reduced_by_hand(items, limit, threshold, rounds):
    for _ in range(rounds):
        over = len(items) - limit
        if over <= 0:
            break
        piles = {}
        for no, _, e in sorted(items, key=lambda x: x[0]):
            piles.setdefault(e.tobytes(), []).append((no, e.astype("float64")))
        pairs = {(p[0][0], no, 1.0) for p in piles.values() if p[0][1].any() for no, _ in p[1:]}
        pairs |= {(p[i][0], p[i + 1][0], 1.0) for p in piles.values() if p[0][1].any() for i in range(0, len(p) - 1, 2)}
        heads = [p[0] for p in piles.values()]
        with np.errstate(invalid="ignore"):
            sims = np.nan_to_num(cosines(np.array([e for _, e in heads])))
        for i in range(len(heads)):
            for j in range(i):
                if sims[i, j] >= threshold:
                    pairs.add((*sorted((heads[i][0], heads[j][0])), float(sims[i, j])))
        taken, by = greedy(sorted(pairs, key=lambda p: (-p[2], p[0], p[1]))[:over]), {no: (t, e) for no, t, e in items}
        top, gone = max(by), {x for p in taken for x in p}
        items = [x for x in items if x[0] not in gone]
        for n, (a, b) in enumerate(taken):
            items.append((top + n + 1, by[a][0] + "\n\n" + by[b][0], ((by[a][1] + by[b][1]) / np.float32(2)).astype("float32")))
    return sorted((no, t) for no, t, _ in items)


@pytest.mark.parametrize("spare", [1, 16])
def test_reduce_to_limit_searches_down_to_a_cut(spark, monkeypatch, spare):
    """In rounds over part of the pairs, and by ranges of them: as by hand, and far from all pairs are given."""
    from stepfold.operators import similarity as S

    rng = np.random.default_rng(11)
    v = np.concatenate([rng.normal(size=(150, 6)), rng.normal(size=(1, 6)) + 0.05 * rng.normal(size=(30, 6)), np.zeros((3, 6))]).astype("float32")
    v = np.concatenate([v, v[:20], v[:6], v[:6], v[:1]])
    lib = spark.createDataFrame([(i, f"t{i}", x.tolist()) for i, x in enumerate(v)], "exp_no long, text string, embedding array<float>")
    seen, cuts, real, pairs = [], [], M.closest_pairs, S._pairs
    monkeypatch.setattr(M, "closest_pairs", lambda *a: seen.append(real(*a, few=0)) or seen[-1])
    monkeypatch.setattr(S, "_pairs", lambda d, t, *a, **kw: cuts.append((t, len(a))) or pairs(d, t, *a, block=32, **kw))
    for name in ("SPARE", "PROBES"):
        monkeypatch.setattr(S, name, {"SPARE": spare, "PROBES": 400}[name])
    monkeypatch.setattr(M, "RANGE_ROWS", 40)
    spark.conf.set("stepfold.hotRows", "100")
    monkeypatch.setattr(M, "greedy_matching", lambda d: greedy_matching(d, 20))
    try:
        got = M.reduce_to_limit(lib, 60, -0.5, rounds=4).collect()
    finally:
        spark.conf.unset("stepfold.hotRows")
    assert sorted((r.exp_no, r.text) for r in got) == reduced_by_hand([(i, f"t{i}", x) for i, x in enumerate(v)], 60, -0.5, 4)
    assert seen[0].cut > -0.5
    if spare == 16:
        assert (seen[0].cut, 1) in cuts  # the second round met the new items only
    else:
        assert seen[0].pairs.count() < 1000  # of 15,000 over the threshold


def test_greedy_matching_ends_in_one_task(spark):
    rng = np.random.default_rng(5)
    pairs = list({(int(a), int(b)): (int(a), int(b), round(float(s), 1)) for a, b, s in zip(rng.integers(0, 20, 90), rng.integers(20, 40, 90), rng.random(90))}.values())
    d = spark.createDataFrame(pairs, "a long, b long, sim double").repartition(4)
    for few in (0, 7, 1000):
        assert {(r.a, r.b) for r in greedy_matching(d, few).collect()} == set(greedy(pairs))
