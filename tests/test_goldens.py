"""Literal expectations on tiny tables."""

import math

import pytest
from pyspark.sql import functions as F

from stepfold.functions import classify as C
from stepfold.functions import parse as P
from stepfold.functions import text as X
from stepfold.operators import advantage as A
from stepfold.operators import memory as M
from stepfold.operators import quality as Q
from stepfold.operators import report as R
from stepfold.operators import sample as S


def scored(spark, scores, uid="g"):
    return spark.createDataFrame([(uid, i, float(s)) for i, s in enumerate(scores)], "uid string, ord long, score double")


def adv(df, fn, **kw):
    return [r.adv for r in fn(df, **kw).orderBy("ord").collect()]


def one(spark, col):
    return spark.range(1).select(col.alias("c")).first().c


def test_returns(spark):
    df = spark.createDataFrame([("t", i + 1, float(i + 1)) for i in range(3)], "traj_uid string, step long, reward double")
    got = [r.returns for r in A.discounted_returns(df, 0.9).orderBy("step").collect()]
    assert got == pytest.approx([5.23, 4.7, 3.0])
    assert [r.returns for r in A.discounted_returns(df, 0.0).orderBy("step").collect()] == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("gamma", [1.0, 0.999, 0.9, 0.01])
def test_long_trajectory_crosses_blocks(spark, monkeypatch, gamma):
    from stepfold.plans import skew

    monkeypatch.setattr(skew, "RANGE_ROWS", 16)
    n = 200
    df = spark.range(1, n + 1).select(F.lit("t").alias("traj_uid"), F.col("id").alias("step"), (F.col("id") % 7).cast("double").alias("reward"))
    want, acc = {}, 0.0
    for i in range(n, 0, -1):
        acc = i % 7 + gamma * acc
        want[i] = acc
    got = {r.step: r.returns for r in A.discounted_returns(df, gamma).collect()}
    assert got == pytest.approx(want)


def test_table_overwritten_in_the_session(spark, hot, tmp_path):
    """Counts are never remembered: what grew past the limit is split, with right results."""
    from stepfold.plans.skew import rank

    for n in (3, 60):
        made = spark.range(1, n + 1).select(F.lit("t").alias("traj_uid"), F.col("id").alias("step"), F.lit(1.0).alias("reward"))
        made.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "t"))
        df = spark.read.parquet(str(tmp_path / "t"))
        got = {r.step: r.returns for r in A.discounted_returns(df, 1.0).collect()}
        assert got == {i: float(n + 1 - i) for i in range(1, n + 1)}
        assert sorted((r.step, r.rn) for r in rank(df, ["traj_uid"], [F.desc("step")]).collect()) == [(i, n + 1 - i) for i in range(1, n + 1)]


VALUES = [None, None, float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 7.5, -2.0, 1e9, None]


@pytest.mark.parametrize("order", ["asc", "desc", "desc_nulls_first"])
@pytest.mark.parametrize("keyed", [True, False])
def test_split_order_equals_plain_order(spark, order, keyed):
    """Nulls, NaN, ties, one skewed value: ranks and sums as in one window."""
    from stepfold.plans.skew import group_values, lookup, rank, running

    rows = [(i, "g" if i % 5 else None, VALUES[i % len(VALUES)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, grp string, v double")
    by = [getattr(F, order)("v") if order != "desc_nulls_first" else F.desc_nulls_first("v"), F.col("id")]
    keys = ["grp"] if keyed else []

    def all_of():
        r = {x.id: x.rn for x in rank(df, keys, by).collect()}
        s = {x.id: x.s for x in running(df, keys, by, s=F.col("id")).collect()}
        g = {x.id: (x.n, x.m) for x in group_values(df, ["grp"], n=F.count("v"), m=F.max("id")).collect()}
        dim = spark.createDataFrame([("g", 1), (None, 2)], "grp string, w int")
        j = sorted((x.id, x.w) for x in lookup(df, dim, ["grp"], "inner").collect())
        return r, s, g, j

    plain = all_of()
    spark.conf.set("stepfold.hotRows", "3")
    try:
        assert all_of() == plain
    finally:
        spark.conf.unset("stepfold.hotRows")


def test_recent_history_with_gaps(spark):
    from stepfold.operators.sample import recent_history

    df = spark.createDataFrame([("t", s, "o", "a") for s in range(0, 30, 2)] + [(None, 1, "o", "a")], "traj_uid string, step long, obs string, action string")
    plain = sorted(map(str, recent_history(df, 3).collect()))
    spark.conf.set("stepfold.hotRows", "3")
    try:
        assert sorted(map(str, recent_history(df, 3).collect())) == plain
    finally:
        spark.conf.unset("stepfold.hotRows")
    assert len(plain) == 16


def test_pairwise_accuracy_on_real_labels(spark):
    import random

    rng = random.Random(1)
    rows = [("a", i, rng.choice([0.1, 0.5, rng.random()]), rng.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "uid string, row_id long, score double, label double")
    hit = total = 0.0
    for _, i, s, x in rows:
        for _, j, t, y in rows:
            if x < y:
                total += y - x
                hit += (y - x) * ((s, i) < (t, j))
    assert A.pairwise_accuracy(df).first().accuracy == pytest.approx(hit / total)


def test_resample_one_heavy_row(spark):
    """A slice over many blocks of cells is drawn as often as its weight says, nothing is lost."""
    n = 9000
    df = spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") == 4000, 1000.0).otherwise(1.0).alias("score"))
    got = A.resample(df, 3).groupBy("row_id").count().collect()
    assert sum(r["count"] for r in got) == n
    assert max(r["count"] for r in got) > 0.98 * n


def test_streams_read_folders(spark, tmp_path):
    from stepfold.streaming.streams import drain, read_table_stream
    from tests.oracle import DATA

    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    got = drain(read_table_stream(spark, str(tmp_path), "events").select("event_id"))
    assert got.count() == events.count() > 0


def test_date_window_reaches_the_scan(spark):
    import datetime as dt

    from stepfold.operators.records import filter_date_window
    from tests.oracle import DATA

    o = spark.read.parquet(f"{DATA}/sf0.001/orders.parquet")
    d = filter_date_window(o, "o_orderdate", dt.datetime(1996, 1, 1), dt.datetime(1997, 1, 1))
    pushed = [line for line in d._jdf.queryExecution().toString().split("\n") if "PushedFilters" in line]
    assert any("GreaterThanOrEqual(o_orderdate" in line for line in pushed)


def test_gae_without_lambda(spark):
    df = spark.createDataFrame([("t", 1, 1.0, 0.5, 1), ("t", 2, 2.0, 0.25, 1)], "row_id string, pos long, reward double, value double, mask int")
    got = [r.raw_adv for r in A.gae(df, 0.5, 0.0).orderBy("pos").collect()]
    assert got == pytest.approx([1 + 0.5 * 0.25 - 0.5, 2 - 0.25])


def test_group_advantages(spark):
    g = scored(spark, [1, 0, 0, 1])
    x = 0.5 / (math.sqrt(1 / 3) + 1e-6)
    assert adv(g, A.normalized_advantage) == pytest.approx([x, -x, -x, x])
    assert adv(g, A.population_advantage) == pytest.approx([1, -1, -1, 1])
    assert adv(g, A.rloo_advantage) == pytest.approx([2 / 3, -2 / 3, -2 / 3, 2 / 3])
    one_row = scored(spark, [1])
    assert adv(one_row, A.normalized_advantage) == pytest.approx([1 / (1 + 1e-6)])
    assert adv(one_row, A.normalized_advantage, own_mean=True) == [0.0]
    assert adv(one_row, A.population_advantage) == [0.0]
    assert adv(one_row, A.rloo_advantage) == [1.0]
    assert adv(scored(spark, [2, 2]), A.population_advantage) == [0.0, 0.0]
    assert adv(scored(spark, [1, 0.5, 0]), A.passk_advantage, std=False) == [0.5, 0, 0]
    assert adv(scored(spark, [1, 1, 0]), A.passk_advantage, std=False) == [0, 0, 0]
    assert adv(one_row, A.passk_advantage) == [0.0]
    with pytest.raises(ValueError):
        A.advantage(g, estimator="none")


def test_group_advantages_of_split_groups(spark, hot):
    g = scored(spark, [1, 0, 0, 1, 1, 0, 0, 1, 3]).unionByName(scored(spark, [5, 7], "h"))
    want = {}
    for uid, vals in (("g", [1, 0, 0, 1, 1, 0, 0, 1, 3]), ("h", [5, 7])):
        m = sum(vals) / len(vals)
        sd = math.sqrt(sum((v - m) ** 2 for v in vals) / (len(vals) - 1))
        want |= {(uid, i): (v - m) / (sd + 1e-6) for i, v in enumerate(vals)}
    got = {(r.uid, r.ord): r.adv for r in A.normalized_advantage(g).collect()}
    assert got == pytest.approx(want)


def test_reports(spark):
    r = spark.createDataFrame([("s", i + 1, float(v)) for i, v in enumerate([0, 1, 0])], "sample_id string, rollout_idx int, accuracy_score double")
    p = R.pass_at_k(r, [1, 2, 3]).first()
    assert (p["pass@1"], p["pass@2"], p["average@2"]) == (0, 1, 0.5) and p["average@3"] == pytest.approx(1 / 3)
    v = spark.range(1, 21).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    q = R.quantiles(v, ["k"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (q.p50, q.p95) == (10, 19)
    assert R.quantiles(v.where("v <= 4"), ["k"], "v", {"p50": 0.5}, interpolate=True).first().p50 == 2.5
    m = spark.createDataFrame([("loss", 1.0), ("loss", 2.0), ("loss", 3.0), ("accuracy", 0.0), ("accuracy", 0.5), ("accuracy", 1.0), ("x/max", 5.0)], "name string, value double")
    assert {r.name: r.reduced for r in R.reduce_metrics(m).collect()} == {"loss": 2.0, "accuracy": 0.5, "x/max": 5.0}
    b = R.best_worst_at_n(v.where("v <= 5"), ["k"], "v", [3]).first()
    assert b.best_mean == pytest.approx(4.2) and b.worst_mean == pytest.approx(1.8)
    votes = spark.createDataFrame([("k", 0, "A", 0.9), ("k", 1, "B", 0.8), ("k", 2, "B", 0.8), ("k", 3, "A", 0.7)], "k string, ord int, pred string, val double")
    assert R.majority_value(votes, ["k"]).first().majority == 0.9
    one_vote = R.majority_at_n(votes.where("pred = 'B'"), ["k"], 3, rounds=8).first()
    assert (one_vote.maj_mean, one_vote.maj_std) == pytest.approx((0.8, 0))
    val = spark.createDataFrame([("source1", "prompt1", 0.8), ("source1", "prompt1", 0.9)], "data_source string, prompt string, score double")
    assert {r.metric: r.value for r in R.validation_report(val).collect()}["mean@2"] == pytest.approx(0.85)
    t = spark.createDataFrame([("gen", 0.5), ("ref", 0.3), ("values", 0.2)], "name string, seconds double")
    tok = spark.createDataFrame([(6, 6)], "prompt_tokens long, response_tokens long")
    assert {r.name: r.ms_per_token for r in R.timing_metrics(t, tok).collect()} == pytest.approx({"gen": 500 / 6, "ref": 300 / 12, "values": 200 / 12})
    arr = spark.createDataFrame([("s", [1.0, 0.0]), ("s", [1.0])], "data_source string, scores array<double>")
    assert R.offline_eval(arr, scores="scores").first().test_score == 0.75
    n = spark.createDataFrame([(100,), (200,), (300,)], "total_tokens long")
    assert R.throughput(n, 2.0, 1).first().tokens_per_gpu_second == 300
    assert R.throughput(n, 2.0, 2).first().tokens_per_gpu_second == 150


def letters(spark, text):
    return spark.createDataFrame([(i, c) for i, c in enumerate(text)], "ord long, c string")


def order(df, by="position"):
    return "".join(r.c for r in df.orderBy(by).collect())


def test_row_algebra(spark):
    abc = letters(spark, "abc")
    assert order(S.repeat_rows(abc, 2, order="ord")) == "aabbcc"
    assert order(S.repeat_rows(abc, 2, order="ord", interleave=False)) == "abcabc"
    assert order(S.repeat_by(abc.withColumn("n", F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (F.col("ord") + 1).cast("int"))), "n", order="ord")) == "aaabcc"
    assert order(S.pad_to_divisor(abc, 2, order="ord")) == "abca"
    assert order(S.pad_to_divisor(abc, 7, order="ord")) == "abcabca"
    assert S.pad_to_divisor(abc, 3, order="ord").where("padded").isEmpty()
    assert order(S.unpad(S.pad_to_divisor(abc, 7, order="ord"))) == "abc"
    f = S.fold(letters(spark, "aabbcc"), 2, order="ord")
    turned = f.withColumn("fold", (F.col("fold") + 2) % 3)
    assert order(S.unfold(turned, ["c"]).withColumn("position", F.col("fold") * 2 + F.col("part"))) == "bbccaa"
    arr = spark.createDataFrame([([1, 2, 3, 4], "a")], "obs array<int>, l string")
    assert [(r.obs, r.l) for r in S.unfold_column_chunks(arr, 2, ["obs"]).orderBy("part").collect()] == [([1, 2], "a"), ([3, 4], "a")]
    with pytest.raises(Exception, match="not divisible"):
        S.chunk_rows(abc, 2, order="ord").collect()
    assert S.adjust_to_divisor(abc, 2, "delete", key="ord").count() == 2
    assert S.adjust_to_divisor(abc, 2, "copy", key="ord").count() == 4


def test_sampling(spark):
    ten = spark.range(10).select(F.col("id").cast("string").alias("doc_id"), F.lit("x").alias("k"))
    assert S.stratified_split(ten, ["k"], ratio=0.25).where("split = 'test'").count() == 2
    sizes = spark.range(104).select(F.when(F.col("id") < 4, "a").otherwise("b").alias("benchmark_name"), F.col("id").cast("string").alias("doc_id"))
    got = {r.benchmark_name: (r.expanded_count, r.sampling_probability) for r in S.sqrt_sizes(sizes).collect()}
    assert got["a"] == (20, pytest.approx(1 / 6)) and got["b"] == (100, pytest.approx(5 / 6))
    assert S.expand_sqrt(sizes).groupBy("benchmark_name").count().where("benchmark_name = 'a'").first()["count"] == 20
    f = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.2), ("b", 2, 0.0), ("c", 3, 0.9)], "category string, ord int, reward double")
    assert [(r.category, r.reward) for r in S.round_robin_failures(f, k=3).collect()] == [("a", 0.1), ("b", 0.0), ("a", 0.2)]
    g = spark.createDataFrame([("p", 1), ("p", 1), ("q", 0), ("q", 1), ("r", 1)], "uid string, reward int")
    assert {r.uid for r in S.drop_uniform_groups(g).collect()} == {"q"}
    assert {r.uid for r in S.drop_uniform_groups(g, keep_singletons=True).collect()} == {"q", "r"}


def test_text(spark):
    lit = lambda s: F.lit(s)
    assert one(spark, X.normalize_answer_qa(lit("The  Eiffel-Tower!"))) == "eiffeltower"
    assert one(spark, X.gsm8k_answer(lit("so #### 1,234"))) == "1234"
    many = "<answer>" * 11 + "x</answer>"
    assert one(spark, X.score_qa(lit("<answer>a</answer>" * 11), F.array(lit("a")))) == 0.25
    assert one(spark, X.score_qa(lit("no tag"), F.array(lit("a")))) == 0.0 and many
    r = one(spark, P.project_search_action(lit("<search>a</search><answer>b</answer>")))
    assert (r.action, r.valid) == ("<search>a</search>", False)
    r = one(spark, P.project_tagged_action(lit("<think>t</think><Action> GO </action>"), "household"))
    assert (r.action, r.valid) == ("go", True)
    r = one(spark, P.project_tagged_action(lit("x" * 200 + "Y"), "code"))
    assert (len(r.action), r.action[-1], r.valid) == (100, "Y", False)
    assert one(spark, C.classify_tool_error(lit("HTTP 403"))) == "http_403"
    assert one(spark, C.classify_tool_error(lit("tool x not found"))) == "http_404"
    assert one(spark, C.parse_price(lit("$1,200.50 to $3"))) == [1200.5, 3.0]
    assert one(spark, C.parse_price(lit("none"))) == [100.0]
    assert one(spark, C.classify_failure(lit(""), lit("error: image not found"), lit(""), lit(""))) == "image_missing"
    assert one(spark, X.concrete_answer(lit("Error: x"))).reason == X.ERROR_REASON


def test_passages_and_calls(spark):
    assert one(spark, P.format_passages(F.array(F.lit("T\nbody"), F.lit("U\nmore")))) == "Doc 1 (Title: T)\nbody\n\nDoc 2 (Title: U)\nmore"
    d = spark.createDataFrame([("{'name': 'visit', 'args': {'u': '1'}}",)], "p string").select(F.concat(F.lit("<tool_call>"), "p", F.lit("</tool_call>")).alias("text"))
    r = P.extract_tool_calls(d).first()
    assert (r.type, r.name, r.arguments) == ("tool_call", "visit", {"u": "1"})


def bank(spark, rows):
    return spark.createDataFrame(rows, "kind string, category string, ord long, skill_id string, title string, principle string, when_to_apply string, description string, how_to_avoid string")


def test_skill_bank(spark):
    rows = [("general", None, i, f"dyn_{i:03d}" if i < 3 else f"gen_{i:03d}", "t", "p", "", None, None) for i in range(8)]
    b = bank(spark, rows)
    s = spark.createDataFrame([("x", "none")], "problem string, task_type string")
    ids = lambda k: [g.skill_id for g in M.retrieve_template(s, b, k).first().general]
    assert ids(4) == ["dyn_000", "dyn_001", "dyn_002", "gen_003"] and ids(2) == ["dyn_000", "dyn_001", "dyn_002"]
    b2 = bank(spark, [("general", None, i, x, "t", "p", "", None, None) for i, x in enumerate(["dyn_002", "dyn_010"])])
    new = spark.createDataFrame([("z", 0)], "skill_id string, ord int")
    assert M.next_dyn_ids(new, b2).first().skill_id == "dyn_011"
    empty = M.render_skills(M.retrieve_template(s, b.where("false"), 3)).first().skill_text
    assert empty == "No relevant skills found for this task."


def test_flags(spark):
    r = spark.createDataFrame([("a", "p1", "Error: x", 1.0), ("b", "p2", "Error: x", 0.0)], "sample_id string, path string, final_answer string, accuracy_score double")
    assert [x.sample_id for x in Q.flag_error_scored(r).collect()] == ["a"]


def test_column_union_conflict(spark):
    from stepfold.operators.joins import merge_columns

    nan = float("nan")
    a = spark.createDataFrame([(1, nan, "nan")], "k int, x double, s string")
    assert merge_columns(a, a.withColumn("y", F.lit(1)), ["k"]).count() == 1
    with pytest.raises(Exception, match="one of the two tables only"):
        merge_columns(a, a.withColumn("k", F.col("k") + 1).unionByName(a), ["k"]).collect()
    with pytest.raises(TypeError, match="key k is int"):
        merge_columns(a, a.withColumn("k", F.concat("k", F.lit("x"))), ["k"])
    with pytest.raises(Exception, match="differs"):
        merge_columns(a, a.withColumn("x", F.lit(2.0)), ["k"]).collect()


def test_transcript_cuts_are_optional(spark):
    from stepfold.functions import parse as P

    long = "x" * 5000
    d = spark.createDataFrame([(1, f"<|im_start|>user\n{long}<|im_end|>\n<|im_start|>assistant\n{long}<|im_end|>", long)], "id long, prompt string, output string")
    sizes = lambda **kw: [(len(r.observation), len(r.action)) for r in P.steps_from_transcripts(d, **kw).orderBy("step").collect()]
    assert sizes() == [(5000, 5000), (0, 5000)] and sizes(cuts=P.PROMPT_CUTS) == [(800, 1500), (0, 2000)]
    task = spark.createDataFrame([(f"Task: {long}",), ("\nUser: " + long,), (long,)], "t string")
    length = lambda cut: [len(r.x) for r in task.select(P.task_description(F.col("t"), cut).alias("x")).collect()]
    assert length(None) == [5000, 5000, 5000] and length(1000) == [1000, 1000, 1000]


def test_goal_combinations_in_slices(spark, monkeypatch):
    from itertools import product

    from stepfold.operators import catalog

    monkeypatch.setattr(catalog, "COMBINATIONS", 3)
    options = {"size": ["s", "m", "l"], "color": ["red", "blue"], "fit": ["wide", "slim", "any", "x"]}
    d = spark.createDataFrame([("a1", options, "buy it", 10.0, ["soft"]), ("a2", {}, "buy", 10.0, ["soft"]), ("a3", {"size": []}, "no", 1.0, ["soft"])],
                              "asin string, options map<string,array<string>>, instruction string, price double, attributes array<string>")
    got = [tuple(r.goal_options) for r in catalog.synthesize_goals(d).where("asin = 'a1'").collect()]
    want = [tuple(f"{k}: {v}" for k, v in zip(sorted(options), c)) for c in product(*(options[k] for k in sorted(options)))]
    assert sorted(got) == sorted(want)
    assert {r.asin for r in catalog.synthesize_goals(d).collect()} == {"a1", "a2"}


def test_goal_weights_are_not_broadcast(spark):
    from stepfold.operators import catalog

    d = spark.createDataFrame(
        [("a1", {"size": ["s", "m"]}, "x", 10.0, ["soft", "red"]), ("a2", {}, "x", 10.0, ["soft", "soft"]), ("a3", {}, "x", 1.0, []), ("a4", {"size": ["s"]}, "x", 1.0, [None, "red"])],
        "asin string, options map<string,array<string>>, instruction string, price double, attributes array<string>")
    out = catalog.synthesize_goals(d)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.goal_id, round(r.weight, 9)) for r in out.collect())
    assert got == [("a1|size: m", round((1 / 4 + 1 / 3) / 2, 9)), ("a1|size: s", round((1 / 4 + 1 / 3) / 2, 9)), ("a2|", 0.25), ("a4|size: s", round(1 / 3, 9))]
