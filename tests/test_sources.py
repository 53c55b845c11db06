"""File formats read and written."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stepfold.sources import files as S


def dump(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_read_records(spark, tmp_path):
    a = dump(tmp_path / "My-Bench" / "a.json", "﻿" + json.dumps([{"doc_id": "1", "problem": "p"}, 3, {"env_kwargs": {"doc_id": "2"}}]))
    b = dump(tmp_path / "b.json", {"samples": [{"extra_info": {"sample": {"doc_id": "3"}}, "doc_id": "x"}]})
    c = dump(tmp_path / "c.jsonl", '{"doc_id": "4", "benchmark_name": "own"}\n\nbad\n[1]\n{"doc_id": "5"}\n')
    got = {(r.doc_id, r.benchmark_name) for r in S.read_specs(spark, [a, f"bee={b}", f"cee={c}"]).collect()}
    assert got == {("1", "my_bench"), ("2", "my_bench"), ("3", "bee"), ("4", "own"), ("5", "cee")}
    with pytest.raises(ValueError):
        S.read_records(spark, ["x.csv"])


def test_read_trajectories_and_metrics(spark, tmp_path):
    root = tmp_path / "out"
    line = json.dumps
    dump(root / "s1" / "rollout_0" / "traj.jsonl", "\n".join([line({"doc_id": "s1"}), "", "{bad", line({"turn_idx": 0, "text_output": "hi"}),
         line({"tool_call": {"tool_name": "visit", "result": "r"}}), line({"tool_error": {"tool_name": "zoom", "error": "e"}})]))
    dump(root / "s1" / "rollout_1" / "traj.jsonl", line([{"turn_idx": 0, "text_output": "a"}, 5]))
    dump(root / "s2" / "traj.jsonl", line({"turn_idx": 0}))
    dump(root / "logs" / "rollout_0" / "traj.jsonl", line({"turn_idx": 0}))
    t = S.read_trajectories(spark, str(root)).cache()
    got = sorted((r.sample_id, r.rollout_id, r.line_no, r.tool_name) for r in t.collect())
    assert got == [("s1", "rollout_0", 1, None), ("s1", "rollout_0", 4, None), ("s1", "rollout_0", 5, "visit"), ("s1", "rollout_0", 6, "zoom"),
                   ("s1", "rollout_1", 1, None), ("s2", "s2", 1, None)]
    dump(root / "s1" / "rollout_0" / "metrics.json", {"accuracy_score": 1.0, "final_answer": "x"})
    dump(root / "s1" / "rollout_1" / "metrics.json", "[1]")
    m = {(r.sample_id, r.rollout_id): (r.accuracy_score, r.completed, r.error) for r in S.read_rollout_metrics(spark, str(root), t).collect()}
    assert m == {("s1", "rollout_0"): (1.0, True, ""), ("s1", "rollout_1"): (None, False, "metrics.json is not an object"), ("s2", "s2"): (None, False, "missing metrics.json")}


def test_skill_bank(spark, tmp_path):
    bank = {"general_skills": [{"title": "G", "principle": "p"}, {"skill_id": "dyn_001"}], "query_type_skills": {"Multi Hop!": [{"title": "T"}]},
            "common_mistakes": [{"description": "d"}], "metadata": {"x": 1}}
    rows = {r.skill_id: r for r in S.read_skill_bank(spark, dump(tmp_path / "bank.json", bank)).collect()}
    assert set(rows) == {"gen_001", "dyn_001", "multi_hop_001", "err_001"}
    assert rows["dyn_001"].title == "Dyn 001" and rows["gen_001"].when_to_apply == "" and rows["multi_hop_001"].category == "multi_hop"
    assert rows["err_001"].how_to_avoid == ""


def test_experiences_round_trip(spark, tmp_path):
    for i, doc in enumerate([{"experiences": {"E0": "a", "E12": "b"}}, {"E0": "a", "E12": "b"}]):
        d = S.read_experiences(spark, dump(tmp_path / f"lib{i}.json", doc))
        assert {(r.exp_id, r.exp_no, r.text) for r in d.collect()} == {("E0", 0, "a"), ("E12", 12, "b")}
    S.write_experiences(d, str(tmp_path / "out"))
    assert {r.exp_id for r in S.read_experiences(spark, str(tmp_path / "out")).collect()} == {"E0", "E12"}


def test_timing_aliases(spark, tmp_path):
    p = dump(tmp_path / "t.jsonl", '{"timestamp": "2024-01-01T00:00:01", "request_kind": "a", "latency": 2.5}\n{"kind": "b", "latency_sec": 1}\n')
    got = {(r.kind, r.endpoint, r.latency_sec) for r in S.read_api_timings(spark, p).collect()}
    assert got == {("a", "unknown", 2.5), ("b", "unknown", 1.0)}
    m = dump(tmp_path / "m.jsonl", '{"time": "t", "step": 3, "metrics": {"a/max": 1.5}}\n')
    assert S.read_metrics_log(spark, m).select(F.col("metrics")["a/max"].alias("v")).first().v == 1.5


def test_manifest(spark, tmp_path):
    df = spark.range(5).withColumn("k", F.col("id") % 2)
    for fmt in ("parquet", "jsonl"):
        m = S.write_dataset(df, str(tmp_path / fmt), fmt, ["k"], {"seed": 1})
        assert {(r.k, r.records) for r in m.collect()} == {(0, 3), (1, 2)}
        assert spark.read.json(str(tmp_path / fmt / "manifest")).count() == 2
    with pytest.raises(ValueError):
        S.write_dataset(df, str(tmp_path / "x"), "csv")


def test_logs_in_several_splits(spark, tmp_path):
    """A log cut into splits has the line numbers of the whole file, blank and bad lines included."""
    rng = random.Random(3)
    want = {}
    for f in range(3):
        lines = []
        for i in range(rng.randint(1, 120)):
            kind = rng.random()
            lines.append("" if kind < 0.2 else "{bad" if kind < 0.3 else json.dumps({"turn_idx": i, "text_output": "x" * rng.randint(0, 90)}) + ("\r" if kind < 0.5 else ""))
        dump(tmp_path / "out" / f"s{f}" / "rollout_0" / "traj.jsonl", "\ufeff" * (f == 1) + "\n".join(lines) + "\n" * (f % 2))
        want |= {(f"s{f}", n + 1): json.loads(x)["turn_idx"] for n, x in enumerate(lines) if x.startswith('{"')}
    dump(tmp_path / "out" / "s9" / "traj.jsonl", json.dumps([{"turn_idx": i} for i in range(50)], indent=1))
    want |= {("s9", i + 1): i for i in range(50)}
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        d = S.read_trajectories(spark, str(tmp_path / "out"))
        got = {(r.sample_id, r.line_no): r.turn_idx for r in d.collect()}
        blocks = spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "out")).select(F.col("_metadata.file_block_start").alias("b")).distinct().count()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert blocks > 5 and got == want


def test_typed_records_are_projected(spark, tmp_path):
    """Parquet: wrapped and plain rows, other types as text, and only the schema's columns read."""
    wrapped = "struct<doc_id:bigint,problem:string,images:array<string>,junk:string>"
    rows = [((1, "p", ["i"], "j"), "x", None, 5), (None, "y", ((2, "q", None, "j"),), 6), (None, "z", None, 7)]
    d = spark.createDataFrame(rows, f"env_kwargs {wrapped}, doc_id string, extra_info struct<sample:{wrapped}>, answer int")
    d.write.parquet(str(tmp_path / "t.parquet"))
    out = S.read_records(spark, [str(tmp_path / "t.parquet")])
    assert sorted(((r.doc_id, r.problem, r.images, r.answer) for r in out.collect()), key=str) == sorted([("1", "p", ["i"], None), ("2", "q", None, None), ("z", None, None, "7")], key=str)
    plan = out.select("problem")._jdf.queryExecution().executedPlan().toString()
    assert "junk" not in plan and "to_json" not in plan
    spark.createDataFrame([('{"doc_id": "4"}', "n")], "env_kwargs string, doc_id string").write.parquet(str(tmp_path / "s.parquet"))
    assert [r.doc_id for r in S.read_records(spark, [str(tmp_path / "s.parquet")]).collect()] in (["4"], ["n"])
