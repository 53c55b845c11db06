"""The pipeline's stages against brute-force twins, each on what the stage before kept."""

import re

import corpus_pipeline as P
from stepfold.llm import langid, simhash
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_substrings import brute
from tests.oracle import DATA

SF = f"{DATA}/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept, sizes = docs.columns, {}, {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert name == P.STAGES[-1][0] or out.columns == columns
        before = {r["doc_id"]: r for r in docs.collect()}
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        kept[name], sizes[name] = (before, after), len(after)

    before, after = kept["language_id"]
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    told = {r["doc_id"]: r["rejected"] for r in langid.predict(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()}
    assert set(after) == {d for d, no in told.items() if not no} and len(after) > 0.9 * len(before)

    before, after = kept["near_dedup"]
    prints = {d: brute_fingerprint(r["text"]) for d, r in before.items()}
    parts = brute_components(set(prints.values()), simhash.BITS)
    first = {}
    for d in sorted(before):
        first.setdefault(parts[prints[d]], d)
    assert set(after) == set(first.values()) and all(after[d] == before[d] for d in after)

    before, after = kept["substring_dedup"]
    want = {r[0]: r for r in brute([(d, r["text"]) for d, r in before.items()])}
    for d, r in before.items():
        n_bytes, n_removed = want[d][1:3]
        if n_removed == 0:
            assert after[d] == r
        elif d in after:
            assert n_bytes - n_removed - 6 * want[d][3] <= len(after[d]["text"].encode()) <= n_bytes - n_removed
            assert after[d]["n_chars"] == len(after[d]["text"])
        else:
            assert n_removed > 0
    assert len(after) > 0.8 * len(before)

    before, after = kept["decontamination"]
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    clean = set()
    for d, r in before.items():
        w = words(r["text"])
        if not any(tuple(w[i : i + n]) in grams for n in {len(g) for g in grams} for i in range(len(w) - n + 1)):
            clean.add(d)
    assert set(after) == clean and all(after[d] == before[d] for d in after)

    before, after = kept["mix"]
    assert set(after) == set(before)
    source, taken, target = {}, {}, {}
    for d, r in after.items():
        assert r["size"] == len([w for w in re.split(r"[\x20\x09-\x0D]+", before[d]["text"] or "") if w]) and r["taken"] <= 2 * r["size"]
        source[r["source"]] = max(source.get(r["source"], 0), r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= source[s] for s in source)


def test_near_dedup_tells_rows_apart_by_more_than_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i * i % 89}{x}" for i in range(60)) for x in ("red", "blue", "green", "white"))
    rows = [(5, a, 0), (3, a, 1), (5, b, 2), (None, c, 3), (None, d, 4), (None, d, 4), (7, b, 5), (None, a, 6)]
    out = P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, n int"), SF)
    got = sorted(out.collect(), key=lambda r: r["n"])
    assert [(r["doc_id"], r["text"], r["n"]) for r in got] == [(3, a, 1), (5, b, 2), (None, c, 3), (None, d, 4)]


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in names if re.match(r"op\d+_", q)}
    assert "pipeline" in names and 4 <= len(P.STAGES) <= 5
