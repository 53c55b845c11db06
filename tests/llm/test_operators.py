"""Edge cases, brute-force twins, round trips and held-out accuracy on small fixtures."""

import json
import random
import re
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfold.llm import chat, decontaminate, html, langid, lm, mixing, quality, toxicity
from tests.oracle import DATA

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("score", T.StringType()))])


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# chat


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<s>/[INST]\\ab\n"), st.text(alphabet="<s>[INST]\\u"))
def test_template_round_trip(text, role):
    def esc(s):
        return re.sub(chat.CONTROL, lambda m: f"{m[1]}\\{m[2]}{m[3]}", s)

    formatted = chat.BEGIN + esc(role) + chat.TEXT + esc(text) + chat.CLOSE + chat.END
    assert chat.read_back(formatted) == (role, text)
    assert formatted.count("[INST]") == 1


def test_json_records_never_stop_the_job(spark):
    part = [{"type": "text", "text": "look"}, {"type": "image_url", "image_url": {"url": "u"}}, {"type": "text", "text": "here"}]
    records = [
        {"id": 1, "messages": [{"role": "user", "content": 5}, {"role": "gpt", "content": None}]},
        {"conv_id": 2, "turn": "a", "role": "user", "text": "x"},
        {"id": 3, "messages": [{"role": "user", "content": "x"}, "bare"]},
        {"id": 4, "messages": []},
        {"id": 5, "messages": [{"role": "user", "content": part}, {"role": "assistant", "content": "ok"}]},
        {"id": 6, "messages": [{"role": "user", "content": part}]},
        {"id": 7, "messages": {"role": "user", "content": "x"}},
        {"id": 8, "prompt": ["a"], "response": "r"},
        {"conv_id": 9, "turn": 1 << 70, "role": "user", "text": "x"},
        {"id": "ten", "prompt": "\ud800", "response": "r"},
        {"id": 11, "prompt": 1.5, "response": True},
    ]
    lines = [json.dumps(r) for r in records] + ["[" * 100_000, "", "7"]
    got = [tuple(r) for r in chat.json_turns(spark.createDataFrame([(x,) for x in lines], "json string").coalesce(1)).collect()]
    lost = lambda i, key: (key, -1, "unreadable", lines[i])
    assert got == [
        ("1", 0, "user", "5"), ("1", 1, "assistant", None), lost(1, "2"), lost(2, "3"), lost(3, "4"),
        ("5", 0, "user", "look\n[image_url]\nhere"), ("5", 1, "assistant", "ok"), ("6", 0, "user", "look\n[image_url]\nhere"), lost(6, "7"),
        lost(7, "8"), lost(8, "9"), ("ten", 0, "user", "?"), ("ten", 1, "assistant", "r"),
        ("11", 0, "user", "1.5"), ("11", 1, "assistant", "true"), lost(11, None), lost(12, None), lost(13, None),
    ]


def test_messages_in_parts(spark):
    kind = "id long, messages array<struct<role:string,content:array<struct<type:string,text:string,url:string>>>>"
    df = spark.createDataFrame([(1, [("human", [("text", "look", None), ("image", None, "u")]), ("gpt", [("text", "a", None)])]), (2, [("user", None)])], kind)
    got = sorted(((r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.canonical_turns(df).collect()), key=str)
    assert got == [("1", 0, "user", "look\n[image]"), ("1", 1, "assistant", "a"), ("2", 0, "user", None)]


def test_native_escape_reads_back(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [\\INST]", "", None, "plain < [ text", "é[/INST]"]
    df = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    rows = chat.format_turns(df).orderBy("turn").collect()
    for r, t in zip(rows, texts):
        assert chat.read_back(r["formatted"]) == ("assistant", t or "")
        assert chat.unescape(r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_length"]]) == (t or "")


def test_layouts(spark):
    turns = [(0, "user", "q"), (1, "assistant", "a")]
    messages = spark.createDataFrame([Row(id=7, messages=[Row(role=r, content=x) for _, r, x in turns], extra=1)])
    shares = spark.createDataFrame([Row(id=7, conversations=[Row(**{"from": f, "value": x}) for f, (_, _, x) in zip(("human", "gpt"), turns)])])
    prompt = spark.createDataFrame([Row(id=7, prompt="q", response="a")])
    instruction = spark.createDataFrame([Row(id=7, instruction="q", output="a")])
    for df in (messages, shares, prompt, instruction):
        got = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.canonical_turns(df).orderBy("turn").collect()]
        assert got == [("7", *t) for t in turns]
    lines = ['{"id": 7, "prompt": "q", "response": "a"}', '{"id": 8, "messages": [{"role": "user", "content": "q"}]}', "[1]", "{", None]
    got = chat.json_turns(spark.createDataFrame([(x,) for x in lines], "json string")).collect()
    assert [r["role"] for r in got] == ["user", "assistant", "user", "unreadable", "unreadable", "unreadable"]
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical_turns(spark.range(1))


def test_conversations_with_nulls_ties_and_none(spark):
    rows = [(None, 0, "user", "x"), (None, None, None, None), (1, 0, "b", "2"), (1, 0, "a", "1"), (1, 0, "a", "1")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    assert got == {None: 2, 1: 3}
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0


# language model


def test_counts_and_base_scores_match_brute_force(spark):
    rows = [(1, "The cat the CAT", None, None, None), (2, None, None, None, None), (3, "", None, None, None), (4, "the é x\ty\x0bz", None, None, None), (4, "the é x\ty\x0bz", None, None, None), (5, " ".join(f"w{i % 97}" for i in range(3000)), None, None, None)]
    all_docs, train = docs(spark, rows), docs(spark, rows[:4])
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] + [""]
    counts = Counter(w for r in rows[:4] for w in split(r[1]))
    n, v = sum(counts.values()), len(counts)
    for head in (2, 1000):
        got = sorted(lm.fit_and_score(all_docs, train, head=head, frequent=2).collect(), key=lambda r: r["doc_id"])
        assert len(got) == len(rows)
        for r, (doc, text, *_) in zip(got, rows):
            toks = split(text)
            base = sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks)
            assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (doc, len(toks), sum(counts[w] > 0 for w in toks), n)
            assert abs(r["base_score"] - base) < 1e-6 * max(1, -base) and r["score"] < 0
    assert lm.fit_and_score(all_docs, train.limit(0)).count() == len(rows)
    assert lm.fit_and_score(all_docs.limit(0), train).count() == 0


def test_tokens_are_looked_up_once_for_a_batch():
    import pyarrow as pa

    texts = ["  The the\x0bTHE \x1cx\u00a0 \u00c9\n", None, "", "a the\tend\r", " ", "b" * 300 + " a"]
    names, code, offsets = lm.numbered(pa.array(["skipped", *texts]).slice(1))
    flat = [t.as_py() for t in names]
    assert [[flat[i] for i in code[a:b]] for a, b in zip(offsets, offsets[1:])] == [lm.tokens(t) for t in texts]
    assert len(set(flat)) == len(flat) < len(code)
    assert lm.classes_of(names).tolist() == [lm.class_of(t) for t in flat]
    assert lm.places(names, pa.array([b"the", b""], pa.binary())).tolist() == [[b"the", b""].index(t) if t in (b"the", b"") else -1 for t in flat]
    assert lm.histories(np.array([5, 6, 7, 8, 9]), np.array([0, 1]), 99).tolist() == [[99] * 3, [99] * 3, [6, 99, 99], [7, 6, 99], [8, 7, 6]]


@pytest.mark.parametrize("size", [0.1, 5, 60])
def test_sums_over_all_symbols(size):
    rng = np.random.default_rng(4)
    n = 6
    model = lm.Model({}, {}, np.zeros(1), 0, 0, size * rng.normal(size=(lm.ORDER, n + 1, lm.WIDTH)).astype(np.float32), rng.normal(size=(lm.WIDTH, n)).astype(np.float32), rng.normal(size=n).astype(np.float32))
    before, symbol = rng.integers(0, n + 1, (3000, lm.ORDER)), rng.integers(0, n, 3000)
    x = sum(model.context[j][before[:, j]].astype(float) for j in range(lm.ORDER)) @ model.output + model.bias
    want = x[np.arange(3000), symbol] - np.log(np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1)) - x.max(axis=1)
    scores = lm.Scores(model)
    for _ in range(2):  # the second time from the sums kept
        assert np.allclose(scores(before, symbol), want, rtol=1e-4, atol=1e-4 * max(1, size))


def test_model_is_normalised_and_learns_order():
    rng = random.Random(1)
    texts = [" ".join(("a b c d " if rng.random() < 0.5 else "d c b a ") * 5 for _ in range(5)) for _ in range(40)]
    counts = Counter(w for t in texts for w in lm.tokens(t))
    symbols = {w: i for i, w in enumerate(sorted(counts))}
    n = len(symbols) + lm.CLASSES
    model = lm.train(texts, lm.Model({}, symbols, np.zeros(lm.CLASSES), 0, 0, np.zeros((lm.ORDER, n + 1, lm.WIDTH)), np.zeros((lm.WIDTH, n)), np.zeros(n)), epochs=5)
    before = np.array([[symbols[b"b"], symbols[b"a"], n], [n, n, n]])
    p = np.exp([[model.log_probs(before[i : i + 1], np.array([s]))[0] for s in range(n)] for i in range(2)])
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    assert p[0].argmax() == symbols[b"c"]


def test_model_learns_from_every_training_document(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("a b c" if rng.random() < 0.5 else "d e f" for _ in range(100)), None, None, None) for i in range(300)]
    asked = [(1000, " ".join(["a b c"] * 50), None, None, None), (1001, " ".join(["b a c"] * 50), None, None, None)]
    # word order is learnt from the documents outside the starting sample too
    for sample in (0, 1):
        got = {r["doc_id"]: r for r in lm.fit_and_score(docs(spark, asked), docs(spark, rows), sample=sample).collect()}
        assert abs(got[1000]["base_score"] - got[1001]["base_score"]) < 1e-6
        assert got[1000]["score"] > got[1001]["score"] + 30


# mixing


def brute_targets(sizes, weights=(5.0, 2.0, 1.0)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > 2 * sizes[s]]
        if not over:
            return {s: capped.get(s, level * w[s]) for s in names}
        for s in over:
            capped[s] = 2.0 * sizes[s]
            left -= capped[s]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.choice([1, 5, 40, 300])) if rng.random() < 0.95 else None, None, rng.choice([None, "a", "é", "b", "zz", "hot", "hot", "hot"]), "x") for i in range(900)]
    rows = [(i, (t or "").replace("ww", "w w") if t else t, lang, s, x) for i, t, lang, s, x in rows]
    rows += [rows[5]] * 3 + [(None, "one two", None, "empty", None), (901, "", None, "void", None)]
    df = docs(spark, rows)
    got = mixing.mix_plan(df, seed=seed).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = brute_targets(sizes)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_plan(df.repartition(7), seed=seed).collect()))
    assert mixing.mix(df, seed=seed).count() == sum(r["copies"] for r in got)
    assert mixing.mix_plan(df.limit(0)).count() == 0


def test_rounding_keeps_expectations(spark):
    """Over many seeds a document is picked as often as its fraction says."""
    items = spark.createDataFrame([(i, "s", i % 3 + 1, 0.3) for i in range(30)], "key long, grp string, size long, p double")
    picked = Counter()
    for seed in range(12):
        got = mixing.pivotal_rounding(items, seed, fan_in=4).collect()
        assert len(got) == 30 and {r["picked"] for r in got} <= {0.0, 1.0}
        size = sum((r["key"] % 3 + 1) * r["picked"] for r in got)
        assert abs(size - 0.3 * 60) <= 3
        picked.update(r["key"] for r in got if r["picked"] == 1)
    assert 60 < sum(picked.values()) < 160 and len(picked) > 20


# decontamination


def test_paths_agree_with_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "the"]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, item(rng.choice([1, 4, 9, 10, 11, 25]))) for i in range(14)] + [(50, None), (51, "..."), (3, "w1 w2"), (60, "w1 w2")]
    rows = []
    for i in range(40):
        parts = [item(rng.randint(0, 15)) for _ in range(2)] + [rng.choice(items)[1] or ""]
        rng.shuffle(parts)
        rows.append((i, ", ".join(parts).upper().replace("É", "É"), None, None, None))
    rows += [(100, None, None, None, None), (101, "", None, None, None), (1, rows[1][1], None, None, None), (None, rows[2][1], None, None, None)]

    def words(t):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]

    want = []
    for doc, text, *_ in rows:
        w, hit, ids = words(text), set(), set()
        for i, t in items:
            v = words(t)
            m = min(10, len(v))
            for a in range(len(v) - m + 1) if v else ():
                for b in range(len(w) - m + 1):
                    if w[b : b + m] == v[a : a + m]:
                        hit.update(range(b, b + m))
                        ids.add(str(i))
        want.append((str(doc), len(w), len(hit), len(ids), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1000, 0):
        got = decontaminate.contamination(docs(spark, rows), bench, broadcast_rows=limit).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got) == sorted(want)
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(docs(spark, rows), bench.limit(0)).collect()} == {0}


def test_contamination_searches_the_corpus_once(spark):
    bench = spark.createDataFrame([(1, "a b c"), (2, "b c")], "item_id long, text string")
    found = decontaminate.contamination(docs(spark, [(1, "x a b c y b c", None, None, None)]), bench)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["n_hit"], r["n_items"]) for r in found.collect()] == [(5, 2)]


def test_proximity(spark):
    texts = decontaminate.with_words(docs(spark, [(1, "a x x b rare", None, None, None), (2, "a x x x x x x b rare", None, None, None), (3, "Rare B A", None, None, None)]))
    phrases = decontaminate.item_words(spark.createDataFrame([(1, "a b rare")], "item_id long, text string"))
    assert {r["doc_key"]["doc_id"] for r in decontaminate.proximity_matches(texts, phrases, 4).collect()} == {1, 3}


# quality


def test_quality_edges(spark):
    rng = random.Random(4)
    prose = "The river rose in the night, and the old bridge went with it before anyone woke up to see the water. "
    varied = " ".join("".join(rng.choice("aeioustrnl") for _ in range(6)) for _ in range(80)) + "."
    rows = [
        (1, None, None, None, None), (2, "", None, None, None), (3, " \n\t\n", None, None, None), (4, varied, None, None, None),
        (5, "\n".join(["Home | About | Contact | Terms"] * 40 + [prose] * 2), None, None, None), (6, "same words again " * 60, None, None, None), (7, "\n".join(["### *** $$$ %%%"] * 60), None, None, None),
    ]
    got = {r["doc_id"]: r for r in quality.quality(docs(spark, rows)).collect()}
    assert len(got) == 7 and got[4]["kept"] and got[4]["lost_share"] == 0
    assert [k for k, r in got.items() if r["kept"]] == [4]
    assert got[5]["n_dup_lines"] == 40 and got[5]["loses_too_much"] and got[5]["cleaned"].count("|") == 0
    assert got[6]["n_repeat_words"] == 180 and got[6]["base_failed"] and got[7]["punctuation_lines"] == 60
    assert quality.quality(docs(spark, [])).count() == 0


# classifiers


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").persist()


def test_language_accuracy_on_held_out_rows(spark, corpus):
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    got = langid.predict(corpus.where(fold == 2), langid.fit(corpus.where(fold != 2), per_label=100)).toPandas()
    assert len(got) > 200 and (got["lang_pred"] == got["lang"]).mean() > 0.97 and got["rejected"].mean() < 0.05


def test_language_edges(spark):
    rows = [(1, None, "en", None, "x"), (2, "", "en", None, "x"), (3, "12 3!", None, None, "x"), (4, "the cat and the dog", "en", None, "x"), (5, "der Hund und die Katze", "de", None, "x"), (6, "ж", None, None, None)]
    model = langid.train([r[1] for r in rows[3:5]], ["en", "de"])
    got = {r["doc_id"]: r for r in langid.predict(docs(spark, rows), model).collect()}
    assert [k for k, r in got.items() if r["lang_pred"] == "und"] == [1, 2, 3] and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.predict(docs(spark, rows), langid.fit(docs(spark, []))).collect()} == {"und"}
    assert langid.predict(docs(spark, []), model).count() == 0


def test_toxicity_on_held_out_rows_and_edges(spark):
    rng = random.Random(5)
    plain = lambda n: " ".join(rng.choice("river stone field bread window paper green small quiet over under".split()) for _ in range(n))
    made = []
    for i in range(300):
        bad = i % 2
        text = plain(rng.randint(20, 200))
        if bad:
            w = text.split()
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["zorgface.", "GRUNKLY", "blathead" + rng.choice("abcdef")])
            text = " ".join(w)
        made.append((i, text, None, None, None))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(201, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, made[:200]), labels)
    rest = docs(spark, made[200:] + [(900, None, None, None, None), (901, "", None, None, None), (902, "1 2 3", None, None, None)])
    got = {r["doc_id"]: r for r in toxicity.score(rest, model).collect()}
    assert [i for i in range(200, 300) if (got[i]["score"] >= 0.5) != bool(i % 2)] == []
    assert all(0 <= got[i]["score"] < 0.5 and got[i]["spans"] == [] for i in (900, 901, 902))
    one = got[201]
    assert all(re.match("(?i)zorg|grun|blat", made[201][1][s["start"] : s["end"]]) for s in one["spans"]) and one["spans"]
    empty = toxicity.fit(docs(spark, []), labels)
    assert {r["score"] for r in toxicity.score(rest, empty).collect()} == {0.0}


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    psi, trans = np.exp(rng.normal(0, 1, 9)), rng.normal(0, 1, (2, 2))
    first, count = np.array([0, 4, 4]), np.array([4, 0, 5])
    a, b = toxicity.forward_backward(psi, trans, first, count)
    for f, n in ((0, 4), (4, 5)):
        p = np.zeros(n)
        z = 0.0
        for s in range(1 << n):
            tags = [s >> i & 1 for i in range(n)]
            w = np.prod([psi[f + i] ** t for i, t in enumerate(tags)]) * np.exp(sum(trans[x, y] for x, y in zip(tags, tags[1:])))
            z += w
            p += w * np.array(tags)
        odds = (a * b)[f : f + n]
        assert np.allclose(odds / (1 + odds), p / z)


# pages


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="menu"><header><p>Site header, with words</p></header>
    <nav><ul><li><a href=a>one</a><li><a href=b>two</a></ul></nav><div class="cookie-notice">We use cookies, really</div>
    <div id=content><h1>Big &amp; bold</h1><p>First&nbsp;paragraph, with <b>bold</b><br>and <a href=x>one link</a>, and more text here.<p>Second   one, unclosed &lt;tag&gt;, goes on for a while.
    <ul><li>an item of the text</ul><script>var x = "<p>no</p>";</script><form>search</form></div>
    <div class="ads">Buy, buy, buy, this thing now</div><section id="comments"><p>A reader, who comments at great length, says things.</p></section><footer>foot</footer></body></html>"""
    assert html.main_text(page) == "Big & bold\n\nFirst paragraph, with bold and one link, and more text here.\n\nSecond one, unclosed <tag>, goes on for a while.\n\nan item of the text"
    for none in (None, "", "<html>", "<script>x", "<!-- x"):
        assert html.main_text(none) == ""
    assert html.main_text("just text") == "just text"
    deep = "<div>" * 3000 + "<p>deep text, far below</p>" + "</div>" * 3000
    assert html.main_text(deep) == "deep text, far below"


@pytest.mark.parametrize("wrap", ['class="layout with-sidebar"', 'id="page-no-sidebar"', 'class="has-header"', 'data-id="comments"', 'data-hidden="false"', 'title="the hidden cost"'])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_layout_words_cut_nothing(wrap, tag):
    text = "A sentence of the page, which goes on, and on, for some length."
    page = f"""<body><div {wrap}><div class="sidebar"><p>Side text, short.</p></div><{tag}><h2 id="related-work">Related work</h2>
    <p id="share-price">{text}</p><p>{text} <a href="/hidden-gems">gems</a></p><div hidden>secret</div></{tag}></div>
    <div id="comments"><p>{text * 3}</p><div class="comment"><p>{text * 3}</p></div></div></body>"""
    assert html.main_text(page) == f"Related work\n\n{text}\n\n{text} gems"


def test_pages_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "<p>Hi there", "y"), (1, "<p>Hi there", "y")], "page_id long, html string, text string")
    assert sorted(r["n_chars"] for r in html.extract(df).collect()) == [0, 8, 8]
    assert html.extract(df.limit(0)).count() == 0


def test_quality_lines_match_sql(spark):
    """CRLF, lines of tabs only and mixed blanks are judged alike by both, with and without a bad line."""
    import duckdb

    from stepfold.llm.oracles import QUALITY

    rng = random.Random(8)
    parts = ["abc def", "\t", "\r", "more words.\r", "", " ", "123", "| a | b | c |", "\x0b\f", "»x\r", "Privacy Policy\r", "two\tcolumns", "-----", "ok 5%"]
    rows = [(0, "abc def\n\t\nmore words"), (1, "para one\r\n\r\npara two"), (2, None), (3, "\t\n\r")]
    rows += [(i, "\n".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))) for i in range(10, 300)]
    names = ["doc_id", "n_words", "n_dup_lines", "base_failed", "kept", "lost_share", "punctuation_lines", "navigation_lines", "boilerplate_lines"]
    got = sorted(tuple(r) for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).select(names).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({QUALITY})").fetchall())
    assert [g[:5] + g[6:] for g in got] == [w[:5] + w[6:] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])


def test_repeated_words_of_texts_too_long_to_pack(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randint(0, 40))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, w array<string>")
    short = {r["i"]: r["n"] for r in quality.repeated_words(df, "w", "n").collect()}
    assert short == {r["i"]: r["n"] for r in quality.repeated_words(df, "w", "n", bits=2).collect()} and max(short.values()) > 3
