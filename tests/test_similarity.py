"""The ball index, range joins and posting lists against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfold.operators import balls as B
from stepfold.operators import similarity as S


def table(spark, v, kinds=None, ids=None):
    rows = [(ids[i] if ids else i, v[i].tolist(), kinds[i] if kinds else None) for i in range(len(v))]
    key = "string" if ids else "long"
    return spark.createDataFrame(rows, f"id {key}, embedding array<float>, kind int").repartition(3)


def scores(q, v, cosine=True):
    q, v = (x.astype("float32").astype("float64") for x in (q, v))
    if cosine:
        q, v = (np.divide(x, n, out=np.zeros_like(x), where=n > 0) for x, n in ((x, np.linalg.norm(x, axis=1, keepdims=True)) for x in (q, v)))
    return np.round(q @ v.T, S.DIGITS)


def best(c, k, ids, kinds=None, floor=None, exclude_self=False, q_ids=None):
    want = set()
    for i in range(len(c)):
        for kind in set(kinds or [None]):
            mine = [j for j in range(c.shape[1]) if kinds is None or kinds[j] == kind]
            mine = [j for j in mine if not (exclude_self and q_ids[i] == ids[j]) and (floor is None or c[i, j] >= floor)]
            top = sorted(mine, key=lambda j: (-c[i, j], ids[j]))[:k]
            want |= {(q_ids[i] if q_ids else i, kind, n + 1, ids[j]) for n, j in enumerate(top)}
    return want


def clustered(rng, n, dim=8, clusters=12, spread=0.02):
    centres = rng.normal(size=(clusters, dim))
    v = centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dim))
    return v.astype("float32")


@pytest.fixture(params=["scan", "index"])
def way(request, monkeypatch):
    monkeypatch.setattr(S, "I_BLOCK", 16)
    monkeypatch.setattr(S, "Q_BLOCK", 7)
    if request.param == "index":
        monkeypatch.setattr(S, "QUERY_BYTES", -1)


def hard(rng):
    """Clusters, a pile of equal vectors, a pile of scaled copies, zero vectors."""
    v = clustered(rng, 150)
    v[20:50] = v[3]
    v[60:70] = np.outer(np.arange(1, 11), v[5])
    v[80:84] = 0
    return v


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_topk(spark, way, metric):
    v = hard(np.random.default_rng(1))
    df = table(spark, v)
    c = scores(v, v, metric == "cosine")
    got = {(r.query_id, None, r.rn, r.item_id) for r in S.similarity_topk(df, df, 6, metric=metric, exclude_self=True).collect()}
    assert got == best(c, 6, range(150), exclude_self=True, q_ids=range(150))
    got = {(r.query_id, None, r.rn, r.item_id) for r in S.similarity_topk(df, df, 40, metric=metric).collect()}
    assert got == best(c, 40, range(150))


def test_topk_by_kind_text_ids_and_floor(spark, way):
    rng = np.random.default_rng(2)
    v, q = hard(rng), clustered(rng, 30)
    q[4] = 0
    kinds = [int(x) for x in rng.integers(0, 4, 150)]
    kinds[7] = None
    ids = [f"i{i}" for i in range(150)]
    items, queries = table(spark, v, kinds, ids), table(spark, q).select("id", "embedding")
    for floor in (None, 0.5, 0.0):
        got = {(r.query_id, r.kind, r.rn, r.item_id) for r in S.similarity_topk(queries, items, 3, min_sim=floor, by_kind=True).collect()}
        assert got == best(scores(q, v), 3, ids, kinds, floor)


def test_topk_of_nothing(spark, way):
    v = clustered(np.random.default_rng(3), 20)
    df = table(spark, v)
    assert S.similarity_topk(df.limit(0), df, 3).collect() == [] == S.similarity_topk(df, df.limit(0), 3).collect()
    blank = table(spark, np.zeros((5, 4)))
    got = {(r.query_id, r.item_id, r.sim) for r in S.similarity_topk(blank, blank, 2).collect()}
    assert got == {(i, j, 0.0) for i in range(5) for j in range(2)}
    holes = df.withColumn("embedding", F.when(F.col("id") % 2 == 0, F.col("embedding")))
    assert {r.item_id % 2 for r in S.similarity_topk(df, holes, 3).collect()} == {0}


def test_few_blocks_are_visited(spark):
    """On clustered vectors the two visits multiply a small share of all pairs."""
    v = clustered(np.random.default_rng(4), 3000, dim=16, clusters=40, spread=0.01)
    df = table(spark, v)
    report = []
    found = S.index_topk(df, df, 5, floor=None, cosine=True, exclude_self=True, block=32, report=report)
    got = {(r.query_id, r.item_id) for r in S.top_k(found, ["query_id"], [F.desc("sim"), F.col("item_id")], 5).collect()}
    assert got == {(i, j) for i, _, _, j in best(scores(v, v), 5, range(3000), exclude_self=True, q_ids=range(3000))}
    index, *visits = report
    sizes = index.packed.select("block", F.size("ids").alias("n"))
    met = sum(x.join(sizes, "block").agg(F.sum(F.size("q_ids") * F.col("n"))).first()[0] or 0 for x in visits)
    assert 0 < met < 0.15 * 3000 * 3000


def test_blocks_stay_bounded_in_one_cluster(spark):
    v = clustered(np.random.default_rng(5), 500, clusters=1, spread=0.001)
    index = B.build(table(spark, v), block=32)
    sizes = [r.n for r in index.packed.select(F.size("ids").alias("n")).collect()]
    assert max(sizes) <= 32 and sum(sizes) == 500


def groups(edges):
    of = {}

    def root(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in edges:
        of[root(a)] = root(b)
    out = {}
    for x in list(of):
        out.setdefault(root(x), set()).add(x)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("threshold", [0.3, 0.9, 0.999, -0.2])
def test_pairs_and_links(spark, threshold):
    v = hard(np.random.default_rng(6))
    df = table(spark, v)
    f = v.astype("float64")
    norm = np.linalg.norm(f, axis=1, keepdims=True)
    u = np.divide(f, norm, out=np.zeros_like(f), where=norm > 0)
    c = u @ u.T
    first = {i: min(j for j in range(150) if (v[j] == v[i]).all()) for i in range(150)}
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if c[i, j] >= threshold and first[i] == i and first[j] == j}
    want |= {(first[i], i) for i in range(150) if first[i] != i and norm[i] > 0}
    got = [(r.a, r.b) for r in S.similar_pairs(df, threshold, block=16).collect()]
    assert len(got) == len(set(got))
    close = {(i, j) for i, j in want ^ set(got)}
    assert all(abs(c[i, j] - threshold) < 1e-12 for i, j in close)
    links = [(r.a, r.b) for r in S.similar_links(df, threshold, block=16).collect()]
    assert groups(links) == groups(got)


def test_links_of_a_pile_are_few(spark):
    """2000 near-copies: two million pairs, about as many links as items."""
    rng = np.random.default_rng(7)
    v = (rng.normal(size=(1, 8)) + 1e-4 * rng.normal(size=(2000, 8))).astype("float32")
    links = [(r.a, r.b) for r in S.similar_links(table(spark, v), 0.9, block=64).collect()]
    assert len(groups(links)) == 1 and len(links) < 2 * 2000


# posting lists


def bm25_by_hand(queries, docs, k, k1=0.9, b=0.4):
    import re
    from collections import Counter
    from math import log

    split = lambda t: [x for x in re.split(r"[^\w]+", (t or "").lower().replace("_", " ")) if x]
    bags = {i: Counter(split(t)) for i, t in docs}
    n, avg = len(bags), sum(sum(c.values()) for c in bags.values()) / sum(t is not None for _, t in docs)
    df = Counter(t for c in bags.values() for t in c)
    out = set()
    for q, text in queries:
        score = {}
        for t in set(split(text)):
            idf = log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            for i, c in bags.items():
                if c[t]:
                    score[i] = score.get(i, 0) + idf * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * sum(c.values()) / avg))
        out |= {(q, i, r + 1, round(s, 9)) for r, (s, i) in enumerate(sorted(((round(s, 12), i) for i, s in score.items()), key=lambda x: (-x[0], x[1]))[:k])}
    return out


def texts(rng, n, words, rare):
    """Three words that everyone uses, and a long tail."""
    tail = [f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, n * words), rare)]
    common = lambda: " ".join(rng.choice(["the", "and", "of"], int(rng.integers(1, 5))))
    return [common() + " " + " ".join(tail[i * words : i * words + int(rng.integers(0, words))]) for i in range(n)]


@pytest.mark.parametrize("k,block", [(3, 1024), (3, 8), (50, 16), (1, 1)])
def test_bm25(spark, k, block):
    from stepfold.operators.postings import bm25_topk

    rng = np.random.default_rng(8)
    docs = [*enumerate(texts(rng, 200, 25, 400)), (900, None), (901, ""), (902, "the the the"), (903, "the the the")]
    queries = [*((f"q{i}", t) for i, t in enumerate(texts(rng, 15, 12, 400))), ("none", "zzz"), ("null", None), ("same", "of of the")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id string, text string")
    got = {(r.query_id, r.doc_id, r.rn, round(r.score, 9)) for r in bm25_topk(q, d, k, block=block).collect()}
    assert got == bm25_by_hand(queries, docs, k)
    assert bm25_topk(q, d.limit(0), k).collect() == [] == bm25_topk(q.limit(0), d, k).collect()


def test_bm25_leaves_frequent_lists_alone(spark):
    """Documents that share only common words with a query are not listed for it."""
    from stepfold.operators.postings import bm25_topk

    rng = np.random.default_rng(9)
    docs = list(enumerate(texts(rng, 1500, 30, 100_000)))
    queries = [(i, docs[i * 7][1]) for i in range(40) if len(docs[i * 7][1].split()) > 12]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    report = []
    got = {(r.query_id, r.doc_id, r.rn, round(r.score, 9)) for r in bm25_topk(q, d, 1, block=32, report=report).collect()}
    assert got == bm25_by_hand(queries, docs, 1)
    met, found, qt = (r.agg(F.sum(c)).first()[0] for r, c in ((report[0], "n"), (report[1].withColumn("one", F.lit(1)), "one"), (report[2], "df")))
    assert met < 0.05 * qt and found < 0.1 * len(queries) * len(docs)


@pytest.mark.parametrize("text", [False, True])
def test_tiles_shuffle_no_vector_again(spark, monkeypatch, text):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 6)).astype("float32")
    v[50:60], v[7] = v[0], 0  # copies, no length
    name = (lambda i: f"x{i:03d}") if text else (lambda i: i)
    rows = [(name(i), v[i].tolist(), i % 3) for i in range(90)]
    d = spark.createDataFrame(rows, f"id {'string' if text else 'long'}, embedding array<float>, kind int")
    monkeypatch.setattr(S, "QUERY_BYTES", 1 << 30)
    want = {}
    for metric, own in (("cosine", True), ("dot", False)):
        want[metric] = S.similarity_topk(d, d, 4, min_sim=0.1, by_kind=True, metric=metric, exclude_self=own).collect()
        found = S.tile_topk(d, d, 4, floor=0.1, cosine=metric == "cosine", exclude_self=own, block=8, parts=(5, 3))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        got = S.top_k(found, ["query_id", "kind"], [F.desc("sim"), F.col("item_id")], 4).collect()
        assert len(got) > 300
        assert {(r.query_id, r.item_id, r.kind, r.rn, round(r.sim, 9)) for r in got} == {(r.query_id, r.item_id, r.kind, r.rn, round(r.sim, 9)) for r in want[metric]}


def test_pairs_shuffle_no_vector_again(spark):
    v = np.random.default_rng(4).normal(size=(70, 5)).astype("float32")
    v[60:] = v[0]
    found = S.similar_pairs(table(spark, v), 0.4, block=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan
    got = [(r.a, r.b) for r in found.collect()]
    c = scores(v, v)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if c[a, b] >= 0.4} | {(0, b) for b in range(60, 70)}
    assert len(got) == len(want) and set(got) == want


def test_bm25_ties_at_nine_digits(spark, monkeypatch):
    from stepfold.operators import catalog, postings

    # the shorter text is better by less than 1e-9, so the smaller id goes first, as in the SQL
    d = spark.createDataFrame([("1", "x y y y y"), ("2", "x y y"), ("3", "z")], "asin string, contents string")
    q = spark.createDataFrame([(0, "x")], "query_id long, text string")
    monkeypatch.setattr(catalog, "bm25_topk", lambda *a, **kw: postings.bm25_topk(*a, b=1e-10, **kw))
    assert [(r.doc_id, r.rn) for r in catalog.keyword_search(q, d, 2).collect()] == [("1", 1), ("2", 2)]


def test_equal_texts_are_ranked_once(spark):
    """600 documents of ten texts: as ranked one by one, with postings of ten texts only."""
    from stepfold.operators import catalog, postings

    words = ["red ring", "blue ring", "red bolt large", "blue bolt", "ring ring bolt", "cold plate", "red plate", "bolt", "blue", "large ring"]
    d = spark.createDataFrame([(f"{(i * 7) % 600:04d}", words[i % 10]) for i in range(600)], "asin string, contents string")
    q = spark.createDataFrame([("a", "red ring"), ("b", "blue bolt large"), ("c", "plate")], "query_id string, text string")
    report = []
    got = {(r.query_id, r.rn): (r.doc_id, r.score) for r in catalog.keyword_search(q, d, 70, report=report).collect()}
    docs = d.select(d.asin.alias("doc_id"), d.contents.alias("text"))
    want = {(r.query_id, r.rn): (r.doc_id, r.score) for r in postings.bm25_topk(q, docs, 70, digits=9).collect()}
    assert got == want
    assert report[1].count() <= 3 * len(words)


def test_tfidf_of_products_with_several_texts(spark):
    """Rows that share an asin count as one product, and nothing else is shuffled by product and term."""
    from collections import Counter

    from stepfold.operators import catalog

    rows = [("a", "x", "red ring red"), ("a", "x", "ring bolt"), ("b", "x", "bolt"), ("c", "y", "red"), ("c", "x", "plate red"), (None, "x", "bolt bolt"), (None, "x", "ring"), ("d", "y", None)]
    df = spark.createDataFrame(rows, "asin string, category string, text string")
    want: dict = {}
    for asin, category, text in rows:
        want.setdefault((asin, category), Counter()).update((text or "").split())
    got = {(r.asin, r.category): {x.term: x.tf for x in r.l or []} for r in catalog._counted(df, 1, [], "category", "text").collect()}
    assert got == {k: dict(c) for k, c in want.items()}
    assert catalog.tfidf_attributes(df, 1, stop_words=[], k=2, max_features=3).count() > 0


def test_a_task_of_tiles_gives_one_best_list_for_all_parts_of_the_items(spark, monkeypatch):
    v = np.random.default_rng(5).normal(size=(120, 6)).astype("float32")
    d = table(spark, v, [i % 2 for i in range(120)])
    monkeypatch.setattr(S, "Q_PARTS", 3)
    found = S.tile_topk(d, d, 4, floor=None, cosine=True, exclude_self=False, block=8, parts=(3, 7))
    # in each of three tasks: four for every query and kind, and no query in two tasks
    assert found.rdd.getNumPartitions() == 3 and found.count() == 120 * 2 * 4
    got = {(r.query_id, r.kind, r.rn, r.item_id) for r in S.top_k(found, ["query_id", "kind"], [F.desc("sim"), F.col("item_id")], 4).collect()}
    assert got == best(scores(v, v), 4, range(120), [i % 2 for i in range(120)], q_ids=range(120))
