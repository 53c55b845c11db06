import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from stepfold.llm import simhash as S


def brute_fingerprint(text):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(fps, bits):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprint_matches_brute_force():
    for text in (None, "", " \n\t ", "One", "one two", "a b c", "A b c A b c d e É é", "x " * 500 + "y z"):
        assert S.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("seed", range(3))
def test_trie_pairs_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, k, replace=False))) for b in base for k in (1, 2, 3, 4)]
    a = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    i, j = S.trie_pairs(a, None, 2)
    want = {(x, y) for y in range(len(a)) for x in range(y) if int(a[x] ^ a[y]).bit_count() <= 2}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want
    one, two = a[::2], a[1::2]
    i, j = S.trie_pairs(one, two, 2)
    want = {(x, y) for x in range(len(one)) for y in range(len(two)) if int(one[x] ^ two[y]).bit_count() <= 2}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("node_rows", [50_000, 20])
def test_links_connect_what_brute_force_connects(spark, node_rows):
    """Also where every trie node is cut before it reaches a task."""
    rng = np.random.default_rng(5)
    fps = {0}
    for b in rng.integers(0, 1 << 63, 30).tolist():
        for _ in range(8):
            fps.add(b)
            b ^= 1 << int(rng.integers(64))
            b ^= 1 << int(rng.integers(64))
    hot = int(rng.integers(0, 1 << 63))
    for _ in range(150):  # one block in common
        fps.add((hot & ~((1 << 21) - 1)) | int(rng.integers(0, 1 << 21)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {}
    edges = [(r["a"], r["b"]) for r in S.links(df, 2, node_rows).collect()]
    for a, b in edges:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    want = brute_components([f & (1 << 64) - 1 for f in signed], 2)
    from stepfold.llm.components import components

    parts = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for f in signed:
        got.setdefault(parts.get(f, f), set()).add(f & (1 << 64) - 1)
    expect = {}
    for f, c in want.items():
        expect.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expect.values()))


def test_near_duplicates_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " ", "y"), (5, "same text for all", "y"), (4, "same text for all", None), (4, "same text for all", None), (None, "other words here", "z")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (5, 4), (4, 4), (4, 4), (None, None)], key=str)
    assert S.near_duplicates(spark.createDataFrame([], schema)).count() == 0
