"""The prefix trie against a dictionary of prefixes, in one shard and in many."""

import hashlib
import random
import zlib
from collections import defaultdict
from math import fmod

import pytest

from stepfold.llm import trie
from stepfold.llm.queries import QUERIES
from tests.oracle import DATA

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_hand(rows):
    """rows: (conv_id, turn, role, text)."""
    of = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            of[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in of.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(fmod(c, 20)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = lambda p: [q for q in members if q[: len(p)] == p]
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, own_members in members.items():
        words = lambda q: len(q[-1][1].replace("\r", " ").replace("\x0b", " ").split()) if q else 0
        ends = ",".join(map(str, sorted(c for c in own_members if len(rebuilt[c]) == len(p))))
        out.append((
            min(own_members), len(p), min(members[p[:-1]]) if p else None, len(own_members), len(kids[p]), sum(not kids[q] for q in below(p)),
            sum((len(members[q]) - 1) * words(q) for q in below(p)), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def made(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, path string")
    out = trie.prefix_trie(trie.rebuild(trie.encode(df)), **options)
    return sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=str)


def talk(rng, n, kinds):
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(kinds)) for c in range(n) for t in range(rng.randint(0, 7))]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"shard_bytes": 200, "fan": 2}), (3, {"shard_bytes": 400, "fan": 3}), (4, {"shard_bytes": 64, "fan": 64})])
def test_equals_by_hand(spark, seed, options):
    rng = random.Random(seed)
    rows = talk(rng, 120, ["a", "b b", "", None, "c  c\tc"])
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(3)]  # many copies
    rows += [(500, t, "user", f"long {t % 3}") for t in range(400)]  # one long path
    rng.shuffle(rows)
    assert made(spark, rows, **options) == by_hand(rows)


def test_nulls_ties_repeats_and_nothing(spark):
    rows = [(None, 0, "user", "x"), (40, None, "user", "z"), (40, 1, None, None), (40, 1, "user", "b"), (40, 1, "user", "b"), (41, 0, "user", "q"), (45, None, None, None), (-3, 0, "user", "z"), (-20, 0, "user", "z")]
    assert made(spark, rows) == by_hand(rows)
    assert made(spark, []) == [] == made(spark, rows[:1])


def test_tree_is_balanced():
    """Median insertion keeps sibling trees shallow."""
    own = trie.Tree()
    own.insert_sorted([i.to_bytes(8, "big") + bytes(4) for i in range(1 << 10)])
    deep = 0
    todo = [(own.equal[0], 1)]
    while todo:
        at, d = todo.pop()
        if at >= 0:
            deep = max(deep, d)
            todo += [(own.lower[at], d + 1), (own.higher[at], d + 1)]
    assert deep <= 11


def test_query(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.001/conversations.parquet").collect()]
    got = QUERIES["op11_prefix_trie"](spark, f"{DATA}/sf0.001")
    assert got.columns == COLUMNS and {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows)
