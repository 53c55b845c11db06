import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from stepfold.llm import substrings as S

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("removed", T.StringType())])


def brute(rows, length=50):
    first = {}
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        did = S.LAST_ID if doc is None else doc
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            first[w] = min(first.get(w, did), did)
    out = []
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        did = S.LAST_ID if doc is None else doc
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < did:
                gone[i : i + length] = True
        left = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    syllables = ["tion", "en", "é", "ing", "ß", "the ", "of ", "a", ". ", "\n", "er "]
    some = ["".join(rng.choice(syllables) for _ in range(n)) for n in (15, 20, 25, 30, 60, 200)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(some) if rng.random() < 0.6 else "".join(rng.choice(syllables) for _ in range(rng.randint(1, 60))))
        text = "".join(parts)
        if rng.random() < 0.3 and len(text) > 60:
            k = rng.randrange(len(text))
            text = text[:k] + "X" + text[k + 1 :]
        rows.append((i, text, "x"))
    rows += [(70, rows[3][1], "x"), (70, rows[3][1], "x"), (71, rows[3][1] + "!", "x"), (2, rows[5][1], "x"), (None, rows[8][1] * 3, "x"), (72, None, None), (73, "", ""), (74, "ab" * 400, ""), (75, "ba" * 300, ""), (76, "z" * 49, ""), (77, "z" * 49, "")]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    rows = passages(seed)
    got = S.deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert set(got.columns) == {"doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"}
    got = sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got.collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert S.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_do_not_change_the_starts(monkeypatch):
    raw = np.frombuffer(("".join(x[1] or "" for x in passages(1))).encode(), np.uint8)
    offsets = np.array([0, 40, 40, 2000, len(raw)])
    whole = {(int(s) + k, int(a), int(h)) for s, e, a, h, _ in zip(*S.chosen_starts(raw, offsets)) for k in range(int(e - s) + 1)}
    monkeypatch.setattr(S, "BLOCK", 300)
    cut = {(int(s) + k, int(a), int(h)) for s, e, a, h, _ in zip(*S.chosen_starts(raw, offsets)) for k in range(int(e - s) + 1)}
    assert whole == cut
