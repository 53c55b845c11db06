"""Encoding, decoding and alignment against the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stepfold.llm import align, bpe
from stepfold.llm.queries import QUERIES, tokenizer_file
from tests.oracle import DATA

WORD, BYTE, PIECE = (tokenizer_file(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
PARTS = [
    "a", "b", "the", "in", "g", "Ing", "'S", "'ll", "'", "  ", "\t", "\x1c", "\x85", "\xa0", "é", "É", "İ", "Σ", "日", "本", "̈", "1", "²", "½",
    "<|endoftext|>", "<|startoftext|>", "<|", "|>", "</w>", "!", "...", "ß", "ŉ", "ǅ", "Ā", "😀", "‍", "　", "▁", "\n", "–", "K", "aaa", "\x00", "<0x41>", "</s>", "-", ">",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def mixed(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(n))


def same(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = own.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want, repr(text)
    assert b"".join(own.decode(got)).decode() == library.decode(want, skip_special_tokens=False)


def test_encoder_equals_library(library):
    own, rng = bpe.encoder(WORD), random.Random(12)
    for text in ["", " ", "\n\n"]:
        same(own, library, text)
    for _ in range(3000):
        same(own, library, mixed(rng, rng.randint(1, 25)))
        same(own, library, "".join(rng.choice("abehinorst") for _ in range(rng.randint(1, 40))))
    for c in range(0x20, 0x600):
        same(own, library, f"a{chr(c)}{chr(c)}b '{chr(c)} {chr(c)}9")


def test_one_endless_word(library):
    rng = random.Random(3)
    for text in ("a" * 30_000, "".join(rng.choice("abehinorst") for _ in range(100_000)), "日" * 5_000, "!" * 5_000):
        same(bpe.encoder(WORD), library, text)


def test_stretches_end_at_blanks(library):
    rng = random.Random(6)
    for _ in range(300):
        text = mixed(rng, 80)
        for size in (1, 7):
            parts = list(bpe.stretches(text, size))
            assert "".join(parts) == text
            want = [i for p in parts for i in library.encode(p, add_special_tokens=False).ids]
            assert "<|" in text or want == library.encode(text, add_special_tokens=False).ids
    long = " ".join(mixed(rng, 5) for _ in range(60_000))
    assert len(list(bpe.stretches(long))) > 1
    same(bpe.encoder(WORD), library, long)


def test_tables_may_be_emptied(library, monkeypatch):
    monkeypatch.setattr(bpe, "HELD_WORDS", 3)
    monkeypatch.setattr(bpe, "HELD_PAIRS", 3)
    own, rng = bpe.Encoder(WORD), random.Random(5)
    for _ in range(200):
        same(own, library, mixed(rng, 20))


def test_columns_round_trip(spark, library):
    rows = [(1, "Hello  World", "x"), (2, None, None), (2, "", "y"), (None, "ça <|endoftext|>", "z"), (1, "Hello  World", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, WORD), WORD).collect()
    assert [(r["doc_id"], r["text"], r["ids"]) for r in out] == rows
    for r in out:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), WORD).collect() == []
    with pytest.raises(ValueError):
        bpe.encode(df, WORD, ids="ids")


def test_codec_query(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op12_bpe_codec"](spark, f"{DATA}/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# alignment


def by_hand(rows):
    """The contract one token pair at a time, with the libraries."""
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    to_byte = bpe.byte_characters()
    vocab = {i: bytes(to_byte[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    raw = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    made = []
    for doc, text in rows:
        groups = []
        ta, tb = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if text and b"".join(vocab[i] for i in ta) == whole == b"".join(raw(i) for i in tb):
            ends = [np.cumsum([len(x) for x in t]).tolist() for t in ([vocab[i] for i in ta], [raw(i) for i in tb])]
            cuts = sorted(set(ends[0]) & set(ends[1]))
            groups = [[[i for i, e in zip(t, es) if lo < e <= hi] for t, es in zip((ta, tb), ends)] for lo, hi in zip([0, *cuts], cuts)]
        made.append((doc, groups))
    count = Counter(p for _, groups in made for p in {(x, y) for ga, gb in groups for x in ga for y in gb})
    best = defaultdict(int)
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    out = []
    for doc, groups in made:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check_alignment(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_a int").repartition(3)
    got = [tuple(r[c] for c in COLUMNS) for r in align.align(df, BYTE, PIECE, **options).collect()]
    assert sorted(got, key=str) == sorted(by_hand(rows), key=str)


def sample_rows():
    rng = random.Random(13)
    rows = [(i, mixed(rng, rng.randint(1, 60))) for i in range(40)]
    rows += [(None, "no id here"), (None, "no id here"), (7, None), (8, ""), (9, " "), (10, "a▁b"), (11, "word " * 50), (12, "Wörter und mots, 日本語 😀😀 " * 20), (12, "again"), (13, "<|endoftext|> </s> <unk>")]
    return rows


def test_alignment(spark):
    check_alignment(spark, sample_rows())


@pytest.mark.parametrize("sizes", [align.Sizes(chunk=9, stretch=5, fan=4, many=3), align.Sizes(chunk=200, stretch=16, fan=2, many=1)])
def test_alignment_in_fragments(spark, sizes):
    """Chunks, tree rounds, crowded groups and the join of rare pairs give the same rows."""
    check_alignment(spark, sample_rows(), head=20, sizes=sizes)


def test_fragments_are_associative():
    """Any bracketing of three neighbours closes the same groups."""
    own, rng = align.pair(BYTE, PIECE), random.Random(2)
    sizes = align.Sizes()
    for _ in range(60):
        a, b = own.tokens(mixed(rng, 40).replace("▁", "x"), 1 << 16)
        ends = [np.cumsum(own.a_size[a]), np.cumsum(own.b_size[b])]
        at = sorted(rng.sample(range(1, int(ends[0][-1])), 2))
        parts = []
        for no, (lo, hi) in enumerate(zip([0, *at], [*at, int(ends[0][-1])])):
            ka, kb = ((e > lo) & (e <= hi) for e in ends)
            row = {"rid": 1, "no": no, "a": a[ka].astype("<u4").tobytes(), "a_end": ends[0][ka].tobytes(), "b": b[kb].astype("<u4").tobytes(), "b_end": ends[1][kb].tobytes()}
            parts.append(list(align.fragment(own, row, sizes)))
        done = [r for p in parts for r in p if not r["is_open"]]
        x, y, z = (next(r for r in p if r["is_open"]) for p in parts)

        def join(*rows):
            out = list(align.compose(own, iter(rows), 0, sizes))
            return next(r for r in out if r["is_open"]), [r for r in out if not r["is_open"]]

        def text(rows):
            return b";".join(r["text"] for r in sorted(done + rows, key=lambda r: (r["at"], r["seam"])))

        xy, c1 = join(x, y)
        left, c2 = join(xy, z)
        yz, c3 = join(y, z)
        right, c4 = join(x, yz)
        flat, c5 = join(x, y, z)
        assert text(c1 + c2) == text(c3 + c4) == text(c5)
        assert all(r[k] == b"" for r in (left, right, flat) for k in ("pa", "pb", "sa", "sb"))


def test_alignment_of_nothing(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), BYTE, PIECE).collect() == []


def test_alignment_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_tokenizer_alignment"](spark, f"{DATA}/sf0.001").collect()]
    assert sorted(got) == sorted(by_hand(rows))
