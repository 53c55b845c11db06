"""Exact byte-pair encoding of whole texts by backtracking over longest matches, and its inverse.

Encoding. An Aho-Corasick automaton over the vocabulary finds the longest token that starts at
every place of a word in one pass. Tokens are then laid end to end, the longest first; a token
stays only if it is compatible with the one before it, that is, if merging the bytes of the
two by the tokenizer's ranks ends in these same two. If it is not, the next shorter token that
is a prefix of it is tried; if none is left, the place is marked dead and the token before is
taken back. A sequence whose neighbours are all compatible is what the merges give, and a place
is reached with one such sequence only, so it dies once at most: the work is linear in the
word. The table of compatible pairs is filled as pairs come up, at most ``HELD_PAIRS`` at a
time. Words repeat, so their ids are remembered, at most ``HELD_WORDS`` at a time.

Around the merges stand the tokenizer file's own steps: strings of added tokens are cut out of
the raw text first; the rest is put into composed form and lower case, and split into words.
For texts in Latin letters and common marks that is done here; texts with any other character
go through the file's own normaliser and splitter.

Decoding. All token strings lie in one block of bytes, with a table of their offsets; the
bytes of a list of ids are gathered from it, a bounded stretch at a time.

Each row is worked on by itself: no shuffle, no row is lost, other columns may have any name.
Null and empty texts have no tokens; their decoded text is empty. Repeated rows are encoded
again. Long texts are split into words a stretch at a time, ending at a blank; a word of any
length is one run of the linear encoder.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stepfold.llm.base import chunks

HELD_WORDS, HELD_PAIRS = 1 << 19, 1 << 21
#: Words longer than this are not remembered.
LONG_WORD = 64
#: Ids decoded at a time.
DECODED = 1 << 16
#: Stands for the end of a word inside the automaton; bytes are U+0000 to U+00FF there.
WORD_END = "\u0100"
#: Texts of these characters only are normalised and split here: all of them are in composed
#: form, have a lower-case form of one character among them, and keep their class in every
#: Unicode version. The dotted capital I is not.
_PLAIN = r"\t-\r\x20-\x7e\xa0-\u012f\u0131-\u017f\u2010-\u2015\u2018-\u201f\u2026"
_OTHER = re.compile(f"[^{_PLAIN}]")
_STOP = re.compile(r"[ \n]")
#: Word separators among them.
_BLANK = r"\t-\r\x20\xa0"


def _class_of(kinds: str) -> str:
    """The plain characters above ASCII of the given Unicode kinds, as a character class."""
    return "".join(c for c in map(chr, range(0xA0, 0x180)) if unicodedata.category(c)[0] in kinds)


_LETTERS, _DIGITS = "a-zA-Z" + _class_of("L"), "0-9" + _class_of("N")
#: Fixed value: the split pattern of the tokenizer file, with its classes spelled out.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_BLANK}{_LETTERS}{_DIGITS}]+")


def byte_characters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for every byte, and its byte."""
    kept = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def stretches(text: str, size: int = 1 << 18) -> Iterator[str]:
    """A text in stretches of about ``size`` characters that end after a blank or line end, where
    no word reaches across and nothing composes."""
    at = 0
    while len(text) - at > size and (m := _STOP.search(text, at + size)):
        yield text[at : m.end()]
        at = m.end()
    if at < len(text):
        yield text[at:]


class Words(dict):
    """Word (as characters of its bytes) to its ids as little-endian bytes, found as words come."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = self.encoder.merge(word.encode().decode("latin-1"))
        out = pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONG_WORD:
            if len(self) >= HELD_WORDS:
                self.clear()
            self[word] = out
        return out


class Encoder:
    """One tokenizer file: automaton, splits, pair table, offset table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        to_byte = byte_characters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self.library = Tokenizer.from_file(path)
        self._back = str.maketrans({c: chr(b) for c, b in to_byte.items()})

        def inner(token: str) -> str:
            ends = self.suffix and token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if ends else token
            return body.translate(self._back) + (WORD_END if ends else "")

        self.ids = {inner(t): i for t, i in model["vocab"].items()}
        self.rank = {(self.ids[inner(a)], self.ids[inner(b)]): k for k, (a, b) in enumerate(model["merges"])}
        self.merged = {(a, b): self.ids[inner(x + y)] for (x, y), (a, b) in zip(model["merges"], self.rank)}
        n = max([*self.ids.values(), *self.added.values()]) + 1
        self.text = [""] * n
        for t, i in self.ids.items():
            self.text[i] = t
        self.length = [len(t) for t in self.text]
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if self.base(t) == [i]:  # a token that its own merges don't end in never occurs
                self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.shorter = [self._prefix(t) for t in self.text]
        self.pairs: dict[int, bool] = {}
        self.words = Words(self)
        # decoding: the strings as they stand in the file, each after a space
        shown = [""] * n
        for t, i in [*model["vocab"].items(), *self.added.items()]:
            shown[i] = t
        each = [(" " + t).encode() for t in shown]
        self.block = np.frombuffer(b"".join(each), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)

    def _prefix(self, token: str) -> int:
        for k in range(len(token) - 1, 0, -1):
            if (hit := self.automaton.get(token[:k], None)) is not None:
                return hit[1]
        return -1

    def _symbols(self, s: str) -> list[int]:
        out = list(s[:-1] if s.endswith(WORD_END) else s)
        if s.endswith(WORD_END):
            out[-1] += WORD_END
        return [self.ids[x] for x in out]

    def base(self, s: str) -> list[int]:
        """The merges themselves, lowest rank first; for the few bytes of one or two tokens."""
        ids = self._symbols(s)
        while len(ids) > 1:
            ranked = [(self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(ids, ids[1:]))]
            best, i = min(ranked)
            if best == 1 << 30:
                break
            ids[i : i + 2] = [self.merged[ids[i], ids[i + 1]]]
        return ids

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of both tokens' bytes end in these two."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= HELD_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.base(self.text[a] + self.text[b]) == [a, b]
        return known

    def merge(self, word: str) -> list[int]:
        """Ids of one word, given as characters of its bytes."""
        s = word + WORD_END if self.suffix else word
        n = len(s)
        longest = [-1] * (n + 1)
        for end, (size, token) in self.automaton.iter(s):
            longest[end - size + 1] = token  # later ends are longer
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0 and (dead[at + self.length[token]] or out and not self.compatible(out[-1], token)):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.length[token]
                token = longest[at]
            elif out:
                dead[at] = 1
                last = out.pop()
                at -= self.length[last]
                token = self.shorter[last]
            else:
                raise ValueError("the vocabulary does not cover this word")
        return out

    def _pieces(self, text: str) -> Iterator[bytes]:
        if not _OTHER.search(text):
            yield b"".join(map(self.words.__getitem__, _WORDS.findall(text.lower())))
            return
        normal = self.library.normalizer.normalize_str(text)
        for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
            yield self.words[word.translate(self._back).encode("latin-1").decode()]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for i, piece in enumerate(self._cut.split(text)):
            if i % 2:
                out.append(self.added[piece].to_bytes(4, "little"))
            else:
                for stretch in stretches(piece):
                    out.extend(self._pieces(stretch))
        return b"".join(out)

    def decode(self, ids: bytes) -> Iterator[bytes]:
        """The text of the ids, in stretches."""
        every = np.frombuffer(ids, "<u4")
        for a in range(0, len(every), DECODED):
            some = every[a : a + DECODED]
            start = self.offset[some]
            size = self.offset[some.astype(np.int64) + 1] - start
            ends = np.cumsum(size)
            at = np.repeat(start - ends + size, size) + np.arange(ends[-1])
            out = self.block[at].tobytes()
            yield out if a else out[1:]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a file, once in each Python process."""
    return Encoder(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of every text, an array of longs (empty for null)."""
    return _with_column(docs, ids, "array<bigint>", pa.list_(pa.int64()), text, lambda x: np.frombuffer(encoder(path).encode(x.as_py() or ""), "<u4").astype(np.int64))


def decode(rows: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text that the ids stand for (empty for null)."""
    return _with_column(rows, text, "string", pa.string(), ids, lambda x: b"".join(encoder(path).decode(np.array(x.as_py() or [], "<u4").tobytes())).decode())


def _with_column(df: DataFrame, name: str, kind: str, arrow: pa.DataType, of: str, fn) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"the table has a column {name} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([fn(x) for x in part.column(of)], arrow)], names=[*part.schema.names, name])

    wide = df.withColumn(name, F.lit(None).cast(kind)).schema
    return df.mapInArrow(run, wide)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; ids and texts stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in chunks([batch], "text"):
                n, ids, texts = [], [], []
                for x in part.column("text"):
                    found = own.encode(x.as_py() or "")
                    seen = hashlib.sha256()
                    for piece in own.decode(found):
                        seen.update(piece)
                    n.append(len(found) // 4)
                    ids.append(hashlib.sha256(found).hexdigest())
                    texts.append(seen.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
