"""Byte-level views of Arrow string columns for vectorised text work inside tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: ASCII letters in lower case and all bytes of non-ASCII characters stay; everything else becomes a space.
FOLDED = np.full(256, 0x20, np.uint8)
FOLDED[0x61:0x7B] = FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B, dtype=np.uint8)
FOLDED[0x80:] = np.arange(0x80, 0x100, dtype=np.uint8)

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash step and of its inverse, for the next power of two of positions."""
    one = np.ones(n, np.uint64)
    up, down = one.copy(), one.copy()
    up[1:], down[1:] = _STEP, _BACK
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: equal bytes, equal hash, wherever they stand."""
    up, down = _powers(1 << max(10, int(len(raw)).bit_length()))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def letter_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as maximal runs of letters: start, end and document of each, in order."""
    letter = raw != 0x20
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    cut = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[cut] |= letter[cut]
    ends[cut - 1] |= letter[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def segment_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values[start:end] for each segment (empty ones 0), along axis 0."""
    out = np.zeros((len(start), *values.shape[1:]), np.float64)
    some = np.flatnonzero(end > start)
    if len(some):
        cuts = np.stack([start[some], end[some]], 1).ravel()
        cuts = cuts[:-1] if cuts[-1] >= len(values) else cuts
        out[some] = np.add.reduceat(values, cuts, axis=0, dtype=np.float64)[::2]
    return out
