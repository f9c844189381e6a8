"""Vectorised scanning of Arrow string columns: words and their 64-bit hashes, without a Python loop per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_pow: list[np.ndarray] = []


def _table(separators) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


#: Words of [^\x20\x09-\x0D]+
SPACE_WORDS = _table([32, *range(9, 14)])
#: Lines, split at \n
LINES = _table([10])
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased: digits, letters and all bytes above ASCII
ALNUM_WORDS = _table([*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xA0761D6478BD642F)
    return h ^ (h >> U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _pow or len(_pow[0]) < n:
        size = max(n, 1 << 18)
        _pow[:] = [np.concatenate(([U(1)], np.multiply.accumulate(np.full(size, b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _pow[0], _pow[1]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give freed memory back to the system: Spark keeps its Python workers from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def slices(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes together; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j
    release()


def word_spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of all words; rows are cut at ``offsets`` (from 0)."""
    n = len(buf)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = is_word[buf]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    cut = offsets[1:] - 1
    after[cut[cut >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, step: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each span's bytes (spans ascending, disjoint), in bounded memory."""
    out = np.empty(len(starts), np.uint64)
    weight = _LOWER if lower else _BYTE
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + step, "right")))
        hi = int(ends[j - 1])
        power, inverse = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(weight[buf[lo:hi]] * power[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows of one long array of word hashes (rows are not told apart)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    k = len(words) - n + 1
    h = np.zeros(k, np.uint64)
    for i in range(n):
        h = h * U(_BASE) + words[i : i + k]
    return mix(h)
