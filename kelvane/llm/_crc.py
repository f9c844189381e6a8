"""CRC-32 states of many byte strings at once: a state is carried on over what follows without reading the start again.

The checksum of ``a + b`` is a linear map of a's checksum, which depends on b's length only, xor b's checksum.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

_POLY = 0xEDB88320


def _columns(images: list[int]) -> np.ndarray:
    """Tables of a linear map of 32 bits, one for each byte of the argument, from the images of the single bits."""
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, 1 << bit : 2 << bit] = out[byte, : 1 << bit] ^ np.uint32(images[8 * byte + bit])
    return out


def _apply(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    return t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]


@functools.lru_cache(64)
def _power(k: int) -> np.ndarray:
    """Images of the single bits after 2^k zero bytes."""
    if k:
        before = _power(k - 1)
        return _apply(_columns(before.tolist()), before)
    x = [1 << i for i in range(32)]
    for _ in range(8):
        x = [(v >> 1) ^ (_POLY if v & 1 else 0) for v in x]
    return np.array(x, np.uint32)


@functools.lru_cache(4096)
def _shift(length: int) -> np.ndarray:
    """Tables that carry a checksum over ``length`` bytes."""
    bits = np.array([1 << i for i in range(32)], np.uint32)
    k = 0
    while length:
        if length & 1:
            bits = _apply(_columns(_power(k).tolist()), bits)
        length, k = length >> 1, k + 1
    return _columns(bits.tolist())


def carried(states: np.ndarray, lengths: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """Checksums of what has the checksums ``states``, each followed by ``lengths`` bytes that have the checksums ``crcs``."""
    distinct, which = np.unique(lengths, return_inverse=True)
    tables = np.stack([_shift(int(n)) for n in distinct]) if len(distinct) else np.empty((0, 4, 256), np.uint32)
    x = states.astype(np.uint32)
    out = crcs.astype(np.uint32)
    for byte in range(4):
        out = out ^ tables[which, byte, (x >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


def of_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Checksums of spans of a buffer, one by one: for distinct words."""
    data = buf.tobytes()
    return np.fromiter((zlib.crc32(data[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint32, len(starts))
