"""Parser of MATLAB level-5 files: their first matrix, without any other library.

A file is a header of 128 bytes and elements, each a tag (type, bytes) and its data; compressed elements hold one
element more. A matrix element holds its flags, dimensions, name and values as elements of their own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Fixed values of the format: element types, and classes of arrays.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
SPARSE, NUMERIC = 5, range(6, 16)
COMPLEX = 0x0800


def _elements(raw: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """Type and data of each element."""
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(order + "II", raw, at)
        if kind >> 16:  # up to four bytes of data stand in the tag itself
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, raw[at + 8 : at + 8 + size]
        at += 8 + (size if kind == COMPRESSED else -(-size // 8) * 8)


def _values(element: tuple[int, bytes], order: str) -> np.ndarray:
    kind, data = element
    if kind not in TYPES:
        raise ValueError(f"element type {kind} holds no numbers")
    return np.frombuffer(data, order + TYPES[kind])


def _matrix(raw: bytes, order: str) -> tuple[tuple[int, int], pd.DataFrame] | None:
    """A sparse or two-dimensional numeric array; None for anything else."""
    parts = _elements(raw, order)
    flags = int(_values(next(parts), order)[0])
    kind = flags & 0xFF
    if kind != SPARSE and kind not in NUMERIC:
        return None
    shape, _name = tuple(int(n) for n in _values(next(parts), order)), next(parts)
    if len(shape) != 2:
        return None
    if flags & COMPLEX:
        raise ValueError("complex matrices are not supported")
    if kind == SPARSE:
        row, starts = (_values(next(parts), order).astype(np.int64) for _ in range(2))
        n = int(starts[-1])  # a file may reserve room for more entries
        col, row, val = np.repeat(np.arange(shape[1]), np.diff(starts)), row[:n], _values(next(parts), order)[:n]
    else:
        grid = _values(next(parts), order).reshape(shape, order="F")
        row, col = np.nonzero(grid)
        val = grid[row, col]
    return shape, pd.DataFrame({"row": row.astype(np.int64), "col": col.astype(np.int64), "val": val.astype(float)})


def first_matrix(raw: bytes) -> tuple[tuple[int, int], pd.DataFrame]:
    """Shape and entries of the first variable that is a sparse or two-dimensional numeric array."""
    mark = raw[126:128]
    if mark not in (b"IM", b"MI"):
        raise ValueError("no MATLAB file of level 5; save newer ones with -v7")
    order = "<" if mark == b"IM" else ">"
    for kind, data in _elements(raw[128:], order):
        if kind == COMPRESSED:
            kind, data = next(_elements(zlib.decompress(data), order))
        if kind == MATRIX and (found := _matrix(data, order)) is not None:
            return found
    raise ValueError("the file holds no matrix")
