"""Best-fit packing of documents into sequences of several permitted lengths.

A text counts one token per UTF-8 byte (a byte-level vocabulary) and one end token. A text longer than the
longest sequence is cut into full sequences, each a bin of its own, and a rest. The rests of a group are packed
together, longest first: into the open bin that it fills best, else into a new bin. At the end every bin shrinks to
the shortest permitted length that holds what it got.

What a sequence of ``c`` tokens costs is ``overhead + c + c * c / quadratic``: attention makes long ones dearer by the
token, so that the lengths compete. A new bin takes the length that costs least for each token that it can be expected
to hold: the piece that opens it, and what the pieces that are still to come put into the rest of it (the longest that
fits, again and again, as best fit with falling lengths does). So a long bin is opened only where a short one would not
hold the piece, or would leave a hole that no piece to come can fill.

A group is a task's share of a round-robin deal, bounded by ``group_rows``; keys play no part in it, so that no
key can fill a group. Within the group the order is by length, then id, then piece.

Defined cases: a null text gives no row; an empty text is one end token; a text of any length is packed whole; equal
costs go to the shorter length; repeated rows are packed each; other columns do not matter; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table

#: Permitted sequence lengths, in tokens.
LENGTHS = (2048, 4096, 8192, 16384)
#: What a sequence costs besides its length, and the length at which attention costs as much as all that goes by the token.
OVERHEAD, QUADRATIC = 64, 32768
#: Pieces packed together at most, about.
GROUP_ROWS = 100_000

SCHEMA = "doc_id long, piece int, piece_start long, piece_tokens int, bin long, bin_tokens int, bin_capacity int, bin_offset int"


def cost_of(length, overhead: int = OVERHEAD, quadratic: int = QUADRATIC):
    return overhead + length + length * length / quadratic


def expected_fill(hole: int, left: dict[int, int], present: int) -> int:
    """Tokens that pieces still to come put into a hole, the longest that fits again and again.

    left: their number by size; present: a bit for each size that is left.
    """
    fill = 0
    while fill < hole:
        below = present & ((2 << (hole - fill)) - 1)
        if not below:
            break
        size = below.bit_length() - 1
        fill += size * min(left[size], (hole - fill) // size)
        present = below & ~(1 << size)
    return fill


def pack_lengths(sizes: np.ndarray, lengths=LENGTHS, overhead: int = OVERHEAD, quadratic: int = QUADRATIC) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins and offsets of pieces that come in descending size (1 to the longest length), and the bins' final and opened lengths.

    Open bins stand in stacks by what they have left; a bit set of the stacks in use gives the best fit at once.
    """
    lengths = sorted(lengths)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    filled: list[int] = []
    stacks: dict[int, list[int]] = {}
    in_use, capacity, present = 0, [], 0
    left = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))  # pieces to come, by size
    for size in left:
        present |= 1 << size
    for i, s in enumerate(sizes.tolist()):
        left[s] -= 1
        if not left[s]:
            present ^= 1 << s
        above = in_use >> s
        if above:
            room = s + ((above & -above).bit_length() - 1)
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                in_use ^= 1 << room
        else:
            room = min((c for c in lengths if c >= s), key=lambda c: (cost_of(c, overhead, quadratic) / (s + expected_fill(c - s, left, present)), c))
            b = len(filled)
            filled.append(0)
            capacity.append(room)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += s
        rest = room - s
        if rest:
            stack = stacks.setdefault(rest, [])
            if not stack:
                in_use |= 1 << rest
            stack.append(b)
    return bins, offsets, np.array([next(c for c in lengths if c >= f) for f in filled], np.int64), np.array(capacity, np.int64)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lengths=LENGTHS, overhead: int = OVERHEAD, quadratic: int = QUADRATIC, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: where it starts in its text, its bin, its offset in it, and the bin's fill and length."""
    lengths = tuple(sorted(lengths))
    longest = lengths[-1]
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("n"))
    groups = max(1, -(-rows.count() // group_rows))

    def run(batches):
        task = TaskContext.get().partitionId() << 34
        ids, ns = [], []
        for b in batches:
            ids.append(b.column(0))
            ns.append(b.column(1).to_numpy(zero_copy_only=False))
        if not ns:
            return
        doc, n = pa.chunked_array(ids).combine_chunks(), np.concatenate(ns)
        full, rest = n // longest, n % longest
        out = []
        if full.any():
            at = np.repeat(np.arange(len(n)), full)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full)
            out.append((at, piece, piece * longest, np.full(len(at), longest), np.arange(len(at)), np.full(len(at), longest), np.full(len(at), longest), np.zeros(len(at), np.int64)))
        own = len(out[0][0]) if out else 0
        at = np.flatnonzero(rest)
        if len(at):
            key = doc.fill_null(2**63 - 1).to_numpy(zero_copy_only=False)
            at = at[np.lexsort((full[at], key[at], -rest[at]))]
            bins, offsets, caps, _ = pack_lengths(rest[at], lengths, overhead, quadratic)
            fill = np.bincount(bins, rest[at], len(caps)).astype(np.int64)
            out.append((at, full[at], full[at] * longest, rest[at], bins + own, fill[bins], caps[bins], offsets))
        at, piece, start, size, b, fill, cap, offset = (np.concatenate(x) for x in zip(*out, strict=True))
        for i in range(0, len(at), 50_000):
            j = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays(
                [doc.take(pa.array(at[j])), *(pa.array(x[j].astype(t)) for x, t in ((piece, "int32"), (start, "int64"), (size, "int32"), (b + task, "int64"), (fill, "int32"), (cap, "int32"), (offset, "int32")))],
                names=["doc_id", "piece", "piece_start", "piece_tokens", "bin", "bin_tokens", "bin_capacity", "bin_offset"],
            )

    return rows.repartition(groups).mapInArrow(run, SCHEMA)


def bins(packed: DataFrame) -> DataFrame:
    """The sequences: length, fill and the pieces in their order (each bin holds a bounded number of tokens)."""
    piece = F.struct("bin_offset", "doc_id", "piece_start", "piece_tokens")
    return packed.groupBy("bin").agg(F.first("bin_capacity").alias("bin_capacity"), F.first("bin_tokens").alias("bin_tokens"), F.array_sort(F.collect_list(piece)).alias("pieces"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
