"""Removal of repeated passages by longest previous factors.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller id, or
earlier in the same one. A start has such an earlier match if its longest previous factor is ``length`` at least,
and that is so if, in suffix order, the previous or the next suffix with a smaller position shares that many bytes.

One suffix array of the whole corpus would not fit anywhere, and only starts whose string occurs twice matter:

1. Every string of ``length`` bytes is filed under its least k-gram (by hash; the first if it occurs again). Equal
   strings have equal keys, so a key that only one stretch of one text has cannot hold a repeat. Texts that equal an
   earlier one are set apart first: all of them goes.
2. The stretches of the other keys are gathered by key, with their bytes; equal ones are folded where they are made,
   and a key with very many stretches is dealt out by its single strings instead, so that no key grows in one task.
3. The suffixes of a batch's stretches, cut at ``length``, are brought into suffix order by prefix doubling. What
   neighbours share there, and each suffix's previous and next smaller position, give its longest previous factor (cut at
   ``length``); a start whose factor is ``length`` long has an earlier match.
4. The strings found are united to spans in each document, and the rest of its bytes is hashed.

Suffixes are compared by their bytes; only the folding of equal stretches and of equal texts goes by hashes (of 64 bits
within a key, and SHA-256). Defined cases: null texts are empty; texts shorter than
``length`` stay whole; of rows that repeat an id and a text none is earlier than the other; rows that repeat an id
with another text are one document whose spans are united; a row without id is left whole and is no source.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._common import materialise, table
from ._text import _BASE, _BYTE, U, _powers, buffer_of, mix, slices

LENGTH = 100
#: Bytes of the k-grams that strings are filed under.
GRAM = 24
#: Stretches of a key beyond which its single strings are dealt out.
HOT = 20_000
#: Ids of equal texts up to which they are sent to the tasks, to be left out early (8 bytes each).
SKIP_IDS = 4_000_000
#: Rows of a text from which its copies find their first row by a broadcast instead of in one task, and one in so many of
#: all rows at least: no more texts than this second number can have so many.
HOT_COPIES, HOT_SHARE = 500, 5_000
#: Bytes of stretches that a task gathers before it folds equal ones.
FOLD_BYTES = 24 << 20
_POS = 20
#: Bytes that are scanned at once.
SLICE = 1 << 18


def cut_suffix_keys(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Numbers in the order of the suffixes at ``at`` cut at ``length``; equal ones have one number. By prefix multiplying.

    Ranks of words of up to 8 bytes become ranks of as many words as fit in one number, and so on; each width is ranked only
    where the next one asks for it.
    """
    bits = max(1, int(len(text)).bit_length())
    times = max(2, 63 // bits)
    widths = [min(8, length)]
    while -(-length // widths[-1]) > times:
        widths.append(times * widths[-1])
    pieces = [*range(0, length - widths[-1], widths[-1]), length - widths[-1]]
    asked = np.zeros(len(text) + 1, bool)
    for k in pieces:
        asked[at + k] = True
    masks = [asked]
    for w in widths[-2::-1]:
        narrower = masks[-1].copy()
        for k in range(1, times):
            narrower[k * w :] |= masks[-1][: len(narrower) - k * w]
        masks.append(narrower)
    masks.reverse()
    place = np.flatnonzero(masks[0])
    word = np.zeros(len(place), np.uint64)
    for k in range(widths[0]):
        word = (word << U(8)) | text[place + k].astype(np.uint64)
    rank = np.zeros(len(text), np.int64)
    rank[place] = np.unique(word, return_inverse=True)[1]

    def joined(place, steps):
        key = rank[place + steps[0]]
        for k in steps[1:]:
            key = key << bits | rank[place + k]
        return key

    for w, mask in zip(widths, masks[1:], strict=False):
        place = np.flatnonzero(mask)
        rank[place] = np.unique(joined(place, [k * w for k in range(times)]), return_inverse=True)[1]
    return joined(at, pieces)


def common_prefixes(text: np.ndarray, at: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """Of the suffixes at ``at``, which stand in suffix order, the bytes that each shares with the one before, ``length`` at most."""
    out = np.zeros(len(at), np.int32)
    equal = key[1:] == key[:-1]
    out[1:][equal] = length
    open_ = np.flatnonzero(~equal) + 1  # unequal ones differ before their ends
    one, two, k = at[open_], at[open_ - 1], 0
    while len(open_):
        same = text[one + k] == text[two + k]
        open_, one, two, k = open_[same], one[same], two[same], k + 1
        out[open_] = k
    return out


def previous_factors(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Longest previous factors of suffixes in suffix order, by their previous and next smaller positions.

    ``shared`` is what each suffix shares with the one before. A pointer that is not yet at a smaller position jumps to where
    the one there points, for all suffixes at once: between a suffix and its pointer all positions are its own or larger.
    """
    n = len(position)
    best = np.zeros(n, np.int32)
    for step in (-1, 1):
        to = np.arange(n, dtype=np.int32) + np.int32(step)
        least = shared.copy() if step < 0 else np.r_[shared[1:], np.zeros(1, np.int32)][:n]
        near = position[:-1] >= position[1:] if step < 0 else position[1:] >= position[:-1]  # the neighbour is not smaller
        todo = np.flatnonzero(near) + (step < 0)
        if n:
            least[0 if step < 0 else -1] = 0
        while len(todo):
            todo = todo[least[todo] > best[todo]]  # who cannot gain any more rests
            way = to[todo]
            own = np.minimum(least[todo], least[way])
            to[todo] = way = to[way]
            inside = (way >= 0) & (way < n)
            own[~inside] = 0
            least[todo] = own
            todo, way = todo[inside], way[inside]
            todo = todo[position[way] >= position[todo]]
        at = np.flatnonzero(least > best)
        at = at[(to[at] >= 0) & (to[at] < n)]
        at = at[position[to[at]] < position[at]]
        best[at] = least[at]
    return best


def earlier_copies(rank: np.ndarray, *position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by rank and position, and whether an equal one stands at an earlier position."""
    order = np.lexsort((*position[::-1], rank))
    f = rank[order]
    new = np.r_[True, f[1:] != f[:-1]]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    found = np.zeros(len(order), bool)
    for p in position:
        own = p[order]
        found |= own != own[first]
    return order, found


def _poly(buf: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all substrings of one width, from those of doubled widths."""
    n = len(buf) - width + 1
    power, out, done, k = _BYTE[buf], None, 0, 1
    while True:
        if width & k:  # the substring's next k bytes
            part = power[done : done + n]
            out = part.copy() if out is None else out * U(pow(_BASE, k, 2**64)) + part
            done += k
        if done == width:
            return out
        power = power[: len(power) - k] * U(pow(_BASE, k, 2**64)) + power[k:]
        k *= 2


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def stretches(buf: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Stretches of starts with one key: row, first start, last start (in the row), key; by chunks of bounded size."""
    step = 1 << (_POS - 2)
    for i, j in slices(off, SLICE):
        chunks = [(i, j, int(off[i]), int(off[j]))]
        if off[j] - off[i] > step:  # one long row
            chunks = [(i, j, lo, min(lo + step + length - 1, int(off[j]))) for lo in range(int(off[i]), int(off[j]) - length + 1, step)] or chunks
        for a, b, lo, hi in chunks:
            if hi - lo < length:
                continue
            g = mix(_poly(buf[lo:hi], gram))
            packed = (g >> U(_POS) << U(_POS)) | np.arange(len(g), dtype=np.uint64)
            at = (_window_min(packed, length - gram + 1) & U((1 << _POS) - 1)).astype(np.int64)
            edges = np.clip(off[a : b + 1], lo, hi) - lo
            inside = np.zeros(len(at) + 1, np.int8)
            s, e = edges[:-1], edges[1:] - length + 1
            ok = e > s
            inside[s[ok]] += 1
            np.add.at(inside, e[ok], -1)
            valid = np.cumsum(inside[:-1], dtype=np.int8) > 0
            new = np.r_[True, at[1:] != at[:-1]]
            new[s[ok]] = True
            begin = np.flatnonzero(new & valid)
            if not len(begin):
                continue
            # A stretch ends where the next begins or its text has no more starts.
            row = np.searchsorted(edges, begin, "right") - 1
            stop = np.minimum(np.r_[begin[1:], len(at)], edges[row + 1] - length + 1)
            base = lo - off[a + row]
            yield a + row, begin + base, stop - 1 + base, g[at[begin]]


def _keys(length: int, gram: int, skip: np.ndarray):
    def run(batches):
        for batch in batches:
            buf, off = buffer_of(batch.column(1))
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            use = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            if len(skip):
                use = use & (skip[np.minimum(np.searchsorted(skip, ids), len(skip) - 1)] != ids)
            for row, _, _, key in stretches(buf, off, length, gram):
                # A text that repeats itself may have very many stretches of one key: they are counted here.
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
                many = np.diff(np.r_[first, len(row)])
                on = use[row[first]]
                at = first[on]
                yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(ids[row[at]]), pa.array(many[on].astype(np.int32))], names=["key", "doc_id", "n"])

    return run


def _repeated(hot: int):
    """Over rows (key, doc_id, n) by key: those of keys with n above one in all; a row without doc_id tells that a key is hot."""

    def run(batches):
        last, n, held = None, 0, None  # the key that ended the last batch, its n so far, its row if that is 1
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            before = n if last == key[0] else 0
            total = np.add.reduceat(batch.column(2).to_numpy().astype(np.int64), first)
            total[0] += before
            keep = np.repeat(total > 1, size)
            if before == 1 and held is not None:
                key, doc, keep = np.r_[held[0], key], np.r_[held[1], doc], np.r_[True, keep]
            reach = np.flatnonzero(total > hot)
            if before > hot:
                reach = reach[reach > 0]
            last, n = batch.column(0)[len(batch.column(0)) - 1].as_py(), int(total[-1])
            held = (key[-1], doc[-1]) if n == 1 else None
            k, d = key[keep], doc[keep]
            if len(reach):
                hot_keys = batch.column(0).to_numpy()[first[reach]]
                yield pa.RecordBatch.from_arrays([pa.array(hot_keys), pa.nulls(len(hot_keys), pa.int64())], names=["key", "doc_id"])
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(d)], names=["key", "doc_id"])

    return run


def _gather(length: int, gram: int, fold_bytes: int):
    """Over rows (doc_id, text, keys, hot_keys): (key, doc_id, start, body) of their stretches, equal ones folded.

    A folded stretch comes without body: an equal one earlier in the order of documents is in the output.
    """

    def fold(parts):
        key, doc, start, size = (np.concatenate([p[k] for p in parts]) for k in range(4))
        bodies = [x for p in parts for x in p[4]]
        mark = np.concatenate([p[5] for p in parts])
        order, found = earlier_copies(mix(mark) ^ mix(key.view(np.uint64) ^ size.astype(np.uint64)), doc, start)
        # A folded stretch needs no company: it goes anywhere.
        away = mix(doc.astype(np.uint64) * U(_BASE) ^ start.astype(np.uint64)).view(np.int64)
        key = key.copy()
        key[order[found]] = away[order[found]]
        body = [None if f else bodies[k] for k, f in zip(order.tolist(), found.tolist(), strict=True)]
        for i in range(0, len(order), 10_000):
            o = order[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(key[o]), pa.array(doc[o]), pa.array(start[o].astype(np.int64)), pa.array(size[o].astype(np.int32)), pa.array(body[i : i + 10_000], pa.binary())], names=["key", "doc_id", "start", "size", "body"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            buf, off = buffer_of(batch.column(1))
            ids = batch.column(0).to_numpy()
            wanted, hot = batch.column(2), batch.column(3)
            lists = [np.sort(x.flatten().to_numpy()) for x in (wanted, hot)]
            # All keys of the batch at once; that another row of it has the key as well does no harm.
            for row, s, e, key in stretches(buf, off, length, gram):
                k = key.view(np.int64)
                isin = [v[np.minimum(np.searchsorted(v, k), len(v) - 1)] == k if len(v) else np.zeros(len(k), bool) for v in lists]
                at = np.flatnonzero(isin[0] | isin[1])
                if not len(at):
                    continue
                row, s, e, k, single = row[at], s[at], e[at], k[at], isin[1][at]
                if single.any():  # a stretch of a hot key becomes one of each of its starts
                    many = np.where(single, e - s + 1, 1)
                    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    row, s, e, k, single = (np.repeat(x, many) for x in (row, s, e, k, single))
                    s = s + step
                    e = np.where(single, s, e)
                lo = off[row] + s
                size = e - s + length
                raw = buf[int(lo.min()) : int((lo + size).max())]
                base = int(lo.min())
                ends = np.zeros(len(raw) + 1, np.uint64)
                power, inverse = _powers(len(raw) + 1)
                np.cumsum(_BYTE[raw] * power[: len(raw)], out=ends[1:])
                mark = (ends[lo - base + size] - ends[lo - base]) * inverse[lo - base]
                k = np.where(single, mix(mark ^ k.view(np.uint64)).view(np.int64), k)
                whole = raw.tobytes()
                parts.append((k, ids[row], s, size, [whole[a : a + m] for a, m in zip((lo - base).tolist(), size.tolist(), strict=True)], mark))
                held += int(size.sum())
                if held > fold_bytes:
                    yield from fold(parts)
                    parts, held = [], 0
        if parts:
            yield from fold(parts)

    return run


def _match(length: int):
    """Over rows (key, doc_id, start, size, body) in that order: spans (doc_id, lo, hi) whose strings start earlier."""

    def run(batches):
        last, seen = None, None  # the key that ended the last batch; its stretches with the first of equal suffixes
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, start, size = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
            has = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            owner, lo, hi = [doc[~has]], [start[~has]], [(start + size)[~has]]
            bodies = batch.column(4).drop_null().to_pylist()
            if last != key[0]:
                seen = None
            if bodies:
                k, d, s, m = key[has], doc[has], start[has], size[has]
                old = 0
                if seen is not None:
                    old = len(seen[3])
                    k, d, s, m = np.r_[np.full(old, last), k], np.r_[seen[0], d], np.r_[seen[1], s], np.r_[seen[2], m]
                    bodies = seen[3] + bodies
                starts = m - length + 1
                offset = np.cumsum(m) - m
                src = np.repeat(np.arange(len(m)), starts)
                step = np.arange(len(src)) - np.repeat(np.cumsum(starts) - starts, starts)
                # Equal strings have equal keys: the suffixes of all keys may stand in one order.
                text, at = np.frombuffer(b"".join(bodies), np.uint8), offset[src] + step
                key_ = cut_suffix_keys(text, at, length)
                place = (np.unique(d, return_inverse=True)[1] << 40)[src] + s[src] + step
                order = np.lexsort((place, key_))
                shared = common_prefixes(text, at[order], key_[order], length)
                flag = np.zeros(len(src), bool)
                flag[order] = previous_factors(place[order], shared) >= length
                first = order[np.flatnonzero(shared < length)]
                flag &= src >= old
                # Neighbouring starts of a stretch that have earlier matches make one span.
                cut = np.flatnonzero(flag & np.r_[True, ~flag[:-1] | (src[1:] != src[:-1])])
                end = np.flatnonzero(flag & np.r_[~flag[1:] | (src[1:] != src[:-1]), True])
                owner.append(d[src[cut]])
                lo.append(s[src[cut]] + step[cut])
                hi.append(s[src[end]] + step[end] + length)
                own = np.unique(src[first])
                own = own[k[own] == key[-1]]
                seen = (d[own], s[own], m[own], [bodies[x] for x in own.tolist()])
            elif last != key[-1]:
                seen = None
            last = int(key[-1])
            owner, lo, hi = (np.concatenate(x) for x in (owner, lo, hi))
            if len(owner):
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(lo), pa.array(hi)], names=["doc_id", "lo", "hi"])

    return run


def _cut(batches):
    """Over rows (doc_id, text, spans): the spans united, and what is left."""
    for batch in batches:
        buf, off = buffer_of(batch.column(1))
        data = memoryview(buf)
        n, removed, count, digest, out_lo, out_hi = [], [], [], [], [], []
        for r, spans in enumerate(batch.column(2)):
            text = data[off[r] : off[r + 1]]
            a = b = np.empty(0, np.int64)
            if spans.is_valid and len(spans):
                v = spans.values
                a, b = v.field("lo").to_numpy(), v.field("hi").to_numpy()
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                a, b = np.minimum(a, len(text)), np.minimum(b, len(text))  # of another text with this id
                a, b = a[a < b], b[a < b]
                if len(a):
                    new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
                    a, b = a[new], b[np.r_[new[1:] - 1, len(b) - 1]]
            h = hashlib.sha256()
            at = 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                h.update(text[at:x])
                at = y
            h.update(text[at:])
            n.append(len(text))
            removed.append(int((b - a).sum()))
            count.append(len(a))
            digest.append(h.hexdigest())
            out_lo.append(a.tolist())
            out_hi.append(b.tolist())
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(digest, pa.string()), pa.array(out_lo, kind), pa.array(out_hi, kind)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "cut_starts", "cut_ends"])


def _copies(meta: DataFrame, rows: int, hot: int = HOT_COPIES) -> DataFrame:
    """(doc_id, n) of the documents whose text an id before theirs has; meta: (doc_id, digest, n) of ``rows`` rows.

    An id with several texts is no copy as a whole, and is left to the search. The rows of a text with very many copies
    stay where they are: there are few such texts.
    """
    firsts = materialise(meta.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("k")).where("k > 1"), "firsts")
    many = F.col("k") > max(hot, rows // HOT_SHARE)
    frequent = firsts.where(many).select("digest", "first")  # fewer than HOT_SHARE rows
    near = meta.join(F.broadcast(frequent), "digest")
    rest = meta.join(F.broadcast(frequent.select("digest")), "digest", "left_anti").join(firsts.where(~many).select("digest", "first"), "digest")
    later = near.select("doc_id", "n", "first").unionByName(rest.select("doc_id", "n", "first")).where("doc_id > first").select("doc_id", "n").distinct()
    several = meta.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id")
    return later.join(several, "doc_id", "left_anti")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: n_bytes, n_removed, n_spans, kept_sha256, and the spans cut (cut_starts, cut_ends)."""
    # An idle alias stays on one side of the joins below, and Spark no longer sees that both read the same exchange.
    plain = (doc_id, text) == ("doc_id", "text") and docs.schema["doc_id"].dataType == LongType()
    rows = docs.select("doc_id", "text") if plain else docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    meta = materialise(known.select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n")), "digests")
    copies = materialise(_copies(meta.where(F.col("n") >= length), meta.count()), "copies")
    few = copies.count() <= SKIP_IDS
    skip = np.unique(np.array(copies.select("doc_id").toArrow().column(0).to_numpy(), np.int64)) if few else np.empty(0, np.int64)
    keys = known.mapInArrow(_keys(length, gram, skip), "key long, doc_id long, n int").repartition("key").sortWithinPartitions("key")
    found = materialise(keys.mapInArrow(_repeated(hot), "key long, doc_id long"), "keys")
    hot_keys = found.where("doc_id IS NULL").select("key", F.lit(True).alias("hot")).distinct()
    rest = found.where("doc_id IS NOT NULL")
    if not few:
        rest = rest.join(copies.select("doc_id").distinct(), "doc_id", "left_anti")
    wanted = rest.join(hot_keys, "key", "left").groupBy("doc_id").agg(F.collect_set(F.when(F.col("hot").isNull(), F.col("key"))).alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot_keys"))
    wanted = materialise(wanted, "wanted")
    keyed = rows.where("doc_id IS NOT NULL")
    bodies = keyed.join(wanted, "doc_id").select("doc_id", "text", "keys", "hot_keys").mapInArrow(_gather(length, gram, FOLD_BYTES), "key long, doc_id long, start long, size int, body binary")
    spans = bodies.repartition("key").sortWithinPartitions("key", "doc_id", "start").mapInArrow(_match(length), "doc_id long, lo long, hi long")
    spans = spans.unionByName(copies.select("doc_id", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")))
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    # Both joins need the texts by id: in one query, Spark deals them out once and reads that twice.
    none = F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("spans")
    cut = keyed.join(by_doc, "doc_id", "left").select("doc_id", "text", "spans").unionByName(rows.where("doc_id IS NULL").select("doc_id", "text", none))
    return cut.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, cut_starts array<long>, cut_ends array<long>")


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("cut_starts", "cut_ends")


#: Every string of LENGTH bytes (in hex digits, cut from parts of texts) with its first place; the places after it, as runs; and the bytes between runs.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT doc_id, o, h[2 * o + 1:2 * o + 2 * (500 + {LENGTH} - 1)] AS p FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 500)) AS o FROM d)),
s AS (SELECT doc_id, o + j AS i, p[2 * j + 1:2 * j + 2 * {LENGTH}] AS s FROM (SELECT doc_id, o, p, unnest(range(len(p) // 2 - {LENGTH} + 1)) AS j FROM part WHERE len(p) >= 2 * {LENGTH})),
f AS (SELECT s, min({{'doc_id': doc_id, 'i': i}}) AS f FROM s GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s JOIN f USING (s) WHERE s.doc_id <> f.f.doc_id OR s.i <> f.f.i),
run AS (SELECT doc_id, i, sum(CASE WHEN i <= before + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit),
span AS (SELECT doc_id, min(i) AS lo, max(i) + {LENGTH} AS hi FROM run GROUP BY doc_id, g),
gap AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM span UNION ALL SELECT doc_id, max(hi), NULL FROM span GROUP BY 1),
kept AS (SELECT doc_id, string_agg(h[2 * a + 1:2 * coalesce(b, len(h) // 2)], '' ORDER BY a) AS k FROM gap JOIN d USING (doc_id) GROUP BY 1),
cut AS (SELECT doc_id, sum(hi - lo) AS n, count(*) AS m FROM span GROUP BY 1)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(m, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
