"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of an item (all words of a shorter one); it must stand in a document whole.
So a document can hold it only if it holds the window's rarest word, counted over all documents: that word is the
whole prefix, as all words are required. Each occurrence of a prefix word proposes the windows it is the prefix of;
its offset in the window fixes where the window would start, which must leave room for it in the document; then the
window is verified at that place: by a hash of its words first, and what passes word by word.

The benchmark may be of any size. One of ``INDEX_BYTES`` at most is made an index that each task holds. Beyond, nothing
but bit tables of fixed size goes through the driver: one scan counts the words that the benchmark has, items choose
their windows' prefix words in tasks, and one scan of the different texts proposes windows, which meet the benchmark's in
a join on prefix word, offset, length and the words themselves. Passages that many texts hold are salted there.

Defined cases: null texts and those without words hit nothing and are not contaminated; an empty benchmark finds
nothing; repeated items count as one by id; item ids are reported sorted as strings; rows that repeat whole are
reported each; an added column whose name is taken gets an underscore behind it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, LongType, StringType, StructType

from ._common import discard, free_name, materialise, table
from ._text import ALNUM_WORDS, U, buffer_of, mix, ngram_hashes, slices, span_hashes, word_spans

WIDTH = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Bytes of benchmark text up to which its index is held by each task (some 50 bytes of index a byte of text).
INDEX_BYTES = 1 << 20
#: Bits of the tables of words and of (prefix word, offset, length): they thin out what is shuffled, and decide nothing.
WORD_BITS, ANCHOR_BITS = 23, 26
#: Parts into which the texts of one window are dealt in joins.
SALTS = 32
#: Columns that a search adds.
FOUND = ("n_words", "hit_starts", "hit_ends", "hit_items")
BITS = 20


def _words(texts: pa.Array):
    buf, off = buffer_of(texts)
    for i, j in slices(off):
        b, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, rows = word_spans(b, o, ALNUM_WORDS)
        yield i, j, span_hashes(b, starts, ends, True), rows, (b, starts, ends)


def _lower(chars: np.ndarray) -> bytes:
    """Bytes with A-Z lower-cased (bytes.lower leaves all others as they are)."""
    return chars.tobytes().lower()


class _Set:
    """Membership in a sorted array of hashes: a bit table first, then a binary search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[(self.values >> U(64 - BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of members in ``h``, and their places in ``values``."""
        at = np.flatnonzero(self.bits[(h >> U(64 - BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.values, h[at]), max(len(self.values) - 1, 0))
        ok = self.values[place] == h[at] if len(self.values) else np.zeros(0, bool)
        return at[ok], place[ok]


class Index:
    """Windows of a small benchmark: their hash, length, items, and the rarest word with its offset."""

    def __init__(self, ids: list[str], texts: pa.Array, width: int = WIDTH):
        self.width, windows = width, {}
        self.words: list[np.ndarray] = []
        for i, j, words, rows, (b, starts, ends) in _words(texts):
            for r in range(j - i):
                own = slice(int(np.searchsorted(rows, r)), int(np.searchsorted(rows, r, "right")))
                w = words[own]
                n = min(width, len(w))
                spelt = [_lower(b[x:y]) for x, y in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
                for k, h in enumerate(ngram_hashes(w, n).tolist() if n else ()):
                    windows.setdefault((n, tuple(spelt[k : k + n])), (w[k : k + n], [], h))[1].append(ids[i + r])
        self.windows = windows
        self.vocabulary = _Set(np.unique(np.concatenate([w for w, _, _ in windows.values()])) if windows else np.empty(0, np.uint64))

    def order(self, counts: np.ndarray) -> None:
        """Choose each window's prefix; counts: of the vocabulary in all documents."""
        rows = []
        for (n, _), (w, _, h) in self.windows.items():
            c = counts[np.searchsorted(self.vocabulary.values, w)]
            k = int(np.lexsort((np.arange(n), w, c))[0])
            rows.append((int(w[k]), k, n, h))
        order = sorted(range(len(rows)), key=lambda x: rows[x])
        rows = [rows[x] for x in order]
        keys = list(self.windows)
        self.items = [sorted(set(self.windows[keys[x]][1])) for x in order]
        self.spelt = [keys[x][1] for x in order]
        self.prefix = np.array([r[0] for r in rows], np.uint64)
        self.offset, self.length = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        self.hash = np.array([r[3] for r in rows], np.uint64)
        self.anchors = _Set(self.prefix)
        self.from_ = np.searchsorted(self.prefix, self.anchors.values)
        self.many = np.searchsorted(self.prefix, self.anchors.values, "right") - self.from_
        self.lengths = sorted(set(self.length.tolist()))
        del self.windows

    def search(self, words: np.ndarray, rows: np.ndarray, n_rows: int, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Starts (in ``words``) and numbers of all windows that stand in a row."""
        at, place = self.anchors.find(words)
        many = self.many[place]
        win = np.repeat(self.from_[place], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start = np.repeat(at, many) - self.offset[win]
        row = np.repeat(rows[at], many)
        first = np.searchsorted(rows, np.arange(n_rows + 1))
        room = (start >= first[row]) & (start + self.length[win] <= first[row + 1])
        start, win = start[room], win[room]
        true = np.zeros(len(win), bool)
        for n in self.lengths:
            own = np.flatnonzero(self.length[win] == n)
            if len(own):
                h = np.zeros(len(own), np.uint64)
                for k in range(n):
                    h = h * U(0x9E3779B97F4A7C15) + words[start[own] + k]
                true[own] = mix(h) == self.hash[win[own]]
        b, starts, ends = spans
        for x in np.flatnonzero(true).tolist():  # few: exactly the words of a window, but for hashes that collide
            at = slice(int(start[x]), int(start[x] + self.length[win[x]]))
            true[x] = all(_lower(b[lo:hi]) == w for lo, hi, w in zip(starts[at].tolist(), ends[at].tolist(), self.spelt[win[x]], strict=True))
        return start[true], win[true]


def build_index(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> Index:
    """Index of items, which the caller bounds, with word counts over all documents."""
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").toArrow()
    index = Index(rows.column("i").to_pylist(), rows.column("t").combine_chunks(), width)
    vocabulary = index.vocabulary

    def count(batches):
        n = np.zeros(len(vocabulary.values), np.int64)
        for batch in batches:
            for _, _, words, _, _ in _words(batch.column(0)):
                n += np.bincount(vocabulary.find(words)[1], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(n[at])], names=["place", "n"])

    counts = np.zeros(len(vocabulary.values), np.int64)
    found = docs.select(text).mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # at most the index's vocabulary
    counts[found.column("place").to_numpy()] = found.column("n").to_numpy()
    index.order(counts)
    return index


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals that come sorted by start."""
    reach = np.maximum.accumulate(ends)
    new = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[new], reach[np.r_[new[1:] - 1, len(reach) - 1]]


def find(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """``docs`` plus n_words, hit_starts, hit_ends (word spans, disjoint) and hit_items."""
    at = docs.columns.index(text)
    added = [free_name(docs, x) for x in FOUND]

    def run(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            s, e, items = ([[] for _ in range(batch.num_rows)] for _ in range(3))
            for i, j, words, rows, spans in _words(batch.column(at)):
                n[i:j] = np.bincount(rows, minlength=j - i)
                start, win = index.search(words, rows, j - i, spans)
                if not len(start):
                    continue
                order = np.argsort(start, kind="stable")
                start, win = start[order], win[order]
                row = rows[start]
                for r in np.unique(row).tolist():
                    own = slice(*np.searchsorted(row, [r, r + 1]))
                    base = np.searchsorted(rows, r)
                    a, b = _spans(start[own] - base, start[own] - base + index.length[win[own]])
                    s[i + r], e[i + r] = a.tolist(), b.tolist()
                    items[i + r] = sorted({x for w in set(win[own].tolist()) for x in index.items[w]})
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(s, kind), pa.array(e, kind), pa.array(items, pa.list_(pa.string()))], names=[*batch.schema.names, *added])

    schema = StructType([*docs.schema.fields])
    for name, kind in zip(added, (LongType(), ArrayType(LongType()), ArrayType(LongType()), ArrayType(StringType())), strict=True):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


class _Bits:
    """Membership in a set of hashes of any size, by one bit for their leading bits: no member is missed."""

    def __init__(self, hashes: DataFrame, column: str, bits: int):
        self.shift, self.table = U(64 - bits), np.zeros(1 << (bits - 6), np.uint64)
        place = f"shiftrightunsigned({column}, {64 - bits})"
        rows = hashes.groupBy(F.expr(f"shiftright({place}, 6)").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({place} & 63 AS int)))").alias("bits")).toArrow()  # 2 ** (bits - 6) rows at most
        self.table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        place = h >> self.shift
        return (self.table[(place >> U(6)).astype(np.int64)] >> (place & U(63)) & U(1)).astype(bool)


def _anchor(prefix: np.ndarray, offset, n) -> np.ndarray:
    """One hash of a prefix word, its offset and its window's length."""
    return mix(prefix + U(0x9E3779B97F4A7C15) * ((np.atleast_1d(offset) << 16) + n).astype(np.uint64))


def _spelt(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Lower-cased words, joined by a space."""
    return b" ".join(_lower(b[x:y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True))


def _longs(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _item_words(batches):
    for batch in batches:
        key = batch.column(0).to_pylist()
        for i, j, words, rows, _ in _words(batch.column(1)):
            for r in range(j - i):
                h = np.unique(words[slice(*np.searchsorted(rows, [r, r + 1]))])
                yield pa.RecordBatch.from_arrays([pa.array([key[i + r]] * len(h), pa.string()), _longs(h)], names=["item_key", "h"])


def _windows(width: int):
    """Windows of items that come as (id, text, hashes and counts of their words), each with its rarest word."""

    def run(batches):
        for batch in batches:
            ids, known = batch.column(0).to_pylist(), batch.column(2)
            for i, j, words, rows, (b, starts, ends) in _words(batch.column(1)):
                for r in range(j - i):
                    own = slice(*np.searchsorted(rows, [r, r + 1]))
                    w, n = words[own], min(width, own.stop - own.start)
                    if not n:
                        continue
                    counted = known[i + r].values
                    h, c = counted.field("h").to_numpy().view(np.uint64), counted.field("n").to_numpy()
                    order = np.lexsort((h, c))
                    rank = np.empty(len(h), np.int64)
                    rank[order] = np.arange(len(h))
                    by = np.argsort(h)
                    at = rank[by[np.searchsorted(h, w, sorter=by)]]
                    k = np.lib.stride_tricks.sliding_window_view(at, n).argmin(1)
                    line = _spelt(b, starts[own], ends[own])
                    cut = np.r_[0, np.cumsum(ends[own] - starts[own] + 1)]
                    prefix = w[np.arange(len(k)) + k]
                    spelt = [line[x : y - 1] for x, y in zip(cut[: len(k)].tolist(), cut[n:].tolist(), strict=True)]
                    many = np.full(len(k), n, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [_longs(prefix), pa.array(k), pa.array(many), _longs(_anchor(prefix, k, many)), pa.array(spelt).cast(pa.string()), pa.array([ids[i + r]] * len(k), pa.string())],
                        names=["prefix", "k", "n", "anchor", "words", "item"],
                    )

    return run


def _proposals(prefixes: _Bits, anchors: _Bits, lengths: list[int]):
    """Places of texts (key, text) at which a window may stand by its prefix word, that word's offset, and room in the text."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, j, words, rows, (b, starts, ends) in _words(batch.column(1)):
                at = np.flatnonzero(prefixes.has(words))
                first = np.searchsorted(rows, np.arange(j - i + 1))
                for n in lengths:
                    for k in range(n):
                        start = at - k
                        row = rows[at]
                        ok = (start >= first[row]) & (start + n <= first[row + 1])
                        start, row, own = start[ok], row[ok], at[ok]
                        ok = anchors.has(_anchor(words[own], k, n))
                        start, row, own = start[ok], row[ok], own[ok]
                        if not len(start):
                            continue
                        spelt = [_spelt(b, starts[x : x + n], ends[x : x + n]) for x in start.tolist()]
                        same = np.full(len(start), n, np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([keys[i + r] for r in row.tolist()], pa.string()), pa.array(start - first[row]), _longs(words[own]), pa.array(np.full(len(start), k, np.int64)), pa.array(same), pa.array(spelt).cast(pa.string())],
                            names=["row_key", "start", "prefix", "k", "n", "words"],
                        )

    return run


def _count_words(bits: _Bits):
    def run(batches):
        for batch in batches:
            for _, _, words, _, _ in _words(batch.column(0)):
                h, n = np.unique(words[bits.has(words)], return_counts=True)
                yield pa.RecordBatch.from_arrays([_longs(h), pa.array(n)], names=["h", "n"])

    return run


def _all_salts(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int").alias("salt")


def benchmark_windows(docs: DataFrame, items: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """(prefix, k, n, anchor, words, item): each item's windows, their rarest word in ``docs`` and its offset, by joins."""
    given = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("t")).where("item IS NOT NULL AND t IS NOT NULL").distinct()
    given = materialise(given.select(F.sha2(F.concat_ws("\0", "item", "t"), 256).alias("item_key"), "item", "t"), "items")
    own = materialise(given.select("item_key", "t").mapInArrow(_item_words, "item_key string, h long"), "item-words")
    counts = docs.select(text).mapInArrow(_count_words(_Bits(own, "h", WORD_BITS)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    known = own.select("h").distinct().join(counts, "h", "left").select("h", F.coalesce("n", F.lit(0)).alias("n"))
    ranked = own.withColumn("salt", _salt("item_key")).join(_all_salts(known), ["h", "salt"]).groupBy("item_key").agg(F.collect_list(F.struct("h", "n")).alias("known"))
    out = given.join(ranked, "item_key").select("item", "t", "known").mapInArrow(_windows(width), "prefix long, k long, n long, anchor long, words string, item string")
    out = materialise(out, "windows")
    discard(given)
    discard(own)
    return out


def find_by_join(docs: DataFrame, items: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """What :func:`find` gives, for a benchmark of any size."""
    windows = benchmark_windows(docs, items, text, width)
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())  # as many as a window has words at most
    # Equal texts have equal hits: they are searched once, under a digest of the text.
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    texts = docs.select(digest.alias("row_key"), F.col(text).alias("text")).groupBy("row_key").agg(F.min("text").alias("text"))
    run = _proposals(_Bits(windows, "prefix", WORD_BITS), _Bits(windows, "anchor", ANCHOR_BITS), lengths)
    proposed = materialise(texts.mapInArrow(run, "row_key string, start long, prefix long, k long, n long, words string"), "proposals")
    window = ["prefix", "k", "n", "words"]
    # The windows that texts hold come first, each once; then each is sent to all parts of its texts.
    held = materialise(proposed.select(*window).distinct().join(windows.select(*window).distinct(), window), "held")
    hits = materialise(proposed.select("*", _salt("row_key")).join(_all_salts(held), [*window, "salt"]).select("row_key", "start", "n", "words").distinct(), "hits")
    holders = windows.select("words", "item").distinct().join(held.select("words").distinct(), "words", "left_semi")
    named = hits.select("row_key", "words").distinct().withColumn("salt", _salt("row_key")).join(_all_salts(holders), ["words", "salt"])
    named = named.groupBy("row_key").agg(F.array_sort(F.collect_set("item")).alias("hit_items"))

    def merge(batches):
        for batch in batches:
            out = []
            for spans in batch.column("s").to_pylist():
                pairs = np.array(sorted((x["start"], x["start"] + x["n"]) for x in spans), np.int64)
                out.append([x.tolist() for x in _spans(pairs[:, 0], pairs[:, 1])])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], kind)], names=["row_key", "hit_starts", "hit_ends"])

    spans = hits.groupBy("row_key").agg(F.collect_set(F.struct("start", "n")).alias("s")).mapInArrow(merge, "row_key string, hit_starts array<long>, hit_ends array<long>")
    found = materialise(spans.join(named, "row_key"), "found")
    for used in (windows, proposed, held, hits):
        discard(used)
    key, salt, added = free_name(docs, "row_key"), free_name(docs, "salt"), [free_name(docs, x) for x in FOUND]
    found = _all_salts(found).select(F.col("row_key").alias(key), F.col("salt").alias(salt), *[F.col(x).alias(y) for x, y in zip(FOUND[1:], added[1:], strict=True)])
    plain = [f.name for f in docs.schema.fields if isinstance(f.dataType, AtomicType)]
    out = docs.withColumns({key: digest, salt: _salt(*[f"`{x}`" for x in plain])}).join(found, [key, salt], "left").drop(key, salt)
    at = docs.columns.index(text)

    def count(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for i, j, _, rows, _ in _words(batch.column(at)):
                n[i:j] = np.bincount(rows, minlength=j - i)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], names=[*batch.schema.names, added[0]])

    out = out.mapInArrow(count, StructType([*out.schema.fields]).add(added[0], LongType()))
    lists = [F.coalesce(x, F.array().cast(kind)).alias(x) for x, kind in zip(added[1:], ("array<long>", "array<long>", "array<string>"), strict=True)]
    return out.select(*[F.col(f"`{x}`") for x in docs.columns], added[0], *lists)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH, share: int = SHARE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``docs`` plus n_words, n_hit, hit_starts, hit_ends, hit_items and contaminated."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    out = find(docs, build_index(docs, benchmark, text=text, width=width), text) if total <= index_bytes else find_by_join(docs, benchmark, text, width)
    n_words, starts, ends, _ = (F.col(free_name(docs, x)) for x in FOUND)
    lengths = F.zip_with(starts, ends, lambda a, b: b - a)
    hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    n_hit, contaminated = (free_name(docs, x) for x in ("n_hit", "contaminated"))
    return out.withColumn(n_hit, hit).withColumn(contaminated, (F.col(n_hit) > 0) & (F.col(n_hit) * share >= n_words))


def query(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("hit_items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item, w, least({WIDTH}, len(w)) AS n, unnest(range(1, len(w) - least({WIDTH}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, i, n, item FROM grams JOIN win USING (n, s)),
spot AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS at FROM hit) GROUP BY 1),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND n_hit * {SHARE} >= len(w) AS contaminated
FROM d LEFT JOIN spot USING (r) LEFT JOIN found USING (r)
"""
