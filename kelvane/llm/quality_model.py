"""Quality classifier: a generalised additive model with pairwise interactions, by cyclic boosting of shallow trees.

Each feature of a text (lengths, shares of symbols, capitals, repetition, line endings) is cut into bins at the sample's
quantiles, and has a lookup table of one number a bin. Boosting goes round the features: a tree of a few leaves over one
feature's bins is fitted to the gradient of the log loss, and a small part of it is added to that feature's table, so that no
feature takes what another explains. Then pairs of features are ranked by how much a cut in both explains of what is left, and
the best pairs get tables of two dimensions by the same rounds. A text's score is the logistic function of the tables' sum.

The model is an average over ``BAGS`` bags, each fitted by a task of its own, which stops by the loss on rows that the bag sets
aside. Pairs are chosen by all bags together. The bags share one sample of labelled rows, the first ``SAMPLE_ROWS`` ids by a
hash: features only are kept of them. Scoring is one pass over the texts: bins by search, tables by lookup, sums.

Defined cases: a null text counts as an empty one, whose features are zeros and which is scored like any other; texts of any
length are read whole; labels that are neither 0 nor 1 and labels without id are left out, of several labels of an id the
least counts, and of rows that repeat a labelled id the one with the least features is learned from; without labelled rows
the score is 0.5 and with labels of one kind it is their share, smoothed, both with a warning; an empty table gives an empty
result; a value on a cut belongs to the bin above it; equal gains go to the first cut and feature; rows keep their columns, and
an added column whose name is taken gets an underscore behind it.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ._common import discard, free_name, materialise, table
from ._text import LINES, SPACE_WORDS, U, buffer_of, mix, ngram_hashes, slices, span_hashes, word_spans

FOLDS = 5
#: Labelled rows that the model is fitted on at most.
SAMPLE_ROWS = 20_000
BAGS, BINS, PAIR_BINS, PAIRS = 8, 32, 8, 6
#: Rounds at most, rounds without a lower loss after which a bag stops, the part of a tree that is added, its leaves.
ROUNDS, PATIENCE, RATE, LEAVES = 300, 25, 0.1, 4
#: Rows on either side of a cut at least, and what is added to a leaf's curvature.
LEAST_ROWS, RIDGE = 4, 1.0
#: Share of the sample that a bag sets aside.
ASIDE = 0.15
THRESHOLD = 0.3
FEATURES = ("words", "word_size", "long_word", "symbols", "capitals", "digits", "marks", "stops", "distinct", "repeated", "repeated_lines", "line_size", "closed_lines", "marked_words", "wide", "short_words")


def _flags(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(chars)] = 1
    return t


_SYMBOL, _UPPER, _DIGIT = _flags(b"#*$%&|<>"), _flags(bytes(range(65, 91))), _flags(bytes(range(48, 58)))
_MARK, _STOP, _WIDE = _flags(b"!?:;=/\\@_{}[]()+~^\"'`-"), _flags(b".,"), _flags(bytes(range(128, 256)))
_LETTER = _UPPER | _flags(bytes(range(97, 123))) | _flags(bytes(range(192, 256)))
_LEAD = 1 - _flags(bytes(range(128, 192)))
_CLOSE = _flags(b".!?")


def _apart(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ (rows.astype(np.uint64) * U(0x9E3779B97F4A7C15)))


def features(texts: pa.Array) -> np.ndarray:
    """texts x FEATURES."""
    buf, off = buffer_of(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    for i, j in slices(off):
        b, o, n = buf[off[i] : off[j]], off[i : j + 1] - off[i], j - i
        if not len(b):
            continue

        def held(flags, b=b, o=o):
            sums = np.concatenate(([0], np.cumsum(flags[b])))
            return sums[o[1:]] - sums[o[:-1]]

        starts, ends, rows = word_spans(b, o, SPACE_WORDS)
        words = np.bincount(rows, minlength=n)
        per = np.maximum(words, 1)
        lead = np.concatenate(([0], np.cumsum(_LEAD[b])))
        size = lead[ends] - lead[starts]
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, rows, size)
        h = span_hashes(b, starts, ends, False)
        kinds = np.unique(_apart(rows, h), return_index=True)[1]
        again = np.zeros(len(h), bool)
        if len(h) >= 3:
            at = np.flatnonzero(rows[2:] == rows[:-2])
            _, which, times = np.unique(_apart(rows[at], ngram_hashes(h, 3)[at]), return_inverse=True, return_counts=True)
            for k in range(3):
                again[at[times[which] > 1] + k] = True
        l0, l1, lrow = word_spans(b, o, LINES)
        lines = np.bincount(lrow, minlength=n)
        first = np.unique(_apart(lrow, span_hashes(b, l0, l1, False)), return_index=True)[1]
        x = out[i:j]
        x[:, 0] = np.log1p(words)
        x[:, 1] = np.bincount(rows, size, n) / per
        x[:, 2] = np.log1p(longest)
        for k, flags in ((3, _SYMBOL), (5, _DIGIT), (6, _MARK), (7, _STOP)):
            x[:, k] = held(flags) / per
        letters = np.maximum(held(_LETTER), 1)
        x[:, 4] = held(_UPPER) / letters
        x[:, 8] = np.bincount(rows[kinds], minlength=n) / per
        x[:, 9] = np.bincount(rows[again], minlength=n) / per
        x[:, 10] = (lines - np.bincount(lrow[first], minlength=n)) / np.maximum(lines, 1)
        x[:, 11] = np.log1p(words / np.maximum(lines, 1))
        x[:, 12] = np.bincount(lrow, _CLOSE[b[l1 - 1]], n) / np.maximum(lines, 1)
        x[:, 13] = np.bincount(rows, (_SYMBOL | _MARK)[b[ends - 1]], n) / per
        x[:, 14] = held(_WIDE) / np.maximum(o[1:] - o[:-1], 1)
        x[:, 15] = np.bincount(rows, size <= 3, n) / per
    return out


def cuts_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner cuts of each column at its quantiles, without repeats."""
    return [np.unique(np.quantile(c, np.arange(1, bins) / bins, method="higher")) if len(c) else np.empty(0) for c in x.T]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)]).astype(np.int16)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins; a cut at k leaves bins before k on the left."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(gl):
        return 0.0, 0
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain = np.where((nl >= LEAST_ROWS) & (nr >= LEAST_ROWS), gain, 0)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A tree of at most ``leaves`` leaves over one feature's bins (their gradients, curvatures, rows): a value a bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(_best_cut(g[a:z], h[a:z], n[a:z]), a, z) for a, z in parts]
        (gain, k), a, z = max(found, key=lambda x: x[0][0])
        if gain <= 1e-12:
            break
        at = parts.index((a, z))
        parts[at : at + 1] = [(a, a + k), (a + k, z)]
    out = np.empty(len(g))
    for a, z in parts:
        out[a:z] = g[a:z].sum() / (h[a:z].sum() + RIDGE)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree of a cut in one feature and a cut in the other on each side, over a grid of bins: gain, and a value a cell."""
    best, value = 0.0, np.full(g.shape, g.sum() / (h.sum() + RIDGE))
    for turned in (False, True):
        gg, hh, nn = (x.T if turned else x for x in (g, h, n))
        for k in range(1, len(gg)):
            gain, out = -(g.sum() ** 2) / (h.sum() + RIDGE), np.empty(gg.shape)
            for side in (slice(0, k), slice(k, None)):
                a, b, c = gg[side].sum(axis=0), hh[side].sum(axis=0), nn[side].sum(axis=0)
                if c.sum() < LEAST_ROWS:
                    gain = -np.inf
                    break
                more, at = _best_cut(a, b, c)
                gain += more + a.sum() ** 2 / (b.sum() + RIDGE)
                out[side] = a.sum() / (b.sum() + RIDGE)
                if more > 1e-12:
                    out[side, :at] = a[:at].sum() / (b[:at].sum() + RIDGE)
                    out[side, at:] = a[at:].sum() / (b[at:].sum() + RIDGE)
            if gain > best + 1e-12:
                best, value = gain, out.T if turned else out
    return best, value


def _loss(y: np.ndarray, s: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, s) - y * s)) if len(y) else 0.0


def boost(cells: list[np.ndarray], sizes: list[int], y: np.ndarray, start: np.ndarray, aside: np.ndarray, fit, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Tables, one for each column of ``cells`` (a row's place in the table), by rounds over the columns; ``fit``: (column, sums) to a tree.

    The tables are those of the round with the least loss on the rows set ``aside``.
    """
    tables, s, on = [np.zeros(k) for k in sizes], start.copy(), ~aside
    counts = [np.bincount(c[on], minlength=k).astype(float) for c, k in zip(cells, sizes, strict=True)]
    held = aside if aside.any() else on
    best, kept, since = _loss(y[held], s[held]), [t.copy() for t in tables], 0
    for _ in range(rounds):
        for k, c in enumerate(cells):
            p = 1 / (1 + np.exp(-s[on]))
            g, h = np.bincount(c[on], y[on] - p, sizes[k]), np.bincount(c[on], p * (1 - p), sizes[k])
            step = RATE * fit(k, g, h, counts[k])
            tables[k] += step
            s += step[c]
        loss = _loss(y[held], s[held])
        if loss < best - 1e-6:
            best, kept, since = loss, [t.copy() for t in tables], 0
        elif (since := since + 1) >= PATIENCE:
            break
    return kept


@dataclass
class Model:
    """base plus a table a feature, plus a table a pair of features (by coarser bins)."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    @classmethod
    def constant(cls, share: float) -> "Model":
        none = [np.empty(0)] * len(FEATURES)
        return cls(float(np.log(share / (1 - share))), none, [np.zeros(1)] * len(FEATURES), none, [], [])

    def raw(self, x: np.ndarray) -> np.ndarray:
        at, wide = binned(x, self.cuts), binned(x, self.coarse)
        out = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            out += t[at[:, k]]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[wide[:, a].astype(int) * (len(self.coarse[b]) + 1) + wide[:, b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


class _Bag:
    """A bag's view of the sample: all bags have the same rows and cuts, and set other rows aside."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["hash", "quality"], kind="stable")  # whatever order they come in
        self.x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
        self.y = rows["quality"].to_numpy(float)
        self.bag = int(rows["bag"].iloc[0])
        self.base = float(np.log((self.y.sum() + 1) / (len(self.y) - self.y.sum() + 1)))
        self.cuts, self.coarse = cuts_of(self.x, BINS), cuts_of(self.x, PAIR_BINS)
        self.aside = np.random.default_rng(self.bag).random(len(self.y)) < ASIDE

    def mains(self, rounds: int) -> list[np.ndarray]:
        at = binned(self.x, self.cuts)
        return boost(list(at.T), [len(c) + 1 for c in self.cuts], self.y, np.full(len(self.y), self.base), self.aside, lambda _, g, h, n: tree(g, h, n), rounds)

    def grids(self, pairs) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
        at = binned(self.x, self.coarse).astype(int)
        shapes = [(len(self.coarse[a]) + 1, len(self.coarse[b]) + 1) for a, b in pairs]
        return [at[:, a] * w + at[:, b] for (a, b), (_, w) in zip(pairs, shapes, strict=True)], shapes

    def start(self, tables: list[np.ndarray]) -> np.ndarray:
        return Model(self.base, self.cuts, tables, self.coarse, [], []).raw(self.x)

    def strengths(self, tables: list[np.ndarray]) -> dict[tuple[int, int], float]:
        """What one tree over a pair's grid explains beyond one tree over each of its features, on what the tables leave."""
        s, on = self.start(tables), ~self.aside
        p = 1 / (1 + np.exp(-s[on]))
        g, h = self.y[on] - p, p * (1 - p)
        pairs = [(a, b) for a in range(len(FEATURES)) for b in range(a + 1, len(FEATURES))]
        cells, shapes = self.grids(pairs)
        out = {}
        for pair, c, (v, w) in zip(pairs, cells, shapes, strict=True):
            sums = [np.bincount(c[on], z, v * w).reshape(v, w) for z in (g, h, np.ones(on.sum()))]
            alone = max(_best_cut(*(z.sum(axis=axis) for z in sums))[0] for axis in (0, 1))
            out[pair] = pair_tree(*sums)[0] - alone
        return out

    def pair_tables(self, pairs, tables: list[np.ndarray], rounds: int) -> list[np.ndarray]:
        cells, shapes = self.grids(pairs)
        fit = lambda k, g, h, n: pair_tree(*(z.reshape(shapes[k]) for z in (g, h, n)))[1].ravel()
        return boost(cells, [v * w for v, w in shapes], self.y, self.start(tables), self.aside, fit, rounds)


_OUT = "kind string, bag int, a int, b int, value array<double>"


def _rows(kind: str, bag: int, tables: dict) -> pd.DataFrame:
    return pd.DataFrame([(kind, bag, a, b, [float(x) for x in np.ravel(t)]) for (a, b), t in tables.items()], columns=["kind", "bag", "a", "b", "value"])


def fit(sample: DataFrame, bags: int = BAGS, pairs: int = PAIRS, rounds: int = ROUNDS) -> Model:
    """sample: hash (long), quality (0 or 1), x (array of FEATURES); a bounded number of rows, of which each bag's task has all."""
    n, good = sample.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if good in (0, n):
        warnings.warn(f"{n} labelled rows, {good} of quality 1: the score is a constant", stacklevel=2)
        return Model.constant((good + 1) / (n + 2))
    dealt = sample.select("hash", "quality", "x", F.explode(F.array(*map(F.lit, range(bags)))).alias("bag"))

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        bag = _Bag(rows)
        tables = bag.mains(rounds)
        cuts = {(k, w): c for w, cs in enumerate((bag.cuts, bag.coarse)) for k, c in enumerate(cs)}
        parts = [_rows("main", bag.bag, {(k, -1): t for k, t in enumerate(tables)}), _rows("strength", bag.bag, bag.strengths(tables))]
        return pd.concat(parts + [_rows("cuts", bag.bag, cuts), _rows("base", bag.bag, {(-1, -1): [bag.base]})] if bag.bag == 0 else parts)

    # A few hundred short rows.
    found: dict = {}
    for r in dealt.groupBy("bag").applyInPandas(first, _OUT).collect():
        found.setdefault(r["kind"], {})[r["bag"], r["a"], r["b"]] = np.array(r["value"])
    cuts, coarse = ([found["cuts"][0, k, w] for k in range(len(FEATURES))] for w in (0, 1))
    by_bag = [[found["main"][g, k, -1] for k in range(len(FEATURES))] for g in range(bags)]
    total: dict = {}
    for (_, a, b), v in sorted(found["strength"].items()):
        total[a, b] = total.get((a, b), 0.0) + float(v[0])
    chosen = [p for p in sorted(total, key=lambda p: (-total[p], p))[:pairs] if total[p] > 1e-9]
    averaged: list[np.ndarray] = []
    if chosen:

        def second(rows: pd.DataFrame) -> pd.DataFrame:
            bag = _Bag(rows)
            return _rows("pair", bag.bag, dict(zip(chosen, bag.pair_tables(chosen, by_bag[bag.bag], rounds), strict=True)))

        got = {(r["bag"], r["a"], r["b"]): np.array(r["value"]) for r in dealt.groupBy("bag").applyInPandas(second, _OUT).collect()}
        averaged = [np.mean([got[g, *p] for g in range(bags)], axis=0) for p in chosen]
    mains = [np.mean([t[k] for t in by_bag], axis=0) for k in range(len(FEATURES))]
    return Model(float(found["base"][0, -1, -1][0]), cuts, mains, coarse, chosen, averaged)


def held_out(doc_id: str) -> "F.Column":
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def sample_of(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(hash, quality, x) of the first ``rows`` labelled ids by hash that have a text; docs: doc_id, text."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    there = known.join(docs.where("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # a top-k by hash, before any text is read

    def run(batches):
        for batch in batches:
            x = features(batch.column(2))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["hash", "quality", "x"])

    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ``rows`` ids at most
    return texts.select(F.xxhash64("doc_id").alias("hash"), F.col("quality").cast("long").alias("quality"), F.col("text").cast("string").alias("text")).mapInArrow(run, "hash long, quality long, x array<double>").groupBy("hash", "quality").agg(F.min("x").alias("x"))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, **options) -> Model:
    """docs: doc_id, text; labels: doc_id, quality."""
    sample = materialise(sample_of(docs, labels, rows), "sample")
    model = fit(sample, **options)
    discard(sample)
    return model


def classify(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus score and predicted."""
    at, name = docs.columns.index(text), free_name(docs, "score")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(features(batch.column(at))))], names=[*batch.schema.names, name])

    out = docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))
    return out.withColumn(free_name(out, "predicted"), (F.col(name) >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = ~held_out("doc_id")
    model = train(docs.where(learned), table(spark, sf_dir, "labels").where(learned))
    return classify(docs.withColumn("held_out", held_out("doc_id")), model).drop("text")
