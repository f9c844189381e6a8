"""Quality rules with line labelling by a linear-chain conditional random field.

Base counts of a text (words, symbols, repeated lines and word windows) decide first. Then each line with a word
is labelled content or boilerplate: features of the line give emission scores, neighbouring labels give transition
scores, and Viterbi decoding finds the best labelling of the whole text. The share of words in content lines
decides whether the text is kept.

The field is trained here by gradient ascent on its conditional likelihood (forward-backward), on weak labels of the
lines of labelled texts: at most ``SAMPLE_ROWS`` of them and ``SAMPLE_BYTES`` in all, the first by a hash of their id, without
those of more than ``TEXT_BYTES``. For fitting, chains of more than ``PIECE_LINES`` lines are cut; decoding never cuts.
A line that recurs in documents all over the corpus (counted over all of them), and one without letters or of symbols
mostly, is boilerplate; of the other lines, those of a good text are content, those of a bad one boilerplate. A text
most of whose words stand in recurring lines is a copy of others rather than made of their template, so its lines take
its own label. Without lines of both kinds all lines are content, and a warning says so.

Defined cases: a null or empty text has zero counts and fails the base rule; a text without a line that has a word
has no content; equal scores are content; a text of any length is decoded whole, in memory of its own size; repeated
rows are judged each, and of rows that repeat a labelled id the least text is trained on; rows keep their columns,
and an added column whose name is taken gets an underscore behind it.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructType

from ._common import free_name, materialise, table
from ._text import LINES, SPACE_WORDS, U, buffer_of, mix, ngram_hashes, slices, span_hashes, word_spans

#: Labelled texts that the field is fitted on at most, and their bytes in all.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 16 << 20
#: Bytes of a text that the field is fitted on, and lines of a chain in fitting.
TEXT_BYTES, PIECE_LINES = 1 << 20, 256
#: Share of all documents, and number of them, on which a line must stand at least to be called recurring.
RECURRING, RECURRING_ROWS = 0.001, 3
#: Share of a line's bytes that are symbols or punctuation, from which it is no running text.
NOISY = 0.4
MIN_WORDS = 50
#: Share of words that content lines must hold.
MIN_CONTENT = 0.5
STEPS = 150
CONTENT, BOILERPLATE = 0, 1
FEATURES = 17
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _flags(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int8)
    t[list(chars)] = 1
    return t


_SYMBOL = _flags(b"#*$%&|<>")
_UPPER = _flags(bytes(range(65, 91)))
_DIGIT = _flags(bytes(range(48, 58)))
_PUNCT = _flags(b"!?:;=/\\@_{}[]()+~^\"'`-")
_END = _flags(b".,")
_LETTER = _UPPER | _flags(bytes([*range(97, 123), *range(128, 256)]))
_STOP = _flags(b".!?").astype(float)
_LEAD = np.ones(256, np.int8)
_LEAD[0x80:0xC0] = 0


def _sums(flags: np.ndarray, buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(flags[buf], out=out[1:])
    return out


def _in_row(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes made different between rows."""
    return mix(h ^ (rows.astype(np.uint64) * U(0x9E3779B97F4A7C15)))


def scan(texts: pa.Array):
    """For slices of rows: range, base counts (rows x 5), and the lines with words: row, number in the text, number of words, hash, features, noise."""
    buf, off = buffer_of(texts)
    for i, j in slices(off):
        b, o, n = buf[off[i] : off[j]], off[i : j + 1] - off[i], j - i
        counts = np.zeros((n, len(COUNTS)), np.int64)
        starts, ends, rows = word_spans(b, o, SPACE_WORDS)
        lead, symbols = _sums(_LEAD, b), _sums(_SYMBOL, b)
        counts[:, 0] = np.bincount(rows, minlength=n)
        chars = lead[ends] - lead[starts]
        counts[:, 1] = np.bincount(rows, chars, n).astype(np.int64)
        counts[:, 2] = symbols[o[1:]] - symbols[o[:-1]]
        words = span_hashes(b, starts, ends, False)
        if len(words) >= 3:
            ok = np.flatnonzero(rows[2:] == rows[:-2])
            _, inverse, times = np.unique(_in_row(rows[ok], ngram_hashes(words, 3)[ok]), return_inverse=True, return_counts=True)
            again = ok[times[inverse] > 1]
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[again + k] = True
            counts[:, 4] = np.bincount(rows[covered], minlength=n)
        l0, l1, lrow = word_spans(b, o, LINES)
        first = np.searchsorted(starts, l0)
        width = np.searchsorted(starts, l1) - first
        keep = width > 0
        l0, l1, lrow, first, width = l0[keep], l1[keep], lrow[keep], first[keep], width[keep]
        lines = span_hashes(b, l0, l1, False)
        _, at, same, times = np.unique(_in_row(lrow, lines), return_index=True, return_inverse=True, return_counts=True)
        counts[:, 3] = np.bincount(lrow, minlength=n) - np.bincount(lrow[at], minlength=n)
        breaks = np.concatenate(([0], np.cumsum(b == 10)))
        number = breaks[l0] - breaks[o[lrow]]
        head = np.r_[True, lrow[1:] != lrow[:-1]][: len(lrow)]
        tail = np.r_[lrow[1:] != lrow[:-1], True][: len(lrow)]
        size = np.maximum(l1 - l0, 1)
        upper, digit, punct, end, letter = (_sums(x, b) for x in (_UPPER, _DIGIT, _PUNCT, _END, _LETTER))
        per = lambda s: (s[l1] - s[l0]) / width  # noqa: E731  a word of the line
        closed = np.concatenate(([0], np.cumsum(_SYMBOL[b[ends - 1]] | _PUNCT[b[ends - 1]]))) if len(ends) else np.zeros(1)
        feats = np.column_stack(
            (
                np.ones(len(l0)),
                np.minimum(per(symbols), 3),
                np.minimum(per(upper), 6) / 2,
                np.minimum(per(digit), 6) / 2,
                np.minimum(per(punct), 3),
                np.minimum(per(end), 1),
                np.minimum((lead[l1] - lead[l0]) / width, 20) / 10,
                np.log1p(width) / 4,
                (closed[first + width] - closed[first]) / width,
                (symbols[l1] - symbols[l0] > 0).astype(float),
                np.minimum(np.log1p(size) / 8, 2),
                head.astype(float),
                tail.astype(float),
                (width <= 3).astype(float),
                (width <= 12).astype(float),
                (times[same] > 1).astype(float),
                1.0 - _STOP[b[np.maximum(l1 - 1, 0)]],
            )
        )
        noise = ((symbols[l1] - symbols[l0] + punct[l1] - punct[l0]) >= NOISY * size) | (letter[l1] == letter[l0])
        yield i, j, counts, lrow, number, width, lines, feats, noise


def gradient(x: np.ndarray, rows: np.ndarray, y: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the labels' conditional log likelihood, by the emission weights and by the moves: what is seen less what is expected.

    Forward and backward sums run over all texts at once, a place of the line in its text a step.
    """
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    size = np.diff(np.r_[first, len(rows)])
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[pair], y[pair + 1]), 1)
    active = [int(np.searchsorted(-size, -k, "left")) for k in range(int(size[0]))]  # texts with more than k lines
    e = x @ w
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[first] = e[first]
    for k in range(1, len(active)):
        at = first[: active[k]] + k
        alpha[at] = e[at] + np.logaddexp.reduce(alpha[at - 1][:, :, None] + t, axis=1)
    for k in range(len(active) - 2, -1, -1):
        at = first[: active[k + 1]] + k
        beta[at] = np.logaddexp.reduce(t + (e[at + 1] + beta[at + 1])[:, None, :], axis=2)
    z = np.empty(len(x))
    z[np.concatenate([np.arange(f, f + s) for f, s in zip(first, size, strict=True)])] = np.repeat(np.logaddexp.reduce(alpha[first + size - 1], axis=1), size)
    p = np.exp(alpha + beta - z[:, None])
    pairs = np.exp(alpha[pair][:, :, None] + t + (e[pair + 1] + beta[pair + 1])[:, None, :] - z[pair][:, None, None]).sum(axis=0)
    return x.T @ (np.eye(2)[y] - p), seen - pairs


class Field:
    """A linear-chain conditional random field with two labels."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    @classmethod
    def neutral(cls, n: int = FEATURES) -> "Field":
        w = np.zeros((n, 2))
        w[0, CONTENT] = 1
        return cls(w, np.zeros((2, 2)))

    @classmethod
    def fit(cls, feats: np.ndarray, rows: np.ndarray, labels: np.ndarray, steps: int = STEPS, decay: float = 1e-3) -> "Field":
        """feats: lines x features, in order; rows: ascending numbers of their texts; labels: 0 or 1 by line."""
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        rows = np.cumsum(np.r_[0, (rows[1:] != rows[:-1]) | (place[1:] % PIECE_LINES == 0)])
        w, t = np.zeros((feats.shape[1], 2)), np.zeros((2, 2))
        m, v = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
        for step in range(1, steps + 1):
            for k, (g, param) in enumerate(zip(gradient(feats, rows, labels, w, t), (w, t), strict=True)):
                g = g / len(feats) - decay * param
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                param += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return cls(w, t)

    def decode(self, feats: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Viterbi labels of lines; rows: ascending numbers of their texts. Runs over all texts at once."""
        if not len(rows):
            return np.empty(0, np.int64)
        e = feats @ self.weights
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        size = np.diff(np.r_[first, len(rows)])
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        best, back = e.copy(), np.zeros(e.shape, np.int8)
        for k in range(1, int(size[0])):
            at = first[: int(np.searchsorted(-size, -k, "left"))] + k
            ways = best[at - 1][:, :, None] + self.moves
            back[at] = ways.argmax(axis=1)
            best[at] = e[at] + ways.max(axis=1)
        labels = np.empty(len(rows), np.int64)
        labels[first + size - 1] = best[first + size - 1].argmax(axis=1)
        for k in range(int(size[0]) - 2, -1, -1):
            at = first[: int(np.searchsorted(-size, -(k + 1), "left"))] + k
            labels[at] = back[at + 1, labels[at + 1]]
        return labels


def recurring(docs: DataFrame, lines: np.ndarray, text: str = "text") -> np.ndarray:
    """Which of ``lines`` (ascending hashes, a bounded number) stand on enough of all documents to be called recurring."""

    def count(batches):
        n, rows = np.zeros(len(lines), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            buf, off = buffer_of(batch.column(0))
            for i, j in slices(off):
                l0, l1, lrow = word_spans(buf[off[i] : off[j]], off[i : j + 1] - off[i], LINES)
                h = span_hashes(buf[off[i] : off[j]], l0, l1, False)
                place = np.minimum(np.searchsorted(lines, h), len(lines) - 1)
                ok = lines[place] == h
                once = np.unique(lrow[ok] * np.int64(len(lines)) + place[ok])  # a line counts once a document
                n += np.bincount(once % len(lines), minlength=len(lines))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[n[at], rows])], names=["place", "n"])

    if not len(lines):
        return np.empty(0, bool)
    found = docs.select(text).mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # a row a line at most
    place, n = found.column("place").to_numpy(), found.column("n").to_numpy()
    total, own = n[place < 0].sum(), place >= 0
    many = np.zeros(len(lines), np.int64)
    many[place[own]] = n[own]
    return many >= max(RECURRING_ROWS, RECURRING * total)


def weak_labels(quality: np.ndarray, rows: np.ndarray, width: np.ndarray, known: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Labels of lines from their texts' quality; rows: the lines' texts, known: the line recurs, noise: it is no running text."""
    n = len(quality)
    copy = 2 * np.bincount(rows, width * known, n) > np.bincount(rows, width, n)
    return np.where((quality[rows] == 0) | noise | (known & ~copy[rows]), BOILERPLATE, CONTENT)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, text_bytes: int = TEXT_BYTES) -> Field:
    """docs: doc_id, text; labels: doc_id, quality (0 or 1)."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # a top-k by hash, before any text is read
    sizes = docs.where("text IS NOT NULL").select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.max("size").alias("size")).where(F.col("size") <= text_bytes)
    first = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # sample_rows rows at most
    taken = materialise(sizes.withColumn("so_far", F.sum("size").over(first)).where(F.col("so_far") <= sample_bytes).select("doc_id", "quality"), "sample")
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(taken), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).toArrow()
    rows = rows.sort_by([("quality", "ascending"), ("text", "ascending")]).combine_chunks()
    quality, parts = rows.column("quality").to_numpy(), []
    for i, _, _, lrow, _, width, lines, feats, noise in scan(rows.column("text").combine_chunks()) if rows.num_rows else ():
        parts.append((lrow + i, width, lines, noise, feats))
    if not parts:
        warnings.warn("no labelled text has a line to learn from: all lines count as content", stacklevel=2)
        return Field.neutral()
    at, width, lines, noise, feats = (np.concatenate(x) for x in zip(*parts, strict=True))
    distinct, place = np.unique(lines, return_inverse=True)
    label = weak_labels(quality, at, width, recurring(docs, distinct)[place], noise)
    if len(set(label.tolist())) < 2:
        warnings.warn("the lines of labelled texts are all of one kind: all lines count as content", stacklevel=2)
        return Field.neutral()
    return Field.fit(feats, at, label)


def judge(docs: DataFrame, field: Field, text: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """``docs`` plus the base counts, base_failed, content_share, boilerplate_lines (numbers, from 0) and kept."""
    at = docs.columns.index(text)
    names = [free_name(docs, x) for x in (*COUNTS, "base_failed", "content_share", "boilerplate_lines", "kept")]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            counts, content, many, numbers = np.zeros((n, len(COUNTS)), np.int64), np.zeros(n), np.zeros(n, np.int64), [np.empty(0, np.int64)]
            for i, j, c, lrow, number, width, _, feats, _ in scan(batch.column(at)):
                counts[i:j] = c
                label = field.decode(feats, lrow)
                content[i:j] = np.bincount(lrow, width * (label == CONTENT), j - i)
                many[i:j] = np.bincount(lrow[label == BOILERPLATE], minlength=j - i)
                numbers.append(number[label == BOILERPLATE])
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > 50 * counts[:, 0])
            share = content / np.maximum(counts[:, 0], 1)
            marked = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), pa.array(np.concatenate(numbers).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(share), marked, pa.array(~failed & (share >= min_content))], names=[*batch.schema.names, *names])

    schema = StructType([*docs.schema.fields])
    for name, kind in zip(names, [LongType()] * 5 + [BooleanType(), DoubleType(), ArrayType(IntegerType()), BooleanType()], strict=True):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = train(docs, table(spark, sf_dir, "labels"))
    out = judge(docs.select("doc_id", "text"), field)
    return out.withColumn("n_boilerplate_lines", F.size("boilerplate_lines").cast("long")).drop("text", "boilerplate_lines")


def base_query(spark, sf_dir: str) -> DataFrame:
    """The base counts alone, which need no field."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), Field.neutral()).select("doc_id", *COUNTS, "base_failed")


BASE_ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
win AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
again AS (SELECT r, i FROM win JOIN (SELECT r, s FROM win GROUP BY 1, 2 HAVING count(*) > 1) USING (r, s)),
rep AS (SELECT r, count(*) AS k FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS at FROM again) GROUP BY 1),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      coalesce(dup.k, 0)::BIGINT AS n_dup_lines, coalesce(rep.k, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""
