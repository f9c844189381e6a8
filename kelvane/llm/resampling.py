"""Importance resampling towards a target distribution, over tries of words.

Features of a text are its runs of one to three words. A trie's nodes are such runs: an edge adds a word, and a node holds
how often its run occurs and the CRC-32 state of its spelling, which is carried on from its parent's. Counting walks all
texts of a partition into tries and adds the nodes' counts to bucket totals (a feature's bucket is its CRC-32 modulo
``BUCKETS``); the totals of all partitions are summed for the raw documents and for the target texts. Each bucket has a gain,
the logarithm of its share in the target over its share in the documents, smoothed. Scoring builds the tries again,
attaches the gains to their nodes and adds them up along each document's paths. With Gumbel noise from a hash of the id, the
highest scores are a sample without replacement in proportion to the exponential of the weights.

Memory: a trie is made of at most ``PIECE`` words of a partition at a time (its totals are kept, ``BUCKETS`` numbers), so it
does not grow with the partition or with a text. Totals are ``BUCKETS`` numbers a side on the driver. Scores are ranked by
ranges, and no task or driver sees all of them.

Defined cases: a null text and one without a word have no features, weight 0, and a score; an id that is null is hashed as
an empty one and comes last among ties; rows that repeat an id share its noise and are scored and ranked each; texts of
any length are walked whole; an empty table gives an empty result; without target texts, a bucket's gain comes from the
smoothing alone; rows keep their columns, and an added column whose name is taken gets an underscore behind it. Words of one
piece are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..operators.numbering import numbered
from ._common import free_name, materialise, table
from ._crc import carried, of_spans
from ._text import ALNUM_WORDS, buffer_of, slices, span_hashes, word_spans

BUCKETS = 10_000
#: Words of a feature at most.
DEPTH = 3
#: Documents with fewer words are not drawn; of the others, this share in percent is.
MIN_WORDS, PERCENT = 20, 5
SEED = 42
#: Bytes of texts that are read together, and words of which one trie is made.
BLOCK, PIECE = 4 << 20, 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Trie:
    """The runs of up to ``depth`` words of some texts. Level by level: ``crc`` and ``count`` of its nodes, and which node each run is."""

    def __init__(self, words: np.ndarray, rows: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, own: int, depth: int = DEPTH):
        """words: hashes of consecutive words, rows: their texts. Runs start at the first ``own`` words and may end behind them."""
        _, one, word = np.unique(words, return_index=True, return_inverse=True)
        crc, length = of_spans(buf, starts[one], ends[one]), ends[one] - starts[one]
        spaced = carried(np.full(len(one), of_spans(np.array([32], np.uint8), np.zeros(1, np.int64), np.ones(1, np.int64))[0]), length, crc)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # places, node by place, states, counts
        place, node = np.arange(own), word[:own]
        state = crc
        self.levels.append((place, node, state, np.bincount(node, minlength=len(one))))
        for k in range(1, depth):
            on = place + k < len(words)
            on[on] = rows[place[on]] == rows[place[on] + k]
            place, parent = place[on], node[on]
            nxt = word[place + k]
            edges, node, count = np.unique(parent * np.int64(len(one)) + nxt, return_inverse=True, return_counts=True)
            state = carried(state[edges // len(one)], length[edges % len(one)] + 1, spaced[edges % len(one)])
            self.levels.append((place, node, state, count))

    def totals(self, buckets: int = BUCKETS) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for _, _, state, count in self.levels:
            out += np.bincount(state % np.uint32(buckets), count, buckets).astype(np.int64)
        return out

    def walk(self, gains: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Sums of the nodes' gains by row (of n) over all paths."""
        out = np.zeros(n, np.int64)
        for place, node, state, _ in self.levels:
            np.add.at(out, rows[place], gains[state % np.uint32(len(gains))][node])
        return out


def tries(texts: pa.Array, depth: int = DEPTH, piece: int = PIECE):
    """For blocks of rows: their range and word counts; and the tries of their words, with the words' rows in the range."""
    buf, off = buffer_of(texts)
    for i, j in slices(off, BLOCK):
        b, o = _LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
        starts, ends, rows = word_spans(b, o, ALNUM_WORDS)
        words = span_hashes(b, starts, ends, False)

        def parts(b=b, starts=starts, ends=ends, rows=rows, words=words):
            for at in range(0, len(words), piece):
                own = min(piece, len(words) - at)
                to = at + own + depth - 1
                lo, hi = int(starts[at]), int(ends[min(to, len(words)) - 1])
                yield Trie(words[at:to], rows[at:to], b[lo:hi], starts[at:to] - lo, ends[at:to] - lo, own, depth), rows[at:to]

        yield i, j, np.bincount(rows, minlength=j - i), parts()


def totals(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text") -> DataFrame:
    """(bucket, n_docs, n_target): how many features of each side fall into each bucket that any falls into."""

    def count(batches):
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            side = batch.column(1).to_numpy(zero_copy_only=False)
            for s in np.unique(side).tolist():
                for _, _, _, parts in tries(batch.column(0).filter(pa.array(side == s))):
                    for trie, _ in parts:
                        sums[s] += trie.totals()
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["bucket", "n_docs", "n_target"])

    both = docs.select(F.col(text).cast("string").alias("text"), F.lit(0).alias("side")).unionByName(target.select(F.col(target_text).cast("string").alias("text"), F.lit(1).alias("side")))
    per_task = both.mapInArrow(count, "bucket int, n_docs long, n_target long")  # BUCKETS rows a task at most
    return per_task.groupBy("bucket").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_target").alias("n_target"))


def gains_of(counts: DataFrame) -> np.ndarray:
    """Gain of every bucket, in thousandths; counts: what :func:`totals` gives."""
    spark = counts.sparkSession
    rows = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in ("n_docs", "n_target"))
    sides = rows.select("bucket", s, t).toArrow()  # BUCKETS rows
    own, other = sides.column("n_docs").to_numpy(), sides.column("n_target").to_numpy()
    gain = np.empty(BUCKETS, np.int64)
    ratio = (other + 1) * (own.sum() + BUCKETS) / ((own + 1) * (other.sum() + BUCKETS))
    gain[sides.column("bucket").to_numpy()] = np.floor(1000 * np.log(ratio)).astype(np.int64)
    return gain


def score(docs: DataFrame, gains: np.ndarray, text: str = "text", doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``docs`` plus n_words, n_features, weight and score."""
    at = docs.columns.index(text)
    names = [free_name(docs, x) for x in ("n_words", "n_features", "weight")]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            words, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, j, k, parts in tries(batch.column(at)):
                words[i:j] = k
                for trie, rows in parts:
                    weight[i:j] += trie.walk(gains, rows, j - i)
            features = sum(np.maximum(words - k, 0) for k in range(DEPTH))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words), pa.array(features), pa.array(weight)], names=[*batch.schema.names, *names])

    schema = StructType([*docs.schema.fields])
    for name in names:
        schema = schema.add(name, LongType())
    out = docs.mapInArrow(run, schema)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    return out.withColumn(free_name(out, "score"), F.col(names[2]) + noise)


def draw(scored: DataFrame, doc_id: str = "doc_id", score: str = "score", n_words: str = "n_words", percent: int = PERCENT, least: int = MIN_WORDS) -> DataFrame:
    """``scored`` plus rank, from 1, of the rows that are drawn: the highest scores, ties to the smaller id; others have none.

    ``scored`` is read several times: it should be a stored table.
    """
    rank = free_name(scored, "rank")
    fit = F.col(n_words) >= least
    drawn = scored.where(fit).count() * percent // 100
    others = [F.col(c) for c, kind in scored.dtypes if c not in (doc_id, score) and not kind.startswith("map")]
    place = numbered(scored.where(fit), F.col(score).desc(), F.col(doc_id).asc_nulls_last(), F.xxhash64(*others), name=rank)
    return place.withColumn(rank, F.when(F.col(rank) < drawn, F.col(rank) + 1)).unionByName(scored.where(~fit).withColumn(rank, F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """``docs`` plus n_words, n_features, weight, score and rank; the drawn ones have a rank."""
    names = {x: free_name(docs, x) for x in ("n_words", "score")}
    scored = materialise(score(docs, gains_of(totals(docs, target, text)), text, doc_id), "scored")
    return draw(scored, doc_id, names["score"], names["n_words"], percent)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = totals(docs, table(spark, sf_dir, "benchmark"))
    scored = materialise(score(docs, gains_of(counts)).drop("text"), "scored")
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte from the table of its 256 steps, as SQL knows no such function.
CRC = """steps AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""


def crc_sql(text: str) -> str:
    """SQL of the CRC-32 of a string, where ``steps`` is in scope."""
    h = f"hex(encode({text}))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({h}), 2), lambda i: ('0x' || substr({h}, i, 2))::BIGINT)), lambda c, b: xor(c // 256, steps.t[(xor(c, b) % 256) + 1])))"


ORACLE = rf"""
WITH {CRC},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
fd AS (SELECT r, f, count(*) AS k FROM (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM d) GROUP BY 1, 2),
fb AS (SELECT f, count(*) AS k FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM b) GROUP BY 1),
bucket AS (SELECT f, {crc_sql("f")} % 10000 AS bucket FROM (SELECT f FROM fd UNION SELECT f FROM fb), steps),
sb AS (SELECT bucket, sum(k)::DOUBLE AS s FROM fd JOIN bucket USING (f) GROUP BY 1),
tb AS (SELECT bucket, sum(k)::DOUBLE AS t FROM fb JOIN bucket USING (f) GROUP BY 1),
gain AS (SELECT g.i AS bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM sb) + 10000) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM tb) + 10000))))::BIGINT AS gain
         FROM (SELECT unnest(range(10000)) AS i) g LEFT JOIN sb ON sb.bucket = g.i LEFT JOIN tb ON tb.bucket = g.i),
wt AS (SELECT r, sum(k)::BIGINT AS n_features, sum(k * gain)::BIGINT AS weight FROM fd JOIN bucket USING (f) JOIN gain USING (bucket) GROUP BY 1),
sc AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
       coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN wt USING (r)),
rk AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS k FROM sc)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND k <= (SELECT count(*) * 5 // 100 FROM sc WHERE n_words >= 20) THEN k END::BIGINT AS rank FROM rk
"""
