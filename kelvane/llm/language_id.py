"""Language identification by multilingual mixture inference.

Every word of a text is taken to come from one of the languages that mix in it. Its likelihood under a language
is that of its byte trigrams (a space on either side; A-Z lower-cased; digits and ASCII punctuation count as
space). Expectation-maximisation estimates the proportions of the languages; among the nested sets of the most
probable languages, the one with the best likelihood less a penalty per language (half the logarithm of the
number of words, as in BIC) is the text's language set. The prediction is its largest language.

Trigrams are hashed into 65536 buckets, so that the model has a fixed size per language and counting it over
all training rows needs a fixed size per task.

Defined cases: a null text, and one without a letter, is ``und`` with score 0 and no languages; so is every text
if nothing could be learned; equal proportions go to the language that sorts first; rows keep their columns (an added
column whose name is taken gets an underscore behind it).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_name, table
from ._text import SPACE_WORDS, buffer_of, slices, word_spans

BUCKETS = 1 << 16
FOLDS = 5
ITERATIONS = 8
#: Times half the logarithm of the number of words that another language must gain in log-likelihood.
PENALTY = 4.0
_mixed = np.random.default_rng(7).integers(0, BUCKETS, (3, 256)).astype(np.uint16)
_letters = np.full(256, 32, np.uint8)
_letters[97:123] = np.arange(97, 123)
_letters[65:91] = np.arange(97, 123)
_letters[128:] = np.arange(128, 256)


def _scan(texts: pa.Array):
    """For slices of rows: their range, the trigram bucket at each byte, and the words' starts, ends and rows."""
    padded = pc.binary_join_element_wise(pa.scalar(" ", texts.type), pc.fill_null(texts, ""), pa.scalar(" ", texts.type), pa.scalar("", texts.type))
    buf, off = buffer_of(padded)
    for i, j in slices(off):
        b = _letters[buf[off[i] : off[j]]]
        grams = _mixed[0][b[:-2]] ^ _mixed[1][b[1:-1]] ^ _mixed[2][b[2:]] if len(b) > 2 else np.empty(0, np.uint16)
        yield i, j, b, grams, *word_spans(b, off[i : j + 1] - off[i], SPACE_WORDS)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of the trigram buckets, from all rows with a text and a language."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            names, codes = np.unique(langs.astype(str), return_inverse=True)
            for i, j, b, grams, starts, ends, rows in _scan(batch.column(0)):
                if not len(starts):
                    continue
                step = np.zeros(len(b) + 1, np.int8)
                np.add.at(step, starts - 1, 1)
                np.add.at(step, ends - 1, -1)
                at = np.flatnonzero(np.cumsum(step[:-1], dtype=np.int8)[: len(grams)])
                code = np.repeat(codes[i:j][rows], ends - starts)
                n = np.bincount(code * BUCKETS + grams[at], minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for k in np.flatnonzero(n.any(axis=1)):
                    sums[names[k]] = sums.get(names[k], 0) + n[k]
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])

    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 65536 rows a language
    names = sorted(set(rows.column("lang").to_pylist()))
    counts = np.full((len(names), BUCKETS), 0.5)
    place = {x: k for k, x in enumerate(names)}
    np.add.at(counts, ([place[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()), rows.column("n").to_numpy())
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32) if names else counts


def _mixture(lik: np.ndarray, first: np.ndarray, sizes: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for many texts at once. lik: languages x words; first, sizes: each text's words; share: languages x texts."""
    for _ in range(rounds):
        r = lik * np.repeat(share, sizes, axis=1)
        r /= r.sum(axis=0) + 1e-30
        share = np.add.reduceat(r, first, axis=1) / sizes
    ll = np.add.reduceat(np.log((lik * np.repeat(share, sizes, axis=1)).sum(axis=0) + 1e-30), first)
    return share, ll


def infer(texts: pa.Array, names: list[str], model: np.ndarray, penalty: float = PENALTY) -> tuple[list, np.ndarray, list]:
    """Language, score (its proportion) and language set of each text."""
    out, score, sets = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in range(len(texts))]
    if not names:
        return out, score, sets
    for i, j, b, grams, starts, ends, rows in _scan(texts):
        if not len(starts):
            continue
        cuts = np.ravel(np.column_stack((starts - 1, ends - 1)))
        cuts = cuts[:-1] if cuts[-1] >= len(grams) else cuts
        words = np.stack([np.add.reduceat(m[grams], cuts)[::2] for m in model])
        texts_at, first, sizes = np.unique(rows, return_index=True, return_counts=True)
        ascii_letters = np.add.reduceat(((b[starts] < 128) | (b[ends - 1] < 128)).astype(np.int64), first)
        top = words.max(axis=0)
        lik = np.exp(words - top)
        share, mixed = _mixture(lik, first, sizes, np.full((len(names), len(first)), 1 / len(names), np.float32), ITERATIONS)
        order = np.argsort(-share, axis=0, kind="stable")
        alone = np.add.reduceat(words, first, axis=1)
        base = np.add.reduceat(top, first)
        cost = penalty * np.log(np.maximum(sizes, 2)) / 2
        best = np.take_along_axis(alone, order[:1], axis=0)[0] - base - cost
        chosen = np.ones(len(first), np.int64)
        final = np.zeros_like(share)
        np.put_along_axis(final, order[:1], 1, axis=0)
        for t in np.flatnonzero(mixed - 2 * cost > best):  # others cannot gain by a second language
            own = lik[:, first[t] : first[t] + sizes[t]]
            for k in range(2, len(names) + 1):
                on = np.zeros((len(names), 1), np.float32)
                on[order[:k, t]] = 1 / k
                s, ll = _mixture(own, np.zeros(1, np.int64), sizes[t : t + 1], on, 2 * ITERATIONS)
                if ll[0] - k * cost[t] > best[t]:
                    best[t], chosen[t], final[:, t] = ll[0] - k * cost[t], k, s[:, 0]
        for t, row in enumerate(texts_at.tolist()):
            row += i
            if not ascii_letters[t] and not any(c.isalpha() for c in texts[row].as_py()):
                continue
            k = int(final[:, t].argmax())
            out[row], score[row] = names[k], min(1.0, float(final[k, t]))
            sets[row] = [names[x] for x in np.argsort(-final[:, t], kind="stable")[: chosen[t]]]
    return out, score, sets


def identify(docs: DataFrame, names: list[str], model: np.ndarray, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """``docs`` plus lang_pred, lang_score and lang_set."""
    added = [free_name(docs, x) for x in ("lang_pred", "lang_score", "lang_set")]
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            out, score, sets = infer(batch.column(at), names, model, penalty)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string()))], names=[*batch.schema.names, *added])

    from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add(added[0], StringType()).add(added[1], DoubleType()).add(added[2], ArrayType(StringType()))
    return docs.mapInArrow(run, schema)


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, model = train(docs.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0))
    rows = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return identify(rows, names, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_set")
