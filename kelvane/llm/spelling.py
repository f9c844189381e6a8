"""Spelling variants: words one edit apart, found by a rare-first prefix filter over positional bigrams.

Runs of letters are counted over all documents (some lose a letter by a seeded hash, which plants misspellings). The
vocabulary's bigrams are ordered by how many places of distinct words hold them, rarest first, one order for all words. An
edit touches two bigrams of a word at most, so of its three rarest one is untouched, and the rarest untouched bigram is
among the three rarest of the other word too, at most one position away. Words are joined on those three, their lengths and
positions not more than one apart. As a bigram that is rare in its words may still be frequent in the vocabulary, the join also
asks for what an edit leaves as it is: two thirds of the word at its start, or at its end, or a third at both. Candidates are
verified by edit distance.

A word's form is its most frequent near word, if that is ``RATIO`` times as frequent; forms are followed to a root by doubling
the steps each round.

Defined cases: a null text has no words, and an empty one neither; a null id is hashed as an empty one; rows that repeat
count each; ties of frequency go to the smallest word in code-point order; texts of any length are read whole; an empty
table gives an empty result; other columns of the documents are not read. No join sends a table to all tasks: Spark takes a
table of exploded words for as small as the vocabulary's file, which the driver could not hold. Distinct words of a block of text are told apart by
64-bit hashes. Bigrams are at most the square of the alphabet of 90 letters, so their order is held by every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise, table
from ._crc import carried, of_spans
from ._text import buffer_of, slices, span_hashes, word_spans
from .resampling import CRC, crc_sql

#: A run whose hash this divides loses a letter.
TYPO = 31
#: Letters and occurrences of a word at least; how many times as frequent a form must be.
LEAST_SIZE, LEAST_COUNT, RATIO = 7, 2, 10
#: Untouched bigrams need so many more than an edit touches (two).
PREFIX = 3
#: Bytes of text read together; distinct words a task holds before it hands them on.
BLOCK, HELD = 4 << 20, 1 << 17
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_ONE = np.array([False, True])


def letter_runs(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and code points of maximal runs of a-z and U+00C0 to U+00FF; these are the byte 0xC3 and one more."""
    two = b == 0xC3
    inside = _LETTER[b] | two
    inside[1:] |= two[:-1]
    starts, ends, rows = word_spans(inside.view(np.uint8), o, _ONE)
    before = np.concatenate(([0], np.cumsum(two)))
    return starts, ends, rows, ends - starts - (before[ends] - before[starts])


def occurrences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", typo: int = TYPO, least: int = LEAST_SIZE) -> DataFrame:
    """(word, n): words of at least ``least`` letters after the seeded deletions, and how often tasks saw them; words repeat."""

    def run(batches):
        held: dict[bytes, int] = {}

        def out():
            words, n = [w.decode() for w in held], list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            buf, off = buffer_of(batch.column(1))
            for i, j in slices(off, BLOCK):
                b, o = _LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
                starts, ends, rows, size = letter_runs(b, o)
                ok = size >= least
                starts, ends, rows, size = starts[ok], ends[ok], rows[ok], size[ok]
                if not len(starts):
                    continue
                _, one, word = np.unique(span_hashes(b, starts, ends, False), return_index=True, return_inverse=True)
                s, e, size = starts[one], ends[one], size[one]
                pairs, count = np.unique(rows * np.int64(len(one)) + word, return_counts=True)
                row, word = pairs // len(one), pairs % len(one)
                heads = [f"{'' if x is None else x}:".encode() for x in ids[i:j]]
                cuts = np.concatenate(([0], np.cumsum([len(x) for x in heads])))
                head = of_spans(np.frombuffer(b"".join(heads), np.uint8), cuts[:-1], cuts[1:])
                h = carried(head[row], (e - s)[word], of_spans(b, s, e)[word])
                hit = h % np.uint32(typo) == 0
                n = np.bincount(word[~hit], count[~hit], len(one)).astype(np.int64)
                data = b.tobytes()
                for w in np.flatnonzero(n).tolist():
                    key = data[s[w] : e[w]]
                    held[key] = held.get(key, 0) + int(n[w])
                for w, x, k in zip(word[hit].tolist(), h[hit].tolist(), count[hit].tolist(), strict=True):
                    if size[w] > least:
                        letters = data[s[w] : e[w]].decode()
                        at = x % len(letters)
                        key = (letters[:at] + letters[at + 1 :]).encode()
                        held[key] = held.get(key, 0) + k
                if len(held) >= HELD:
                    yield out()
        yield out()

    return docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur often enough in all documents together."""
    return occurrences(docs, text, doc_id).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A byte a letter (U+00FF is the last one), and where the words begin."""
    w = words.to_pylist()
    o = np.concatenate(([0], np.cumsum([len(x) for x in w]))).astype(np.int64)
    return np.frombuffer("".join(w).encode("latin-1"), np.uint8).astype(np.int32), o


def _bigrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, row and position of every bigram."""
    c, o = _letters(words)
    row = np.searchsorted(o, np.arange(len(c)), "right") - 1
    at = np.flatnonzero(row[:-1] == row[1:]) if len(c) else np.empty(0, np.int64)
    return c[at] * 256 + c[at + 1], row[at], at - o[row[at]]


def rarity(words: DataFrame) -> np.ndarray:
    """Place of each bigram in the one order: rarest first, ties by code."""

    def count(batches):
        n = np.zeros(65536, np.int64)
        for batch in batches:
            n += np.bincount(_bigrams(batch.column(0))[0], minlength=65536)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["gram", "n"])

    found = words.select("word").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # 90 * 90 rows at most
    n = np.zeros(65536, np.int64)
    n[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    place = np.empty(65536, np.int32)
    place[np.lexsort((np.arange(65536), n))] = np.arange(65536, dtype=np.int32)
    return place


def prefixes(words: DataFrame, order: np.ndarray) -> DataFrame:
    """(word, n, size, gram, pos): the ``PREFIX`` rarest bigrams of each word, in the one order, equal ones from the left."""

    def run(batches):
        for batch in batches:
            gram, row, pos = _bigrams(batch.column(0))
            by = np.lexsort((pos, order[gram], row))
            rows = row[by]
            first = np.searchsorted(rows, rows, "left")
            by = by[np.arange(len(rows)) - first < PREFIX]
            at = pa.array(row[by])
            size = np.array([len(x) for x in batch.column(0).to_pylist()], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(size[row[by]]), pa.array(gram[by].astype(np.int32)), pa.array(pos[by].astype(np.int32))], names=["word", "n", "size", "gram", "pos"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, size int, gram int, pos int")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) both ways, once each: words exactly one inserted, deleted or replaced letter apart."""
    rows = prefixes(words, rarity(words))
    # A word meets words of its own length, and the next longer ones: in a pair, the shorter length tells how long a piece is.
    roles = F.array(*[F.struct((F.col("size") - x).alias("short"), F.lit(x == 1).alias("longer")) for x in (0, 1)])
    dealt = rows.select("*", F.explode(roles).alias("role")).select("word", "n", "gram", "pos", "size", "role.*")
    long_piece = ((F.col("short") * 2 + 1) / 3).cast("int")
    piece = F.col("short") - long_piece
    head, tail = (lambda k: F.substring("word", F.lit(1), k)), (lambda k: F.substring("word", F.col("size") - k + 1, k))
    pieces = F.array(head(long_piece), F.concat(F.lit("-"), tail(long_piece)), F.concat(head(piece), F.lit("-"), tail(piece)))
    dealt = dealt.select("word", "n", "pos", "longer", F.explode(pieces).alias("piece"), "gram", "short").withColumn("key", F.xxhash64("gram", "short", "piece")).drop("gram", "short", "piece")
    a = dealt.where("NOT longer").drop("longer")
    b = dealt.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("pos").alias("other_pos"), "longer")
    met = a.join(b.hint("merge"), "key").where("(longer OR word < other) AND abs(pos - other_pos) <= 1 AND abs(length(word) - length(other)) <= 1")
    found = met.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct()  # several bigrams and pieces find a pair
    ways = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return found.select(F.explode(ways).alias("pair")).select("pair.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form; forms: (word, form) once a word, without circles."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialise(at.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(at)
        at = new.drop("moved")
        at._kelvane_path = new._kelvane_path
        if new.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the whole vocabulary of ``docs``."""
    words = materialise(vocabulary(docs, text, doc_id), "vocabulary")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best")
    near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    enough = -F.col("best.minus") >= ratio * F.col("n")
    near = materialise(near.select("word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")), "near")
    followed = roots(near.where("form IS NOT NULL"))
    out = words.join(near.hint("merge"), "word", "left").join(followed.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE {CRC},
run AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY 1, 2),
h AS (SELECT w, k, {crc_sql("doc_id || ':' || w")} AS h FROM run, steps),
v AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
del AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM del a JOIN del b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, a.n, v.word, v.n FROM del a JOIN v ON v.word = a.less UNION SELECT v.word, v.n, a.word, a.n FROM del a JOIN v ON v.word = a.less),
best AS (SELECT word, count(*) AS n_near, min({{'minus': -m, 'other': other}}) AS b FROM near GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.minus >= 10 * n THEN b.other END AS form, CASE WHEN -b.minus >= 10 * n THEN -b.minus END::BIGINT AS form_n FROM v LEFT JOIN best USING (word)),
walk(word, top, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.top WHERE f.form IS NOT NULL)
SELECT f.word, form, r.root, n, n_near, form_n FROM f JOIN (SELECT word, max_by(top, step) AS root FROM walk GROUP BY 1) r ON r.word = f.word
"""
