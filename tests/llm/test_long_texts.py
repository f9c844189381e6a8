"""Very long texts, plain versions of what no SQL holds, and what a run leaves behind."""

import hashlib
import math
import os
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from kelvane.llm import _common, jaccard_join, language_id, sharding, suffix_dedup, warc

from .test_llm import replicas


def test_repeats_in_texts_of_several_slices(spark):
    """Texts of more than one slice of 262,144 bytes, with repeats within, across the seam and between documents."""
    r = random.Random(11)
    new = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage, seam = new(700), new(300)
    first = new(150_000) + passage + new(suffix_dedup.SLICE - 150_850) + seam + new(60_000) + passage
    second = seam + new(suffix_dedup.SLICE + 40_000) + passage[:150] + new(90) + seam
    texts = {0: first, 1: "short " + seam[:99], 2: second, 3: first[-400_000:], 4: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeated_spans(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    seen = {}
    for k in sorted(texts):
        b = (texts[k] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if seen.setdefault(hash(b[p : p + 100]), (k, p)) != (k, p):
                gone[p : p + 100] = b"\1" * 100
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        assert got[k] == (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    assert got[0][1] >= 700 and got[2][1] >= 750 and got[3][1] == got[3][0]  # chance may lengthen a match


def test_long_texts_in_shards(spark):
    """A text beyond a bucket's size fills one bucket, and is neither cut nor lost."""
    texts = ["x " * 700_000, "y" * 300_000, None, "", "z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    placed = sharding.shuffle_shards(docs, "doc_id", bucket_bytes=100_000, size=F.octet_length("text")).collect()
    assert {r["doc_id"]: r["text"] for r in placed} == dict(enumerate(texts))


def test_shards_by_plain_hashing(spark):
    """The shard of a key is the one of the highest seeded hash, told by a plain loop."""

    def plain(key, shards):
        best = None
        for k in range(shards):
            h = 42
            for part in (struct.pack("<i", sharding.SEED), struct.pack("<i", k), struct.pack("<q", key)):
                h = xxhash.xxh64_intdigest(part, h)
            best = max(best or (-(2**63), -1), (h - 2**64 if h >= 2**63 else h, k))
        return best[1]

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    for r in sharding.shuffle_shards(docs, "doc_id").collect():
        assert (r["shard"], r["grown_shard"]) == (plain(r["doc_id"], 16), plain(r["doc_id"], 17))
        assert r["grown_shard"] in (r["shard"], 16)


def test_mixtures_equal_a_plain_loop():
    """EM and the choice of the set, word by word in doubles, against the arrays of all texts."""
    r = random.Random(3)
    names = ["a", "b", "c"]
    vocabulary = {x: ["".join(r.choices(abc, k=r.randint(2, 7))) for _ in range(60)] for x, abc in zip(names, ("abcdefgh", "efghijkl", "ijklmnab"), strict=True)}

    def grams(word):
        b = f" {word} ".encode()
        return [int(language_id._mixed[0][p] ^ language_id._mixed[1][q] ^ language_id._mixed[2][s]) for p, q, s in zip(b, b[1:], b[2:], strict=False)]

    counts = np.full((3, language_id.BUCKETS), 0.5)
    for k, x in enumerate(names):
        for w in vocabulary[x] * 20:
            np.add.at(counts[k], grams(w), 1)
    model = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    texts = [" ".join(r.choices(vocabulary[x], k=n) + r.choices(vocabulary[y], k=m)) for x, n, y, m in (("a", 40, "b", 0), ("a", 60, "b", 40), ("c", 1, "c", 0), ("b", 300, "c", 200), ("c", 25, "a", 24))]
    texts.append(" ".join(r.choices(vocabulary["a"] + vocabulary["b"] + vocabulary["c"], k=400)))
    texts.append(texts[3] * 600)  # beyond a slice

    def em(rows, on, rounds):
        share = [1 / len(on) if x in on else 0.0 for x in range(3)]
        for _ in range(rounds):
            new = [0.0] * 3
            for row in rows:
                total = sum(s * p for s, p in zip(share, row, strict=True)) + 1e-30
                new = [t + s * p / total for t, s, p in zip(new, share, row, strict=True)]
            share = [t / len(rows) for t in new]
        return share, sum(math.log(sum(s * p for s, p in zip(share, row, strict=True)) + 1e-30) for row in rows)

    got = language_id.infer(pa.array([*texts, None, "", "12 34"]), names, model)
    assert got[0][-3:] == ["und"] * 3 and got[2][-3:] == [[], [], []]
    for k, text in enumerate(texts[:-1]):
        logs = [[float(model[x][grams(w)].sum()) for x in range(3)] for w in text.split()]
        rows = [[math.exp(v - max(row)) for v in row] for row in logs]
        top = sum(max(row) for row in logs)
        order = sorted(range(3), key=lambda x, s=em(rows, range(3), language_id.ITERATIONS)[0]: -s[x])
        cost = language_id.PENALTY * math.log(max(2, len(rows))) / 2
        best = (sum(row[order[0]] for row in logs) - top - cost, 1, [float(x == order[0]) for x in range(3)])
        for n in (2, 3):
            share, ll = em(rows, order[:n], 2 * language_id.ITERATIONS)
            if ll - n * cost > best[0]:
                best = (ll - n * cost, n, share)
        want = max(range(3), key=best[2].__getitem__)
        assert got[0][k] == names[want] and abs(got[1][k] - best[2][want]) < 1e-3 and len(got[2][k]) == best[1]
    assert {len(x) for x in got[2][:6]} == {1, 2, 3}
    assert got[0][6] == got[0][3] and abs(got[1][6] - got[1][3]) < 0.02 and set(got[2][6]) >= set(got[2][3])


def test_fixity_of_long_records(spark):
    """A record longer than a file and one byte of it changed: that one record is found."""
    body = "long " * 500_000
    rows = [(i, f"http://h/{i}", f"body {i}" if i != 5 else body) for i in range(40)]
    wrong = [(i, u, b if i != 5 else b[:1_000_000] + "X" + b[1_000_001:]) for i, u, b in rows]
    (a, b), key = replicas(spark, rows, wrong[::-1])
    found = warc.audit(a, b, key, 2, file_bytes=5000).collect()
    assert [(r["page_id"], r["status"]) for r in found] == [(5, "changed")] and found[0]["hi"] - found[0]["lo"] >= len(body)


def folders(root):
    return sorted(x for x in os.listdir(root) if not x.startswith("."))


def test_runs_leave_only_what_results_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_common, "shared_root", lambda spark: f"file://{tmp_path}/shared")
    (tmp_path / "shared").mkdir()
    r = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(r.choices(words, k=80)) for _ in range(30)]
    texts += [t + " more" for t in texts[:8]] + texts[:3]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = jaccard_join.join_classes(docs)
    assert [x.split("-")[0] for x in folders(tmp_path / "shared")] == ["components", "shingles"]
    assert sum(r["component_id"] != r["doc_id"] for r in got.collect()) == 11
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("q1", " ".join(texts[20].split()[10:40]))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = set(folders(tmp_path / "shared"))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert [x.rsplit("-", 1)[0] for x in folders(tmp_path / "shared") if x not in before] == ["benchmark-decontamination"]
    assert packed.select("doc_id").distinct().count() == 29


def test_a_failing_step_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_common, "shared_root", lambda spark: f"file://{tmp_path}")

    def make():
        _common.settle(lambda: _common.materialise(spark.range(3).toDF("a"), "inner").select("a"), "kept")
        raise ValueError(zlib.crc32(b"x"))

    try:
        _common.settle(make, "outer")
    except ValueError:
        pass
    assert folders(tmp_path) == [] and _common._written.get() is None
