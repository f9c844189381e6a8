"""Importance resampling, spelling variants and the quality classifier against plain versions, and on their odd cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kelvane.llm import _crc, quality_model, resampling, spelling

WORDS = "river stone under morning letter garden simple travel across winter people market quiet window yellow forest".split()


def rows_of(r, n):
    out = [(i, " ".join(r.choice(WORDS) + r.choice(["", "", ",", ".\n", " É", "ß"]) for _ in range(r.randrange(0, 60)))) for i in range(n)]
    out += [(n, None), (n + 1, ""), (n + 2, "?!"), (n + 3, "a"), (3, out[3][1]), (None, out[5][1]), (n + 4, "long " * 30_000 + "end")]
    return out


def test_checksums_are_carried_on():
    r = random.Random(1)
    pairs = [(r.randbytes(r.randrange(0, 9)), r.randbytes(r.choice([0, 1, 7, 300, 70_000]))) for _ in range(60)]
    got = _crc.carried(np.array([zlib.crc32(a) for a, _ in pairs], np.uint32), np.array([len(b) for _, b in pairs]), np.array([zlib.crc32(b) for _, b in pairs], np.uint32))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def test_resampling_equals_a_plain_version(spark, monkeypatch):
    r = random.Random(2)
    rows, target = rows_of(r, 90), [(str(i), " ".join(r.choices(WORDS[:6], k=30))) for i in range(20)] + [("x", None)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (collections.Counter(bucket(f) for _, text in x for f in features(text)[1]) for x in (rows, target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    want = []
    for i, text in rows:
        n, fs = features(text)
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((x for x in want if x[1] >= 20), key=lambda x: (-x[4], math.inf if x[0] is None else x[0]))
    docs = spark.createDataFrame([(i, x, "kept") for i, x in rows], "doc_id long, text string, score string").repartition(5)
    for piece in (resampling.PIECE, 7):  # tries of a few words as well: their features begin in one and end in the next
        monkeypatch.setattr(resampling.tries, "__defaults__", (resampling.DEPTH, piece))
        got = resampling.resample(docs, spark.createDataFrame(target, "item_id string, text string"), percent=20)
        assert got.columns == ["doc_id", "text", "score", "n_words", "n_features", "weight", "score_", "rank"]
        found = got.collect()
        assert collections.Counter((x["doc_id"], x["n_words"], x["n_features"], x["weight"], x["score_"]) for x in found) == collections.Counter(map(tuple, want))
        drawn = sorted((x["rank"], x["doc_id"]) for x in found if x["rank"] is not None)
        assert drawn == [(k + 1, x[0]) for k, x in enumerate(fit[: 20 * len(fit) // 100])] and len(drawn) > 5
        assert all(x["score"] == "kept" for x in found)
    empty = resampling.resample(docs.where("false"), spark.createDataFrame([], "text string"))
    assert empty.count() == 0


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_variants_equal_all_pairs(spark):
    r = random.Random(3)
    base = ["".join(r.choices("abcdeéÿ", k=r.randrange(6, 12))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "x" * 400]
    words = []
    for w in base:
        words += [w] * r.choice([1, 2, 30, 400])
        for _ in range(3):
            i = r.randrange(len(w))
            words += [r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abc") + w[i:], w[:i] + r.choice("abc") + w[i + 1 :]])] * r.choice([1, 2, 3, 20])
    r.shuffle(words)
    rows = [(i, " ".join(w.upper() if k % 9 == 0 and w.isascii() else w for k, w in enumerate(words[i * 50 : i * 50 + 50])) + "-Ω9") for i in range(len(words) // 50 + 1)]
    rows += [(None, "ababababa " * 40), (900, None), (901, ""), (902, "ÀÀÀÀÀÀÀÀ ×÷×÷×÷×÷ " * 2), (rows[0][0], rows[0][1]), (903, "abababa " * 50_000)]
    count = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate({k: k + 32 for k in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: k for w, k in count.items() if len(w) >= 7 and k >= 2}
    forms, want = {}, {}
    for w in n:
        by = sorted((-n[x], x) for x in n if near(w, x))
        forms[w] = by[0][1] if by and -by[0][0] >= 10 * n[w] else None
        want[w] = [forms[w], None, n[w], len(by), n[forms[w]] if forms[w] else None]
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        want[w][1] = root
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {x["word"]: [x["form"], x["root"], x["n"], x["n_near"], x["form_n"]] for x in spelling.variants(docs).collect()}
    assert got == want and sum(x[0] is not None for x in want.values()) > 5 and any(want[w][1] != want[w][0] for w in n if want[w][0])
    assert spelling.variants(docs.where("false")).count() == 0


def test_chains_of_forms(spark):
    links = [(f"w{i:03}", f"w{i + 1:03}") for i in range(37)]
    assert {tuple(x) for x in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()} == {(a, "w037") for a, _ in links}


def samples(r, n):
    for i in range(n):
        good = r.random() < 0.7
        text = ". ".join(" ".join(r.choices(WORDS, k=9)) for _ in range(r.randrange(3, 9))) if good else " ".join(r.choice(WORDS).upper() + r.choice(["!!", "##"]) for _ in range(r.randrange(20, 60)))
        yield i, text, int(good)


def test_classifier_on_held_out_texts(spark):
    rows = list(samples(random.Random(4), 500))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (902, "word " * 80_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(5, 1, 0), (None, 1, 0), (6, None, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    learned = ~quality_model.held_out("doc_id")
    model = quality_model.train(docs.where(learned), labels.where(learned), bags=2, rounds=40)
    out = quality_model.classify(docs, model)
    assert out.columns == ["doc_id", "text", "score", "score_", "predicted"]
    got = {x["doc_id"]: x for x in out.collect()}
    unseen = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(unseen) > 60 and all(got[i]["predicted"] == q for i, q in unseen)
    assert all(0 <= x["score_"] <= 1 for x in got.values()) and got[900]["score_"] == got[901]["score_"]
    # The score is the logistic function of a sum of looked-up numbers.
    x = quality_model.features(pa.array([t for _, t, _ in rows[:50]]))
    for k, row in enumerate(x):
        total = model.base + sum(t[int(np.searchsorted(c, row[f], "right"))] for f, (t, c) in enumerate(zip(model.tables, model.cuts)))
        for (a, b), t in zip(model.pairs, model.pair_tables):
            total += t.reshape(len(model.coarse[a]) + 1, -1)[np.searchsorted(model.coarse[a], row[a], "right"), np.searchsorted(model.coarse[b], row[b], "right")]
        assert math.isclose(1 / (1 + math.exp(-total)), got[rows[k][0]]["score_"], rel_tol=1e-9)
    with pytest.warns(UserWarning):
        assert quality_model.train(docs, labels.where("false")).score(x[:1])[0] == 0.5
    assert quality_model.classify(docs.where("false"), model).count() == 0


def test_an_interaction_is_found(spark):
    """A label that only two features together tell: their pair is chosen, and the tables of single features do not suffice."""
    g = np.random.default_rng(5)
    x = g.random((1500, len(quality_model.FEATURES)))
    y = ((x[:, 3] > 0.5) != (x[:, 7] > 0.5)).astype(int)
    sample = spark.createDataFrame([(i, int(q), v.tolist()) for i, (q, v) in enumerate(zip(y, x))], "hash long, quality long, x array<double>")
    model = quality_model.fit(sample, bags=2, rounds=60)
    assert model.pairs[0] == (3, 7)
    z = g.random((500, len(quality_model.FEATURES)))
    right = lambda m: np.mean((m.score(z) > 0.5) == ((z[:, 3] > 0.5) != (z[:, 7] > 0.5)))
    alone = quality_model.Model(model.base, model.cuts, model.tables, model.coarse, [], [])
    assert right(model) > 0.85 > 0.65 > right(alone)


def test_trees_take_the_best_cuts():
    g = np.random.default_rng(6)
    grad, curve, n = g.normal(size=9), g.random(9) + 0.5, np.full(9, 10.0)
    gain = lambda a, z: grad[a:z].sum() ** 2 / (curve[a:z].sum() + quality_model.RIDGE)
    got = quality_model.tree(grad, curve, n, leaves=2)
    k = max(range(1, 9), key=lambda k: gain(0, k) + gain(k, 9))
    assert np.allclose(got, np.r_[np.full(k, grad[:k].sum() / (curve[:k].sum() + 1)), np.full(9 - k, grad[k:].sum() / (curve[k:].sum() + 1))])
    two, h = g.normal(size=(4, 5)), g.random((4, 5)) + 0.5
    value = lambda m, c: m.sum() ** 2 / (c.sum() + quality_model.RIDGE)

    def best_of(a, c):
        top = 0
        for k in range(1, len(a)):
            sides = [max([value(p, q)] + [value(p[:, :j], q[:, :j]) + value(p[:, j:], q[:, j:]) for j in range(1, p.shape[1])]) for p, q in ((a[:k], c[:k]), (a[k:], c[k:]))]
            top = max(top, sum(sides) - value(a, c))
        return top

    assert math.isclose(quality_model.pair_tree(two, h, np.full((4, 5), 10.0))[0], max(best_of(two, h), best_of(two.T, h.T)), rel_tol=1e-9)


def test_features_of_texts():
    texts = ["", None, "One two two. THREE!!\nOne two two. x", "a b c a b c", "é" * 30]
    x = quality_model.features(pa.array(texts, pa.string()))
    one = dict(zip(quality_model.FEATURES, x[2]))
    assert not x[:2].any()
    assert math.isclose(one["words"], math.log1p(8)) and math.isclose(one["distinct"], 5 / 8) and one["repeated_lines"] == 0 and math.isclose(one["marks"], 2 / 8)
    assert math.isclose(one["repeated"], 6 / 8) and math.isclose(one["closed_lines"], 1 / 2) and math.isclose(one["capitals"], 7 / 24)
    assert x[3][quality_model.FEATURES.index("repeated")] == 1 and x[4][quality_model.FEATURES.index("word_size")] == 30
    many = [t for t in texts for _ in range(3)]
    assert np.array_equal(quality_model.features(pa.array(many, pa.string())), np.repeat(x, 3, axis=0))


def test_variants_send_no_table(spark):
    """Joins of words deal both sides, however small the vocabulary's file looks: nothing is sent to all tasks."""
    docs = spark.createDataFrame([(i, "mountain mountains fountain fountains") for i in range(40)], "doc_id long, text string")
    words = spelling.materialise(spelling.vocabulary(docs), "vocabulary")
    for df in (spelling.near_words(words), spelling.variants(docs)):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
