"""Operators against brute-force versions and on awkward rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kelvane.llm import decontamination, jaccard_join, language_id, line_dedup, packing, quality_rules, sharding, suffix_dedup, url_filters, warc
from kelvane.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def corpus(seed=1, n=120):
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.randrange(20, 120))) for _ in range(n // 3)]
    out = []
    for i in range(n):
        t = base[i % len(base)].split()
        for _ in range(r.randrange(3)):
            t[r.randrange(len(t))] = "edit" + str(r.randrange(99))
        out.append(" ".join(t) + ("\n" + base[0] if i % 11 == 0 else ""))
    return out + [None, "", " \n ", "one", "one two", "ab" * 4000, out[3], out[3]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, 0) for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


@pytest.mark.parametrize("percent,n,hot", [(90, 3, 256), (80, 5, 256), (90, 3, 2)])
def test_jaccard(docs, texts, percent, n, hot, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_RUN", hot)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    got = {r["doc_id"]: r for r in jaccard_join.join_classes(docs, percent, n).collect()}
    sets = {}
    for k, t in texts.items():
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == {k: (len(s), label[k]) for k, s in sets.items()}


def test_divide_skip():
    r = np.random.default_rng(0)
    probe = np.unique(r.integers(0, 300, 100)).astype(np.uint64)
    sets = [np.unique(np.r_[r.choice(probe, k, False), r.integers(0, 300, 10).astype(np.uint64)]) for k in range(10, len(probe), 5)]
    for percent in (50, 80, 90):
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(probe, s)) >= percent * len(np.union1d(probe, s))]
        assert jaccard_join._divide_skip(probe, sets, percent) == want


def test_bitmaps(spark):
    r = np.random.default_rng(3)
    sets = [r.integers(0, 1 << 60, n).astype(np.uint64) for n in (5, 1000, 2100)]
    sets += [np.r_[s[: len(s) - k], r.integers(0, 1 << 60, j).astype(np.uint64)] for s in sets for k, j in ((1, 1), (40, 90), (90, 40))]
    sets = [np.unique(s) for s in sets]
    rows = [(i, len(s), jaccard_join._bitmap(s).tolist()) for i, s in enumerate(sets)]
    feats = spark.createDataFrame(rows, "doc_id long, n_shingles int, marks array<long>")
    every = [(i, j) for i in range(len(sets)) for j in range(i)]
    got = {tuple(x) for x in jaccard_join.plausible(spark.createDataFrame(every, "a long, b long"), feats, 90).collect()}
    linked = {(i, j) for i, j in every if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
    assert linked and linked <= got and len(got) < len(every) / 2


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(50, 40), (41, 50)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 41: 40, 50: 40}


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(docs, texts, hot):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeated_spans(docs, hot=hot).collect()}
    seen = {}
    for k in sorted(texts):
        b = (texts[k] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if seen.setdefault(b[p : p + 100], (k, p)) != (k, p):
                gone[p : p + 100] = b"\1" * 100
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        assert got[k] == (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())


@pytest.mark.parametrize("length", [1, 5, 8, 20, 64])
def test_longest_previous_factors(length):
    """Suffix order, shared prefixes, previous and next smaller positions, and the factors that these give."""
    r = random.Random(length)
    for s in (b"a", b"aaaa" * 20, b"abracadabra" * 9, bytes(r.choices(b"ab", k=260)), bytes(r.choices(b"ab\0\xff", k=130)) * 2, bytes(r.choices(b"abcdefgh", k=300))):
        at = np.arange(max(0, len(s) - length + 1))
        if not len(at):
            continue
        text = np.frombuffer(s, np.uint8)
        key = suffix_dedup.cut_suffix_keys(text, at, length)
        order = np.lexsort((at, key))
        assert order.tolist() == sorted(at.tolist(), key=lambda i: (s[i : i + length], i))
        shared = suffix_dedup.common_prefixes(text, at[order], key[order], length)
        common = lambda i, j: next((k for k in range(length) if s[i + k] != s[j + k]), length)
        assert shared.tolist() == [0] + [common(i, j) for i, j in zip(order[1:].tolist(), order[:-1].tolist())]
        factors = np.empty(len(at), int)
        factors[order] = suffix_dedup.previous_factors(order, shared)
        assert factors.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in at.tolist()]


def test_factors_of_repeated_positions():
    """Suffixes at one position (of rows that repeat) are not earlier than one another."""
    position, shared = np.array([4, 4, 2, 7, 2]), np.array([0, 9, 9, 3, 9], np.int32)
    # of equal positions neither counts: 4 looks to 2, 7 to 4 or 2
    assert suffix_dedup.previous_factors(position, shared).tolist() == [9, 9, 0, 9, 0]


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_matches_over_batches(rows):
    r = random.Random(rows)
    pools = [[bytes(r.choices(letters, k=20)) for _ in range(6)] for letters in (b"abc", b"def", b"ghi")]  # equal strings have equal keys
    data = sorted((k, d, 50 * p, len(b), b if r.random() < 0.9 else None) for k in range(3) for d in range(8) for p in range(2) for b in [r.choice(pools[k])[: r.randrange(10, 21)]])
    kind = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("body", pa.binary())])
    batch = pa.RecordBatch.from_pylist([dict(zip(kind.names, (k, d, p, n, b))) for k, d, p, n, b in data], kind)
    got = set()
    for out in suffix_dedup._match(10)(batch.slice(i, rows) for i in range(0, len(data), rows)):
        got |= {(x["doc_id"], i) for x in out.to_pylist() for i in range(x["lo"], x["hi"])}
    want, seen = set(), {}
    for k, d, p, n, b in data:
        if b is None:
            want |= {(d, i) for i in range(p, p + n)}
        for i in range(n - 9) if b is not None else ():
            if seen.setdefault(b[i : i + 10], (d, p + i)) != (d, p + i):
                want |= {(d, j) for j in range(p + i, p + i + 10)}
    assert got == want


def brute_decontamination(text: str | None, items: list[tuple[str, str]], width: int = decontamination.WIDTH, share: int = decontamination.SHARE) -> tuple[int, int, int, str, bool]:
    """The same for one document, straight from the definition (for tests)."""
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    doc = words(text)
    hit, ids = set(), set()
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for p in range(len(doc) - n + 1):
                if doc[p : p + n] == w[k : k + n]:
                    hit.update(range(p, p + n))
                    ids.add(str(i))
    return len(doc), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and share * len(hit) >= len(doc)


def test_decontamination(spark, docs, texts):
    items = [(1, " ".join(texts[5].split()[3:22])), (2, "one two"), (10, texts[7].upper()), (11, None), (12, "!!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 300):
        for r in decontamination.decontaminate(docs, bench, index_bytes=block).collect():
            n, hit, ids, digest, bad = brute_decontamination(r["text"], [(str(i), t) for i, t in items])
            assert (r["n_words"], r["n_hit"], len(r["hit_items"]), r["contaminated"]) == (n, hit, ids, bad)
            assert hashlib.sha256(",".join(r["hit_items"]).encode()).hexdigest() == digest


def test_decontamination_by_join(spark):
    """Beyond the index: items that share windows, words in all of them, a passage in a third of the texts and copies."""
    r = random.Random(8)
    say = lambda n: " ".join(r.choice(("the", "The", "é", "β1", *WORDS)) for _ in range(n))
    shared = say(15)
    items = [(i, f"{shared} {say(r.randrange(20))}" if i % 3 == 0 else say(r.randrange(40))) for i in range(30)]
    items += [(30, items[0][1]), (0, items[1][1]), (31, "the the the"), (32, None), (33, "-")]
    texts = [" - ".join((say(r.randrange(30)), shared if i % 3 == 0 else r.choice(items)[1] or "", say(5))) for i in range(60)]
    texts += [texts[0], texts[0], None, "", "the", "the " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda size: sorted(map(repr, decontamination.decontaminate(docs, bench, index_bytes=size).collect()))
    got = rows(0)
    assert got == rows(1 << 20) and sum("contaminated=True" in x for x in got) > 20
    listed = [(str(i), t) for i, t in items]
    for x in decontamination.decontaminate(docs.where("doc_id % 7 = 0"), bench, index_bytes=0).collect():
        n, hit, ids, digest, bad = brute_decontamination(x["text"], listed)
        assert (x["n_words"], x["n_hit"], len(x["hit_items"]), x["contaminated"]) == (n, hit, ids, bad)
        assert hashlib.sha256(",".join(x["hit_items"]).encode()).hexdigest() == digest


def test_quality(docs, texts, spark):
    got = quality_rules.judge(docs, quality_rules.Field.neutral()).collect()
    for r in got:
        w = words(r["text"])
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (r["text"] or "").split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (r["n_words"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), len(lines) - len(set(lines)), len(covered))
        assert (r["word_chars"], r["n_symbols"]) == (sum(map(len, w)), len(re.findall("[#*$%&|<>]", r["text"] or "")))
        assert (r["base_failed"], r["kept"], r["content_share"], r["boilerplate_lines"]) == (failed, not failed, float(bool(w)), [])


def test_viterbi():
    r = np.random.default_rng(4)
    f = quality_rules.Field(r.normal(size=(3, 2)), r.normal(size=(2, 2)))
    x, rows = r.normal(size=(9, 3)), np.array([0, 0, 0, 0, 2, 2, 2, 3, 3])
    got = f.decode(x, rows)
    import itertools

    for row in set(rows.tolist()):
        e = x[rows == row] @ f.weights
        best = max(itertools.product((0, 1), repeat=len(e)), key=lambda y: sum(e[i, k] for i, k in enumerate(y)) + sum(f.moves[a, b] for a, b in zip(y, y[1:])))
        assert got[rows == row].tolist() == list(best)


def test_field_learns():
    r = np.random.default_rng(5)
    rows = np.repeat(np.arange(40), 5)
    y = rows % 2
    f = quality_rules.Field.fit(np.column_stack((np.ones(200), y + r.normal(0, 0.3, 200))), rows, y, 60)
    assert (f.decode(np.column_stack((np.ones(200), y + r.normal(0, 0.3, 200))), rows) == y).mean() > 0.95


def test_language(spark):
    fr, de = "le chat est dans la maison et les enfants", "der hund ist in dem haus und die kinder"
    rows = [(i, (fr, de)[i % 2] + f" {i}", ("fr", "de")[i % 2]) for i in range(20)] + [(90, None, None), (91, "12 — 34", None), (92, fr + " " + fr + " " + de + " " + de, None), (93, "", "fr")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, model = language_id.train(d)
    got = {r["doc_id"]: r for r in language_id.identify(d, names, model, penalty=1.0).collect()}
    assert all(got[i]["lang_pred"] == ("fr", "de")[i % 2] for i in range(20))
    assert [got[i]["lang_pred"] for i in (90, 91, 93)] == ["und"] * 3 and set(got[92]["lang_set"]) == {"fr", "de"}
    assert language_id.infer(pa.array(["abc"]), [], model)[0] == ["und"]


@pytest.mark.parametrize("rows", [200_000, 0])
def test_lines(spark, rows):
    data = [(i, f"menu\nbody {i}\n\nmenu", "h") for i in range(20)] + [(90, "menu\nx", None), (91, None, "h"), (92, "menu", "h")]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    cut = lambda **how: {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"], r["n_boilerplate"]) for r in line_dedup.dedup_lines(d, broadcast_rows=rows, **how).collect()}
    got = cut()
    assert got[3] == ("body 3\n", 3, 2, 2) and got[91] == (None, 0, 0, 0) and got[92] == ("", 1, 1, 1)
    assert got[90] == ("", 2, 2, 2)  # a host of one page: the ratio alone decides
    got = cut(min_pages=2, keep_whole=True)
    assert got[3] == ("body 3\n", 3, 2, 2) and got[90] == ("menu\nx", 2, 0, 0) and got[91] == (None, 0, 0, 0) and got[92] == ("menu", 1, 0, 1)


def test_packing(docs, texts):
    r = np.random.default_rng(1)
    lengths, overhead, quadratic = (30, 60, 90), 2, 120
    sizes = np.sort(r.integers(1, 90, 300))[::-1]
    bins, offsets, caps, opened = packing.pack_lengths(sizes, lengths, overhead, quadratic)
    fill = np.bincount(bins, sizes)
    assert (fill <= caps).all() and all(c == min(x for x in lengths if x >= f) for c, f in zip(caps, fill))
    # best fit and the least expected cost, straight from the definition
    left, want, first = [], [], []
    for i, s in enumerate(sizes.tolist()):
        ok = [b for b in range(len(left)) if left[b] >= s]
        if ok:
            b = min(ok, key=lambda b: left[b])
        else:
            b, price = len(left), {}
            for c in lengths:
                if c >= s:
                    hole = c - s
                    for x in sizes[i + 1 :].tolist():
                        hole -= x if x <= hole else 0
                    price[c] = (overhead + c + c * c / quadratic) / (c - hole)
            left.append(min(price, key=lambda c: (price[c], c)))
            first.append(left[-1])
        left[b] -= s
        want.append(b)
    assert first == opened.tolist()
    assert sorted(left) == sorted((opened - fill).astype(int).tolist()) and len(want) == len(bins)  # of equally full bins any will do
    got = packing.pack(docs, lengths=(64, 256, 1024), group_rows=40).collect()
    for k, t in texts.items():
        own = sorted((p["piece_start"], p["piece_tokens"]) for p in got if p["doc_id"] == k)
        assert sum(n for _, n in own) == (0 if t is None else len(t.encode()) + 1) and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_packing_lengths_compete():
    """Ordinary sizes open all lengths, and cost less than with any single length that holds them."""
    sizes = np.sort(np.minimum(np.random.default_rng(5).lognormal(7.3, 1.1, 20_000).astype(int) + 1, 16384))[::-1]
    _, _, caps, opened = packing.pack_lengths(sizes)
    assert set(opened.tolist()) == set(packing.LENGTHS) and np.bincount(opened).max() < 0.9 * len(opened)
    _, _, single, _ = packing.pack_lengths(sizes, (16384,))
    assert packing.cost_of(caps).sum() < 0.9 * packing.cost_of(single).sum() and sizes.sum() > 0.95 * caps.sum()


def test_sharding(spark):
    d = spark.createDataFrame([(i % 50, f"t{i % 70}") for i in range(500)] + [(None, None)] * 30, "doc_id long, text string")
    def of(rows):
        return sorted((r.asDict() for r in sharding.shuffle_shards(rows, "doc_id", bucket_bytes=1000).collect()), key=lambda x: (x["shard"], x["slot"]))

    got = of(d)
    assert len(got) == 530 and len({(g["doc_id"], g["shard"], g["grown_shard"]) for g in got}) == 51
    for s in {g["shard"] for g in got}:
        assert sorted(g["slot"] for g in got if g["shard"] == s) == list(range(sum(g["shard"] == s for g in got)))
    assert all(g["grown_shard"] in (g["shard"], 16) for g in got)
    # Whatever the partitions of the input: the same slots (equal texts of one id may trade theirs).
    assert got == of(d.repartition(7, "text"))


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/1?q", "https://x.org", "ftp://b.com/de/2", None, "nothing", "http://example.org/en/12"] + [f"http://spam-{i}.net/buy" for i in range(30)] + [f"http://good-{i}.net/read" for i in range(60)]
    p = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labelled = p.where("page_id > 5").select("url", F.col("url").contains("spam").alias("bad"))
    got = {r["page_id"]: r for r in url_filters.filter_urls(p, labelled).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(6)] == [("a.example.org", "/es/1", "example.org/es/"), ("x.org", "", None), ("b.com", "/de/2", "com/de/"), ("", "", None), ("", "", None), ("example.org", "/en/12", "example.org/en/1")]
    assert all((got[i]["verdict"] == "block") == ("spam" in urls[i]) for i in range(6, len(urls)))
    rules = url_filters.mine_rules(labelled).collect()
    assert {tuple(r["tokens"]) for r in rules if r["verdict"] == "block"} == {("h=spam",), ("p=buy",)}  # longer ones are implied
    assert {tuple(r["tokens"]) for r in rules if r["verdict"] == "allow"} == {("h=good",), ("p=read",)}


def replicas(spark, ours, theirs, **kind):
    key, out = ["page_id", "url"], []
    for rows in (ours, theirs):
        out.append(warc.lay_out(warc.catalogue(spark.createDataFrame(rows, "page_id long, url string, html string")), key, kind.get("depth", 2)))
    return out, key


def test_fixity(spark):
    """Replicas that are laid out by themselves: each fault is found once, and no record that only moved."""
    rows = [(i, f"http://h/{i}", f"body {i} " * (1 + i % 9)) for i in range(400)] + [(7, "http://h/7", "body 7")] * 2 + [(None, None, None)]
    faulty = [r if r[0] not in (3, 50) else (*r[:2], "x" * r[0]) for r in rows if r[0] != 9] + [(900, "http://new", "y"), (5, None, "z")]
    random.Random(1).shuffle(faulty)
    (a, b), key = replicas(spark, rows, faulty)
    found = warc.audit(a, b, key, 2, file_bytes=5000).collect()
    assert sorted((r["page_id"], r["status"]) for r in found) == [(3, "changed"), (5, "extra"), (9, "missing"), (50, "changed"), (900, "extra")]
    assert all((r["digest"] is None) == (r["status"] == "extra") and (r["replica_digest"] is None) == (r["status"] == "missing") and r["hi"] - r["lo"] == r["length"] for r in found)
    differ, looked = warc.descend(warc.merkle_tree(a, 2), warc.merkle_tree(b, 2))
    seen = [x.count() for x in looked]
    assert differ.count() == 7 and seen[0] == 1 and sum(seen[:3]) <= 1 + 16 + 16 * 5 and seen[3] < 60  # changed ones change buckets
    (a, b), _ = replicas(spark, rows, rows[::-1])
    assert warc.audit(a, b, key, 2).count() == 0 and [x.count() for x in warc.descend(warc.merkle_tree(a, 2), warc.merkle_tree(b, 2))[1]] == [1, 0, 0, 0]


def test_fixity_byte_ranges(spark):
    """The byte ranges of findings are those of the records in the order of the replica that holds them."""
    rows = [(i % 40, f"u{i % 40}", f"b{i}" * (1 + i % 5)) for i in range(300)]
    for depth in (0, 1, 2):
        (a, b), key = replicas(spark, rows, [], depth=depth)
        found = warc.audit(a, b, key, depth, file_bytes=1 << 30).collect()
        spans = sorted((r["lo"], r["hi"]) for r in found)
        assert len(found) == 300 and {r["status"] for r in found} == {"missing"} and spans[0][0] == 0
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        back = warc.audit(b, a, key, depth).collect()
        assert len(back) == 300 and {r["status"] for r in back} == {"extra"}
    (a, b), key = replicas(spark, [], [])
    assert warc.audit(a, b, key, 2).count() == 0


def test_fixity_versions_of_a_key(spark):
    """A key with very many records; other numbers of copies are a change."""
    rows = [(1, "u", f"v{i}") for i in range(500)] + [(2, "w", "same")] * 3
    (a, b), key = replicas(spark, rows, [r for r in rows if r[2] not in ("v4", "v77")][:-1])
    found = [(r["page_id"], r["status"], r["copies"], r["replica_digest"] and r["digest"] == r["replica_digest"]) for r in warc.audit(a, b, key, 2).collect()]
    assert sorted(found, key=str) == [(1, "missing", 1, None), (1, "missing", 1, None), (2, "changed", 3, True)]


TAKEN = "n_words hit_starts hit_ends hit_items n_hit contaminated lang_pred lang_score lang_set N_LINES n_dropped line_hash host path rule verdict hit u bad shard bucket slot grown_shard record key bytes row_key kept base_failed boilerplate_lines content_share mined says n_boilerplate token node n digest component doc_hash".split()


def test_taken_names(spark):
    """Columns of the caller stay as they are; an added one gets an underscore."""
    rows = [(i, f"menu\nwords of text number {i} and {i * 7} more words", "en", "s", 0) for i in range(30)] + [(None, None, None, None, None)]
    plain = spark.createDataFrame(rows, SCHEMA)
    wide = plain.withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1))) for c in TAKEN})
    bench = spark.createDataFrame([(1, "words of text number 3"), (2, "text number 4 and 28")], "item_id long, text string")

    def same(run, *names):
        a, b = run(plain), run(wide)
        assert a.columns == [*plain.columns, *a.columns[len(plain.columns) :]] and set(wide.columns) < set(b.columns)
        of = lambda df, cols: sorted(map(repr, df.select("doc_id", *cols).collect()))
        assert [x.replace("_=", "=") for x in of(b, [f"{n}_" for n in names])] == of(a, names)
        assert of(b, TAKEN) == of(wide, TAKEN)

    model = language_id.train(plain)
    same(lambda d: language_id.identify(d, *model), "lang_pred", "lang_set")
    same(line_dedup.dedup_lines, "n_lines", "n_dropped")
    for block in (1 << 20, 30):
        same(lambda d, block=block: decontamination.decontaminate(d, bench, index_bytes=block), "n_words", "n_hit", "hit_items", "contaminated")
    same(lambda d: quality_rules.judge(d, quality_rules.Field.neutral()), "n_words", "kept")
    same(lambda d: sharding.shuffle_shards(d, "doc_id"), "shard", "grown_shard")
    url = lambda d: d.withColumn("text", F.concat(F.lit("http://spam.net/"), F.col("doc_id") % 5))
    labels = url(plain).select(F.col("text").alias("url"), F.lit(True).alias("bad"))
    same(lambda d: url_filters.filter_urls(url(d), labels, "text"), "host", "path", "rule", "verdict")
    for run in (jaccard_join.join_classes, suffix_dedup.repeated_spans, packing.pack):
        assert sorted(map(repr, run(plain).drop("bin").collect())) == sorted(map(repr, run(wide).drop("bin").collect()))


def test_hot_shard(spark):
    """The shard of a key that holds a third of the rows has as many more buckets."""
    d = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.col("id").alias("text"))
    n = sharding.shuffle_shards(d, "doc_id", bucket_bytes=4096).groupBy("shard", "bucket").count().agg(F.max("count"), F.sum("count")).first()
    assert n[0] <= 3 * 4096 / sharding.RECORD_BYTES and n[1] == 3000


def test_empty_tables(spark, empty):
    assert jaccard_join.join_classes(empty).count() == suffix_dedup.repeated_spans(empty).count() == packing.pack(empty).count() == line_dedup.dedup_lines(empty).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(empty, bench).count() == 0 and sharding.shuffle_shards(empty.select("doc_id"), "doc_id").count() == 0
    assert language_id.identify(empty, *language_id.train(empty)).count() == 0
    field = quality_rules.train(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_rules.judge(empty, field).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.filter_urls(pages, spark.createDataFrame([], "url string, bad boolean")).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "none of these words stand in any of the documents of this small table")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs.columns
    wide = docs.withColumns({c: F.lit(c) for c in TAKEN})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide = stage(spark, wide, str(tmp_path))
    assert wide.columns == [*docs.columns, *TAKEN] and wide.select(*TAKEN).distinct().collect() == [tuple(TAKEN)]
    assert sorted(map(repr, wide.select(*docs.columns).collect())) == sorted(map(repr, d.collect()))
    left = {r["doc_id"] for r in d.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left and 0 < len(left) < docs.count()


def brute_pipeline(rows, items):
    """Ids and texts that the pipeline's stages keep, straight from their definitions."""
    rows = [(i, t, s) for i, t, s in rows if any(c.isalpha() for c in t or "")]
    pages = collections.Counter(s for _, _, s in rows)
    on = collections.Counter((s, x) for _, t, s in rows for x in {y for y in t.split("\n") if y.strip(" ")})
    cut = []
    for i, t, s in rows:
        left = [x for x in t.split("\n") if not x.strip(" ") or not (on[s, x] >= 2 and on[s, x] > pages[s] * line_dedup.RATIO)]
        cut.append((i, "\n".join(left) if any(x.strip(" ") for x in left) else t))
    sets = []
    for i, t in cut:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}))
    label = {i: i for i, _ in sets}
    links = [(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(x & y) >= 80 * len(x | y)]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: t for i, t in cut if label[i] == i and not brute_decontamination(t, items)[4]}


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    texts = corpus(seed=8)
    texts = [t if i % 4 or not t else f"about us\n{t}\nall rights reserved" for i, t in enumerate(texts)]
    quoted = "these fourteen words of an item of the benchmark stand in two documents whole"
    texts += [quoted, "x1 y2 " + quoted + " z3", "12 34", "about us\nall rights reserved", quoted + " " + " ".join(f"own{k}" for k in range(400))]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 4}" if i % 9 else None, 0) for i, t in enumerate(texts)]
    items = [("1", quoted), ("2", None), ("3", "none of these words")]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(int(i), t) for i, t in items], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute_pipeline([(i, t, s) for i, t, _, s, _ in rows], items)
    d, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        sizes.append(d.count())
    assert {r["doc_id"]: r["text"] for r in d.collect()} == want and len(rows) > sizes[0] > sizes[2] > sizes[3]
    pieces = collections.defaultdict(list)
    load, room = collections.Counter(), {}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[p["doc_id"]].append((p["piece_start"], p["piece_tokens"]))
        load[p["bin"]] += p["piece_tokens"]
        room[p["bin"]] = p["bin_capacity"]
    assert all(n <= room[b] and room[b] == min(c for c in packing.LENGTHS if c >= n) for b, n in load.items())
    assert {k: (sum(n for _, n in v), min(v)[0]) for k, v in pieces.items()} == {k: (len(t.encode()) + 1, 0) for k, t in want.items()}
