"""The dealt methods decide results: planted cases through the queries' own paths."""

import collections
import math
import random
import time
import zlib

import numpy as np
import pytest

from kelvane.llm import language_id, quality_rules, sharding, url_filters

WORDS = "river stone under morning letter garden simple travel across winter people market quiet window yellow forest".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ","]) for _ in range(n)).capitalize() + "."


def test_menus_are_labelled_in_good_texts(spark, tmp_path):
    """Lines of a template are boilerplate and the rest content, within one text, in texts that the field has not seen."""
    r = random.Random(4)
    menu, foot = ["Home | News | Sport", "Login / Register"], ["Copyright 2020 all rights reserved", "Share this page"]
    rows, labels, templated = [], [], {}
    for i in range(240):
        body = [prose(r, r.randrange(18, 40)) for _ in range(r.randrange(3, 6))]
        if i % 3 == 0:
            lines, templated[i] = menu + body + foot, {0, 1, len(body) + 2, len(body) + 3}
        elif i % 3 == 1:
            lines, templated[i] = body, set()
        else:
            lines = [f"{r.choice(WORDS)} {r.choice(WORDS)} $$ {r.randrange(99)} ## >> click" for _ in range(14)]
        rows.append((i, "\n".join(lines)))
        if i < 150:
            labels.append((i, int(i % 3 != 2), 0))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    field = quality_rules.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    got = {x["doc_id"]: x for x in quality_rules.judge(docs, field).collect()}
    unseen = [i for i in templated if i >= 150]
    assert sum(set(got[i]["boilerplate_lines"]) == templated[i] for i in unseen) >= 0.95 * len(unseen)
    assert all(got[i]["kept"] == (i % 3 != 2) for i in got)
    out = {x["doc_id"]: x for x in quality_rules.query(spark, str(tmp_path)).collect()}
    assert all(out[i]["kept"] == got[i]["kept"] and out[i]["n_boilerplate_lines"] == len(got[i]["boilerplate_lines"]) for i in got)


def test_copies_are_no_template(spark):
    """Lines of a text that many rows repeat whole take the text's label."""
    r = random.Random(8)
    good = "\n".join(prose(r, 25) for _ in range(4))
    rows = [(i, good) for i in range(30)] + [(100 + i, "\n".join(prose(r, 25) for _ in range(4))) for i in range(30)] + [(200 + i, "buy $$ now\n## >> 77 click") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in rows], "doc_id long, quality int")
    got = {x["doc_id"]: x["content_share"] for x in quality_rules.judge(docs, quality_rules.train(docs, labels)).collect()}
    assert all(got[i] == (1 if i < 200 else 0) for i in got)


def brute_rules(rows):
    """Every set of tokens that some URL has, with its figures: strength by label, by set."""
    import itertools

    total, bad = len(rows), sum(b for _, b in rows)
    sets = {}
    for tokens, b in rows:
        for n in range(1, len(tokens) + 1):
            for c in itertools.combinations(sorted(tokens), n):
                k = sets.setdefault(c, [0, 0])
                k[b] += 1
    tried, base = len({t for tokens, _ in rows for t in tokens}), {"block": bad / total, "allow": 1 - bad / total}
    z, least = url_filters.interval_width(tried), max(math.ceil(url_filters.MIN_SUPPORT * total), url_filters.chance_rows(tried, min(base.values())))

    def strength(hits, n, verdict):
        p = hits / n if n else 0
        low = (p + z * z / 2 / n - z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n) if n else 0
        return low / base[verdict] if low > base[verdict] and p >= url_filters.MIN_LIFT * base[verdict] else None

    out = {}
    for c, k in sets.items():
        for b, verdict in ((1, "block"), (0, "allow")):
            if k[b] >= least and (s := strength(k[b], sum(k), verdict)):
                out[c, verdict] = s, k[b], sum(k)
    gone = set()
    for (c, v), (s, hits, n) in out.items():
        for (d, w), (t, more, m) in out.items():
            if v == w and set(c) < set(d):
                if s >= t:
                    gone.add((d, w))
                elif not strength(hits - more, n - m, v):
                    gone.add((c, v))
    return {k: x[0] for k, x in out.items() if k not in gone}


def test_mined_rules_decide_verdicts(spark, tmp_path):
    """Rules of one, two and three tokens in noise, through the query's path, against all combinations of tokens."""
    r = random.Random(12)
    urls, labels, rows = [], [], []
    for i in range(900):
        host, zone, path, key = r.choice(["alpha", "beta", "gamma", "delta"]), r.choice(["net", "info"]), r.choice(["aa", "bb", "cc"]), r.choice(["k1", "k2", "k3"])
        likely = host == "alpha" or (host == "beta" and path == "bb") or (host == "gamma" and zone == "net" and key == "k3")
        bad = int(r.random() < (0.9 if likely else 0.08))
        urls.append((i, f"http://{host}.{zone}/{path}/deep/er?{key}=1" if i % 50 else None))
        labels.append((i, 1 - bad, 0))
        if i % 50:
            rows.append(({f"h={host}", f"h={zone}", f"p={path}", "p=deep", "p=er", f"q={key}"}, bad))
        else:
            rows.append((set(), bad))
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    labelled = spark.createDataFrame([(u, not q) for (_, u), (_, q, _) in zip(urls, labels)], "url string, bad boolean")
    want = brute_rules([({t for t in tokens}, b) for tokens, b in rows])
    mined = {(tuple(x["tokens"]), x["verdict"]): x["strength"] for x in url_filters.mine_rules(labelled).collect()}
    assert set(mined) == set(want) and all(math.isclose(mined[k], want[k], rel_tol=1e-9) for k in want)
    assert {("h=alpha",), ("h=beta", "p=bb"), ("h=gamma", "h=net", "q=k3")} <= {c for c, v in mined if v == "block"}
    got = {x["page_id"]: x for x in url_filters.query(spark, str(tmp_path)).collect()}
    for (i, u), (tokens, _) in zip(urls, rows):
        fits = sorted((s, v) for (c, v), s in want.items() if set(c) <= tokens)
        assert got[i]["verdict"] == (fits[-1][1] if fits else "allow") and (got[i]["mined"] is None) == (not fits)
    assert collections.Counter(x["verdict"] for x in got.values())["block"] > 200


def test_few_long_urls_make_no_rules(spark):
    """A set of tokens that only a few rows hold is no rule, however few rows are labelled, and long paths do not multiply."""
    r = random.Random(6)
    urls = [("http://h%d.net/" % (i % 5) + "/".join(f"s{r.randrange(400)}" for _ in range(20)), i % 3 == 0) for i in range(60)]
    began = time.time()
    assert url_filters.mine_rules(spark.createDataFrame(urls, "url string, bad boolean")).count() == 0
    assert time.time() - began < 60
    assert url_filters.chance_rows(1, 0.1) == 2 and url_filters.chance_rows(100, 0.1) == 4 and url_filters.chance_rows(1, 0.5) == 7


def test_long_texts_do_not_empty_the_sample(spark):
    """A labelled text above the limit is left out alone; chains of many lines are cut into pieces; nothing to learn from is said."""
    r = random.Random(3)
    rows = [(i, "\n".join(prose(r, 20) for _ in range(5)) if i % 2 else "\n".join("buy $$ now ## >> 77 click" + str(r.randrange(9)) for _ in range(12))) for i in range(80)]
    rows += [(1000 + i, "\n".join(prose(r, 9) for _ in range(3000))) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 or i >= 1000)) for i, _ in rows], "doc_id long, quality int")
    for bound in (quality_rules.TEXT_BYTES, 10_000):
        field = quality_rules.train(docs, labels, text_bytes=bound)
        assert abs(field.weights[1:]).max() > 0.1  # the neutral field has zeros there
        kept = {x["doc_id"]: x["kept"] for x in quality_rules.judge(docs, field).collect()}
        assert all(kept[i] == bool(i % 2) for i in kept if i < 1000)  # the long ones repeat their words: the base rule takes them
    with pytest.warns(UserWarning):
        quality_rules.train(docs, labels, text_bytes=10)


def test_gradient_of_the_field():
    """The field's gradient agrees with differences of its likelihood, computed over all labellings."""
    import itertools

    g = np.random.default_rng(5)
    x, rows, y = g.normal(size=(9, 3)), np.array([0, 0, 0, 0, 1, 1, 1, 2, 2]), g.integers(0, 2, 9)
    w, t = g.normal(size=(3, 2)), g.normal(size=(2, 2))

    def likelihood(w, t):
        total = 0.0
        for text in range(3):
            at = np.flatnonzero(rows == text)
            value = lambda z: sum(x[i] @ w[:, c] for i, c in zip(at, z)) + sum(t[a, b] for a, b in zip(z, z[1:]))
            total += value(y[at]) - np.logaddexp.reduce([value(z) for z in itertools.product((0, 1), repeat=len(at))])
        return total

    by_w, by_t = quality_rules.gradient(x, rows, y, w, t)
    for m, of in ((w, by_w), (t, by_t)):
        for k in np.ndindex(*m.shape):
            step = np.zeros_like(m)
            step[k] = 1e-5
            up, down = ((likelihood(w + s, t) if m is w else likelihood(w, t + s)) for s in (step, -step))
            assert math.isclose((up - down) / 2e-5, of[k], rel_tol=1e-4, abs_tol=1e-6)


def test_a_path_that_many_share(spark):
    """Forty segments that always stand together do not make all their combinations."""
    path = "/".join(f"s{i:02}" for i in range(40))
    rows = [(f"http://bad.net/{path}", True)] * 40 + [(f"http://ok{i}.net/x", False) for i in range(80)]
    rules = url_filters.mine_rules(spark.createDataFrame(rows, "url string, bad boolean")).where("verdict = 'block'").collect()
    assert {tuple(x["tokens"]) for x in rules} == {("h=bad",), *((f"p=s{i:02}",) for i in range(40))}


def test_languages_of_held_out_rows(spark, tmp_path):
    r = random.Random(3)
    parts = {"en": "the ing tion and er wh th".split(), "de": "der ung sch keit ein ich \u00fcb".split(), "fr": "le eau que ment aux ou \u00e9".split()}
    rows = []
    for i in range(300):
        lang = r.choice(list(parts))
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randrange(1, 4))) for _ in range(30)), lang if i % 7 else None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    truth = {i: lang for i, _, lang in rows}
    got = language_id.query(spark, str(tmp_path)).collect()
    held = [x for x in got if x["held_out"]]
    assert {x["doc_id"] for x in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    known = [x for x in held if truth[x["doc_id"]]]
    assert len(known) > 30 and sum(x["lang_pred"] == truth[x["doc_id"]] for x in known) >= 0.97 * len(known)
    assert all(0 <= x["score"] <= 1 for x in got)


def test_slots_do_not_depend_on_partitions(spark):
    rows = [(i % 60, f"text {i % 90} " * (1 + i % 7)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, kept = [], {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for n in (1, 5, 8):
            for adaptive in ("true", "false"):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                spark.conf.set("spark.sql.adaptive.enabled", adaptive)
                placed = sharding.shuffle_shards(docs.repartition(n), "doc_id", bucket_bytes=3000, size="doc_id")
                seen.append(sorted((x["shard"], x["slot"], x["doc_id"], x["text"]) for x in placed.collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert all(x == seen[0] for x in seen)
    order = [x[3] for x in seen[0]]
    assert order != sorted(order)  # shuffled it is


def test_shard_key_law(spark):
    """doc_id and the number of shards decide; with one more shard, rows only move into that one."""
    docs = spark.createDataFrame([(i, f"t{i % 7}") for i in range(300)] + [(None, "x")], "doc_id long, text string")
    got = {n: {x["doc_id"]: (x["shard"], x["grown_shard"]) for x in sharding.shuffle_shards(docs, "doc_id", n).collect()} for n in (16, 17)}
    assert {k: v[1] for k, v in got[16].items()} == {k: v[0] for k, v in got[17].items()}
    assert all(b in (a, 16) for a, b in got[16].values()) and len({a for a, _ in got[16].values()}) == 16
