"""Cases in which an operator once did less than its whole job."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from kelvane.llm import jaccard_join, sharding, suffix_dedup, url_filters


def test_links_across_hot_clusters(spark, monkeypatch):
    """Two near copies, each with a common passage that the other has not; what they share is led by a longer document."""
    monkeypatch.setattr(jaccard_join, "HOT_RUN", 4)
    r = random.Random(357)
    new = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    common, p, q = new(42), new(20), new(20)
    texts = [common + p, common + q, common + new(90)]
    texts.append(texts[2][42:] + new(250))
    for passage in (p, q):
        texts += [passage + new(20) for _ in range(6)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in texts]
    linked = {(a, b) for b in range(len(sets)) for a in range(b) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert linked == {(0, 1)}
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join_classes(docs, 50, 3).collect()}
    assert got == {i: 0 if i == 1 else i for i in range(len(texts))}


def test_shards_hold_the_documents(spark, tmp_path):
    """The query's path: documents of many bytes fill several buckets a shard, and the shards as written hold them whole."""
    rows = [(i % 90, None if i % 31 == 0 else f"text {i % 80} " * 60, f"s{i % 2}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    placed = sharding.shuffle_shards(docs, "doc_id", bucket_bytes=4000, size=F.octet_length("text"))
    sharding.write_shards(placed, str(tmp_path / "shards"))
    back = spark.read.schema(placed.schema).parquet(str(tmp_path / "shards"))
    assert sorted(map(repr, back.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    files = {}
    for r in back.withColumn("file", F.input_file_name()).select("shard", "bucket", "slot", "file").collect():
        assert f"shard={r['shard']}/" in r["file"]
        files.setdefault((r["shard"], r["bucket"]), {}).setdefault(r["file"], []).append(r["slot"])
    assert all(len(f) == 1 for f in files.values())  # a bucket is one file, in slot order
    assert all(s == list(range(s[0], s[0] + len(s))) for f in files.values() for s in f.values())
    assert len(files) > 2 * len({s for s, _ in files})
    for s in {s for s, _ in files}:
        assert sorted(x for (t, _), f in files.items() if t == s for v in f.values() for x in v) == list(range(sum(len(v) for (t, _), f in files.items() if t == s for v in f.values())))


def test_sharding_query_moves_texts(spark, tmp_path, monkeypatch):
    """What goes through the shuffle and into the shards is the whole record."""
    seen = []
    write = sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda placed, path: (seen.append(placed.columns), write(placed, path)))
    spark.createDataFrame([(1, "one", "en"), (1, "one", "en"), (2, None, "de")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.query(spark, str(tmp_path)).collect())
    crc = zlib.crc32(b"one")
    assert got == [(1, 4, crc), (1, 4, crc), (2, 1, 0)]
    assert seen == [["doc_id", "text", "lang", "shard", "grown_shard", "bucket", "slot"]]


def test_rules_of_four_tokens(spark):
    """Four tokens tell what no three of them do; and of a rule and a much longer one that it implies, the short one stays."""
    own = ("aaa", "bbb", "ccc", "ddd")
    url = lambda t: f"http://{t[0]}.{t[1]}/{t[2]}?{t[3]}=1"
    rows = [(url(own), True)] * 30 + [(url([f"x{i}" if j == k else t for j, t in enumerate(own)]), False) for k in range(4) for i in range(30)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules = url_filters.mine_rules(labelled).where("verdict = 'block'").collect()
    assert [tuple(r["tokens"]) for r in rules] == [("h=aaa", "h=bbb", "p=ccc", "q=ddd")]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(pages, labelled).collect()}
    assert all((got[i] == "block") == bad for i, (_, bad) in enumerate(rows))
    spam = spark.createDataFrame([("http://spam.one/two/three?four", True)] * 30 + [(f"http://good{i}.one/two/three?four", False) for i in range(30)], "url string, bad boolean")
    assert [tuple(r["tokens"]) for r in url_filters.mine_rules(spam).where("verdict = 'block'").collect()] == [("h=spam",)]


def test_near_copies_keep_one_row(spark):
    import corpus_pipeline

    t = " ".join(f"word{i}" for i in range(60))
    rows = [(1, t), (1, t), (1, t + " more"), (2, t), (2, t), (3, "another text of a few words"), (None, t), (None, t)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got) == [-1, -1, 1, 3]
    assert {(r["doc_id"], r["text"]) for r in got} <= set(rows)


@pytest.mark.parametrize("hot", [500, 1])
def test_copies_of_ids_with_several_texts(spark, hot):
    """An id that has a copy and another text is searched like any other; copies are found the same by broadcast and by shuffle."""
    r = random.Random(4)
    a, b, c = ("".join(r.choice("abcdefghij ") for _ in range(n)) for n in (300, 260, 400))
    rows = [(3, a), (5, a), (5, b), (7, b[:150] + c), (8, c), (9, c), (9, c), (10, "short"), (11, "short")]
    got = {(x["doc_id"], x["n_bytes"]): (x["n_removed"], x["n_spans"], x["cut_starts"], x["cut_ends"]) for x in suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3, 300][0] == got[10, 5][0] == 0
    assert got[5, 300] == (300, 1, [0], [300])
    assert got[7, 550] == (150, 1, [0], [150])  # b stands in document 5 first
    assert got[8, 400] == got[9, 400] == (400, 1, [0], [400])
    meta = spark.createDataFrame([(i, "d%d" % (i % 3), 200) for i in range(60)] + [(2, "d9", 200), (70, "d2", 200), (70, "d2", 200)], "doc_id long, digest string, n long")
    copies = sorted(x["doc_id"] for x in suffix_dedup._copies(meta, 63, hot).collect())
    assert copies == [*range(3, 60), 70]


def test_suffix_dedup_deals_texts_once(spark):
    """Both joins by id read one exchange of the texts."""
    rows = [(i, "text %d " % (i % 3) * 40) for i in range(20)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
        out.collect()
        assert "ReusedExchange [doc_id#" in out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_comparisons_in_deals(spark, monkeypatch):
    """What is compared in deals gives the same rows, and what a table that was written had shuffled is gone."""
    import random

    from kelvane.llm import jaccard_join

    r = random.Random(8)
    base = [" ".join(f"w{r.randrange(300)}" for _ in range(60)) for _ in range(8)]
    rows = [(i, " ".join([*base[i % 8].split()[: 60 - i % 3], f"x{i}"])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "HOT_RUN", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    result = lambda: sorted(map(tuple, jaccard_join.join_classes(docs, 80).collect()))
    whole = result()
    assert len({x[2] for x in whole}) < 20
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left = lambda: sum(f.getName().startswith("shuffle_") for f in [disk.getAllFiles().apply(i) for i in range(disk.getAllFiles().size())])
    before = left()
    table = jaccard_join.materialise(docs.groupBy("text").count().repartition(7), "swept")
    assert left() <= before and table.count() == 80
    monkeypatch.setattr(jaccard_join, "DEAL_BYTES", 3_000)
    deals, settle = [], jaccard_join.settle
    monkeypatch.setattr(jaccard_join, "settle", lambda make, name: (deals.append(name), settle(make, name))[1])
    assert result() == whole and deals.count("deal") > 3
