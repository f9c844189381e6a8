"""WARC records and a Merkle fixity audit of independent replicas (DataFrame functions only).

Each replica is laid out by itself. A record's place follows from its key alone: the first hexadecimal digits of the
key's hash name a range of keys, which is the same in every replica whatever else it holds, so that a lost or added
record moves no other one into another range. Within a range records stand in the order of a hash of their content,
and of these bytes; ranges follow one another, and a file is a number of neighbouring ranges.

Records of a range are hashed, each with its key, length and number of copies, in buckets of their content's hash (a
key that very many records share fills many buckets); a range's hash covers its buckets in order with their bytes, and
``FANOUT`` neighbouring ranges hash into the node above, which covers its children's numbers, bytes (and so their
ordered offset ranges) and hashes, up to one root per replica. Two replicas are compared by their roots; only the
children of nodes that differ are looked at, level by level. In the buckets that differ the records themselves are
compared, and their byte ranges are worked out on the way down.

Defined cases: equal records are stored once with a count of copies, which the hash covers; a null URL or body is
written as empty; null keys are keys; a record that only we have is ``changed`` where the replica has another one of
its key that we lack (the least digest of these is given), else ``missing``; one that only the replica has, of a key
of which we lack no other, is ``extra``; other numbers of copies of one record are a change; a record may be of any
length, as only digests travel; an empty archive has no nodes, and against it all of the other's records are findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, table

FANOUT = 16
#: Records in a range of keys, about.
RANGE_ROWS = 16
#: Bits of the content's hash that deal a range's records into buckets.
BUCKET_BITS = 16
#: Bytes of records in a file, about.
FILE_BYTES = 16 << 20


def record_bytes(url: Column, body: Column) -> Column:
    """A response record as text: version line, headers, blank line, body, two line ends."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def depth_for(rows: int) -> int:
    """Digits of the key's hash that make ranges of about RANGE_ROWS records."""
    d = 0
    while FANOUT**d * RANGE_ROWS < rows:
        d += 1
    return d


def lay_out(records: DataFrame, key: list[str], depth: int, length: str = "length", digest: str = "digest") -> DataFrame:
    """(k, key columns, length, digest, copies, node, bucket): distinct records of one replica and their places."""
    rows = records.groupBy(*key, F.col(length).cast("long").alias("length"), F.col(digest).alias("digest")).agg(F.count("*").alias("copies"))
    node = F.shiftrightunsigned(F.xxhash64(*key), 64 - 4 * depth) if depth else F.lit(0).cast("long")
    bucket = F.shiftrightunsigned(F.xxhash64("digest", "length"), 64 - BUCKET_BITS)
    return rows.withColumns({"k": F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256), "node": node, "bucket": bucket})


def _hash_of(children: Column, *fields: str) -> Column:
    return F.sha2(F.array_join(F.transform(children, lambda x: F.concat_ws(",", *[x[f].cast("string") for f in fields])), ";"), 256)


def _sum_of(children: Column, field: str) -> Column:
    return F.aggregate(children, F.lit(0).cast("long"), lambda s, x: s + x[field])


def merkle_tree(placed: DataFrame, depth: int) -> list[DataFrame]:
    """Tables (up, node, bytes, hash) from the root to the ranges, and last the buckets of the ranges (up is the range)."""

    def above(rows: DataFrame, by: list[str], fields: tuple[str, ...]) -> DataFrame:
        out = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("c"))
        return out.select(*by, _sum_of(F.col("c"), fields[1]).alias("bytes"), _hash_of(F.col("c"), *fields).alias("hash"))

    buckets = above(placed.select("node", "bucket", "digest", "length", "copies", "k"), ["node", "bucket"], ("digest", "length", "copies", "k"))
    levels = [materialise(buckets.select(F.col("node").alias("up"), F.col("bucket").alias("node"), "bytes", "hash"), "tree")]
    up = F.col("up").alias("node")
    for k in range(depth, -1, -1):
        ranges = above(levels[0], ["up"], ("node", "bytes", "hash")).select(up, "bytes", "hash")
        levels.insert(0, materialise(ranges.select(F.shiftright("node", 4).alias("up"), "node", "bytes", "hash"), "tree"))
    return levels


def descend(ours: list[DataFrame], theirs: list[DataFrame], file_level: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """Buckets that differ (up, node, file, a_lo, b_lo: the bytes before them in their file), and the nodes compared at each level."""
    differ, looked = None, []
    for level, sides in enumerate(zip(ours, theirs, strict=True)):
        last = level == len(ours) - 1
        rows = []
        for side, name in zip(sides, "ab", strict=True):
            if differ is not None:  # the children of what differs: at most FANOUT, or the buckets of a range
                parents = differ.select(F.col("node").alias("up"), "file", F.col(f"{name}_lo").alias("base"))
                before = Window.partitionBy("up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
                side = side.join(parents, "up").withColumn("lo", F.col("base") + F.coalesce(F.sum("bytes").over(before), F.lit(0)))
            else:
                side = side.withColumns({"lo": F.lit(0).cast("long"), "file": F.lit(0).cast("long")})
            if level <= file_level:
                side = side.withColumns({"lo": F.lit(0).cast("long"), "file": F.col("node")})
            rows.append(side.select("up", "node", "file", F.col("lo").alias(f"{name}_lo"), F.col("hash").alias(f"{name}_hash")))
        both = rows[0].join(rows[1], ["up", "node", "file"], "full_outer")
        looked.append(both)
        here = both.where(~F.col("a_hash").eqNullSafe(F.col("b_hash")))
        here = here.withColumns({x: F.coalesce(x, F.lit(0)).cast("long") for x in ("a_lo", "b_lo")})
        differ = materialise(here.select("up", "node", "file", "a_lo", "b_lo"), "differ")
        if last:
            return differ, looked
    raise ValueError("a tree has a root at least")


def audit(ours: DataFrame, theirs: DataFrame, key: list[str], depth: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Findings: key columns, status, length, copies, digest, replica_digest, and file, lo, hi: where the record stands.

    ``ours`` and ``theirs`` as :func:`lay_out` gives them, each from its own records; a range is in a file of its own side.
    """
    a, b = materialise(ours, "layout"), materialise(theirs, "layout")
    total = a.agg(F.sum("length")).first()[0] or 0
    level = 0
    while level < depth and FANOUT**level * file_bytes < total:
        level += 1
    differ, _ = descend(merkle_tree(a, depth), merkle_tree(b, depth), level)
    own = ["k", "length", "digest", "copies"]
    sides = []
    for rows, name in ((a, "a"), (b, "b")):
        at = differ.select(F.col("up").alias("node"), F.col("node").alias("bucket"), "file", F.col(f"{name}_lo").alias("base"))
        before = Window.partitionBy("node", "bucket").orderBy("digest", "length", "copies", "k").rowsBetween(Window.unboundedPreceding, -1)
        sides.append(materialise(rows.join(at, ["node", "bucket"]).withColumn("lo", F.col("base") + F.coalesce(F.sum("length").over(before), F.lit(0))).drop("base"), "suspects"))
    alone = [x.join(y.select(*own), own, "left_anti") for x, y in (sides, sides[::-1])]  # no column of these is null
    alone = [materialise(x.select(*key, *own, "file", "lo", (F.col("lo") + F.col("length")).alias("hi")), "alone") for x in alone]
    lost, new = (x.groupBy("k").agg(F.min("digest").alias("other")) for x in alone)
    changed = alone[0].join(new, "k", "left")
    extra = alone[1].join(lost, "k", "left_anti")
    return changed.select(*key, F.when(F.col("other").isNull(), "missing").otherwise("changed").alias("status"), "length", "copies", "digest", F.col("other").alias("replica_digest"), "file", "lo", "hi").unionByName(
        extra.select(*key, F.lit("extra").alias("status"), "length", "copies", F.lit(None).cast("string").alias("digest"), F.col("digest").alias("replica_digest"), "file", "lo", "hi")
    )


def faulty_replica(pages: DataFrame) -> DataFrame:
    """What a mirror holds whose transfer had three faults: a transcoding made each sharp s an umlaut of the same width, URLs with
    a fragment got lost, and pages of mobile hosts came a second time from the plain host."""
    kept = pages.where("url IS NULL OR NOT contains(url, '#')").withColumn("html", F.translate("html", "ß", "ü"))
    again = kept.where("contains(url, '://m.')").withColumn("url", F.replace("url", F.lit("://m."), F.lit("://")))
    return kept.unionByName(again)


def catalogue(pages: DataFrame) -> DataFrame:
    """page_id, url, length and digest of the pages' records."""
    whole = record_bytes(F.col("url"), F.col("html"))
    return pages.select("page_id", "url", F.octet_length(whole).cast("long").alias("length"), F.sha2(whole, 256).alias("digest"))


def query(spark, sf_dir: str) -> DataFrame:
    pages, key = table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id", "url"]
    depth = depth_for(pages.count())
    found = audit(lay_out(catalogue(pages), key, depth), lay_out(catalogue(faulty_replica(pages)), key, depth), key, depth)
    return found.select("page_id", "url", "status", "length", "copies", "digest", "replica_digest")


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
kept AS (SELECT page_id, url, replace(html, 'ß', 'ü') AS html FROM p WHERE url IS NULL OR NOT contains(url, '#')),
q AS (SELECT * FROM kept UNION ALL SELECT page_id, replace(url, '://m.', '://'), html FROM kept WHERE contains(url, '://m.')),
r AS (SELECT 'a' AS side, * FROM p UNION ALL SELECT 'b', * FROM q),
w AS (SELECT side, page_id, url, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(html)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM r),
d AS (SELECT side, page_id, url, strlen(record)::BIGINT AS length, count(*)::BIGINT AS copies, sha256(record) AS digest FROM w GROUP BY ALL),
alone AS (SELECT * FROM d x WHERE NOT EXISTS (SELECT 1 FROM d y WHERE y.side <> x.side AND y.page_id IS NOT DISTINCT FROM x.page_id AND y.url IS NOT DISTINCT FROM x.url
  AND y.length = x.length AND y.copies = x.copies AND y.digest = x.digest)),
k AS (SELECT side, page_id, url, min(digest) AS least FROM alone GROUP BY ALL)
SELECT a.page_id, a.url, CASE WHEN k.side IS NULL THEN 'missing' ELSE 'changed' END AS status, length, copies, digest, k.least AS replica_digest
FROM alone a LEFT JOIN k ON k.side = 'b' AND k.page_id IS NOT DISTINCT FROM a.page_id AND k.url IS NOT DISTINCT FROM a.url WHERE a.side = 'a'
UNION ALL
SELECT a.page_id, a.url, 'extra', length, copies, NULL, digest
FROM alone a LEFT JOIN k ON k.side = 'a' AND k.page_id IS NOT DISTINCT FROM a.page_id AND k.url IS NOT DISTINCT FROM a.url WHERE a.side = 'b' AND k.side IS NULL
"""
