"""Line dedup by site-relative frequency (DataFrame functions only).

A line that stands on more than ``ratio`` of a host's pages is boilerplate of that host and is dropped there; other hosts
keep it. A page counts once for a line however often it repeats it. Blank lines are neither counted nor dropped. The ratio
alone decides on every host, of however many pages; so on a host of fewer than 1 / ratio pages each line goes. Who wants to
keep lines that no other page repeats gives ``min_pages`` (2: a line must stand on two pages at least).

A page of which no content line would be left may be a copy of other pages, which near-duplicate removal judges, rather than
a template: with ``keep_whole`` its text stays, and ``n_boilerplate`` still tells how many of its lines exceed the ratio.

Lines are told apart by 64-bit hashes: two different lines of a host are taken for one once in 2^64 pairs.

Defined cases: a null or empty text stays as it is; a null host is a host of its own; repeated rows count as
pages; a text of any length is taken whole; a line at the ratio exactly stays; other columns pass through, and an added
column whose name is taken gets an underscore behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_name, materialise

#: A line on more than this share of the host's pages is boilerplate.
RATIO = 0.1
#: Rows of the boilerplate table up to which it is broadcast (16 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Boilerplate lines of a host up to which a page's lines are held against all of them, one by one.
HOST_LINES = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def boilerplate_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = 1) -> DataFrame:
    """(host, line_hash, n_pages, host_pages) of the lines above the ratio, on ``min_pages`` at least.

    Counting shuffles one (host, hash) pair per distinct line of a task; a host of any size is spread over the
    cluster because the hash is part of the key.
    """
    page = pages.select(F.col(host).alias("host"), F.col(text).alias("t"))
    totals = page.groupBy("host").agg(F.count("*").alias("host_pages"))
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("t")), lambda x: ~_blank(x)), lambda x: F.xxhash64(x)))
    counts = page.select("host", F.explode(hashes).alias("line_hash")).groupBy("host", "line_hash").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    return (
        counts.alias("c")
        .join(totals.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host")))
        .where(F.col("n_pages") > F.col("host_pages") * F.lit(ratio))
        .select("c.host", "line_hash", "n_pages", "host_pages")
    )


def dedup_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = 1, broadcast_rows: int = BROADCAST_ROWS, keep_whole: bool = False) -> DataFrame:
    """``pages`` with boilerplate lines cut from ``text``, plus ``n_lines``, ``n_dropped`` and ``n_boilerplate`` (of non-blank lines)."""
    total, dropped, above = (free_name(pages, x) for x in ("n_lines", "n_dropped", "n_boilerplate"))
    spark, columns = pages.sparkSession, pages.columns
    bad = materialise(boilerplate_lines(pages, host, text, ratio, min_pages).select("host", "line_hash"), "boilerplate")
    drop, site, key = (free_name(pages, x) for x in ("drop_hashes", "drop_site", "drop_key"))
    per_host = bad.groupBy("host").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    if (per_host[0] or 0) <= broadcast_rows and (per_host[1] or 0) <= HOST_LINES:
        sets = bad.groupBy("host").agg(F.collect_set("line_hash").alias(drop)).withColumnRenamed("host", site)
        joined = pages.join(F.broadcast(sets), F.col(host).eqNullSafe(F.col(site)), "left")
    else:
        # The table of boilerplate may be of any size: find each page's lines in it first, then send a page only its own.
        keyed = pages.withColumn(key, F.xxhash64(*[F.col(c) for c in (host, text)]))
        found = (
            keyed.select(key, F.col(host).alias(site), F.explode(F.array_distinct(F.transform(_lines(F.col(text)), lambda x: F.xxhash64(x)))).alias("line_hash"))
            .distinct()
            .alias("p")
            .join(bad.alias("b"), (F.col("p.line_hash") == F.col("b.line_hash")) & F.col(site).eqNullSafe(F.col("b.host")))
            .groupBy(F.col(key))
            .agg(F.collect_set("p.line_hash").alias(drop))
        )
        joined = keyed.join(found, key, "left")
    lines = F.filter(_lines(F.col(text)), lambda x: ~_blank(x))
    kept = F.filter(_lines(F.col(text)), lambda x: _blank(x) | ~F.array_contains(F.col(drop), F.xxhash64(x)))
    has = F.col(drop).isNotNull() & F.col(text).isNotNull()
    n_lines, left, cleaned = (free_name(pages, x) for x in ("line_total", "line_left", "line_text"))
    out = joined.withColumn(cleaned, F.when(has, kept))
    out = out.withColumns({n_lines: F.coalesce(F.size(lines), F.lit(0)), left: F.when(has, F.size(F.filter(F.col(cleaned), lambda x: ~_blank(x))))})
    cut = has & (F.col(left) < F.col(n_lines)) & (F.lit(not keep_whole) | (F.col(left) > 0))
    body = F.when(cut, F.array_join(F.col(cleaned), "\n")).otherwise(F.col(text))
    more = [F.when(F.col(text).isNull(), 0).otherwise(F.col(n_lines)).cast("long").alias(total), F.when(cut, F.col(n_lines) - F.col(left)).otherwise(0).cast("long").alias(dropped)]
    more.append(F.when(has, F.col(n_lines) - F.col(left)).otherwise(0).cast("long").alias(above))
    return out.select(*[body.alias(c) if c == text else F.col(f"`{c}`") for c in columns], *more)


def query(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", "n_boilerplate", F.sha2("text", 256).alias("text_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, text FROM documents),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM d),
t AS (SELECT source, count(*) AS n FROM d GROUP BY 1),
bad AS (SELECT c.source, c.line FROM (SELECT source, line, count(DISTINCT doc_id) AS k FROM l WHERE trim(line) <> '' GROUP BY 1, 2) c
        JOIN t ON t.source IS NOT DISTINCT FROM c.source WHERE k > n * {RATIO}),
m AS (SELECT l.*, bad.line IS NOT NULL AS dropped FROM l LEFT JOIN bad ON bad.source IS NOT DISTINCT FROM l.source AND bad.line = l.line),
a AS (SELECT doc_id, count(*) FILTER (trim(line) <> '') AS n_lines, count(*) FILTER (dropped) AS n_drop,
             string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped) AS cleaned FROM m GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_drop, 0)::BIGINT AS n_dropped, coalesce(n_drop, 0)::BIGINT AS n_boilerplate,
       sha256(CASE WHEN n_drop > 0 THEN coalesce(cleaned, '') ELSE text END) AS text_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""
