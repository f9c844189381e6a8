"""Graphs of matrices and their analytics. Edges are (src, dst) with src < dst."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.histogram import histogram
from ..matrix import SparseMatrix
from ..sources.storage import Growing, bucketed, discard, store
from . import meeting

#: Pairs of rows that share a column, over all columns, beyond which no overlap graph is made.
MAX_PAIRS = 10**13


def bipartite(m: SparseMatrix) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, side) and edges; columns are numbered after the rows."""
    vertices = m.spark.range(m.nrows + m.ncols).select("id", F.when(F.col("id") < m.nrows, 0).otherwise(1).alias("side"))
    return vertices, m.entries.select(F.col("row").alias("src"), (F.col("col") + m.nrows).alias("dst"))


def row_overlap(m: SparseMatrix, block: int = meeting.BLOCK, most: int = MAX_PAIRS) -> DataFrame:
    """Edges between rows that share a column. A column of d rows makes d * (d - 1) / 2 of them before they are made distinct.

    Columns of more than ``block`` rows are cut, and their blocks meet two by two; pairs are made by the task that has their lower
    row (:mod:`meeting`). Their number is known before any is made, and more than ``most`` are refused.
    """
    cells = m.stored().entries.select(F.col("col").alias("k"), "row")
    columns = store(meeting.sizes(cells).where("a > 1").withColumn("b", F.col("a")), "columns")
    pairs = columns.agg(F.sum(F.col("a").cast("double") * (F.col("a") - 1) / 2)).first()[0] or 0
    if pairs > most:
        raise ValueError(f"{pairs:.3g} pairs of rows share a column (at most {most:.3g} are made)")
    met = meeting.pairs(cells, cells.withColumnRenamed("row", "col"), columns, lambda row, col: col > row, block)
    return met.select(F.col("row").alias("src"), F.col("col").alias("dst")).distinct()


def pattern_graph(m: SparseMatrix) -> DataFrame:
    """Edges of the symmetrised pattern of a square matrix."""
    return m.entries.where("row <> col").select(F.least("row", "col").alias("src"), F.greatest("row", "col").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


#: Edges, both ways, from which a table that rounds join again and again is bucketed, and edges of a bucket.
BUCKETED_EDGES, BUCKET_EDGES = 2_000_000, 500_000


def laid_out(edges: DataFrame, key: str) -> DataFrame:
    """Stored ``edges`` both ways, for rounds that join them by ``key``: many of them in buckets, which no round shuffles."""
    two, many = both_ways(edges), 2 * edges.count()
    if many < BUCKETED_EDGES:
        return store(two, "both-ways")
    return bucketed(two, "both_ways", [key], max(1, many // BUCKET_EDGES))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id)."""
    return edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def degrees(edges: DataFrame, n: int) -> DataFrame:
    d = both_ways(edges).groupBy("src").agg(F.count("*").alias("degree"))
    return edges.sparkSession.range(n).join(d, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def density(edges: DataFrame, n: int) -> DataFrame:
    return edges.agg(F.lit(n).cast("long").alias("nodes"), F.count("*").alias("edges"), F.round(F.try_divide(F.count("*") * 2.0, F.lit(float(n) * (n - 1))), 9).alias("density"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) once each: edges point from the lower degree to the higher, so that hubs open few wedges."""
    d = both_ways(edges).groupBy("src").agg(F.count("*").alias("d"))
    du, dv = (d.select(F.col("src").alias(k), F.col("d").alias("d" + k)) for k in ("src", "dst"))
    e = edges.join(du, "src").join(dv, "dst")
    up = F.struct("dsrc", "src") < F.struct("ddst", "dst")
    o = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v"))
    wedges = o.select("u", F.col("v").alias("v")).join(o.select("u", F.col("v").alias("w")), "u").where("v < w")
    return wedges.join(edges.select(F.col("src").alias("v"), F.col("dst").alias("w")), ["v", "w"]).select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("w").alias("c"))


def average_clustering(edges: DataFrame, n: int) -> DataFrame:
    t = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    c = F.when(F.col("degree") >= 2, F.coalesce("t", F.lit(0)) * 2.0 / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return degrees(edges, n).join(t, "id", "left").agg((F.coalesce(F.sum("t"), F.lit(0)) / 3).cast("long").alias("triangles"), F.round(F.avg(c), 6).alias("average_clustering"))


def components(edges: DataFrame, n: int) -> DataFrame:
    """(id, component), the component's smallest id.

    In a round each vertex joins the one of the least hash among itself and its neighbours, and the graph of those that were joined
    is the next round's; each round hashes anew. The smallest ids are handed up, and the components down. No vertex ever gets
    links to all of its component, so that no task gets them, however large a component is.
    """
    down = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    links, levels = store(down.distinct(), "links"), []
    while not levels or not links.isEmpty():
        drawn = lambda c, k=len(levels): F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("id"))
        best = both_ways(links).groupBy("src").agg(F.min(drawn("dst")).alias("best"))
        joined = store(best.select(F.col("src").alias("id"), F.least(F.col("best"), drawn("src"))["id"].alias("rep")), "joined")
        a, b = (joined.select(F.col("id").alias(x), F.col("rep").alias("r" + x)) for x in ("src", "dst"))
        up = links.join(a, "src").join(b, "dst").where("rsrc <> rdst")
        new = store(up.select(F.greatest("rsrc", "rdst").alias("src"), F.least("rsrc", "rdst").alias("dst")).distinct(), "links")
        discard(links)
        low = joined.withColumn("low", F.col("id")) if not levels else joined.join(levels[-1][1], "id")
        levels.append((joined, store(low.groupBy(F.col("rep").alias("id")).agg(F.min("low").alias("low")), "lows")))
        links = new
    found = None
    for joined, low in reversed(levels):
        if found is not None:  # vertices that had links left in the round after
            low = low.join(found, "id", "left").select("id", F.coalesce("component", "low").alias("low"))
        found = store(joined.join(low.select(F.col("id").alias("rep"), F.col("low").alias("component")), "rep").select("id", "component"), "components")
    discard(links, *[t for level in levels for t in level])
    return edges.sparkSession.range(n).join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def apart(edges: DataFrame, n: int, k: int) -> DataFrame | None:
    """(id, part) of a graph of just k components, numbered by their least vertices; of another None."""
    found = store(components(edges, n), "components")
    least = sorted(r[0] for r in found.select("component").distinct().limit(k + 1).collect())
    if len(least) != k:
        discard(found)
        return None
    names = F.create_map(*[F.lit(x) for place, first in enumerate(least) for x in (first, place)])
    return found.select("id", names[F.col("component")].cast("int").alias("part"))


#: Links of all sources' vertices of which one task of a search takes its share.
TASK_LINKS = 2_000_000


def bfs(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, level) of all that each source (id) reaches, level by level.

    A neighbour of a level lies in it, in the one before, or in the next one: a round reads two levels and writes one. A level may
    hold almost all vertices for each source: large searches go by as many tasks as ``TASK_LINKS`` asks for, which Spark does not join.
    """
    two = store(both_ways(edges), "edges")
    front = store(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("level")).distinct(), "front")
    tasks = two.count() * front.count() // TASK_LINKS
    if tasks:
        stored, two = two, bucketed(two, "edges", ["src"], tasks)
        discard(stored)
    spread = lambda rows: rows.repartition(tasks, "source", "id") if tasks else rows
    seen, before, level = Growing(front, "seen"), None, 0
    while True:
        level += 1
        known = front if before is None else front.unionByName(before)
        near = front.join(two, F.col("id") == F.col("src")).select("source", F.col("dst").alias("id"))
        new = spread(near).distinct().join(spread(known.select("source", "id")), ["source", "id"], "left_anti")
        new = store(new.select("source", "id", F.lit(level).alias("level")), "front")
        if before is not None:
            discard(before)
        if new.isEmpty():
            return seen.all()
        seen.append(new)
        before, front = front, new


#: Vertices up to which all pairs' distances are listed.
ALL_PAIRS = 5_000


def diameter(edges: DataFrame, n: int, batch: int = 64) -> int | None:
    """Largest distance of two vertices, exactly; null of a graph that is not connected.

    A few breadth-first searches bound every vertex's largest distance from both sides: it is at least the distance to a source,
    and at most that and the source's own largest distance. The sources of the next round are among those whose bound lies
    above the largest distance seen (the highest bounds; in each second round, the most linked neighbours of such vertices,
    which bring down many bounds at once), until there are none.
    """
    if n <= 1:
        return 0 if n else None
    edges = store(edges.where("src <> dst").distinct(), "graph")
    degree, two = store(degrees(edges, n), "degrees"), both_ways(edges)
    sources = [r["id"] for r in degree.orderBy(F.col("degree").desc(), "id").limit(batch).collect()]
    bounds, turn = None, 0
    while True:
        found = bfs(edges, edges.sparkSession.createDataFrame([(x,) for x in sources], "id long"))
        far = found.groupBy("source").agg(F.max("level").alias("far"), F.count("*").alias("n"))
        if bounds is None and far.where(F.col("n") < n).limit(1).count():
            return None
        met = found.join(far, "source")
        new = met.groupBy("id").agg(F.max(F.greatest("level", F.col("far") - F.col("level"))).alias("low"), F.min(F.col("far") + F.col("level")).alias("high"))
        if bounds is not None:
            new = new.unionByName(bounds).groupBy("id").agg(F.max("low").alias("low"), F.min("high").alias("high"))
        new = store(new, "bounds")
        if bounds is not None:
            discard(bounds)
        bounds, turn = new, turn + 1
        low = bounds.agg(F.max("low")).first()[0]
        open_ = bounds.where(F.col("high") > low)
        order = [F.col("high").desc(), F.xxhash64("id"), F.col("id")]
        if turn % 2:
            beside = open_.join(two, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("links"))
            done = bounds.where("low = high").select("id")
            near = beside.join(done, "id", "left_anti").orderBy(F.col("links").desc(), "id").limit(batch).collect()
            sources = [r["id"] for r in near] or [r["id"] for r in open_.orderBy(*order).limit(batch).collect()]
        else:
            sources = [r["id"] for r in open_.orderBy(*order).limit(batch).collect()]
        if open_.isEmpty():
            return int(low)


#: Links of a graph of which each task that searches it holds all; sources that one pass of a task takes, and a search of larger graphs.
CORE_LINKS, SOURCES, BATCH = 4_000_000, 64, 256


def _folded(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
    """(vertices (id, w), edges, distances): a connected graph without its hanging vertices, each of which counts where it hangs.

    The edge of a hanging vertex that stands for w of n vertices lies on the ways of w (n - w) pairs. Rounds end when few links
    are left or few vertices hang: what is left is searched, so that this changes the effort only.
    """
    vertices, past = store(edges.sparkSession.range(n).withColumn("w", F.lit(1).cast("long")), "vertices"), 0
    while n > 2:
        left, links = vertices.count(), edges.count()
        if left <= SOURCES or links <= ALL_PAIRS:
            break
        hanging = both_ways(edges).groupBy("src").agg(F.count("*").alias("k"), F.min("dst").alias("to")).where("k = 1").select(F.col("src").alias("id"), "to")
        gone = store(hanging.join(vertices, "id"), "hanging")
        k, ways = gone.agg(F.count("*"), F.sum((F.col("w") * (F.lit(n) - F.col("w"))).cast("decimal(38,0)"))).first()
        if k < left / 16:
            discard(gone)
            break
        past += int(ways)
        more = gone.groupBy(F.col("to").alias("id")).agg(F.sum("w").alias("more"))
        kept = store(vertices.join(gone.select("id"), "id", "left_anti").join(more, "id", "left").select("id", (F.col("w") + F.coalesce("more", F.lit(0))).cast("long").alias("w")), "vertices")
        end = lambda x: gone.select(F.col("id").alias(x))
        rest = store(edges.join(end("src"), "src", "left_anti").join(end("dst"), "dst", "left_anti").select("src", "dst"), "graph")
        discard(vertices, edges, gone)
        vertices, edges = kept, rest
    return vertices, edges, past


def _searched(batches):
    """Over rows (task, tasks, ids, ws, src, dst), a whole graph each: the weighted distances from this task's vertices, 64 sources at once."""
    total = 0
    for batch in batches:
        for k in range(batch.num_rows):
            task, tasks = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            ids, w, src, dst = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in range(2, 6))
            src, dst = np.searchsorted(ids, src), np.searchsorted(ids, dst)
            at, to = np.r_[src, dst], np.r_[dst, src]
            to = to[np.argsort(at, kind="stable")]
            first = np.r_[0, np.cumsum(np.bincount(at, minlength=len(ids)))[:-1]]
            for begin in range(task * SOURCES, len(ids) if len(to) else 0, tasks * SOURCES):
                own = np.arange(begin, min(begin + SOURCES, len(ids)))
                front = np.zeros(len(ids), np.uint64)
                front[own] = np.uint64(1) << (own - begin).astype(np.uint64)
                seen, level = front.copy(), 0
                while True:
                    level += 1
                    front = np.bitwise_or.reduceat(front[to], first) & ~seen
                    seen |= front
                    met = np.flatnonzero(front)
                    if not len(met):
                        break
                    for part in np.array_split(met, len(met) // 65536 + 1):
                        bits = np.unpackbits(front[part].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : len(own)]
                        total += level * int((w[part] @ bits.astype(np.int64) * w[own]).sum())
    yield pa.RecordBatch.from_arrays([pa.array([str(total)])], names=["ways"])


def distance_sum(edges: DataFrame, n: int, core_links: int | None = None) -> int:
    """Distances of all ordered pairs of a connected graph added up, exactly.

    Hanging vertices are folded first. The rest is searched from each vertex: in tasks that hold all of it up to ``core_links`` links,
    else level by level across the cluster, ``BATCH`` sources at once. Its time is quadratic by nature; its memory and disk are not.
    """
    core_links = CORE_LINKS if core_links is None else core_links
    once = store(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "graph")
    vertices, rest, past = _folded(once, n)
    left, spark, total = vertices.count(), edges.sparkSession, 0
    if 2 * rest.count() <= core_links:
        listed = lambda rows, *cols: store(rows.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("e")).select(*[F.col(f"e.{c}").alias(c) for c in cols]), "core")
        ids, links = listed(vertices, "id", "w"), listed(rest, "src", "dst")
        tasks = min(-(-left // SOURCES), 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        rows = spark.range(0, tasks, 1, tasks).select(F.col("id").alias("task"), F.lit(tasks).cast("long").alias("tasks")).hint("shuffle_replicate_nl").crossJoin(ids.hint("shuffle_replicate_nl")).crossJoin(links.hint("shuffle_replicate_nl"))
        ways = rows.mapInArrow(_searched, "ways string").agg(F.sum(F.col("ways").cast("decimal(38,0)"))).first()[0]
        total = int(ways or 0)
        discard(ids, links)
    else:
        deals = -(-left // BATCH)
        weight = lambda x: vertices.select(F.col("id").alias(x), F.col("w").alias("w" + x))
        for deal in range(deals):
            found = bfs(rest, vertices.where(F.pmod(F.xxhash64("id"), F.lit(deals)) == deal).select("id"))
            ways = found.join(weight("source"), "source").join(weight("id"), "id").agg(F.sum(F.col("level").cast("decimal(38,0)") * F.col("wsource") * F.col("wid"))).first()[0]
            total += int(ways or 0)
            discard(found)
    discard(vertices, rest)
    return total + 2 * past


def distances(edges: DataFrame, n: int) -> DataFrame:
    """Diameter and average shortest path of a connected graph, exactly at any size; null of another.

    Of up to ``ALL_PAIRS`` vertices all pairs are listed; of more the diameter is found by bounds, and the distances are added up
    (:func:`distance_sum`).
    """
    if n > ALL_PAIRS:
        widest = diameter(edges, n)
        ways = None if widest is None else float(distance_sum(edges, n))
        one = edges.sparkSession.createDataFrame([(widest, ways)], "diameter long, ways double")
        return one.select("diameter", F.round(F.col("ways") / float(n * (n - 1)), 6).alias("average_shortest_path"))
    d = bfs(edges, edges.sparkSession.range(n))
    full = F.count("*") == n * n
    return d.agg(F.when(full, F.max("level")).cast("long").alias("diameter"), F.when(full, F.round(F.sum("level") / float(max(1, n * (n - 1))), 6)).alias("average_shortest_path"))


def degree_histogram(edges: DataFrame, n: int, bins: int = 10) -> DataFrame:
    return histogram(degrees(edges, n), "degree", bins)


def properties(edges: DataFrame, n: int, bins: int = 10) -> DataFrame:
    """One row: size, density, degrees and their histogram, components and, of a connected graph, distances and clustering."""
    edges = store(edges, "graph")
    degree, comp = store(degrees(edges, n), "degrees"), store(components(edges, n), "components")
    sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
    # A component's size and how many have it: far fewer rows than components.
    per_size = sizes.groupBy("size").agg(F.count("*").alias("components"))
    parts = per_size.agg(
        F.coalesce(F.sum("components"), F.lit(0)).alias("num_components"), F.max("size").alias("largest_component_size"),
        F.array_sort(F.collect_list(F.struct("size", "components"))).alias("component_sizes"),
    )
    spread = degree.agg(*[F.round(f("degree"), 6).alias(f"{x}_degree") for x, f in (("avg", F.avg), ("std", F.stddev_pop))], F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))
    hist = histogram(degree, "degree", bins).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias("degree_distribution"))
    tables = [density(edges, n), spread, hist, parts.withColumn("is_connected", F.col("num_components") == 1)]
    if comp.select("component").distinct().count() == 1:
        tables += [distances(edges, n), average_clustering(edges, n).select("average_clustering")]
    else:
        tables.append(edges.sparkSession.range(1).select(F.lit(None).cast("long").alias("diameter"), *[F.lit(None).cast("double").alias(x) for x in ("average_shortest_path", "average_clustering")]))
    return beside(*tables)


def beside(*ones: DataFrame) -> DataFrame:
    """Tables of one row each as one row: a union of a few rows and one aggregate, no joins."""
    rows = ones[0]
    for t in ones[1:]:
        rows = rows.unionByName(t, allowMissingColumns=True)
    return rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns])  # each column has one value
