"""Balanced multilevel partitioning of many weighted graphs at once.

Vertices (id, grp, w) belong to a group, a graph of its own: bisecting all parts of a level at once is one call. Edges
(src, dst, w) join vertices of one group, once each with src < dst. A group's parts may take shares of its weight.

Coarsening merges vertices along heavy edges up to a weight limit, in rounds over all groups; weights of vertices and edges
are added up, so that a cut of the coarse graph is a cut of the fine one. Once a group has ``START`` vertices a part at most, a
task splits it (several starts, each improved by Fiduccia-Mattheyses passes). On the way back each level moves boundary
vertices in rounds: a move must lower the cut, no two neighbours move at once, and what moves into or out of a part stays within
its bounds, so no round raises the cut or breaks the balance.

Joins by vertex deal both sides on levels of more than ``SENT`` vertices. Spark would send a table of up to 10 MB to all tasks: up to
36 MB each as a hash table, several of them in a step, all of which the driver makes and holds.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import discard, store
from . import graphs

#: How far a part's weight may lie from its share.
TOLERANCE = 0.05
#: Vertices at which coarsening of a group ends: so many, or for each part (and 1 / tolerance); a task splits at most the last number.
TASK_START, START, START_MOST = 600, 3, 3_000
#: Rounds of moves on each level.
ROUNDS = 2
#: Deals of the moves of one gain into one part.
DEALS = 64
#: Vertices up to which a table of them may be sent to all tasks.
SENT = 50_000
_LONG = 2**62


def unsent(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` as a side of a join by vertex: those of more than ``SENT`` vertices do not go through the driver."""
    return rows.hint("merge") if n > SENT else rows


def grouped(vertices: DataFrame, shares: list[float], tolerance: float = TOLERANCE) -> DataFrame:
    """Vertices (id, grp, w) plus the bounds of their group's parts (lo, hi) and the weight limit of a coarse vertex (most)."""
    k = len(shares)
    total = vertices.groupBy("grp").agg(F.sum("w").alias("total"))
    lo, hi = ([(F.col("total") * s * (1 + sign * tolerance)).alias("x") for s in shares] for sign in (-1, 1))
    # Whole weights: the next whole number above an exact share is always allowed.
    lo = F.array(*[F.least(F.floor(F.col("total") * s), F.ceil(x)).cast("double") for s, x in zip(shares, lo, strict=True)])
    hi = F.array(*[F.greatest(F.ceil(F.col("total") * s), F.floor(x)).cast("double") for s, x in zip(shares, hi, strict=True)])
    limit = F.greatest(F.col("total") * tolerance * min(shares), F.col("total") * 3 / START_MOST, F.lit(1.0))
    return vertices.join(total.select("grp", lo.alias("lo"), hi.alias("hi"), limit.alias("most")), "grp").select("id", "grp", F.col("w").cast("double").alias("w"), "lo", "hi", "most")


def _twice(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def matching(vertices: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """``vertices`` plus lead, the vertex that stands for all that merge with this one.

    Each vertex proposes to the neighbour by the heaviest edge (then the lighter one, then by hash) that it may merge with; who
    propose to each other merge. The light ones of the others that propose to one and the same vertex merge about two by two,
    dealt by hash, or a star would lose one leaf a round; vertices without an edge do so within their group.
    """
    theirs, own = vertices.select(F.col("id").alias("dst"), F.col("w").alias("theirs")), vertices.select(F.col("id").alias("src"), F.col("w").alias("own"), "most")
    ends = _twice(edges).join(unsent(theirs, n), "dst").join(unsent(own, n), "src")
    order = F.struct(F.col("own") + F.col("theirs") <= F.col("most"), "w", -F.col("theirs"), F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst")), F.col("dst").alias("to"))
    wish = ends.groupBy("src").agg(F.max(order).alias("best"))
    wish = store(vertices.join(unsent(wish.select(F.col("src").alias("id"), F.col("best.to").alias("to"), F.col("best.col1").alias("fits")), n), "id", "left"), "wishes")
    back = wish.where("fits").select(F.col("id").alias("to"), F.col("to").alias("id"), F.lit(True).alias("mutual"))
    met = wish.join(unsent(back, n), ["id", "to"], "left")
    alone = -1 - F.xxhash64("grp").bitwiseAND(_LONG - 1)  # no vertex has such a number
    left = met.where("mutual IS NULL").withColumn("to", F.coalesce("to", alone)).withColumn("light", F.col("w") * 2 <= F.col("most"))
    crowd = left.where("light").groupBy("grp", "to").agg(F.ceil(F.count("*") / 2).alias("deals"))
    dealt = left.where("light").join(crowd, ["grp", "to"]).withColumn("deal", F.pmod(F.xxhash64("id", "to"), "deals"))
    table = Window.partitionBy("grp", "to", "deal")  # about two rows each
    before = F.coalesce(F.sum("w").over(table.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    dealt = dealt.withColumn("seat", F.floor(before * 2 / F.col("most"))).withColumn("lead", F.min("id").over(Window.partitionBy("grp", "to", "deal", "seat")))
    names = vertices.columns
    merged = met.where("mutual").withColumn("lead", F.least("id", "to")).select(*names, "lead")
    return merged.unionByName(dealt.select(*names, "lead")).unionByName(left.where("NOT light").withColumn("lead", F.col("id")).select(*names, "lead"))


def coarsen(vertices: DataFrame, edges: DataFrame, n: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mapping of id to lead, coarse vertices, coarse edges); weights are added up. ``n`` is the number of vertices, if it is known."""
    n = vertices.count() if n is None else n
    mapping = store(matching(vertices, edges, n), "mapping")
    coarse = mapping.groupBy(F.col("lead").alias("id")).agg(F.first("grp").alias("grp"), F.sum("w").alias("w"), *[F.first(c).alias(c) for c in ("lo", "hi", "most")])
    a, b = (unsent(mapping.select(F.col("id").alias(x), F.col("lead").alias("c" + x)), n) for x in ("src", "dst"))
    up = edges.join(a, "src").join(b, "dst").where("csrc <> cdst").groupBy(F.least("csrc", "cdst").alias("src"), F.greatest("csrc", "cdst").alias("dst")).agg(F.sum("w").alias("w"))
    return mapping.select("id", "lead"), store(coarse, "vertices"), store(up, "coarse")


def cut_of(a: np.ndarray, part: np.ndarray) -> float:
    return float(a[part[:, None] != part[None]].sum() / 2)


def improve(a: np.ndarray, w: np.ndarray, part: np.ndarray, lo: np.ndarray, hi: np.ndarray, passes: int = 10) -> np.ndarray:
    """Fiduccia-Mattheyses passes over a dense graph: each vertex moves once a pass, by the best gain; the best state seen stays.

    On the way, parts may leave their bounds by the heaviest vertex; a state counts by how far it breaks them, then by its cut.
    """
    n, k = len(a), len(lo)
    part, slack = part.copy(), w.max(initial=0.0)
    broken = lambda size: float(np.maximum(size - hi, 0).sum() + np.maximum(lo - size, 0).sum())
    every = np.arange(n)
    for _ in range(passes):
        size = np.bincount(part, w, k)
        links = a @ np.eye(k)[part]
        cut, begun = cut_of(a, part), part.copy()
        best, state, free, idle = (broken(size), cut), part.copy(), np.ones(n, bool), 0
        while free.any() and idle < max(50, n // 4):
            gain = links - links[every, part][:, None]
            over = np.maximum(size - hi, 0)[part]
            ok = free[:, None] & (size[None] + w[:, None] <= hi[None] + slack) & ((size[part] - w >= lo[part] - slack)[:, None])
            ok[every, part] = False
            if not ok.any():
                break
            # Out of a part that is too heavy first, into lighter ones among equal gains.
            worth = np.where(ok, gain + 1e-9 * (size[part][:, None] - size[None]) + np.where(over[:, None] > 0, 1e6, 0), -np.inf)
            i, to = np.unravel_index(int(worth.argmax()), worth.shape)
            cut -= gain[i, to]
            size[part[i]] -= w[i]
            size[to] += w[i]
            links[:, part[i]] -= a[:, i]
            links[:, to] += a[:, i]
            part[i], free[i] = to, False
            now = (broken(size), cut)
            if now[0] < best[0] - 1e-9 or (now[0] <= best[0] + 1e-9 and now[1] < best[1] - 1e-9):
                best, state, idle = now, part.copy(), 0
            else:
                idle += 1
        part = state
        if (part == begun).all():
            break
    return part


def _by_order(order: np.ndarray, w: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Parts of the given shares along an order of the vertices."""
    middle = np.cumsum(w[order]) - w[order] / 2
    part = np.empty(len(w), int)
    part[order] = np.minimum(np.searchsorted(np.cumsum(shares) * w.sum(), middle, "right"), len(shares) - 1)
    return part


def starts(a: np.ndarray, w: np.ndarray, shares: np.ndarray, seed: int, tries: int):
    """Splits to improve: along the second eigenvector, halves of halves, spectral clusters, and parts grown from random vertices."""
    from .partitions import fiedler, recursive_labels, spectral_labels

    k, rng = len(shares), np.random.default_rng(seed)
    yield _by_order(np.lexsort((np.arange(len(a)), fiedler(a))), w, shares)
    yield spectral_labels(a, k, seed)
    if k > 2:
        yield recursive_labels(a, k)
    for _ in range(tries):
        near, free, order = np.zeros(len(a)), np.ones(len(a), bool), []
        while free.any():  # the free vertex that is linked best to those taken
            top = np.where(free, near, -1)
            i = int(top.argmax()) if top.max() > 0 else int(rng.choice(np.flatnonzero(free)))
            order.append(i)
            free[i] = False
            near += a[i]
        yield _by_order(np.array(order), w, shares)


def split_dense(a: np.ndarray, w: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int = 42, tries: int | None = None) -> np.ndarray:
    """The best of several improved splits of a weighted graph into parts within bounds; small graphs are tried more often."""
    tries = tries or (6 if len(a) <= 100 else 2)
    shares = (lo + hi) / (lo + hi).sum()
    best, found = (np.inf, np.inf), np.zeros(len(a), int)
    for part in starts(a, w, shares, seed, tries):
        part = improve(a, w, part, lo, hi)
        size = np.bincount(part, w, len(lo))
        now = (float(np.maximum(size - hi, 0).sum() + np.maximum(lo - size, 0).sum()), cut_of(a, part))
        if now < best:
            best, found = now, part
    return found


def _start_parts(vertices: DataFrame, edges: DataFrame, seed: int, n: int) -> DataFrame:
    """(id, part): a task splits each group, which is small by now."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own, links = rows[rows["dst"] < 0].sort_values("src"), rows[rows["dst"] >= 0]
        ids = own["src"].to_numpy(np.int64)
        a = np.zeros((len(ids), len(ids)))
        s, d = np.searchsorted(ids, links["src"].to_numpy(np.int64)), np.searchsorted(ids, links["dst"].to_numpy(np.int64))
        a[s, d] = a[d, s] = links["w"].to_numpy(float)
        part = split_dense(a, own["w"].to_numpy(float), np.array(own["lo"].iloc[0], float), np.array(own["hi"].iloc[0], float), seed)
        return pd.DataFrame({"id": ids, "part": part})

    nodes = vertices.select("grp", F.col("id").alias("src"), F.lit(-1).cast("long").alias("dst"), "w", "lo", "hi")
    empty = F.lit(None).cast("array<double>")
    links = edges.join(unsent(vertices.select(F.col("id").alias("src"), "grp"), n), "src").select("grp", "src", "dst", F.col("w").cast("double").alias("w"), empty.alias("lo"), empty.alias("hi"))
    return nodes.unionByName(links).groupBy("grp").applyInPandas(run, "id long, part int")


def _within(go: DataFrame, weight: DataFrame, side: str, bound) -> DataFrame:
    """Of the moves into (or out of) a part those of the most gain, as far as its bound leaves room; a gain's moves go by a few deals each."""
    keys = ["grp", side, "gain", "deal"]
    dealt = go.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(DEALS)))
    sums = dealt.groupBy(*keys).agg(F.sum("size").alias("flow"))
    # A row a deal of a gain of a part: aggregated before it is ordered.
    upto = Window.partitionBy("grp", side).orderBy(F.col("gain").desc(), "deal").rowsBetween(Window.unboundedPreceding, 0)
    known = weight.select("grp", F.col("part").alias(side), "weight", "lo", "hi")
    allowed = sums.withColumn("so_far", F.sum("flow").over(upto)).join(known, ["grp", side]).where(F.col("so_far") <= bound + 1e-9)
    return dealt.join(allowed.select(*keys), keys, "left_semi").drop("deal")


def refine(vertices: DataFrame, edges: DataFrame, parts: DataFrame, rounds: int = ROUNDS, n: int | None = None) -> DataFrame:
    """(id, part) after rounds of moves that lower the cut and keep every part within its bounds. ``n`` is the number of vertices, if it is known."""
    n = vertices.count() if n is None else n
    two = store(_twice(edges), "both-ways")
    for _ in range(rounds):
        placed = vertices.join(unsent(parts, n), "id")
        near = two.join(unsent(parts.select(F.col("id").alias("dst"), F.col("part").alias("near")), n), "dst").groupBy("src", "near").agg(F.sum("w").alias("k"))
        ends = near.join(unsent(placed.select(F.col("id").alias("src"), "grp", "part", F.col("w").alias("size"), "lo", "hi"), n), "src")
        own = F.coalesce(F.max(F.when(F.col("near") == F.col("part"), F.col("k"))), F.lit(0.0))
        best = F.max(F.when(F.col("near") != F.col("part"), F.struct("k", (-F.col("near")).alias("to"))))
        wish = ends.groupBy("src").agg(own.alias("own"), best.alias("best"), *[F.first(c).alias(c) for c in ("grp", "part", "size", "lo", "hi")])
        movers = store(wish.where(F.col("best.k") > F.col("own")).select(F.col("src").alias("id"), "grp", "part", (-F.col("best.to")).alias("to"), (F.col("best.k") - F.col("own")).alias("gain"), "size", "lo", "hi"), "movers")
        rank = F.struct("gain", F.xxhash64("id"))
        beside = two.join(unsent(movers.select(F.col("id").alias("dst"), rank.alias("theirs")), n), "dst").groupBy("src").agg(F.max("theirs").alias("theirs"))
        first = movers.join(unsent(beside, n), F.col("id") == F.col("src"), "left").where(F.col("theirs").isNull() | (rank > F.col("theirs")))
        weight = placed.groupBy("grp", "part").agg(F.sum("w").alias("weight"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        go = _within(first.select(*movers.columns), weight, "to", F.get("hi", "to") - F.col("weight"))
        go = store(_within(go, weight, "part", F.col("weight") - F.get("lo", "part")), "moves")
        if go.isEmpty():
            discard(movers, go)
            break
        new = store(parts.join(unsent(go.select("id", "to"), n), "id", "left").select("id", F.coalesce("to", "part").cast("int").alias("part")), "parts")
        discard(movers, go)
        parts = new
    return parts


def split(vertices: DataFrame, edges: DataFrame, shares: list[float], tolerance: float = TOLERANCE, seed: int = 42, rounds: int = ROUNDS) -> DataFrame:
    """(id, part) of vertices (id, grp, w): each group's parts take ``shares`` of its weight, up to the tolerance."""
    most = min(START_MOST, max(TASK_START, int(START * len(shares) / tolerance)))
    vertices = store(grouped(vertices, shares, tolerance), "vertices")
    edges = store(edges.select("src", "dst", F.col("w").cast("double").alias("w")), "graph")
    levels = []
    while True:
        n, largest = vertices.groupBy("grp").count().agg(F.sum("count"), F.max("count")).first()
        if (largest or 0) <= most or (levels and n > 0.97 * levels[-1][0] and largest <= START_MOST):
            break
        if levels and n == levels[-1][0]:
            raise ValueError(f"{largest} vertices of a group do not merge any further (at most {START_MOST} are split by a task)")
        mapping, up, links = coarsen(vertices, edges, n)
        levels.append((n, vertices, edges, mapping))
        vertices, edges = up, links
    parts = store(_start_parts(vertices, edges, seed, n or 0), "parts")
    for n, vertices, edges, mapping in reversed(levels):
        parts = store(mapping.join(unsent(parts.withColumnRenamed("id", "lead"), n), "lead").select("id", "part"), "parts")
        parts = refine(vertices, edges, parts, rounds, n)
    return parts


def unit(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of weight 1 of one graph of n vertices; repeated edges and loops do not count."""
    once = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return edges.sparkSession.range(n).select("id", F.lit("").alias("grp"), F.lit(1.0).alias("w")), once.withColumn("w", F.lit(1.0))


def partition(edges: DataFrame, n: int, k: int = 4, seed: int = 42, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, part) of vertices 0..n-1 in k parts of equal size, up to the tolerance.

    A graph of few edges may fall into k components of such sizes: they are the parts, and nothing is cut.
    """
    edges = store(edges, "graph")
    if k > 1 and n - edges.count() >= k:  # at least k components
        known = graphs.apart(edges, n, k)
        if known is not None:
            lo, hi = known.groupBy("part").count().agg(F.min("count"), F.max("count")).first()
            if lo >= min(n // k, math.ceil(n / k * (1 - tolerance))) and hi <= max(-(-n // k), math.floor(n / k * (1 + tolerance))):
                return known
    return split(*unit(edges, n), [1 / k] * k, tolerance, seed)


def bisected(edges: DataFrame, n: int, k: int, seed: int = 42, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, part) by halves of halves, all subgraphs of a level at once; an odd number splits into the larger and smaller half.

    What the levels may add up to lies within the tolerance.
    """
    vertices, links = unit(edges, n)
    vertices, links = store(vertices, "vertices"), store(links, "graph")
    depth = max(1, (k - 1).bit_length())
    parts = vertices.select("id", F.lit(0).alias("base"), F.lit(k).alias("count"))
    for _ in range(depth):
        counts = [r[0] for r in parts.select("count").distinct().collect() if r[0] > 1]  # two at most
        done = [parts.where("count = 1")]
        for c in sorted(counts):
            own = store(parts.where(F.col("count") == c), "own")
            group = own.select("id", F.col("base").cast("string").alias("grp"), F.lit(1.0).alias("w"))
            a, b = (unsent(own.select(F.col("id").alias(x), F.col("base").alias("b" + x)), n) for x in ("src", "dst"))
            inner = links.join(a, "src").join(b, "dst").where("bsrc = bdst").select("src", "dst", "w")
            left = (c + 1) // 2
            halves = split(group, inner, [left / c, 1 - left / c], tolerance / depth, seed)
            done.append(own.join(unsent(halves, n), "id").select("id", (F.col("base") + F.col("part") * left).alias("base"), F.when(F.col("part") == 0, left).otherwise(c - left).alias("count")))
        parts = store(reduce(DataFrame.unionByName, done), "parts")
    return parts.select("id", F.col("base").cast("int").alias("part"))
