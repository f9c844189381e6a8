"""Greedy graph colouring and what follows from it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..sources.storage import Growing, discard, store
from . import graphs
from .orderings import breadth_first, by_groups

STRATEGIES = ("largest_first", "smallest_last", "random_sequential", "independent_set", "connected_sequential_bfs", "connected_sequential_dfs", "saturation_largest_first")
#: Strategies that take one vertex after the other, each depending on all before: their components must fit into a task.
SEQUENTIAL = ("connected_sequential_dfs", "saturation_largest_first")
#: Edges of a component up to which one task colours it.
TASK_EDGES = 2_000_000


def _peel(first: np.ndarray, to: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order that removes a vertex of least remaining degree again and again, reversed."""
    import heapq

    degree = np.diff(first).tolist()
    heap = [(d, int(i)) for i, d in enumerate(degree)]
    heapq.heapify(heap)
    gone, out = [False] * len(ids), []
    while heap:
        d, u = heapq.heappop(heap)
        if gone[u] or d != degree[u]:
            continue
        gone[u] = True
        out.append(u)
        for v in to[first[u] : first[u + 1]].tolist():
            if not gone[v]:
                degree[v] -= 1
                heapq.heappush(heap, (degree[v], v))
    return np.array(out[::-1])


def _depth_first(first: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Vertices as a walk meets them that goes on to the least unvisited neighbour, and back where there is none."""
    seen, out, path = np.zeros(len(first) - 1, bool), [0], [0]
    seen[0], at = True, first[:-1].copy()
    while path:
        u = path[-1]
        while at[u] < first[u + 1] and seen[to[at[u]]]:
            at[u] += 1
        if at[u] == first[u + 1]:
            path.pop()
            continue
        v = int(to[at[u]])
        seen[v] = True
        out.append(v)
        path.append(v)
    return np.array(out)


def _breadth_first(first: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Vertices as a queue meets them, neighbours by number."""
    seen, queue = np.zeros(len(first) - 1, bool), [0]
    seen[0] = True
    for u in queue:
        new = to[first[u] : first[u + 1]]
        new = new[~seen[new]]
        seen[new] = True
        queue.extend(new.tolist())
    return np.array(queue)


def _saturated(first: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Colours, the vertex that sees the most colours next; ties go to the higher degree, then to the smaller number."""
    import heapq

    n, degree = len(first) - 1, np.diff(first)
    seen: list[set[int]] = [set() for _ in range(n)]
    heap = [(0, -int(d), i) for i, d in enumerate(degree)]
    heapq.heapify(heap)
    color = np.full(n, -1)
    while heap:
        k, _, u = heapq.heappop(heap)
        if color[u] >= 0 or -k != len(seen[u]):
            continue
        c = 0
        while c in seen[u]:
            c += 1
        color[u] = c
        for v in to[first[u] : first[u + 1]].tolist():
            if color[v] < 0 and c not in seen[v]:
                seen[v].add(c)
                heapq.heappush(heap, (-len(seen[v]), -int(degree[v]), v))
    return color


def _greedy(strategy: str):
    """Colours one component; for a random order, the edges bring their ends' hashes (hsrc, hdst)."""

    def run(edges: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate((edges.src, edges.dst)), return_inverse=True)
        a, b = at[: len(edges)], at[len(edges) :]
        order = np.lexsort((np.r_[b, a], np.r_[a, b]))
        to = np.r_[b, a][order]
        first = np.searchsorted(np.r_[a, b][order], np.arange(len(ids) + 1))
        if strategy == "saturation_largest_first":
            return pd.DataFrame({"id": ids, "color": _saturated(first, to)})
        if strategy == "largest_first":
            turn = np.lexsort((ids, -np.diff(first)))
        elif strategy == "smallest_last":
            turn = _peel(first, to, ids)
        elif strategy == "connected_sequential_dfs":
            turn = _depth_first(first, to)
        elif strategy == "connected_sequential_bfs":
            turn = _breadth_first(first, to)
        else:
            drawn = np.empty(len(ids), np.int64)
            drawn[a], drawn[b] = edges.hsrc, edges.hdst
            turn = np.lexsort((ids, drawn))[::-1]
        color = np.full(len(ids), -1)
        for u in turn.tolist():
            used = set(color[to[first[u] : first[u + 1]]].tolist())
            c = 0
            while c in used:
                c += 1
            color[u] = c
        return pd.DataFrame({"id": ids, "color": color})

    return run


def _rounds(edges: DataFrame, priority: DataFrame) -> DataFrame:
    """Jones-Plassmann: who has no uncoloured neighbour of higher priority takes the least free colour. Equals greedy in that order."""
    two = graphs.both_ways(edges).join(priority.select(F.col("id").alias("src"), F.col("p").alias("ps")), "src").join(priority.select(F.col("id").alias("dst"), F.col("p").alias("pd")), "dst")
    above = store(two.where("pd > ps").select("src", "dst"), "above")  # neighbours that go first
    done = Growing(priority.select("id").where("false").withColumn("color", F.lit(0).cast("int")), "colors")
    todo = store(priority.select("id"), "todo")
    while not todo.isEmpty():
        waits = above.join(todo.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        ready = store(todo.join(waits, "id", "left_anti"), "ready")
        used = ready.join(above, F.col("id") == F.col("src")).join(done.all().withColumnRenamed("id", "dst"), "dst").groupBy("id").agg(F.collect_set("color").alias("used"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used"))
        new = store(ready.join(used, "id", "left").select("id", F.when(F.col("used").isNull(), 0).otherwise(free).cast("int").alias("color")), "new")
        done.append(new)
        rest = store(todo.join(ready, "id", "left_anti"), "todo")
        discard(todo, ready, new)
        todo = rest
    return done.all()


def cores(edges: DataFrame, n: int) -> DataFrame:
    """(id, core, turn): core numbers, and the round in which a vertex goes when those with few neighbours left go together.

    All vertices with at most k neighbours left go at once; when none is left, k rises to the least number that is. At its turn a
    vertex has at most its core number of neighbours that go with it or later. A round shuffles what goes and what stays, and not
    the edges of all.
    """
    once = store(edges.where("src <> dst").distinct(), "once")
    two, left = graphs.laid_out(once, "dst"), store(graphs.degrees(once, n), "left")
    done, k, turn = Growing(left.where("false").select("id", F.lit(0).alias("core"), F.lit(0).alias("turn")), "cores"), 0, 0
    while True:
        least = left.agg(F.min("degree")).first()[0]
        if least is None:
            discard(once, two, left)
            return done.all()
        k, turn = max(k, int(least)), turn + 1
        done.append(left.where(F.col("degree") <= k).select("id", F.lit(k).alias("core"), F.lit(turn).alias("turn")))
        stay, gone = left.where(F.col("degree") > k), left.where(F.col("degree") <= k).select(F.col("id").alias("dst"))
        lost = two.join(gone, "dst").groupBy("src").agg(F.count("*").alias("lost"))
        rest = store(stay.join(lost, F.col("id") == F.col("src"), "left").select("id", (F.col("degree") - F.coalesce("lost", F.lit(0))).alias("degree")), "left")
        discard(left)
        left = rest


#: Multiplier and modulus of the draws of independent sets: plain arithmetic, which any engine repeats.
DRAW, DRAWS = 2_654_435_761, 2_147_483_648


def drawn(seed: int, turn: int, vertex: str = "id") -> "F.Column":
    """A vertex's number in the draw for one colour."""
    return ((F.col(vertex) % DRAWS + (seed + 1) * 7_919 + turn * 104_729) * DRAW) % DRAWS


def _among(two: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges that have no end among ``gone`` (id)."""
    return two.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")


def independent_sets(edges: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(id, color): each colour is a maximal independent set of what the colours before have left.

    In a round, whoever has drawn a higher number than all its open neighbours joins the set, and its neighbours are closed for
    this colour. Each colour draws anew. A round reads the edges among open vertices only, and each colour those among uncoloured ones.
    """
    once = store(edges.where("src <> dst").distinct(), "once")
    two = graphs.laid_out(once, "src")
    rest, turn = store(edges.sparkSession.range(n), "rest"), 0
    done = Growing(rest.where("false").withColumn("color", F.lit(0)), "colors")
    while not rest.isEmpty():
        open_, live = rest, two
        while not open_.isEmpty():
            theirs = live.groupBy("src").agg(F.max(F.struct(drawn(seed, turn, "dst").alias("number"), F.col("dst").alias("id"))).alias("theirs"))
            number = F.struct(drawn(seed, turn).alias("number"), "id")
            joins = store(open_.join(theirs, F.col("id") == F.col("src"), "left").where(F.col("theirs").isNull() | (number > F.col("theirs"))).select("id"), "joins")
            done.append(joins.withColumn("color", F.lit(turn)))
            closed = live.join(joins.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
            gone = store(joins.unionByName(closed), "gone")
            new, links = store(open_.join(gone, "id", "left_anti"), "open"), store(_among(live, gone), "live")
            discard(joins, gone, *([] if open_ is rest else [open_]), *([] if live is two else [live]))
            open_, live = new, links
        colored = done.all().where(F.col("color") == turn).select("id")
        new, links = store(rest.join(colored, "id", "left_anti"), "rest"), store(_among(two, colored), "two")
        discard(rest, two, open_, live)
        rest, two, turn = new, links, turn + 1
    discard(once, two, rest)
    return done.all()


def color(edges: DataFrame, n: int, strategy: str = "largest_first", seed: int = 42, task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, color) of vertices 0..n-1. Components are coloured apart; isolated vertices get colour 0.

    largest_first, random_sequential (vertices by a seeded hash) and connected_sequential_bfs (breadth first from the least
    vertex) give the same colours at every size: small components in a task, larger ones in rounds; independent_set is rounds
    always. smallest_last removes the vertex of least degree again and again; from components of more edges, all vertices of few
    neighbours go at once (:func:`cores`), and colours are at most the largest core number and one in both cases. The other two
    take one vertex after the other and are refused for components of more edges.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; one of {', '.join(STRATEGIES)}")
    edges = store(edges, "graph")
    if strategy == "independent_set":
        return independent_sets(edges, n, seed)
    comp = graphs.components(edges, n)
    own = edges.join(comp, F.col("src") == F.col("id")).select("component", "src", "dst")
    big = store(own.groupBy("component").agg(F.count("*").alias("k")).where(F.col("k") > task_edges).select("component"), "big")
    hashes = [F.xxhash64(F.lit(seed), x).alias(f"h{x}") for x in ("src", "dst")] if strategy == "random_sequential" else []
    found = own.join(big, "component", "left_anti").select("component", "src", "dst", *hashes).groupBy("component").applyInPandas(_greedy(strategy), "id long, color int")
    if not big.isEmpty():
        if strategy in SEQUENTIAL:
            raise ValueError(f"{strategy} takes one vertex at a time: its components must fit into a task")
        part = store(own.join(big, "component", "left_semi").select("src", "dst"), "part")
        p = graphs.degrees(part, n).where("degree > 0")
        if strategy == "smallest_last":
            p = cores(part, n).where("core > 0")
            rank = F.struct("turn", F.xxhash64("id"), "id")
        elif strategy == "connected_sequential_bfs":
            p = breadth_first(part, comp.join(big, "component", "left_semi"))
            rank = F.struct((-F.col("pos")).alias("late"), "id")
        else:
            rank = F.struct("degree", (-F.col("id")).alias("low")) if strategy == "largest_first" else F.struct(F.xxhash64(F.lit(seed), "id"), "id")
        found = found.unionByName(_rounds(part, store(p.select("id", rank.alias("p")), "priority")))
    return edges.sparkSession.range(n).join(found, "id", "left").select("id", F.coalesce("color", F.lit(0)).cast("int").alias("color"))


def quality(edges: DataFrame, colors: DataFrame) -> DataFrame:
    """Colours, validity and balance of the colour classes."""
    a, b = (colors.select(F.col("id").alias(k), F.col("color").alias("c" + k)) for k in ("src", "dst"))
    bad = edges.join(a, "src").join(b, "dst").agg((F.count_if(F.col("csrc") == F.col("cdst")) == 0).alias("is_valid"))
    sizes = colors.groupBy("color").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("num_colors"), F.sum("n").alias("num_nodes"), F.max("n").alias("max_size"), F.min("n").alias("min_size"), F.round(F.avg("n"), 6).alias("avg_size"), F.round(F.stddev_pop("n"), 6).alias("color_balance")).join(bad)


def order(m: SparseMatrix, strategy: str = "largest_first", graph_type: str = "row_overlap") -> DataFrame:
    """Rows by colour. The bipartite graph has no edge between rows: one colour, and the order stays."""
    if graph_type not in ("row_overlap", "bipartite"):
        raise ValueError(f"unknown graph type {graph_type}")
    edges = graphs.row_overlap(m) if graph_type == "row_overlap" else graphs.row_overlap(m).where("false")
    return by_groups(color(edges, m.nrows, strategy), "color")


def parallel_groups(m: SparseMatrix) -> DataFrame:
    """(color, id): rows of one colour share no column and can be worked on together."""
    return color(graphs.row_overlap(m), m.nrows).select("color", "id")
