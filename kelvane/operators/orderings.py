"""Row and symmetric orderings as permutation tables (new_pos, old_id)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..sources.storage import Growing, discard, store
from . import graphs, meeting
from .metrics import counts
from .numbering import numbered, running

#: Edges of a component up to which one task orders it; larger ones advance level by level across the cluster.
TASK_EDGES = 2_000_000


def _positions(ids: DataFrame, *keys) -> DataFrame:
    """Number rows 0.. by keys, partition by partition."""
    return numbered(ids, *keys, name="new_pos").select("new_pos", F.col("row").alias("old_id"))


def king(m: SparseMatrix) -> DataFrame:
    """Rows by ascending value sum, then number: what the queue of three least unvisited rows comes to."""
    return _positions(counts(m).select("row", "value_sum"), "value_sum", "row")


def diagonal(m: SparseMatrix) -> DataFrame:
    """Rows with a stored diagonal entry first."""
    on = m.entries.where("row = col").select("row", F.lit(0).alias("late"))
    return _positions(m.row_ids().join(on, "row", "left").select("row", F.coalesce("late", F.lit(1)).alias("late")), "late", "row")


def block_reverse(m: SparseMatrix) -> DataFrame:
    """Blocks of a tenth of the rows (10 at least), each reversed."""
    size = max(10, m.nrows // 10)
    start = F.floor(F.col("row") / size) * size
    end = F.least(start + size, F.lit(m.nrows)) - 1
    return m.row_ids().select((start + end - F.col("row")).cast("long").alias("new_pos"), F.col("row").alias("old_id"))


def by_groups(groups: DataFrame, key: str) -> DataFrame:
    """Rows by group, then number; groups: (id, key)."""
    return _positions(groups.withColumnRenamed("id", "row"), key, "row")


def _cuthill_mckee(edges: pd.DataFrame) -> pd.DataFrame:
    """One component in breadth-first order from its vertex of least degree; neighbours by degree, then id."""
    ids, at = np.unique(np.concatenate((edges.src, edges.dst)), return_inverse=True)
    a, b = at[: len(edges)], at[len(edges) :]
    degree = np.bincount(at, minlength=len(ids))
    order = np.lexsort((np.r_[b, a], degree[np.r_[b, a]], np.r_[a, b]))
    to = np.r_[b, a][order]
    first = np.searchsorted(np.r_[a, b][order], np.arange(len(ids) + 1))
    queue, seen = [int(np.lexsort((np.arange(len(ids)), degree))[0])], np.zeros(len(ids), bool)
    seen[queue[0]] = True
    for u in queue:
        new = to[first[u] : first[u + 1]]
        new = new[~seen[new]]
        seen[new] = True
        queue.extend(new.tolist())
    return pd.DataFrame({"component": edges.component.iloc[0], "id": ids[queue], "pos": np.arange(len(queue))})


def _by_levels(edges: DataFrame, placed: DataFrame, degree: DataFrame) -> DataFrame:
    """The same for large components, all at once: a level of each a round. placed: (component, id, pos) of the starts.

    A level is numbered across partitions, whatever its size; a round reads the last two levels and writes one.
    """
    two = store(graphs.both_ways(edges).join(degree.withColumnRenamed("id", "dst"), "dst"), "two")
    done, front, before = Growing(placed, "placed"), placed, None
    base = store(placed.groupBy("component").agg((F.max("pos") + 1).alias("base")), "base")
    while True:
        reached = front.join(two, F.col("id") == F.col("src")).groupBy("component", "dst").agg(F.min("pos").alias("parent"), F.first("degree").alias("degree"))
        known = front if before is None else front.unionByName(before)
        reached = reached.join(known.select(F.col("id").alias("dst")), "dst", "left_anti")
        at = numbered(reached, "component", "parent", "degree", "dst", name="at")
        starts = at.groupBy("component").agg(F.min("at").alias("start"), F.count("*").alias("n"))
        new = store(at.join(starts.join(base, "component"), "component").select("component", F.col("dst").alias("id"), (F.col("base") + F.col("at") - F.col("start")).cast("long").alias("pos")), "front")
        if new.isEmpty():
            return done.all()
        done.append(new)
        next_base = store(new.groupBy("component").agg((F.max("pos") + 1).alias("base")), "base")
        discard(base, *([] if before is None else [before]))
        before, front, base = front, new, next_base


def breadth_first(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, id, pos): each component's vertices as a queue from its least vertex meets them, neighbours by number."""
    alike = components.select("id", F.lit(0).alias("degree"))
    starts = store(components.where("id = component").select("component", "id", F.lit(0).cast("long").alias("pos")), "starts")
    return _by_levels(edges, starts, alike)


def reverse_cuthill_mckee(edges: DataFrame, n: int, task_edges: int = TASK_EDGES) -> DataFrame:
    """Components by the least (degree, id) of their vertices, each in Cuthill-McKee order, and all of it reversed."""
    edges = store(edges, "graph")
    comp, degree = store(graphs.components(edges, n), "components"), store(graphs.degrees(edges, n), "degree")
    start = comp.join(degree, "id").groupBy("component").agg(F.min(F.struct("degree", "id")).alias("s"), F.count("*").alias("size"))
    start = store(start.select("component", "size", F.col("s.degree").alias("degree"), F.col("s.id").alias("id")), "starts")
    own = edges.join(comp, F.col("src") == F.col("id")).select("component", "src", "dst")
    sizes = own.groupBy("component").agg(F.count("*").alias("k"))
    big = store(sizes.where(F.col("k") > task_edges).select("component"), "big")
    small = own.join(big, "component", "left_anti").groupBy("component").applyInPandas(_cuthill_mckee, "component long, id long, pos long")
    parts = small.unionByName(start.where("size = 1").select("component", "id", F.lit(0).cast("long").alias("pos")))
    if not big.isEmpty():
        parts = parts.unionByName(_by_levels(own.join(big, "component", "left_semi"), store(start.join(big, "component").select("component", "id", F.lit(0).cast("long").alias("pos")), "starts"), degree))
    offset = running(start.select("component", "size", "degree", "id"), "size", "degree", "id", name="upto").select("component", (F.col("upto") - F.col("size")).alias("before"))
    return parts.join(offset, "component").select((F.lit(n - 1) - F.col("before") - F.col("pos")).cast("long").alias("new_pos"), F.col("id").alias("old_id"))


#: Rows of a block, about, and entries of it at most.
BLOCK_ROWS, BLOCK_CELLS = 1_000_000, 2_000_000


def _overlaps(batches):
    """Over pairs of blocks: (id, degree), how many rows of the other block share a column with each row of the one."""
    names = ["ids", "row_n", "row_cols", "cols", "col_n", "col_rows"]
    for batch in batches:
        for ids, row_n, row_cols, cols, col_n, col_rows in meeting.arrays(batch, names):
            wide = int(col_rows.max()) + 1
            degree = np.empty(len(ids), np.int64)
            for first, last, _, there, row in meeting.expanded(row_n, row_cols, cols, col_n, wide):
                seen = np.zeros((last - first) * wide, bool)
                seen[row * wide + col_rows[there]] = True
                degree[first:last] = np.count_nonzero(seen.reshape(last - first, wide), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(degree)], names=["id", "degree"])


def overlap_degrees(cells: DataFrame, n: int, block_rows: int = BLOCK_ROWS, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(id, degree) of rows with an entry: how many other rows share a column with each, from cells (row, col).

    Blocks of rows are stored, and a task reads two of them and marks what the rows of the one reach in the other. So pairs of rows are
    met in tasks only, and only a number a row and block is shuffled.
    """
    most = min(block_cells, -(-max(cells.count(), 1) * block_rows // max(n, 1)))
    blocks = meeting.blocks(cells.select("row", "col"), most)
    if not blocks:
        return cells.sparkSession.createDataFrame([], "id long, degree long")
    met = meeting.crossed(blocks, ["ids", "row_n", "row_cols"], ["cols", "col_n", "col_rows"]).drop("i", "j")
    found = met.mapInArrow(_overlaps, "id long, degree long")
    return found.groupBy("id").agg((F.sum("degree") - 1).alias("degree"))  # each row reaches itself


def overlap_reverse_cuthill_mckee(m: SparseMatrix) -> DataFrame:
    """The order that :func:`reverse_cuthill_mckee` gives of the rows' overlap graph, without its edges.

    A row's neighbours are the rows of its columns. A level's least position goes to its columns, and each column's to its rows,
    once a column: all rows of a column that was met have their place in that level or the next.
    """
    n = m.nrows
    cells = store(m.entries.select("row", "col").distinct(), "cells")
    degree = store(m.row_ids().join(overlap_degrees(cells, n), F.col("row") == F.col("id"), "left").select(F.col("row").alias("id"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree")), "degree")
    comp = store(graphs.components(cells.select(F.col("row").alias("src"), (F.col("col") + n).alias("dst")), n), "components")
    start = comp.join(degree, "id").groupBy("component").agg(F.min(F.struct("degree", "id")).alias("s"), F.count("*").alias("size"))
    start = store(start.select("component", "size", F.col("s.degree").alias("degree"), F.col("s.id").alias("id")), "starts")
    placed = store(start.select("component", "id", F.lit(0).cast("long").alias("pos")), "placed")
    done, front = Growing(placed, "placed"), placed
    base = store(placed.select("component", F.lit(1).cast("long").alias("base")), "base")
    open_ = cells  # of columns that no level has met
    while True:
        met = store(front.join(open_, F.col("id") == F.col("row")).groupBy("col").agg(F.min("component").alias("component"), F.min("pos").alias("parent")), "columns")
        reached = met.join(open_, "col").groupBy("component", F.col("row").alias("id")).agg(F.min("parent").alias("parent"))
        reached = store(reached.join(done.all().select("id"), "id", "left_anti").join(degree, "id"), "reached")
        rest = store(open_.join(met, "col", "left_anti"), "open")
        discard(met, *([] if open_ is cells else [open_]))
        open_ = rest
        if reached.isEmpty():
            discard(reached, front, open_, base)
            break
        at = numbered(reached, "component", "parent", "degree", "id", name="at")
        starts = at.groupBy("component").agg(F.min("at").alias("start"), F.count("*").alias("n"))
        sizes = store(base.join(starts, "component"), "sizes")
        new = store(at.join(sizes, "component").select("component", "id", (F.col("base") + F.col("at") - F.col("start")).cast("long").alias("pos")), "front")
        done.append(new)
        next_base = store(sizes.select("component", (F.col("base") + F.col("n")).alias("base")), "base")
        discard(reached, sizes, base, front)
        front, base = new, next_base
    offset = running(start.select("component", "size", "degree", "id"), "size", "degree", "id", name="upto").select("component", (F.col("upto") - F.col("size")).alias("before"))
    return done.all().join(offset, "component").select((F.lit(n - 1) - F.col("before") - F.col("pos")).cast("long").alias("new_pos"), F.col("id").alias("old_id"))


def rcm(m: SparseMatrix) -> DataFrame:
    """Square: by the pattern of A + A'; else rows by the pattern of A A'."""
    if m.square:
        return reverse_cuthill_mckee(graphs.pattern_graph(m), m.nrows)
    return overlap_reverse_cuthill_mckee(m)


def rcm_both(m: SparseMatrix) -> tuple[DataFrame, DataFrame]:
    """Rows by A A', columns by A' A; a square matrix takes the rows' order for both."""
    m = m.stored()
    rows = overlap_reverse_cuthill_mckee(m)
    return (rows, rows) if m.square else (rows, overlap_reverse_cuthill_mckee(m.transpose()))
