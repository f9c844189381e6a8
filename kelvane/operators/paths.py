"""Graphs that are one path: its vertices' places, and the halves by the second eigenvector at any length.

The second eigenvector of a path of n vertices is cos(pi * (place + 1/2) / n), and it falls along the path: its median is the
path's middle. So a half is a range of places, and no eigenvector need be computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import discard, store
from . import graphs


def places(edges: DataFrame, n: int) -> DataFrame | None:
    """(id, place) along the path from its end of the smaller number; None of a graph that is not one path of all n vertices.

    Each edge is a step in both directions. A round doubles the distance that a step knows the way for.
    """
    edges = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    two = store(graphs.both_ways(edges), "both-ways")
    near = two.groupBy("src").agg(F.count("*").alias("degree"), F.min("dst").alias("low"), F.max("dst").alias("high"))
    met, ends, most, head = near.agg(F.count("*"), F.count_if(F.col("degree") == 1), F.max("degree"), F.min(F.when(F.col("degree") == 1, F.col("src")))).first()
    if met != n or ends != 2 or most > 2:
        discard(two)
        return None
    # A step's number is twice that of the vertex it leaves, and one more towards the larger of two neighbours.
    ahead = near.select(F.col("src").alias("dst"), "degree", "low", "high")
    other = F.when(F.col("degree") == 2, F.when(F.col("src") == F.col("low"), F.col("dst") * 2 + 1).otherwise(F.col("dst") * 2))
    own = two.join(near.select("src", F.col("low").alias("first")), "src").select("src", "dst", (F.col("src") * 2 + F.when(F.col("dst") == F.col("first"), 0).otherwise(1)).alias("step"))
    steps = store(own.join(ahead, "dst").select("step", other.alias("next"), F.lit(1).cast("long").alias("length"), F.col("dst").alias("last")), "steps")
    for _ in range((2 * n).bit_length()):
        then = steps.select(F.col("step").alias("next"), F.col("next").alias("after"), F.col("length").alias("more"), F.col("last").alias("end"))
        new = store(steps.join(then, "next", "left").select("step", F.col("after").alias("next"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), F.coalesce("end", "last").alias("last")), "steps")
        discard(steps)
        steps = new
        if steps.where("next IS NOT NULL").isEmpty():
            break
    discard(two)
    own = steps.where((F.col("last") == head) & F.col("next").isNull()).select(F.floor(F.col("step") / 2).alias("id"), F.col("length").alias("place"))
    placed = store(own.unionByName(edges.sparkSession.range(1).select(F.lit(head).alias("id"), F.lit(0).cast("long").alias("place"))), "places")
    discard(steps)
    if placed.count() != n:  # cycles beside the path
        discard(placed)
        return None
    return placed


def halves(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (id, place, key) plus half and border: the halves of each group, a piece of the path, as ``partitions.bisect`` makes
    them; border tells the two vertices at the cut. The end of the smaller number is in half 1."""
    size = F.max("place") - F.min("place") + 1
    group = rows.groupBy(key).agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.floor((size + 1) / 2).alias("h"), (F.min_by("id", "place") < F.max_by("id", "place")).alias("upper"))
    joined = rows.join(group, key)
    half = F.when(F.col("upper"), F.col("place") <= F.col("hi") - F.col("h")).otherwise(F.col("place") >= F.col("lo") + F.col("h")).cast("int")
    cut = F.when(F.col("upper"), F.col("hi") - F.col("h") + 1).otherwise(F.col("lo") + F.col("h"))  # the first place behind the cut
    border = (F.col("lo") < F.col("hi")) & ((F.col("place") == cut) | (F.col("place") == cut - 1))
    return joined.select(*rows.columns, half.alias("half"), border.alias("border"))


def recursive(rows: DataFrame, k: int) -> DataFrame:
    """(id, part) by halves of halves of a path (id, place); an odd number splits into the larger and the smaller half."""
    parts = rows.select("id", "place", F.lit(0).alias("base"), F.lit(k).alias("count"))
    for _ in range((k - 1).bit_length()):
        left = F.floor((F.col("count") + 1) / 2).cast("int")
        more = F.col("count") > 1
        base = F.when(more & (F.col("half") == 1), F.col("base") + left).otherwise(F.col("base"))
        count = F.when(more, F.when(F.col("half") == 0, left).otherwise(F.col("count") - left)).otherwise(F.col("count"))
        parts = store(halves(parts, "base").select("id", "place", base.cast("int").alias("base"), count.cast("int").alias("count")), "parts")
    return parts.select("id", F.col("base").alias("part"))
