"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of `edges` (u, v) with the least node of its component. Nodes may be of any ordered type.

    Edges lead from the greater node to the lesser. Each round links the greater end of an edge to the least neighbour of the
    lesser end, and on to its least neighbour, then all lesser neighbours of a node to the least of them, until each node has one edge, to a node without any; the number of
    rounds grows with the logarithm of a component's size. Least neighbours are tables of their own, so that the edges of a node with very
    many neighbours are one side of a join between two written tables, which adaptive plans split."""
    e = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        least = materialise(e.groupBy("u").agg(F.min("v").alias("m")), "least")
        # Large star: a root has no lesser neighbour, so the edges to it stay. Two steps at once, since a step is a join and a round writes three tables.
        step = least.withColumnsRenamed({"u": "x", "m": "next"})
        once = e.join(step, F.col("v") == F.col("x"), "left").select("u", F.coalesce("next", "v").alias("v"), F.col("next").isNotNull().alias("moved"))
        twice = once.join(step, F.col("v") == F.col("x"), "left").select("u", F.coalesce("next", "v").alias("v"), "moved")
        large = materialise(twice, "large")
        nearest = materialise(large.groupBy("u").agg(F.min("v").alias("m"), (F.max("moved") | (F.min("v") < F.max("v"))).alias("open")), "nearest")
        if not nearest.agg(F.max("open")).first()[0]:
            break
        # Small star: each node and its lesser neighbours go to the least of them.
        rest = large.join(nearest.select("u", "m"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialise(nearest.select("u", F.col("m").alias("v")).unionByName(rest).distinct(), "edges")
        for old in (e, least, large, nearest):
            forget(old)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
