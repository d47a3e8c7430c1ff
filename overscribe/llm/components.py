"""Connected components by alternating large and small stars (Kiveris et al., 2014).

Every round is two grouped minima and two joins; nothing is gathered on the
driver but the two numbers that tell whether a round still changed an edge.
The minimum is joined back to the edges instead of being taken in a window, so
that a node with very many edges is only ever a skewed join, which Spark
splits, and never one group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _star(pairs: DataFrame, smaller_only: bool) -> DataFrame:
    """pairs: (u, v). Link the neighbours of u, as far as they qualify, to the least of them and u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = pairs.join(least, "u")
    if smaller_only:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with an edge to another one; root is the least node that it reaches.

    ``edges`` may repeat pairs, name them in either order and hold loops; rows
    with a null are ignored. Nodes are of any type that can be ordered.
    """
    now = materialize(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    state = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        after = materialize(_star(_star(both, False), True), "edges")
        release(now)
        now = after
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(got) == state or not got[0]:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        state = tuple(got)
