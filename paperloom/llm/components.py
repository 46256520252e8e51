"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm._shared import stored


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component): the smallest node that each node reaches; only nodes with an edge to another.

    Every round hangs each node's larger neighbours on its smallest neighbour (large star), then each node and its
    smaller neighbours on the smallest (small star); the edges become stars after logarithmically many rounds.  Minima
    combine before the shuffle, so a hub's edges never meet in one task; a hub's side of a join is split by adaptive
    execution.  Each round is written to the shared folder.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = stored(edges, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large-star")  # now every edge goes from a node to a smaller one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        small = stored(small, "small-star")
        state = small.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return small.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        edges, before = small, state
