"""Connected components by alternating large-star and small-star steps over an edge table, each step materialised in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._job import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), the component named by its smallest node.

    Self-loops and repeated edges are harmless; an edge with a NULL end is left out; no edges, no rows. A step is two shuffles of the
    edges; their number grows with the logarithm of the longest path. No node's whole neighbourhood is ever held in one row.
    """
    edges = edges.select("a", "b").dropna()
    nodes_only = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    # an edge is held as (child u, parent v) with v < u
    star = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    star = materialize(star, "edges")
    before = None
    while True:
        both = star.union(star.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: each larger neighbour hangs on the smallest of u and its neighbours
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours and u itself hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        star = materialize(small, "edges", star)
        after = star.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.count_distinct("u")).first()
        if after == before or after[0] == 0:
            break
        before = after
    found = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = nodes_only.select("node", F.col("node").alias("component")).join(found.union(roots), "node", "left_anti")
    return found.union(roots).union(alone)
