"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of `edges` (a, b); a component's number is its smallest node.

    Alternates two steps until nothing changes: every node's larger neighbours are tied to its smallest neighbour, then
    its smaller neighbours and itself are. Only minima are taken for a node, never lists, so a hot node costs no memory;
    rounds grow with the logarithm of the longest path. Each round is written to the checkpoint folder.
    """
    ties = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    ties, before = materialise(ties), None
    while True:
        both = ties.union(ties.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        ties = materialise(smaller.where("u <> v").distinct())
        now = ties.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before:
            break
        before = now
    roots = ties.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return ties.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
