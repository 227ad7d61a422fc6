"""Connected components of a graph of long node names, by star rounds.

Large-star and small-star steps alternate (Kiveris et al., "Connected
Components in MapReduce and Beyond", SoCC 2014). Each round is written to the
shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges ``u > v``: link neighbours to the smallest of them."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    smallest = both.groupBy("u").agg(F.min("v").alias("m"))
    linked = both.join(smallest, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            smallest.select("u", F.col("m").alias("v"))
        )
    return out.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that is not the smallest of its component.

    ``edges`` has two columns of longs; their direction does not matter, and
    repeats and loops are allowed.
    """
    a, b = edges.columns
    edges = cut_lineage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    )
    mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
    state = edges.agg(*mark).first()
    while state["n"]:
        edges = cut_lineage(_star(_star(edges, True), False))
        before, state = state, edges.agg(*mark).first()
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
