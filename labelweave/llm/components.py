"""Connected components of an edge table, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.steps import saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("least"))
    least = least.select(F.col("hi").alias("node"), F.least("hi", "least").alias("least"))
    greater = both.filter("lo > hi").select(F.col("hi").alias("node"), F.col("lo").alias("far"))
    joined = greater.join(least, "node")
    return joined.select(F.col("far").alias("hi"), F.col("least").alias("lo")).filter("hi <> lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = edges.join(least.withColumnRenamed("hi", "node"), F.col("hi") == F.col("node"))
    moved = moved.filter("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return moved.union(least.select("hi", F.col("least").alias("lo"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge to another node.

    ``component`` is the smallest node of the component. Each round links the
    greater neighbours of a node to its least neighbour, then the lesser ones;
    the rounds end when every node links to the root of its star only. The
    number of rounds grows with the logarithm of the size of a component. A
    hub costs one minimum, combined before the shuffle, and its joined rows
    are split by adaptive execution. Rows with a null end and self loops are
    no edges; an empty table gives an empty result.
    """
    edges = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    edges = edges.filter("hi <> lo").distinct()
    state = None
    while True:
        edges = saved(edges, "star-edges")
        mark = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
        now = tuple(edges.agg(F.count(F.lit(1)), mark).first())
        if now[0] == 0 or now == state:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
                edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        state = now
        edges = _small_star(_large_star(edges))
