"""Connected components of a graph given by its edges, by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014: each round replaces edges by edges to the
least neighbour, the number of rounds grows with the logarithm of the graph's size, and no round holds more edges
than the graph has. Every step is a grouped minimum (combined before the shuffle) and an equi-join, so a hub of any
size is never gathered in one row or task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchglass.plans.lineage import stored

#: A graph of 2^60 nodes needs fewer.
MOST_ROUNDS = 120


def _to_least(edges: DataFrame) -> DataFrame:
    """Adds to each edge (u, v) the least of u and its neighbours v."""
    least = edges.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    larger = _to_least(both).filter(F.col("v") > F.col("u"))
    return larger.select(F.col("v").alias("u"), F.col("least").alias("v")).filter(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges must lead from the larger node u to the smaller v."""
    seen = _to_least(edges)
    moved = seen.filter(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    own = seen.select("u", F.col("least").alias("v"))
    return moved.unionByName(own).filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    ``edges`` has two columns of one orderable type, in any order and with repeats; edges with a null end or from a
    node to itself take no part. No edges give no rows.
    """
    first, second = edges.columns
    a, b = F.col(first), F.col(second)
    now = edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, before = stored(now, "edges"), None
    for _ in range(MOST_ROUNDS):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        now = stored(_small_star(_large_star(now)), "edges")
    raise RuntimeError("connected components did not settle")
