"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, root for every node of an edge: root is the smallest node
    that can be reached.

    Alternates two steps on pairs (u, v) with u > v until nothing changes: every node points its
    larger neighbours at its smallest one; then every node points itself and its smaller
    neighbours at the smallest. Both use a minimum per node (combined before the shuffle) and an
    equi-join of two written tables, which Spark can split where a node has very many neighbours; rounds
    grow with the logarithm of the longest path. Each round is checkpointed. Loops, nulls and repeated edges are
    ignored; without edges the result is empty.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")
    )
    pairs = cut(pairs.distinct())
    seen = None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == seen or not state[0]:
            break
        seen = state
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = cut(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u != v").distinct())
        smallest = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.unionByName(smallest.withColumnRenamed("m", "v")).distinct())
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
