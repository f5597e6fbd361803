"""Routing of queries to pages by vector similarity; recall and pages saved."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaymill.sources.shared import stored


def unit(vector: Column) -> Column:
    """The vector with length 1; a length below 1e-12 counts as that."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def similarities(queries: DataFrame, pages: DataFrame, most_queries: int = 4096) -> DataFrame:
    """query_id, page_id, score (six decimals) of every query against every page.

    queries: query_id, embedding: a stated set, held in memory on every executor, so its size is checked.
    """
    n = queries.limit(most_queries + 1).count()
    if n > most_queries:
        raise ValueError(f"more than {most_queries} queries: route them in blocks")
    left = F.broadcast(queries.select("query_id", unit(F.col("embedding")).alias("q")))
    right = pages.select("page_id", unit(F.col("embedding")).alias("p"))
    return right.join(left).select("query_id", "page_id", F.round(dot(F.col("q"), F.col("p")), 6).alias("score"))


def similarities_in_blocks(queries: DataFrame, pages: DataFrame, most_queries: int = 4096) -> DataFrame:
    """As :func:`similarities`, for any number of rows of queries: by blocks of ``most_queries`` at most."""
    blocks = max(1, math.ceil(queries.count() / most_queries))
    while True:
        # Rows of one query_id go to any block, as each meets all pages by itself.
        keyed = queries.withColumn("block", F.pmod(F.xxhash64("query_id", F.monotonically_increasing_id()), F.lit(blocks)))
        keyed = stored(keyed, "query-blocks")
        largest = keyed.groupBy("block").count().agg(F.max("count")).head()[0] or 0
        if largest <= most_queries:
            break
        blocks *= 2
    of_block = [similarities(keyed.where(F.col("block") == k), pages, most_queries) for k in range(blocks)]
    return reduce(DataFrame.unionByName, of_block)


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """The pages of each query by score, ties by page."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "page_id")
    rows = scores.withColumn("rank", F.row_number().over(order))
    return rows if k is None else rows.where(F.col("rank") <= k)


def recall(ranks: DataFrame, ks: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """ranks: query_id, carrier, rank of the true page (null: not found). Per carrier and over all."""
    rolled = ranks.rollup("carrier").agg(
        F.count("*").alias("n"),
        *[F.round(100.0 * F.count_if(F.coalesce("rank", F.lit(1 << 30)) <= k) / F.count("*"), 1).alias(f"recall_{k}") for k in ks],
    )
    return rolled.select(F.coalesce("carrier", F.lit("all")).alias("carrier"), "n", *[f"recall_{k}" for k in ks])


def pages_saved(top: DataFrame, total_pages: int, ks: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """For each k: distinct pages that any query selects, and the share of all pages not read."""
    rows = top.select("page_id", F.explode(F.array(*[F.when(F.col("rank") <= k, F.lit(k)) for k in ks])).alias("k"))
    counts = rows.where("k is not null").groupBy("k").agg(F.countDistinct("page_id").alias("selected"))
    return counts.withColumn("saved_pct", F.round(100.0 * (1 - F.col("selected") / F.lit(float(total_pages))), 1))
