"""Nearest vectors by cells around centres, exactly: the triangle inequality rules out cells and rings of cells.

Centres are learned from a bounded sample; every vector is then in the cell of its nearest centre, with its distance
from it. A vector that lies within t of a query lies, from any centre, within t of the query's distance from that centre.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaymill.sources.shared import stored

#: Centres at most, vectors that they are learned from at most, and passes over those.
CENTRES, SAMPLE, PASSES = 512, 16_384, 8
#: Vectors and queries that meet at a time, at most.
TILE, ASKED = 4096, 1024
#: Cells in which a query looks for its first k neighbours.
SEEDS = 2
#: What rounding scores to six decimals and arithmetic may take from a distance.
SLACK = 1e-5
#: More than two vectors of length 1 can lie apart.
EVERYWHERE = 4.0


def units(vectors: np.ndarray) -> np.ndarray:
    """Each vector with length 1; a length below 1e-12 counts as that."""
    vectors = vectors.astype(np.float64)
    return vectors / np.maximum(np.sqrt((vectors * vectors).sum(1)), 1e-12)[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column of lists of one size; no null among them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def learn_centres(vectors: DataFrame, centres: int = CENTRES, sample: int = SAMPLE, passes: int = PASSES) -> np.ndarray:
    """Centres of unit vectors: k-means on a sample of at most ``sample`` rows, the lowest by a hash, so that it doesn't hang
    on their order. There are as many as the square root of all rows, at most ``centres``."""
    rows = vectors.count()
    if not rows:
        return np.zeros((0, 1))
    taken = vectors.select(F.xxhash64("page_id").alias("h"), "page_id", "embedding").orderBy("h", "page_id").limit(sample)
    points = units(np.array([r["embedding"] for r in taken.collect()], float))
    n = max(1, min(centres, len(points), int(rows**0.5)))
    found = points[:: max(1, len(points) // n)][:n].copy()
    for _ in range(passes):
        nearest = distances(points, found).argmin(1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(found))
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
    return found


def placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """page_id, embedding (unit), cell and away (from its centre) of every row of ``vectors``."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = units(matrix(batch.column("embedding")))
            away = distances(points, centres)
            cell = away.argmin(1) if away.size else np.zeros(0, int)
            arrays = [batch.column("page_id"), pa.array(list(points), pa.list_(pa.float64())), pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "embedding", "cell", "away"])

    kinds = f"page_id {vectors.schema['page_id'].dataType.simpleString()}, embedding array<double>, cell int, away double"
    return vectors.select("page_id", "embedding").mapInArrow(place, kinds)


class CellIndex:
    """Every vector of a table in its cell. ``pages``: page_id, embedding, cell, away, tile; ``cells``: cell, far, tiles."""

    def __init__(self, vectors: DataFrame, centres: np.ndarray | None = None, tile: int = TILE):
        """vectors: page_id, embedding; rows without either are left out. A cell of any size is cut into tiles."""
        rows = vectors.select("page_id", "embedding").where("page_id is not null and embedding is not null")
        self.centres = learn_centres(rows) if centres is None else centres
        pages = stored(placed(rows, self.centres).withColumn("row", F.monotonically_increasing_id()), "cells")
        sizes = pages.groupBy("cell").agg(F.max("away").alias("far"), F.min("away").alias("near"), F.ceil(F.count("*") / tile).alias("tiles"))
        self.cells = stored(sizes, "cell-sizes")  # a row for each centre
        pages = pages.join(F.broadcast(self.cells.select("cell", "tiles")), "cell")
        self.pages = pages.withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int")).drop("row", "tiles")


def asked_cells(queries: DataFrame, index: CellIndex) -> DataFrame:
    """query_id, embedding (unit), cell, off: how far each query is from each centre."""
    centres = index.centres

    def reach(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = units(matrix(batch.column("embedding")))
            off = distances(points, centres)
            arrays = [batch.column("query_id"), pa.array(list(points), pa.list_(pa.float64())), pa.array(list(off), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "embedding", "off"])

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, embedding array<double>, off array<double>"
    rows = queries.select("query_id", "embedding").where("query_id is not null and embedding is not null")
    return rows.mapInArrow(reach, kinds)


def compared(asked: DataFrame, index: CellIndex, k: int, but_itself: bool) -> DataFrame:
    """query_id, page_id, score, met: of each query and tile the k best pages within the query's reach.

    asked: query_id, embedding, cell, off, reach. Queries of a cell meet its tiles in blocks, so that what stands in
    memory is a tile of vectors and a block of queries. met: how many vectors of the tile were compared.
    """
    n_asked = asked.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("blocks"))
    sizes = index.cells.select("cell", F.col("tiles").cast("int").alias("tiles"))
    blocks = n_asked.join(sizes, "cell")  # a row for each centre
    left = asked.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    left = left.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles", "blocks")
    right = index.pages.join(F.broadcast(blocks.select("cell", "blocks")), "cell")
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def meet(queries: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(pages):
            pages = pages.sort_values("page_id", kind="stable")
            ids, away = pages["page_id"].to_numpy(), pages["away"].to_numpy()
            points = np.stack(pages["embedding"].to_numpy())
            scores = np.round(np.stack(queries["embedding"].to_numpy()) @ points.T, 6)
            for i, q in enumerate(queries.itertuples(index=False)):
                near = np.abs(q.off - away) <= q.reach
                if but_itself:
                    near &= ids != q.query_id
                at = np.flatnonzero(near)
                for j in at[np.argsort(-scores[i, at], kind="stable")[:k]]:
                    out.append((q.query_id, ids[j], scores[i, j], len(at)))
        return pd.DataFrame(out, columns=["query_id", "page_id", "score", "met"])

    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, page_id {index.pages.schema['page_id'].dataType.simpleString()}, score double, met long"
    keys = ["cell", "tile", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, kinds)


def nearest(queries: DataFrame, index: CellIndex, k: int, but_itself: bool = False) -> DataFrame:
    """query_id, page_id, score (cosine, six decimals), rank: the k nearest vectors of each query, exactly; ties by page.

    queries: query_id, embedding; query_id is unique, rows without either are left out. A query meets the vectors of
    the cells nearest to it first; the k-th of these is as far as its others can be, which leaves a ring of each cell
    that reaches so far. but_itself: a vector whose page_id is the query's isn't its neighbour.
    """
    asked = stored(asked_cells(queries, index), "cell-queries")
    by_off = F.array_sort(F.transform("off", lambda x, i: F.struct(x.alias("off"), i.alias("cell"))))
    first = asked.select("query_id", "embedding", F.inline(F.slice(by_off, 1, SEEDS))).withColumn("reach", F.lit(EVERYWHERE))
    seen = top(compared(first, index, k, but_itself), k)
    least = seen.where(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(2.0 - 2.0 * F.col("score"), F.lit(0.0)) + SLACK).alias("reach"))
    each = asked.join(least, "query_id", "left").select(
        "query_id", "embedding", F.coalesce("reach", F.lit(EVERYWHERE)).alias("reach"), F.posexplode("off").alias("cell", "off")
    )
    each = each.join(F.broadcast(index.cells.select("cell", "near", "far")), "cell")
    touched = F.col("off").between(F.col("near") - F.col("reach"), F.col("far") + F.col("reach"))
    return top(compared(each.where(touched).drop("near", "far"), index, k, but_itself), k)


def top(pairs: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "page_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("met")
