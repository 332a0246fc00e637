"""Edges to the nearest vectors, exact, by cells with bounds on distances.

Vectors are dealt to the nearest of a bounded number of centres, and each cell has a radius. A query
first meets the cells nearest to it, as many as hold enough vectors, which bounds how far its
neighbours can be. By the triangle inequality, a cell whose centre is further off than that bound and its
radius together holds none, and so for each vector by its own distance from the centre. All
other cells are searched. The centres decide how much is searched, and never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.scratch import materialize

SAMPLE = 20_000  # vectors that centres are fitted on at most
CELLS = 1024  # at most; else the root of the number of vectors
ROWS = 4096  # vectors of a block of a cell on average
QUERIES = 1024  # queries that meet a block at once, on average
STEPS = 5  # of moving centres


class Cells(NamedTuple):
    """Centres, and per cell its number of vectors and radius: bounded, so held by the driver."""

    centres: np.ndarray
    counts: np.ndarray
    radius: np.ndarray


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    return np.array(vectors.tolist(), float).reshape(len(vectors), width)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of each row of x from each of y."""
    square = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0))


def fit_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres that started as rows of the sample, moved to the mean of their own rows a few times."""
    centres = np.unique(sample, axis=0)
    centres = centres[np.random.default_rng(1).permutation(len(centres))[:cells]]
    for _ in range(STEPS):
        own = _distances(sample, centres).argmin(axis=1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, vector, cell, far): each vector with its nearest centre and the distance from it."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # at most CELLS rows

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                far = _distances(_matrix(part["vector"], shared.value.shape[1]), shared.value)
                yield part.assign(cell=far.argmin(axis=1), far=far.min(axis=1))

    return vectors.mapInPandas(run, "id bigint, vector array<double>, cell bigint, far double")


def _first_cells(far: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Which cells a query meets first: the nearest ones, until they hold more than k vectors."""
    order = far.argsort(kind="stable")
    held = counts[order].cumsum()
    chosen = np.zeros(len(far), bool)
    chosen[order[: np.searchsorted(held, k + 1) + 1]] = True
    return chosen


def _asked(queries: DataFrame, cells: Cells, k: int, bounded: bool) -> DataFrame:
    """(cell, id, vector, far, bound) of the cells that each query meets: the first ones, or, with a
    bound for each query, all others that may hold a neighbour."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, counts, radius = shared.value
        for part in parts:
            far = _distances(_matrix(part["vector"], centres.shape[1]), centres) if len(part) else ()
            for row, distances in zip(part.itertuples(index=False), far):
                chosen = _first_cells(distances, counts, k)
                if bounded:
                    chosen = ~chosen & (counts > 0) & (distances - radius <= row.bound)
                at = np.flatnonzero(chosen)
                if len(at):
                    n = len(at)
                    yield pd.DataFrame(
                        {"cell": at, "id": [row.id] * n, "vector": [row.vector] * n, "far": distances[at], "bound": [row.bound] * n}
                    )

    return queries.mapInPandas(run, "cell bigint, id bigint, vector array<double>, far double, bound double")


def _search(asked: DataFrame, placed: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(src, dst, square): for each query and block of a cell, the k nearest vectors of the block.

    A cell is parted into blocks by its count, and its queries too, so a task is bounded at any size
    of a cell. Rows whose distance from the centre differs from the query's by more than the
    query's bound are passed over.
    """
    spark = asked.sparkSession
    rows = [(c, max(1, -(-int(n) // ROWS))) for c, n in enumerate(cells.counts)]
    blocks = F.broadcast(spark.createDataFrame(rows, "cell bigint, blocks int"))  # at most CELLS rows
    asked = materialize(asked, "asked")
    groups = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))

    def own(salt: str, of: str):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.col(of)).cast("int")

    def each(of: str):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    left = asked.join(blocks, "cell").join(F.broadcast(groups), "cell")  # at most CELLS rows
    left = left.select("cell", each("blocks").alias("block"), own("q", "groups").alias("part"), "id", "vector", "far", "bound")
    right = placed.join(blocks, "cell").join(F.broadcast(groups), "cell")
    right = right.select("cell", own("r", "blocks").alias("block"), each("groups").alias("part"), "id", "vector", "far")

    def nearest(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(ask) and len(have):
            width = cells.centres.shape[1]
            x, y = _matrix(ask["vector"], width), _matrix(have["vector"], width)
            ids, far, rough = have["id"].to_numpy(), have["far"].to_numpy(), _distances(x, y)
            slack = 1e-6 * (1 + np.abs(x).max() + np.abs(y).max())  # the product form is less exact than the check
            for n, (src, own_far, bound) in enumerate(zip(ask["id"], ask["far"], ask["bound"])):
                near = np.flatnonzero((ids != src) & (np.abs(far - own_far) <= bound + slack) & (rough[n] <= bound + slack))
                if len(near) > k:
                    edge = np.partition(rough[n][near], k - 1)[k - 1]
                    near = near[rough[n][near] <= edge + slack]
                square = ((y[near] - x[n]) ** 2).sum(axis=1)
                order = np.lexsort((ids[near], square))
                found += [(src, int(ids[near[o]]), float(square[o])) for o in order[:k]]
        return pd.DataFrame(found, columns=["src", "dst", "square"])

    met = left.groupBy("cell", "block", "part").cogroup(right.groupBy("cell", "block", "part"))
    return met.applyInPandas(nearest, "src bigint, dst bigint, square double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy("square", "dst")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_edges(vectors: DataFrame, k: int = 10, every: int = 50, sample: int = SAMPLE) -> DataFrame:
    """``src, dst, rank, distance``: the ``k`` nearest other vectors of each whose id is divisible by ``every``.

    ``vectors`` has ``id`` and ``vector``, of one length. Distances are Euclidean; ties go to the smaller id. Rows without an id or
    a whole vector are left out; of rows that repeat an id, the smallest vector stands for it. With fewer
    than ``k`` others, all are returned. Exact, for any centres: they are fitted on at most ``sample``
    vectors, chosen by a hash of the id, and every vector is indexed.
    """
    known = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    known = known.where("id IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL OR isnan(x))")
    known = materialize(known.groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if not len(chosen):
        return known.sparkSession.createDataFrame([], "src bigint, dst bigint, rank int, distance double")
    points = np.array(chosen["vector"].tolist(), float)
    centres = fit_centres(points, min(CELLS, max(1, int(known.count() ** 0.5))))
    placed = materialize(_assigned(known, centres), "placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).toPandas()
    counts, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    counts[sizes["cell"]], radius[sizes["cell"]] = sizes["n"], sizes["radius"]
    cells = Cells(centres, counts, radius * (1 + 1e-9) + 1e-9)
    queries = placed.where(F.col("id") % every == 0).select("id", "vector", F.lit(float("inf")).alias("bound"))
    first = materialize(_search(_asked(queries, cells, k, False), placed, cells, k), "first")
    bound = _best(first, k).where(F.col("rank") == k).select(F.col("src").alias("id"), F.sqrt("square").alias("bound"))
    again = queries.drop("bound").join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    more = _search(_asked(again, cells, k, True), placed, cells, k)
    best = _best(first.unionByName(more), k)
    return best.select("src", "dst", "rank", F.sqrt("square").alias("distance"))
