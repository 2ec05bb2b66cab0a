"""Exact k-means over integer vectors, with clusters as balls.

A cluster is a ball: its centroid and a radius that no member is outside of.
Only centroids nearer than twice the radius can take members away; these are
its neighbours. A member within half the distance to the nearest neighbour is
in the stable core and stays. The rest of the ball is cut into annuli at half
the distances to the neighbours in order, and a member of the n-th annulus is
compared with the first n neighbours only. All numbers are integers, so results
don't depend on the order of sums or on how rows are dealt to tasks.

Every round reads the vectors once, writes them with their new cluster, and
adds up sums, counts and radii in each task; the driver gets one row a cluster.
A cluster's radius in the next round is bounded by its farthest member plus
what its centroid moved.

Vectors with another number of components, or with a null, NaN or infinite one,
are left out, as are null vectors. Repeated rows are vectors of their own; a
null id counts as an empty text where centroids are chosen. Fewer vectors than
``k`` give as many clusters as there are vectors; none give no rows. Other
columns aren't returned, so their names can't clash. Components whose distances
might not fit a long (beyond 2**26 after scaling, at 64 components) are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import Scratch, written


def scaled(vectors: DataFrame, dims: int, scale: int, vec: str = "embedding") -> DataFrame:
    """``vectors`` with ``parts_``, the components times ``scale`` rounded down; only vectors of ``dims`` finite numbers."""
    x = F.col(vec).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = vectors.where((F.size(x) == dims) & finite)
    parts = F.transform(x, lambda v: F.floor(v * scale))
    largest = F.array_max(F.transform(parts, lambda v: F.abs(v)))
    # Differences are up to twice as large, and four times their squared sum must fit a long.
    checked = F.when(largest <= isqrt(((1 << 63) - 1) // (16 * dims)), parts).otherwise(F.raise_error(F.lit("a component is too large for distances in a long")).cast("array<bigint>"))
    return whole.withColumn("parts_", checked)


def first_centroids(rows: DataFrame, k: int, seed: int, vec_id: str) -> np.ndarray:
    """The vectors of the ``k`` least SHA-256 digests of ``seed:id``, in their order; ties by the vectors."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(vec_id).cast("string"), F.lit(""))).cast("binary"), 256)
    found = rows.select(digest.alias("digest"), "parts_").orderBy("digest", "parts_").limit(k).collect()
    return np.array([r.parts_ for r in found], np.int64)


class Balls:
    """The centroids of a round, and for each cluster the neighbours in order with their squared distances.

    ``radii`` holds squared bounds of the balls' radii as (farthest, moved), both
    squared; None stands for a ball that holds everything.
    """

    def __init__(self, centroids: np.ndarray, radii: list[tuple[int, int] | None]):
        self.centroids, self.neighbours = centroids, []
        for j, radius in enumerate(radii):
            apart = ((centroids - centroids[j]) ** 2).sum(axis=1)
            order = np.lexsort((np.arange(len(centroids)), apart))
            order = order[order != j]
            if radius is not None:
                bound = sum(isqrt(part) + 1 for part in radius)
                order = order[[int(apart[i]) <= 4 * bound * bound for i in order]]
            self.neighbours.append((order, apart[order]))

    def assign(self, points: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each point, which is in the ball ``cluster`` so far; ties go to the smaller number."""
        best, least = cluster.copy(), np.zeros(len(points), np.int64)
        for j in np.unique(cluster):
            rows = np.flatnonzero(cluster == j)
            own = ((points[rows] - self.centroids[j]) ** 2).sum(axis=1)
            near, mine = own.copy(), np.full(len(rows), j)
            for i, apart in zip(*self.neighbours[j], strict=True):
                # Closer than half the way to a neighbour, a point can neither be nearer to it nor tie; later ones are farther.
                outer = np.flatnonzero(4 * own >= apart)
                if not len(outer):
                    break
                to = ((points[rows[outer]] - self.centroids[i]) ** 2).sum(axis=1)
                wins = (to < near[outer]) | ((to == near[outer]) & (i < mine[outer]))
                near[outer[wins]], mine[outer[wins]] = to[wins], i
            best[rows], least[rows] = mine, near
        return best, least


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def assigned(rows: DataFrame, balls: Balls) -> DataFrame:
    """``rows`` with ``cluster_`` and ``distance_`` by the balls of a round."""
    dims, names = balls.centroids.shape[1], rows.columns
    shared = rows.sparkSession.sparkContext.broadcast(balls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = dict(zip(("cluster_", "distance_"), shared.value.assign(_matrix(batch.column("parts_"), dims), batch.column("cluster_").to_numpy()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(new[c]) if c in new else batch.column(c) for c in names], names)

    return rows.mapInArrow(run, rows.schema)


def totals(rows: DataFrame, dims: int) -> dict[int, tuple[np.ndarray, int, int, int]]:
    """Of each cluster the sum of its vectors, their number, the largest and the summed squared distance; added up in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, far = batch.column("cluster_").to_numpy(), batch.column("distance_").to_numpy()
            points = _matrix(batch.column("parts_"), dims)
            found = np.unique(cluster)
            masks = [cluster == j for j in found]
            flat = [points[m].sum(axis=0) for m in masks]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(flat, pa.list_(pa.int64())), *(pa.array([int(f(far[m])) for m in masks], pa.int64()) for f in (len, np.max, np.sum))],
                ["cluster_", "sums", "n", "far", "inertia"],
            )

    part = rows.select("cluster_", "distance_", "parts_").mapInArrow(run, "cluster_ bigint, sums array<bigint>, n bigint, far bigint, inertia bigint")
    sums = F.array(*(F.sum(F.col("sums")[i]) for i in range(dims)))
    found = part.groupBy("cluster_").agg(sums.alias("sums"), F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("inertia").alias("inertia")).collect()
    return {r.cluster_: (np.array(r.sums, np.int64), r.n, r.far, r.inertia) for r in found}


def cluster(vectors: DataFrame, k: int, rounds: int, seed: int, dims: int, scale: int = 1024, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): the clusters after ``rounds`` rounds and a last assignment.

    ``distance`` is squared, ``centroid`` the final integers. The clusters are few
    enough for a row each on the driver and in every task: ``k`` bounds them.
    """
    spark = vectors.sparkSession
    with Scratch(spark) as tables:
        start = scaled(vectors.select(vec_id, vec), dims, scale, vec).select(vec_id, "parts_", F.lit(0).cast("bigint").alias("cluster_"), F.lit(0).cast("bigint").alias("distance_"))
        rows = tables.write(start, "balls_even")
        centroids = first_centroids(rows, k, seed, vec_id)
        if not len(centroids):
            return spark.createDataFrame([], f"{vec_id} {vectors.schema[vec_id].dataType.simpleString()}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
        radii: list[tuple[int, int] | None] = [None] * len(centroids)
        for n in range(rounds):
            name, last = ("balls_odd", "balls_even") if n % 2 == 0 else ("balls_even", "balls_odd")
            rows = tables.write(assigned(rows, Balls(centroids, radii)), name)
            tables.drop(last)
            found = totals(rows, dims)
            moved = centroids.copy()
            for j, (sums, size, _, _) in found.items():
                moved[j] = sums // size
            radii = [(found[j][2], int(((moved[j] - centroids[j]) ** 2).sum())) if j in found else (0, 0) for j in range(len(centroids))]
            centroids = moved
        rows = written(assigned(rows, Balls(centroids, radii)), "balls_last")
    found = totals(rows, dims)
    each = [(j, found[j][3] if j in found else 0, [int(x) for x in centroids[j]]) for j in range(len(centroids))]
    of = F.broadcast(spark.createDataFrame(each, "number int, cluster_inertia bigint, centroid array<bigint>"))
    total = F.lit(sum(e[1] for e in each)).cast("bigint")
    joined = rows.join(of, F.col("cluster_") == F.col("number"))
    return joined.select(vec_id, F.col("number").alias("cluster"), F.col("distance_").alias("distance"), "cluster_inertia", total.alias("inertia"), "centroid")


def digest(centroid: np.ndarray | list[int]) -> str:
    """The lowercase SHA-256 of a centroid's integers, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
