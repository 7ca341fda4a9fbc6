"""Centroid clustering by a tournament of bisecting planes, in exact integers.

A vector x is nearer to centroid a than to centroid b, or as near, if it does not lie beyond
the plane between them: x . 2(b - a) <= |b|^2 - |a|^2. Normals and thresholds of all pairs
are integers made once for each round of k-means. A vector's winner so far meets the other
centroids by ascending number; each of the k - 1 sign tests eliminates one of the two, and
zero favours the smaller number, so the last winner is the nearest centroid with the
smallest number. Only its distance is worked out, exactly.

Vectors are assigned where they are; a task sends one row of sums for each centroid, and
nothing else of a round reaches the driver. The table is read once for each round.

Nulls: vectors that are null, hold null or non-finite components or have another length than
`dims` are left out. Rows without vec_id are clustered and come last as starting centroids;
vectors with equal ids stand in the order of their components. With fewer vectors than
centroids each vector starts one. Repeated rows count each; no vectors give no rows.
Components beyond 2^27 after scaling are an error, since 64 bits might not hold the sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passagemill.llm.common import column
from passagemill.llm.vectors import SUMS, GroupSums, floor_means, integer_batches, integer_vectors
from passagemill.session import stored

RESULT = ("vec_id LONG, cluster INT, distance LONG, cluster_inertia LONG, inertia LONG, centroid_sha256 STRING")


class Tournament:
    """Normals and thresholds between all pairs of centroids."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.normals = 2 * (centroids[None] - centroids[:, None])  # [a, b] points from a to b
        squares = (centroids * centroids).sum(axis=1)
        self.thresholds = squares[None] - squares[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        winner = np.zeros(len(x), np.int64)
        for challenger in range(1, len(self.centroids)):
            side = np.einsum("ij,ij->i", x, self.normals[winner, challenger])
            winner[side > self.thresholds[winner, challenger]] = challenger
        return winner

    def distances(self, x: np.ndarray, winner: np.ndarray) -> np.ndarray:
        away = x - self.centroids[winner]
        return np.einsum("ij,ij->i", away, away)


def starting_centroids(rows: DataFrame, k: int, factor: int, dims: int, salt: str) -> np.ndarray:
    """The k vectors whose ids have the smallest sha256 of `salt` and the id, in that order."""
    first = integer_vectors(rows, factor, dims).select(
        F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("h"), "v",
    ).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64).reshape(len(first), dims)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, factor: int = 256, dims: int = 64,
            salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, a stored table, and the centroids."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    centroids = starting_centroids(rows, k, factor, dims, salt)

    def assign(batches: Iterator[pa.RecordBatch], planes: Tournament) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for part, x in integer_batches(batches, factor, dims):
            yield part, x, planes.nearest(x)

    for _ in range(rounds if len(centroids) else 0):
        planes = Tournament(centroids)

        def added(batches: Iterator[pa.RecordBatch], planes: Tournament = planes) -> Iterator[pa.RecordBatch]:
            sums = GroupSums(len(planes.centroids), dims)
            for _, x, winner in assign(batches, planes):
                sums.add(winner, x)
            yield sums.batch()

        centroids = floor_means(rows.mapInArrow(added, SUMS), centroids)
    planes = Tournament(centroids)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, winner in assign(batches, planes):
            if len(x):
                yield pa.RecordBatch.from_arrays(
                    [column(part, "vec_id"), pa.array(winner.astype(np.int32)), pa.array(planes.distances(x, winner))],
                    ["vec_id", "cluster", "distance"])

    return stored(rows.mapInArrow(final, "vec_id LONG, cluster INT, distance LONG"), "clusters"), centroids


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """The assignment with the inertia of each cluster and of all, and its centroid's digest."""
    spark = vectors.sparkSession
    found, centroids = cluster(vectors, **options)
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    if not inertia:
        return spark.createDataFrame([], RESULT)
    told = spark.createDataFrame([
        (c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, s in inertia.items()], "cluster INT, cluster_inertia LONG, inertia LONG, centroid_sha256 STRING")
    return found.join(F.broadcast(told), "cluster").select(  # a row for each centroid, k at most
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
