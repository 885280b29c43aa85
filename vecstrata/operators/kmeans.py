"""Two-means for splitting a posting list, one k-means step, and the mean vector."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import euclidean_squared


def two_means(rows: np.ndarray, iterations: int = 50, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions a, positions b, centroid a, centroid b).

    Squared Euclidean always; the first and the last row are the seeds; ties go to a; a side
    that stays empty takes the row farthest from the other's centre; it ends when the total
    squared shift is below the squared tolerance, and assigns once more."""
    n, none = len(rows), np.zeros(0, np.int64)
    if n == 0:
        return none, none, np.zeros(rows.shape[1]), np.zeros(rows.shape[1])
    if n == 1:
        return np.zeros(1, np.int64), none, rows[0].copy(), rows[0].copy()
    centers = np.stack([rows[0], rows[-1]])

    def sides() -> np.ndarray:
        da, db = (((rows - c) ** 2).sum(axis=1) for c in centers)
        in_b = db < da
        if in_b.all():
            in_b[np.flatnonzero(db == db.max())[-1]] = False
        elif not in_b.any():
            in_b[np.flatnonzero(da == da.max())[-1]] = True
        return in_b

    for _ in range(iterations):
        in_b = sides()
        moved = np.stack([rows[~in_b].mean(axis=0), rows[in_b].mean(axis=0)])
        shift, centers = ((moved - centers) ** 2).sum(), moved
        if shift < tolerance**2:
            break
    in_b = sides()
    return np.flatnonzero(~in_b), np.flatnonzero(in_b), centers[0], centers[1]


def divide(rows: np.ndarray, parts: int) -> list[np.ndarray]:
    """Centroids of up to ``parts`` groups: the largest group is split in two again and again."""
    groups = [rows]
    while len(groups) < parts:
        big = max(range(len(groups)), key=lambda i: len(groups[i]))
        a, b, _, _ = two_means(groups[big])
        if not len(b) or not len(a) or len(groups[big]) < 2 or (groups[big] == groups[big][0]).all():
            break
        g = groups.pop(big)
        groups += [g[a], g[b]]
    return [g.mean(axis=0) for g in groups]


def centroid_mean(rows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """(key, centroid): the mean of each component, by grouped averages alone."""
    numbers = rows.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("pos", "v"))
    parts = numbers.groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))


def kmeans_step(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """(cluster, n, centroid): assign (id, vector) rows to the nearest of a few (cluster,
    centroid) rows, ties to the smaller cluster, and take the means.

    The centres travel as one array, so a vector finds its own without a join on pairs or a
    shuffle; only the partial means are shuffled."""
    listed = centers.agg(F.collect_list(F.struct("cluster", "centroid")).alias("centers"))
    scored = F.transform("centers", lambda c: F.struct(euclidean_squared(F.col("vector"), c["centroid"]).alias("d"), c["cluster"].alias("cluster")))
    own = rows.crossJoin(F.broadcast(listed)).select("id", "vector", F.array_min(scored)["cluster"].alias("cluster"))
    return own.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).join(centroid_mean(own, "cluster"), "cluster")


def posting_sizes(postings: DataFrame) -> DataFrame:
    return postings.groupBy("head_id").agg(F.count(F.lit(1)).alias("size"))
