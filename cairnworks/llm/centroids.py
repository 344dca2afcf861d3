"""Clustering of integer vectors by Lloyd's rounds, each assignment an annulus search.

By the triangle inequality a centroid at distance u or less from a vector has a norm within u of
the vector's. The centroids are sorted by norm, the exact distance to the one with the closest
norm bounds the annulus, two binary searches find the centroids inside, and only those are
compared, in integers. Norms are floating-point numbers, so the annulus is widened by far more than
their rounding: what lies on its edge, ties included, is always among the compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.llm.batches import map_arrow
from cairnworks.llm.vectors import integer_vectors, matrix
from cairnworks.scratch import discard, materialize

#: Numbers of vector components that are compared at a time.
AT_A_TIME = 1 << 20
#: Relative widening of the annulus; a double's rounding is about 1e-16.
SLACK = 1e-9


class Annuli:
    """The nearest of some centroids for many vectors."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def _distance(self, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        apart = vectors - self.centroids[numbers]
        return np.einsum("ij,ij->i", apart, apart)

    def candidates(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end places, in the order of norms, of the centroids in each vector's annulus."""
        own = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        right = np.searchsorted(self.norms, own).clip(max=len(self.norms) - 1)
        left = (right - 1).clip(min=0)
        guess = np.where(np.abs(own - self.norms[left]) <= np.abs(self.norms[right] - own), left, right)
        bound = np.sqrt(self._distance(vectors, self.order[guess]).astype(np.float64))
        slack = SLACK * (own + bound + 1)
        return np.searchsorted(self.norms, own - bound - slack, "left"), np.searchsorted(self.norms, own + bound + slack, "right")

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the nearest centroids and squared distances to them; of ties the smaller number."""
        found, distances = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
        step = max(1, AT_A_TIME // self.centroids.size)
        for k in range(0, len(vectors), step):
            some = vectors[k : k + step]
            first, end = self.candidates(some)
            n = end - first
            starts = np.cumsum(n) - n
            row = np.repeat(np.arange(len(some)), n)
            number = self.order[np.arange(len(row)) - np.repeat(starts - first, n)]
            distance = self._distance(some[row], number)
            least = np.minimum.reduceat(distance, starts)
            found[k : k + step] = np.minimum.reduceat(np.where(distance == least[row], number, len(self.order)), starts)
            distances[k : k + step] = least
        return found, distances


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes, in that order; null ids come last, rows of one id by their vectors."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(drawn.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: every one's vectors' mean, rounded down by component; those without vectors stay.

    A task sends one row of sums for each centroid, which Spark adds up before and after the
    shuffle; the driver sees as many numbers as the centroids have components.
    """
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annuli(centroids)
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = matrix(batch.column(0), dims)
            cluster = search.nearest(v)[0]
            np.add.at(total, cluster, v)
            count += np.bincount(cluster, minlength=k)
        held = np.flatnonzero(count)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(count[held]), pa.array(list(total[held]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = map_arrow(vectors.select("v"), sums, "cluster int, n long, total array<long>")
    added = parts.select("cluster", "n", F.posexplode("total").alias("j", "x")).groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = centroids.copy()
    for r in added.collect():  # k * dims rows
        out[r["cluster"], r["j"]] = int(r["x"]) // r["n"]
    return out


def cluster_vectors(table: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", scale: int = 1024, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(rows (vec_id, cluster, distance), final centroids).

    Vectors of ``dims`` finite components only, as integers floor(scale * x); the first centroids are
    drawn by a hash of the id, then come ``rounds`` rounds and one more assignment. Everything is exact, so any
    order of tasks gives the same result. Repeated rows and ids are vectors of their own; null ids stay null and
    are drawn last; fewer vectors than ``k`` give fewer centroids; an empty table gives no rows and no centroids.
    Columns but the two named are not read. The vectors are written once, as integers, to the shared folder.
    """
    spark = table.sparkSession
    vectors = materialize(integer_vectors(table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x")), scale, dims, "vec_id", vector_col="x"), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        discard(vectors)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annuli(centroids)
        for batch in batches:
            cluster, distance = search.nearest(matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    rows = materialize(map_arrow(vectors, assign, "vec_id long, cluster int, distance long"), "assigned")
    discard(vectors)
    return rows, centroids


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds each cluster's and the whole inertia and a digest of its centroid, ``k`` rows that are broadcast."""
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = [(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()]
    about = rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
