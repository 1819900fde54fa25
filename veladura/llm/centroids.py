"""Clusters of vectors around centroids, by equal-average equal-variance search.

Centroids are sorted by the sum of their components.  A vector starts where its own sum
belongs and looks outward, always at the nearer sum next.  With ``S`` for the sum of a
vector's components, ``d`` components and ``V**2 = d * sum(x**2) - S**2`` (d times the
spread around the mean), every centroid ``c`` has::

    d * distance(x, c) >= (Sx - Sc)**2 + (Vx - Vc)**2

The first term alone ends a vector's search, as all later sums are farther away; both
reject a single centroid.  The first is compared in integers, the second in doubles that
are rounded towards keeping.  A centroid is rejected only if it is strictly farther than
the best so far; the others are compared by their integer distance and then by number, so
the result is that of comparing with all centroids.

Spark deals out the vectors; a task keeps one sum per centroid and component and returns
them when it ends, so what is shuffled grows with tasks and centroids only.  The driver
holds the centroids, ``k * dim`` numbers.  Vectors are stored once as integers in the
shared folder; a lost executor costs one round of its tasks.

Edge cases: vectors that are null, hold a null, NaN or infinite component, or have another
length than ``dim`` are left out; vectors with a component beyond ``vectors.bound(dim)``
(16,777,216 / 1024 for 64 components) are returned with a null cluster and distance and
take no part.  Rows without an id come last where the first centroids are chosen; rows
with equal ids are told apart by their vectors, and repeated rows count each.  Fewer than
``k`` vectors give as many centroids; an empty table gives an empty result.  Equal
centroids: the smaller number gets the vectors and the other one stays as it is.  Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veladura.llm import vectors
from veladura.llm.common import cut, ship

ship(__name__)

CLUSTERS, ROUNDS, DIM, SEED = 8, 10, 64, "3"


class Search:
    """The centroids in order of their sums, ready to be searched."""

    def __init__(self, centroids: np.ndarray):
        self.dim = centroids.shape[1]
        self.order = np.argsort(centroids.sum(1), kind="stable")
        self.rows = centroids[self.order]
        self.sums = self.rows.sum(1)
        self.spread = self._spread(self.rows, self.sums)
        self.compared = 0  # distances computed so far

    def _spread(self, rows: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return np.sqrt((self.dim * (rows * rows).sum(1) - sums * sums).astype(np.float64))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and the squared distance to it, for every row."""
        n, k = len(x), len(self.rows)
        sums = x.sum(1)
        spread = self._spread(x, sums)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        best = np.full(n, np.iinfo(np.int64).max, dtype=np.int64)
        number = np.full(n, k, dtype=np.int64)
        far = np.iinfo(np.int64).max
        active = np.arange(n)
        while len(active):
            li, ri = left[active], right[active]
            to_left = np.where(li >= 0, sums[active] - self.sums[np.maximum(li, 0)], far)
            to_right = np.where(ri < k, self.sums[np.minimum(ri, k - 1)] - sums[active], far)
            gap = np.minimum(to_left, to_right)
            # nothing is left, or whatever is left is too far by its sum
            limit = np.where(number[active] < k, self.dim * np.minimum(best[active], far // self.dim), far)
            on = (gap < far) & (np.where(gap < far, gap, 0) ** 2 <= limit)
            active, gap, limit = active[on], gap[on], limit[on]
            goes_left = to_left[on] <= to_right[on]
            candidate = np.where(goes_left, left[active], right[active])
            left[active] -= goes_left
            right[active] += ~goes_left
            apart = np.abs(spread[active] - self.spread[candidate])
            doubt = 1e-9 * (spread[active] + self.spread[candidate] + 1.0)
            least = gap.astype(np.float64) ** 2 + np.maximum(apart - doubt, 0.0) ** 2
            close = least * (1 - 1e-12) <= limit.astype(np.float64) * (1 + 1e-12)
            rows, candidate = active[close], candidate[close]
            self.compared += len(rows)
            difference = x[rows] - self.rows[candidate]
            distance = (difference * difference).sum(1)
            of = self.order[candidate]
            better = (distance < best[rows]) | ((distance == best[rows]) & (of < number[rows]))
            best[rows[better]] = distance[better]
            number[rows[better]] = of[better]
        return number, best


def _blocks(batches: Iterator[pa.RecordBatch], dim: int):
    for batch in batches:
        for start in range(0, batch.num_rows, vectors.BLOCK):
            part = batch.slice(start, vectors.BLOCK)
            yield part, vectors.matrix(part.column("whole"), dim)


def _gather(stored: DataFrame, centroids: np.ndarray) -> dict[int, int]:
    """Per centroid the sums of its vectors' components, then their number."""
    k, dim = centroids.shape

    def run(batches):
        search, sums = Search(centroids), np.zeros((k, dim + 1), dtype=np.int64)
        for _, x in _blocks(batches, dim):
            number, _ = search.nearest(x)
            np.add.at(sums[:, :dim], number, x)
            sums[:, dim] += np.bincount(number, minlength=k)
        held = np.flatnonzero(np.repeat(sums[:, dim] > 0, dim + 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int64()), pa.array(sums.ravel()[held], pa.int64())], ["slot", "total"]
        )

    return vectors.summed(stored.select("whole").mapInArrow(run, "slot bigint, total bigint"))


def move(centroids: np.ndarray, sums: dict[int, int]) -> np.ndarray:
    """Every centroid at the floor of its vectors' mean; those without vectors stay."""
    k, dim = centroids.shape
    moved = centroids.copy()
    for c in range(k):
        n = sums.get(c * (dim + 1) + dim, 0)
        if n:
            moved[c] = [sums[c * (dim + 1) + i] // n for i in range(dim)]
    return moved


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    df: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dim: int = DIM,
    id: str = "vec_id",
    vector: str = "embedding",
    seed: str = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` and the centroids."""
    spark = df.sparkSession
    kept = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("vector"))
    kept = kept.filter(vectors.finite(F.col("vector")) & (F.size("vector") == dim))
    every = cut(kept.select("id", vectors.whole(F.col("vector"), dim).alias("whole")), "vectors")
    stored = every.filter("whole is not null")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = stored.orderBy(hashed.asc_nulls_last(), "whole").limit(k).select("whole").collect()
    centroids = np.array([r[0] for r in first], dtype=np.int64).reshape(-1, dim)
    if len(centroids):
        for _ in range(rounds):
            centroids = move(centroids, _gather(stored, centroids))

    def run(batches):
        search = Search(centroids)
        for part, x in _blocks(batches, dim):
            number, distance = search.nearest(x)
            columns = [part.column("id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    kind = every.schema["id"].dataType.simpleString()
    found = stored.mapInArrow(run, f"id {kind}, cluster int, distance bigint")
    found = cut(found, "clusters")
    sums = vectors.summed(found, "cluster", "distance")
    rows = [(c, sums.get(c, 0), digest(row)) for c, row in enumerate(centroids)]
    # one row per centroid, whatever the input
    totals = spark.createDataFrame(rows, "c int, cluster_inertia bigint, centroid_sha256 string")
    out = found.join(F.broadcast(totals), F.col("cluster") == F.col("c"))
    none = every.filter("whole is null").select(
        "id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("bigint").alias("distance"),
        F.lit(None).cast("bigint").alias("cluster_inertia"), F.lit(None).cast("string").alias("centroid_sha256"),
    )
    out = out.select("id", "cluster", "distance", "cluster_inertia", "centroid_sha256").unionByName(none)
    return out.select(
        F.col("id").alias(id), "cluster", "distance", "cluster_inertia",
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"), "centroid_sha256",
    ), centroids
