"""Exact k-means over integer vectors, with distances to centroids skipped by a bound in PCA-rotated space.

Each vector is stored as its integers, its ``LEADING`` first coordinates after rotation onto the principal axes (of the
covariance of all vectors), and the norm of the rest. A rotation keeps distances, and the distance of two rests is at
least the difference of their norms; so the squared distance of the leading coordinates plus the squared difference of
the norms is a lower bound of the squared distance. A centroid whose bound is above the distance to the best one so
far can't be the nearest; the others are compared in integers, so the assignment is exact and ties go to the smaller
number. The stored coordinates are rounded, for which the bound allows in proportion to the norms.

A round is one pass over the stored table: each task sends the sums of its vectors by cluster, k times 65 numbers,
however skewed clusters and vectors are; the driver gets k times 65 numbers in all.

Defined cases: a null vector, one of another size, or with a component that is null, NaN or infinite is left out; a
component beyond +-131,072 raises, since distances wouldn't fit a long; equal vectors and ids are rows of their own; null
ids start as a centroid only where there are too few others; of rows with one hash the smaller vector starts first; with
fewer vectors than k there are as many centroids as vectors; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, ship

SIZE = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
LEADING = 12
#: Up to here 64 squared differences fit a long.
LARGEST = 1 << 27


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components times ``scale`` rounded down, of all sound vectors."""
    v = vectors[vector_col].cast("array<double>")
    sound = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def whole(x):
        n = F.floor(x * scale)
        return F.when(n.between(-LARGEST, LARGEST), n).otherwise(F.raise_error(F.lit("a component is too large for distances in a long"))).cast("int")

    return vectors.where(F.coalesce(sound, F.lit(False))).select(vectors[id_col].cast("long").alias("vec_id"), F.transform(v, whole).alias("v"))


def matrix(column: pa.Array, size: int, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), size)


def axes(vectors: DataFrame, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the principal axes as columns by falling variance."""
    ship(vectors.sparkSession)

    def run(batches):
        total = np.zeros((size + 1, size + 1))
        for b in batches:
            m = np.hstack([matrix(b.column(0), size, float), np.ones((b.num_rows, 1))])
            total += m.T @ m
        if total[-1, -1]:
            yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "row": [np.sum(np.stack(pdf["row"].to_list()), axis=0)]})

    rows = vectors.select("v").mapInArrow(run, "i int, row array<double>").groupBy("i").applyInPandas(summed, "i int, row array<double>").collect()
    if not rows:
        return np.zeros(size), np.eye(size)
    m = np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])
    mean = m[-1, :-1] / m[-1, -1]
    return mean, np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))[1][:, ::-1].copy()


def rotate(v: np.ndarray, mean: np.ndarray, rotation: np.ndarray, leading: int) -> np.ndarray:
    """Leading coordinates and the norm of the rest."""
    p = (v - mean) @ rotation
    return np.hstack([p[:, :leading], np.sqrt((p[:, leading:] ** 2).sum(axis=1, keepdims=True))])


def rotated(vectors: DataFrame, mean: np.ndarray, rotation: np.ndarray, leading: int = LEADING) -> DataFrame:
    """Adds p to vec_id and v."""
    size = len(mean)

    def run(batches):
        for b in batches:
            p = rotate(matrix(b.column(1), size, float), mean, rotation, leading).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(p.ravel(), leading + 1).cast(pa.list_(pa.float32()))], ["vec_id", "v", "p"])

    return vectors.mapInArrow(run, "vec_id long, v array<int>, p array<float>")


def nearest(v: np.ndarray, p: np.ndarray, centroids: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each vector, and how many exact distances that took."""
    n, rows = len(v), np.arange(len(v))
    bounds = np.sqrt(np.maximum(0, (p**2).sum(1)[:, None] + (turned**2).sum(1)[None, :] - 2 * p @ turned.T))
    # Rounding of p to 32 bits, and of the expanded square where it is small beside its parts.
    norms = np.sqrt((p**2).sum(1))[:, None] + np.sqrt((turned**2).sum(1))[None, :]
    bounds -= 1e-6 * norms + 1e-3
    cluster = bounds.argmin(1)
    distance = ((v - centroids[cluster]) ** 2).sum(1)
    exact = n
    for c in range(len(centroids)):
        at = rows[(bounds[:, c] <= np.sqrt(distance)) & (cluster != c)]
        d = ((v[at] - centroids[c]) ** 2).sum(1)
        better = (d < distance[at]) | (d == distance[at]) & (c < cluster[at])
        cluster[at[better]], distance[at[better]] = c, d[better]
        exact += len(at)
    return cluster, distance, exact


def first_centroids(kept: DataFrame, clusters: int, size: int) -> np.ndarray:
    by_hash = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in kept.orderBy(by_hash.asc_nulls_last(), "v").limit(clusters).collect()], np.int64).reshape(-1, size)


class Clusters:
    """Centroids with their rotation; ``assign`` and ``moved`` are one pass over the stored table each."""

    def __init__(self, kept: DataFrame, mean: np.ndarray, rotation: np.ndarray, centroids: np.ndarray, leading: int):
        self.kept, self.mean, self.rotation, self.centroids, self.leading = kept, mean, rotation, centroids, leading

    def _nearest(self):
        size, leading, centroids = len(self.mean), self.leading, self.centroids
        turned = rotate(centroids.astype(float), self.mean, self.rotation, leading)
        return lambda b: (v := matrix(b.column("v"), size), nearest(v, matrix(b.column("p"), leading + 1, float), centroids, turned))

    def moved(self) -> Clusters:
        """Non-empty centroids become the means of their vectors, rounded down."""
        find, k, size = self._nearest(), len(self.centroids), len(self.mean)

        def run(batches):
            sums = np.zeros((k, size + 1), np.int64)
            for b in batches:
                v, (cluster, _, _) = find(b)
                for c in range(k):
                    own = v[cluster == c]
                    sums[c, :size] += own.sum(0)
                    sums[c, size] += len(own)
            c, i = np.indices(sums.shape).reshape(2, -1)
            own = np.flatnonzero(sums[c, size])
            yield pa.RecordBatch.from_arrays([pa.array(c[own], pa.int32()), pa.array(i[own], pa.int32()), pa.array(sums.ravel()[own])], ["cluster", "i", "n"])

        totals = self.kept.select("v", "p").mapInArrow(run, "cluster int, i int, n long").groupBy("cluster", "i").agg(F.sum("n").alias("n")).collect()
        centroids, counts = self.centroids.copy(), {r["cluster"]: r["n"] for r in totals if r["i"] == size}
        for r in totals:
            if r["i"] < size:
                centroids[r["cluster"], r["i"]] = r["n"] // counts[r["cluster"]]
        return Clusters(self.kept, self.mean, self.rotation, centroids, self.leading)

    def assign(self) -> DataFrame:
        """vec_id, cluster, distance."""
        find = self._nearest()

        def run(batches):
            for b in filter(len, batches):
                _, (cluster, distance, _) = find(b)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

        return self.kept.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, leading: int = LEADING, size: int = SIZE) -> tuple[DataFrame, Clusters]:
    """Assignment of all vectors to the centroids after so many rounds, and these."""
    mean, rotation = axes(vectors, size)
    kept = keep(rotated(vectors, mean, rotation, leading), "rotated")
    found = Clusters(kept, mean, rotation, first_centroids(kept, clusters, size), leading)
    for _ in range(rounds if len(found.centroids) else 0):
        found = found.moved()
    return found.assign(), found


def op12_pca_filtered_kmeans(spark, sf_dir):
    found, last = cluster(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    found = keep(found, "clusters")
    # One row for each cluster at most.
    inertia = {r["cluster"]: int(r["n"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last.centroids.tolist()]
    by_cluster = lambda values: F.get(F.lit(values), F.col("cluster"))
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        by_cluster([inertia.get(c, 0) for c in range(len(names))] or [0]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        by_cluster(names or [""]).alias("centroid_sha256"),
    )


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> str:
    """The same rounds over all vectors and centroids, one common table each for assignment, means and centroids."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS INTEGER) AS c, v AS m FROM kept ORDER BY sha256('3:' || vec_id), v LIMIT {clusters})",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT r, min((d, c)) AS best FROM (SELECT r, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{i}) GROUP BY r)"""
        )
        if i < rounds:
            parts.append(
                f"""s{i} AS MATERIALIZED (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT best[2] AS c, unnest(v) AS x, unnest(range({size})) AS i FROM kept JOIN a{i} USING (r)) GROUP BY c, i)"""
            )
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(any_value(t.m), any_value(c{i}.m)) AS m FROM c{i} LEFT JOIN
  (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{i} GROUP BY c) t ON t.c = c{i}.c GROUP BY c{i}.c)"""
            )
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM (SELECT r, best[2] AS c, CAST(best[1] AS BIGINT) AS d FROM a{rounds}) JOIN kept USING (r) JOIN c{rounds} USING (c)"""


ORACLE_SQL = oracle_sql()
