"""k-means over a table (id, vector): squared L2, the lowest cluster wins ties, an empty cluster keeps its centroid.

A Lloyd round is one pass over the vectors: every task sums the members of each cluster, and k sums a task are shuffled.
The centroids, k rows of one vector each, are what goes to every task; they don't grow with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.config import KMeansConfig
from quillon.functions.vectors import centroids, l2_squared
from quillon.operators.knn import PLACES, matrix

#: Vectors that the initial centroids are drawn from, or four times as many as there are clusters.
INIT_SAMPLE = 20_000
#: Distances that nearest() holds at once.
_DISTANCES = 1 << 20
#: Vectors a row of a packed table.
_PACKED = 1 << 11


def optimal_clusters(n: int, configured: int) -> int:
    return min(max(math.isqrt(n), configured), n)


def nearest(vectors: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector; the first of equal ones after rounding."""
    cluster, best = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    own = (centers * centers).sum(1)
    step = max(1, _DISTANCES // max(1, len(centers)))
    for a in range(0, len(vectors), step):
        v = vectors[a : a + step]
        d = np.maximum((v * v).sum(1)[:, None] + own[None, :] - 2 * (v @ centers.T), 0)
        at = np.round(d, PLACES).argmin(1)
        cluster[a : a + step], best[a : a + step] = at, d[np.arange(len(v)), at]
    return cluster, best


def plus_plus(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k initial centroids by squared-distance sampling; uniform where all remaining distances are 0."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(sample)))]
    d = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = d.sum()
        i = int(rng.choice(len(sample), p=d / total)) if total > 0 else int(rng.integers(len(sample)))
        chosen.append(i)
        d = np.minimum(d, ((sample - sample[i]) ** 2).sum(1))
    return sample[chosen]


def assign(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """vectors with cluster_id, by Arrow batches; rows with a null vector go."""
    held = vectors.sparkSession.sparkContext.broadcast(centers)
    schema = T.StructType([*vectors.schema, T.StructField("cluster_id", T.IntegerType())])
    at = vectors.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = nearest(matrix(batch.column(at)), held.value)[0] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster.astype(np.int32))], names=[*batch.schema.names, "cluster_id"])

    return vectors.where("vector IS NOT NULL").mapInArrow(run, schema)


def assign_by_plan(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """(id, cluster_id) as assign() gives it, in one Catalyst plan; centers (cluster_id, centroid) must be few."""
    pairs = vectors.select("id", "vector").crossJoin(F.broadcast(centers))
    d = F.round(l2_squared("vector", "centroid"), PLACES)
    return pairs.groupBy("id").agg(F.min(F.struct(d.alias("d"), F.col("cluster_id"))).alias("x")).select("id", F.col("x.cluster_id").alias("cluster_id"))


def update(assigned: DataFrame) -> DataFrame:
    """(cluster_id, centroid): the means of (cluster_id, vector)."""
    return centroids(assigned, ["cluster_id"])


def members(assigned: DataFrame, size: int = 100_000) -> DataFrame:
    """(cluster_id, part, members, n): the ids of each cluster in order, size of them a row at most."""
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("id")) - 1
    parted = assigned.select("cluster_id", "id").withColumn("part", F.floor(place / size).cast("int"))
    return parted.groupBy("cluster_id", "part").agg(F.array_sort(F.collect_list("id")).alias("members"), F.count(F.lit(1)).alias("n"))


def _pack(vectors: DataFrame) -> DataFrame:
    """(size, data): the vectors of (vector) as bytes, many a row, so that a pass over them takes nothing apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _PACKED):
                v = matrix(batch.column(0).slice(a, _PACKED))
                yield pa.RecordBatch.from_arrays([pa.array([v.shape[1]], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["size", "data"])

    return vectors.where("vector IS NOT NULL").select("vector").mapInArrow(run, "size int, data binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for size, data in zip(batch.column(0).to_pylist(), batch.column(1)):
        yield np.frombuffer(data.as_buffer(), np.float64).reshape(-1, size)


def lloyd_round(vectors: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new centroids, members of each) after one pass."""
    return _round(vectors.where("vector IS NOT NULL").select("vector"), centers, lambda batch: [matrix(batch.column(0))] if batch.num_rows else [])


def _round(source: DataFrame, centers: np.ndarray, parts: Callable[[pa.RecordBatch], Iterable[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """lloyd_round() of a table whose batches parts takes to matrices. The tasks' sums are added in the order of the tasks, so
    that equal members have equal centroids in every round."""
    held = source.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(held.value), np.zeros(len(held.value), np.int64)
        for batch in batches:
            for v in parts(batch):
                cluster = nearest(v, held.value)[0]
                order = np.argsort(cluster, kind="stable")
                some, begin = np.unique(cluster[order], return_index=True)
                total[some] += np.add.reduceat(v[order], begin, axis=0)
                n += np.bincount(cluster, minlength=len(n))
        some = np.flatnonzero(n)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * total.shape[1], pa.int32()), pa.array(total[some].ravel()))
        task = pa.array(np.full(len(some), TaskContext.get().partitionId()), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(some), task, pa.array(n[some]), values], names=["cluster_id", "task", "n", "total"])

    sums = source.mapInArrow(run, "cluster_id long, task int, n long, total array<double>")
    ordered = F.array_sort(F.collect_list(F.struct("task", "total")))
    zeros = F.array_repeat(F.lit(0.0), centers.shape[1])
    added = F.aggregate(ordered, zeros, lambda s, x: F.zip_with(s, x["total"], lambda a, b: a + b))
    found = sums.groupBy("cluster_id").agg(F.sum("n").alias("n"), added.alias("total")).toArrow()  # k vectors
    out, n = centers.copy(), np.zeros(len(centers), np.int64)
    if found.num_rows:
        at = found.column("cluster_id").to_numpy()
        n[at] = found.column("n").to_numpy()
        out[at] = matrix(found.column("total")) / n[at, None]
    return out, n


def initial(vectors: DataFrame, k: int, seed: int) -> tuple[np.ndarray, bool]:
    """(rows of vectors (vector), whether these are all): those of least hash, so they are the same in every run."""
    most = max(INIT_SAMPLE, 4 * k)
    some = vectors.orderBy(F.xxhash64(F.lit(seed), "vector")).limit(most + 1).toArrow()
    return matrix(some.column("vector"))[:most], some.num_rows <= most


def settled(old: np.ndarray, new: np.ndarray, tolerance: float) -> bool:
    """No centroid has moved by more than tolerance of the root of their mean squared norm."""
    moved = ((new - old) ** 2).sum(-1).max(initial=0)
    return moved <= tolerance**2 * max(1e-12, float((new * new).sum(-1).mean()) if new.size else 0)


def fit(vectors: DataFrame, config: KMeansConfig = KMeansConfig(), init: np.ndarray | None = None) -> np.ndarray:
    """Centroids after Lloyd rounds over all vectors; the initial ones are drawn by squared distance if not given.

    Rounds end when no centroid moves by more than tolerance, or after max_iterations. They are the same computation
    wherever they run: in place, where the vectors are no more than the initial centroids are drawn from, or else as a
    pass over the table each. Fewer vectors than clusters give as many clusters as vectors; no vectors give none.
    """
    source = vectors.where("vector IS NOT NULL").select("vector")
    if init is None:
        sample, whole = initial(source, config.num_clusters, config.seed)
        if not len(sample):
            return np.zeros((0, 0))
        if whole:
            return fit_local(sample, config.num_clusters, config.max_iterations, config.seed, tolerance=config.tolerance)
        init = plus_plus(sample, config.num_clusters, config.seed)
    centers = np.array(init, np.float64)
    packed = _pack(source).persist(StorageLevel.MEMORY_AND_DISK)  # read from the table once, not in every round
    try:
        for _ in range(config.max_iterations):
            old = centers
            centers, _ = _round(packed, old, _unpacked)
            if settled(old, centers, config.tolerance):
                break
    finally:
        packed.unpersist()
    return centers


def fit_local(sample: np.ndarray, k: int, iterations: int, seed: int, init: np.ndarray | None = None, tolerance: float = KMeansConfig.tolerance) -> np.ndarray:
    """The same rounds over a matrix that one task holds."""
    k = min(k, len(sample))
    centers = plus_plus(sample, k, seed) if init is None else np.array(init, np.float64)
    for _ in range(iterations):
        cluster, _ = nearest(sample, centers)
        n = np.bincount(cluster, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, cluster, sample)
        old, centers = centers, np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
        if settled(old, centers, tolerance):
            break
    return centers


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    """(cluster_id, n) of assigned (cluster_id, ...)."""
    return assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def size_stats(assigned: DataFrame) -> DataFrame:
    """(clusters, least, most, mean) of the sizes of the clusters that have members."""
    return cluster_sizes(assigned).agg(F.count(F.lit(1)).alias("clusters"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), PLACES).alias("mean"))
