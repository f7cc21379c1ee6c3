"""Product quantization: codebooks, codes, table-based distances, and an inverted file of residual codes.

A codebook is an array (M, K, D/M). Codes are array<int> columns; compact codes are binary, one byte a subvector if
K <= 256 and two little-endian ones otherwise. The lowest code wins ties.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.config import KMeansConfig, PqConfig
from quillon.errors import InsufficientSamples, InvalidQuery
from quillon.functions.vectors import Metric, distance, l2_squared
from quillon.operators import kmeans
from quillon.operators.knn import _BLOCK, PLACES, QUERY_BYTES, Best, _asked, _chunks, _scanned, distances, id_array, literal, matrix, ranked, rerank
from quillon.sources.storage import Storage


@dataclass
class Codebook:
    centers: np.ndarray

    @property
    def subvectors(self) -> int:
        return self.centers.shape[0]

    @property
    def codes(self) -> int:
        return self.centers.shape[1]

    @property
    def dimension(self) -> int:
        return self.centers.shape[0] * self.centers.shape[2]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        parts = vectors.reshape(len(vectors), self.subvectors, -1)
        return np.stack([kmeans.nearest(parts[:, m], self.centers[m])[0] for m in range(self.subvectors)], 1) if len(vectors) else np.zeros((0, self.subvectors), np.int64)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        if len(codes) and (codes.min() < 0 or codes.max() >= self.codes):
            raise InvalidQuery("a code is out of range")
        return self.centers[np.arange(self.subvectors)[None, :], codes].reshape(len(codes), -1)

    def table(self, query: np.ndarray) -> np.ndarray:
        """(M, K): the squared distance of each subvector of query to each centroid."""
        return ((query.reshape(self.subvectors, 1, -1) - self.centers) ** 2).sum(2)

    def to_dataframe(self, spark) -> DataFrame:
        rows = [(m, k, self.centers[m, k].tolist()) for m in range(self.subvectors) for k in range(self.codes)]
        return spark.createDataFrame(rows, "m int, k int, centroid array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        """As a table (m, k, centroid), on any store."""
        self.to_dataframe(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Codebook":
        rows = spark.read.parquet(path).orderBy("m", "k").collect()
        m = rows[-1]["m"] + 1
        return Codebook(np.array([r["centroid"] for r in rows]).reshape(m, len(rows) // m, -1))


def _summed(source: DataFrame, held: np.ndarray | tuple, size: int, kernel: Callable) -> np.ndarray:
    """The sum over all batches of kernel(held, vectors), arrays of size numbers, added up in every task before they move."""
    value = source.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += kernel(value.value, matrix(batch.column(0)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "x"])

    found = source.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # size rows at most
    out = np.zeros(size)
    out[found.column("at").to_numpy()] = found.column("x").to_numpy()
    return out


def _totals(centers: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The members' sum of each centroid of each subspace, then their numbers."""
    m, k, size = centers.shape
    parts = vectors.reshape(len(vectors), m, size)
    total, n = np.zeros((m, k, size)), np.zeros((m, k))
    for i in range(m):
        cluster, _ = kmeans.nearest(parts[:, i], centers[i])
        np.add.at(total[i], cluster, parts[:, i])
        n[i] = np.bincount(cluster, minlength=k)
    return np.concatenate([total.ravel(), n.ravel()])


def _rounds(source: DataFrame, sample: np.ndarray, whole: bool, centers: np.ndarray, iterations: int, tolerance: float, made: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """centers after Lloyd rounds in all subspaces at once, over sample if that is whole and else over the table; they are of
    what made makes of the vectors."""
    kernel = _totals if made is None else lambda c, v: _totals(c, made(v))
    for _ in range(iterations):
        sums = kernel(centers, sample) if whole else _summed(source, centers, centers.size + centers.shape[0] * centers.shape[1], kernel)
        total, n = sums[: centers.size].reshape(centers.shape), sums[centers.size :].reshape(centers.shape[:2])
        old, centers = centers, np.where(n[:, :, None] > 0, total / np.maximum(n, 1)[:, :, None], centers)
        if all(kmeans.settled(a, b, tolerance) for a, b in zip(old, centers)):
            break
    return centers


def _begin(vectors: DataFrame, config: PqConfig, made: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[DataFrame, np.ndarray, bool, np.ndarray]:
    """(source, sample, whether that is all, initial centroids (M, K, D/M), of what made makes of the sample)."""
    source = vectors.where("vector IS NOT NULL").select("vector")
    sample, whole = kmeans.initial(source, config.centroids, config.seed)
    config.validate(sample.shape[1] if len(sample) else config.subvectors)
    if len(sample) < config.centroids:
        raise InsufficientSamples(config.centroids, len(sample))
    parts = (made(sample) if made else sample).reshape(len(sample), config.subvectors, -1)
    return source, sample, whole, np.stack([kmeans.plus_plus(parts[:, m], config.centroids, config.seed + m) for m in range(config.subvectors)])


def train(vectors: DataFrame, config: PqConfig = PqConfig(), init: np.ndarray | None = None, made: Callable[[np.ndarray], np.ndarray] | None = None) -> Codebook:
    """A codebook of all vectors, or of what made makes of a matrix of them: Lloyd rounds in all subspaces at once, each a pass
    over the table.

    Initial centroids are drawn by squared distance from some rows if not given. Fewer vectors than centroids are an
    error.
    """
    if init is None:
        source, sample, whole, init = _begin(vectors, config, made)
    else:
        source, sample, whole = vectors.where("vector IS NOT NULL").select("vector"), np.zeros((0, 0)), False
        config.validate(init.shape[0] * init.shape[2])
    return Codebook(_rounds(source, sample, whole, np.array(init, np.float64), config.max_iterations, config.tolerance, made))


def _mapped(df: DataFrame, kernel, columns: list[T.StructField], held) -> DataFrame:
    """df with the columns that kernel(broadcast value, batch) gives."""
    schema = T.StructType([*df.schema, *columns])
    value = df.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *kernel(value.value, batch)], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), kind))


def encode(vectors: DataFrame, codebook: Codebook) -> DataFrame:
    """vectors with codes; rows with a null vector go."""
    return _mapped(vectors.where("vector IS NOT NULL"), lambda c, b: [_lists(c.encode(matrix(b.column("vector"))) if b.num_rows else np.zeros((0, c.subvectors), np.int64), pa.int32())], [T.StructField("codes", T.ArrayType(T.IntegerType()))], codebook)


def decode(encoded: DataFrame, codebook: Codebook) -> DataFrame:
    """encoded (…, codes) with decoded."""
    return _mapped(encoded, lambda c, b: [_lists(c.decode(matrix(b.column("codes")).astype(np.int64).reshape(-1, c.subvectors)), pa.float64())], [T.StructField("decoded", T.ArrayType(T.DoubleType()))], codebook)


def compact(codes: Column | str, centroids: int) -> Column:
    """Codes as bytes, within the JVM."""
    wide = 2 if centroids <= 256 else 4
    part = lambda c: F.lpad(F.hex(c), wide, "0")
    swapped = part if wide == 2 else lambda c: F.concat(F.substring(part(c), 3, 2), F.substring(part(c), 1, 2))
    return F.unhex(F.array_join(F.transform(codes, swapped), ""))


def expand(packed: Column | str, centroids: int) -> Column:
    """The codes that compact() packed."""
    text = F.hex(packed)
    wide = 2 if centroids <= 256 else 4
    n = (F.length(text) / wide).cast("int")

    def code(i: Column) -> Column:
        at = i * wide + 1
        part = F.substring(text, at, F.lit(wide)) if wide == 2 else F.concat(F.substring(text, at + 2, F.lit(2)), F.substring(text, at, F.lit(2)))
        return F.conv(part, 16, 10).cast("int")

    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), code))


def reconstruction_error(decoded: DataFrame) -> DataFrame:
    """(error): the mean squared distance of vector and decoded."""
    return decoded.select(l2_squared("vector", "decoded").alias("e")).agg(F.round(F.avg("e"), PLACES).alias("error"))


def distance_table(codebook: DataFrame, query: list[float], size: int) -> DataFrame:
    """(m, k, distance) of (m, k, centroid)."""
    part = F.slice(literal(query), F.col("m") * size + 1, F.lit(size))
    return codebook.select("m", "k", F.round(l2_squared(part, "centroid"), PLACES).alias("distance"))


def table_distance(codes: Column | str, table: np.ndarray) -> Column:
    """The sum of the table's entries of codes, within the JVM: the table is a literal of M x K numbers."""
    m, k = table.shape
    flat = F.array(*[F.lit(float(x)) for x in table.ravel()])
    places = F.transform(codes, lambda c, i: F.element_at(flat, (i * k + c + 1).cast("int")))
    return F.aggregate(places, F.lit(0.0), lambda s, x: s + x)


def search(encoded: DataFrame, codebook: Codebook, query: list[float], k: int) -> DataFrame:
    """(id, distance): the k nearest of (id, codes) by table; distances are squared L2 to the decoded vectors."""
    table = codebook.table(np.asarray(query, np.float64))
    found = _looked_up(encoded.where("codes IS NOT NULL").select("id", "codes"), {None: table[None]}, k)
    return found.select("id", "distance").orderBy("distance", "id").limit(k)


def search_refined(encoded: DataFrame, vectors: DataFrame, codebook: Codebook, query: list[float], k: int, factor: int, metric: str | Metric = "l2") -> DataFrame:
    """search() for k * factor candidates, those ranked by exact distance."""
    return rerank(search(encoded, codebook, query, k * factor), vectors, query, k, metric)


def batch_search(encoded: DataFrame, codebook: Codebook, queries: DataFrame, k: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, id, distance, rank) for (query_id, vector).

    The sum of a query's table entries is its squared distance to the decoded vector, so a task decodes a batch of codes once
    and takes matrix products with all queries, which go to the tasks in chunks of a checked size.
    """
    source = encoded.where("codes IS NOT NULL").select("id", F.col("codes").alias("vector"))
    asked = [_asked(c) for c in _chunks(queries.where("vector IS NOT NULL").select("query_id", "vector"), query_bytes)]
    found = _scanned(source, asked, k, Metric.L2, False, queries, lambda codes: codebook.decode(codes.astype(np.int64)))
    return ranked(found, k)


def batch_search_refined(encoded: DataFrame, vectors: DataFrame, codebook: Codebook, queries: DataFrame, k: int, factor: int, metric: str | Metric = "l2") -> DataFrame:
    """(query_id, id, distance, rank): batch_search() for k * factor candidates of each query, those ranked exactly."""
    near = batch_search(encoded, codebook, queries, k * factor).select("query_id", "id")
    both = near.join(vectors.select("id", "vector"), "id").join(queries.select("query_id", F.col("vector").alias("query")), "query_id")
    return ranked(both.select("query_id", "id", F.round(distance("vector", "query", metric), PLACES).alias("distance")), k)


def enough_candidates(encoded: DataFrame, codebook: Codebook, queries: DataFrame, truth: DataFrame, k: int, least: int, share: float) -> int:
    """The factor, least or doubled from it, with which batch_search_refined() finds that share of truth (query_id, id): the true
    neighbours of queries (query_id, vector), which are few. With all vectors as candidates it finds all."""
    pair, n = truth.select("query_id", "id"), encoded.count()
    wanted = F.broadcast(encoded.sparkSession.createDataFrame(pair.collect(), pair.schema))  # k rows a query
    most, factor = wanted.count(), least
    while k * factor < n and batch_search(encoded, codebook, queries, k * factor).join(wanted, ["query_id", "id"], "left_semi").count() < share * most:
        factor *= 2
    return factor


def _looked_up(source: DataFrame, tables: dict[int | None, np.ndarray], k: int, query_ids: pa.Array | None = None, kind: T.DataType = T.LongType()) -> DataFrame:
    """(query_id, id, distance): every task's k nearest of each query. tables are (queries, M, K) by cluster, or one for all."""
    n = next(iter(tables.values())).shape[0]
    names = query_ids if query_ids is not None else pa.array(np.zeros(n, np.int64))
    held = source.sparkSession.sparkContext.broadcast((tables, names))
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", source.schema["id"].dataType), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, names = held.value
        best, kind, every = Best(len(names), k), None, np.arange(len(names))
        for batch in batches:
            kind = batch.schema.field("id").type
            if not batch.num_rows or not len(names):
                continue
            codes, ids = matrix(batch.column("codes")).astype(np.int64), id_array(batch.column("id"))
            if None in tables:
                groups = [(None, np.arange(len(ids)))]
            else:
                cluster = batch.column("cluster_id").to_numpy()
                groups = [(c, np.flatnonzero(cluster == c)) for c in tables]
            for c, at in groups:
                step = max(1, _BLOCK // max(1, len(at)))
                for a in range(0, len(every) if len(at) else 0, step):
                    t = tables[c][a : a + step]
                    d = np.zeros((len(t), len(at)))
                    for m in range(codes.shape[1]):
                        d += t[:, m][:, codes[at, m]]
                    best.add(every[a : a + step], d, ids[at])
        if kind is not None:
            slot, d, ids = best.rows()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(slot)), pa.array(ids, kind), pa.array(d)], names=["query_id", "id", "distance"])

    return source.mapInArrow(run, schema)


def encode_with_progress(vectors: DataFrame, codebook: Codebook, report: Callable[[int], None], every: float = 1.0) -> DataFrame:
    """encode(), with an accumulator of the rows that tasks have encoded; report gets it about every so many seconds while an
    action runs on the result within progress(). Tasks that are run again count again."""
    spark = vectors.sparkSession
    done = spark.sparkContext.accumulator(0)

    def kernel(held: Codebook, batch: pa.RecordBatch) -> list[pa.Array]:
        done.add(batch.num_rows)
        return [_lists(held.encode(matrix(batch.column("vector"))) if batch.num_rows else np.zeros((0, held.subvectors), np.int64), pa.int32())]

    out = _mapped(vectors.where("vector IS NOT NULL"), kernel, [T.StructField("codes", T.ArrayType(T.IntegerType()))], codebook)
    out.progress = Progress(lambda: done.value, report, every)
    return out


class Progress:
    """with df.progress: an action on df; report is called while it runs and once after it."""

    def __init__(self, value: Callable[[], int], report: Callable[[int], None], every: float):
        self.value, self.report, self.every = value, report, every

    def __enter__(self) -> "Progress":
        self.over = threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()
        return self

    def _run(self) -> None:
        while not self.over.wait(self.every):
            self.report(self.value())

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()
        self.report(self.value())


@dataclass
class IvfPq:
    """An inverted file of codes: coarse centroids, a codebook of residuals (or of vectors), and (id, cluster_id, codes[, vector])."""

    centers: np.ndarray
    codebook: Codebook
    codes: DataFrame
    config: PqConfig
    metric: Metric

    @staticmethod
    def build(vectors: DataFrame, num_clusters: int = 100, config: PqConfig = PqConfig(), metric: str | Metric = "l2", keep_vectors: bool = True, centers: np.ndarray | None = None, codebook: Codebook | None = None) -> "IvfPq":
        metric = Metric.parse(metric)
        if metric is Metric.COSINE and not keep_vectors:
            raise InvalidQuery("under cosine the exact distances of kept vectors are needed")
        if centers is None:
            centers = kmeans.fit(vectors, KMeansConfig(num_clusters=num_clusters, seed=config.seed))
        # a chain of Python steps holds a worker each in every task: what is made of a vector is made in one of them
        made = (lambda v: v - centers[kmeans.nearest(v, centers)[0]]) if config.residual else None
        if codebook is None:
            codebook = train(vectors, config, made=made)
        coded = _coded(vectors.where("vector IS NOT NULL").select("id", "vector"), centers, codebook, config.residual)
        return IvfPq(centers, codebook, coded.select("id", "cluster_id", "codes", *["vector"] * keep_vectors), config, metric)

    def search(self, query: list[float], k: int, nprobe: int = 10) -> DataFrame:
        """(id, distance): by tables within the nprobe nearest clusters, then exactly among refine_candidates if vectors are kept."""
        q = np.asarray(query, np.float64)
        d = np.round(distances(q[None, :], self.centers, self.metric)[0], PLACES)
        probes = np.lexsort((np.arange(len(d)), d))[:nprobe].tolist()
        # a table of its own for each probed cluster
        tables = {int(c): self.codebook.table(q - self.centers[c] if self.config.residual else q)[None] for c in probes}
        exact = "vector" in self.codes.columns and self.config.refine_candidates > 0
        n = max(k, self.config.refine_candidates) if exact else k
        inside = self.codes.where(F.col("cluster_id").isin(probes)).select("id", "cluster_id", "codes")
        near = _looked_up(inside, tables, n).select("id", "distance").orderBy("distance", "id").limit(n)
        return rerank(near, self.codes, query, k, self.metric) if exact else near

    def save(self, spark: SparkSession, path: str) -> None:
        """The codes sorted by cluster, so that a search reads few row groups, beside centroids, codebook and settings."""
        self.codes.repartitionByRange("cluster_id").sortWithinPartitions("cluster_id", "id").write.mode("overwrite").parquet(f"{path}/codes")
        self.codebook.save(spark, f"{path}/codebook")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centers)], "cluster_id int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        Storage(spark).write(f"{path}/config.json", json.dumps(asdict(self.config) | {"metric": self.metric.value}))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IvfPq":
        held = json.loads(Storage(spark).read(f"{path}/config.json"))
        metric = Metric.parse(held.pop("metric"))
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cluster_id").collect()
        return IvfPq(np.array([r["centroid"] for r in rows]), Codebook.load(spark, f"{path}/codebook"), spark.read.parquet(f"{path}/codes"), PqConfig(**held), metric)

    def stats(self) -> DataFrame:
        """(vectors, clusters, original_bytes, compressed_bytes, ratio)."""
        return pq_stats(self.codes, self.codebook.dimension, self.codebook.subvectors)


def pq_stats(codes: DataFrame, dimension: int, subvectors: int) -> DataFrame:
    n = codes.agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("cluster_id").alias("clusters"))
    original, compressed = F.col("vectors") * dimension * 4, F.col("vectors") * subvectors * 2
    return n.select("vectors", "clusters", original.alias("original_bytes"), compressed.alias("compressed_bytes"), F.round(original / compressed, 6).alias("ratio"))


def _coded(vectors: DataFrame, centers: np.ndarray, codebook: Codebook, residual: bool) -> DataFrame:
    """vectors with cluster_id and codes, of the residual or of the vector."""

    def kernel(held: tuple[np.ndarray, Codebook], batch: pa.RecordBatch) -> list[pa.Array]:
        centers, book = held
        if not batch.num_rows:
            return [pa.array([], pa.int32()), pa.array([], pa.list_(pa.int32()))]
        v = matrix(batch.column("vector"))
        cluster = kmeans.nearest(v, centers)[0]
        return [pa.array(cluster.astype(np.int32)), _lists(book.encode(v - centers[cluster] if residual else v), pa.int32())]

    return _mapped(vectors, kernel, [T.StructField("cluster_id", T.IntegerType()), T.StructField("codes", T.ArrayType(T.IntegerType()))], (centers, codebook))


@dataclass
class Rotated:
    """A rotation learnt with its codebook: codes are of the rotated vectors."""

    rotation: np.ndarray
    codebook: Codebook

    def save(self, spark: SparkSession, path: str) -> None:
        self.codebook.save(spark, f"{path}/codebook")
        spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(self.rotation)], "i int, row array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/rotation")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Rotated":
        rows = spark.read.parquet(f"{path}/rotation").orderBy("i").collect()
        return Rotated(np.array([r["row"] for r in rows]), Codebook.load(spark, f"{path}/codebook"))

    def rotate(self, vectors: DataFrame) -> DataFrame:
        return rotate(vectors, self.rotation)

    def encode(self, vectors: DataFrame) -> DataFrame:
        return encode(self.rotate(vectors), self.codebook)

    def decode(self, encoded: DataFrame) -> DataFrame:
        """encoded with decoded, in the original axes."""
        back = decode(encoded.drop("vector"), self.codebook).withColumnRenamed("decoded", "vector")
        return rotate(back, self.rotation.T).withColumnRenamed("vector", "decoded")


def rotate(vectors: DataFrame, rotation: np.ndarray) -> DataFrame:
    """vectors with every vector multiplied by rotation; its transpose takes them back."""
    others = [c for c in vectors.columns if c != "vector"]
    old = vectors.where("vector IS NOT NULL").select(*others, F.col("vector").cast("array<double>").alias("vector"))
    held = vectors.sparkSession.sparkContext.broadcast(rotation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(matrix(batch.columns[-1]) @ held.value.T, pa.float64())], names=batch.schema.names)

    return old.mapInArrow(run, old.schema)


def train_rotated(vectors: DataFrame, config: PqConfig = PqConfig()) -> Rotated:
    """Alternates codebook and rotation (orthogonal Procrustes by singular values) over all vectors; the best pair stays.

    A rotation needs the sum of products of decoded and given vectors, a matrix as wide as a vector: one pass.
    """
    source, sample, whole, centers = _begin(vectors, config)
    size = sample.shape[1]
    rotation, best = np.eye(size), None

    def products(held: tuple[np.ndarray, np.ndarray], v: np.ndarray) -> np.ndarray:
        rotation, centers = held
        turned, book = v @ rotation.T, Codebook(centers)
        decoded = book.decode(book.encode(turned))
        return np.concatenate([(decoded.T @ v).ravel(), [((turned - decoded) ** 2).sum(), len(v)]])

    for i in range(max(1, config.opq_iterations)):
        centers = _rounds(source, sample, whole, centers, 3 if i else config.max_iterations, config.tolerance, lambda v, turn=rotation: v @ turn.T)
        held = rotation, centers
        sums = products(held, sample) if whole else _summed(source, held, size * size + 2, products)
        error = sums[-2] / sums[-1]
        if best is None or error < best[0]:
            best = error, Rotated(rotation, Codebook(centers))
        u, _, vt = np.linalg.svd(sums[:-2].reshape(size, size))
        rotation = u @ vt
    return best[1]
