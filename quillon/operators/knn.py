"""Nearest-neighbour search: one query as a Catalyst plan, batches of queries as Arrow kernels, pruning by cluster and segment.

Distances are rounded to PLACES before ranking, ties go to the lower id, and squared distances are told for L2. Corpora
are tables (id, vector, ...); batches of queries are tables (query_id, vector).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.errors import DimensionMismatch, InvalidQuery
from quillon.functions.vectors import Metric, distance

PLACES = 6
#: Queries that are sent to every task at once; a larger batch goes in several passes over the corpus.
QUERY_BYTES = 16 << 20
#: Distances that a task holds at once.
_BLOCK = 1 << 20


def literal(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def check_dimension(df: DataFrame, dimension: int, vector: str = "vector") -> None:
    """Raises DimensionMismatch if any vector of df has another size."""
    other = df.where(F.size(vector) != dimension).select(F.size(vector)).head(1)
    if other:
        raise DimensionMismatch(dimension, other[0][0])


def search(corpus: DataFrame, query: list[float], k: int, metric: str | Metric = "l2", id_col: str = "id", vector: str = "vector", keep: list[str] | None = None) -> DataFrame:
    """(id, distance, keep...) of the k nearest; a partial top-k in every task, then one over theirs."""
    if k < 0:
        raise InvalidQuery("k must not be negative")
    d = F.round(distance(vector, literal(query), metric), PLACES)
    found = corpus.where(F.col(vector).isNotNull()).select(id_col, d.alias("distance"), *(keep or []))
    return found.orderBy("distance", id_col).limit(k)


def merge(parts: list[DataFrame], k: int, id_col: str = "id") -> DataFrame:
    """The k nearest of several results, repeated ids as they are."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("distance", id_col).limit(k)


def ranked(found: DataFrame, k: int, by: str = "query_id", id_col: str = "id") -> DataFrame:
    """found with rank (from 1) within each query, cut to k."""
    w = Window.partitionBy(by).orderBy("distance", id_col)
    return found.drop("turn").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of floats, all of one size and none null, as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def distances(queries: np.ndarray, vectors: np.ndarray, metric: Metric) -> np.ndarray:
    """queries x vectors, as in functions.vectors.distance()."""
    products = queries @ vectors.T
    if metric is Metric.COSINE:
        norms = np.sqrt((queries * queries).sum(1))[:, None] * np.sqrt((vectors * vectors).sum(1))[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - np.where(norms == 0, 0.0, products / norms)
    return np.maximum((queries * queries).sum(1)[:, None] + (vectors * vectors).sum(1)[None, :] - 2 * products, 0)


def local_top(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each row of d the places of the k least by (rounded distance, id)."""
    order = np.argsort(ids, kind="stable")
    return order[np.argsort(np.round(d, PLACES)[:, order], axis=1, kind="stable")[:, :k]]


class Best:
    """The k least (rounded distance, id) of each of many slots, over blocks of distances as they come."""

    def __init__(self, slots: int, k: int):
        self.slots, self.k = slots, k
        self.bound = np.full(slots, np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, slots: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        """d has a row for each of slots and a column for each of ids; infinite distances count for nothing."""
        d = np.round(d, PLACES)
        bound = self.bound[slots]
        if d.shape[1] > self.k > 0:
            bound = np.minimum(bound, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
        row, column = np.nonzero((d <= bound[:, None]) & (d < np.inf))
        if len(row):
            self.parts.append((slots[row], d[row, column], ids[column]))
            self.held += len(row)
            if self.held > 4 * self.slots * self.k + (1 << 18):
                self._close()

    def _close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, d, ids = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        rank = ids if ids.dtype.kind in "iuf" else np.unique(ids.astype(str), return_inverse=True)[1]
        order = np.lexsort((rank, d, slot))
        slot, d, ids = slot[order], d[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(slot)))
        place = np.arange(len(slot)) - np.repeat(first, size)
        kept = place < self.k
        last = place == self.k - 1
        self.bound[slot[last]] = d[last]
        self.parts, self.held = [(slot[kept], d[kept], ids[kept])], int(kept.sum())
        return self.parts[0]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, distance, id), slots in order, nearest first."""
        slot, d, ids = self._close()
        return slot, d + 0.0, ids


def id_array(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else np.array(column.to_pylist(), dtype=object)


def _chunks(queries: DataFrame, limit: int) -> list[DataFrame]:
    """queries as tables that hold about limit bytes each."""
    total = queries.agg(F.sum(F.size("vector") * 8)).first()[0] or 0
    n = max(1, -(-int(total) // limit))
    part = F.pmod(F.xxhash64("query_id"), F.lit(n))
    return [queries] if n == 1 else [queries.where(part == i) for i in range(n)]


@dataclass
class Asked:
    """A chunk of queries as every task gets it. A slot is what has a top-k of its own: a query, or a query's turn.

    by_cluster has the queries and their slots that look at a cluster; it is None where all look at all vectors.
    """

    queries: np.ndarray
    query_ids: pa.Array
    turns: int = 1
    by_cluster: dict[int, tuple[np.ndarray, np.ndarray]] | None = None


def _asked(chunk: DataFrame, turns: Callable[[np.ndarray], np.ndarray] | None = None, n_turns: int = 1) -> Asked:
    """A chunk (query_id, vector[, probes]) on the driver; turns gives the turn of each place among the probes."""
    table = chunk.toArrow()
    out = Asked(matrix(table.column("vector")), table.column("query_id").combine_chunks(), n_turns)
    if "probes" in chunk.columns:
        probes = matrix(table.column("probes")).astype(np.int64)
        query = np.repeat(np.arange(len(probes)), probes.shape[1])
        turn = np.tile(turns(np.arange(probes.shape[1])) if turns else np.zeros(probes.shape[1], np.int64), len(probes))
        order = np.argsort(probes.ravel(), kind="stable")
        clusters, first = np.unique(probes.ravel()[order], return_index=True)
        parts = np.split(order, first[1:]) if len(order) else []
        out.by_cluster = {int(c): (query[p], query[p] * n_turns + turn[p]) for c, p in zip(clusters, parts)}
    return out


def batch_search(corpus: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2", exclude_self: bool = False, id_col: str = "id", vector: str = "vector", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest of every query, exactly.

    The queries go to the tasks in chunks of a checked size, the corpus stays where it is, every task keeps its own
    top-k by matrix products, and only those are shuffled. exclude_self leaves out the id that equals the query's.
    """
    source = corpus.where(F.col(vector).isNotNull()).select(corpus[id_col].alias("id"), corpus[vector].alias("vector"))
    asked = [_asked(c) for c in _chunks(queries.where("vector IS NOT NULL").select("query_id", "vector"), query_bytes)]
    return ranked(_scanned(source, asked, k, Metric.parse(metric), exclude_self, queries), k)


def _scanned(source: DataFrame, asked: list[Asked], k: int, metric: Metric, exclude_self: bool, queries: DataFrame, decode: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query_id, turn, id, distance): every task's top-k of each slot, of (id[, cluster_id], vector); decode makes vectors of
    what stands in their place."""
    schema = T.StructType([queries.schema["query_id"], T.StructField("turn", T.IntegerType()), T.StructField("id", source.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    found = None
    for chunk in asked:
        part = source.mapInArrow(_scan(source.sparkSession.sparkContext.broadcast(chunk), k, metric, exclude_self, decode), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _scan(held, k: int, metric: Metric, exclude_self: bool, decode: Callable[[np.ndarray], np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = held.value
        q = asked.queries
        if not len(q):
            return
        own = id_array(asked.query_ids)
        best, kind = Best(len(q) * asked.turns, k), None

        def look(query: np.ndarray, slot: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
            step = max(1, _BLOCK // len(vectors))
            for a in range(0, len(query), step):
                some = query[a : a + step]
                d = distances(q[some], vectors, metric)
                if exclude_self:
                    d[own[some, None] == ids[None, :]] = np.inf
                best.add(slot[a : a + step], d, ids)

        every = np.arange(len(q))
        for batch in batches:
            kind = batch.schema.field("id").type
            vectors = matrix(batch.column("vector"))
            if not len(vectors):
                continue
            vectors = decode(vectors) if decode else vectors
            if vectors.shape[1] != q.shape[1]:
                raise DimensionMismatch(q.shape[1], vectors.shape[1])
            ids = id_array(batch.column("id"))
            if asked.by_cluster is None:
                look(every, every, vectors, ids)
                continue
            cluster = batch.column("cluster_id").to_numpy(zero_copy_only=False)
            order = np.argsort(cluster, kind="stable")
            names, first = np.unique(cluster[order], return_index=True)
            for name, at in zip(names, np.split(order, first[1:])):
                if int(name) in asked.by_cluster:
                    look(*asked.by_cluster[int(name)], vectors[at], ids[at])
        if kind is not None:
            slot, d, ids = best.rows()
            yield pa.RecordBatch.from_arrays([asked.query_ids.take(pa.array(slot // asked.turns)), pa.array((slot % asked.turns).astype(np.int32)), pa.array(ids, kind), pa.array(d)], names=["query_id", "turn", "id", "distance"])

    return run


def probed(queries: DataFrame, centroids: DataFrame, nprobe: int, metric: str | Metric = "l2") -> DataFrame:
    """(query_id, vector, probes): the nprobe nearest clusters of each query, nearest first; more than there are is all.

    centroids (cluster_id, centroid), a vector for each cluster, go to every task.
    """
    metric = Metric.parse(metric)
    rows = centroids.select("cluster_id", "centroid").orderBy("cluster_id").collect()
    held = queries.sparkSession.sparkContext.broadcast((np.array([r["cluster_id"] for r in rows], np.int64), np.array([r["centroid"] for r in rows], np.float64)))
    source = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    schema = T.StructType([*source.schema, T.StructField("probes", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centers = held.value
        n = min(nprobe, len(names))
        for batch in batches:
            near = np.zeros((batch.num_rows, n), np.int64)
            if batch.num_rows and n:
                q = matrix(batch.column("vector"))
                step = max(1, _BLOCK // len(centers))
                for a in range(0, len(q), step):
                    near[a : a + step] = names[local_top(distances(q[a : a + step], centers, metric), names, n)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * n, pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def enough_probes(clustered: DataFrame, centroids: DataFrame, queries: DataFrame, truth: DataFrame, least: int, share: float, metric: str | Metric = "l2") -> int:
    """The probes, least or more, with which the clusters looked into hold that share of the true neighbours truth (query_id, id).

    queries (query_id, vector) are a few that truth was found for by batch_search(). All clusters hold all neighbours, so
    there is always such a number.
    """
    n = centroids.count()
    near = probed(queries, centroids, n, metric).select("query_id", F.posexplode("probes").alias("place", "cluster_id"))
    owned = F.broadcast(truth.select("query_id", "id")).join(clustered.select("id", "cluster_id"), "id")
    rows = owned.join(near, ["query_id", "cluster_id"]).groupBy("place").count().collect()  # a row a cluster
    found = np.zeros(max(1, n))
    for r in rows:
        found[r["place"]] = r["count"]
    enough = np.cumsum(found) >= share * found.sum()
    return max(least, int(enough.argmax()) + 1)


def nearest_clusters(centroids: DataFrame, query: list[float], nprobe: int, metric: str | Metric = "l2", by: list[str] | None = None) -> DataFrame:
    """The nprobe clusters whose centroids are nearest, of each group of by if given; nprobe beyond their number is all.

    centroids is (by..., cluster_id, centroid).
    """
    by = by or []
    d = F.round(distance("centroid", literal(query), metric), PLACES)
    found = centroids.select(*by, "cluster_id", d.alias("distance"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = w.orderBy("distance", "cluster_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= nprobe)


def ivf_search(clustered: DataFrame, centroids: DataFrame, query: list[float], k: int, nprobe: int, metric: str | Metric = "l2", by: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(id, distance, keep...) of the k nearest within the nprobe nearest clusters (of each group of by).

    The clusters are chosen on the driver, where they are nprobe rows a group, so that the scan of clustered gets them
    as literals and prunes partitions and row groups.
    """
    by = by or []
    chosen = nearest_clusters(centroids, query, nprobe, metric, by).select(*by, "cluster_id").collect()
    wanted: dict[tuple, list] = {}
    for r in chosen:
        wanted.setdefault(tuple(r[b] for b in by), []).append(r["cluster_id"])
    where = F.lit(False)
    for key, clusters in sorted(wanted.items()):
        here = F.col("cluster_id").isin(clusters)
        for b, v in zip(by, key):
            here = here & (F.col(b) == v)
        where = where | here
    return search(clustered.where(where), query, k, metric, keep=keep)


def batch_ivf_search(clustered: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int, metric: str | Metric = "l2", exclude_self: bool = False, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, id, distance, rank): every query against its own nprobe nearest clusters.

    clustered is (id, cluster_id, vector), centroids (cluster_id, centroid). As in batch_search() the queries, with their
    probes, go to the vectors: a task takes each cluster of a batch at once, with the queries that probe it.
    """
    asked = [_asked(c) for c in _chunks(probed(queries, centroids, nprobe, metric), query_bytes)]
    source = clustered.where("vector IS NOT NULL").select("id", "cluster_id", "vector")
    return ranked(_scanned(source, asked, k, Metric.parse(metric), exclude_self, queries), k)


def batch_by_turns(clustered: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, step: int, metric: str | Metric = "l2", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, turn, id, distance, rank): the k nearest of every query within each turn; turn t is the clusters that are
    nearest to it from place t * step on, step of them."""
    n = centroids.count()
    turns = max(1, -(-n // step))
    chunks = _chunks(probed(queries, centroids, n, metric), max(1, query_bytes // turns))
    asked = [_asked(c, lambda place: place // step, turns) for c in chunks]
    source = clustered.where("vector IS NOT NULL").select("id", "cluster_id", "vector")
    found = _scanned(source, asked, k, Metric.parse(metric), False, queries)
    w = Window.partitionBy("query_id", "turn").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def select_segments(router: DataFrame, query: list[float], top_m: int, metric: str | Metric = "l2") -> DataFrame:
    """(segment_id, distance) of the top_m segments by centroid; 0 is all of them. router: (segment_id, segment_centroid)."""
    d = F.round(distance("segment_centroid", literal(query), metric), PLACES)
    found = router.select("segment_id", d.alias("distance")).orderBy("distance", "segment_id")
    return found.limit(top_m) if top_m else found


def rerank(candidates: DataFrame, vectors: DataFrame, query: list[float], k: int, metric: str | Metric = "l2") -> DataFrame:
    """(id, distance) of candidates (id) by exact distance; ids without a vector go."""
    near = candidates.select("id").join(vectors.select("id", "vector"), "id")
    return search(near, query, k, metric)


def rerank_with_expansion(candidates: DataFrame, vectors: DataFrame, query: list[float], k: int, factor: int, metric: str | Metric = "l2") -> DataFrame:
    """rerank() of the first k * factor of candidates (id, distance)."""
    return rerank(candidates.orderBy("distance", "id").limit(k * factor), vectors, query, k, metric)


def rerank_unresolved_last(candidates: DataFrame, vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, distance): as rerank() under L2, but candidates without a vector come last with a null distance."""
    near = candidates.select("id").join(vectors.select("id", "vector"), "id", "left")
    d = F.round(distance("vector", literal(query), "l2"), PLACES)
    return near.select("id", d.alias("distance")).orderBy(F.col("distance").asc_nulls_last(), "id").limit(k)


def add_results(state: DataFrame, more: DataFrame, k: int) -> DataFrame:
    """(id, distance): state and more, an id once (the one in state first, then the nearest), the k nearest."""
    both = state.select("id", "distance", F.lit(0).alias("turn")).unionByName(more.select("id", "distance", F.lit(1).alias("turn")))
    first = both.groupBy("id").agg(F.min(F.struct("turn", "distance")).alias("x")).select("id", F.col("x.distance").alias("distance"))
    return first.orderBy("distance", "id").limit(k)
