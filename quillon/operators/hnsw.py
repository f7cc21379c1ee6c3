"""Navigable small-world graphs, one for each cluster: built and searched inside the task that holds the cluster.

A graph is sequential to build, so the unit of parallel work is the cluster; a cluster below min_cluster_size has no
graph and is searched by brute force. A built index is a table (cluster_id, part, ids, vectors, graph), a row for each
graph, of plain arrays; a search of many queries sends the queries to these rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.config import HnswConfig
from quillon.functions.vectors import Metric
from quillon.operators import kmeans
from quillon.operators.knn import _BLOCK, PLACES, QUERY_BYTES, Best, _asked, _chunks, distances, id_array, matrix, ranked
from quillon.operators.knn import probed as near_clusters


class Graph:
    """layers[l] maps a node to its neighbours; a node is a row of vectors."""

    def __init__(self, vectors: np.ndarray, metric: Metric, config: HnswConfig):
        self.metric, self.config = metric, config
        if metric is Metric.COSINE:  # on unit vectors both distances rank alike; a zero vector is as far from all
            norms = np.sqrt((vectors * vectors).sum(1, keepdims=True))
            vectors = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
        self.vectors = vectors
        self.layers: list[dict[int, list[int]]] = []
        self.entry = -1

    def _far(self, query: np.ndarray, nodes: list[int]) -> np.ndarray:
        d = self.vectors[nodes] - query
        return np.einsum("ij,ij->i", d, d)

    def _beam(self, query: np.ndarray, starts: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ef nearest that a best-first walk from starts meets, nearest first."""
        seen = {n for _, n in starts}
        front = list(starts)
        heapq.heapify(front)
        best = [(-d, n) for d, n in starts]
        heapq.heapify(best)
        links = self.layers[layer]
        while front:
            d, node = heapq.heappop(front)
            if d > -best[0][0] and len(best) >= ef:
                break
            new = [n for n in links[node] if n not in seen]
            if not new:
                continue
            seen.update(new)
            for dn, n in zip(self._far(query, new).tolist(), new):
                if len(best) < ef or dn < -best[0][0]:
                    heapq.heappush(front, (dn, n))
                    heapq.heappush(best, (-dn, n))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, n) for d, n in best)

    def select(self, near: list[tuple[float, int]], m: int) -> list[int]:
        """At most m of near (nearest first): the closest, or those closer to the node than to any chosen one, filled up."""
        if not self.config.heuristic or len(near) <= m:
            return [n for _, n in near[:m]]
        chosen: list[int] = []
        left: list[int] = []
        for d, n in near:
            if len(chosen) == m:
                break
            if not chosen or self._far(self.vectors[n], chosen).min() > d:
                chosen.append(n)
            else:
                left.append(n)
        return chosen + left[: m - len(chosen)]

    def add(self, node: int, level: int) -> None:
        query = self.vectors[node]
        if self.entry < 0:
            self.layers = [{node: []} for _ in range(level + 1)]
            self.entry = node
            return
        top = len(self.layers) - 1
        starts = [(float(self._far(query, [self.entry])[0]), self.entry)]
        for layer in range(top, level, -1):
            starts = self._beam(query, starts, 1, layer)
        for layer in range(min(level, top), -1, -1):
            near = self._beam(query, starts, self.config.ef_construction, layer)
            chosen = self.select(near, self.config.m)
            links, most = self.layers[layer], self.config.most(layer)
            links[node] = chosen
            for n in chosen:
                links[n].append(node)
                if len(links[n]) > most:
                    d = self._far(self.vectors[n], links[n]).tolist()
                    links[n] = self.select(sorted(zip(d, links[n])), most)
            starts = near
        for _ in range(top + 1, level + 1):
            self.layers.append({node: []})
            self.entry = node

    @staticmethod
    def build(vectors: np.ndarray, metric: str | Metric = "l2", config: HnswConfig = HnswConfig()) -> "Graph":
        g = Graph(np.asarray(vectors, np.float64), Metric.parse(metric), config)
        draws = np.random.default_rng(config.seed).random(len(vectors))
        for i, u in enumerate(draws):
            g.add(i, int(-math.log(max(u, 1e-12)) * config.level_scale))
        return g

    def search(self, query: np.ndarray, k: int, ef: int | None = None) -> list[int]:
        """The nodes of about the k nearest, nearest first."""
        if self.entry < 0 or k <= 0:
            return []
        query = np.asarray(query, np.float64)
        if self.metric is Metric.COSINE and (size := math.sqrt(float(query @ query))) > 0:
            query = query / size
        near = [(float(self._far(query, [self.entry])[0]), self.entry)]
        for layer in range(len(self.layers) - 1, 0, -1):
            near = self._beam(query, near, 1, layer)
        return [n for _, n in self._beam(query, near, max(ef or self.config.ef_search, k), 0)[:k]]

    def edges(self) -> list[tuple[int, int, int]]:
        return [(layer, a, b) for layer, links in enumerate(self.layers) for a, to in links.items() for b in to]

    def to_row(self) -> dict:
        """entry and layers as plain arrays: nodes, where each one's links begin, links."""
        layers = []
        for links in self.layers:
            nodes = sorted(links)
            layers.append({"nodes": nodes, "offsets": [0, *accumulate(len(links[n]) for n in nodes)], "links": [x for n in nodes for x in links[n]]})
        return {"entry": self.entry, "layers": layers}

    def restored(self, row: dict) -> "Graph":
        """A graph from to_row(), with this one's vectors."""
        self.entry = row["entry"]
        self.layers = [{n: x["links"][x["offsets"][i] : x["offsets"][i + 1]] for i, n in enumerate(x["nodes"])} for x in row["layers"]]
        return self


_INTS = T.ArrayType(T.IntegerType())
GRAPH = T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("layers", T.ArrayType(T.StructType([T.StructField(x, _INTS) for x in ("nodes", "offsets", "links")])))])
_ARROW_INTS = pa.list_(pa.int32())
_ARROW_GRAPH = pa.struct([("entry", pa.int32()), ("layers", pa.list_(pa.struct([(x, _ARROW_INTS) for x in ("nodes", "offsets", "links")])))])


def build(clustered: DataFrame, metric: str | Metric = "l2", config: HnswConfig = HnswConfig(), keep_vectors: bool = True) -> DataFrame:
    """(cluster_id, part, ids, vectors, graph) of (id, cluster_id, vector); graph is null for a small cluster.

    A cluster of more than max_graph_size vectors has several parts of about equal size, by hash of the id, so that no task
    builds more than one such graph at a time. Without keep_vectors, vectors is null and search_external() brings them.
    """
    metric = Metric.parse(metric)
    id_type = clustered.schema["id"].dataType
    source = clustered.where("vector IS NOT NULL").select("id", "cluster_id", "vector")
    sizes = kmeans.cluster_sizes(source).withColumn("parts", F.ceil(F.col("n") / config.max_graph_size).cast("int")).select("cluster_id", "parts")
    parted = source.join(F.broadcast(sizes), "cluster_id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")  # a row a cluster

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        v = matrix(table.column("vector"))
        graph = Graph.build(v, metric, config).to_row() if len(v) >= config.min_cluster_size else None
        lists = lambda values, begin: pa.ListArray.from_arrays(pa.array(begin, pa.int32()), values)
        ids = table.column("id").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        vectors = pa.array([v.ravel()] if keep_vectors else [None], pa.list_(pa.float64()))
        return pa.table({"cluster_id": table.column("cluster_id").slice(0, 1), "part": table.column("part").slice(0, 1), "ids": lists(ids, [0, len(v)]), "vectors": vectors, "graph": pa.array([graph], _ARROW_GRAPH)})

    schema = T.StructType([clustered.schema["cluster_id"], T.StructField("part", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("vectors", T.ArrayType(T.DoubleType())), T.StructField("graph", GRAPH)])
    # rows are small and graphs take long, so the tasks are not to be joined by the bytes that they read
    spark = clustered.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return parted.repartition(tasks, "cluster_id", "part").groupBy("cluster_id", "part").applyInArrow(run, schema)


def search(index: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2", config: HnswConfig = HnswConfig(), probed: DataFrame | None = None, ef: int | None = None) -> DataFrame:
    """(query_id, id, distance, rank): every query (query_id, vector) in every cluster, or in those that probed
    (query_id, vector, probes) names.

    The queries go to the graphs in chunks of a checked size; the index stays where it is.
    """
    metric = Metric.parse(metric)
    id_type = index.schema["ids"].dataType.elementType
    schema = T.StructType([queries.schema["query_id"], T.StructField("id", id_type), T.StructField("distance", T.DoubleType())])
    source = probed if probed is not None else queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    held = [index.sparkSession.sparkContext.broadcast(_asked(chunk)) for chunk in _chunks(source, QUERY_BYTES)]
    return ranked(index.select("cluster_id", "ids", "vectors", "graph").mapInArrow(_walk(held, k, metric, config, ef), schema), k)


def _walk(held: list, k: int, metric: Metric, config: HnswConfig, ef: int | None):
    """One pass over the graphs for all chunks of queries, so that none is built twice; a task keeps k rows of each query."""
    width = max(ef or config.ef_search, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = [Best(len(h.value.queries), k) for h in held], None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("cluster_id", "ids", "vectors", "graph")}
                if not row["vectors"].is_valid:
                    continue
                names, cluster, g = id_array(row["ids"].values), row["cluster_id"].as_py(), None
                v = row["vectors"].values.to_numpy(zero_copy_only=False).reshape(len(names), -1)
                for h, found in zip(held, best):
                    asked = h.value
                    some = np.arange(len(asked.queries)) if asked.by_cluster is None else asked.by_cluster.get(cluster, (np.zeros(0, np.int64),))[0]
                    if not len(some):
                        continue
                    if width >= len(names) or not row["graph"].is_valid:  # a beam that holds every vector is a scan
                        step = max(1, _BLOCK // len(names))
                        for a in range(0, len(some), step):
                            found.add(some[a : a + step], distances(asked.queries[some[a : a + step]], v, metric), names)
                        continue
                    g = g or Graph(v, metric, config).restored(row["graph"].as_py())
                    for x in some:
                        at = np.array(g.search(asked.queries[x], k, ef), np.int64)
                        found.add(np.array([x]), distances(asked.queries[x : x + 1], v[at], metric), names[at])
        for h, found in zip(held, best):
            if kind is not None:
                slot, d, ids = found.rows()
                yield pa.RecordBatch.from_arrays([h.value.query_ids.take(pa.array(slot)), pa.array(ids, kind), pa.array(d)], names=["query_id", "id", "distance"])

    return run


def search_external(index: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2", config: HnswConfig = HnswConfig(), probed: DataFrame | None = None, ef: int | None = None) -> DataFrame:
    """search() in an index that holds no vectors: they come from vectors (id, vector), in the order of the index's ids."""
    places = index.select("cluster_id", "part", F.posexplode("ids").alias("at", "id"))
    joined = places.join(vectors.select("id", F.col("vector").cast("array<double>").alias("v")), "id")
    held = joined.groupBy("cluster_id", "part").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"])).alias("vectors"))
    whole = index.drop("vectors").join(held, ["cluster_id", "part"]).select("cluster_id", "part", "ids", "vectors", "graph")
    return search(whole, queries, k, metric, config, probed, ef)


def ivf_search(index: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int, metric: str | Metric = "l2", config: HnswConfig = HnswConfig()) -> DataFrame:
    """search() in the nprobe nearest clusters of each query; centroids is (cluster_id, centroid)."""
    return search(index, queries, k, metric, config, near_clusters(queries, centroids, nprobe, metric))


def edges(index: DataFrame) -> DataFrame:
    """(cluster_id, part, layer, src, dst) of a built index; src and dst are ids."""
    layers = index.where("graph IS NOT NULL").select("cluster_id", "part", "ids", F.posexplode("graph.layers").alias("layer", "x"))
    nodes = layers.select("cluster_id", "part", "layer", "ids", "x", F.posexplode("x.nodes").alias("i", "node"))
    begin, end = F.col("x.offsets")[F.col("i")], F.col("x.offsets")[F.col("i") + 1]
    links = nodes.where(end > begin).select("cluster_id", "part", "layer", "ids", F.col("ids")[F.col("node")].alias("src"), F.explode(F.slice("x.links", begin + 1, end - begin)).alias("to"))
    return links.select("cluster_id", "part", "layer", "src", F.col("ids")[F.col("to")].alias("dst"))


def stats(index: DataFrame) -> DataFrame:
    """(layer, nodes, edges, mean_degree) of the graphs of a built index, links counted from either end."""
    e = edges(index)
    both = e.select("cluster_id", "part", "layer", "src", "dst").union(e.select("cluster_id", "part", "layer", "dst", "src")).distinct()
    return degree_stats(both)


def degree_stats(links: DataFrame) -> DataFrame:
    """(layer, nodes, edges, mean_degree) of (layer, src, dst); an edge in both directions counts once."""
    degrees = links.groupBy("layer", "src").agg(F.count(F.lit(1)).alias("degree"))
    return degrees.groupBy("layer").agg(F.count(F.lit(1)).alias("nodes"), F.floor(F.sum("degree") / 2).alias("edges"), F.round(F.avg("degree"), PLACES).alias("mean_degree"))


def select_simple(pairs: DataFrame, m: int) -> DataFrame:
    """(src, dst, distance, rank): the m nearest neighbours of each node of (src, dst, distance)."""
    w = Window.partitionBy("src").orderBy("distance", "dst")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m)
