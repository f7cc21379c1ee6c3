"""Collections of vectors as Parquet tables: a staging table, immutable segments, and routing metadata.

A collection is a folder with config.json, meta/ (versions of the list of its segments with level and size) and tables:
staging/ holds what came in last, vectors/ one folder segment_id=... for each segment, sorted by cluster so that row
groups are pruned, and centroids/ the clusters' centroids likewise. A flush turns staging to a segment of level 0;
compaction merges segments of level 0 to one of level 1. A new version of meta comes last and names what belongs to the
collection, so a job that dies half way leaves files that no reader looks at; of two writers that began with one version
one gets through, and the other takes an insert up again or raises ConcurrentChange.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import CollectionConfig, KMeansConfig
from quillon.errors import CollectionExists, CollectionNotFound, ConcurrentChange, DimensionMismatch
from quillon.functions.vectors import Metric, centroids, norm
from quillon.operators import kmeans, knn
from quillon.sources.storage import Storage, Versions

SCHEMA = "id string, vector array<float>, payload string"
CENTROIDS = "segment_id string, cluster_id int, centroid array<double>, n long"


class Collection:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.storage = spark, path.rstrip("/"), Storage(spark)
        if not self.storage.exists(f"{self.path}/config.json"):
            raise CollectionNotFound(path)
        self.config = CollectionConfig.from_json(self.storage.read(f"{self.path}/config.json"))
        self.versions = Versions(self.storage, f"{self.path}/meta")

    # metadata

    def _meta(self) -> dict:
        """The last version, with its number under "version"."""
        number, text = self.versions.read()
        return json.loads(text) | {"version": number}

    def _save(self, meta: dict) -> None:
        """meta as the version after the one that it was read from."""
        self.versions.commit(meta["version"], json.dumps({k: v for k, v in meta.items() if k != "version"}))

    # tables

    def staging(self) -> DataFrame:
        """(id, vector, payload)"""
        parts = [f"{self.path}/staging/{x}" for x in self._meta()["staging"]]
        return self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)

    def _table(self, kind: str, schema: str, segments: list[str]) -> DataFrame:
        parts = [f"{self.path}/{kind}/segment_id={s}" for s in segments]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.path}/{kind}").schema(schema).parquet(*parts)

    def vectors(self, segments: list[str] | None = None) -> DataFrame:
        """(id, vector, payload, norm, cluster_id, segment_id) of the segments."""
        names = [s["segment_id"] for s in self._meta()["segments"]] if segments is None else segments
        return self._table("vectors", f"{SCHEMA}, norm double, cluster_id int, segment_id string", names)

    def centroids(self, segments: list[str] | None = None) -> DataFrame:
        names = [s["segment_id"] for s in self._meta()["segments"]] if segments is None else segments
        return self._table("centroids", CENTROIDS, names)

    def all(self) -> DataFrame:
        """(id, vector, payload) of staging and segments."""
        return self.staging().unionByName(self.vectors().select("id", "vector", "payload"))

    def router(self) -> DataFrame:
        """(segment_id, level, segment_centroid, num_vectors): a segment's centroid is the mean of its clusters', weighted."""
        rows = [(s["segment_id"], s["level"], s["segment_centroid"], s["num_vectors"]) for s in self._meta()["segments"]]
        return self.spark.createDataFrame(rows, "segment_id string, level int, segment_centroid array<double>, num_vectors long")

    # writing

    def insert(self, points: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Appends (id, vector[, payload]); all or nothing if a vector has a wrong size. Flushes a full staging table.

        batch is (stream, number): a number that is not above the last one taken in from that stream is left out, as both
        come into meta in one step. Whether points were taken in.
        """
        if batch and batch[1] <= self._meta().get("streams", {}).get(batch[0], -1):
            return False
        if "payload" not in points.columns:
            points = points.withColumn("payload", F.lit(None).cast("string"))
        points = points.select(F.col("id").cast("string"), F.col("vector").cast("array<float>"), F.col("payload").cast("string"))
        part = uuid.uuid4().hex
        points.write.parquet(f"{self.path}/staging/{part}")  # computed once; it belongs to the collection only when meta says so
        new = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/staging/{part}")
        bad = new.where("vector IS NULL OR size(vector) != " + str(self.config.dimension)).select(F.size("vector")).head(1)
        if bad:
            self.storage.delete(f"{self.path}/staging/{part}")
            raise DimensionMismatch(self.config.dimension, max(0, bad[0][0] or 0))
        n = new.count()
        while True:
            meta = self._meta()
            if batch and batch[1] <= meta.get("streams", {}).get(batch[0], -1):
                self.storage.delete(f"{self.path}/staging/{part}")
                return False
            meta["staging"].append(part)
            meta["staged"] += n
            if batch:
                meta["streams"] = meta.get("streams", {}) | {batch[0]: batch[1]}
            try:
                self._save(meta)
                break
            except ConcurrentChange:  # another writer's insert came between: ours goes after it
                continue
        if meta["staged"] >= self.config.staging_threshold:
            self.flush()
        return True

    def flush(self) -> str | None:
        """Staging as a segment of level 0, compacted if there are many; an empty staging table is left alone."""
        meta = self._meta()
        if not meta["staged"]:
            return None
        entry = self._write_segment(self.staging(), 0, meta["staged"])
        old = meta["staging"]
        meta.update(staging=[], staged=0, segments=[*meta["segments"], entry])
        self._save(meta)
        for x in old:
            self.storage.delete(f"{self.path}/staging/{x}")
        if self.needs_compaction():
            self.compact()
        return entry["segment_id"]

    def _write_segment(self, points: DataFrame, level: int, n: int) -> dict:
        segment = f"l{level}_{uuid.uuid4().hex}"
        k = kmeans.optimal_clusters(n, self.config.num_clusters)
        centers = kmeans.fit(points, KMeansConfig(num_clusters=k))
        assigned = kmeans.assign(points, centers).withColumn("norm", norm("vector"))
        ordered = assigned.repartitionByRange("cluster_id").sortWithinPartitions("cluster_id", "id")
        ordered.select("id", "vector", "payload", "norm", "cluster_id").write.parquet(f"{self.path}/vectors/segment_id={segment}")
        return self._write_centroids(segment, level)

    def _write_centroids(self, segment: str, level: int) -> dict:
        held = self.vectors([segment])
        own = centroids(held, ["cluster_id"]).join(held.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")), "cluster_id")
        own.select("cluster_id", "centroid", "n").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids/segment_id={segment}")
        x = F.posexplode("centroid").alias("pos", "x")
        clusters = self.centroids([segment])
        sums = clusters.select("n", x).groupBy("pos").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x")).orderBy("pos")
        n = clusters.agg(F.sum("n")).first()[0]
        return {"segment_id": segment, "level": level, "num_vectors": int(n), "segment_centroid": [r["x"] for r in sums.collect()]}

    def needs_compaction(self) -> bool:
        return sum(s["level"] == 0 for s in self._meta()["segments"]) >= self.config.l0_max_segments

    def compact(self) -> tuple[int, int]:
        """Merges the first l0_max_segments of level 0 to one segment, as long as there are so many; (segments before, after)."""
        before = len(self._meta()["segments"])
        while True:
            meta = self._meta()
            batch = [s for s in meta["segments"] if s["level"] == 0][: self.config.l0_max_segments]
            if len(batch) < self.config.l0_max_segments:
                return before, len(meta["segments"])
            size = sum(s["num_vectors"] for s in batch)
            names = [s["segment_id"] for s in batch]
            entry = self._write_segment(self.vectors(names).select("id", "vector", "payload"), 1, size)
            meta["segments"] = [s for s in meta["segments"] if s["segment_id"] not in names] + [entry]
            self._save(meta)
            for s in names:
                self.storage.delete(f"{self.path}/vectors/segment_id={s}")
                self.storage.delete(f"{self.path}/centroids/segment_id={s}")

    # the router's entries

    def router_upsert(self, segment_id: str, centroid: list[float], num_vectors: int, level: int = 0) -> None:
        """Puts a segment's entry in the place of its old one, or adds it."""
        meta = self._meta()
        entry = {"segment_id": segment_id, "level": level, "num_vectors": int(num_vectors), "segment_centroid": [float(x) for x in centroid]}
        kept = [entry if s["segment_id"] == segment_id else s for s in meta["segments"]]
        self._save(meta | {"segments": kept if any(s is entry for s in kept) else [*kept, entry]})

    def router_remove(self, segment_id: str) -> bool:
        """Takes a segment out of all searches; its files stay. Whether there was one."""
        meta = self._meta()
        kept = [s for s in meta["segments"] if s["segment_id"] != segment_id]
        if len(kept) == len(meta["segments"]):
            return False
        self._save(meta | {"segments": kept})
        return True

    def router_contains(self, segment_id: str) -> bool:
        return any(s["segment_id"] == segment_id for s in self._meta()["segments"])

    def router_get(self, segment_id: str) -> DataFrame:
        """The row of router() of one segment, or none."""
        return self.router().where(F.col("segment_id") == segment_id)

    def rebuild_router(self) -> None:
        """Recomputes every segment's centroids from its vectors."""
        meta = self._meta()
        meta["segments"] = [self._write_centroids(s["segment_id"], s["level"]) for s in meta["segments"]]
        self._save(meta)

    # reading

    def stats(self) -> DataFrame:
        """(segment_id, level, num_vectors, num_clusters), staging as level -1 without clusters."""
        meta = self._meta()
        levels = self.router().select("segment_id", "level", "num_vectors")
        clusters = self.centroids().groupBy("segment_id").agg(F.count(F.lit(1)).alias("num_clusters"))
        staged = self.spark.createDataFrame([("staging", -1, meta["staged"], 0)], "segment_id string, level int, num_vectors long, num_clusters long")
        return levels.join(clusters, "segment_id").unionByName(staged)

    def count(self) -> int:
        meta = self._meta()
        return meta["staged"] + sum(s["num_vectors"] for s in meta["segments"])

    def search(self, query: list[float], k: int = 10, nprobe: int = 4, include_payload: bool = False) -> DataFrame:
        """(id, distance[, payload]): staging and the nprobe nearest clusters of every segment (or of the router_top_m nearest)."""
        if len(query) != self.config.dimension:
            raise DimensionMismatch(self.config.dimension, len(query))
        metric = Metric.parse(self.config.metric)
        keep = ["payload"] if include_payload else []
        parts = [knn.search(self.staging(), query, k, metric, keep=keep)]
        names = [s["segment_id"] for s in self._meta()["segments"]]
        if self.config.router_top_m and len(names) > self.config.router_top_m:
            names = [r["segment_id"] for r in knn.select_segments(self.router(), query, self.config.router_top_m, metric).collect()]
        if names:
            parts.append(knn.ivf_search(self.vectors(names), self.centroids(names), query, k, nprobe, metric, ["segment_id"], keep))
        return knn.merge(parts, k)

    def get(self, ids: list[str]) -> DataFrame:
        """(id, vector, payload) of some ids; the filter reaches the scans of staging and segments."""
        wanted = F.col("id").isin([str(i) for i in ids])
        return self.staging().where(wanted).unionByName(self.vectors().where(wanted).select("id", "vector", "payload"))

    def search_exact(self, queries: DataFrame, k: int = 10, exclude_self: bool = False) -> DataFrame:
        """(query_id, id, distance, rank) for many queries (query_id, vector) over all vectors."""
        return knn.batch_search(self.all(), queries, k, self.config.metric, exclude_self)


class Catalog:
    """The collections in a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.storage = spark, root.rstrip("/"), Storage(spark)

    def create(self, config: CollectionConfig) -> Collection:
        path = f"{self.root}/{config.name}"
        if self.storage.exists(f"{path}/config.json"):
            raise CollectionExists(config.name)
        try:
            Versions(self.storage, f"{path}/meta").commit(0, json.dumps({"segments": [], "staging": [], "staged": 0}))
        except ConcurrentChange as e:
            if self.storage.exists(f"{path}/config.json"):  # else one who died before it wrote the settings
                raise CollectionExists(config.name) from e
        self.storage.write(f"{path}/config.json", config.to_json())
        return Collection(self.spark, path)

    def get(self, name: str) -> Collection:
        return Collection(self.spark, f"{self.root}/{name}")

    def names(self) -> list[str]:
        return [n for n in self.storage.folders(self.root) if self.storage.exists(f"{self.root}/{n}/config.json")]

    def drop(self, name: str) -> None:
        if name not in self.names():
            raise CollectionNotFound(name)
        self.storage.delete(f"{self.root}/{name}")

    def list(self) -> DataFrame:
        """(name, dimension, metric, num_segments, num_vectors)"""
        rows = []
        for name in self.names():
            c = self.get(name)
            rows.append((name, c.config.dimension, c.config.metric, len(c._meta()["segments"]), c.count()))
        return self.spark.createDataFrame(rows, "name string, dimension int, metric string, num_segments int, num_vectors long")
