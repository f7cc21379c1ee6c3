"""Streams into collections, and results that get better while they are read."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.config import RefinementConfig
from quillon.functions.vectors import Metric
from quillon.operators import knn
from quillon.sources.collection import Collection

BATCH_SCHEMA = "id string, vector array<float>, payload string"


def ingest(points: DataFrame, collection: Collection, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Every micro-batch of a stream (id, vector[, payload]) is one insert; full staging tables are flushed on the way.

    A batch and its number come into the collection's metadata in one step, so one that is run again after a failure is
    known and left out. The stream is named by its checkpoint.
    """

    def insert(batch: DataFrame, number: int) -> None:
        collection.insert(batch, (checkpoint, number))

    writer = points.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_points(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(BATCH_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def two_phase(clustered: DataFrame, centroids: DataFrame, query: list[float], k: int, metric: str | Metric = "l2", config: RefinementConfig = RefinementConfig(), keep_time: bool = True) -> DataFrame:
    """(id, distance): the nearest clusters first; more of them only if these hold fewer than k and time is left."""
    began = time.monotonic()
    first = knn.ivf_search(clustered, centroids, query, k, config.initial_nprobe, metric)
    rows = first.collect()  # k rows
    late = keep_time and (time.monotonic() - began) * 1000 > config.max_timeout_ms
    if len(rows) >= k or late:
        return clustered.sparkSession.createDataFrame(rows, first.schema) if rows else first
    return knn.ivf_search(clustered, centroids, query, k, config.initial_nprobe + config.refinement_nprobe, metric)


def progressive(clustered: DataFrame, centroids: DataFrame, query: list[float], k: int, metric: str | Metric = "l2", step: int = 5) -> Iterator[tuple[int, bool, bool, DataFrame]]:
    """(clusters searched, first, last, the k nearest so far) after every step clusters, nearest clusters first."""
    order = [r["cluster_id"] for r in knn.nearest_clusters(centroids, query, 1 << 30, metric).orderBy("rank").collect()]
    for a in range(0, max(1, len(order)), step):
        found = knn.search(clustered.where(F.col("cluster_id").isin(order[: a + step])), query, k, metric)
        yield min(a + step, len(order)), a == 0, a + step >= len(order), found


def progressive_table(clustered: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2", step: int = 5) -> DataFrame:
    """(query_id, snapshot, id, distance, rank): the snapshots of progressive() for many queries in one plan.

    Every task keeps the k best of each query and step; a snapshot ranks those of the steps up to its own.
    """
    best = knn.batch_by_turns(clustered, centroids, queries, k, step, metric).drop("rank")  # only these can be in a later snapshot
    steps = -(-centroids.count() // step)
    seen = best.withColumn("snapshot", F.explode(F.sequence(F.col("turn"), F.lit(max(0, steps - 1)))))
    w = knn.Window.partitionBy("query_id", "snapshot").orderBy("distance", "id")
    return seen.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "snapshot", "id", "distance", "rank")
