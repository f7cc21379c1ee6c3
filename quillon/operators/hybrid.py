"""Fusion of a text result (id, score) and a vector result (id, distance) to (id, score, text_score, vector_score, text_rank, vector_rank).

Both inputs are candidate lists of a few hundred rows, so their extremes and ranks are windows over all of them. Fused
scores are rounded before ranking and ties go to the lower id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.config import HybridConfig
from quillon.errors import InvalidQuery

PLACES = 6
LEAST_RANGE = 1e-6


def _all() -> Window:
    return Window.partitionBy(F.lit(0))


def _sides(text: DataFrame, vector: DataFrame, config: HybridConfig) -> tuple[DataFrame, DataFrame]:
    """The candidates after the filters, an id once on the text side (its best score), with their ranks."""
    if config.min_text_score is not None:
        text = text.where(F.col("score") >= config.min_text_score)
    if config.max_vector_distance is not None:
        vector = vector.where(F.col("distance") <= config.max_vector_distance)
    text = text.groupBy("id").agg(F.max("score").alias("raw"))
    vector = vector.select("id", F.col("distance").alias("raw"))
    return (
        text.withColumn("text_rank", F.row_number().over(_all().orderBy(F.desc("raw"), "id"))),
        vector.withColumn("vector_rank", F.row_number().over(_all().orderBy("raw", "id"))),
    )


def _joined(text: DataFrame, vector: DataFrame, score: Callable[[Column, Column], Column], k: int) -> DataFrame:
    """text (id, text_rank, text_score), vector (id, vector_rank, vector_score); an id twice on the vector side adds up."""
    vector = vector.groupBy("id").agg(F.min("vector_rank").alias("vector_rank"), F.sum("vector_score").alias("vector_score"))
    both = text.select("id", "text_rank", "text_score").join(vector, "id", "full_outer")
    total = score(F.coalesce("text_score", F.lit(0.0)), F.coalesce("vector_score", F.lit(0.0)))
    rounded = lambda c: F.round(c, PLACES).alias(c)
    return both.select("id", F.round(total, PLACES).alias("score"), rounded("text_score"), rounded("vector_score"), "text_rank", "vector_rank").orderBy(F.desc("score"), "id").limit(k)


def weighted(text: DataFrame, vector: DataFrame, k: int = 10, config: HybridConfig = HybridConfig()) -> DataFrame:
    """lambda times the text score plus (1 - lambda) times the vector score, each scaled to [0, 1] over its candidates."""
    t, v = _sides(text, vector, config)
    low, high = F.min("raw").over(_all()), F.max("raw").over(_all())
    wide = F.greatest(high - low, F.lit(LEAST_RANGE))
    t = t.withColumn("text_score", (F.col("raw") - low) / wide)
    v = v.withColumn("vector_score", 1 - (F.col("raw") - low) / wide)
    return _joined(t, v, lambda a, b: a * config.lambda_ + b * (1 - config.lambda_), k)


def rrf(text: DataFrame, vector: DataFrame, k: int = 10, config: HybridConfig = HybridConfig(method="rrf")) -> DataFrame:
    """The sum of 1 / (rrf_k + rank) over both lists."""
    t, v = _sides(text, vector, config)
    t = t.withColumn("text_score", 1 / (config.rrf_k + F.col("text_rank")))
    v = v.withColumn("vector_score", 1 / (config.rrf_k + F.col("vector_rank")))
    return _joined(t, v, lambda a, b: a + b, k)


def softmax(text: DataFrame, vector: DataFrame, k: int = 10, config: HybridConfig = HybridConfig(method="softmax")) -> DataFrame:
    """As weighted(), scaled by a softmax at the temperature over the scores, and over how much nearer than the farthest."""
    t, v = _sides(text, vector, config)
    temperature = F.lit(config.temperature)
    t = t.withColumn("e", F.exp((F.col("raw") - F.max("raw").over(_all())) / temperature))
    v = v.withColumn("e", F.exp((F.min("raw").over(_all()) - F.col("raw")) / temperature))
    t = t.withColumn("text_score", F.col("e") / F.sum("e").over(_all()))
    v = v.withColumn("vector_score", F.col("e") / F.sum("e").over(_all()))
    return _joined(t, v, lambda a, b: a * config.lambda_ + b * (1 - config.lambda_), k)


METHODS = {"weighted": weighted, "normalized": weighted, "rrf": rrf, "softmax": softmax}


def fuse(text: DataFrame, vector: DataFrame, k: int = 10, config: HybridConfig = HybridConfig()) -> DataFrame:
    """By the method of config; "normalized" is another name of "weighted"."""
    if config.method not in METHODS:
        raise InvalidQuery(f"unknown fusion method: {config.method}")
    return METHODS[config.method](text, vector, k, config)


def with_payload(fused: DataFrame, hits: DataFrame) -> DataFrame:
    """fused with payload from the vector hits (id, payload); null for ids that only the text side has."""
    return fused.join(hits.select("id", "payload").dropDuplicates(["id"]), "id", "left")
