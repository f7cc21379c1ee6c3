"""Measures of search results, and co-access counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PLACES = 6


def recall_by_query(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of k that found (query_id, id) has in common with truth (query_id, id)."""
    pair = ["query_id", "id"]
    hits = truth.select(*pair).distinct().join(found.select(*pair).distinct().withColumn("hit", F.lit(1)), pair, "left")
    return hits.groupBy("query_id").agg(F.round(F.count("hit") / k, PLACES).alias("recall"))


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(n_queries, recall): the mean over the queries of truth."""
    return recall_by_query(found, truth, k).agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("recall"), PLACES).alias("recall"))


def recall_of_truth(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the query's own truth, however many ids that has."""
    pair = ["query_id", "id"]
    hits = truth.select(*pair).distinct().join(found.select(*pair).distinct().withColumn("hit", F.lit(1)), pair, "left")
    return hits.groupBy("query_id").agg(F.round(F.count("hit") / F.count(F.lit(1)), PLACES).alias("recall"))


def mrr(found: DataFrame, relevant: DataFrame) -> DataFrame:
    """(n_queries, mrr): the mean of 1 / rank of the one relevant id (query_id, id) in found (query_id, id, rank); 0 if absent."""
    ranks = relevant.select("query_id", "id").join(found.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    best = ranks.groupBy("query_id").agg(F.min("rank").alias("rank"))
    return best.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), PLACES).alias("mrr"))


def quantiles(df: DataFrame, value: str, by: list[str], shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(by..., n, mean, p50, p95, p99): the value at place floor(n * share) of the sorted values, counted from 0.

    Equal values are counted before they are sorted, so a group's window holds distinct values only.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by)
    upto = counted.withColumn("upto", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    aggs = [F.first("n").alias("n"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), PLACES).alias("mean")]
    for s in shares:
        place = F.least(F.floor(F.col("n") * s), F.col("n") - 1)
        aggs.append(F.min(F.when(F.col("upto") > place, F.col("v"))).alias(f"p{round(100 * s)}"))
    return upto.groupBy(*by).agg(*aggs)


def coaccess(accesses: DataFrame, top: int) -> DataFrame:
    """(item, other, n, rank): the items that most sets (access_id, item) hold beside each item."""
    pairs = accesses.select("access_id", "item").distinct()
    both = pairs.join(pairs.withColumnRenamed("item", "other"), "access_id").where("item != other")
    counted = both.groupBy("item", "other").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("item").orderBy(F.desc("n"), "other")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
