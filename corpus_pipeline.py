"""From raw documents to packed training windows: STAGES in order, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm._batch import drop_since, mark, written
from quillon.llm.exact_dedup import drop_exact_duplicates
from quillon.llm.language_id import keep_identified
from quillon.llm.near_dedup import drop_near_duplicates
from quillon.llm.packing import pack
from quillon.llm.secrets import redact_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier can tell stay; null texts and texts without letters go.

    Without two labelled documents of a language there is no classifier, and nothing stays. An empty table stays empty.
    """
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id stays of those with the same bytes.

    Null ids come last; of rows that repeat an id and a text any one stays. Null texts all stay; empty ones equal each
    other. An empty table stays empty.
    """
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id stays of each group of near copies.

    Null ids come last, ties go by text. Null and empty texts and texts without words are no copies and stay. An empty
    table stays empty.
    """
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; what holds a secret, encoded or not, is replaced, and n_chars follows."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows, each with the documents' texts, or parts of them, that it holds.

    Null and empty texts and texts of white space are in none; rows that repeat are all in. An empty table has none.
    """
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

# A trained classifier, recursive decoding and a dynamic program have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of the last stage; every stage's rows are written to the shared folder and read again.

    What a stage has written on the way, and the rows of the stage before it, are deleted once its own rows are there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = mark()
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        drop_since(place, docs)
    return docs
