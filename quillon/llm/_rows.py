"""Rows of a corpus named by content, and decisions about them applied without a row number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._batch import KeyFilter, fresh, small_batches


def text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits that name a text; two seeds, so that billions of texts do not collide. A null text has its own key."""
    return F.xxhash64(F.lit(1), text, text.isNull()), F.xxhash64(F.lit(2), text, text.isNull())


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, text, more..., k1, k2): the named columns alone, so no other column can clash."""
    k1, k2 = text_keys(docs[text_col])
    return small_batches(docs).select(docs[id_col].alias("id"), docs[text_col].alias("text"), *[docs[c].alias(c) for c in more], k1.alias("k1"), k2.alias("k2"))


def without(docs: DataFrame, id_col: str, text_col: str, dropped: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """docs less the rows whose (id, text) is in dropped (id, k1, k2), with one row for each key in repeated.

    Both tables hold a key once and are written ones. A filter of their keys tells most rows that surely stay from the
    others, and only those others move for the joins.
    """
    a, b, c = (fresh(docs, f"_quillon_{x}") for x in ("a", "b", "c"))
    k1, k2 = text_keys(docs[text_col])
    keys = dropped.select("k1") if repeated is None else dropped.select("k1").unionByName(repeated.select("k1"))
    left, stays = KeyFilter(keys, "k1").split(docs.withColumns({a: k1, b: k2}), a)
    named = lambda t: t.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("id").alias(c))

    def on(x: DataFrame, t: DataFrame) -> Column:
        return (x[a] == t[a]) & (x[b] == t[b]) & x[id_col].eqNullSafe(t[c])

    gone = named(dropped)
    left = left.join(gone, on(left, gone), "left_anti")
    if repeated is not None and not repeated.isEmpty():
        twice = named(repeated)
        one = left.join(twice, on(left, twice), "left_semi").dropDuplicates([id_col, a, b])
        left = left.join(twice, on(left, twice), "left_anti").unionByName(one)
    return stays.unionByName(left).drop(a, b)
