"""Vector scalars as Column expressions over array<float> or array<double>; all arithmetic is in double.

A null vector gives null. Two vectors of different sizes give null, as zip_with pads the shorter one with nulls; where
that is an error, check_dimension() raises it.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Metric(Enum):
    L2 = "l2"
    COSINE = "cosine"

    @classmethod
    def parse(cls, name: "str | Metric") -> "Metric":
        if isinstance(name, Metric):
            return name
        found = {"l2": cls.L2, "euclidean": cls.L2, "cosine": cls.COSINE}.get(name.lower())
        if found is None:
            raise ValueError(f"unknown metric: {name}")
        return found


def _doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def l2_squared(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(l2_squared(a, b))


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity_with_norms(a: Column | str, b: Column | str, norm_a: Column, norm_b: Column) -> Column:
    """0 if either norm is 0."""
    return F.when(norm_a * norm_b == 0, F.lit(0.0)).otherwise(dot(a, b) / (norm_a * norm_b))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    return cosine_similarity_with_norms(a, b, norm(a), norm(b))


def cosine_similarity_or_zero(a: Column | str, b: Column | str) -> Column:
    """cosine_similarity(), and 0 for vectors of different sizes."""
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(cosine_similarity(a, b))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - cosine_similarity(a, b)


def cosine_distance_with_norms(a: Column | str, b: Column | str, norm_a: Column, norm_b: Column) -> Column:
    return 1 - cosine_similarity_with_norms(a, b, norm_a, norm_b)


def distance(a: Column | str, b: Column | str, metric: str | Metric) -> Column:
    """The distance that searches rank by: squared for L2."""
    return l2_squared(a, b) if Metric.parse(metric) is Metric.L2 else cosine_distance(a, b)


def normalize(v: Column | str) -> Column:
    """v at unit length; a zero vector as it is."""
    d = _doubles(v)
    # transform() with the norm as a struct field: computed once a row, not once an element
    held = F.struct(d.alias("v"), norm(v).alias("n"))
    return F.transform(F.array(held), lambda h: F.when(h["n"] > 0, F.transform(h["v"], lambda x: x / h["n"])).otherwise(h["v"]))[0]


def residual(v: Column | str, centroid: Column | str) -> Column:
    return F.zip_with(_doubles(v), _doubles(centroid), lambda x, y: x - y)


def subvector(v: Column | str, m: Column | int, size: int) -> Column:
    """The m-th run of size elements, counted from 0."""
    return F.slice(F.col(v) if isinstance(v, str) else v, (F.lit(m) if isinstance(m, int) else m) * size + 1, F.lit(size))


def centroids(df: DataFrame, group: list[str], vector: str = "vector", out: str = "centroid") -> DataFrame:
    """(group..., out): the mean of the vectors of each group, summed by element with map-side combination.

    Groups without a vector have no row. Vectors of a group should have one size; missing elements count for nothing.
    """
    elements = df.select(*group, F.posexplode(_doubles(vector)).alias("_pos", "_x"))
    means = elements.groupBy(*group, "_pos").agg(F.avg("_x").alias("_x"))
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_x")))
    return means.groupBy(*group).agg(F.transform(ordered, lambda e: e["_x"]).alias(out))


def rounded(x: Column, places: int = 6) -> Column:
    return F.round(x, places)
