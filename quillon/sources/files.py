"""Vectors and texts from files, random vectors, and results as CSV."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import InvalidQuery


def read_npy(spark: SparkSession, path: str, ids_path: str | None = None) -> DataFrame:
    """(id, vector) of a matrix file, ids from a file with one on each line or else the row numbers.

    The matrix is mapped and sent in slices; a number of ids other than that of rows is an error.
    """
    rows = np.load(path, mmap_mode="r")
    if rows.ndim != 2:
        raise InvalidQuery(f"{path} holds no matrix")
    if ids_path is None:
        ids = [str(i) for i in range(len(rows))]
    else:
        with open(ids_path, encoding="utf-8") as lines:
            ids = [x.rstrip("\n") for x in lines]
    if len(ids) != len(rows):
        raise InvalidQuery(f"{len(ids)} ids for {len(rows)} vectors")
    flat = pa.array(np.ascontiguousarray(rows, dtype=np.float32).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), flat)
    return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.string()), "vector": lists}))


def read_npy_parts(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector) of the matrices in a folder of .npy files, each read by a task; ids are file name, # and row number."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
                if rows.ndim != 2:
                    raise InvalidQuery(f"{name} holds no matrix")
                for a in range(0, len(rows), 10_000):
                    some = np.ascontiguousarray(rows[a : a + 10_000], np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * rows.shape[1], pa.int32()), pa.array(some.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([f"{name.rpartition('/')[2]}#{a + i}" for i in range(len(some))], pa.string()), lists], names=["id", "vector"])

    return files.mapInArrow(run, "id string, vector array<float>")


def read_hdf5(spark: SparkSession, path: str, dataset: str = "train", rows: int = 1 << 16) -> DataFrame:
    """(id, vector) of a matrix in an HDF5 file, ids the row numbers; it needs h5py. It is read and sent in slices."""
    try:
        import h5py
    except ImportError as e:
        raise InvalidQuery("h5py is not installed") from e
    parts = None
    with h5py.File(path, "r") as f:
        held = f[dataset]
        for a in range(0, max(1, len(held)), rows):
            part = np.ascontiguousarray(held[a : a + rows], np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * held.shape[1], pa.int32()), pa.array(part.ravel()))
            df = spark.createDataFrame(pa.table({"id": pa.array([str(a + i) for i in range(len(part))], pa.string()), "vector": lists}))
            parts = df if parts is None else parts.unionByName(df)
    return parts


def encode_vectors(vector: Column | str) -> Column:
    """Vectors as bytes: 32-bit floats, low byte first, one after the other; a null vector gives null."""

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return run(F.col(vector) if isinstance(vector, str) else vector)


def decode_vectors(data: Column | str) -> Column:
    """The vectors that encode_vectors() wrote; null and bytes that are no whole number of floats give null."""

    @F.pandas_udf("array<float>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist())

    return run(F.col(data) if isinstance(data, str) else data)


def read_texts(spark: SparkSession, path: str, extensions: list[str] | None = None, recursive: bool = False) -> DataFrame:
    """(path, text): a row for each file of a folder (or for one file), of certain extensions if given.

    Files that can't be read are left out.
    """
    pattern = f"*.{{{','.join(x.lstrip('.') for x in extensions)}}}" if extensions else "*"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).option("ignoreCorruptFiles", "true").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def random_vectors(spark: SparkSession, n: int, dimension: int, seed: int = 42) -> DataFrame:
    """(id, vector): n vectors of independent standard normal elements, ids vec_0 and so on."""
    # one random column an element: within a transform every element of a row would be the same draw
    elements = [F.randn(seed + i).cast("float") for i in range(dimension)]
    return spark.range(n).select(F.concat(F.lit("vec_"), F.col("id").cast("string")).alias("id"), F.array(*elements).alias("vector"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_json_points(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, payload) of JSON lines; payload stays JSON text."""
    lines = spark.read.text(path)
    x = F.from_json("value", "id string, vector array<float>, payload string")
    return lines.select(x.alias("x")).select("x.*")
