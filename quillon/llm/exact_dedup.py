"""Exact duplicates by an extendible-hash index on shared files.

The key of a text is its 64-bit hash. A directory maps the leading bits of a key to a bucket; where a bucket holds more
than its capacity in bytes it splits by one more bit, as far as the bits of a key go, and the directory doubles when the
bucket is as deep as the directory. Buckets are ranges of keys; neighbouring ones make up the range of one owner task.
Only keys that occur twice have entries, and every task that meets a text writes it once, with the least id and the
number of its rows, so the entry of a text that a third of the corpus repeats comes once a task. Entries and directory are
tables in the shared folder. An owner reads the entries of its range in order of key, chains the different texts of one
key and compares their bytes; the chain it writes names each text's least id. Rows then meet the chains of their key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm._batch import KeyFilter, drop_written, written
from quillon.llm._rows import keyed, without

CAPACITY = 32 << 20
KEY_BITS = 64
_STEP = 8
_HELD = 16 << 20


def directory(sizes: Callable[[int, list[int]], dict[int, tuple[int, int]]], capacity: int, bits: int = KEY_BITS) -> tuple[int, list[tuple[int, int, int]]]:
    """(depth, buckets): a bucket is (its prefix, its depth in bits, its bytes), in order of key.

    sizes(d, parents) gives (bytes, keys) by prefix of d bits, of the prefixes that begin with one of parents (prefixes of
    d - 8 bits; of all at first). A bucket with one key doesn't split: its surplus is a chain.
    """
    depth, buckets, level = 0, [], min(_STEP, bits)
    open_: list[tuple[int, int]] = [(0, 0)]  # (prefix, depth) of what is still to be divided
    while open_:
        found = sizes(level, sorted({p for p, _ in open_}) if level > _STEP else [0])
        order = sorted(found)
        total = np.concatenate([[0], np.cumsum([found[p][0] for p in order])]).astype(np.int64)
        keys = np.concatenate([[0], np.cumsum([found[p][1] for p in order])]).astype(np.int64)
        more = []
        work = open_[::-1]
        while work:
            prefix, d = work.pop()
            i, j = (int(np.searchsorted(order, x << (level - d))) for x in (prefix, prefix + 1))
            size, several = int(total[j] - total[i]), keys[j] - keys[i] > 1
            if size <= capacity or not several or d == bits:
                buckets.append((prefix, d, size))
            elif d == level:
                more.append((prefix, d))
            else:
                depth = max(depth, d + 1)  # the directory doubles when its deepest bucket splits
                work += [(2 * prefix + 1, d + 1), (2 * prefix, d + 1)]
        open_, level = more, min(level + _STEP, bits)
    buckets.sort(key=lambda b: b[0] << (bits - b[1]))
    return depth, buckets


def slot(buckets: list[tuple[int, int, int]], key: np.ndarray, bits: int = KEY_BITS) -> np.ndarray:
    """The bucket of each key. A directory of 2^depth slots would repeat a bucket's number in all slots that begin with its
    prefix; the buckets' first keys in order say the same."""
    first = np.array([p << (bits - d) for p, d, _ in buckets], np.uint64)
    return np.searchsorted(first, key.view(np.uint64), side="right") - 1


def owners(buckets: list[tuple[int, int, int]], share: int) -> list[int]:
    """The owner of each bucket: consecutive buckets of about share bytes for each task."""
    out, owner, held = [], 0, 0
    for _, _, n in buckets:
        if held and held + n > share:
            owner, held = owner + 1, 0
        out.append(owner)
        held += n
    return out


def _entries(docs: DataFrame) -> DataFrame:
    """(k1, k2, text, id, n) of docs' texts: in a task each text once, with its least id (nulls last) and its rows.

    A task holds some 16 MB of texts and then begins anew, so a text may come several times from one task as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        held, schema = 0, None

        def out() -> pa.RecordBatch:
            k1, k2, text = zip(*found)
            ids, n = zip(*found.values())
            return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(text, pa.string()), pa.array(ids, schema.field("id").type), pa.array(n, pa.int64())], names=["k1", "k2", "text", "id", "n"])

        for batch in batches:
            schema = batch.schema
            for i, text, k1, k2 in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "k1", "k2"))):
                at = found.get((k1, k2, text))
                if at is None:
                    found[k1, k2, text] = [i, 1]
                    held += len(text) + 200
                else:
                    at[1] += 1
                    if i is not None and (at[0] is None or i < at[0]):
                        at[0] = i
            if held > _HELD:
                yield out()
                found, held = {}, 0
        if found:
            yield out()

    kinds = [("k1", T.LongType()), ("k2", T.LongType()), ("text", T.StringType()), ("id", docs.schema["id"].dataType), ("n", T.LongType())]
    return docs.select("id", "text", "k1", "k2").mapInArrow(run, T.StructType([T.StructField(*x) for x in kinds]))


def _chains(entries: DataFrame) -> DataFrame:
    """(k1, k2, kept, n, text) of the entries that one owner has in order of key: a row for every text of several rows;
    text is null where it is the only one of its key, as the key then names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chain, kind = None, {}, None

        def closed() -> list[tuple]:
            same: dict[int, int] = {}
            for k2, _ in chain:
                same[k2] = same.get(k2, 0) + 1
            return [(at, k2, i, n, text if same[k2] > 1 else None) for (k2, text), (i, n) in chain.items() if n > 1]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), kind, pa.int64(), pa.string()))], names=["k1", "k2", "kept", "n", "text"])

        for batch in batches:
            kind, out = batch.schema.field("id").type, []
            for k1, k2, text, i, n in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "id", "n"))):
                if k1 != at:
                    out += closed()
                    at, chain = k1, {}
                old = chain.get((k2, text))  # equal hash and equal bytes
                if old is None:
                    chain[k2, text] = (i, n)
                else:
                    chain[k2, text] = (min((x for x in (old[0], i) if x is not None), default=None), old[1] + n)
            yield batch_of(out)
        if kind is not None:
            yield batch_of(closed())

    kinds = [("k1", T.LongType()), ("k2", T.LongType()), ("kept", entries.schema["id"].dataType), ("n", T.LongType()), ("text", T.StringType())]
    return entries.select("k1", "k2", "text", "id", "n").mapInArrow(run, T.StructType([T.StructField(*x) for x in kinds]))


def _index(docs: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame, int]:
    """(entries, directory (bucket, prefix, depth, bytes, owner), owners): written tables of the texts whose key comes twice."""
    spark = docs.sparkSession
    twice = written(docs.groupBy("k1").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("k1"))
    some = KeyFilter(twice, "k1").passing(docs, "k1")
    entries = written(_entries(some.join(twice, "k1", "left_semi")))
    sized = entries.select("k1", F.octet_length("text").alias("bytes"))

    def sizes(d: int, parents: list[int]) -> dict[int, tuple[int, int]]:
        # a bucket over capacity has 2^8 parts at most, so this is little however many keys there are
        prefix = F.shiftrightunsigned("k1", 64 - d)
        if d > _STEP:
            up = spark.createDataFrame([(_signed(p),) for p in parents], "up long")
            got = sized.withColumn("up", F.shiftrightunsigned("k1", 64 - d + _STEP)).join(F.broadcast(up), "up")
        else:
            got = sized
        rows = got.groupBy(prefix.alias("p")).agg(F.sum("bytes").alias("b"), F.min("k1").alias("low"), F.max("k1").alias("high")).collect()
        return {r["p"] % (1 << 64): (r["b"], 1 + (r["low"] != r["high"])) for r in rows}

    depth, buckets = directory(sizes, capacity)
    own = owners(buckets, capacity)
    rows = [(i, _signed(p), d, n, o) for i, ((p, d, n), o) in enumerate(zip(buckets, own))]
    table = written(spark.createDataFrame(rows, "bucket int, prefix long, depth int, bytes long, owner int"))
    drop_written(twice)
    return entries, table, own[-1] + 1 if own else 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _owner_of(table: DataFrame) -> Callable[[Column], Column]:
    """The owner of a key by the directory, a row for each bucket of some 32 MB of repeated texts."""
    rows = table.orderBy("bucket").collect()
    buckets = [(r["prefix"] % (1 << 64), r["depth"], r["bytes"]) for r in rows]
    held = table.sparkSession.sparkContext.broadcast((buckets, np.array([r["owner"] for r in rows], np.int32)))

    @F.pandas_udf("int")
    def owner(keys: pd.Series) -> pd.Series:
        buckets, own = held.value
        return pd.Series(own[slot(buckets, keys.to_numpy())])

    return owner


def _goes(docs: DataFrame, capacity: int) -> DataFrame:
    """(id, kept, k1, k2, m) by distinct id and text of which m rows go; kept is the least id, nulls last, with those bytes.

    A written table; the index and what else was written on the way is deleted.
    """
    docs = docs.where("text IS NOT NULL")
    entries, table, tasks = _index(docs, capacity)
    owned = entries.withColumn("owner", _owner_of(table)(F.col("k1"))).repartitionById(tasks, "owner")
    chains = written(_chains(owned.sortWithinPartitions("k1", "k2")))
    rows = KeyFilter(chains, "k1").passing(docs, "k1")
    # texts move only where two different ones have one key of 128 bits
    apart = chains.where("text IS NOT NULL")
    found = rows.select("id", "k1", "k2").join(chains.where("text IS NULL").drop("text"), ["k1", "k2"])
    if not apart.isEmpty():
        found = found.unionByName(rows.select("id", "k1", "k2", "text").join(apart, ["k1", "k2", "text"]).drop("text"))
    counted = found.groupBy("id", "k1", "k2", "kept").agg(F.count(F.lit(1)).alias("rows"))
    m = F.col("rows") - F.col("id").eqNullSafe(F.col("kept")).cast("int")
    goes = written(counted.select("id", "kept", "k1", "k2", m.alias("m")).where("m > 0"))
    drop_written(entries, table, chains)
    return goes


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, kept_id): a row for every document that goes, beside the least id that has the same bytes.

    Null ids come last. A null text equals nothing and stays; empty texts equal each other, and very long ones are
    compared whole. Of rows that repeat an id and a text one stays, and kept_id equals doc_id for the others. capacity is
    the bytes of a bucket before it splits. Other columns are not read; their names don't matter. An empty table gives an
    empty result.
    """
    goes = _goes(keyed(docs, id_col, text_col), capacity)
    return goes.select(F.col("id").alias("doc_id"), F.col("kept").alias("kept_id"), F.explode(F.array_repeat(F.lit(1), F.col("m").cast("int"))).alias("one")).drop("one")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """docs with one row of each text, that of exact_duplicates(), all columns as they are; null texts all stay.

    Of rows that tie in id and text any one stays. An empty table gives an empty one.
    """
    goes = _goes(keyed(docs, id_col, text_col), capacity)
    same = F.col("id").eqNullSafe(F.col("kept"))
    return without(docs, id_col, text_col, goes.where(~same).select("id", "k1", "k2"), goes.where(same).select("id", "k1", "k2"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
SELECT doc_id, kept_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r
  FROM documents WHERE text IS NOT NULL)
WHERE r > 1
"""
