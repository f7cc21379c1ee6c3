"""Order-preserving packing of documents into training windows by dynamic programming.

The corpus in order of id is one stream of words. It is cut into blocks of about block_words words at document ends, and
within a block a dynamic program chooses the windows: each holds at most window words and ends at a document's or a
sentence's end, or within a sentence that is longer than a window itself; the cost is the padding of all windows plus a
penalty for every document that a cut divides. The best predecessor of a place is the least of a sliding range, which a
monotone queue gives in constant time.

A first pass counts words; their running sums, over rows of a few bytes a document, tell where in the stream every task's
range of blocks begins. Then the texts move once, to the task of their range, which packs one block after the other.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm._batch import drop_written, slices, small_batches, utf8, written
from quillon.llm._rows import text_keys

WINDOW, SENTENCE_PENALTY, WORD_PENALTY, BLOCK_WORDS = 1024, 32, 256, 1 << 19
KINDS = ("document", "sentence", "word")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def sentence_words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each sentence, row of each sentence, where each word begins) of a slice.

    A word is a run of bytes that are no ASCII white space. A sentence ends with a word that ends in . ! or ? and before
    a line break.
    """
    space = _SPACE[data]
    brk = np.zeros(len(data) + 1, bool)
    brk[offsets] = True
    first = ~space
    first[1:] &= space[:-1] | brk[1:-1]
    last = ~space
    last[:-1] &= space[1:] | brk[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    if not len(starts):
        return rows, rows, starts
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    final = np.isin(data[ends], list(b".!?"))
    final[:-1] |= (breaks[starts[1:]] > breaks[ends[:-1]]) | (rows[1:] != rows[:-1])
    final[-1] = True
    at = np.flatnonzero(final)
    return np.diff(at, prepend=-1), rows[at], starts


def cuts(position: list[int], penalty: list[int], window: int) -> list[int]:
    """Indices of the chosen places, the last one included: consecutive chosen positions differ by at most window, and
    (window - difference) plus the penalty of each is least in sum. Of equal predecessors the earliest is taken.

    position ascends from above 0 in steps of at most window; the stream begins at 0 and ends at the last place.
    """
    n = len(position)
    best, back = [0] * n, [-1] * n
    queue: deque[tuple[int, int, int]] = deque([(0, 0, -1)])  # (best + position, position, index), values ascending
    for j in range(n):
        p = position[j]
        while p - queue[0][1] > window:
            queue.popleft()
        value, _, i = queue[0]
        back[j] = i
        value += window + penalty[j]  # best[j] + position[j]
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, p, j))
        best[j] = value
    chosen, j = [], n - 1
    while j >= 0:
        chosen.append(j)
        j = back[j]
    return chosen[::-1]


def places(sentences: list[np.ndarray], window: int, sentence_penalty: int, word_penalty: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, kind) of every place where a window may end, for the sentence lengths of each document in order."""
    size = np.concatenate(sentences).astype(np.int64)
    kind = np.ones(len(size), np.int8)
    kind[np.cumsum([len(s) for s in sentences]) - 1] = 0
    end = np.cumsum(size)
    if size.max() > window:  # every window-th word of a longer sentence
        more = (size - 1) // window
        inner = np.repeat(end - size, more) + window * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
        position = np.concatenate([end, inner])
        kind = np.concatenate([kind, np.full(len(inner), 2, np.int8)])
        order = np.argsort(position, kind="stable")
        return position[order], kind[order]
    return end, kind


def _weights(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What a document counts for a block's size: its words, or as many as its bytes would be at 16 a word."""
    return np.where(n > 0, np.maximum(n, size // 16), 0)


def _lengths(docs: DataFrame) -> DataFrame:
    """(id, k1, k2, weight) of the rows of (id, k1, k2, text) that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, data in slices(utf8(batch.column("text"))):
                size, rows, _ = sentence_words(offsets, data)
                n = np.bincount(rows, size, minlength=len(offsets) - 1).astype(np.int64)
                part = batch.slice(first, len(n))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("k1"), part.column("k2"), pa.array(_weights(n, np.diff(offsets)))], names=["id", "k1", "k2", "weight"])

    schema = T.StructType([docs.schema["id"], T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("weight", T.LongType())])
    return docs.select("id", "k1", "k2", "text").mapInArrow(run, schema).where("weight > 0")


def _key(i, k1: int, k2: int) -> tuple:
    return (0, 0, k1, k2) if i is None else (1, i, k1, k2)


def _ranges(docs: DataFrame, block_words: int, tasks: int) -> list[tuple[tuple, int]]:
    """(first key, its place in the stream) of each task's range, in order: about tasks ranges, cut where blocks begin."""
    order = [F.col("id").asc_nulls_first(), F.col("k1"), F.col("k2")]
    counted = _lengths(docs).groupBy("id", "k1", "k2").agg(F.sum("weight").alias("weight"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            upto = before + np.cumsum(batch.column("weight").to_numpy())
            start = np.concatenate([[before], upto[:-1]])[: len(upto)]
            before = int(upto[-1]) if len(upto) else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start, pa.int64()), pa.array(np.full(len(start), part, np.int32))], names=[*batch.schema.names, "start", "part"])

    schema = T.StructType([*counted.schema, T.StructField("start", T.LongType()), T.StructField("part", T.IntegerType())])
    held = written(counted.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(sums, schema))
    spark, total, offsets = docs.sparkSession, 0, []
    for r in held.groupBy("part").agg(F.sum("weight").alias("n")).orderBy("part").collect():  # a row for each range
        offsets.append((r["part"], total))
        total += r["n"]
    blocks = -(-total // block_words)
    several = max(1, blocks // max(tasks, blocks // 16)) if blocks else 1  # blocks of a task
    table = spark.createDataFrame(offsets, "part int, offset long")
    start = (F.col("start") + F.col("offset")).alias("start")
    placed = held.join(F.broadcast(table), "part").select("id", "k1", "k2", start).withColumn("range", F.floor(F.col("start") / (block_words * several)))
    rows = placed.groupBy("range").agg(F.min_by(F.struct("id", "k1", "k2", "start"), "start").alias("x")).orderBy("range").select("x.*").collect()  # a row for each task
    drop_written(held)
    return [(_key(r["id"], r["k1"], r["k2"]), r["start"]) for r in rows]


def _range_of(spark: SparkSession, ranges: list[tuple[tuple, int]]) -> Callable[[Column, Column, Column], Column]:
    """The range that a key (id, k1, k2) lies in."""
    held = spark.sparkContext.broadcast([k for k, _ in ranges])

    @F.pandas_udf("int")
    def find(key: pd.DataFrame) -> pd.Series:
        first = held.value
        keys = zip(key["id"].astype(object).where(key["id"].notna(), None), key["k1"], key["k2"])
        return pd.Series([max(0, bisect_right(first, _key(i, a, b)) - 1) for i, a, b in keys], dtype="int32")

    return lambda i, k1, k2: find(F.struct(i.alias("id"), k1.alias("k1"), k2.alias("k2")))


def _packed(ids: pa.Array, place: np.ndarray, text: pa.Array, block: int, window: int, penalties: tuple[int, int]) -> pa.RecordBatch:
    """The windows of one block's documents; place is each one's first place in the stream, all have words."""
    ((_, offsets, data),) = slices(text, limit=1 << 62)
    size, rows, word = sentence_words(offsets, data)
    count = np.bincount(rows, minlength=len(text))
    position, kind = places(np.split(size, np.cumsum(count)[:-1]), window, *penalties)
    costs = np.array([0, *penalties])[kind]
    at = np.array(cuts(position.tolist(), costs.tolist(), window))
    end = position[at]
    start = np.concatenate([[0], end[:-1]])
    doc_end = np.cumsum(np.bincount(rows, size, minlength=len(text)).astype(np.int64))
    doc_start = np.concatenate([[0], doc_end[:-1]])
    first = np.searchsorted(doc_end, start, side="right")
    many = np.searchsorted(doc_start, end, side="left") - first
    doc = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    low, high = np.maximum(np.repeat(start, many), doc_start[doc]), np.minimum(np.repeat(end, many), doc_end[doc])
    # the parts in order tile the texts: each begins with its first word, a document's first with the document
    begin = np.where(low == doc_start[doc], offsets[doc], word[low])
    pieces = pa.StringArray.from_buffers(len(doc), pa.py_buffer(np.append(begin, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    parts = pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(place[doc]), pa.array(low - doc_start[doc]), pa.array(high - doc_start[doc]), pieces], names=["doc_id", "place", "first", "last", "text"])
    n = len(at)
    columns = {
        "block": pa.array(np.full(n, block), pa.int64()),
        "window": pa.array(np.arange(n), pa.int32()),
        "n_words": pa.array(end - start, pa.int32()),
        "padding": pa.array(window - (end - start), pa.int32()),
        "cut": pa.array(np.array(KINDS, dtype=object)[kind[at]], pa.string()),
        "parts": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), parts),
    }
    return pa.RecordBatch.from_pydict(columns)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, sentence_penalty: int = SENTENCE_PENALTY, word_penalty: int = WORD_PENALTY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, window, n_words, padding, cut, parts), a row for every window.

    parts are (doc_id, place, first, last, text): words first to last - 1 of that document with the white space after
    them, in order of id (nulls first, ties by text; repeated rows are all packed). The texts of a document's parts, put
    together, are the document's text. place is the document's first place in the stream, which no other row has, so it
    tells rows apart whose ids repeat. cut tells where the window ends: at a document's end, a sentence's, or within a
    sentence longer than a window. Each block is packed on its own to the least padding plus penalties; a block begins
    with the first document that starts in its block_words places, so a very long document makes its block longer; a
    document whose words are longer than 16 bytes on average takes more places, so that blocks are bounded in bytes. Null
    and empty texts and texts of white space have no words and are in no window. Other columns are not read; an empty
    table gives no windows.
    """
    k1, k2 = text_keys(docs[text_col])
    source = small_batches(docs).select(docs[id_col].alias("id"), docs[text_col].alias("text"), k1.alias("k1"), k2.alias("k2"))
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType
    ranges = _ranges(source, block_words, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = spark.sparkContext.broadcast([start for _, start in ranges])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, -1
        buffer: list[tuple[pa.Array, np.ndarray, pa.Array]] = []

        def flush() -> pa.RecordBatch:
            ids, place, text = zip(*buffer)
            buffer.clear()
            return _packed(pa.concat_arrays(ids), np.concatenate(place), pa.concat_arrays(text), now, window, (sentence_penalty, word_penalty))

        for batch in batches:
            if not batch.num_rows:
                continue
            if at is None:
                at = held.value[batch.column("range")[0].as_py()]
            for first, offsets, data in slices(batch.column("text")):
                size, rows, _ = sentence_words(offsets, data)
                n = np.bincount(rows, size, minlength=len(offsets) - 1).astype(np.int64)
                weight = _weights(n, np.diff(offsets))
                place = at + np.cumsum(weight) - weight
                at += int(weight.sum())
                some = np.flatnonzero(n)
                part = batch.slice(first, len(n)).take(pa.array(some))
                block = place[some] // block_words
                for group in np.split(np.arange(len(some)), np.flatnonzero(np.diff(block)) + 1):
                    if not len(group):
                        continue
                    if buffer and block[group[0]] != now:
                        yield flush()
                    now = int(block[group[0]])
                    piece = part.slice(int(group[0]), len(group))
                    buffer.append((piece.column("id"), place[some][group], piece.column("text")))
        if buffer:
            yield flush()

    part = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in ("place", "first", "last")), T.StructField("text", T.StringType())])
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("window", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("padding", T.IntegerType()), T.StructField("cut", T.StringType()), T.StructField("parts", T.ArrayType(part))])
    if not ranges:
        return spark.createDataFrame([], schema)
    moved = source.where("text IS NOT NULL").withColumn("range", _range_of(spark, ranges)(F.col("id"), F.col("k1"), F.col("k2")))
    owned = moved.repartitionById(len(ranges), "range").sortWithinPartitions("range", F.col("id").asc_nulls_first(), "k1", "k2")
    return owned.select("range", "id", "text").mapInArrow(run, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
