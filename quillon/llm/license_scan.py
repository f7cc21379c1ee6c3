"""Licence texts in documents by diagonal voting.

Every window of k words of every document is hashed and joined with the windows of the templates. A hit at word d of the
document and word t of the template votes for the diagonal d - t: a licence that stands in a document whole gives all its
votes to one diagonal, and a word more or less in it moves the rest to a neighbouring one. Votes are counted by diagonal,
neighbouring diagonals are merged to spans, and each span's words are aligned with the template's to verify it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.llm._batch import KeyFilter, slices, utf8, windows, word_hashes, written
from quillon.llm._rows import keyed
from quillon.llm.license_texts import TEMPLATES

K, DRIFT, VOTES, SIMILARITY = 3, 8, 0.4, 0.8


def words_of(text: str) -> np.ndarray:
    """The hashes of a text's lower-case words."""
    found = [word_hashes(offsets, data)[0] for _, offsets, data in slices(utf8(pa.array([text], pa.string()), lower=True))]
    return found[0] if found else np.zeros(0, np.uint64)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    return windows(words, np.zeros(len(words), np.int64), 1, k, pad=False)[0].view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(length of the longest common subsequence, first and last place of it in a); of equal ones that with the latest
    beginning, so words before a span don't belong to it by chance."""
    # by row: the length so far and where in a it began and last matched
    n = len(b) + 1
    length, begin, end = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
    for i in range(len(a)):
        old_l, old_b, old_e = length.copy(), begin.copy(), end.copy()
        for j in np.flatnonzero(b == a[i]) + 1:
            start = old_b[j - 1] if old_l[j - 1] else i
            new = (old_l[j - 1] + 1, start)
            if new > (length[j], begin[j]):
                length[j], begin[j], end[j] = old_l[j - 1] + 1, start, i
        # carry the best to the right
        key = length * (len(a) + 2) + begin + 1
        best = np.maximum.accumulate(key)
        at = np.maximum.accumulate(np.where(key == best, np.arange(n), 0))
        length, begin, end = length[at], begin[at], end[at]
    return int(length[-1]), int(begin[-1]), int(end[-1])


def _hits(docs: DataFrame, spark: SparkSession, templates: dict[str, str], k: int) -> DataFrame:
    """(id, k1, k2, license, d, t): every window of every document that a template has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, data in slices(utf8(batch.column("text"), lower=True)):
                n = len(offsets) - 1
                h, rows, _ = windows(*word_hashes(offsets, data), n, k, pad=False)
                begin = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("k1"), part.column("k2"), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(h.view(np.int64)))], names=["id", "k1", "k2", "grams"])

    schema = T.StructType([docs.schema["id"], T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))])
    rolled = docs.select("id", "k1", "k2", "text").mapInArrow(run, schema).select("id", "k1", "k2", F.posexplode("grams").alias("d", "gram"))
    rows = [(int(g), name, t) for name, text in templates.items() for t, g in enumerate(grams(words_of(text), k))]
    # the templates are a few thousand words, however large the corpus
    return rolled.join(F.broadcast(spark.createDataFrame(rows, "gram long, license string, t int")), "gram").drop("gram")


def candidates(docs: DataFrame, templates: dict[str, str], k: int, drift: int, votes: float) -> DataFrame:
    """(id, k1, k2, spans): spans are (license, low, high, votes), the words low to high - 1 that may be the licence."""
    spark = docs.sparkSession
    # copies of a template in a row are a template's length apart: diagonals of two copies must not be neighbours
    near = {name: min(drift, len(words_of(text)) - 1) for name, text in templates.items()}
    need = {name: max(1, int(np.ceil(votes * (len(words_of(text)) - k + 1)))) for name, text in templates.items()}
    rows = ["id", "k1", "k2", "license"]
    diagonals = _hits(docs, spark, templates, k).withColumn("diagonal", F.col("d") - F.col("t")).groupBy(*rows, "diagonal").agg(F.collect_set("t").alias("t"), F.min("d").alias("low"), F.max("d").alias("high"))
    order = Window.partitionBy(*rows).orderBy("diagonal")
    by_license = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("license"))
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > by_license(near)).cast("int"), F.lit(1))
    merged = diagonals.withColumn("apart", apart).withColumn("run", F.sum("apart").over(order)).groupBy(*rows, "run").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("t"), F.min("low").alias("low"), F.max("high").alias("high"))
    spans = merged.where(F.size("t") >= by_license(need)).select(*rows, "low", (F.col("high") + k).alias("high"), F.size("t").alias("votes"))
    return spans.groupBy("id", "k1", "k2").agg(F.array_sort(F.collect_list(F.struct("license", "low", "high", "votes"))).alias("spans"))


def verify(words: np.ndarray, spans: list[dict], templates: dict[str, np.ndarray], similarity: float) -> list[tuple[str, int, int, int, float]]:
    """(license, first word, end, votes, similarity) of the spans that hold, the most similar first where they overlap."""
    found = []
    for s in spans:
        template = templates[s["license"]]
        room = max(4, len(template) // 8)
        # a run may hold several copies: what is left on both sides of one is aligned again
        work = [(max(0, s["low"] - room), min(len(words), s["high"] + room))]
        tried = {(s["low"], s["high"])}
        while work:
            low, high = work.pop()
            n, first, last = aligned(words[low:high], template)
            like = 2 * n / (len(template) + last + 1 - first) if n else 0.0
            while last + 1 - first > n > 1:  # a word at an end that stands apart from the rest is there by chance
                ends = [(first + 1, last + 1), (first, last)]
                shorter = [(a + low, *aligned(words[low + a : low + b], template)) for a, b in ends]
                m, a, b = max(((2 * c / (len(template) + j + 1 - i), start + i - low, start + j - low, c) for start, c, i, j in shorter if c), default=(0.0, 0, 0, 0))[:3]
                if m <= like:
                    break
                n, like, first, last = round(m * (len(template) + b + 1 - a) / 2), m, a, b
            if like >= similarity:
                found.append((round(like, 6), n, s["license"], low + first, low + last + 1, s["votes"]))
                tried.clear()
                work += [x for x in ((low, low + first), (low + last + 1, high)) if 2 * (x[1] - x[0]) >= similarity * len(template)]
            elif tried:  # words around the run may have drawn the alignment apart
                work.append(tried.pop())
    kept: list[tuple[str, int, int, int, float]] = []
    for like, _, name, low, high, n in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
        if all(high <= x[1] or low >= x[2] for x in kept):
            kept.append((name, low, high, n, like))
    return sorted(kept, key=lambda x: x[1])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, k: int = K, drift: int = DRIFT, votes: float = VOTES, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, license, first_word, end_word, votes, similarity), a row for every licence found in a row of docs.

    A span is looked at if at least that share of a template's windows of k words vote for it, on diagonals at most
    drift apart (less for a shorter template), and holds if twice the words in common with the template, in order, by the words of both is at least
    similarity. Of licences that overlap the most similar stays, ties by more words, then by name. Words are runs of
    letters and digits in lower case, counted from 0. Null and empty texts have no findings; repeated rows have theirs
    again. Templates shorter than k words find nothing. Very long texts are scanned whole. Other columns are not read, and
    an empty table gives an empty result.
    """
    source = keyed(docs, id_col, text_col)
    spans = written(candidates(source, templates, k, drift, votes))
    known = {name: words_of(text) for name, text in templates.items()}

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (text, of) in enumerate(zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())):
                for found in verify(words_of(text), of, known, similarity):
                    at.append(i)
                    rows.append(found)
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", "license", "first_word", "end_word", "votes", "similarity"])

    # texts without a span stay where they are: only those with one move to meet it
    texts = KeyFilter(spans, "k1").passing(source, "k1")
    on = [texts.k1 == spans.k1, texts.k2 == spans.k2, texts.id.eqNullSafe(spans.id)]
    both = texts.join(spans, on).select(texts.id.alias("id"), "text", "spans")
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("license", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("votes", T.LongType()), T.StructField("similarity", T.DoubleType())])
    return both.mapInArrow(check, out)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
