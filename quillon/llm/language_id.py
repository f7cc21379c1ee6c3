"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 lower-case characters are hashed to 2^14 features. Document frequencies are counted over the whole
corpus. The classifier is fitted on a bounded sample of labelled documents by follow-the-regularised-leader with
elastic-net penalties, and a temperature fitted on held-out documents calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.llm._batch import fresh, mix, small_batches

BITS, ORDERS = 14, 3
FEATURES = 1 << BITS
_STEP = 1 << 17  # characters at a time


def _counts(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row, feature, count) by slice of rows, sorted by row and feature; text has no nulls.

    Runs of characters that are no letters count as one space, also before and after the text, so a text without
    letters has no features.
    """
    strings = text.to_pylist()
    i = 0
    while i < len(strings):
        j, size = i, 0
        while j < len(strings) and (j == i or size + len(strings[j]) <= _STEP):
            size += len(strings[j]) + 1
            j += 1
        # a separator ends each text, for lower-casing can change its length
        joined = "".join(s.replace("\0", " ").lower() + "\0" for s in strings[i:j])
        yield i, *_features(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), j - i)
        i = j


def _features(units: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = units == 0
    row = np.cumsum(cut) - cut  # the separator after a text belongs to it
    letter = ((units >= 97) & (units <= 122)) | (units >= 170)
    letter &= ~((units >= 0x2000) & (units <= 0x2BFF)) & (units != 0xD7) & (units != 0xF7) & (units != 171) & (units != 187) & (units != 191)
    u = np.where(letter, units, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each run of letters
    keep |= cut
    u, row = u[keep].astype(np.uint64), row[keep]
    n = len(u)
    keys = []
    for k in range(1, ORDERS + 1):
        if n < k:
            break
        h = np.full(n - k + 1, np.uint64(k))
        space = np.ones(n - k + 1, bool)
        for t in range(k):
            part = u[t : n - k + 1 + t]
            h = h * np.uint64(0x100000001B3) + part
            space &= part == 32
        inside = (row[: n - k + 1] == row[k - 1 :]) & ~space
        keys.append(row[: n - k + 1][inside].astype(np.int64) << BITS | (mix(h[inside]) >> np.uint64(64 - BITS)).astype(np.int64))
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    if rows * FEATURES <= 1 << 21:
        dense = np.bincount(key, minlength=1)
        key = np.flatnonzero(dense)
        count = dense[key]
    else:
        key, count = np.unique(key, return_counts=True)
    return key >> BITS, key & (FEATURES - 1), count


@dataclass
class Model:
    """What scoring needs: the classes, inverse document frequencies, weights (features x classes), bias, temperature."""

    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, row: np.ndarray, feature: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros((rows, len(self.classes)))
        if len(row):
            x = _tfidf(row, feature, count, rows, self.idf)
            w = self.weights[feature] * x[:, None]
            some, begin = np.unique(row, return_index=True)
            out[some] = np.add.reduceat(w, begin, axis=0)
        return out + self.bias


def _tfidf(row: np.ndarray, feature: np.ndarray, count: np.ndarray, rows: int, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[feature]
    norm = np.sqrt(np.bincount(row, x * x, minlength=rows))
    return x / norm[row]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader (proximal) for multinomial logistic regression; l1 makes the weights sparse."""

    def __init__(self, features: int, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def weights(self) -> np.ndarray:
        """The last row is the bias, which isn't penalised."""
        l1, l2 = np.full((len(self.z), 1), self.l1), np.full((len(self.z), 1), self.l2)
        l1[-1] = l2[-1] = 0
        shrunk = np.where(np.abs(self.z) <= l1, 0.0, self.z - np.sign(self.z) * l1)
        return -shrunk / ((self.beta + np.sqrt(self.n)) / self.alpha + l2)

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        """One batch: x is dense (rows x features + 1, the last column ones), y the class of each row."""
        w = self.weights()
        p = softmax(x @ w)
        p[np.arange(len(y)), y] -= 1
        g = x.T @ p / len(y)
        more = np.sqrt(self.n + g * g)
        self.z += g - (more - np.sqrt(self.n)) / self.alpha * w
        self.n += g * g


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean())

    a, b, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _document_frequency(text: DataFrame) -> tuple[np.ndarray, int]:
    """The number of documents with each feature, and of documents that have any, over all of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for _, row, feature, _ in _counts(pc.fill_null(batch.column(0), "")):
                df[:-1] += np.bincount(feature, minlength=FEATURES)
                df[-1] += len(np.unique(row))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["feature", "n"])

    total = np.zeros(FEATURES + 1, np.int64)
    found = text.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # 2^14 rows
    total[found["feature"]] = found["n"]
    return total[:-1], int(total[-1])


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", per_class: int = 600, epochs: int = 4, held_out: float = 0.25, seed: int = 7) -> Model | None:
    """Fits the model on up to per_class labelled documents of each label, those with the least hash of their text.

    That sample is the only bound: document frequencies are of all documents. Labels with fewer than two documents with
    letters are no class. Null labels and null texts are not used for fitting. None if no class is left.
    """
    source = small_batches(docs).select(docs[text_col].alias("text"), docs[label_col].cast("string").alias("label"))
    df, total = _document_frequency(source.select("text"))
    idf = np.log((1 + total) / (1 + df)) + 1
    labelled = source.where("label IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64(F.lit(seed), "text"))
    ranked = labelled.select("label", "h").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("r") <= per_class)
    limits = ranked.groupBy("label").agg(F.max("h").alias("top")).collect()
    if not limits:
        return None
    chosen: Column = F.lit(False)
    for r in limits:
        chosen = chosen | ((F.col("label") == r["label"]) & (F.col("h") <= r["top"]))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for first, row, feature, count in _counts(text):
                rows, begin = np.unique(row, return_index=True)
                ends = np.append(begin[1:], len(row))
                for r, a, b in zip(rows, begin, ends):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("label").slice(first + int(r), 1), batch.column("h").slice(first + int(r), 1), pa.array([feature[a:b].astype(np.int32).tobytes()], pa.binary()), pa.array([count[a:b].astype(np.int32).tobytes()], pa.binary())],
                        names=["label", "h", "f", "c"],
                    )

    sample = labelled.where(chosen).mapInArrow(features, "label string, h long, f binary, c binary").toPandas()
    # copies of one text tie in the hash; the sample has each text once
    sample = sample.drop_duplicates(["label", "h"]).sort_values(["label", "h"], ignore_index=True)
    sample = sample[sample.groupby("label")["h"].transform("size") >= 2].reset_index(drop=True)
    if not len(sample):
        return None
    classes = sorted(sample["label"].unique())
    y = sample["label"].map({c: i for i, c in enumerate(classes)}).to_numpy()
    rng = np.random.default_rng(seed)
    vectors = []
    for f, c in zip(sample["f"], sample["c"]):
        feature, count = np.frombuffer(f, np.int32), np.frombuffer(c, np.int32)
        vectors.append((feature, _tfidf(np.zeros(len(feature), int), feature, count, 1, idf)))

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), FEATURES + 1))
        x[:, -1] = 1
        for i, r in enumerate(rows):
            x[i, vectors[r][0]] = vectors[r][1]
        return x

    order = rng.permutation(len(y))
    out = order[: int(held_out * len(y))]
    fit = order[len(out) :]
    ftrl = Ftrl(FEATURES, len(classes))
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 24)):
            ftrl.step(dense(batch), y[batch])
    w = ftrl.weights()
    model = Model(classes, idf, w[:-1], w[-1])
    logits = np.concatenate([dense(b) @ w for b in np.array_split(out, max(1, len(out) // 64))]) if len(out) else np.zeros((0, len(classes)))
    model.temperature = fit_temperature(logits, y[out])
    return model


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with language and confidence; their names get underscores where docs has such columns already.

    confidence is the calibrated probability of language. Both are null where the text is null or has no letters, or if
    there is no model.
    """
    spark = docs.sparkSession
    names = fresh(docs, "language"), fresh(docs, "confidence")
    schema = T.StructType([*docs.schema, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    if model is None:
        return docs.withColumns({names[0]: F.lit(None).cast("string"), names[1]: F.lit(None).cast("double")})
    held = spark.sparkContext.broadcast(model)  # 2^14 x classes numbers, however large the corpus
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            best, sure = np.zeros(batch.num_rows, int), np.full(batch.num_rows, np.nan)
            for first, row, feature, count in _counts(pc.fill_null(batch.column(at), "")):
                some = np.unique(row)
                if len(some):
                    p = softmax(m.logits(row, feature, count, int(some[-1]) + 1) / m.temperature)[some]
                    best[first + some], sure[first + some] = p.argmax(axis=1), p.max(axis=1)
            none = np.isnan(sure)
            language = pa.DictionaryArray.from_arrays(pa.array(best, mask=none), pa.array(m.classes)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, language, pa.array(sure, mask=none)], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **training) -> DataFrame:
    """(doc_id, language, confidence), a row for every row of docs, by a model trained on its own labels.

    language and confidence are null for a null text and one without letters. Every text is scored whole, on its own, so
    repeated rows get equal answers and ties in probability go to the first class in order of name. Other columns are
    not read; their names don't matter. An empty table gives an empty result.
    """
    model = train(docs, text_col, label_col, **training)
    scored = score(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), model)
    return scored.select("doc_id", "language", F.round("confidence", 6).alias("confidence"))


def keep_identified(docs: DataFrame, text_col: str = "text", label_col: str = "lang", least: float = 0.4, **training) -> DataFrame:
    """docs whose language is known with a confidence of at least least; all columns as they are.

    Null texts and texts without letters go.
    """
    scored = score(docs, train(docs, text_col, label_col, **training), text_col)
    language, confidence = scored.columns[-2:]
    return scored.where(F.col(confidence) >= least).drop(language, confidence)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
