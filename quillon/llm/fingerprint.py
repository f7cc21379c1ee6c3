"""Document fingerprints: prefix polynomial hashes over the code points of a text.

The prefix array of a text is P[i] = sum of (c[j] + 1) * BASE^j for j < i, modulo two primes below 2^31, so P[n] is the
fingerprint of the whole text, and the spans [a, a+m) and [b, b+m) with a <= b are equal just when
(P[a+m] - P[a]) * BASE^(b-a) = P[b+m] - P[b] for both primes (62 bits). The longest common extension of two places is
found by a binary search on m, and the longest span that a text repeats by a binary search on its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillon.llm._batch import small_batches

PRIMES = (2147483647, 2147483629)
BASES = (1130773907, 1582439221)
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_pow[0]) < n:
        for k, (p, b) in enumerate(zip(PRIMES, BASES)):
            x = _pow[k]
            while len(x) < n:
                x = np.concatenate([x, x * np.uint64(pow(b, len(x), p)) % np.uint64(p)])
            _pow[k] = x
    return _pow


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefix:
    """The prefix arrays of one text."""

    def __init__(self, text: str):
        self.units = code_points(text)
        self.n = len(self.units)
        self.p = []
        powers = _powers(self.n + 1)
        for k, prime in enumerate(PRIMES):
            terms = (self.units.astype(np.uint64) + np.uint64(1)) * powers[k][: self.n] % np.uint64(prime)
            # terms are below 2^31, so the sums of 2^33 of them still fit
            self.p.append(np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)]) % np.uint64(prime))

    @property
    def fingerprint(self) -> int:
        """The 62 bits that name the whole text."""
        return int(self.p[0][self.n]) << 31 | int(self.p[1][self.n])

    def spans(self, starts: np.ndarray, length: int) -> np.ndarray:
        """The hash of each span of that length, brought to one common place so that equal spans have equal hashes."""
        out = None
        powers = _powers(self.n + 1)
        for k, prime in enumerate(PRIMES):
            p, m = self.p[k], np.uint64(prime)
            h = (p[starts + length] + m - p[starts]) % m * powers[k][self.n - starts] % m
            out = h if out is None else out << np.uint64(31) | h
        return out

    def equal(self, a: int, b: int, length: int) -> bool:
        """Whether the spans of that length at a and b are equal; spans beyond the text are not."""
        if max(a, b) + length > self.n or min(a, b, length) < 0:
            return False
        x = self.spans(np.array([a, b]), length)
        return bool(x[0] == x[1])

    def extension(self, a: int, b: int) -> int:
        """The longest length at which the spans at a and b are equal."""
        low, high = 0, self.n - max(a, b)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(a, b, middle) else (low, middle - 1)
        return low

    def word_starts(self) -> np.ndarray:
        """Places of units that are not white space after white space or the beginning."""
        u = self.units
        space = (u == 32) | ((u >= 9) & (u <= 13)) | (u == 133) | (u == 160) | (u == 0x3000) | ((u >= 0x2000) & (u <= 0x200A)) | (u == 0x2028) | (u == 0x2029)
        first = ~space
        first[1:] &= space[:-1]
        return np.flatnonzero(first)

    def longest_repeat(self) -> tuple[int, int, int]:
        """(length, first place, second place) of the longest span that begins at two words; (0, 0, 0) if there is none.

        Of the longest spans, that with the least second place, then the least first one.
        """
        starts = self.word_starts()
        if len(starts) < 2:
            return 0, 0, 0

        def pair(length: int) -> tuple[int, int] | None:
            at = starts[: np.searchsorted(starts, self.n - length, side="right")]
            if len(at) < 2:
                return None
            h = self.spans(at, length)
            order = np.argsort(h, kind="stable")
            same = np.flatnonzero(h[order][1:] == h[order][:-1])
            if not len(same):
                return None
            second = at[order[same + 1]].min()
            first = at[np.flatnonzero(h == h[np.searchsorted(at, second)])[0]]
            return int(first), int(second)

        # doubling finds the range, a binary search the length: most texts repeat a short span only
        low, high = 0, 1
        while high < self.n and pair(high):
            low, high = high, 2 * high
        high = min(high, self.n) - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if pair(middle) else (low, middle - 1)
        return (low, *pair(low)) if low else (0, 0, 0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True) -> DataFrame:
    """(doc_id, n_units, fingerprint[, repeat_len, repeat_a, repeat_b]), a row for every row of docs.

    n_units counts code points. The repeat is the longest span that begins at two word beginnings (it may overlap
    itself), 0 at 0 and 0 if no span does. An empty text has fingerprint 0 and no repeat; a null text has nulls in all
    but doc_id. Rows are independent, so ties and repeated rows give equal rows, and other columns are not read.
    """
    columns = ["n_units", "fingerprint"] + ["repeat_len", "repeat_a", "repeat_b"] * repeats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1):
                text = text.as_py()
                if text is None:
                    found.append((None,) * len(columns))
                    continue
                prefix = Prefix(text)
                found.append((prefix.n, prefix.fingerprint, *(prefix.longest_repeat() if repeats else ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (zip(*found) if found else [[]] * len(columns)))], names=["doc_id", *columns])

    source = small_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in columns)]))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def fingerprint_whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), repeats=False)


WHOLE_TEXTS_SQL = f"""
WITH units AS (
  SELECT doc_id, length(text) AS n_units, list_reverse([unicode(c)::BIGINT + 1 FOR c IN string_split(text, '')]) AS u
  FROM documents WHERE text IS NOT NULL),
hashed AS (
  SELECT doc_id, n_units,
    list_reduce(list_prepend(0::BIGINT, u), lambda h, c: (h * {BASES[0]} + c) % {PRIMES[0]}) AS h0,
    list_reduce(list_prepend(0::BIGINT, u), lambda h, c: (h * {BASES[1]} + c) % {PRIMES[1]}) AS h1
  FROM units)
SELECT doc_id, n_units, CASE WHEN n_units = 0 THEN 0 ELSE h0 * 2147483648 + h1 END AS fingerprint FROM hashed
"""
