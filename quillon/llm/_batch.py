"""Arrow buffers as numpy arrays, word hashing over whole buffers, and the shared-folder tables of the operators.

Everything here runs vectorised over slices of a record batch: a slice holds whole texts and about ``limit`` bytes, so
the working set of a Python worker stays small however large a batch or however many rows it has.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, dtype=bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_":
    _WORD[_c] = True
_WORD[128:] = True
_powers: dict[int, np.ndarray] = {}


def fresh(df: DataFrame, base: str) -> str:
    """A column name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(df: DataFrame) -> DataFrame:
    """df, and Arrow batches of 4 MB at most from now on, where the session leaves that at its default of 64: a task holds a
    batch in the JVM, on the way and in Python, and a slice of work is smaller in any case."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) == "67108864b":
        conf.set(key, "4m")
    return df


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Where neither the session nor the context has one, a folder under the warehouse directory is set on a local master,
    as in tests; on a cluster that is an error, for no folder of one machine would do.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


_made: list[str] = []  # the folders of written() that are not deleted yet


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later plan reads."""
    for df in tables:
        for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
            _delete(df.sparkSession, path)
            name = path.rpartition("/")[2]
            _made[:] = [x for x in _made if x.rpartition("/")[2] != name]


def mark() -> int:
    """Where written() is now, for drop_since()."""
    return len(_made)


def drop_since(place: int, kept: DataFrame) -> None:
    """Deletes all that written() has made since mark() gave place, but for kept."""
    name = {p.rpartition("/")[0].rpartition("/")[2] for p in kept.inputFiles()}
    for path in _made[place:]:
        if path.rpartition("/")[2] not in name:
            _delete(kept.sparkSession, path)
    _made[place:] = [x for x in _made[place:] if x.rpartition("/")[2] in name]


#: The largest filter: 2^22 words of 64 bits, however many keys there are.
MOST_BITS = 28


class KeyFilter:
    """Which keys (longs) may be in a table, without a shuffle: 16 to 32 bits a key, 2^28 bits at most.

    The bits are a table of words that is broadcast to the scan, 4 million rows at most. Beyond 16 million keys it passes
    more and more of the others; what it passes must be joined with the keys in any case, so that costs shuffle and loses
    nothing.
    """

    def __init__(self, keys: DataFrame, key: str):
        self.bits = min(MOST_BITS, max(10, (32 * keys.count()).bit_length() - 1))
        place = self._place(F.col(key))
        words = keys.select(F.shiftright(place, 6).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")).alias("_bits"))
        self.words = words.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))

    def _place(self, key: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(key), 64 - self.bits)

    def split(self, df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """(rows whose key may be in the table, rows whose key surely isn't)."""
        word, bits = fresh(df, "_word"), fresh(df, "_bits")
        place = self._place(df[key])
        found = df.join(F.broadcast(self.words.toDF(word, bits)), F.shiftright(place, 6) == F.col(word), "left")
        hit = F.coalesce(F.call_function("shiftright", F.col(bits), place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1, F.lit(False))
        return tuple(found.where(x).drop(word, bits) for x in (hit, ~hit))

    def passing(self, df: DataFrame, key: str) -> DataFrame:
        """The rows whose key may be in the table."""
        return self.split(df, key)[0]


def utf8(column: pa.Array, lower: bool = False) -> pa.Array:
    """column as string with nulls as empty texts."""
    column = pc.fill_null(column, "")
    return pc.utf8_lower(column) if lower else column


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of whole texts with about limit bytes; column has no nulls."""
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        n = max(n, 2 * SLICE_BYTES)
        out = np.ones(n, np.uint64)
        done, step = 1, base
        while done < n:  # doubling: x[done:2 done] = x[:done] * base^done
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        _powers[base] = have = out
        if n > 8 * SLICE_BYTES:
            _powers.pop(base)
    return have


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of letters, digits, underscores) of a slice, and the row of each."""
    is_word = _WORD[data]
    brk = np.zeros(len(data) + 1, bool)
    brk[offsets] = True
    first, last = is_word.copy(), is_word
    first[1:] &= ~is_word[:-1] | brk[1:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | brk[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word of a slice, and its row."""
    starts, ends, rows = word_spans(offsets, data)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE_INV, len(data))[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * _power(_BASE, len(data))[starts]
    return mix(h + (ends - starts).astype(np.uint64)), rows


def windows(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int, pad: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k words in sequence: (hash, row, index of the first word in its row).

    With pad, a text of fewer than k words has one window of all its words; a text without words has none.
    """
    count = np.bincount(rows, minlength=n_rows)
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    place = np.arange(len(words)) - begin[rows]
    left = count[rows] - place
    at = np.flatnonzero((left >= k) | (place == 0 if pad else False))
    h = np.zeros(len(at), np.uint64)
    for t in range(k):
        inside = left[at] > t
        w = np.where(inside, words[np.minimum(at + t, len(words) - 1)], np.uint64(0)) if len(words) else h
        h = h * np.uint64(_BASE) + w * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    return mix(h), rows[at], place[at]
