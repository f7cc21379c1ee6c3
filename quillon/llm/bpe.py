"""Byte-level BPE encoding and decoding with a public vocabulary.

Texts are split into pieces, and the pieces that a worker has not met yet are encoded together: bucketed by length, each
bucket is a padded matrix of token ids with a row for each piece. In every round each row merges its leftmost pair of
least rank; ranks come from a hash table of pairs held in two numpy arrays; the row then closes up, and rows without a
pair to merge leave the matrix. Pieces beyond the widest bucket are first divided between bytes that no token has side by
side, as nothing merges across them; a part that is still longer, such as a run of one letter, is a matrix of one row,
where a round takes at once all merges that would come one after the other with the same rank.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillon.llm._batch import mix, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, 256)
NONE = np.int32(2**31 - 1)
_SLICE = 1 << 18


class PairTable:
    """Rank by pair of ids: open addressing in two arrays, looked up for many pairs at once."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        todo, at = np.arange(len(keys)), self._place(keys)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]  # of several for one place, one gets it
            won = self.keys[at] == keys[todo]
            self.ranks[at[won]] = ranks[todo[won]]
            todo, at = todo[~won], at[~won] + 1 & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where there is none or an id is negative."""
        out = np.full(len(left), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[todo].astype(np.int64) << 32 | right[todo].astype(np.int64)
        at = self._place(keys)
        while len(todo):
            there = self.keys[at]
            hit = there == keys
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (there >= 0)
            todo, keys, at = todo[on], keys[on], at[on] + 1 & self.mask
        return out


class Bpe:
    """A vocabulary, read from a file of base64 token and rank by line, that encodes and decodes."""

    def __init__(self, path: str = VOCABULARY, cached: int = 300_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.pattern = regex.compile(PATTERN)
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_begin = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.beside = np.zeros((256, 256), bool)  # bytes that a token has side by side
        inner = np.ones(len(self.token_bytes), bool)
        inner[self.token_begin[:-1][np.diff(self.token_begin) > 0]] = False
        at = np.flatnonzero(inner)
        self.beside[self.token_bytes[at - 1], self.token_bytes[at]] = True
        self.table = PairTable(np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.cached = cached
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.begin, self.used = np.zeros(1 << 16, np.int32), [0], 0

    def _matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of pieces of at most width bytes: a padded row of ids for each."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        row = np.repeat(np.arange(n), size)
        column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        m = np.full((n, width + 1), -1, np.int32)  # a last column that stays empty
        m[row, column] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.table.find(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(n, width)
        done, left = np.full((n, width), -1, np.int32), size.copy()
        live = np.arange(n)
        columns = np.arange(width)
        while True:
            best = ranks.argmin(axis=1) if len(live) else np.zeros(0, int)  # the leftmost of least rank
            rank = ranks[np.arange(len(live)), best]
            going = rank != NONE
            if not going.all():
                done[live[~going]] = m[~going, :-1]
                live, m, ranks, best, rank = live[going], m[going], ranks[going], best[going], rank[going]
            if not len(live):
                return done, left
            at = np.arange(len(live))
            later = columns > best[:, None]
            m[:, :-1] = np.where(later, m[:, 1:], m[:, :-1])
            ranks[:, :-1] = np.where(later[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            m[at, best] = rank
            ranks[at, best] = self.table.find(rank, m[at, best + 1])
            before = np.flatnonzero(best > 0)
            ranks[before, best[before] - 1] = self.table.find(m[before, best[before] - 1], rank[before])
            left[live] -= 1

    def _row(self, piece: bytes) -> np.ndarray:
        """The ids of one long row. A round merges the leftmost pairs of least rank up to the first that makes a pair of a
        still lower rank, which would be next."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        ranks = self.table.find(ids[:-1], ids[1:])
        while len(ranks) and (rank := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == rank)
            begins = np.concatenate([[True], np.diff(at) > 1])
            at = at[(at - at[begins][np.cumsum(begins) - 1]) % 2 == 0]  # of pairs that overlap, every second
            same = np.full(len(at), rank, np.int32)
            left = np.where(at > 0, ids[at - 1], -1)
            left[1:] = np.where(np.diff(at) == 2, rank, left[1:])
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            lower = (self.table.find(left, same) < rank) | (self.table.find(same, right) < rank)
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            ids[at] = rank
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, ranks = ids[keep], ranks[keep[1:]]
            now = at - np.arange(len(at))  # where the merged ones are after the row has closed up
            for place in (now[now < len(ranks)], now[now > 0] - 1):
                ranks[place] = self.table.find(ids[place], ids[place + 1])
        return ids

    def _parts(self, piece: bytes) -> list[bytes]:
        """piece divided between bytes that no token has side by side."""
        data = np.frombuffer(piece, np.uint8)
        cut = [0, *(np.flatnonzero(~self.beside[data[:-1], data[1:]]) + 1).tolist(), len(piece)]
        return [piece[a:b] for a, b in zip(cut, cut[1:])]

    def _encoded(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of rows of bytes, in order."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        bucket = np.searchsorted(WIDTHS, size)
        n = np.zeros(len(raw), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # rows, their ids
        for k in np.unique(bucket):
            of = np.flatnonzero(bucket == k)
            if k == len(WIDTHS):
                for i in of:
                    ids = self._row(raw[i])
                    n[i] = len(ids)
                    found.append((of[of == i], ids))
                continue
            for some in np.array_split(of, -(-len(of) * WIDTHS[k] // (1 << 20)) or 1):
                m, n[some] = self._matrix([raw[i] for i in some], WIDTHS[k])
                found.append((some, m[m >= 0]))
        out = np.zeros(int(n.sum()), np.int32)
        begin = np.cumsum(n) - n
        for rows, ids in found:
            many = n[rows]
            out[np.repeat(begin[rows] - (np.cumsum(many) - many), many) + np.arange(len(ids))] = ids
        return out, n

    def _add(self, pieces: list[str]) -> None:
        """Encodes pieces and adds them to the known ones."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        if max(map(len, raw)) <= WIDTHS[-1]:
            return self._keep(pieces, *self._encoded(raw))
        parts = [self._parts(r) if len(r) > WIDTHS[-1] else [r] for r in raw]
        number: dict[bytes, int] = {}
        for of in parts:
            for x in of:
                number.setdefault(x, len(number))
        ids, n = self._encoded(list(number))
        begin = np.cumsum(n) - n
        row = np.fromiter((number[x] for of in parts for x in of), np.int64)
        many = n[row]
        whole = ids[np.repeat(begin[row] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        self._keep(pieces, whole, np.add.reduceat(many, np.cumsum([0, *map(len, parts)])[:-1]))

    def _keep(self, pieces: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.begin.extend((self.used + np.cumsum(n)).tolist())
        self.used += len(ids)

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text begins, and the end)."""
        split = [self.pattern.findall(t) for t in texts]
        new = {p for s in split for p in s if p not in self.known}
        if new:
            if len(self.known) + len(new) > self.cached:
                self._forget()
                new = {p for s in split for p in s}
            self._add(sorted(new))
        place = np.fromiter((self.known[p] for s in split for p in s), np.int64, sum(map(len, split)))
        begin = np.array(self.begin)
        size = begin[place + 1] - begin[place]
        out = np.cumsum(size)
        ids = self.ids[np.repeat(begin[place] - (out - size), size) + np.arange(out[-1] if len(out) else 0)]
        ends = np.concatenate([[0], out])[np.cumsum([0, *map(len, split)])]
        return ids, ends

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode_many(self, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each text begins, and the end) of ids as encode_many() gives them."""
        size = self.token_begin[ids + 1] - self.token_begin[ids]
        out = np.cumsum(size)
        data = self.token_bytes[np.repeat(self.token_begin[ids] - (out - size), size) + np.arange(out[-1] if len(out) else 0)]
        return data, np.concatenate([[0], out])[begin]

    def decode(self, ids: list[int]) -> str:
        at = np.array(ids, np.int64)
        return self.decode_many(at, np.array([0, len(at)]))[0].tobytes().decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def vocabulary(path: str) -> Bpe:
    """The vocabulary of a file, read once by a worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, tokens, round_trip), a row for every row of docs.

    round_trip tells whether decoding the tokens gives the text's bytes again. An empty text has no tokens; a null text
    has nulls in all but doc_id. Special tokens in a text are ordinary text. Rows are independent, so repeated rows give
    equal rows; other columns are not read. Very long texts and words are encoded whole; an empty table gives an empty
    result. path must exist on every executor.
    """
    source = small_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= _SLICE):
                    size += len(texts[j] or "")
                    j += 1
                some = [t or "" for t in texts[i:j]]
                ids, begin = bpe.encode_many(some)
                data, ends = bpe.decode_many(ids, begin)
                raw = [t.encode() for t in some]
                none = np.array([t is None for t in texts[i:j]])
                same = [data[ends[k] : ends[k + 1]].tobytes() == r for k, r in enumerate(raw)]
                tokens = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids), mask=pa.array(none))
                columns = [pa.array([len(r) for r in raw], pa.int64(), mask=none), pa.array(np.diff(begin), pa.int64(), mask=none), tokens, pa.array(same, mask=none)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["doc_id", "n_bytes", "n_tokens", "tokens", "round_trip"])
                i = j

    schema = T.StructType([source.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of arrays of tokens.

    A null array, one with a null and one with an id that is not in the vocabulary give a null text; an empty one gives
    the empty text. Bytes that are not UTF-8 become U+FFFD.
    """
    source = encoded.select(encoded[id_col].alias("doc_id"), encoded[tokens_col].cast("array<int>").alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                good = ids is not None and all(x is not None and 0 <= x < len(bpe.token_begin) - 1 for x in ids)
                texts.append(bpe.decode(ids) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("text", T.StringType())]))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
