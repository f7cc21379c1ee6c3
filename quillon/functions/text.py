"""Text as Column expressions: tokens, stems, chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.config import EmbedConfig
from quillon.errors import InvalidConfig
from quillon.functions.stemmers import STEMMERS, english

TOKEN = r"([\p{L}\p{N}]+)"
#: What divides the words of chunks.
BLANK = " \t\n\f\r"


def tokens(text: Column | str, max_bytes: int = 40) -> Column:
    """Lower-case runs of letters and digits below max_bytes bytes; a null text gives null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1)), lambda t: F.octet_length(t) < max_bytes)


def stem(word: str, language: str = "english") -> str:
    """The stem of a lower-case word; an unknown language is stemmed as English."""
    return STEMMERS.get(language, english)(word)


def stems(words: Column | str, language: str = "english") -> Column:
    """The stems of an array of words, by Arrow batches; each distinct word of a batch is stemmed once."""

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        out = []
        for row in column:
            if row is None:
                out.append(None)
                continue
            for w in row:
                if w not in known:
                    known[w] = stem(w, language)
            out.append([known[w] for w in row])
        return pd.Series(out, index=column.index, dtype=object)

    return run(words)


def _check(size: int, overlap: int) -> int:
    if not 0 <= overlap < size:
        raise InvalidConfig("overlap must be at least 0 and below size")
    return size - overlap


def _starts(n: Column, size: int, step: int) -> Column:
    """0, step, ... so that the last chunk reaches the end and none lies in another."""
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * step)


def word_chunks(text: Column | str, size: int = EmbedConfig.chunk_size, overlap: int = EmbedConfig.chunk_overlap) -> Column:
    """Array of chunks of size words, overlap of them from the chunk before; [] for an empty text or one of spaces of any kind."""
    step = _check(size, overlap)
    text = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")
    # the words are computed once a row: a lambda variable holds them
    chunked = F.transform(F.array(words), lambda w: F.transform(_starts(F.size(w), size, step), lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " ")))[0]
    return F.when(F.coalesce(text, F.lit("")).rlike(r"\A\p{Zs}*\z"), F.array().cast("array<string>")).otherwise(chunked)


def char_chunks(text: Column | str, size: int, overlap: int) -> Column:
    """Array of chunks of size characters, overlap of them from the chunk before; [] for an empty text."""
    step = _check(size, overlap)
    text = F.col(text) if isinstance(text, str) else text
    chunked = F.transform(_starts(F.length(text), size, step), lambda i: F.substring(text, i + 1, F.lit(size)))
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.array().cast("array<string>")).otherwise(chunked)
