"""Full-text search: an inverted index as tables, BM25, terms, phrases, edit distance and a query language.

The index is postings (bucket, field, term, id, tf, length, positions), lengths (field, id, length; bucket -1), terms (bucket, field,
term, df) and stats (field, n, tokens). It is built once, in one pass over the texts: every task writes the postings of its
texts where it makes them, in runs sorted by term, and small pages. No posting is shuffled or sorted outside a run; of a run
a search reads the pages of its terms, so what it shuffles is the postings of the query, not the corpus. bucket is a hash of
the term, which is -1 for lengths. Scores are
ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)), summed over terms
and fields; they are rounded before ranking and ties go to the lower id. Lengths are exact.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.config import TextConfig
from quillon.errors import InvalidQuery
from quillon.functions.text import stem, stems, tokens

PLACES, BUCKETS = 6, 64
#: Words of a run, which a task counts at once, bytes of an Arrow batch while an index is written, and rows of a page of it.
_WORDS, _BATCH_BYTES, _PAGE = 1 << 18, 4 << 20, 2000
#: Rows of terms, or words of queries, up to which they go to every task.
_ASKED = 1 << 18


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_of(term: str) -> int:
    """As _bucket(), for one term on the driver."""
    return _signed(xxhash.xxh64_intdigest(term.encode(), 42)) % BUCKETS


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, term, id, tf, length, positions) of (field, id, words), in runs sorted by term: each in one sort of its words' numbers.

    Every document and field has a row without a term as well, which tells the length of those that have no words, too.
    """
    for batch in batches:
        lists = batch.column("words")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        a = 0
        while a < len(lists):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _WORDS, side="right")) - 1)
            size = np.diff(offsets[a : b + 1])
            coded = lists.values.slice(offsets[a], offsets[b] - offsets[a]).dictionary_encode()
            by_term = pc.sort_indices(coded.dictionary)
            place = np.empty(len(by_term), np.int64)
            place[by_term.to_numpy()] = np.arange(len(by_term))
            terms, code = coded.dictionary.take(by_term), place[coded.indices.to_numpy()]
            row = np.repeat(np.arange(b - a), size)
            key = code * (b - a) + row
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            ends = np.append(first, len(key))
            at = row[order[first]]
            positions = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size))[order]
            part = batch.slice(a, b - a)
            columns = [part.column("field").take(pa.array(at)), terms.take(pa.array(code[order[first]])), part.column("id").take(pa.array(at)), pa.array(np.diff(ends)), pa.array(size[at]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(positions.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=["field", "term", "id", "tf", "length", "positions"])
            n = b - a
            empty = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1), pa.int32()), pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("field"), pa.nulls(n, pa.string()), part.column("id"), pa.array(np.zeros(n, np.int64)), pa.array(size), empty], names=["field", "term", "id", "tf", "length", "positions"])
            a = b


def _sent(df: DataFrame, asked: DataFrame) -> DataFrame:
    """df, as what goes to the postings in every task unless asked, which tells how large it is, has very many rows: its size
    on disk is no measure of what a condition leaves of it, and else all postings move to meet it."""
    return F.broadcast(df) if asked.limit(_ASKED + 1).count() <= _ASKED else df


def _postings(rows: DataFrame) -> DataFrame:
    return rows.where("bucket >= 0")


def _lengths(rows: DataFrame) -> DataFrame:
    return rows.where("bucket < 0").select("field", "id", "length")


@dataclass
class TextIndex:
    """config tells how texts were analysed; queries are analysed alike. stored is (id, ...), the fields that hits show."""

    postings: DataFrame
    lengths: DataFrame
    config: TextConfig
    terms: DataFrame | None = None
    totals: DataFrame | None = None
    stored: DataFrame | None = None
    rows: DataFrame | None = None  # postings and lengths as one table, lengths in bucket -1 without a term

    def __post_init__(self) -> None:
        if self.terms is None:
            self.terms = self.postings.groupBy("bucket", "field", "term").agg(F.count(F.lit(1)).alias("df"))
        if self.totals is None:
            self.totals = self.lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"))

    @staticmethod
    def build(docs: DataFrame, fields: dict[str, str] | None = None, id_col: str = "id", config: TextConfig = TextConfig(), stored: list[str] | None = None) -> "TextIndex":
        """fields names the column of each field: strings, or arrays of strings whose values are indexed one after another.

        Null texts are not indexed. stored are columns that with_fields() gives back.
        """
        fields = fields or {f: f for f in config.fields if f in docs.columns}
        if not fields:
            raise InvalidQuery("no field to index")
        parts = []
        for field, column in fields.items():
            array = docs.schema[column].dataType.typeName() == "array"
            words = F.flatten(F.transform(column, lambda t: tokens(t, config.max_token_bytes))) if array else tokens(column, config.max_token_bytes)
            if config.stemming:
                words = stems(words, config.stemming)
            parts.append(docs.select(F.lit(field).alias("field"), F.col(id_col).alias("id"), words.alias("words")))
        analysed = parts[0]
        for p in parts[1:]:
            analysed = analysed.unionByName(p)
        analysed = analysed.where("words IS NOT NULL")
        schema = T.StructType([T.StructField("field", T.StringType()), T.StructField("term", T.StringType()), docs.select(F.col(id_col).alias("id")).schema["id"], T.StructField("tf", T.LongType()), T.StructField("length", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
        rows = analysed.mapInArrow(_counted, schema).select(F.when(F.col("term").isNull(), -1).otherwise(_bucket(F.col("term"))).alias("bucket"), "*")
        kept = docs.select(F.col(id_col).alias("id"), *stored) if stored else None
        return TextIndex(_postings(rows), _lengths(rows), config, stored=kept, rows=rows)

    def write(self, path: str) -> "TextIndex":
        """The index as tables. Rows are written where they are; those of no single build() are sorted by term there first."""
        spark = self.postings.sparkSession
        rows = self.rows
        if rows is None:
            bare = [F.lit(-1).alias("bucket"), "field", F.lit(None).cast("string").alias("term"), "id", F.lit(0).cast("long").alias("tf"), "length", F.array().cast("array<int>").alias("positions")]
            rows = self.postings.select("bucket", "field", "term", "id", "tf", "length", "positions").unionByName(self.lengths.select(*bare)).sortWithinPartitions("term", "field", "id")
        limit = "spark.sql.execution.arrow.maxBytesPerBatch"
        before = spark.conf.get(limit)
        spark.conf.set(limit, str(_BATCH_BYTES))
        try:
            rows.write.mode("overwrite").option("parquet.page.row.count.limit", _PAGE).parquet(f"{path}/postings")
        finally:
            spark.conf.set(limit, before)
        back = spark.read.parquet(f"{path}/postings")
        held = _postings(back)
        held.groupBy("bucket", "field", "term").agg(F.count(F.lit(1)).alias("df")).sortWithinPartitions("term").write.mode("overwrite").option("parquet.page.row.count.limit", _PAGE).parquet(f"{path}/terms")
        if self.stored is not None:
            self.stored.write.mode("overwrite").parquet(f"{path}/stored")
        TextIndex(held, _lengths(back), self.config).totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
        return TextIndex.read(spark, path, self.config, self.stored is not None)

    @staticmethod
    def read(spark: SparkSession, path: str, config: TextConfig = TextConfig(), stored: bool = False) -> "TextIndex":
        at = lambda name: spark.read.parquet(f"{path}/{name}")
        rows = at("postings")
        return TextIndex(_postings(rows), _lengths(rows), config, at("terms"), at("totals"), at("stored") if stored else None, rows)

    def analyse(self, text: str) -> list[str]:
        words = [t for t in re.findall(r"[^\W_]+", text.lower()) if len(t.encode()) < self.config.max_token_bytes]
        return [stem(w, self.config.stemming) for w in words] if self.config.stemming else words

    def delete(self, ids: DataFrame) -> "TextIndex":
        """The index without the documents of ids (id)."""
        gone = ids.select("id").distinct()
        left = lambda df: None if df is None else df.join(gone, "id", "left_anti")
        return TextIndex(left(self.postings), left(self.lengths), self.config, stored=left(self.stored))

    def add(self, other: "TextIndex") -> "TextIndex":
        stored = self.stored.unionByName(other.stored) if self.stored is not None and other.stored is not None else self.stored or other.stored
        return TextIndex(self.postings.unionByName(other.postings), self.lengths.unionByName(other.lengths), self.config, stored=stored)

    def num_docs(self) -> int:
        return self.lengths.select("id").distinct().count()

    def stats(self) -> DataFrame:
        """(field, n_docs, n_tokens, mean_length)."""
        return self.totals.select("field", F.col("n").alias("n_docs"), F.col("tokens").alias("n_tokens"), F.round(F.col("tokens") / F.col("n"), PLACES).alias("mean_length"))

    def with_fields(self, found: DataFrame) -> DataFrame:
        """found (id, ...) with the stored fields of its documents."""
        if self.stored is None:
            raise InvalidQuery("the index has no stored fields")
        return found.join(self.stored, "id", "left")

    # scores

    def _of(self, table: DataFrame, terms: list[str], fields: list[str] | None) -> DataFrame:
        """The rows of table that are of terms, read from their pages only."""
        terms = sorted(set(terms))
        here = F.col("bucket").isin(sorted({bucket_of(t) for t in terms})) & F.col("term").isin(terms)
        return table.where(here & F.col("field").isin(fields) if fields else here)

    def _weighted(self, found: DataFrame, terms: DataFrame, *more: str) -> DataFrame:
        """(more..., term, field, id, score) of postings, terms being the (few) rows of the terms table that they have."""
        k1, b = F.lit(float(self.config.k1)), F.lit(float(self.config.b))
        totals = self.totals.select("field", "n", (F.col("tokens") / F.col("n")).alias("mean"))  # a row a field
        both = found.join(terms.select("field", "term", "df"), ["field", "term"]).join(F.broadcast(totals), "field")
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        return both.select(*more, "term", "field", "id", (idf * weight).alias("score"))

    def scored(self, terms: list[str], fields: list[str] | None = None) -> DataFrame:
        """(term, field, id, score) for the postings of analysed terms."""
        found = self._of(self.postings, terms, fields).select("field", "term", "id", "tf", "length")
        return self._weighted(found, F.broadcast(self._of(self.terms, terms, fields)))  # a row for each term of the query and field

    @staticmethod
    def top(scored: DataFrame, k: int | None, min_score: float | None = None) -> DataFrame:
        """(id, score) of the k best, then those below min_score left out."""
        total = scored.groupBy("id").agg(F.round(F.sum("score"), PLACES).alias("score"))
        if k is not None:
            total = total.orderBy(F.desc("score"), "id").limit(k)
        return total.where(F.col("score") >= min_score) if min_score is not None else total

    def search(self, query: str, k: int | None = 10, fields: list[str] | None = None, min_score: float | None = None) -> DataFrame:
        """(id, score) of the k best documents with any of the query's words; a blank query finds none."""
        return self.top(self.scored(self.analyse(query), fields), k, min_score)

    def search_many(self, queries: DataFrame, k: int = 10, fields: list[str] | None = None) -> DataFrame:
        """(query_id, id, score, rank): search() for a table of queries (query_id, query) in one plan.

        A posting is scored once, and then meets the queries that have its term. Words of queries and their terms go to the
        postings, unless they are very many; every task adds up what it has of a query and document before these meet, and
        ranks its part before the k best of a query meet.
        """
        words = tokens("query", self.config.max_token_bytes)
        asked = queries.select("query_id", F.explode(F.array_distinct(stems(words, self.config.stemming) if self.config.stemming else words)).alias("term"))
        asked = asked.distinct()
        wanted = lambda table: table.where(F.col("field").isin(fields)) if fields else table
        terms = wanted(self.terms).join(asked.select("term").distinct(), "term", "left_semi").select("field", "term", "df")
        scored = self._weighted(wanted(self.postings).select("field", "term", "id", "tf", "length"), _sent(terms, asked))
        total = scored.join(_sent(asked, asked), "term").groupBy("query_id", "id").agg(F.round(F.sum("score"), PLACES).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return total.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def term(self, field: str, term: str, k: int = 10) -> DataFrame:
        """(id, score) of the documents with one word in one field."""
        if not self.totals.where(F.col("field") == field).head(1):
            raise InvalidQuery(f"unknown field: {field}")
        return self.top(self.scored(self.analyse(term), [field]), k)

    def phrase_matches(self, phrase: str, field: str = "text") -> DataFrame:
        """(id, length, n): how often the words of phrase stand in sequence, in documents of that length."""
        words = self.analyse(phrase)
        found = self._of(self.postings, words or [""], [field])
        # a document's postings of these words meet in one row; an offset's positions are shifted to the phrase's beginning
        by_term = found.groupBy("id").agg(F.first("length").alias("length"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
        starts = F.array().cast("array<int>")
        for i, w in enumerate(words):
            shift = F.lit(i)
            here = F.transform(F.col("at")[w], lambda p: p - shift)  # evaluated at once, so shift is this word's
            starts = F.array_intersect(starts, here) if i else here
        return by_term.select("id", "length", F.size(starts).cast("long").alias("n")).where("n > 0")

    def phrase(self, phrase: str, k: int = 10, field: str = "text") -> DataFrame:
        """(id, score) of the documents that have phrase, scored by BM25 with the phrase's frequency as tf and the sum of its
        words' idf."""
        return self.top(self._phrase_scores(phrase, field), k)

    def _phrase_scores(self, phrase: str, field: str) -> DataFrame:
        words = self.analyse(phrase)
        df = self._of(self.terms, words or [""], [field]).select("term", "df")
        corpus = self.totals.where(F.col("field") == field).select("n", (F.col("tokens") / F.col("n")).alias("mean"))
        times = {w: words.count(w) for w in set(words)}
        repeat = F.element_at(F.create_map(*[F.lit(x) for p in sorted(times.items()) for x in p]), F.col("term")) if times else F.lit(0)
        each = (F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * repeat).alias("idf")
        ordered = F.array_sort(F.collect_list("idf"))
        idf = df.crossJoin(F.broadcast(corpus)).select(each, "n", "mean").groupBy("n", "mean").agg(F.aggregate(ordered, F.lit(0.0), lambda s, x: s + x).alias("idf"))  # one row
        k1, b = F.lit(float(self.config.k1)), F.lit(float(self.config.b))
        both = self.phrase_matches(phrase, field).withColumnRenamed("n", "tf").crossJoin(F.broadcast(idf))
        weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        return both.select(F.lit(f'"{phrase}"').alias("term"), F.lit(field).alias("field"), "id", (F.col("idf") * weight).alias("score"))

    def _some(self, which: Callable[[DataFrame], DataFrame], fields: list[str] | None) -> DataFrame:
        """scored() for the terms that which takes from the terms table: joined, not collected."""
        terms = which(self.terms.where(F.col("field").isin(fields)) if fields else self.terms).select("field", "term", "df")
        return self._weighted(self.postings.select("field", "term", "id", "tf", "length"), _sent(terms, terms))

    def fuzzy_terms(self, word: str, most: int = 1, field: str | None = None) -> DataFrame:
        """(term, edits): the terms of the index within that many edits."""
        terms = self.terms.where(F.col("field") == field) if field else self.terms
        near = terms.select("term").distinct().withColumn("edits", F.levenshtein("term", F.lit(word), most))
        return near.where("edits >= 0")

    def fuzzy(self, query: str, k: int = 10, most: int = 1, fields: list[str] | None = None) -> DataFrame:
        """(id, score): search() for all terms within most edits of the query's words."""
        words = self.analyse(query)
        near = F.lit(False)
        for w in words:
            near = near | (F.levenshtein("term", F.lit(w), most) >= 0)
        return self.top(self._some(lambda t: t.where(near), fields), k)

    # the query language

    def boolean(self, query: str, k: int | None = 10, fields: list[str] | None = None) -> DataFrame:
        """(id, score) of a query in the language that parse() reads.

        Documents must match every required clause of a group and no forbidden one, and a clause at least; the score is
        the sum over the clauses that match, times their boosts. A group of forbidden clauses alone matches nothing.
        """
        node = parse(query)
        found = self._evaluate(node, fields)
        return self.top(found if found is not None else self.scored([""]).select("id", "score"), k)

    def _evaluate(self, node: "Node", fields: list[str] | None) -> DataFrame | None:
        """(id, score), not yet summed by id for a leaf; None if nothing can match."""
        own = [node.field] if node.field else fields
        if node.kind == "group":
            return self._group(node, own)
        if node.kind == "phrase":
            found = None
            for field in own or self._field_names():
                part = self._phrase_scores(node.text, field)
                found = part if found is None else found.unionByName(part)
        elif node.kind == "all":
            found = self.lengths.select("id").distinct().withColumn("score", F.lit(1.0))
        elif node.kind == "prefix":
            prefix = F.lit(node.text.lower())
            found = self._some(lambda t: t.where(F.col("term").startswith(prefix)), own)
        elif node.kind == "range":
            low, high, open_low, open_high = node.bounds
            inside = F.lit(True)
            if low != "*":
                inside = inside & ((F.col("term") > low.lower()) if open_low else (F.col("term") >= low.lower()))
            if high != "*":
                inside = inside & ((F.col("term") < high.lower()) if open_high else (F.col("term") <= high.lower()))
            found = self._some(lambda t: t.where(inside), own).select("id").distinct().withColumn("score", F.lit(1.0))
        else:
            words = self.analyse(node.text)
            if not words:
                return None
            found = self.scored(words, own)
        return found.select("id", (F.col("score") * node.boost).alias("score"))

    def _field_names(self) -> list[str]:
        return sorted(r["field"] for r in self.totals.select("field").collect())

    def _group(self, node: "Node", fields: list[str] | None) -> DataFrame | None:
        both = None
        for i, clause in enumerate(node.clauses):
            found = self._evaluate(clause, fields)
            if found is None:
                if clause.mode == "+":
                    return None
                continue
            part = found.withColumn("clause", F.lit(i))
            both = part if both is None else both.unionByName(part)
        if both is None or not any(c.mode != "-" for c in node.clauses):
            return None
        matched = both.groupBy("id").agg(F.collect_set("clause").alias("clauses"), F.collect_list(F.struct("clause", "score")).alias("s"))
        for i, c in enumerate(node.clauses):
            has = F.array_contains("clauses", i)
            if c.mode:
                matched = matched.where(has if c.mode == "+" else ~has)
        forbidden = [i for i, c in enumerate(node.clauses) if c.mode == "-"]
        scores = matched.select("id", F.explode("s").alias("s")).where(~F.col("s.clause").isin(forbidden) if forbidden else F.lit(True))
        return scores.select("id", (F.col("s.score") * node.boost).alias("score"))


@dataclass
class Node:
    """kind is word, phrase, prefix, range, all or group; mode is + for required, - for forbidden within the group."""

    kind: str
    text: str = ""
    clauses: tuple["Node", ...] = ()
    field: str | None = None
    mode: str = ""
    boost: float = 1.0
    bounds: tuple[str, str, bool, bool] | None = None


_LEXEME = re.compile(r'\s+|(?P<sign>[+-])(?=\S)|(?P<open>\()|(?P<close>\))|(?P<field>\w+):(?=\S)|"(?P<quoted>[^"]*)"|(?P<low>[\[{])\s*(?P<from>\S+)\s+TO\s+(?P<to>[^\s\]}]+)\s*(?P<high>[\]}])|\^(?P<boost>\d+(?:\.\d+)?)|(?P<word>[^\s()"^]+)|.')


def parse(query: str) -> Node:
    """The tree of a query of words, "phrases", prefix*, [low TO high] and {low TO high} ranges of words, *, field:x, x^2,
    +must, -must not, parentheses, and AND, OR, NOT. AND binds closer than OR, and makes its sides required where the group
    has no OR; side by side is either. Any text is a query: a
    parenthesis too many is left out, one too few is added at the end.
    """
    lexemes = [m for m in _LEXEME.finditer(query) if m.lastgroup]
    at = 0

    def group(depth: int) -> Node:
        nonlocal at
        alternatives: list[list[Node]] = [[]]  # the clauses between ORs and side by side; AND makes a list of several
        mode, field, joined, negated, either = "", None, False, False, False
        while at < len(lexemes):
            m = lexemes[at]
            at += 1
            kind = m.lastgroup
            if kind == "close":
                if depth:
                    break
                continue
            if kind == "sign":
                mode = m["sign"]
                continue
            if kind == "field":
                field = m["field"]
                continue
            if kind == "boost":
                if alternatives[-1]:
                    alternatives[-1][-1].boost = float(m["boost"])
                continue
            if kind == "word" and m["word"] in ("AND", "OR", "NOT") and not mode and not field:
                joined = joined or m["word"] == "AND" and bool(alternatives[-1])
                negated, either = negated or m["word"] == "NOT", either or m["word"] == "OR"
                continue
            if kind == "open":
                node = group(depth + 1)
            elif kind == "quoted":
                node = Node("phrase", m["quoted"])
            elif kind == "high":
                node = Node("range", bounds=(m["from"], m["to"], m["low"] == "{", m["high"] == "}"))
            elif m["word"] == "*":
                node = Node("all")
            elif m["word"].endswith("*"):
                node = Node("prefix", m["word"][:-1])
            else:
                node = Node("word", m["word"])
            node.field = field or node.field
            node.mode = "-" if negated or mode == "-" else mode
            if joined:
                alternatives[-1].append(node)
            else:
                alternatives.append([node])
            mode, field, joined, negated = "", None, False, False
        clauses: list[Node] = []
        alternatives = [a for a in alternatives if a]
        for several in alternatives:
            if len(several) == 1:
                clauses.append(several[0])
                continue
            for x in several:
                x.mode = x.mode or "+"
            if len(alternatives) == 1 or not either:
                clauses += several
            else:
                clauses.append(Node("group", clauses=tuple(several)))
        return Node("group", clauses=tuple(clauses))

    return group(0)
