"""Near-duplicate documents by bottom-k sketches of one hash function.

Every document is the set of its hashed word windows; its sketch is the set's least values. Inverted lists of the
retained values generate candidates: values are ordered by how many sketches hold them, and two sketches that overlap in
at least c of s values share one of the first s-c+1, so only those are listed and the values of a passage that many
documents repeat stay out of the lists. The bottom-k of the union of two sketches estimates their Jaccard similarity
and prunes; the exact Jaccard similarity of the whole sets decides. Within a list documents are first compared with one
leader; pairs already in one component need no comparison, and every other pair of the list is then compared, so the
groups are those of all pairs of the lists while a group of n copies costs about n comparisons. Where lists stay long
because their texts share a passage and no more, the lists of these texts are made anew from their whole sets, in which
the passage's values are the last to be listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.llm._batch import KeyFilter, drop_written, mix, slices, utf8, windows, word_hashes, written
from quillon.llm._rows import keyed, without
from quillon.llm.components import components

SHINGLE, SKETCH, THRESHOLD, SLACK = 3, 64, 0.5, 0.12


def _sets(text: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, window hash, row) by slice, sorted by row and hash, each hash once in a row."""
    for first, offsets, data in slices(utf8(text, lower=True)):
        n = len(offsets) - 1
        h, rows, _ = windows(*word_hashes(offsets, data), n, shingle, pad=True)
        h = h >> np.uint64(1)  # non-negative as a Spark long
        order = np.lexsort((h, rows))
        h, rows = h[order], rows[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        yield first, n, h[new], rows[new]


def _lists(count: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(values.astype(np.int64)))


def _sketches(docs: DataFrame, shingle: int, sketch: int) -> DataFrame:
    """(id, k1, k2, node, node2, n, least): node and node2 name the set; a text without words has no node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, h, rows in _sets(batch.column("text"), shingle):
                size = np.bincount(rows, minlength=n)
                begin = np.concatenate([[0], np.cumsum(size)])[:-1]
                total = np.zeros((2, n), np.uint64)
                if len(h):
                    some = size > 0
                    for i, salt in enumerate((0x1234567, 0x89ABCDEF)):
                        total[i][some] = np.add.reduceat(mix(h ^ np.uint64(salt)), begin[some])
                node = [pa.array(mix(t).view(np.int64), mask=size == 0) for t in total]
                kept = (np.arange(len(h)) - begin[rows]) < sketch
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("k1"), part.column("k2"), *node, pa.array(size), _lists(np.minimum(size, sketch), h[kept])], names=["id", "k1", "k2", "node", "node2", "n", "least"])

    schema = T.StructType([docs.schema["id"], T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("node", T.LongType()), T.StructField("node2", T.LongType()), T.StructField("n", T.LongType()), T.StructField("least", T.ArrayType(T.LongType()))])
    return docs.select("id", "k1", "k2", "text").mapInArrow(run, schema)


def _whole_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, whole) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, h, rows in _sets(batch.column("text"), shingle):
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(first, n), _lists(np.bincount(rows, minlength=n), h)], names=["node", "whole"])

    return texts.select("node", "text").mapInArrow(run, "node long, whole array<long>")


def _first(held: DataFrame, share: F.Column) -> DataFrame:
    """(v, node) of the values (node, s, v, f) that a list is made of: held has those of each node's s values that other
    nodes hold too, f nodes in all, and two nodes that count must have that share of the s values in common."""
    need = F.ceil(share * F.col("s") - 1e-9)
    by_node = Window.partitionBy("node")
    # the values that no other node holds come first in the order, so q of them are left
    first = held.withColumns({"r": F.row_number().over(by_node.orderBy("f", "v")), "q": F.count(F.lit(1)).over(by_node)})
    return first.where((F.col("q") >= need) & (F.col("r") <= F.col("q") - need + 1)).select("v", "node")


class _Search:
    """The candidate lists of the distinct sets, and the comparison of pairs of them."""

    def __init__(self, docs: DataFrame, rows: DataFrame, shingle: int, sketch: int, threshold: float, slack: float):
        self.spark: SparkSession = docs.sparkSession
        self.docs, self.shingle, self.sketch, self.threshold, self.slack = docs, shingle, sketch, threshold, slack
        self.held: list[DataFrame] = []
        self.nodes = self.keep(rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("node2", "k1", "k2", "n", "least")).alias("x")).select("node", "x.*"))
        held = self.nodes.select("node", F.size("least").alias("s"), F.explode("least").alias("v"))
        self.hot = self.keep(self._hot())
        self.any_hot = not self.hot.isEmpty()
        held = self.by_value(held, {"f": F.count(F.lit(1))}).where("f > 1")
        # a set so small that every partner's sketch is its whole set needs no slack
        self.lists = self.keep(_first(held, F.when(F.col("s") <= sketch * threshold, threshold).otherwise(threshold - slack)))
        self.tested = self.edges = self.spark.createDataFrame([], "a long, b long")

    def keep(self, df: DataFrame) -> DataFrame:
        """df as a written table that is deleted with the search."""
        self.held.append(written(df))
        return self.held[-1]

    def _hot(self) -> DataFrame:
        """(v) of the values that about a hundredth of all sketches hold or more, 6,400 at most, by a sample of 20,000
        sketches. It decides which way a value is counted by, not what is counted."""
        n = self.nodes.count()
        some = self.nodes if n <= 20_000 else self.nodes.sample(20_000 / n, seed=1)
        held = some.select(F.explode("least").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        return held.where(F.col("n") >= max(50, min(n, 20_000) // 100)).select("v")

    def by_value(self, rows: DataFrame, columns: dict[str, F.Column]) -> DataFrame:
        """rows (v, ...) with aggregates over all rows of the same v.

        The rows of a value meet in one task; those of a value that a third of all sketches may hold don't: they are
        aggregated where they are, and the results, a row for each such value, come to them.
        """
        here = Window.partitionBy("v")
        cold = rows.join(F.broadcast(self.hot), "v", "left_anti") if self.any_hot else rows
        out = cold.withColumns({name: c.over(here) for name, c in columns.items()})
        if not self.any_hot:
            return out
        hot = rows.join(F.broadcast(self.hot), "v")
        found = hot.groupBy("v").agg(*(c.alias(name) for name, c in columns.items()))
        return out.unionByName(hot.join(F.broadcast(found), "v"))

    def compare(self, pairs: DataFrame) -> tuple[int, int]:
        """Adds the pairs (a, b) that reach the threshold to edges; gives their number and that of the pairs tried."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = self.keep(pairs.join(self.tested, ["a", "b"], "left_anti"))
        self.tested = self.tested.unionByName(pairs)
        # sketches of no pair stay where they are
        asked = KeyFilter(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), "node")
        sets = asked.passing(self.nodes, "node").select("node", "n", "least")
        both = pairs.join(sets.toDF("a", "na", "x"), "a").join(sets.toDF("b", "nb", "y"), "b")
        # sets whose sizes are too far apart can't be that similar, whatever they share
        both = both.where(F.least("na", "nb") >= self.threshold * F.greatest("na", "nb"))
        both = both.withColumn("u", F.slice(F.array_sort(F.array_union("x", "y")), 1, self.sketch))
        shared = F.size(F.array_intersect(F.array_intersect("u", "x"), "y"))
        likely = written(both.where(shared >= F.lit(self.threshold - self.slack) * F.size("u")).select("a", "b"))
        ends = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
        whole = self.texts(ends)
        sets = likely.join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b")
        shared = F.size(F.array_intersect("x", "y"))
        good = sets.withColumn("o", shared).where(F.col("o") >= self.threshold * (F.size("x") + F.size("y") - F.col("o"))).select("a", "b")
        good = self.keep(good)
        self.edges = self.edges.unionByName(good)
        drop_written(likely, whole)
        return good.count(), pairs.count()

    def texts(self, nodes: DataFrame) -> DataFrame:
        """(node, whole): the whole sets of some nodes (node); texts of others stay where they are. A written table."""
        keys = written(nodes.join(self.nodes.select("node", "k1", "k2"), "node"))
        maybe = KeyFilter(keys, "k1").passing(self.docs.select("k1", "k2", "text"), "k1")
        whole = written(_whole_sets(maybe.join(keys, ["k1", "k2"]).dropDuplicates(["k1", "k2"]), self.shingle))
        drop_written(keys)
        return whole

    def whole_lists(self, listed: DataFrame) -> DataFrame:
        """(v, node) of the nodes in listed, by their whole sets: two sets that are alike enough share one of the values
        that are listed of each, as all but threshold of a set's values are, those that fewest of these sets hold first."""
        whole = self.texts(listed.select("node").distinct())
        held = whole.select("node", F.size("whole").alias("s"), F.explode("whole").alias("v"))
        held = self.by_value(held, {"f": F.count(F.lit(1))}).where("f > 1")
        lists = self.keep(_first(held, F.lit(self.threshold)))
        drop_written(whole)
        return lists

    def roots(self) -> DataFrame:
        return self.keep(components(self.edges))

    def listed(self, roots: DataFrame) -> DataFrame:
        """(v, node, root) of the lists that hold more than one component."""
        out = self.lists.join(roots, "node", "left").select("v", "node", F.coalesce("root", "node").alias("root"))
        return self.by_value(out, {"lo": F.min("root"), "hi": F.max("root")}).where("lo != hi").select("v", "node", "root")

    def run(self) -> DataFrame:
        """(node, root) of the nodes that have a partner."""
        roots = self.spark.createDataFrame([], "node long, root long")
        turn = since = found = tried = 0
        whole = False
        while True:
            listed = written(self.listed(roots))
            by = listed.groupBy("v", "root").count().groupBy("v").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("same"))
            left = by.agg(F.sum(F.col("n") * F.col("n") - F.col("same")).alias("p"), F.sum("n").alias("n")).first()
            if not left["p"]:
                drop_written(listed)
                return roots
            few = left["p"] <= 8 * left["n"]
            if since and (few or found <= 0.05 * tried):
                if few or whole:
                    break
                self.lists, whole, since = self.whole_lists(listed), True, 0
                drop_written(listed)
                continue
            rank = F.struct(F.xxhash64(F.lit(turn), "node"), F.col("node").alias("node"), F.col("root").alias("root"))
            led = self.by_value(listed, {"lead": F.min(rank)}).where("lead.root != root")
            found, tried = self.compare(led.select(F.col("lead.node").alias("a"), F.col("node").alias("b")))
            roots = self.roots()
            drop_written(listed)
            turn, since = turn + 1, since + 1
        # what is left: every pair of one list that is not in one component, by way of the components' pairs
        own = listed.select("v", "root").distinct()
        across = own.toDF("v", "ra").join(own.toDF("v", "rb"), "v").where("ra < rb")
        sized = listed.join(self.nodes.select("node", F.col("n").alias("size")), "node").select("v", "node", "root", "size")
        pairs = across.join(sized.toDF("v", "a", "ra", "na"), ["v", "ra"]).join(sized.toDF("v", "b", "rb", "nb"), ["v", "rb"])
        pairs = pairs.where(F.least("na", "nb") >= self.threshold * F.greatest("na", "nb"))
        self.compare(pairs.select("a", "b"))
        drop_written(listed)
        return self.roots()


def _decided(docs: DataFrame, shingle: int, sketch: int, threshold: float, slack: float) -> DataFrame:
    """(id, k1, k2, m, kept) by distinct (id, text) of a group of several rows: m rows have it, kept is the group's first
    (id, k1, k2). The result is a written table; what was written on the way is gone."""
    rows = written(_sketches(docs, shingle, sketch))
    search = _Search(docs, rows, shingle, sketch, threshold, slack)
    roots = search.run()
    named = search.nodes.select("node", "node2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keys = rows.where("node IS NOT NULL").groupBy("id", "k1", "k2", "node", "node2").agg(F.count(F.lit(1)).alias("m"))
    # two sets that share node and not node2 are different: the second then stands alone
    grouped = keys.join(named, ["node", "node2"]).select("root", "id", "k1", "k2", "m")
    first = grouped.groupBy("root").agg(F.min(F.struct(F.isnull("id").alias("no_id"), "id", "k1", "k2")).alias("kept"), F.sum("m").alias("size")).where("size > 1")
    decided = written(grouped.join(first, "root").select("id", "k1", "k2", "m", "kept"))
    drop_written(rows, *search.held)
    return decided


def _is_kept() -> F.Column:
    return F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("k1") == F.col("kept.k1")) & (F.col("k2") == F.col("kept.k2"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, sketch: int = SKETCH, threshold: float = THRESHOLD, slack: float = SLACK) -> DataFrame:
    """(doc_id, kept_id): every document that goes, beside the one of its group that stays.

    A group is a connected component of the pairs whose sets of lower-case word windows (shingle words; a shorter text
    is one window) have a Jaccard similarity of at least threshold. The least id of a group stays, null ids last, ties
    by text. Sketches of that many values are pruned below threshold - slack, so a pair just at the threshold is missed
    with a chance of about 3 %. A null or empty text, and one without words, has no set: it is no copy of anything. A
    row that repeats another's id and text goes, with kept_id equal to doc_id if the first of them stays. Other columns
    are not read; their names don't matter. An empty table gives an empty result.
    """
    decided = _decided(keyed(docs, id_col, text_col), shingle, sketch, threshold, slack)
    copies = F.when(_is_kept(), F.col("m") - 1).otherwise(F.col("m"))
    out = decided.withColumn("copies", copies).where("copies > 0")
    return out.select(F.col("id").alias("doc_id"), F.col("kept.id").alias("kept_id"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one")).drop("one")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """docs with one row of each group of near_duplicates(), all columns as they are; rows without words all stay."""
    parameters = {"shingle": SHINGLE, "sketch": SKETCH, "threshold": THRESHOLD, "slack": SLACK} | parameters
    decided = _decided(keyed(docs, id_col, text_col), **parameters)
    gone = decided.where(~_is_kept()).select("id", "k1", "k2")
    return without(docs, id_col, text_col, gone, decided.where(_is_kept() & (F.col("m") > 1)).select("id", "k1", "k2"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9A-Za-z_\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents WHERE text IS NOT NULL),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2)::BIGINT)) AS i FROM words WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS g FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
alike AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE o >= {THRESHOLD} * (x.n + y.n - o)),
edges AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
reach AS (SELECT DISTINCT a AS doc_id, a AS root FROM edges UNION SELECT edges.b, reach.root FROM reach JOIN edges ON edges.a = reach.doc_id WHERE reach.root < edges.b)
SELECT doc_id, min(root) AS kept_id FROM reach GROUP BY doc_id HAVING min(root) < doc_id
"""
