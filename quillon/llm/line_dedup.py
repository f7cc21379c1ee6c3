"""Lines that many sites repeat, found by distinct-site sketches and taken out of every document.

Each line's HyperLogLog sketch of the sites that have it is built and merged by aggregation on the line's hash. Lines
whose estimate is clear of the threshold by three standard errors are decided by it; the few near the threshold get
exact distinct counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._batch import KeyFilter, written
from quillon.llm._rows import text_keys

MIN_SITES, LG_K = 8, 8


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def _lines(docs: DataFrame, *columns: str) -> DataFrame:
    """(columns, line key) of every line that isn't blank."""
    line = docs.select(*columns, F.explode(F.split("text", "\n", -1)).alias("line"))
    return line.where(F.btrim("line", F.lit(" \t\r")) != "").select(*columns, _key(F.col("line")).alias("line"))


def widespread_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(line) of (text, site): the keys of the lines that at least min_sites sites have; a null site is none."""
    error = 3 * 1.04 / 2 ** (lg_k / 2)
    lines = _lines(docs.where("site IS NOT NULL"), "site")
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    spread = written(spread.select("line", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - error)))
    near = spread.where(F.col("sites") <= min_sites * (1 + error)).select("line")
    exact = KeyFilter(near, "line").passing(lines, "line").join(near, "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return spread.where(F.col("sites") > min_sites * (1 + error)).select("line").unionByName(exact.select("line"))


def drop_widespread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(doc_id, text, n_lines, n_removed), a row for every row of docs, with the lines of min_sites or more sites gone.

    Lines are what line feeds separate, compared without blanks at their ends; blank lines stay and don't count. n_lines
    counts lines before the removal. A null site has no part in the counts, but its documents are cleaned like others; a
    null text stays null with 0 lines; an empty one stays empty. Repeated rows are cleaned alike and add no site. Very
    long texts are cleaned whole. Other columns are not read, and an empty table gives an empty result.
    """
    k1, k2 = text_keys(docs[text_col])
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[site_col].cast("string").alias("site"), k1.alias("k1"), k2.alias("k2"))
    wide = written(widespread_lines(source, min_sites, lg_k))
    held = KeyFilter(wide, "line").passing(_lines(source, "k1", "k2"), "line").join(wide, "line", "left_semi")
    gone = written(held.groupBy("k1", "k2").agg(F.collect_set("line").alias("gone")))
    lines = F.split("text", "\n", -1)
    full = F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(" \t\r")) != ""))
    # texts that lose no line stay where they are
    some, whole = KeyFilter(gone, "k1").split(source, "k1")
    both = some.join(gone, ["k1", "k2"], "left").unionByName(whole.withColumn("gone", F.lit(None).cast("array<long>")))
    cleaned = both.withColumn("kept", F.when(F.col("gone").isNotNull(), F.filter(lines, lambda x: ~F.array_contains("gone", _key(x)) | (F.btrim(x, F.lit(" \t\r")) == ""))))
    return cleaned.select(
        "doc_id",
        F.coalesce(F.array_join("kept", "\n"), "text").alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(full).cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), 0).otherwise(F.size(lines) - F.size("kept")).cast("long").alias("n_removed"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_widespread_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
trimmed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM lines),
wide AS (SELECT t FROM trimmed WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT doc_id, line, place, t <> '' AS full_line, t IN (SELECT t FROM wide) AS gone FROM trimmed)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text,
  count(*) FILTER (full_line)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed
FROM marked GROUP BY doc_id
"""
