"""Faults that show over larger tables only, on tables made for them."""

import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq_files
import pytest
from conftest import rows_of

from quillon.config import CollectionConfig, KMeansConfig, PqConfig, TextConfig
from quillon.operators import fts, hnsw, kmeans, knn, pq
from quillon.plans import ORACLES, QUERIES
from quillon.sources.collection import Catalog


def embeddings(folder, n):
    """A table of n random vectors in folder."""
    rng = np.random.default_rng(7)
    v = rng.standard_normal((n, 64)).astype(np.float32)
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 64, pa.int32()), pa.array(v.ravel()))
    pq_files.write_table(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": vectors, "label": pa.array(rng.integers(0, 10, n).astype(np.int32))}), f"{folder}/embeddings.parquet")
    return str(folder)


def matches(spark, name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return rows_of(QUERIES[name](spark, folder).toArrow()) == rows_of(con.sql(ORACLES[name]).to_arrow_table())


def test_compaction_leaves_no_segment_out(spark, tmp_path):
    c = Catalog(spark, str(tmp_path)).create(CollectionConfig("line", 2, staging_threshold=10, num_clusters=2, l0_max_segments=3, segment_target_size=15))
    for i in range(3):
        c.insert(spark.range(10 * i, 10 * i + 10).selectExpr("id", "array(id, 1D) AS vector"))
    assert [(r["level"], r["num_vectors"]) for r in c.router().collect()] == [(1, 30)]


def test_whole_table_stays_in_staging(spark, tmp_path):
    """More vectors than fill a staging table by default."""
    assert matches(spark, "collection_list", embeddings(tmp_path, 10_050), "embeddings")


def test_second_half_stays_in_staging(spark, tmp_path):
    assert matches(spark, "collection_stats", embeddings(tmp_path, 20_100), "embeddings")


def test_every_twentieth_row_asks(spark):
    """Batches of searches ask 25 of 500 rows, of all rows."""
    for name in ("knn_batch_self_excluded", "ivf_batch_search", "pq_batch", "hnsw_search_wide", "ivf_hnsw_search_wide"):
        assert {r["query_id"] for r in QUERIES[name](spark, "/root/testdata/sf0.001").select("query_id").collect()} == set(range(0, 500, 20))


def test_graphs_are_built_by_many_tasks(spark, tmp_path):
    """Rows are few bytes, so they were read by one task."""
    points = spark.range(400).selectExpr("id", "cast(id % 10 AS int) AS cluster_id", "array(cast(id AS double), 1D) AS vector")
    built = hnsw.build(points)
    assert built.count() == 10 and built.rdd.getNumPartitions() > 1


def test_equal_members_have_equal_centroids(spark):
    """fit() with tolerance 0 ends only if two rounds over the same members give the same sums."""
    rng = np.random.default_rng(3)
    rows = [(v.tolist(),) for v in rng.standard_normal((3000, 8))]
    source = spark.createDataFrame(rows, "vector array<double>").repartition(8)
    first = kmeans.fit(source, KMeansConfig(num_clusters=4, max_iterations=1000, tolerance=0.0), init=np.array([r[0] for r in rows[:4]]))
    again, n = kmeans.lloyd_round(source, first)
    assert n.sum() == 3000 and np.allclose(again, first, atol=1e-9)


def test_words_are_counted_in_small_parts():
    """The numbers of two million words were held several times at once."""
    words = pa.array([[f"w{i % 500}" for i in range(1000)]] * 1200)
    batch = pa.RecordBatch.from_arrays([pa.array(["text"] * 1200), pa.array(range(1200)), words], names=["field", "id", "words"])
    parts = [b for b in fts._counted(iter([batch])) if b.column("term").null_count == 0]
    assert sum(b.num_rows for b in parts) == 1200 * 500 and max(sum(b.column("tf").to_pylist()) for b in parts) <= 1 << 18
    assert {tuple(b.column("positions")[0].as_py()) for b in parts} == {(0, 500)}


def test_graph_recall_does_not_fall_with_the_table(spark, tmp_path):
    assert matches(spark, "hnsw_recall", embeddings(tmp_path, 6000), "embeddings")


def test_chunks_of_cancelling_words_have_unit_vectors(spark, tmp_path):
    """The words of the first text are hashed to one place with opposite signs; of the others some have no words."""
    at = {}
    for i in range(1000):
        h = int.from_bytes(hashlib.md5(f"w{i}".encode()).digest()[:4])
        if (h >> 1) % 64 in at and at[(h >> 1) % 64][1] != h & 1:
            break
        at.setdefault((h >> 1) % 64, (f"w{i}", h & 1))
    texts = [f"{at[(h >> 1) % 64][0]} w{i}", "\n", "\x0b", "a\x0bb c", "\u00a0", "\u00a0 x", " \u3000", " ", "", None, "\t\f\r\n", "x"]
    docs = pa.table({"doc_id": pa.array(range(len(texts))), "text": texts, "source": ["web"] * len(texts), "lang": ["en"] * len(texts)})
    pq_files.write_table(docs, f"{tmp_path}/documents.parquet")
    assert matches(spark, "embed_chunks", str(tmp_path), "documents")
    assert matches(spark, "chunk_words", str(tmp_path), "documents")


def test_probed_graph_recall_does_not_fall_with_the_table(spark, tmp_path):
    assert matches(spark, "ivf_hnsw_recall", embeddings(tmp_path, 6000), "embeddings")


def test_quantized_recall_does_not_fall_with_the_table(spark, tmp_path):
    assert matches(spark, "pq_refined_recall", embeddings(tmp_path, 6000), "embeddings")


def test_candidates_are_as_many_as_queries_need(spark):
    """With two centroids a code of four tells nothing of most neighbours; the last factor takes all vectors."""
    rng = np.random.default_rng(5)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((900, 8)))], "id long, vector array<double>")
    some = c.limit(20).selectExpr("id AS query_id", "vector")
    truth = knn.batch_search(c, some, 5)
    coded = lambda book: (pq.encode(c, book), book)
    coarse, fine = (coded(pq.train(c, PqConfig(subvectors=m, centroids=n, max_iterations=4))) for m, n in ((1, 2), (8, 128)))
    assert pq.enough_candidates(*fine, some, truth, 5, 2, 0.95) == 2
    assert pq.enough_candidates(*coarse, some, truth, 5, 2, 1.0) > 16


def written_bytes(spark):
    """Shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.fixture
def texts(spark):
    """2,000 texts of 200 words, of a vocabulary of 500."""
    rng = np.random.default_rng(11)
    return spark.createDataFrame([(i, " ".join(f"w{x:03}" for x in rng.integers(0, 500, 200))) for i in range(2000)], "id long, text string").repartition(4).localCheckpoint()


def test_postings_are_written_without_a_shuffle(spark, texts, tmp_path):
    """400,000 words make about 330,000 postings, which were shuffled; the words' numbers are all that is."""
    before = written_bytes(spark)
    index = fts.TextIndex.build(texts, {"text": "text"}, config=TextConfig(stemming=None)).write(str(tmp_path / "i"))
    assert written_bytes(spark) - before < 500_000
    assert index.postings.agg({"tf": "sum"}).first()[0] == 400_000 and index.terms.count() == 500
    for file in (tmp_path / "i" / "postings").glob("*.parquet"):
        terms = [t for t in pq_files.read_table(file).column("term").to_pylist() if t]
        assert sum(a > b for a, b in zip(terms, terms[1:])) < 2  # a run or two


def test_many_queries_do_not_move_the_postings(spark, texts, tmp_path):
    """Whatever the size of the terms table, which limits a broadcast by itself."""
    index = fts.TextIndex.build(texts, {"text": "text"}, config=TextConfig(stemming=None)).write(str(tmp_path / "i"))
    queries = spark.createDataFrame([(i, " ".join(f"w{x:03}" for x in range(i, i + 200))) for i in range(3)], "query_id long, query string").localCheckpoint()
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before, shuffled = spark.conf.get(limit), written_bytes(spark)
    spark.conf.set(limit, "-1")
    try:
        found = {(r["query_id"], r["id"]): r["score"] for r in index.search_many(queries, 10).collect()}
        assert written_bytes(spark) - shuffled < 1_000_000
    finally:
        spark.conf.set(limit, before)
    one = index.search(queries.where("query_id = 1").first()["query"], 10).collect()
    assert len(found) == 30 and all(abs(found[1, r["id"]] - r["score"]) < 1e-6 for r in one)


def test_codes_are_made_in_one_python_step(spark):
    """Steps in a chain had a Python worker each in every task: assignment, residual and codes."""
    rng = np.random.default_rng(2)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))], "id long, vector array<double>").localCheckpoint()
    index = pq.IvfPq.build(c, 4, PqConfig(subvectors=4, centroids=16, refine_candidates=1000))
    assert index.codes._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    centers, rows = index.centers, index.codes.collect()
    v = np.array([r["vector"] for r in rows])
    own = ((v[:, None] - centers[None]) ** 2).sum(2).argmin(1)
    assert [r["cluster_id"] for r in rows] == own.tolist()
    assert [r["codes"] for r in rows] == index.codebook.encode(v - centers[own]).tolist()
    assert [r["id"] for r in index.search(v[7].tolist(), 5).collect()] == [r["id"] for r in knn.search(c, v[7].tolist(), 5, "l2").collect()]
