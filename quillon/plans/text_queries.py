"""Queries of text search, fusion, chunks and embeddings. The oracles are of unstemmed indexes with exact lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import CollectionConfig, EmbedConfig, HybridConfig, TextConfig
from quillon.functions.text import char_chunks, stems, tokens, word_chunks
from quillon.functions.vectors import norm
from quillon.operators import hybrid, knn
from quillon.operators.embed import embed, embed_and_insert, embed_chunked, embed_query
from quillon.operators.embed import semantic_search as semantic
from quillon.operators.fts import TextIndex
from quillon.plans.common import CORPUS, QUERY, SQL_QUERY, TEXT, bm25, corpus, cosine, l2, query, r6, table, text_corpus, total, workspace
from quillon.sources.collection import Catalog, Collection
from quillon.sources.storage import Storage

PLAIN = TextConfig(stemming=None)
WORDS = "the water nicht pour model"
SQL_WORDS = "term IN ('the', 'water', 'nicht', 'pour', 'model')"
K, CANDIDATES = 10, 100
#: DuckDB's edit distance counts bytes: with one sign for each other character it counts characters, for an ASCII word.
ASCII_TERM = r"regexp_replace(term, '[^\x00-\x7F]', '#', 'g')"


_served: dict[tuple[str, str], str] = {}


def build_index(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a new index of all documents."""
    path = workspace(spark)
    TextIndex.build(text_corpus(spark, sf_dir), {"text": "text", "title": "title"}, config=PLAIN, stored=["title"]).write(path)
    return path


def _index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of these documents that the application has built, as a server would hold it: built for the first query."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _served or not Storage(spark).exists(_served[key]):
        _served[key] = build_index(spark, sf_dir)
    return TextIndex.read(spark, _served[key], PLAIN, stored=True)


def _top(source: str, k: int = K) -> str:
    return f"SELECT * FROM ({total(source)}) ORDER BY score DESC, id LIMIT {k}"


@query(f"WITH {TEXT} SELECT id, words FROM words WHERE field = 'text'")
def text_tokenize(spark, sf_dir):
    return text_corpus(spark, sf_dir).where("text IS NOT NULL").select("id", tokens("text").alias("words"))


@query()
def text_stem(spark, sf_dir):
    words = text_corpus(spark, sf_dir).select(F.explode(tokens("text")).alias("word")).distinct()
    return words.select("word", stems(F.array("word"))[0].alias("stem"))


@query(f"WITH {TEXT} SELECT field, term, id, tf, list_transform(positions, lambda p: p::INTEGER) AS positions FROM postings")
def fts_postings(spark, sf_dir):
    return _index(spark, sf_dir).postings.select("field", "term", "id", "tf", "positions")


@query(f"WITH {TEXT} SELECT field, count(*) AS n_docs, sum(length)::BIGINT AS n_tokens, {r6('avg(length)')} AS mean_length FROM lengths GROUP BY field")
def fts_stats(spark, sf_dir):
    return _index(spark, sf_dir).stats()


@query(f"WITH {TEXT} SELECT field, count(*) AS n_docs, sum(length)::BIGINT AS n_tokens, {r6('avg(length)')} AS mean_length FROM lengths JOIN documents ON doc_id = id WHERE lang <> 'en' OR lang IS NULL GROUP BY field")
def fts_delete(spark, sf_dir):
    """Without the English documents."""
    gone = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return _index(spark, sf_dir).delete(gone).stats()


@query(f"WITH {TEXT}, {bm25('s', SQL_WORDS + chr(32) + 'AND p.field = ' + repr('text'))} {_top('s')}")
def bm25_topk(spark, sf_dir):
    return _index(spark, sf_dir).search(WORDS, K, ["text"])


@query(
    f"""WITH {TEXT}, asked AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) < 40)) AS term FROM benchmark WHERE text IS NOT NULL),
{bm25('s', "p.field = 'text' AND p.term IN (SELECT term FROM asked)")},
t2 AS (SELECT query_id, id, {r6('list_sum(list_sort(list(score)))')} AS score FROM asked JOIN s USING (term) GROUP BY query_id, id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM t2) SELECT * FROM r WHERE rank <= {K}"""
)
def bm25_batch(spark, sf_dir):
    """Every benchmark passage as a query."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _index(spark, sf_dir).search_many(asked, K, ["text"])


@query(
    f"""WITH {TEXT}, {bm25('s', "p.field = 'text' AND (term IN ('water', 'model') OR starts_with(term, 'riv') OR (term >= 'mil' AND term < 'mill'))")},
w AS (SELECT id, term, CASE WHEN term = 'model' THEN score * 2 WHEN term >= 'mil' AND term < 'mill' THEN 1 ELSE score END AS score FROM s),
ok AS (SELECT id FROM w GROUP BY id HAVING count(*) FILTER (starts_with(term, 'riv')) > 0 AND count(*) FILTER (term IN ('water', 'model')) > 0 AND count(*) FILTER (term >= 'mil' AND term < 'mill') = 0),
s2 AS (SELECT w.id, w.term, w.score FROM w JOIN ok USING (id)) {_top('s2', 50)}"""
)
def fts_query_language(spark, sf_dir):
    """Groups, boosts, prefixes and ranges."""
    return _index(spark, sf_dir).boolean("text:(water model^2) AND text:riv* AND NOT text:[mil TO mill}", 50)


@query(f"WITH {TEXT}, {bm25('s', SQL_WORDS + ' AND p.field = ' + repr('text'))}, x AS ({_top('s')}) SELECT x.*, title FROM x JOIN t USING (id)")
def fts_stored_fields(spark, sf_dir):
    index = _index(spark, sf_dir)
    return index.with_fields(index.search(WORDS, K, ["text"]))


_FIELDS = "(term IN ('the', 'web', 'en'))"


@query(f"WITH {TEXT}, {bm25('s', _FIELDS)} {_top('s', 50)}")
def bm25_multifield(spark, sf_dir):
    return _index(spark, sf_dir).search("the web en", 50)


@query(f"WITH {TEXT}, {bm25('s', SQL_WORDS)}, t2 AS ({_top('s', 100)}) SELECT * FROM t2 WHERE score >= 2")
def bm25_min_score(spark, sf_dir):
    return _index(spark, sf_dir).search(WORDS, 100, min_score=2.0)


@query(
    f"""WITH {TEXT}, {bm25('s', "term IN ('the', 'water', 'nicht', 'model') AND p.field = 'text'")},
ok AS (SELECT id FROM s GROUP BY id HAVING count(*) FILTER (term = 'the') > 0 AND count(*) FILTER (term = 'nicht') = 0), s2 AS (SELECT s.* FROM s JOIN ok USING (id)) {_top('s2', 50)}"""
)
def bm25_boolean(spark, sf_dir):
    return _index(spark, sf_dir).boolean("+the water -nicht model", 50, ["text"])


@query(f"WITH {TEXT}, {bm25('s', 'term = ' + repr('nicht') + ' AND p.field = ' + repr('text'))} {_top('s', 50)}")
def fts_term(spark, sf_dir):
    return _index(spark, sf_dir).term("text", "Nicht", 50)


@query(
    f"""WITH {TEXT}, a AS (SELECT id, pos FROM places WHERE field = 'text' AND term = 'of'), b AS (SELECT id, pos FROM places WHERE field = 'text' AND term = 'the'),
m AS (SELECT a.id, count(*) AS tf FROM a JOIN b ON a.id = b.id AND b.pos = a.pos + 1 GROUP BY a.id),
i AS (SELECT list_sum(list_sort(list({('ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))')}))) AS idf, any_value(mean) AS mean FROM df JOIN corpus USING (field) WHERE field = 'text' AND term IN ('of', 'the'))
SELECT m.id, {r6('idf * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / mean)))')} AS score FROM m JOIN lengths ON lengths.id = m.id AND field = 'text', i ORDER BY score DESC, id LIMIT 50"""
)
def fts_phrase(spark, sf_dir):
    return _index(spark, sf_dir).phrase("of the", 50)


@query(f"WITH {TEXT} SELECT DISTINCT term, levenshtein({ASCII_TERM}, 'water')::INTEGER AS edits FROM df WHERE levenshtein({ASCII_TERM}, 'water') <= 2")
def fts_fuzzy(spark, sf_dir):
    return _index(spark, sf_dir).fuzzy_terms("water", 2)


@query(f"WITH {TEXT}, {bm25('s', 'levenshtein(' + ASCII_TERM + ', ' + repr('water') + ') <= 1 AND p.field = ' + repr('text'))} {_top('s', 50)}")
def fts_fuzzy_search(spark, sf_dir):
    return _index(spark, sf_dir).fuzzy("water", 50, 1, ["text"])


# fusion

_SIDES = f"""{CORPUS}, {TEXT}, {bm25('s', SQL_WORDS + ' AND p.field = ' + repr('text'))},
tx AS ({_top('s', CANDIDATES)}), vx AS (SELECT id, payload, {r6(l2('vector', SQL_QUERY))} AS distance FROM c ORDER BY distance, id LIMIT {CANDIDATES}),
tr AS (SELECT id, score AS raw, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS text_rank FROM tx),
vr AS (SELECT id, distance AS raw, row_number() OVER (ORDER BY distance, id)::INTEGER AS vector_rank FROM vx)"""
_SCALED = f"""{_SIDES},
ts AS (SELECT id, text_rank, (raw - min(raw) OVER ()) / greatest(max(raw) OVER () - min(raw) OVER (), 1e-6) AS text_score FROM tr),
vs AS (SELECT id, vector_rank, 1 - (raw - min(raw) OVER ()) / greatest(max(raw) OVER () - min(raw) OVER (), 1e-6) AS vector_score FROM vr)"""


def _fused(score: str, k: int = K) -> str:
    return f"SELECT id, {r6(score)} AS score, {r6('text_score')} AS text_score, {r6('vector_score')} AS vector_score, text_rank, vector_rank FROM ts FULL JOIN vs USING (id) ORDER BY score DESC, id LIMIT {k}"


def _mix(lam: float) -> str:
    return f"coalesce(text_score, 0) * {lam}::DOUBLE + coalesce(vector_score, 0) * (1 - {lam}::DOUBLE)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    text = _index(spark, sf_dir).search(WORDS, CANDIDATES, ["text"])
    return text, knn.search(corpus(spark, sf_dir), QUERY, CANDIDATES, "l2", keep=["payload"])


@query(f"WITH {_SCALED} {_fused(_mix(0.5))}")
def hybrid_weighted(spark, sf_dir):
    return hybrid.fuse(*_sides(spark, sf_dir), K)


@query(f"WITH {_SCALED} {_fused(_mix(0.3))}")
def hybrid_normalized(spark, sf_dir):
    return hybrid.fuse(*_sides(spark, sf_dir), K, HybridConfig("normalized", 0.3))


@query(
    f"""WITH {_SIDES}, ts AS (SELECT id, text_rank, 1 / (60 + text_rank)::DOUBLE AS text_score FROM tr), vs AS (SELECT id, vector_rank, 1 / (60 + vector_rank)::DOUBLE AS vector_score FROM vr)
{_fused('coalesce(text_score, 0) + coalesce(vector_score, 0)')}"""
)
def hybrid_rrf(spark, sf_dir):
    return hybrid.fuse(*_sides(spark, sf_dir), K, HybridConfig("rrf"))


@query(
    f"""WITH {_SIDES}, te AS (SELECT *, exp(raw - max(raw) OVER ()) AS e FROM tr), ve AS (SELECT *, exp(min(raw) OVER () - raw) AS e FROM vr),
ts AS (SELECT id, text_rank, e / sum(e) OVER () AS text_score FROM te), vs AS (SELECT id, vector_rank, e / sum(e) OVER () AS vector_score FROM ve)
{_fused(_mix(0.5))}"""
)
def hybrid_softmax(spark, sf_dir):
    return hybrid.fuse(*_sides(spark, sf_dir), K, HybridConfig("softmax"))


_LAMBDAS = (0.0, 0.25, 0.5, 0.75, 1.0)


@query(f"WITH {_SCALED} " + " UNION ALL ".join(f"SELECT {lam}::DOUBLE AS lambda, * FROM ({_fused(_mix(lam))})" for lam in _LAMBDAS))
def hybrid_lambda_sweep(spark, sf_dir):
    text, vector = _sides(spark, sf_dir)
    out = None
    for lam in _LAMBDAS:
        part = hybrid.weighted(text, vector, K, HybridConfig(lambda_=lam)).withColumn("lambda", F.lit(lam))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_SCALED}, f AS ({_fused(_mix(0.5))}) SELECT f.*, payload FROM f LEFT JOIN vx USING (id)")
def hybrid_with_payload(spark, sf_dir):
    text, vector = _sides(spark, sf_dir)
    return hybrid.with_payload(hybrid.fuse(text, vector, K), vector)


# chunks and embeddings

_CHUNKS = r"""w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE trim(text) <> ''),
s AS (SELECT id, w, unnest(range(greatest(ceil((len(w) - 256) / 224.0), 0)::BIGINT + 1)) AS chunk_index FROM w)"""


@query(f"WITH {_CHUNKS} SELECT id, chunk_index::INTEGER AS chunk_index, array_to_string(w[chunk_index * 224 + 1 : chunk_index * 224 + 256], ' ') AS chunk FROM s")
def chunk_words(spark, sf_dir):
    docs = text_corpus(spark, sf_dir)
    return docs.select("id", F.posexplode(word_chunks("text")).alias("chunk_index", "chunk"))


@query(
    """WITH s AS (SELECT doc_id AS id, text, unnest(range(greatest(ceil((length(text) - 1000) / 900.0), 0)::BIGINT + 1)) AS chunk_index FROM documents WHERE length(text) > 0)
SELECT id, chunk_index::INTEGER AS chunk_index, substring(text, chunk_index * 900 + 1, 1000) AS chunk FROM s"""
)
def chunk_chars(spark, sf_dir):
    docs = text_corpus(spark, sf_dir)
    return docs.select("id", F.posexplode(char_chunks("text", 1000, 100)).alias("chunk_index", "chunk"))


_EMBED = EmbedConfig(dimension=64)


_VECTORS = r"""ew AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents WHERE text IS NOT NULL),
eh AS (SELECT id, ('0x' || md5(w)[1:8])::BIGINT AS h FROM ew),
ep AS (SELECT id, (h >> 1) % 64 AS p, sum(CASE WHEN h & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM eh GROUP BY ALL),
en AS (SELECT id, sqrt(sum(x * x)) AS n FROM ep GROUP BY id),
eg AS (SELECT doc_id AS id, unnest(range(64)) AS p FROM documents WHERE text IS NOT NULL),
ev AS (SELECT id, list((CASE WHEN n > 0 THEN coalesce(x, 0) / n ELSE 0 END)::FLOAT ORDER BY p) AS vector FROM eg LEFT JOIN ep USING (id, p) LEFT JOIN en USING (id) GROUP BY id)"""


@query(f"WITH {_VECTORS} SELECT id, list_transform(vector, lambda x: {r6('x::DOUBLE')}) AS vector FROM ev UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL")
def embed_documents(spark, sf_dir):
    vectors = text_corpus(spark, sf_dir).select("id", embed("text", _EMBED).alias("vector"))
    return vectors.select("id", F.transform("vector", lambda x: F.round(x.cast("double"), 6)).alias("vector"))


def _embedded(spark: SparkSession, sf_dir: str) -> Collection:
    """The documents in a collection, by embed_and_insert()."""
    c = Catalog(spark, workspace(spark)).create(CollectionConfig("texts", _EMBED.dimension, staging_threshold=1 << 40))
    embed_and_insert(text_corpus(spark, sf_dir), c, payload_col="title", config=_EMBED)
    return c


@query("SELECT count(text) AS embedded, count(text) AS inserted, 64::INTEGER AS dimension, count(text) AS stored FROM documents")
def embed_insert(spark, sf_dir):
    c = Catalog(spark, workspace(spark)).create(CollectionConfig("texts", _EMBED.dimension, staging_threshold=1 << 40))
    told = embed_and_insert(text_corpus(spark, sf_dir), c, payload_col="title", config=_EMBED)
    return told.crossJoin(c.all().agg(F.count(F.lit(1)).alias("stored")))  # one row each


_ASKED = "the water of the model"
_ASKED_VECTOR = "[" + ", ".join(f"{x!r}::DOUBLE" for x in embed_query(_ASKED, _EMBED)) + "]"


@query(
    f"""WITH {_VECTORS}, d AS (SELECT id::VARCHAR AS id, concat_ws(' ', source, lang) AS payload, {r6(cosine('list_transform(vector, lambda x: x::DOUBLE)', _ASKED_VECTOR))} AS distance FROM ev JOIN documents ON doc_id = id)
SELECT id, distance, payload FROM d ORDER BY distance, id LIMIT {K}"""
)
def semantic_search(spark, sf_dir):
    """A text in, documents out: embedded, inserted, searched."""
    return semantic(_embedded(spark, sf_dir), _ASKED, K, include_payload=True, config=_EMBED)


@query(f"WITH {_CHUNKS} SELECT id, chunk_index::INTEGER AS chunk_index, array_to_string(w[chunk_index * 224 + 1 : chunk_index * 224 + 256], ' ') AS chunk, 64::INTEGER AS dimension, CASE WHEN len(w) > 0 THEN 1::DOUBLE END AS norm FROM s")
def embed_chunks(spark, sf_dir):
    """Chunks with their vectors, of unit length; one without words has no norm."""
    chunks = embed_chunked(text_corpus(spark, sf_dir).select("id", "text"), config=_EMBED)
    return chunks.select("id", "chunk_index", "chunk", F.size("vector").alias("dimension"), F.nullif(F.round(norm("vector"), 3), F.lit(0.0)).alias("norm"))
