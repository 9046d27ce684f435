"""Vectors, fusion, embeddings, index writes and parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import fixtures
from quern.functions.vector import content_hash, fnv1a32, point_id
from quern.operators import bm25, indexing, knn
from quern.operators.chunking import chunk_documents
from quern.operators.filters import comparable_vectors
from quern.operators.ranking import reciprocal_rank_fusion, top_k, weighted_fusion
from quern.plans import retrieval
from quern.sources import parsers

# --- vectors ---------------------------------------------------------------------------


def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = knn.nearest(fixtures.vector_records(spark, sf_dir), fixtures.vector_queries(spark, sf_dir), 10, least=None, digits=6)
    return best.select("query_id", "record_id", "score", "rank")


def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = knn.nearest(fixtures.vector_records(spark, sf_dir), fixtures.vector_queries(spark, sf_dir), 20, digits=6)
    return best.select("query_id", "record_id", "score")


def knn_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = fixtures.vector_records(spark, sf_dir).filter("knowledge_base_id in ('kb_1', 'kb_4')")
    near = comparable_vectors(records, "vector", 64)
    best = knn.nearest(near, fixtures.vector_queries(spark, sf_dir), 5, least=None, digits=6)
    return best.select("query_id", "record_id", "score", "rank")


def dimension_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = fixtures.vector_records(spark, sf_dir)
    cut = F.when(F.col("record_id") % 7 == 0, F.slice("vector", 1, 3)).when(
        F.col("record_id") % 11 == 0, F.array().cast("array<float>")
    ).otherwise(F.col("vector"))
    return knn.dimension_report(records.withColumn("vector", cut), 64)


def storable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = fixtures.vector_records(spark, sf_dir)
    cut = F.when(F.col("record_id") == 0, F.array().cast("array<float>")).when(
        F.col("record_id") % 3 == 1, F.slice("vector", 1, 8)
    ).otherwise(F.col("vector"))
    return indexing.storable_vectors(records.withColumn("vector", cut), "record_id").select(
        "record_id", F.size("vector").alias("dimensions")
    )


def adjacent_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakpoints between neighbouring vectors of a label, as semantic chunking finds them."""
    from quern.operators.chunking import semantic_breakpoints

    records = fixtures.vector_records(spark, sf_dir)
    return semantic_breakpoints(records, "knowledge_base_id", "record_id").select(
        "knowledge_base_id", "record_id", "breaks"
    )


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and containment lists fused by reciprocal ranks."""
    keyword = bm25.bm25_scores(fixtures.documents(spark, sf_dir), fixtures.queries(spark, sf_dir), retrieval.CHUNKS)
    first = top_k(keyword.withColumn("score", F.round("score", 6)), 20, tie="doc_id").drop("rank")
    second = retrieval.local_term_score(spark, sf_dir).drop("rank")
    fused = reciprocal_rank_fusion([first, second], tie="doc_id").withColumn("score", F.round("score", 9))
    return top_k(fused, 6, tie="doc_id").select("query_id", "doc_id", "score", "rank")


def rerank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best by keyword, reranked by their share of the query's terms."""
    keyword = bm25.bm25_scores(fixtures.documents(spark, sf_dir), fixtures.queries(spark, sf_dir), retrieval.CHUNKS)
    best = top_k(keyword.withColumn("score", F.round("score", 6)), 20, tie="doc_id")
    docs = fixtures.documents(spark, sf_dir).select("doc_id", "n_chars")
    candidates = best.join(docs, "doc_id").select(
        "query_id", "doc_id", F.col("score").alias("retrieval_score"), (1000.0 / F.col("n_chars")).alias("rerank_score")
    )
    fused = weighted_fusion(candidates).withColumn("score", F.round("score", 6))
    return top_k(fused, 6, tie="doc_id").select("query_id", "doc_id", "score", "rank")


# --- embedding and records -------------------------------------------------------------


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.documents(spark, sf_dir)
    return chunk_documents(docs, "recursive", target=600, overlap=60)


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.documents(spark, sf_dir)
    return docs.select(
        "doc_id", content_hash(F.col("text")).alias("content_hash"), point_id(F.col("document_id")).cast("string").alias("point_id"),
        fnv1a32(F.col("document_id")).alias("term_index"),
    )


def deterministic_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.documents(spark, sf_dir).withColumn("chunk_index", F.lit(0)).withColumn("char_count", F.col("n_chars"))
    made = indexing.deterministic_provider(indexing.embedding_inputs(docs))
    return made.select(
        "chunk_id", "dimensions", "vector_ref", *(F.round(F.col("vector")[i].cast("double"), 4).alias(f"v{i}") for i in range(8))
    )


def index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _inputs(spark, sf_dir)
    artifacts = indexing.deterministic_provider(indexing.embedding_inputs(chunks))
    docs = fixtures.documents(spark, sf_dir).withColumn("index_name", F.lit(" "))
    records = indexing.index_records(docs, chunks, artifacts)
    return records.select(
        "record_id", "knowledge_base_id", "document_id", "chunk_index", "title", "index_name", "tenant_id",
        F.length("content").alias("n_chars"), F.size("vector").alias("dimensions"),
        F.element_at("metadata", "embeddingModel").alias("model"), F.element_at("metadata", "startOffset").alias("start"),
    )


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored records, and incoming ones: some equal, some changed, some new, and some with
    a blank id."""
    docs = fixtures.documents(spark, sf_dir)
    record = docs.select(
        F.concat_ws("::", "knowledge_base_id", "chunk_id").alias("record_id"), "knowledge_base_id", "document_id",
        "chunk_id", F.lit(0).alias("chunk_index"), "title", F.md5("text").alias("content"), "tenant_id", "org_id",
    )
    old = record.filter("tenant_id <> 'es'").drop("tenant_id", "org_id")
    changed = F.when(F.col("org_id").isin("src1", "src2", "src3", "src4", "src5"), F.concat("content", F.lit("!")))
    blank = F.when(F.col("org_id").isin("src5", "src6"), F.lit("")).otherwise(F.col("record_id"))
    new = record.filter("tenant_id <> 'fr'").withColumns({"content": F.coalesce(changed, "content"), "record_id": blank})
    return old, new.drop("tenant_id", "org_id")


def upsert_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.classify_upsert(*_stored(spark, sf_dir)).select("document_id", "record_id", "action", "content")


def upsert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.write_summary(indexing.classify_upsert(*_stored(spark, sf_dir)))


def delete_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = _stored(spark, sf_dir)
    rest, _ = indexing.delete_records(old, "src3", "doc_3")
    rest, _ = indexing.delete_records(rest, "src5")
    return rest.select("record_id")


def delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = _stored(spark, sf_dir)
    return indexing.delete_records(old, "src5")[1]


def replace_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _stored(spark, sf_dir)
    return indexing.replace_documents(old, new).select("record_id", "document_id", "content")


def last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = fixtures.tasks(spark, sf_dir).select("document_id", "task_id", "status", "updated_at")
    open_ = F.col("status").isin("pending", "running")
    first, second = tasks.filter(open_), tasks.filter(~open_)
    ordered = [x.withColumn("version", F.struct("updated_at", "task_id")) for x in (first, second)]
    return indexing.last_writer_wins(*ordered, "document_id", "version").drop("version")


def compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = fixtures.tasks(spark, sf_dir).select("task_id", "status", "attempt_count", "updated_at")
    stale = F.when(F.col("status") == "failed", F.col("updated_at") - F.expr("interval 1 second")).otherwise(F.col("updated_at"))
    updates = tasks.filter("status in ('failed', 'pending')").select(
        "task_id", stale.alias("expected"), F.lit("running").alias("status"),
        (F.col("attempt_count") + 1).alias("attempt_count"), (F.col("updated_at") + F.expr("interval 1 minute")).alias("updated_at"),
    )
    return indexing.compare_and_set(tasks, updates)


def metadata_side_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = _stored(spark, sf_dir)
    records = old.withColumn("vector", F.array(F.lit(1.0).cast("float")))
    kept = records.filter("knowledge_base_id in ('src1', 'src2')").select("record_id")
    return indexing.index_metadata(records, kept).select("record_id", "document_id", "chunk_index", "title")


# --- parsers ---------------------------------------------------------------------------


def detect_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.documents(spark, sf_dir)
    i = F.col("doc_id") % 6
    mime = F.when(i == 0, " Application/PDF ").when(i == 1, "application/octet-stream").otherwise("")
    name = F.when(i == 2, F.concat("title", F.lit(".MD"))).when(i == 3, F.concat("title", F.lit(".docx"))).otherwise("")
    uri = F.when(i == 4, "data:text/markdown;base64,QUJD").otherwise("file:///x")
    return docs.select("doc_id", parsers.detect_kind(mime, name, uri).alias("kind"))


def data_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through base64 data URIs and back."""
    docs = fixtures.documents(spark, sf_dir)
    uri = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8")))
    back = parsers.data_uri_bytes(F.regexp_replace(uri, "\r\n", ""))
    return docs.select("doc_id", F.sha2(back, 256).alias("sha256"))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents in which lines that start with T or A are headings."""
    text = F.regexp_replace(F.regexp_replace("text", "(?m)^T", "# T"), "(?m)^A", "## A")
    docs = fixtures.documents(spark, sf_dir).select(
        "document_id", F.lit(parsers.MARKDOWN).alias("kind"), "filename", text.alias("content")
    )
    parsed = parsers.parse_text(docs).select("document_id", F.explode("sections").alias("s"))
    return parsed.select("document_id", "s.section_id", "s.title", "s.level", "s.start_offset", "s.end_offset")


# --- the whole search ------------------------------------------------------------------


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as index records with deterministic vectors."""
    docs = fixtures.labelled_documents(spark, sf_dir).withColumns(
        {"chunk_index": F.lit(0), "char_count": F.col("n_chars")}
    )
    made = indexing.deterministic_provider(indexing.embedding_inputs(docs)).select("chunk_id", "vector")
    return docs.join(made, "chunk_id", "left").select(
        F.col("doc_id").alias("record_id"), "knowledge_base_id", "document_id", "chunk_id", "tenant_id", "org_id",
        F.lit("").alias("title"), F.col("text").alias("content"), "metadata",
        F.coalesce("vector", F.array().cast("array<float>")).alias("vector"),
    )


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries over all documents, one language, or labelled ones, with or without a vector."""
    i = F.col("query_id")
    digits = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: ((i * 7 + k * k) % 10 / 10).cast("float"))
    return fixtures.queries(spark, sf_dir).select(
        "query_id", "query", (i % 9).cast("int").alias("top_k"), "knowledge_base_ids",
        F.when(i % 3 == 1, "en").otherwise("").alias("tenant_id"),
        F.when(i % 3 == 2, F.create_map(F.lit("quality"), F.lit(" 1 "))).otherwise(F.create_map().cast("map<string,string>")).alias("filters"),
        F.when(i % 4 != 0, digits).otherwise(F.array().cast("array<float>")).alias("query_vector"),
    )


def _search(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    from quern.operators.search import search

    found = search(_index(spark, sf_dir), _asked(spark, sf_dir), mode)
    return found.select("query_id", "rank", "record_id", F.round("score", 6).alias("score"), "score_source")


def search_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "keyword")


def search_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "vector")


def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "hybrid")


def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.operators.entities import delete_where, update_where, upsert_rows

    nations = fixtures.table(spark, sf_dir, "nation")
    new = nations.filter("n_regionkey = 3").withColumn("n_name", F.lower("n_name"))
    merged = upsert_rows(nations, new, "n_nationkey")
    renamed = update_where(merged, F.col("n_nationkey") == 1, {"n_name": F.lit("renamed")})
    return delete_where(renamed, F.col("n_regionkey") == 2)


QUERIES = {
    name: globals()[name]
    for name in (
        "knn_cosine", "knn_threshold", "knn_scoped", "dimension_guard", "storable_vectors", "adjacent_similarity",
        "rrf_hybrid", "rerank_fusion", "deterministic_embedding", "index_records", "upsert_classify", "upsert_summary",
        "delete_by_document", "delete_counts", "replace_document", "compare_and_set", "metadata_side_table",
        "detect_kind", "data_uris", "markdown_sections", "search_keyword", "search_vector", "search_hybrid", "entity_upsert",
    )
} | {"content_hash": content_hashes, "last_writer_wins": last_writer}

_COS = "list_cosine_similarity(r.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _knn(where: str, k: int, least: str = "") -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, r.vec_id AS record_id, {_COS} AS raw
  FROM embeddings r, embeddings q WHERE q.vec_id % 50 = 0 AND {where})
SELECT query_id, record_id, round(raw, 6) AS score, row_number() OVER (PARTITION BY query_id
  ORDER BY round(raw, 6) DESC, record_id) AS rank FROM s {least} QUALIFY rank <= {k}"""


_RECORDS = """
rec AS (SELECT source || '::doc_' || doc_id AS record_id, 'doc_' || doc_id AS document_id,
  md5(text) AS content, source, lang, doc_id FROM documents),
o AS (SELECT * FROM rec WHERE lang <> 'es'),
n AS (SELECT record_id AS full_id, CASE WHEN source IN ('src5', 'src6') THEN '' ELSE record_id END AS record_id, document_id,
  CASE WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5') THEN content || '!' ELSE content END AS content, source, doc_id
  FROM rec WHERE lang <> 'fr'),
c AS (SELECT coalesce(o.document_id, n.document_id) AS document_id,
  CASE WHEN n.doc_id IS NULL THEN 'untouched' WHEN o.doc_id IS NULL THEN 'inserted'
    WHEN o.content = n.content AND o.record_id = n.record_id THEN 'skipped' ELSE 'replaced' END AS action,
  CASE WHEN n.doc_id IS NULL THEN o.record_id ELSE n.record_id END AS record_id,
  CASE WHEN n.doc_id IS NULL THEN o.content ELSE n.content END AS content
  FROM o FULL JOIN n ON o.record_id = n.full_id)"""

# three scopes: all documents, the English ones, those labelled good
_SCOPED = rf"""sd AS (SELECT 0 AS sc, doc_id, text FROM documents UNION ALL SELECT 1, doc_id, text FROM documents WHERE lang = 'en'
  UNION ALL SELECT 2, doc_id, text FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
dt AS (SELECT sc, doc_id, list_distinct(list_filter(regexp_extract_all(lower(trim(text)), '[\p{{L}}\p{{Nd}}]+'),
  lambda x: octet_length(encode(x)) >= 2)) AS terms FROM sd),
qt AS (SELECT item_id AS query_id, item_id % 3 AS sc, list_distinct(list_filter(regexp_extract_all(lower(trim(text)),
  '[\p{{L}}\p{{Nd}}]+'), lambda x: octet_length(encode(x)) >= 2)) AS terms FROM benchmark),
st AS (SELECT sc, count(*)::DOUBLE AS n, avg(len(terms)) AS mean FROM dt GROUP BY sc),
post AS (SELECT sc, doc_id, len(terms) AS dl, unnest(terms) AS term FROM dt),
freq AS (SELECT sc, term, count(*) AS df FROM post GROUP BY 1, 2),
asked AS (SELECT query_id, sc, unnest(terms) AS term FROM qt),
kw AS (SELECT query_id, doc_id AS record_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.5
    / (1 + 1.5 * (0.25 + 0.75 * dl / mean))) AS score, 'keyword' AS score_source
  FROM asked JOIN freq USING (sc, term) JOIN post USING (sc, term) JOIN st USING (sc) GROUP BY 1, 2),
dv AS (SELECT doc_id, list_transform(range(8), lambda i: (('0x' || substr(sha256('mock-embedding-v1|doc_' || doc_id || '|'
  || sha256(text) || '|' || n_chars), 1 + 8 * i, 8))::UBIGINT % 10000 / 10000.0::DOUBLE)::FLOAT::DOUBLE) AS v
  FROM documents),
qv AS (SELECT item_id AS query_id, item_id % 3 AS sc, list_transform(range(1, 9), lambda k: ((item_id * 7 + k * k) % 10 / 10.0::DOUBLE)::FLOAT::DOUBLE)
  AS q FROM benchmark WHERE item_id % 4 <> 0),
vec AS (SELECT query_id, doc_id AS record_id, list_cosine_similarity(v, q) AS score, 'vector' AS score_source
  FROM qv JOIN sd USING (sc) JOIN dv USING (doc_id) WHERE list_cosine_similarity(v, q) >= 0.3
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) <= 20)"""
_CUT = """, c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS r FROM {source} QUALIFY r <= 20),
m AS (SELECT query_id, record_id, score_source, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5
  ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score FROM c WINDOW w AS (PARTITION BY query_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM m)
SELECT query_id, rank, record_id, round(score, 6) AS score, score_source FROM k
WHERE rank <= CASE WHEN query_id % 9 = 0 THEN 6 ELSE query_id % 9 END"""

ORACLE_SQL = {
    "knn_cosine": _knn("true", 10),
    "knn_threshold": f"SELECT query_id, record_id, score FROM ({_knn('true', 20, 'WHERE raw >= 0.3')})",
    "knn_scoped": _knn("r.label IN (1, 4)", 5),
    "dimension_guard": """SELECT count(*) FILTER (vec_id % 7 <> 0 AND vec_id % 11 <> 0) AS comparable,
  count(*) FILTER (vec_id % 7 <> 0 AND vec_id % 11 = 0) AS empty_vector,
  count(*) FILTER (vec_id % 7 = 0) AS dimension_mismatch FROM embeddings""",
    "storable_vectors": "SELECT vec_id AS record_id, 8 AS dimensions FROM embeddings WHERE vec_id % 3 = 1",
    "adjacent_similarity": """SELECT 'kb_' || label AS knowledge_base_id, vec_id AS record_id,
  coalesce(list_cosine_similarity(lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id),
    embedding::DOUBLE[]) < 0.6, false) AS breaks FROM embeddings""",
    "rrf_hybrid": f"""WITH {retrieval._bm25()}, a AS ({retrieval._top('scored', 20)}),
lq AS ({retrieval.ORACLE_SQL['local_term_score']}),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score
  FROM (SELECT query_id, doc_id, rank FROM a UNION ALL SELECT query_id, doc_id, rank FROM lq) GROUP BY 1, 2)
{retrieval._top('f', 6)}""",
    "rerank_fusion": f"""WITH {retrieval._bm25()}, a AS ({retrieval._top('scored', 20)}),
b AS (SELECT query_id, doc_id, score AS r, 1000.0::DOUBLE / n_chars AS k FROM a JOIN documents USING (doc_id)),
f AS (SELECT query_id, doc_id, round(
  0.3 * CASE WHEN max(r) OVER w = min(r) OVER w THEN 0.5 ELSE (r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w) END +
  0.7 * CASE WHEN max(k) OVER w = min(k) OVER w THEN 0.5 ELSE (k - min(k) OVER w) / (max(k) OVER w - min(k) OVER w) END, 6)
  AS score FROM b WINDOW w AS (PARTITION BY query_id))
{retrieval._top('f', 6)}""",
    "content_hash": """SELECT doc_id, sha256(text) AS content_hash,
  (('0x' || sha256('doc_' || doc_id)[1:16])::UBIGINT)::VARCHAR AS point_id,
  list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(hex(encode('doc_' || doc_id)), ''),
    lambda c, i: CASE WHEN i % 2 = 1 THEN ('0x' || substr(hex(encode('doc_' || doc_id)), i, 2))::BIGINT ELSE NULL END)),
    lambda h, b: CASE WHEN b IS NULL THEN h ELSE ((xor(h, b)::HUGEINT * 16777619) % 4294967296)::BIGINT END) AS term_index
FROM documents""",
    "deterministic_embedding": """WITH d AS (SELECT 'doc_' || doc_id AS chunk_id,
  sha256('mock-embedding-v1|doc_' || doc_id || '|' || sha256(text) || '|' || n_chars) AS h FROM documents)
SELECT chunk_id, 8 AS dimensions, h[1:24] AS vector_ref, """
    + ", ".join(f"round(('0x' || h[{1 + 8 * i}:{8 + 8 * i}])::UBIGINT % 10000 / 10000.0::DOUBLE, 4) AS v{i}" for i in range(8))
    + " FROM d",
    "upsert_classify": f"WITH {_RECORDS} SELECT document_id, record_id, action, content FROM c",
    "upsert_summary": f"""WITH {_RECORDS} SELECT count(*) FILTER (action IN ('inserted', 'replaced')) AS indexed,
  count(*) FILTER (action = 'skipped') AS skipped, count(*) FILTER (action = 'replaced') AS replaced,
  count(*) AS stored FROM c""",
    "delete_by_document": f"""WITH {_RECORDS} SELECT record_id FROM o
WHERE NOT (source = 'src3' AND document_id = 'doc_3') AND source <> 'src5'""",
    "delete_counts": f"WITH {_RECORDS} SELECT count(*) AS deleted FROM o WHERE source = 'src5'",
    "replace_document": f"""WITH {_RECORDS} SELECT record_id, document_id, content FROM n UNION ALL
SELECT record_id, document_id, content FROM o WHERE document_id NOT IN (SELECT document_id FROM n)""",
    "last_writer_wins": """SELECT 'doc_' || user_id AS document_id, event_id AS task_id, CASE event_type WHEN 'purchase'
  THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'pending' END AS status, ts AS updated_at
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "compare_and_set": """WITH t AS (SELECT event_id AS task_id, CASE event_type WHEN 'purchase' THEN 'succeeded'
  WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'pending' END AS status,
  ((props->>'$.k')::INT % 5)::INT AS attempt_count, ts AS updated_at,
  event_type NOT IN ('purchase', 'error', 'click') AS applied FROM events)
SELECT task_id, CASE WHEN applied THEN 'running' ELSE status END AS status,
  CASE WHEN applied THEN attempt_count + 1 ELSE attempt_count END AS attempt_count,
  CASE WHEN applied THEN updated_at + INTERVAL 1 MINUTE ELSE updated_at END AS updated_at, applied FROM t""",
    "metadata_side_table": f"""WITH {_RECORDS} SELECT record_id, document_id, 0 AS chunk_index, document_id AS title FROM o
WHERE source IN ('src1', 'src2')""",
    "detect_kind": """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'application/pdf' WHEN 2 THEN 'text/markdown'
  WHEN 3 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
  WHEN 4 THEN 'text/markdown' ELSE 'text/plain' END AS kind FROM documents""",
    "data_uris": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "index_records": r"""
WITH w AS (SELECT doc_id, lang, source, unnest(range(CASE WHEN n_chars <= 600 THEN 1
    ELSE ceil((n_chars - 600) / 540.0::DOUBLE)::INT + 1 END)) AS k, text FROM documents),
p AS (SELECT *, substr(text, k * 540 + 1, 600) AS part FROM w),
t AS (SELECT *, regexp_replace(part, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS body,
  length(part) - length(regexp_replace(part, '^[ \t\n\r\f\v]+', '')) AS lead FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index FROM t WHERE body <> '')
SELECT source || '::doc_' || doc_id || '_chunk_' || (chunk_index + 1) AS record_id, source AS knowledge_base_id,
  'doc_' || doc_id AS document_id, chunk_index, 'doc_' || doc_id AS title, source AS index_name, lang AS tenant_id,
  length(body) AS n_chars, 8 AS dimensions, 'mock-embedding-v1' AS model,
  (k * 540 + lead)::VARCHAR AS start FROM n""",
    "markdown_sections": """
WITH l AS (SELECT doc_id, unnest(string_split(trim(text, e' \\n\\t\\r'), chr(10))) AS line,
  generate_subscripts(string_split(trim(text, e' \\n\\t\\r'), chr(10)), 1) AS i FROM documents),
m AS (SELECT doc_id, i, CASE WHEN line LIKE 'T%' THEN '# ' || line WHEN line LIKE 'A%' THEN '## ' || line ELSE line END
  AS line FROM l),
o AS (SELECT doc_id, i, line, coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos,
  (sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id))::BIGINT - 1 AS total FROM m),
h AS (SELECT *, row_number() OVER w AS n, coalesce(lead(pos) OVER w, total) AS stop FROM o WHERE line LIKE '#%'
  WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT 'doc_' || doc_id AS document_id, 'section-' || n AS section_id, trim(ltrim(line, '#')) AS title,
  CASE WHEN line LIKE '##%' THEN 2 ELSE 1 END AS level, pos AS start_offset, stop AS end_offset FROM h
UNION ALL SELECT DISTINCT 'doc_' || doc_id, 'section-1', 'doc_' || doc_id, 1, 0, total FROM o
WHERE doc_id NOT IN (SELECT doc_id FROM h)""",
    "search_keyword": f"WITH {_SCOPED} {_CUT.format(source='kw')}",
    "search_vector": f"WITH {_SCOPED} {_CUT.format(source='vec')}",
    "search_hybrid": f"""WITH {_SCOPED},
vr AS (SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS r FROM vec),
kr AS (SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS r FROM kw
  WHERE query_id IN (SELECT query_id FROM vec) QUALIFY r <= 20),
hy AS (SELECT query_id, record_id, sum(1.0::DOUBLE / (60 + r)) AS score, 'hybrid' AS score_source
  FROM (SELECT * FROM vr UNION ALL SELECT * FROM kr) GROUP BY 1, 2
  UNION ALL SELECT * FROM kw WHERE query_id NOT IN (SELECT query_id FROM vec))
{_CUT.format(source='hy')}""",
    "entity_upsert": """SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'renamed' WHEN n_regionkey = 3 THEN lower(n_name)
  ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 2""",
}
