"""Searches over written indexes, words by dictionary, and versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import fixtures
from quern.functions.vector import content_hash, deterministic_vector
from quern.operators import chunk_function, segmentation
from quern.operators.bitmaps import All, Any, BitmapIndex, Equals
from quern.operators.bm25 import Columns
from quern.operators.postings import PostingsIndex
from quern.operators.stages import Stage, StageStore
from quern.operators.vector_index import VectorIndex, recall
from quern.plans import chunking, indexing, retrieval
from quern.plans.backends import _VEC, _records, _store
from quern.session import materialize, shared_dir
from quern.sources import table_source

#: Ideographs that stand for the letters a to z, so that texts of words without spaces can be
#: had from the documents.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
IDEOGRAPHS = "".join(chr(0x4E00 + 7 * k) for k in range(26))


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/quern-{kind}-{uuid.uuid4().hex}"


def _vectors(spark: SparkSession, sf_dir: str) -> VectorIndex:
    return VectorIndex.build(fixtures.vector_records(spark, sf_dir), _folder(spark, "vectors"))


def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All neighbours: probed cells first, then those that the bounds leave open."""
    found = _vectors(spark, sf_dir).search(fixtures.vector_queries(spark, sf_dir), 20, exact=True, digits=6)
    return found.select("query_id", "record_id", "score", "rank")


def vector_index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter reaches the reader of the cells."""
    inside = F.col("knowledge_base_id").isin("kb_1", "kb_4")
    found = _vectors(spark, sf_dir).search(fixtures.vector_queries(spark, sf_dir), 5, exact=True, digits=6, where=inside)
    return found.select("query_id", "record_id", "score", "rank")


def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the best 20 the probed cells alone find, over all queries."""
    index, asked = _vectors(spark, sf_dir), fixtures.vector_queries(spark, sf_dir)
    exact = index.search(asked, 20, exact=True, digits=6)
    found = recall(index.search(asked, 20, digits=6), exact).agg(
        F.count(F.lit(1)).alias("n_queries"), F.sum("n").alias("n_hits"), F.sum("n_found").alias("_found")
    )
    return found.select("n_queries", "n_hits", (10 * F.col("_found") >= 9 * F.col("n_hits")).alias("reaches_90_percent"))


def postings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = PostingsIndex.build(fixtures.documents(spark, sf_dir), _folder(spark, "postings"), retrieval.CHUNKS)
    return index.search(fixtures.queries(spark, sf_dir), 20, retrieval.CHUNKS, digits=6).hits().select("query_id", "doc_id", "score", "rank")


def postings_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titled chunks of two segments; the second is added to what is there."""
    docs = fixtures.documents(spark, sf_dir)
    german = F.col("tenant_id") == "de"
    index = PostingsIndex.build(docs.filter(~german), _folder(spark, "postings"), retrieval.TITLED)
    index.add(docs.filter(german), retrieval.TITLED)
    return index.search(fixtures.queries(spark, sf_dir), 6, retrieval.TITLED, digits=6).hits().select("query_id", "doc_id", "score", "rank")


def _ideographs(column: str = "text"):
    return F.translate(F.lower(column), LETTERS, IDEOGRAPHS)


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents' own ideographs that occur fifty times or more."""
    runs = fixtures.documents(spark, sf_dir).select(F.explode(F.regexp_extract_all(_ideographs(), F.lit("([一-龥]+)"), F.lit(1))).alias("word"))
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("frequency")).filter("frequency >= 50")


def dictionary_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct run of ideographs, cut by the dictionary."""
    segment = segmentation.segmenter(materialize(_dictionary(spark, sf_dir), "words"))
    runs = fixtures.documents(spark, sf_dir).select(F.explode(F.regexp_extract_all(_ideographs(), F.lit("([一-龥]+)"), F.lit(1))).alias("run"))
    return runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).select("run", "n", F.array_join(segment(F.col("run")), " ").alias("words"))


def dictionary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over terms that include the dictionary's words (no SQL: the tests compare it)."""
    segment = segmentation.segmenter(materialize(_dictionary(spark, sf_dir), "words"))
    columns = Columns(chunk="doc_id", tokenize=segmentation.tokenizer(segment))
    docs = fixtures.documents(spark, sf_dir).withColumn("text", _ideographs())
    asked = fixtures.queries(spark, sf_dir).withColumn("query", _ideographs("query"))
    index = PostingsIndex.build(docs, _folder(spark, "postings"), columns)
    return index.search(asked, 20, columns, digits=6).hits().select("query_id", "doc_id", "score", "rank")


def versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge bases of three versions: written, some replaced and added, some deleted."""
    docs = fixtures.documents(spark, sf_dir)
    empty = lambda *c: [F.lit(None).cast("string").alias(x) for x in c]
    bases = docs.groupBy("knowledge_base_id").agg(F.count(F.lit(1)).alias("document_count"), F.max("doc_id").alias("_last"))
    rows = bases.select("knowledge_base_id", F.col("knowledge_base_id").alias("name"), *empty("tenant_id", "org_id"), "document_count", F.lit(None).cast("timestamp").alias("updated_at"), "_last")
    store = _store(spark)
    store.append("knowledge_bases", rows.filter("knowledge_base_id < 'src5'"))
    store.upsert("knowledge_bases", rows.filter("knowledge_base_id > 'src2'").withColumn("name", F.lit("new")), "knowledge_base_id")
    store.delete("knowledge_bases", F.col("knowledge_base_id") == "src7")
    numbers = store.table("knowledge_bases").versions()
    parts = [store.read("knowledge_bases", n).select(F.lit(n).alias("version"), "knowledge_base_id", "name", "document_count") for n in numbers]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _source_table(spark: SparkSession, sf_dir: str) -> str:
    """The path of a collection in three versions, the first written by the data source."""
    table_source.register(spark)
    store = _store(spark)
    records = _records(spark, sf_dir).filter(F.size("vector") == 3)
    writer = records.write.format(table_source.NAME).options(path=store.path("index_records"), table="index_records")
    writer.mode("append").save()
    store.upsert("index_records", records.filter("tenant_id = 'de'").withColumn("title", F.lit("changed")), "record_id")
    store.delete("index_records", F.col("knowledge_base_id") == "src1")
    return store.path("index_records")


def table_source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant's records of some bases, and one without a filter that the scan can take."""
    found = spark.read.format(table_source.NAME).options(path=_source_table(spark, sf_dir), table="index_records").load()
    own = found.filter(F.col("tenant_id").isin("de", "en") & (F.col("knowledge_base_id") != "src2") & F.col("title").isNotNull())
    return own.select("record_id", "title", "content", F.round(F.element_at("vector", 1), 1).alias("first"))


def table_source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per base as a stream of the collection's versions counts them: the rows that
    were written, and again those that replaced some."""
    path = _source_table(spark, sf_dir)
    added = spark.readStream.format(table_source.NAME).options(path=path, table="index_records").load()
    out = _folder(spark, "changes")
    written = added.select("knowledge_base_id", "title").writeStream.format("parquet").option("checkpointLocation", f"{out}-state")
    written.trigger(availableNow=True).start(out).awaitTermination()
    rows = spark.read.schema("knowledge_base_id string, title string").parquet(out)
    return rows.groupBy("knowledge_base_id").agg(F.count(F.lit(1)).alias("added"), F.count_if(F.col("title") == "changed").alias("changed"))


def _bitmaps(spark: SparkSession, sf_dir: str) -> BitmapIndex:
    docs = fixtures.labelled_documents(spark, sf_dir)
    return BitmapIndex.build(docs, _folder(spark, "bitmaps"), record="doc_id", columns=("knowledge_base_id", "tenant_id"))


def bitmap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AND and OR of loose and exact tests, by bitmaps alone."""
    good = All(Equals("quality", " 1 "), Equals("lang", "EN"))
    wanted = Any(good, All(Equals("toxic", "1", loose=False), Any(Equals("tenant_id", "de"), Equals("knowledge_base_id", "src3"))))
    return _bitmaps(spark, sf_dir).records(wanted, "doc_id")


def bitmap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per value of a key: the numbers of bits."""
    rows = spark.read.parquet(f"{_bitmaps(spark, sf_dir).path}/bits")
    return rows.groupBy("key", "value").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def _stages() -> list[Stage]:
    """Texts to paragraphs, paragraphs to vectors."""

    def cut(rows: DataFrame) -> DataFrame:
        parts = F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")
        return rows.select("_key", F.posexplode(parts).alias("chunk_index", "content"))

    def embed(rows: DataFrame) -> DataFrame:
        found = content_hash(F.col("content"))
        return rows.select("_key", deterministic_vector(F.lit("m"), F.lit("c"), found, F.length("content")).alias("vector"))

    return [
        Stage("chunk", "1", ["text"], "chunk_index int, content string", cut),
        Stage("embed", "1", ["content"], "vector array<float>", embed),
    ]


def resumed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, the second over more documents: what each stage worked on, and all chunks."""
    docs, store = fixtures.documents(spark, sf_dir).select("doc_id", "tenant_id", "text"), StageStore(spark, _folder(spark, "stages"))
    _, first = store.run_all(_stages(), docs.filter("tenant_id <> 'de'"))
    chunks, second = store.run_all(_stages(), docs)
    rows = [(name, first[name], second[name]) for name in first]
    counted = spark.createDataFrame(rows, "stage string, first_run long, second_run long")
    return counted.crossJoin(F.broadcast(chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.size("vector") == 8).alias("n_vectors"))))


def chunk_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recursive chunker called from SQL, over a table by language."""
    chunk_function.register(spark)
    docs = fixtures.documents(spark, sf_dir).select("document_id", "tenant_id", "text")
    return spark.sql(
        """
        SELECT document_id, concat(document_id, '_chunk_', chunk_index + 1) AS chunk_id, chunk_index, chunk AS text,
          length(chunk) AS char_count, start, stop
        FROM chunk(TABLE({docs}), 'recursive', 400, 50)
        """,
        docs=docs,
    )


QUERIES = {
    f.__name__: f
    for f in (
        vector_index_search, vector_index_filtered, vector_index_recall, postings_search, postings_segments, dictionary_words,
        dictionary_search, versioned_upsert, table_source_scan, table_source_changes, bitmap_filter, bitmap_counts, resumed_stages, chunk_table_function,
    )
}

#: The longest run and word that the unrolled steps below cover.
_LONGEST_RUN = 48


def _words_sql() -> str:
    """Best paths from left to right, a step per place: of the paths to a place the cheapest,
    of equally cheap ones that of the longest first word."""
    runs = f"""runs AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(lower(text), '{LETTERS}', '{IDEOGRAPHS}'),
  '[一-龥]+')) AS run FROM documents) GROUP BY run),
dict AS (SELECT run AS word, n, floor(1000 * ln((sum(n) OVER ())::DOUBLE / n) + 0.5)::BIGINT AS cost, sum(n) OVER () AS total FROM runs WHERE n >= 50),
places AS (SELECT run, unnest(range(length(run))) AS i FROM runs),
spans AS (SELECT run, i, unnest(range(i + 1, least(length(run), i + (SELECT max(length(word)) FROM dict)) + 1)) AS j FROM places),
edges AS MATERIALIZED (SELECT run, i, j, cost, true AS known FROM spans JOIN dict ON word = run[i + 1:j]
  UNION ALL SELECT run, i, i + 1, (SELECT floor(1000 * ln(max(total)::DOUBLE) + 0.5)::BIGINT + 2000 FROM dict), false FROM places
  WHERE run[i + 1:i + 1] NOT IN (SELECT word FROM dict)),
b0 AS (SELECT run, 0 AS i, 0::BIGINT AS cost, []::BIGINT[] AS stops, []::BOOLEAN[] AS known FROM runs)"""
    parts = [runs]
    for i in range(1, _LONGEST_RUN + 1):
        before = " UNION ALL ".join(f"SELECT * FROM b{j}" for j in range(max(0, i - 24), i))
        parts.append(
            f"""b{i} AS MATERIALIZED (SELECT run, {i} AS i, b.cost + e.cost AS cost, list_append(stops, {i}) AS stops, list_append(b.known, e.known) AS known
  FROM ({before}) b JOIN edges e USING (run, i) WHERE e.j = {i}
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY b.cost + e.cost, list_append(stops, {i}) DESC) = 1)"""
        )
    whole = " UNION ALL ".join(f"SELECT * FROM b{i} WHERE length(run) = {i}" for i in range(1, _LONGEST_RUN + 1))
    return f"""WITH {", ".join(parts)},
pieces AS (SELECT run, k, stops[k] AS stop, coalesce(stops[k - 1], 0) AS start, known[k] AS known, k > 1 AND NOT known[k] AND NOT known[k - 1] AS joins
  FROM (SELECT run, stops, known, unnest(range(1, len(stops) + 1)) AS k FROM ({whole})))
SELECT run, any_value(n) AS n, ltrim(string_agg(CASE WHEN joins THEN '' ELSE ' ' END || run[start + 1:stop], '' ORDER BY k)) AS words
FROM pieces JOIN runs USING (run) GROUP BY run"""


_BASES = "SELECT source AS knowledge_base_id, count(*) AS document_count FROM documents GROUP BY source"

ORACLE_SQL = {
    "vector_index_search": indexing._knn("true", 20),
    "vector_index_filtered": indexing._knn("r.label IN (1, 4)", 5),
    "vector_index_recall": """SELECT count(*) AS n_queries, 20 * count(*) AS n_hits, true AS reaches_90_percent FROM embeddings WHERE vec_id % 50 = 0""",
    "postings_search": retrieval.ORACLE_SQL["bm25_search"],
    "postings_segments": retrieval.ORACLE_SQL["bm25_title_boost"],
    "dictionary_words": _words_sql(),
    "bitmap_filter": """SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id)
WHERE (quality = 1 AND lang = 'en') OR (toxic = 1 AND (lang = 'de' OR source = 'src3'))""",
    "bitmap_counts": """WITH m AS (SELECT lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
p AS (SELECT unnest(['lang', 'tenant_id', 'knowledge_base_id', 'quality', 'toxic']) AS key, unnest([lang, lang, source, quality::VARCHAR, toxic::VARCHAR]) AS value FROM m)
SELECT key, value, count(*) AS n FROM p WHERE value IS NOT NULL GROUP BY key, value""",
    "chunk_table_function": chunking.ORACLE_SQL["chunk_recursive"],
    "resumed_stages": """WITH c AS (SELECT lang, unnest(string_split(text, chr(10))) AS p FROM documents),
k AS (SELECT * FROM c WHERE trim(p, ' ') <> ''), n AS (SELECT count(*) AS n FROM k),
t AS (SELECT 'chunk' AS stage, text AS x, lang FROM documents UNION ALL SELECT 'embed', p, lang FROM k)
SELECT stage, count(DISTINCT x) FILTER (lang <> 'de') AS first_run, count(DISTINCT x) - count(DISTINCT x) FILTER (lang <> 'de') AS second_run,
  any_value(n) AS n_chunks, any_value(n) AS n_vectors FROM t, n GROUP BY stage""",
    "table_source_scan": f"""WITH {_VEC} SELECT record_id, CASE WHEN lang = 'de' THEN 'changed' ELSE 'doc_' || doc_id END AS title,
  md5(text) AS content, (length(text) % 3)::DOUBLE AS first FROM r WHERE lang IN ('de', 'en') AND source NOT IN ('src1', 'src2')""",
    "table_source_changes": f"""WITH {_VEC}, w AS (SELECT source, false AS again FROM r UNION ALL SELECT source, true FROM r WHERE lang = 'de')
SELECT source AS knowledge_base_id, count(*) AS added, count(*) FILTER (again) AS changed FROM w GROUP BY source""",
    "versioned_upsert": f"""WITH b AS ({_BASES})
SELECT 1 AS version, knowledge_base_id, knowledge_base_id AS name, document_count FROM b WHERE knowledge_base_id < 'src5'
UNION ALL SELECT v, knowledge_base_id, CASE WHEN knowledge_base_id > 'src2' THEN 'new' ELSE knowledge_base_id END, document_count
FROM b, (VALUES (2), (3)) t(v) WHERE v = 2 OR knowledge_base_id <> 'src7'""",
}
