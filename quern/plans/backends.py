"""Parsers, stores, back ends, read-models and messages: one query per operator."""

from __future__ import annotations

import uuid
import zipfile
from io import BytesIO
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import fixtures
from quern.functions.text import tokenize_terms
from quern.functions.vector import fnv1a32, sparse_document, sparse_query, strict_cosine
from quern.operators import backends, bm25, conversation, entities, filters, indexing, planning, tasks, views
from quern.operators.chunking import merge_sentences
from quern.operators.ranking import top_k
from quern.operators.search import lexical_reranker, search_rounds
from quern.plans import retrieval
from quern.schemas import schema
from quern.session import materialize, shared_dir
from quern.sources import parsers, stores


def _store(spark: SparkSession, file_format: str = "parquet") -> stores.TableStore:
    """A store of this query's own in the shared folder."""
    path = f"{shared_dir(spark)}/quern-store-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return stores.TableStore(spark, path, file_format)


# --- parsers -----------------------------------------------------------------------------


def file_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as files and read back by their addresses, with line ends made one and
    titles from the file names."""
    items = fixtures.table(spark, sf_dir, "benchmark").select("text", F.col("item_id").cast("string").alias("name"))
    folder = f"{shared_dir(spark)}/quern-files-{uuid.uuid4().hex}"
    text = F.concat(F.lit("\r\n "), F.regexp_replace("text", " ", "\r\n"), F.lit("\r"))
    items.select(text.alias("value"), "name").write.partitionBy("name").text(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    found = parsers.read_files(spark, f"{folder}/*/*.txt").withColumn(
        "item_id", F.regexp_extract("source_uri", "name=([0-9]+)", 1).cast("long")
    )
    title = parsers.fallback_title(F.concat(F.lit("/a/b.c/ Item "), F.col("item_id").cast("string"), F.lit(".v1.txt")), F.lit("?"))
    body = parsers.normalize_lines(F.decode("content", "UTF-8"))
    return found.select("item_id", title.alias("title"), F.sha2(body, 256).alias("text_sha256"))


def _as_docx(title: str, text: str) -> bytes:
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    lines = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in text.split("\n"))
    held = BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {space}><w:body>{lines}</w:body></w:document>")
        archive.writestr("docProps/core.xml", f"<core><title>{escape(title)}</title></core>")
    return held.getvalue()


def docx_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put into DOCX archives and parsed; every seventh is no archive."""

    text = F.regexp_replace("text", r"[\x00-\x08\x0b-\x1f]", "")
    named = F.concat("title", F.lit("\n"), F.coalesce(text, F.lit(""))).alias("named")
    docs = fixtures.documents(spark, sf_dir).select(F.col("doc_id").alias("source_uri"), named)
    made = parsers.in_slices(docs, "named", "archive binary", lambda t: [_as_docx(*t.split("\n", 1))])
    content = F.when(F.col("source_uri") % 7 == 3, F.encode(F.lit("no archive"), "UTF-8")).otherwise(F.col("archive"))
    parsed = parsers.parse_docx(made.select("source_uri", content.alias("content")))
    problem = parsers.error_struct(F.col("error"), "docx")
    return parsed.select(
        F.col("source_uri").alias("doc_id"), "title", F.sha2(F.regexp_replace("text", r"\s+", " "), 256).alias("text_sha256"),
        problem["code"].alias("code"), problem["source"].alias("source"), problem["retryable"].alias("retryable"),
    )


def parser_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    provider = F.when(i % 5 == 0, " Tika ").when(i % 5 == 1, "SIMPLE").when(i % 5 == 2, "auto").when(i % 5 == 3, "other")
    kind = F.when(i % 3 == 0, parsers.PDF).when(i % 3 == 1, parsers.DOCX).otherwise(parsers.PLAIN)
    code = F.when(i % 4 == 0, "file-read-failed").when(i % 4 == 1, "bad-archive").when(i % 4 == 2, "timed-out")
    problem = parsers.error_struct(code, "parser")
    return fixtures.documents(spark, sf_dir).select(
        "doc_id", parsers.route_parser(provider, kind).alias("parser"), problem["code"].alias("code"), problem["retryable"].alias("retryable")
    )


def server_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties from a document server's answers, which name them differently."""
    i = F.col("doc_id")
    answer = F.to_json(
        F.when(i % 3 == 0, F.create_map(F.lit("dc:title"), "title", F.lit("title"), F.lit("x"), F.lit("xmpTPg:NPages"), (i % 9).cast("string")))
        .when(i % 3 == 1, F.create_map(F.lit("Title"), "title", F.lit("Content-Language"), "tenant_id", F.lit("Page-Count"), F.lit("many")))
        .otherwise(F.create_map(F.lit("language"), F.col("tenant_id")))
    )
    listed = F.when(i % 2 == 0, F.concat(F.lit("["), answer, F.lit("]"))).otherwise(answer)
    return fixtures.documents(spark, sf_dir).select("doc_id", parsers.server_metadata(listed).alias("m")).select("doc_id", "m.*")


def parse_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a first parser refuses are parsed by the second, which says why."""
    sources = fixtures.documents(spark, sf_dir).select(F.col("doc_id").alias("source_uri"), "text")
    bad = F.when(F.col("source_uri") % 4 == 1, "bad-archive")
    first = sources.select("source_uri", F.when(bad.isNull(), F.concat(F.lit("> "), "text")).alias("text"), bad.alias("error"))
    made = parsers.with_parse_fallback(first, sources, lambda rest: rest.select("source_uri", "text", F.lit(None).cast("string").alias("error")))
    return made.select(F.col("source_uri").alias("doc_id"), F.md5("text").alias("text_md5"), "fallback_reason")


def placeholder_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.documents(spark, sf_dir).select("document_id", "filename", F.concat(F.lit("file:///"), "filename").alias("source_uri"))
    return backends.placeholder_chunks(backends.placeholder_documents(docs))


# --- stores ------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index records of documents; every tenth without a vector, others of two lengths."""
    i = F.col("doc_id")
    vector = F.when(i % 10 == 7, F.array().cast("array<float>")).when(i % 10 == 3, F.array(F.lit(1.0).cast("float")))
    own = F.array(*((F.length("text") % m).cast("float") for m in (3, 5, 7)))
    docs = fixtures.labelled_documents(spark, sf_dir).select(
        "doc_id", F.lpad(i.cast("string"), 9, "0").alias("record_id"), "knowledge_base_id", "document_id", F.when(i % 2 == 0, F.col("chunk_id")).otherwise(" ").alias("chunk_id"),
        F.lit(0).alias("chunk_index"), "title", F.md5("text").alias("content"), vector.otherwise(own).alias("vector"), "tenant_id", "org_id",
        F.col("knowledge_base_id").alias("index_name"), F.array("tenant_id").alias("section_path"), "metadata",
    )
    return docs.drop("doc_id")


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index metadata as JSON lines: exported, taken into an empty store, replaced, read."""
    rows = indexing.index_metadata(_records(spark, sf_dir)).select(*schema("index_metadata").fieldNames())
    store = _store(spark, "json")
    lines = stores.ndjson(rows.unionByName(rows.limit(1).withColumn("record_id", F.lit(" "))))
    lines.write.text(store.path("export"))
    store.bootstrap("index_metadata", store.path("export"), "record_id")
    assert not store.bootstrap("index_metadata", store.path("export"), "record_id")
    store.overwrite("index_metadata", store.read("index_metadata").withColumn("chunk_index", F.lit(1)))
    found = store.read("index_metadata")
    return found.select("record_id", "document_id", "chunk_index", F.element_at("metadata", "lang").alias("lang"))


def vector_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written to a collection with their side table: equal lengths only, an update,
    a deletion, a search by tenant and base."""
    store = _store(spark)
    collection = backends.VectorCollection(store)
    collection.create()
    records = _records(spark, sf_dir)
    backends.write_with_metadata(collection, records)
    changed = records.filter("tenant_id = 'de'").withColumn("title", F.lit("changed"))
    side = backends.write_with_metadata(collection, changed)
    collection.delete(backends.store_filter(knowledge_base_ids=("src1", " src2 ")))
    kept = collection.read()
    joined = kept.select("record_id", "title", F.size("vector").alias("dimensions")).join(
        side.select("record_id", F.col("title").alias("side_title")), "record_id"
    )
    return joined


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest records without a ``k``, in a tenant, of two bases, by exact metadata."""
    collection = backends.VectorCollection(_store(spark))
    collection.upsert(_records(spark, sf_dir))
    condition = backends.store_filter(tenant_id=" en ", knowledge_base_ids=("src1", "src2", "src3"), filters={"lang": "en", "quality": None})
    asked = fixtures.queries(spark, sf_dir).select(
        "query_id", F.array(*((F.col("query_id") % m + 1).cast("float") for m in (3, 5, 7))).alias("query_vector")
    )
    found = collection.search(asked, condition=condition)
    return found.select("query_id", "rank", F.round("score", 6).alias("score"))


def vector_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the records that a filter lets through."""
    records = _records(spark, sf_dir).filter(backends.store_filter(filters={"lang": "en"}))
    first = materialize(backends.scroll(records), "page")
    last = first.agg(F.max("record_id").alias("r")).first().r
    return backends.scroll(records, after=last).select("record_id", "knowledge_base_id")


def exact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _records(spark, sf_dir)
    return found.filter(filters.exact_metadata_matches({"quality": "1", "toxic": "0"}, F.col("metadata"))).select("record_id")


def record_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records through the database's payload and back, as annotated search hits."""
    points = indexing.payload(_records(spark, sf_dir))
    hits = indexing.annotate_hits(indexing.record_chunks(indexing.from_payload(points)), "index", "local", "index-empty")
    keys = F.array_join(F.array_sort(F.map_keys("metadata")), ",")
    return hits.select("record_id", "chunk_id", keys.alias("keys"), F.element_at("metadata", "documentId").alias("document"), F.element_at("metadata", "actualSource").alias("source"))


def backend_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which back end a configuration gets, and whether a broken one is replaced."""

    def broken():
        raise OSError("no connection")

    makers = {"json": lambda: "json", "vectors": broken}
    rows = []
    for k, (name, fallback) in enumerate((("", ""), (" JSON ", ""), ("vectors", "Json"), ("vectors", ""), ("other", "json"))):
        try:
            rows.append((k, backends.resolve(name, makers, "json", fallback)[0]))
        except (RuntimeError, ValueError) as problem:
            rows.append((k, type(problem).__name__))
    chosen = spark.createDataFrame(rows, "number long, backend string")
    nations = fixtures.table(spark, sf_dir, "nation").filter("n_nationkey < 5")
    return nations.join(chosen, nations["n_nationkey"] == chosen["number"]).select("number", "backend")


def task_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stores.project_task(fixtures.tasks(spark, sf_dir).withColumn("max_attempts", F.when(F.col("k") % 3 == 0, 0).otherwise(F.col("k") % 6).cast("int")))
    stored = F.get_json_object("task_json", "$.status")
    return made.select("task_id", "attempt_count", "max_attempts", "attempts_remaining", stored.alias("stored_status"))


def chat_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as pieces of a stream, one JSON line each."""
    said = fixtures.messages(spark, sf_dir).select("message_id", F.posexplode(stores.stream_pieces("content")).alias("position", "delta"))
    lines = stores.ndjson(said)
    back = F.from_json("value", "message_id string, position int, delta string")
    return lines.select(back.alias("e")).select("e.message_id", "e.position", F.length("e.delta").alias("n"), F.md5("e.delta").alias("delta_md5"))


# --- values, counters, caches --------------------------------------------------------------


def merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.when(F.col("doc_id") % 5 != 0, F.create_map(F.lit("lang"), F.lit("old"), F.lit("a"), F.lit("1")))
    made = fixtures.labelled_documents(spark, sf_dir).select("doc_id", backends.merge_maps(base, F.col("metadata")).alias("m"))
    entries = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return made.select("doc_id", F.array_join(entries, ",").alias("entries"))


def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {
        "lang": F.col("tenant_id"), "number": F.col("n_chars"), "flag": F.col("n_chars") > 500,
        "nothing": F.when(F.col("n_chars") < 0, "x"), "list": F.array("doc_id", F.lit(None)),
        "object": F.struct(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("none"), F.array(F.lit("a")).alias("list")),
        "day": F.date_add(F.lit("2024-01-01"), (F.col("doc_id") % 28).cast("int")),
    }
    return fixtures.documents(spark, sf_dir).select("doc_id", *(backends.json_value(v).alias(f"{k}_json") for k, v in values.items()))


def total_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = fixtures.documents(spark, sf_dir).groupBy("knowledge_base_id").agg(F.count(F.lit(1)).alias("document_count"))
    return backends.total_documents(bases)


def postings_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of corpora that are asked for again; a changed text is another corpus."""
    cache = backends.PostingsCache(_store(spark), most=2, columns=retrieval.CHUNKS)
    docs = fixtures.documents(spark, sf_dir)
    first, second = docs.filter("tenant_id = 'en'"), docs.filter("tenant_id = 'de'")
    changed = first.withColumn("text", F.concat("text", F.lit(" more")))
    sizes = [cache.terms(d).agg(F.sum("_dl")).first()[0] for d in (first, second, first, changed, first)]
    row = cache.statistics() | {"n_terms": sizes[0], "same": sizes[0] == sizes[2] == sizes[4]}
    kinds = "hits long, misses long, hit_rate string, entries long, max_size long, evictions long, n_terms long, same boolean"
    return spark.createDataFrame([tuple(row.values())], kinds)


def health_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows():
        assert fixtures.table(spark, sf_dir, "nation").count() == 25

    def broken():
        raise OSError("no connection")

    return backends.health(spark, {"tables": rows, "vectors": broken}, timeout=120)


# --- vectors -------------------------------------------------------------------------------


def strict_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's cosine: rows with a zero norm have none and are dropped."""
    vector = F.when(F.col("record_id") % 5 == 0, F.transform("vector", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("vector"))
    scored = fixtures.vector_records(spark, sf_dir).select("record_id", strict_cosine(vector, F.array_repeat(F.lit(1.0).cast("float"), 64)).alias("s"))
    return scored.filter("s is not null").select("record_id", F.round("s", 6).alias("score"))


def sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of queries as sparse vectors, with the places that hashing gives them."""
    asked = fixtures.queries(spark, sf_dir).select("query_id", tokenize_terms(F.col("query")).alias("t"))
    made = asked.select("query_id", sparse_document(F.col("t")).alias("d"), sparse_query(F.col("t")).alias("q"))
    weights = F.aggregate(F.map_values("d"), F.lit(0.0), lambda s, x: s + x)
    return made.select(
        "query_id", F.size("d").alias("n_terms"), weights.alias("weight"), F.map_keys("d") == F.map_keys("q"),
        F.aggregate(F.transform(F.map_keys("d"), fnv1a32), F.lit(0).cast("long"), lambda s, x: s + x).alias("places"),
    ).toDF("query_id", "n_terms", "weight", "same_terms", "places")


def embedding_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider that answers for some languages only; the rest is made here."""
    chunks = fixtures.documents(spark, sf_dir).withColumns({"chunk_index": F.lit(0), "char_count": F.col("n_chars")})

    def provider(inputs):
        made = indexing.deterministic_provider(inputs.filter("char_count % 3 <> 1"), "served")
        answered = F.when(F.endswith("chunk_id", F.lit("7")), F.array().cast("array<float>")).otherwise(F.col("vector"))
        return made.withColumn("vector", answered)

    return indexing.embed(indexing.embedding_inputs(chunks), provider).select("chunk_id", "embedding_source", "model", "dimensions")


def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 by keyword with their share of the query's terms."""
    docs, asked = fixtures.documents(spark, sf_dir), fixtures.queries(spark, sf_dir)
    scored = bm25.bm25_scores(docs, asked, retrieval.CHUNKS).withColumn("score", F.round("score", 6))
    best = top_k(scored, 20, tie="doc_id").select("query_id", "doc_id")
    texts = best.join(asked.select("query_id", "query"), "query_id").join(docs.select("doc_id", F.col("text").alias("content")), "doc_id")
    return lexical_reranker(texts).select("query_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"))


def agent_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of an agent's rounds: hits of all rounds stay, also repeated ones."""
    names = fixtures.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    key = F.col("r_regionkey").cast("string")
    first = F.when(F.col("r_regionkey") == 0, "NATION_1").otherwise(F.concat(F.lit("NATION_1"), key))
    turns = fixtures.table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("query_id"), first.alias("rewritten"),
        F.array(first, F.lit("none"), F.concat(F.lit("NATION_"), key)).alias("sub_queries"),
    )

    def find(asked):
        return asked.join(names, F.startswith("name", "query")).select("query_id", "query", "name", (4 / F.length("name")).alias("score"))

    found = search_rounds(turns, find, most=3, least=0.5)
    return found.select("query_id", "query", "name", "round")


# --- read-models, messages -------------------------------------------------------------------


def ingestion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("k")
    events = F.when(i % 3 != 0, F.array_repeat(F.lit("x"), (i % 4).cast("int")))
    rows = fixtures.tasks(spark, sf_dir).withColumns(
        {"trace": events, "chunks": F.when(i % 5 == 0, F.array(F.lit(1), F.lit(2))), "retryable": F.when(i % 2 == 0, F.lit(True))}
    )
    return views.task_summary(rows)


def _region_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as intents; two of three nations are enabled."""
    regions = fixtures.table(spark, sf_dir, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("intent_id"), F.lit(None).cast("string").alias("parent_intent_id"),
        F.col("r_name").alias("name"), F.lit(1).alias("priority"), F.lit(True).alias("enabled"),
    )
    nations = fixtures.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "n_name", F.lit(2), F.col("n_nationkey") % 3 != 0,
    )
    return regions.union(nations)


def region_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as a tree of intents."""
    return views.intent_tree(_region_intents(spark, sf_dir)).select("intent_id", "name", "priority", "depth", "root_id", "path")


def intent_tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.intent_statistics(region_tree(spark, sf_dir), _region_intents(spark, sf_dir))


def session_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.messages(spark, sf_dir).groupBy("conversation_id").agg(F.min_by("content", "position").alias("title"))
    named = rows.select(F.col("conversation_id").cast("string").alias("conversation_id"), "title")
    return filters.sessions_matching(named, " The ").select("conversation_id")


def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which guards actors pass, and which tools they see."""
    i = F.col("n_nationkey")
    actor = F.struct(
        F.when(i % 5 != 0, F.col("n_name")).otherwise(" ").alias("user_id"), F.when(i % 3 == 0, "admin").otherwise("user").alias("role"),
        F.when(i % 2 == 0, "t").alias("tenant_id"), F.when(i % 4 == 0, "o").otherwise("").alias("org_id"),
    )
    names = ("public", "signed-in", "tenant", "org", "admin")
    tools = entities.visible_tools({f"tool_{n}": n for n in names}, F.col("actor"))
    rows = fixtures.table(spark, sf_dir, "nation").withColumn("actor", actor)
    passed = F.concat(*(filters.guard(F.col("actor"), n).cast("int").cast("string") for n in names))
    return rows.select("n_nationkey", passed.alias("passed"), F.array_join(tools, ",").alias("tools"))


def turn_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace rows of user turns with two steps each."""
    turns = fixtures.messages(spark, sf_dir).filter("role = 'user'").select(
        F.col("message_id").alias("turn_id"), F.col("content").alias("message"), F.concat(F.lit("> "), "content").alias("rewritten")
    )
    steps = F.array(
        F.struct(F.lit("search").alias("kind"), F.col("message").alias("text")), F.struct(F.lit("answer").alias("kind"), F.lit("done").alias("text"))
    )
    made = planning.agent_trace(turns, steps)
    return made.select("turn_id", "position", "stage", F.length("preview").alias("n"), F.md5("preview").alias("preview_md5"))


def task_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace rows of tasks with an event per attempt."""
    rows = fixtures.tasks(spark, sf_dir).select(
        F.col("task_id").cast("string").alias("trace_id"), "status", "created_at",
        F.transform(
            F.slice(F.array(F.lit("parse"), F.lit("chunk"), F.lit("embed"), F.lit("index")), F.lit(1), F.col("attempt_count")),
            lambda s: F.struct(s.alias("stage"), F.lit("ok").alias("status"), F.col("updated_at").alias("at")),
        ).alias("trace"),
    )
    return tasks.stage_trace(rows).select("trace_id", "position", "stage", "status")


def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sentences, joined until 400 characters; every fourth line starts anew."""
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.struct(F.concat(F.lit("<"), x, F.lit(">")).alias("text"), (10 * i).alias("start"), (10 * i + 9).alias("stop")),
    )
    docs = fixtures.documents(spark, sf_dir).select("doc_id", lines.alias("spans"))
    breaks = F.transform(F.filter(F.sequence(F.lit(0), F.size("spans")), lambda i: i % 4 == 3), lambda i: i.cast("int"))
    merged = docs.select("doc_id", F.posexplode(merge_sentences(F.col("spans"), breaks, 400)).alias("segment", "s"))
    return merged.select("doc_id", "segment", F.length("s.text").alias("n_chars"), "s.start", "s.stop", F.md5("s.text").alias("text_md5"))


def model_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list for a model: blank parts are left out; and a context's first line."""
    asked = fixtures.queries(spark, sf_dir)
    i = F.col("query_id")
    summary, context = F.when(i % 2 == 0, "earlier"), F.when(i % 3 == 0, F.concat(F.lit(" \n\n"), "query", F.lit("\nrest"))).otherwise(" ")
    history = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("").alias("content")))
    made = conversation.model_messages(F.lit("be brief"), summary, context, history, F.col("query"))
    return asked.select(
        "query_id", F.array_join(F.transform(made, lambda m: m["role"]), ",").alias("roles"),
        F.md5(F.array_join(F.transform(made, lambda m: m["content"]), "|")).alias("contents_md5"),
        F.md5(conversation.first_grounding_line(context)).alias("first_md5"),
    )


_NAMES = (
    "file_sources", "docx_documents", "parser_routes", "server_metadata", "parse_fallback", "placeholder_parse",
    "store_round_trip", "vector_collection", "vector_search", "vector_scroll", "exact_filter", "record_hits",
    "backend_choice", "task_projection", "chat_stream", "merged_maps", "json_values", "total_documents",
    "postings_cache", "health_checks", "strict_similarity", "sparse_vectors", "embedding_fallback", "lexical_rerank",
    "agent_rounds", "ingestion_summary", "region_tree", "intent_tree_counts", "session_search", "guards", "turn_trace",
    "task_traces", "sentence_segments", "model_messages",
)
QUERIES = {name: globals()[name] for name in _NAMES}

_TASKS = """t AS (SELECT event_id AS task_id, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed'
  WHEN 'click' THEN 'running' ELSE 'pending' END AS status, (props->>'$.k')::INT AS k FROM events)"""
_TERMS = r"""list_distinct(list_filter(regexp_extract_all(lower(trim({text})), '[\p{{L}}\p{{Nd}}]+'), lambda x: octet_length(encode(x)) >= 2))"""
_VEC = """r AS (SELECT doc_id, lpad(doc_id::VARCHAR, 9, '0') AS record_id, source, lang, text FROM documents
  WHERE doc_id % 10 NOT IN (3, 7))"""
_V = "[(length(text) % 3)::FLOAT::DOUBLE, (length(text) % 5)::FLOAT::DOUBLE, (length(text) % 7)::FLOAT::DOUBLE]"

ORACLE_SQL = {
    "file_sources": """SELECT item_id, 'Item ' || item_id || '.v1' AS title, sha256(replace(text, ' ', chr(10))) AS text_sha256 FROM benchmark""",
    "docx_documents": r"""
WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[\x00-\x08\x0b-\x1f]', '', 'g'), chr(10))) AS line,
  generate_subscripts(string_split(regexp_replace(text, '[\x00-\x08\x0b-\x1f]', '', 'g'), chr(10)), 1) AS i FROM documents),
p AS (SELECT doc_id, i, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM l),
d AS (SELECT doc_id, string_agg(line, ' ' ORDER BY i) FILTER (line <> '') AS t FROM p GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 7 <> 3 THEN 'doc_' || doc_id END AS title,
  CASE WHEN doc_id % 7 <> 3 THEN sha256(regexp_replace(coalesce(t, ''), '\s+', ' ', 'g')) END AS text_sha256,
  CASE WHEN doc_id % 7 = 3 THEN 'bad-archive' END AS code, CASE WHEN doc_id % 7 = 3 THEN 'docx' END AS source,
  CASE WHEN doc_id % 7 = 3 THEN false END AS retryable FROM d""",
    "parser_routes": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'tika' WHEN 1 THEN 'text' ELSE
  CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'text' END END AS parser,
  CASE doc_id % 4 WHEN 0 THEN 'file-read-failed' WHEN 1 THEN 'bad-archive' WHEN 2 THEN 'timed-out' END AS code,
  CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS retryable FROM documents""",
    "server_metadata": """SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'doc_' || doc_id END AS title,
  CASE WHEN doc_id % 3 > 0 THEN lang END AS language, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 9)::INT END AS page_count FROM documents""",
    "parse_fallback": """SELECT doc_id, md5(CASE WHEN doc_id % 4 = 1 THEN text ELSE '> ' || text END) AS text_md5,
  CASE WHEN doc_id % 4 = 1 THEN 'bad-archive' END AS fallback_reason FROM documents""",
    "placeholder_parse": """
WITH d AS (SELECT 'doc_' || doc_id AS document_id, 'doc_' || doc_id || '.txt stands in for a text' AS a,
  'It was not read' AS b, 'Its address is file:///doc_' || doc_id || '.txt.' AS c FROM documents),
p AS (SELECT document_id, 0 AS i, a AS text, 0 AS start FROM d UNION ALL SELECT document_id, 1, b, length(a) + 2 FROM d
  UNION ALL SELECT document_id, 2, c, length(a) + length(b) + 4 FROM d)
SELECT document_id, document_id || '_chunk_' || (i + 1) AS chunk_id, i AS chunk_index, text, length(text)::INT AS char_count,
  start::INT AS start, (start + length(text))::INT AS stop FROM p""",
    "store_round_trip": "SELECT lpad(doc_id::VARCHAR, 9, '0') AS record_id, 'doc_' || doc_id AS document_id, 1 AS chunk_index, lang FROM documents",
    "vector_collection": f"""WITH {_VEC} SELECT record_id, CASE WHEN lang = 'de' THEN 'changed' ELSE 'doc_' || doc_id END AS title,
  3 AS dimensions, CASE WHEN lang = 'de' THEN 'changed' ELSE 'doc_' || doc_id END AS side_title FROM r WHERE source NOT IN ('src1', 'src2')""",
    "vector_search": f"""WITH {_VEC}, q AS (SELECT item_id AS query_id, [(item_id % 3 + 1)::DOUBLE, (item_id % 5 + 1)::DOUBLE, (item_id % 7 + 1)::DOUBLE] AS v FROM benchmark),
s AS (SELECT query_id, record_id, coalesce(CASE WHEN {_V} = [0.0, 0.0, 0.0] THEN 0 ELSE list_cosine_similarity({_V}, v) END, 0) AS raw
  FROM r, q WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3'))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, record_id) AS rank, round(raw, 6) AS score FROM s QUALIFY rank <= 10""",
    "vector_scroll": """SELECT lpad(doc_id::VARCHAR, 9, '0') AS record_id, source AS knowledge_base_id FROM documents
WHERE lang = 'en' ORDER BY 1 LIMIT 256 OFFSET 256""",
    "exact_filter": "SELECT lpad(doc_id::VARCHAR, 9, '0') AS record_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0",
    "record_hits": """SELECT lpad(d.doc_id::VARCHAR, 9, '0') AS record_id,
  CASE WHEN d.doc_id % 2 = 0 THEN 'doc_' || d.doc_id ELSE lpad(d.doc_id::VARCHAR, 9, '0') END AS chunk_id,
  'actualSource,documentId,fallbackReason,knowledgeBaseId,lang,orgId,' || CASE WHEN l.doc_id IS NULL THEN '' ELSE 'quality,' END
    || 'recordId,requestedSource,tenantId' || CASE WHEN l.doc_id IS NULL THEN '' ELSE ',toxic' END AS keys,
  'doc_' || d.doc_id AS document, 'local' AS source FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "backend_choice": """SELECT n_nationkey AS number, CASE n_nationkey WHEN 3 THEN 'RuntimeError' WHEN 4 THEN 'ValueError' ELSE 'json' END
  AS backend FROM nation WHERE n_nationkey < 5""",
    "task_projection": f"""WITH {_TASKS}, m AS (SELECT *, k % 5 AS used, CASE WHEN k % 3 = 0 OR k % 6 = 0 THEN 3 ELSE k % 6 END AS most FROM t)
SELECT task_id, used AS attempt_count, most AS max_attempts, greatest(most - used, 0) AS attempts_remaining, status AS stored_status FROM m""",
    "chat_stream": r"""
WITH p AS (SELECT conv_id || ':' || turn AS message_id, unnest(regexp_extract_all(text, '[^\n\r\x85\x{2028}\x{2029}]{1,48}')) AS delta,
  generate_subscripts(regexp_extract_all(text, '[^\n\r\x85\x{2028}\x{2029}]{1,48}'), 1) - 1 AS position FROM conversations)
SELECT message_id, position::INT AS position, length(delta)::INT AS n, md5(delta) AS delta_md5 FROM p""",
    "merged_maps": """SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE 'a=1,' END || 'lang=' || lang
  || CASE WHEN l.doc_id IS NULL THEN '' ELSE ',quality=' || quality || ',toxic=' || toxic END AS entries FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "json_values": """SELECT doc_id, '"' || lang || '"' AS lang_json, n_chars::VARCHAR AS number_json,
  CASE WHEN n_chars > 500 THEN 'true' ELSE 'false' END AS flag_json, 'null' AS nothing_json, '[' || doc_id || ',null]' AS list_json,
  '{"id":' || doc_id || ',"none":null,"list":["a"]}' AS object_json,
  '"' || (DATE '2024-01-01' + (doc_id % 28)::INT)::DATE || '"' AS day_json FROM documents""",
    "total_documents": "SELECT count(*)::BIGINT AS total_documents FROM documents",
    "postings_cache": f"""SELECT 1::BIGINT AS hits, 4::BIGINT AS misses, '20.0%' AS hit_rate, 2::BIGINT AS entries, 2::BIGINT AS max_size,
  1::BIGINT AS evictions, sum(len({_TERMS.format(text='text')}))::BIGINT AS n_terms, true AS same FROM documents WHERE lang = 'en'""",
    "health_checks": """SELECT 'tables' AS name, CASE WHEN count(*) = 25 THEN 'ok' END AS status FROM nation
UNION ALL SELECT 'vectors', 'unhealthy: no connection'""",
    "strict_similarity": """SELECT vec_id AS record_id, round(list_cosine_similarity(embedding::DOUBLE[],
  list_transform(range(64), lambda x: 1.0::DOUBLE)), 6) AS score FROM embeddings WHERE vec_id % 5 <> 0""",
    "sparse_vectors": f"""
WITH q AS (SELECT item_id AS query_id, {_TERMS.format(text='text')} AS t FROM benchmark),
h AS (SELECT query_id, unnest(t) AS term FROM q),
f AS (SELECT query_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(octet_length(encode(term))),
    lambda i: ('0x' || substr(hex(encode(term)), 2 * i + 1, 2))::BIGINT)),
  lambda s, b: ((xor(s, b)::HUGEINT * 16777619) % 4294967296)::BIGINT) AS place FROM h)
SELECT query_id, len(t)::INT AS n_terms, len(t)::DOUBLE AS weight, true AS same_terms,
  coalesce((SELECT sum(place) FROM f WHERE f.query_id = q.query_id), 0)::BIGINT AS places FROM q""",
    "embedding_fallback": """WITH d AS (SELECT 'doc_' || doc_id AS chunk_id, n_chars % 3 <> 1 AND doc_id % 10 <> 7 AS served FROM documents)
SELECT chunk_id, CASE WHEN served THEN 'provider' ELSE 'deterministic-fallback' END AS embedding_source,
  CASE WHEN served THEN 'served' ELSE 'mock-embedding-v1' END AS model, 8 AS dimensions FROM d""",
    "lexical_rerank": f"""WITH {retrieval._bm25()}, a AS ({retrieval._top('scored', 20)}),
x AS (SELECT query_id, doc_id, {_TERMS.format(text='b.text')} AS qt, {_TERMS.format(text='d.text')} AS dt
  FROM a JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id)
SELECT query_id, doc_id, round(len(list_intersect(qt, dt))::DOUBLE / len(qt), 6) AS rerank_score FROM x""",
    "agent_rounds": """
WITH t AS (SELECT r_regionkey AS query_id, CASE WHEN r_regionkey = 0 THEN 'NATION_1' ELSE 'NATION_1' || r_regionkey END AS q0,
  'NATION_' || r_regionkey AS q2 FROM region),
a AS (SELECT query_id, q0 AS query, n_name AS name, 0 AS round FROM t JOIN nation ON starts_with(n_name, q0)),
c AS (SELECT query_id, q2 AS query, n_name AS name, 2 AS round FROM t JOIN nation ON starts_with(n_name, q2)
  WHERE query_id NOT IN (SELECT query_id FROM a WHERE length(name) <= 8))
SELECT * FROM a UNION ALL SELECT * FROM c""",
    "ingestion_summary": f"""WITH {_TASKS} SELECT task_id, status, CASE WHEN k % 3 <> 0 THEN k % 4 ELSE 0 END AS trace_events,
  CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END AS chunk_count, k % 2 = 0 AS retryable FROM t""",
    "region_tree": """SELECT 'r' || r_regionkey AS intent_id, r_name AS name, 1 AS priority, 0 AS depth, 'r' || r_regionkey AS root_id, r_name AS path FROM region
UNION ALL SELECT 'n' || n_nationkey, n_name, 2, 1, 'r' || r_regionkey, r_name || '/' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "intent_tree_counts": "SELECT 1 AS max_depth, (SELECT count(*) FROM region) AS roots, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS intents, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation WHERE n_nationkey % 3 <> 0) AS active",
    "session_search": "SELECT conv_id::VARCHAR AS conversation_id FROM conversations GROUP BY conv_id HAVING contains(lower(min_by(text, turn)), 'the')",
    "guards": """
WITH a AS (SELECT n_nationkey, n_nationkey % 5 <> 0 AS s, n_nationkey % 2 = 0 AS t, n_nationkey % 4 = 0 AS o, n_nationkey % 3 = 0 AS m FROM nation)
SELECT n_nationkey, '1' || s::INT || (s AND t)::INT || (s AND t AND o)::INT || (s AND m)::INT AS passed,
  concat_ws(',', 'tool_public', CASE WHEN s THEN 'tool_signed-in' END, CASE WHEN s AND t THEN 'tool_tenant' END,
    CASE WHEN s AND t AND o THEN 'tool_org' END, CASE WHEN s AND m THEN 'tool_admin' END) AS tools FROM a""",
    "turn_trace": """
WITH u AS (SELECT conv_id || ':' || turn AS turn_id, text FROM conversations WHERE role = 'user'),
s AS (SELECT turn_id, unnest(['chat', 'agent.step.search', 'agent.step.answer', 'rewrite.plan', 'tool.plan', 'retrieval.plan',
    'retrieval.execute', 'context.assembly', 'prompt.assembly']) AS stage, unnest(range(9)) AS position, text FROM u),
p AS (SELECT *, CASE WHEN position < 2 THEN substr(text, 1, 500) WHEN position = 2 THEN 'done' ELSE substr('> ' || text, 1, 500) END AS preview FROM s)
SELECT turn_id, position::INT AS position, stage, length(preview)::INT AS n, md5(preview) AS preview_md5 FROM p""",
    "task_traces": f"""WITH {_TASKS}, e AS (SELECT task_id::VARCHAR AS trace_id, status, unnest(range(1 + k % 5)) AS position FROM t)
SELECT trace_id, position::INT AS position, 'ingestion:' || CASE position WHEN 0 THEN 'task-created' WHEN 1 THEN 'parse' WHEN 2 THEN 'chunk'
  WHEN 3 THEN 'embed' ELSE 'index' END AS stage, CASE WHEN position = 0 THEN status ELSE 'ok' END AS status FROM e""",
    "sentence_segments": """
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i,
    len(string_split(text, chr(10))) AS n FROM documents),
f AS (SELECT doc_id, i, n, '<' || line || '>' AS t, length(line) + 2 AS size, 1 AS held, 0 AS seg FROM l WHERE i = 0
  UNION ALL SELECT l.doc_id, l.i, l.n, '<' || l.line || '>', CASE WHEN z THEN 0 ELSE f.size END + length(l.line) + 2,
    CASE WHEN z THEN 1 ELSE f.held + 1 END, f.seg + z::INT
  FROM (SELECT *, (i + 1) % 4 = 3 OR (size >= 400 AND held > 1) AS z FROM f) f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1),
s AS (SELECT doc_id, seg, string_agg(t, '' ORDER BY i) AS t, min(i) AS a, max(i) AS b FROM f GROUP BY doc_id, seg)
SELECT doc_id, seg::INT AS segment, length(t)::INT AS n_chars, (10 * a)::INT AS start, (10 * b + 9)::INT AS stop, md5(t) AS text_md5 FROM s""",
    "model_messages": """
SELECT item_id AS query_id, concat_ws(',', 'system', CASE WHEN item_id % 2 = 0 THEN 'system' END, CASE WHEN item_id % 3 = 0 THEN 'system' END, 'user', 'user') AS roles,
  md5(concat_ws('|', 'be brief', CASE WHEN item_id % 2 = 0 THEN 'earlier' END, CASE WHEN item_id % 3 = 0 THEN e' \\n\\n' || text || e'\\nrest' END, 'hi', text)) AS contents_md5,
  md5(CASE WHEN item_id % 3 = 0 THEN split_part(text, chr(10), 1) ELSE '' END) AS first_md5 FROM benchmark""",
}
