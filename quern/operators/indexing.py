"""Embedding, index records and the write operations of the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import is_blank, non_blank
from quern.functions.vector import content_hash, deterministic_vector, vector_reference

DEFAULT_MODEL = "mock-embedding-v1"
#: Columns that make two records equal; times are left out on purpose, so that writing the
#: same content again is recognised.
COMPARED = (
    "record_id", "knowledge_base_id", "document_id", "chunk_id", "chunk_index", "title", "content", "vector", "metadata",
)


def embedding_inputs(chunks: DataFrame) -> DataFrame:
    """``document_id, chunk_id, chunk_index, text, char_count, content_hash``."""
    return chunks.select(
        "document_id", "chunk_id", "chunk_index", "text", "char_count", content_hash(F.col("text")).alias("content_hash")
    )


def deterministic_provider(inputs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """``chunk_id, vector, dimensions, vector_ref, model`` without any service."""
    arguments = (F.lit(model), F.col("chunk_id"), F.col("content_hash"), F.col("char_count"))
    vector = deterministic_vector(*arguments)
    return inputs.select(
        "chunk_id", vector.alias("vector"), F.size(vector).alias("dimensions"),
        vector_reference(*arguments).alias("vector_ref"), F.lit(model).alias("model"),
    )


def embed(
    inputs: DataFrame,
    provider: Callable[[DataFrame], DataFrame],
    fallback: Callable[[DataFrame], DataFrame] = deterministic_provider,
) -> DataFrame:
    """Artifacts of a provider; chunks that it leaves without a vector get the fallback's,
    with ``embedding_source`` telling which."""
    first = provider(inputs).filter(F.size("vector") > 0).withColumn("embedding_source", F.lit("provider"))
    rest = inputs.join(first.select("chunk_id"), "chunk_id", "left_anti")
    return first.unionByName(fallback(rest).withColumn("embedding_source", F.lit("deterministic-fallback")))


def index_records(documents: DataFrame, chunks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Chunks with their vectors (or none) as index records.

    ``documents``: document_id, knowledge_base_id, tenant_id, org_id, title, index_name.
    """
    joined = chunks.join(artifacts.select("chunk_id", "vector", "vector_ref", "model"), "chunk_id", "left").join(
        documents.select("document_id", "knowledge_base_id", "tenant_id", "org_id", "title", "index_name"), "document_id"
    )
    metadata = F.create_map(
        F.lit("startOffset"), F.col("start").cast("string"),
        F.lit("endOffset"), F.col("stop").cast("string"),
        F.lit("embeddingModel"), F.coalesce("model", F.lit("not-executed")),
        F.lit("vectorDimensions"), F.coalesce(F.size("vector"), F.lit(0)).cast("string"),
    )
    return joined.select(
        F.concat_ws("::", "knowledge_base_id", "chunk_id").alias("record_id"),
        "knowledge_base_id",
        "document_id",
        "chunk_id",
        "chunk_index",
        non_blank(F.col("title"), F.col("document_id")).alias("title"),
        F.col("text").alias("content"),
        F.coalesce("vector", F.array().cast("array<float>")).alias("vector"),
        "tenant_id",
        "org_id",
        non_blank(F.col("index_name"), F.col("knowledge_base_id")).alias("index_name"),
        metadata.alias("metadata"),
    )


def fingerprint() -> Column:
    return F.concat_ws("::", "knowledge_base_id", "document_id", "chunk_id", "title")


def _identity() -> Column:
    """The record id, or the fingerprint where it is blank."""
    return F.when(is_blank(F.col("record_id")), F.concat(F.lit("fp:"), fingerprint())).otherwise(
        F.concat(F.lit("id:"), F.trim("record_id"))
    )


def _comparable(columns: list[str]) -> Column:
    parts = []
    for name in COMPARED:
        if name in columns:
            value = F.array_sort(F.map_entries(name)) if name == "metadata" else F.col(name)
            parts.append(value.alias(name))
    return F.to_json(F.struct(*parts))


def classify_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Every record after the upsert with its ``action``: untouched, skipped (equal),
    replaced (same identity, other content) or inserted.

    One full outer join on the identity. A blank id matches an existing record by its
    fingerprint. Incoming records that repeat an identity: the last by content wins.
    """
    columns = existing.columns

    def keyed(records: DataFrame, tag: str, identity: Column) -> DataFrame:
        own = records.select(*columns).select(
            identity.alias("_key"), _comparable(columns).alias(f"_{tag}_c"), F.struct(*columns).alias(f"_{tag}")
        )
        return own.groupBy("_key").agg(F.max_by(f"_{tag}", f"_{tag}_c").alias(f"_{tag}"), F.max(f"_{tag}_c").alias(f"_{tag}_c"))

    # a blank incoming id takes the identity of the existing record of its fingerprint
    prints = existing.select(fingerprint().alias("_fp"), _identity().alias("_existing")).groupBy("_fp").agg(
        F.max("_existing").alias("_existing")
    )
    blank = incoming.filter(is_blank(F.col("record_id"))).withColumn("_fp", fingerprint()).join(prints, "_fp", "left")
    named = incoming.filter(~is_blank(F.col("record_id"))).withColumn("_existing", F.lit(None).cast("string"))
    tagged = named.unionByName(blank.drop("_fp"))
    new = tagged.select(
        F.coalesce("_existing", _identity()).alias("_key"), _comparable(columns).alias("_n_c"), F.struct(*columns).alias("_n")
    ).groupBy("_key").agg(F.max_by("_n", "_n_c").alias("_n"), F.max("_n_c").alias("_n_c"))
    old = keyed(existing, "o", _identity())
    joined = old.join(new, "_key", "full_outer")
    action = (
        F.when(F.col("_n_c").isNull(), "untouched")
        .when(F.col("_o_c").isNull(), "inserted")
        .when(F.col("_o_c") == F.col("_n_c"), "skipped")
        .otherwise("replaced")
    )
    kept = F.when(F.col("_n_c").isNull() | (F.col("_o_c") == F.col("_n_c")), F.col("_o")).otherwise(F.col("_n"))
    return joined.select(action.alias("action"), F.coalesce(kept, F.col("_n")).alias("r")).select("action", "r.*")


def write_summary(classified: DataFrame) -> DataFrame:
    """One row: indexed, skipped, replaced and stored counts."""
    action = F.col("action")
    return classified.agg(
        F.count_if(action.isin("inserted", "replaced")).alias("indexed"),
        F.count_if(action == "skipped").alias("skipped"),
        F.count_if(action == "replaced").alias("replaced"),
        F.count(F.lit(1)).alias("stored"),
    )


def storable_vectors(records: DataFrame, order: str = "position") -> DataFrame:
    """Records whose vector has the length of the first non-empty one in the order."""
    first = F.min(F.when(F.size("vector") > 0, F.struct(F.col(order), F.size("vector").alias("n")))).alias("f")
    length = records.agg(first).select(F.col("f.n").alias("_n"))  # one row of one number
    return records.crossJoin(F.broadcast(length)).filter(F.size("vector") == F.col("_n")).drop("_n")


def delete_records(records: DataFrame, knowledge_base_id: str, document_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The remaining records, and one row with the number of deleted ones."""
    gone = F.col("knowledge_base_id") == knowledge_base_id
    if document_id is not None:
        gone &= F.col("document_id") == document_id
    gone = F.coalesce(gone, F.lit(False))
    return records.filter(~gone), records.agg(F.count_if(gone).alias("deleted"))


def replace_documents(records: DataFrame, incoming: DataFrame) -> DataFrame:
    """Delete what the incoming documents had, then add their records."""
    keys = ["knowledge_base_id", "document_id"]
    return records.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def last_writer_wins(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the greatest ``order`` per key; of equal ones the incoming row."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    window = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_side"))
    return both.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n", "_side")


def compare_and_set(current: DataFrame, updates: DataFrame, key: str = "task_id", version: str = "updated_at") -> DataFrame:
    """Updates applied where ``expected`` is the current version; ``applied`` tells."""
    values = [c for c in current.columns if c != key]
    new = updates.select(key, F.col("expected").alias("_expected"), *(F.col(c).alias(f"_{c}") for c in values))
    joined = current.join(new, key, "left")
    wins = F.coalesce(F.col("_expected") == F.col(version), F.lit(False))
    return joined.select(key, *(F.when(wins, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values), wins.alias("applied"))


def index_metadata(records: DataFrame, persisted: DataFrame | None = None) -> DataFrame:
    """The side table: records without content and vector, only those that the primary
    store says it persisted (all, if it names none)."""
    side = records.drop("content", "vector")
    if persisted is None or persisted.isEmpty():
        return side
    return side.join(persisted.select("record_id"), "record_id", "left_semi")


def payload(records: DataFrame) -> DataFrame:
    """Records as the vector database's payload: promoted keys beside nested metadata."""
    promoted = [c for c in records.columns if c not in ("vector", "metadata")]
    return records.select(F.col("record_id").alias("key"), "vector", F.struct(*promoted, "metadata").alias("payload"))


def from_payload(points: DataFrame) -> DataFrame:
    return points.select("payload.*", "vector")


def record_chunks(records: DataFrame) -> DataFrame:
    """Records as search hits: the chunk id falls back to the record's, and derived keys
    are merged into the metadata."""
    derived = F.map_filter(
        F.create_map(
            F.lit("recordId"), F.col("record_id"), F.lit("documentId"), F.col("document_id"),
            F.lit("knowledgeBaseId"), F.col("knowledge_base_id"), F.lit("tenantId"), F.col("tenant_id"),
            F.lit("orgId"), F.col("org_id"),
        ),
        lambda k, v: ~is_blank(v),
    )
    return records.withColumns(
        {
            "chunk_id": non_blank(F.col("chunk_id"), F.col("record_id")),
            "metadata": F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), derived),
        }
    )


def annotate_hits(hits: DataFrame, requested: str, actual: str, reason: str | None = None) -> DataFrame:
    """Which source was asked for, which one answered, and why it differs."""
    extra = {"requestedSource": requested, "actualSource": actual} | ({"fallbackReason": reason} if reason else {})
    added = F.create_map(*(F.lit(x) for pair in extra.items() for x in pair))
    return hits.withColumn("metadata", F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), added))
