"""Read-models: dashboard, traces, documents, chunks, evidence, intent tree, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.rules import duration_ms, node_id, node_type, parent_node_id, status_rank
from quern.functions.text import non_blank, preview
from quern.operators.filters import in_control_scope
from quern.operators.tasks import selected_tasks


def scoped(rows: DataFrame, tenant: str, org: str | None) -> DataFrame:
    return rows.filter(in_control_scope(F.lit(tenant), F.lit(org), F.col("tenant_id"), F.col("org_id")))


def message_metadata(metadata: Column) -> Column:
    """Typed parts of a message's free JSON metadata; what has another type is null."""

    def text(path: str) -> Column:
        return F.try_variant_get(F.try_parse_json(metadata), path, "string")

    data = F.try_parse_json(metadata)
    return F.struct(
        text("$.retrievalSource").alias("retrieval_source"),
        text("$.retrievalBoundary").alias("retrieval_boundary"),
        F.try_variant_get(data, "$.generation", "variant").isNotNull().alias("has_generation"),
        F.coalesce(F.size(F.try_variant_get(data, "$.toolCalls", "array<variant>")), F.lit(0)).alias("n_tool_calls"),
    )


def retrieval_request(metadata: Column) -> Column:
    """The retrieval request in a message's metadata: trace id, the knowledge base ids that
    are texts, filters and scope; null without one."""
    data = F.try_parse_json(metadata)

    def text(path: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(data, path, "variant")) == "STRING", F.try_variant_get(data, path, "string"))

    ids = F.try_variant_get(data, "$.retrievalRequest.knowledgeBaseIds", "array<variant>")
    texts = F.transform(F.filter(ids, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    present = F.try_variant_get(data, "$.retrievalRequest", "variant").isNotNull()
    return F.when(
        present,
        F.struct(
            text("$.retrievalRequest.traceId").alias("trace_id"),
            F.coalesce(texts, F.array().cast("array<string>")).alias("knowledge_base_ids"),
            text("$.retrievalRequest.filters.documentId").alias("document_id"),
            F.coalesce(text("$.retrievalRequest.tenantId"), text("$.tenantId")).alias("tenant_id"),
            F.coalesce(text("$.retrievalRequest.orgId"), text("$.orgId")).alias("org_id"),
        ),
    )


def dashboard(
    conversations: DataFrame, messages: DataFrame, traces: DataFrame, knowledge_bases: DataFrame, tasks: DataFrame
) -> DataFrame:
    """One row of counters over tables that are already in scope; messages count only for
    conversations in scope."""
    m = messages.join(conversations.select("conversation_id"), "conversation_id", "left_semi").withColumn(
        "m", message_metadata(F.col("metadata"))
    )
    annotated = F.col("m.retrieval_boundary").isNotNull() | F.col("m.retrieval_source").isNotNull()
    status = F.col("status")
    parts = [
        conversations.agg(F.countDistinct("user_id").alias("active_users"), F.count(F.lit(1)).alias("conversations")),
        m.agg(
            F.count(F.lit(1)).alias("messages"), F.count_if("m.has_generation").alias("generated_messages"),
            F.count_if(annotated).alias("retrieval_annotated_messages"),
            F.coalesce(F.sum("m.n_tool_calls"), F.lit(0)).alias("tool_calls"),
        ),
        traces.agg(F.count(F.lit(1)).alias("traces")),
        knowledge_bases.agg(F.count(F.lit(1)).alias("knowledge_bases")),
        tasks.agg(
            F.count(F.lit(1)).alias("ingestion_tasks"), F.count_if(status == "succeeded").alias("ingestion_succeeded"),
            F.count_if(status == "failed").alias("ingestion_failed"), F.count_if(status == "running").alias("ingestion_running"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up; 0 of nothing."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(part * 100 / whole + 0.5)).cast("long")


def dashboard_ratios(board: DataFrame) -> DataFrame:
    return board.select(
        percent(F.col("retrieval_annotated_messages"), F.col("messages")).alias("retrieval_share"),
        percent(F.col("ingestion_succeeded"), F.col("ingestion_tasks")).alias("ingestion_success"),
    )


def trace_nodes(events: DataFrame, seed: Column) -> DataFrame:
    """Trace events with their node id, type, parent and duration."""
    return events.withColumns(
        {
            "node_type": node_type(F.col("stage")),
            "node_id": node_id(F.col("trace_id"), F.col("stage"), seed),
            "parent_node_id": parent_node_id(F.col("trace_id"), F.col("stage")),
            "duration_ms": duration_ms(F.col("started_at"), F.col("finished_at")),
        }
    )


def trace_runs(nodes: DataFrame) -> DataFrame:
    """A row per run: earliest start, latest end, worst status, duration and counts; the
    nodes of a run stay rows of their own, in order of their start (``run_nodes``)."""
    run = F.coalesce("run_id", F.concat(F.lit("run:"), F.col("trace_id")))
    gap = F.unix_millis("finished_at") - F.unix_millis("started_at")
    return (
        nodes.withColumns({"run_id": run, "_rank": status_rank(F.col("status"))})
        .groupBy("run_id")
        .agg(
            F.min("trace_id").alias("trace_id"),
            F.min("conversation_id").alias("conversation_id"),
            F.min("started_at").alias("started_at"),
            F.max("finished_at").alias("finished_at"),
            F.max_by("status", "_rank").alias("status"),
            F.count(F.lit(1)).alias("n_nodes"),
        )
        .withColumn("duration_ms", F.greatest(gap, F.lit(0)))
    )


def run_nodes(nodes: DataFrame) -> DataFrame:
    """``run_id, nodes``: each run's nodes as an array in order of their start."""
    run = F.coalesce("run_id", F.concat(F.lit("run:"), F.col("trace_id")))
    node = F.struct("started_at", "node_id", "stage", "node_type", "parent_node_id", "status", "finished_at", "duration_ms")
    return nodes.groupBy(run.alias("run_id")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))


def trace_statistics(runs: DataFrame) -> DataFrame:
    """One row: runs, succeeded runs and their mean duration, rounded half up."""
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.floor(F.avg(F.coalesce("duration_ms", F.lit(0))) + 0.5).cast("long").alias("mean_duration_ms"),
    )


def node_parents(nodes: DataFrame) -> DataFrame:
    """Each node with its parent's status, null where the parent is not in the trace."""
    parents = nodes.groupBy(F.col("trace_id").alias("_t"), F.col("node_id").alias("_p")).agg(
        F.max_by("status", status_rank(F.col("status"))).alias("parent_status")
    )
    return nodes.join(
        parents, (nodes["trace_id"] == parents["_t"]) & (nodes["parent_node_id"] == parents["_p"]), "left"
    ).drop("_t", "_p")


def retrieval_evidence(messages: DataFrame, tenant: str, org: str | None = None) -> DataFrame:
    """Per knowledge base and document filter: annotated messages, hits and the latest."""
    asked = (
        messages.filter("role = 'assistant'")
        .withColumn("r", retrieval_request(F.col("metadata")))
        .filter("r is not null")
        .filter(in_control_scope(F.lit(tenant), F.lit(org), F.col("r.tenant_id"), F.col("r.org_id")))
        .select("created_at", "r.trace_id", "r.document_id", F.explode(F.array_distinct("r.knowledge_base_ids")).alias("knowledge_base_id"))
    )
    return asked.groupBy("knowledge_base_id", "document_id").agg(
        F.count(F.lit(1)).alias("hits"), F.max("created_at").alias("latest_at"), F.max_by("trace_id", "created_at").alias("latest_trace_id")
    )


def document_view(tasks: DataFrame, chunk_counts: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """One row per document from its selected task; the title falls back to the file name."""
    chosen = selected_tasks(tasks).join(chunk_counts, "document_id", "left")
    if evidence is not None:
        hits = evidence.select("knowledge_base_id", "document_id", "hits", "latest_at")
        chosen = chosen.join(hits, ["knowledge_base_id", "document_id"], "left")
    else:
        chosen = chosen.withColumns({"hits": F.lit(None).cast("long"), "latest_at": F.lit(None).cast("timestamp")})
    title = non_blank(F.col("title"), F.col("filename")) if "title" in chosen.columns else F.col("document_id")
    return chosen.select(
        "knowledge_base_id", "document_id", "task_id", "status", "updated_at", "created_at", title.alias("title"),
        F.coalesce("n_chunks", F.lit(0)).alias("chunk_count"), F.coalesce("hits", F.lit(0)).alias("retrieval_evidence_count"),
        F.col("latest_at").alias("latest_retrieved_at"),
    )


def chunk_view(chunks: DataFrame, records: DataFrame, size: int = 180) -> DataFrame:
    """Chunks with a preview and the id of their index record, if there is one."""
    indexed = records.select("chunk_id", "record_id")
    return chunks.join(indexed, "chunk_id", "left").select(
        "document_id", "chunk_id", "chunk_index", preview(F.col("text"), size).alias("preview"), "record_id",
        F.col("record_id").isNotNull().alias("indexed"),
    )


def task_summary(tasks: DataFrame) -> DataFrame:
    """Sizes and defaults of a task's nested parts."""
    return tasks.select(
        "task_id", "status",
        F.coalesce(F.size("trace"), F.lit(0)).alias("trace_events"),
        F.coalesce(F.size("chunks"), F.lit(0)).alias("chunk_count") if "chunks" in tasks.columns else F.lit(0).alias("chunk_count"),
        F.coalesce("retryable", F.lit(False)).alias("retryable"),
    )


def intent_tree(intents: DataFrame) -> DataFrame:
    """Intents with ``depth``, ``root_id`` and ``path`` (names from the root), by a recursive
    query over the parent links; intents below an unknown parent are left out."""
    return intents.sparkSession.sql(
        """
        WITH RECURSIVE tree(intent_id, name, priority, depth, root_id, path) MAX RECURSION LEVEL 100 AS (
          SELECT intent_id, name, priority, 0, intent_id, name FROM {intents} WHERE parent_intent_id IS NULL
          UNION ALL
          SELECT i.intent_id, i.name, i.priority, t.depth + 1, t.root_id, concat(t.path, '/', i.name)
          FROM {intents} i JOIN tree t ON i.parent_intent_id = t.intent_id)
        SELECT * FROM tree
        """,
        intents=intents,
    )


def intent_statistics(tree: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    """One row: the tree's depth, roots and intents; with the intents also how many of all of
    them are ``enabled`` (a null is not)."""
    counted = tree.agg(
        F.max("depth").alias("max_depth"), F.count_if(F.col("depth") == 0).alias("roots"), F.count(F.lit(1)).alias("intents")
    )
    return counted if intents is None else counted.join(F.broadcast(intents.agg(F.count_if("enabled").alias("active"))))


def intent_children(intents: DataFrame) -> DataFrame:
    """``parent_intent_id, children``: by ascending priority, then by name."""
    child = F.struct("priority", "name", "intent_id")
    return intents.groupBy("parent_intent_id").agg(
        F.transform(F.array_sort(F.collect_list(child)), lambda c: c["intent_id"]).alias("children")
    )


def list_view(rows: DataFrame, tenant: str, org: str | None, order: str, key: str) -> DataFrame:
    """A table in scope, newest first."""
    return scoped(rows, tenant, org).orderBy(F.desc(order), F.asc(key))


def latest(rows: DataFrame, by: list[str], order: str, key: str) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(F.desc(order), F.asc(key))
    return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")
