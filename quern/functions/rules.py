"""Rule tables of traces and retries as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUS_RANK = {"failed": 5, "cancelled": 4, "running": 3, "pending": 2, "succeeded": 1}
#: Stages whose trace node exists once per trace, with the name in its id.
SINGLE_NODES = {
    "rewrite.plan": "rewrite",
    "tool.plan": "tool.plan",
    "retrieval.plan": "retrieval.plan",
    "retrieval.execute": "retrieval.execute",
    "retrieval.request": "retrieval.execute",
    "context.assembly": "context.assembly",
    "prompt.assembly": "prompt.assembly",
}
_INGESTION = {"parsing": "parser", "chunking": "chunking", "embedding": "embedding", "indexing": "indexing"}
_CHAT_CHILDREN = (
    "rewrite", "tool.plan", "retrieval.plan", "context.assembly", "prompt.assembly", "generation",
)


def status_rank(status: Column) -> Column:
    rank = F.lit(None).cast("int")
    for name, value in STATUS_RANK.items():
        rank = F.when(status == name, value).otherwise(rank)
    return rank


def node_type(stage: Column) -> Column:
    """The kind of trace node that a stage makes."""
    own = F.lower(F.substring(stage, len("ingestion:") + 1, 1 << 30))
    ingestion = F.lit("ingestion")
    for name, kind in _INGESTION.items():
        ingestion = F.when(own == name, kind).otherwise(ingestion)
    return (
        F.when(stage == "chat", "chat")
        .when(F.startswith(stage, F.lit("rewrite")), "rewrite")
        .when(stage == "tool.plan", "tool.plan")
        .when(F.startswith(stage, F.lit("tool.runtime")), "tool.runtime")
        .when(stage == "retrieval.plan", "retrieval.plan")
        .when(stage.isin("retrieval.request", "retrieval.execute"), "retrieval.execute")
        .when(stage == "context.assembly", "context.assembly")
        .when(stage == "prompt.assembly", "prompt.assembly")
        .when(F.startswith(stage, F.lit("ingestion:")), ingestion)
        .when(stage == "ingestion", "ingestion")
        .when(F.startswith(stage, F.lit("generation")), "generation")
        .otherwise("other")
    )


def node_id(trace_id: Column, stage: Column, seed: Column) -> Column:
    """The id of a stage's node; ``seed`` tells nodes apart that a trace may have several of."""

    def named(*parts) -> Column:
        return F.concat_ws(":", F.lit("node"), trace_id, *(p if isinstance(p, Column) else F.lit(p) for p in parts))

    value = named(node_type(stage), seed)
    value = F.when(
        F.startswith(stage, F.lit("ingestion:")), named(F.substring(stage, len("ingestion:") + 1, 1 << 30), "single")
    ).otherwise(value)
    for name, kind in SINGLE_NODES.items():
        value = F.when(stage == name, named(kind, "single")).otherwise(value)
    value = F.when(stage.isin("ingestion", "ingestion:task-created"), named("ingestion", "root")).otherwise(value)
    return F.when(stage == "chat", named("chat", "root")).otherwise(value)


def parent_node_id(trace_id: Column, stage: Column) -> Column:
    kind = node_type(stage)

    def named(*parts: str) -> Column:
        return F.concat_ws(":", F.lit("node"), trace_id, *map(F.lit, parts))

    return (
        F.when(stage.isin("chat", "ingestion", "ingestion:task-created"), F.lit(None).cast("string"))
        .when(kind == "tool.runtime", named("tool.plan", "single"))
        .when(kind == "retrieval.execute", named("retrieval.plan", "single"))
        .when(kind.isin(*_CHAT_CHILDREN), named("chat", "root"))
        .when(kind.isin("ingestion", *_INGESTION.values()), named("ingestion", "root"))
    )


def duration_ms(started: Column, finished: Column) -> Column:
    """Milliseconds between two times, null if one is missing or they are reversed."""
    gap = F.unix_millis(finished) - F.unix_millis(started)
    return F.when(gap >= 0, gap)


def retry_class(stage: Column, retryable: Column, source: Column, reason: Column) -> Column:
    source, reason = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (source, reason))

    def any_of(text: Column, *words: str) -> Column:
        return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))

    return (
        F.when(~retryable, "non-retryable")
        .when(any_of(source, "qdrant", "openai", "tika"), "dependency-transient")
        .when(any_of(source, "store", "index", "file"), "store-transient")
        .when(any_of(reason, "timeout", "temporar", "unavailable"), "dependency-transient")
        .when(stage.isin("embedding", "indexing"), "dependency-transient")
        .otherwise("transient")
    )


def retry_tier(kind: Column, retryable: Column) -> Column:
    return (
        F.when(~retryable, "none")
        .when(kind == "dependency-transient", "dependency-backoff")
        .when(kind == "store-transient", "fast-backoff")
        .otherwise("standard-backoff")
    )


def retry_delay_seconds(attempts: Column, tier: Column) -> Column:
    n = F.greatest(attempts, F.lit(1))
    return (
        F.when(tier == "dependency-backoff", F.least(15 * n, F.lit(300)))
        .when(tier == "fast-backoff", F.least(3 * n, F.lit(30)))
        .otherwise(F.least(5 * n, F.lit(90)))
        .cast("int")
    )
