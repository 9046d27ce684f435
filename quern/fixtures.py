"""Domain tables from the test tables, by the same mappings that the SQL uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of a knowledge base per source, a tenant per language."""
    docs = spread(table(spark, sf_dir, "documents"))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return docs.select(
        "doc_id",
        name.alias("document_id"),
        name.alias("chunk_id"),
        F.col("source").alias("knowledge_base_id"),
        F.col("lang").alias("tenant_id"),
        F.col("source").alias("org_id"),
        name.alias("title"),
        F.concat(name, F.lit(".txt")).alias("filename"),
        "text",
        "n_chars",
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ``metadata``: lang always, quality and toxic only where a label exists."""
    labels = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.create_map(
            F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")
        ).alias("_m"),
    )
    base = F.create_map(F.lit("lang"), F.col("tenant_id"))
    return (
        documents(spark, sf_dir)
        .join(labels, "doc_id", "left")
        .withColumn("metadata", F.when(F.col("_m").isNull(), base).otherwise(F.map_concat(base, F.col("_m"))))
        .drop("_m")
    )


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose line ends are blank lines, for the paragraph chunker."""
    return documents(spark, sf_dir).withColumn("text", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per benchmark item."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query"),
        F.lit(6).alias("top_k"),
        F.array().cast("array<string>").alias("knowledge_base_ids"),
    )


def vector_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("record_id"),
        F.col("embedding").alias("vector"),
        F.concat(F.lit("kb_"), F.col("label").cast("string")).alias("knowledge_base_id"),
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector is a query."""
    return (
        table(spark, sf_dir, "embeddings")
        .filter("vec_id % 50 = 0")
        .select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"),
        F.col("conv_id").alias("conversation_id"),
        F.col("turn").alias("position"),
        "role",
        F.col("text").alias("content"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their times as instants of the session's time zone."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trace records: a run per user and day."""
    kind = F.col("event_type")
    day = F.date_format("ts", "yyyy-MM-dd")
    run = F.concat_ws(":", F.col("user_id").cast("string"), day)
    stage = (
        F.when(kind == "view", "retrieval.plan")
        .when(kind == "click", "retrieval.execute")
        .when(kind == "purchase", "context.assembly")
        .when(kind == "signup", "chat")
        .otherwise("generation")
    )
    status = (
        F.when(kind == "error", "failed")
        .when(kind == "click", "running")
        .when(kind == "signup", "pending")
        .otherwise("succeeded")
    )
    return events(spark, sf_dir).select(
        "event_id",
        run.alias("trace_id"),
        run.alias("run_id"),
        F.lit(None).cast("string").alias("conversation_id"),
        stage.alias("stage"),
        status.alias("status"),
        F.col("ts").alias("started_at"),
        F.timestamp_millis(F.unix_millis("ts") + F.round("value").cast("long")).alias("finished_at"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ingestion tasks."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "purchase", "succeeded")
        .when(kind == "error", "failed")
        .when(kind == "click", "running")
        .otherwise("pending")
    )
    k = F.get_json_object("props", "$.k").cast("int")
    later = F.col("ts") + F.make_dt_interval(mins=k)
    return events(spark, sf_dir).select(
        F.col("event_id").alias("task_id"),
        F.concat(F.lit("kb_"), (F.col("user_id") % 3).cast("string")).alias("knowledge_base_id"),
        F.concat(F.lit("doc_"), F.col("user_id").cast("string")).alias("document_id"),
        status.alias("status"),
        (k % 5).alias("attempt_count"),
        F.lit(3).alias("max_attempts"),
        later.alias("next_run_at"),
        later.alias("lease_expires_at"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        k.alias("k"),
    )
