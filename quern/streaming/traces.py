"""Trace events as they arrive: rolled up into runs in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.rules import STATUS_RANK, node_type, status_rank


def run_rollup(events: DataFrame, window: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Per run and window of its start: times, worst status and number of nodes; late events
    count within the delay."""
    rank = F.max(status_rank(F.col("status")))
    status = F.lit(None).cast("string")
    for name, value in STATUS_RANK.items():
        status = F.when(F.col("_rank") == value, name).otherwise(status)
    return (
        events.withWatermark("started_at", delay)
        .groupBy(F.window("started_at", window), "run_id")
        .agg(
            F.min("started_at").alias("first_start"), F.max("finished_at").alias("last_finish"),
            rank.alias("_rank"), F.count(F.lit(1)).alias("n_nodes"),
        )
        .select("run_id", "first_start", "last_finish", "n_nodes", status.alias("status"))
    )


def typed_nodes(events: DataFrame) -> DataFrame:
    """Each event with its node type; stateless."""
    return events.withColumn("node_type", node_type(F.col("stage")))
