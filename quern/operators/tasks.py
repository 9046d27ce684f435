"""Ingestion tasks as a state machine: creation, claims, failures, selection.

Every transition is a set of Columns over a table of tasks, so the batch form and the
streaming form (in ``foreachBatch``) are the same code.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.rules import retry_class, retry_delay_seconds, retry_tier
from quern.functions.text import is_blank
from quern.operators.filters import runnable

LEASE_SECONDS = 30
MAX_ATTEMPTS = 3


def idempotency_key(knowledge_base: Column, document: Column, source_uri: Column, plan: Column) -> Column:
    """SHA-256 of what makes two requests the same."""
    return F.sha2(F.concat_ws("|", knowledge_base, document, source_uri, plan), 256)


def create_tasks(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """``idempotency_key, task_id, outcome``: a request whose key exists reuses that task
    (of several the latest updated); of new requests with one key the first wins."""
    window = Window.partitionBy("idempotency_key").orderBy(F.desc("updated_at"), "task_id")
    latest = (
        existing.withColumn("_n", F.row_number().over(window))
        .filter("_n = 1")
        .select("idempotency_key", F.col("task_id").alias("_old"), F.col("status").alias("_status"))
    )
    order = Window.partitionBy("idempotency_key").orderBy("task_id")
    first = requests.withColumn("_first", F.first("task_id").over(order))
    joined = first.join(latest, "idempotency_key", "left")
    outcome = (
        F.when(F.col("_old").isNull(), F.when(F.col("task_id") == F.col("_first"), "created").otherwise("reused"))
        .when(F.col("_status") == "succeeded", "already-succeeded")
        .when(F.col("_status") == "failed", "failed-needs-retry")
        .otherwise("reused")
    )
    return joined.select("idempotency_key", F.coalesce("_old", "_first").alias("task_id"), outcome.alias("outcome"))


#: Claimed ids that are sent to every task; more are joined as Spark chooses.
MOST_BROADCAST = 100_000


def claim(tasks: DataFrame, now: Column, limit: int | None = None, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """All tasks with ``claim``: claimed, dead-letter, not-claimable or waiting, and their
    new state. The newest updated runnable tasks are claimed first, ``limit`` at most.
    """
    most = F.when(F.coalesce("max_attempts", F.lit(0)) <= 0, F.lit(MAX_ATTEMPTS)).otherwise(F.col("max_attempts"))
    due = F.coalesce(runnable(F.col("status"), F.col("next_run_at"), F.col("lease_expires_at"), now), F.lit(False))
    marked = tasks.withColumns({"_due": due, "_spent": F.coalesce("attempt_count", F.lit(0)) >= most})
    if limit is not None:
        # only the first rows of the whole order are wanted: a top-k, not a sort of all
        first = (
            marked.filter("_due").orderBy(F.desc("updated_at"), "task_id").limit(limit).select("task_id", F.lit(True).alias("_chosen"))
        )
        marked = marked.join(F.broadcast(first) if limit <= MOST_BROADCAST else first, "task_id", "left")
    else:
        marked = marked.withColumn("_chosen", F.col("_due"))
    chosen = F.coalesce("_chosen", F.lit(False))
    verdict = (
        F.when(~F.col("_due"), "not-claimable").when(~chosen, "waiting").when(F.col("_spent"), "dead-letter").otherwise("claimed")
    )
    marked = marked.withColumn("claim", verdict)
    taken, dead = F.col("claim") == "claimed", F.col("claim") == "dead-letter"
    changes = {
        "status": F.when(taken, "running").when(dead, "failed").otherwise(F.col("status")),
        "attempt_count": F.coalesce("attempt_count", F.lit(0)) + taken.cast("int"),
        "lease_expires_at": F.when(taken, now + F.make_dt_interval(secs=F.lit(lease_seconds))).otherwise(F.col("lease_expires_at")),
        "next_run_at": F.when(dead, F.lit(None)).otherwise(F.col("next_run_at")),
        "updated_at": F.when(taken | dead, now).otherwise(F.col("updated_at")),
        "dead_letter": dead,
    }
    return marked.withColumns(changes).drop("_due", "_spent", "_chosen")


def fail(tasks: DataFrame, now: Column) -> DataFrame:
    """Failed attempts (``failure_stage, failure_reason, retryable, error_source``) in their
    next state: another try later, a terminal failure or a dead letter."""
    most = F.when(F.coalesce("max_attempts", F.lit(0)) <= 0, F.lit(MAX_ATTEMPTS)).otherwise(F.col("max_attempts"))
    left = F.greatest(most - F.col("attempt_count"), F.lit(0))
    kind = retry_class(F.col("failure_stage"), F.col("retryable"), F.col("error_source"), F.col("failure_reason"))
    tier = retry_tier(kind, F.col("retryable"))
    again = F.col("retryable") & (left > 0)
    delay = retry_delay_seconds(F.col("attempt_count"), tier)
    spent = F.col("retryable") & (left == 0)
    return tasks.withColumns(
        {
            "attempts_remaining": left,
            "retry_class": kind,
            "retry_tier": F.when(again, tier).otherwise("none"),
            "retry_after_seconds": F.when(again, delay).otherwise(0),
            "next_run_at": F.when(again, now + F.make_dt_interval(secs=delay)),
            "status": F.when(again, "pending").otherwise("failed"),
            "current_stage": F.when(again, "queued").otherwise("failed"),
            "terminal_state": F.when(again, F.lit(None)).when(spent, "dead-letter").otherwise("terminal-failure"),
            "terminal_reason": F.when(again, F.lit(None))
            .when(spent, "max-attempts-exhausted")
            .otherwise("non-retryable-error"),
            "dead_letter": spent,
            "finished_at": F.when(~again, now),
            "updated_at": now,
        }
    ).withColumn("retryable", again)


def succeed(tasks: DataFrame, now: Column) -> DataFrame:
    return tasks.withColumns(
        {
            "status": F.lit("succeeded"), "current_stage": F.lit("completed"), "finished_at": now, "updated_at": now,
            "next_run_at": F.lit(None).cast("timestamp"), "lease_expires_at": F.lit(None).cast("timestamp"),
        }
    )


def selected_tasks(tasks: DataFrame) -> DataFrame:
    """Per document its succeeded task updated last, else the one updated last."""
    order = Window.partitionBy("knowledge_base_id", "document_id").orderBy(
        F.when(F.col("status") == "succeeded", 0).otherwise(1), F.desc("updated_at"), F.desc("created_at"), "task_id"
    )
    return tasks.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def run_summary(claimed: DataFrame) -> DataFrame:
    """One row: scanned, claimed, dead-lettered and skipped counts of a round."""
    verdict = F.col("claim")
    return claimed.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(verdict == "claimed").alias("claimed"),
        F.count_if(verdict == "dead-letter").alias("dead_lettered"),
        F.count_if(verdict.isin("not-claimable", "waiting")).alias("skipped"),
    )


def ingestion_statistics(tasks: DataFrame) -> DataFrame:
    status = F.col("status")
    return tasks.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "succeeded").alias("succeeded"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "running").alias("running"),
    )


def recovery_checks(tasks: DataFrame, now: Column) -> DataFrame:
    """The checks of a recovery drill as rows ``check, ok``: that tasks exist, that pending
    ones can run, that expired ones can be taken over, that dead letters stay failed, and
    that no other task is claimable."""
    due = F.coalesce(runnable(F.col("status"), F.col("next_run_at"), F.col("lease_expires_at"), now), F.lit(False))
    dead = F.coalesce("dead_letter", F.lit(False))
    checks = {
        "has-tasks": F.count(F.lit(1)) > 0,
        "pending-runnable": F.count_if((F.col("status") == "pending") & due) > 0,
        "running-expired": F.count_if((F.col("status") == "running") & due) > 0,
        "dead-letters-failed": F.count_if(dead & (F.col("status") != "failed")) == 0,
        "finished-not-claimable": F.count_if(F.col("status").isin("succeeded", "failed") & due) == 0,
    }
    row = tasks.agg(*(c.alias(k) for k, c in checks.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("check"), F.col(f"`{k}`").alias("ok")) for k in checks))
    return row.select(F.explode(pairs).alias("c")).select("c.*")


def token_bucket(requests: DataFrame, rate: float = 10.0, burst: float = 20.0) -> DataFrame:
    """``client, at_seconds, allowed``: a bucket per client that fills by ``rate`` a second
    up to ``burst``; a request takes one or is refused.

    Each client's requests lie in one partition, sorted, and pass by once: a task holds one
    bucket and one Arrow batch, however many requests a client has. Requests without a time
    are left out; those without a client share a bucket.
    """
    kind = requests.schema["client"].dataType.simpleString()
    in_order = requests.filter("at_seconds is not null").select("client", F.col("at_seconds").cast("double").alias("at_seconds"))
    in_order = in_order.repartition("client").sortWithinPartitions("client", "at_seconds")

    def run(batches):
        started, client, tokens, last = False, None, 0.0, 0.0
        for batch in batches:
            allowed = []
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not started or own != client:
                    started, client, tokens, last = True, own, burst, t
                tokens, last = min(burst, tokens + (t - last) * rate), t
                allowed.append(tokens >= 1)
                tokens -= allowed[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_())], ["client", "at_seconds", "allowed"])

    return in_order.mapInArrow(run, f"client {kind}, at_seconds double, allowed boolean")


def stage_trace(tasks: DataFrame) -> DataFrame:
    """Trace rows of tasks: a root per task and one row per event of its trace."""
    root = tasks.select(
        "trace_id", F.lit("ingestion:task-created").alias("stage"), "status", F.col("created_at").alias("at"), F.lit(0).alias("position")
    )
    events = tasks.select("trace_id", F.posexplode("trace").alias("i", "e")).select(
        "trace_id", F.concat(F.lit("ingestion:"), F.col("e.stage")).alias("stage"), F.col("e.status").alias("status"),
        F.col("e.at").alias("at"), (F.col("i") + 1).alias("position"),
    )
    return root.unionByName(events)


def not_blank_or(default: str, column: str) -> Column:
    return F.when(is_blank(F.col(column)), F.lit(default)).otherwise(F.col(column))
