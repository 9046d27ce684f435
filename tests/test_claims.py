"""Claims as keyed state: replayed events against a plain model, restarts, and the wall clock."""

from __future__ import annotations

import datetime as dt
import time

from quern.streaming.claims import claims

KIND = (
    "task_id string, at timestamp, kind string, attempt int, max_attempts int, next_run_at timestamp, retryable boolean,"
    " failure_stage string, failure_reason string, error_source string"
)
T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def event(task, seconds, kind, attempt=None, most=None, due=None, retryable=None, source=None):
    return (task, at(seconds), kind, attempt, most, None if due is None else at(due), retryable, "parsing", "odd", source)


def run(spark, folder, batches, name, checkpoint, **options):
    """Each batch is a file; the last one only moves the watermark on."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        stream = spark.readStream.schema(KIND).parquet(f"{folder}/{name}")
        query = (
            claims(stream, event_time=True, lease_seconds=30, **options).writeStream.format("parquet").option("path", f"{folder}/out-{name}")
            .option("checkpointLocation", f"{folder}/{checkpoint}").trigger(availableNow=True).start()
        )
        query.awaitTermination(240)
        assert query.exception() is None
    found = spark.read.parquet(f"{folder}/out-{name}").collect()
    start = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    return sorted((r.task_id, (r.at_ms - start) // 1000, r.change, r.attempt_count, None if r.until_ms is None else (r.until_ms - start) // 1000) for r in found)


def test_leases_retries_and_dead_letters_by_timers(spark, tmp_path):
    first = [
        event("done", 0, "created"), event("lost", 0, "created", most=2), event("later", 0, "created", due=50), event("hard", 0, "created"),
        event("soft", 0, "created", most=1), event("slow", 0, "created"), event("nobody", 1, "succeeded"), (None, at(0), "created", *[None] * 7),
    ]
    second = [
        event("done", 9, "succeeded", attempt=1), event("done", 10, "failed"), event("hard", 9, "failed", retryable=False),
        event("soft", 9, "failed", retryable=True), event("slow", 9, "failed", retryable=True, source="qdrant"), event("done", 11, "created"),
    ]
    clock = [[event("clock", s, "created", due=10_000)] for s in (40, 80, 200)]
    got = run(spark, str(tmp_path), [first, second, *clock], "a", "cp")
    assert [r for r in got if r[0] != "clock"] == [
        ("done", 0, "claimed", 1, 30), ("done", 9, "succeeded", 1, None),
        ("hard", 0, "claimed", 1, 30), ("hard", 9, "terminal-failure", 1, None),
        ("later", 0, "waiting", 0, 50), ("later", 50, "claimed", 1, 80), ("later", 80, "reclaimed", 2, 110), ("later", 110, "reclaimed", 3, 140), ("later", 140, "dead-letter", 3, None),
        ("lost", 0, "claimed", 1, 30), ("lost", 30, "reclaimed", 2, 60), ("lost", 60, "dead-letter", 2, None),
        ("slow", 0, "claimed", 1, 30), ("slow", 9, "retry", 1, 24), ("slow", 24, "claimed", 2, 54), ("slow", 54, "reclaimed", 3, 84), ("slow", 84, "dead-letter", 3, None),
        ("soft", 0, "claimed", 1, 30), ("soft", 9, "dead-letter", 1, None),
    ]


def test_the_wall_clock_ends_leases(spark, tmp_path):
    spark.createDataFrame([event("t", 0, "created", most=2)], KIND).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(KIND).parquet(f"{tmp_path}/in")
    query = (
        claims(stream, lease_seconds=1).writeStream.format("memory").queryName("wall").option("checkpointLocation", f"{tmp_path}/cp")
        .trigger(processingTime="500 milliseconds").start()
    )
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("wall").count() < 3:
            time.sleep(1)
        assert [r.change for r in spark.table("wall").orderBy("at_ms").collect()] == ["claimed", "reclaimed", "dead-letter"]
    finally:
        query.stop()
