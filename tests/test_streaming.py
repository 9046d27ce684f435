"""Streaming forms on rows that arrive as files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quern.operators.tasks import succeed
from quern.schemas import schema
from quern.sources.stores import TableStore
from quern.streaming.rate_limit import rate_limited
from quern.streaming.runner import first_of_key, start_runner
from quern.streaming.traces import run_rollup


def collected(spark, query_df, tmp_path, name, mode="append"):
    query = (
        query_df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_rate_limit(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.0)] * 25 + [("a", 0.25)] * 3 + [("b", 0.0)], "client string, at_seconds double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client string, at_seconds double").parquet(str(tmp_path / "in"))
    got = collected(spark, rate_limited(stream), tmp_path, "limited", "append")
    assert sum(r.allowed for r in got if r.client == "a") == 22 and len(got) == 29


def test_rollup_and_first_of_key(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("r1", "chat", "succeeded", base, base), ("r1", "chat", "failed", base, base + dt.timedelta(seconds=9)), ("r2", "x", "running", base + dt.timedelta(days=3), base)]
    kind = "run_id string, stage string, status string, started_at timestamp, finished_at timestamp"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    got = {r.run_id: (r.status, r.n_nodes) for r in collected(spark, run_rollup(stream), tmp_path, "rollup", "complete")}
    assert got == {"r1": ("failed", 2), "r2": ("running", 1)}
    keys = stream.select(F.col("run_id").alias("idempotency_key"), F.col("started_at").alias("created_at"))
    assert len(collected(spark, first_of_key(keys), tmp_path, "first")) == 2


def test_runner(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/store")
    now = dt.datetime(2024, 1, 1)
    columns = schema("tasks").fieldNames()
    values = [{"task_id": f"t{k}", "status": "pending", "attempt_count": 0, "max_attempts": 3, "updated_at": now} for k in range(6)]
    rows = spark.createDataFrame([tuple(v.get(c) for c in columns) for v in values], schema("tasks"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema("tasks")).parquet(str(tmp_path / "in"))

    def execute(claimed):
        return succeed(claimed, F.current_timestamp())

    start_runner(stream, store, str(tmp_path / "cp"), execute, interval=None).awaitTermination(180)
    done = {r.status: r["count"] for r in store.read("tasks").groupBy("status").count().collect()}
    assert done == {"succeeded": 4, "pending": 2}
