"""The ingestion runner as a streaming query over task events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.indexing import last_writer_wins
from quern.operators.tasks import claim
from quern.sources.stores import TableStore

INTERVAL, LIMIT = "2 seconds", 4


def start_runner(
    events: DataFrame,
    store: TableStore,
    checkpoint: str,
    execute: Callable[[DataFrame], DataFrame],
    *,
    limit: int | None = LIMIT,
    interval: str | None = INTERVAL,
    table: str = "tasks",
    ticks: bool = True,
) -> StreamingQuery:
    """Merge each batch of task rows into the store, claim what can run and execute it.

    A batch is one writer: what arrives is merged by the latest update, claims are decided
    from the merged table, and ``execute`` returns the claimed tasks in their next state.
    Writing a batch twice gives the same table, so a restart after a failure is safe. With
    an interval, ``ticks`` of a clock make a batch of every interval, so due retries and
    expired leases do not wait for new tasks; a round writes the tasks that it changes, and
    nothing if there are none.
    """
    if interval and ticks:
        clock = events.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
        events = events.unionByName(clock.select(*blank))

    def run(batch: DataFrame, number: int) -> None:
        fresh = batch.filter("task_id is not null").persist()
        merged = last_writer_wins(store.read(table), fresh, "task_id", "updated_at").persist()
        claimed = claim(merged, F.current_timestamp(), limit).persist()
        try:
            acts = F.col("claim").isin("claimed", "dead-letter")
            if fresh.isEmpty() and claimed.filter(acts).isEmpty():
                return
            done = execute(claimed.filter("claim = 'claimed'").drop("claim"))
            rest = claimed.filter("claim <> 'claimed'").drop("claim").select(*done.columns)
            changed = rest.join(fresh.select("task_id"), "task_id", "left_semi").unionByName(rest.join(claimed.filter("claim = 'dead-letter'").select("task_id"), "task_id", "left_semi"))
            store.upsert(table, changed.unionByName(done).dropDuplicates(["task_id"]), "task_id")
        finally:
            fresh.unpersist()
            claimed.unpersist()
            merged.unpersist()

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def first_of_key(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Requests whose idempotency key did not occur within the delay: the streaming form of
    idempotent creation, with state that the watermark bounds."""
    return requests.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["idempotency_key"])
