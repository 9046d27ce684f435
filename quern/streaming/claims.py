"""Claims of tasks as keyed state: leases, retries and dead letters by timers.

A task's state is a few numbers under its id, kept by Spark's state store; nothing rewrites a
table of tasks. What happens to a task arrives as events; what has to happen later is a timer:
a pending task's timer is when it is due, a running task's is when its lease ends. A lease
that ends starts the next attempt, and after the last one the task is a dead letter. The
output is a row for each transition, which is all that a table or a worker needs.

With ``event_time`` the clock is the events' watermark, so that a replay of the same events
makes the same transitions; else it is the wall clock, and finished tasks are forgotten after
``keep_seconds`` (the state's time to live).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.functions.rules import retry_class, retry_tier
from quern.operators.tasks import LEASE_SECONDS, MAX_ATTEMPTS
from quern.session import ship_package

#: Seconds per attempt, and at most, by retry tier.
DELAYS = {"dependency-backoff": (15, 300), "fast-backoff": (3, 30), "standard-backoff": (5, 90)}
STATE = "status string, attempts int, most int, until long"
OUTPUT = "task_id string, at_ms long, change string, status string, attempt_count int, until_ms long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FINISHED = ("succeeded", "failed")
_COLUMNS = [c.split(" ")[0] for c in OUTPUT.split(", ")]


class Claims(StatefulProcessor):
    """The state machine of one task. States: pending, running, succeeded, failed."""

    def __init__(self, lease_ms: int, keep_ms: int | None):
        self.lease_ms, self.keep_ms = lease_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", STATE, self.keep_ms)

    def close(self) -> None:
        pass

    def _set(self, now: int, change: str, status: str, attempts: int, most: int, until: int | None) -> tuple:
        """The new state, with one timer, and its row."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if until is not None:
            self.handle.registerTimer(until)
        self.task.update((status, attempts, most, until if until is not None else 0))
        return (now, change, status, attempts, until)

    def _start(self, now: int, attempts: int, most: int, lost: bool = False) -> list[tuple]:
        """The next attempt, or the end if there is none."""
        if attempts >= most:
            return [self._set(now, "dead-letter", "failed", attempts, most, None)]
        return [self._set(now, "reclaimed" if lost else "claimed", "running", attempts + 1, most, now + self.lease_ms)]

    def _event(self, e, now: int) -> list[tuple]:
        known = self.task.get() if self.task.exists() else None
        if known is None:
            if e.kind != "created":
                return []
            most = int(e.max_attempts) if pd.notna(e.max_attempts) and e.max_attempts > 0 else MAX_ATTEMPTS
            due = int(e.due_ms) if pd.notna(e.due_ms) else now
            if due > now:
                return [self._set(now, "waiting", "pending", 0, most, due)]
            return self._start(now, 0, most)
        status, attempts, most, _ = known
        if status != "running" or e.kind == "created":  # repeated, late, or of an attempt that is over
            return []
        if pd.notna(e.attempt) and int(e.attempt) != attempts:
            return []
        if e.kind == "heartbeat":
            return [self._set(now, "extended", "running", attempts, most, now + self.lease_ms)]
        if e.kind == "succeeded":
            return [self._set(now, "succeeded", "succeeded", attempts, most, None)]
        if e.kind != "failed":
            return []
        if not e.retryable:
            return [self._set(now, "terminal-failure", "failed", attempts, most, None)]
        if attempts >= most:
            return [self._set(now, "dead-letter", "failed", attempts, most, None)]
        step, longest = DELAYS[e.tier]
        return [self._set(now, "retry", "pending", attempts, most, now + 1000 * min(step * max(attempts, 1), longest))]

    @staticmethod
    def _frame(key, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame([(key[0], *r) for r in rows], columns=_COLUMNS)
        return frame.astype({"until_ms": "Int64", "at_ms": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at_ms", "kind"], kind="stable")
        wall = timerValues.getCurrentProcessingTimeInMs() if self.keep_ms is not None else None
        out = [change for e in events.itertuples() for change in self._event(e, int(e.at_ms) if wall is None else wall)]
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.task.exists():
            return
        by_events = self.keep_ms is None
        passed = timerValues.getCurrentWatermarkInMs() if by_events else timerValues.getCurrentProcessingTimeInMs()
        out: list[tuple] = []
        status, attempts, most, until = self.task.get()
        while status in ("pending", "running") and until and until <= passed:
            # by the watermark, time stands at the timer, and it may have passed the next one too
            out += self._start(until if by_events else passed, attempts, most, lost=status == "running")
            status, attempts, most, until = self.task.get()
        if out:
            yield self._frame(key, out)


def claims(
    events: DataFrame, *, lease_seconds: int = LEASE_SECONDS, event_time: bool = False, delay: str = "0 seconds", keep_seconds: int = 7 * 86_400
) -> DataFrame:
    """``task_id, at_ms, change, status, attempt_count, until_ms`` for a stream of task events.

    ``events``: task_id, at (a timestamp), kind (created, heartbeat, succeeded, failed), and, all
    of them nullable, attempt, max_attempts, next_run_at, retryable, failure_stage,
    failure_reason, error_source. ``change`` is waiting, claimed, reclaimed (a lease ended),
    extended, retry, succeeded, terminal-failure or dead-letter; ``until_ms`` is when the next
    timer fires. Events of a task that is not known, repeated creations, and events of an
    attempt that is over change nothing; rows without an id or a time are left out.

    The session's state store is set to RocksDB, which this kind of state needs.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ship_package(spark)
    retryable = F.coalesce("retryable", F.lit(False))
    kind = retry_class(F.col("failure_stage"), retryable, F.col("error_source"), F.col("failure_reason"))
    named = events.filter("task_id IS NOT NULL AND at IS NOT NULL")
    if event_time:
        named = named.withWatermark("at", delay)
    rows = named.select(
        "task_id", "at", "kind", F.unix_millis("at").alias("at_ms"), F.unix_millis("next_run_at").alias("due_ms"), "attempt", "max_attempts",
        retryable.alias("retryable"), retry_tier(kind, retryable).alias("tier"),
    )
    processor = Claims(1000 * lease_seconds, None if event_time else 1000 * keep_seconds)
    return rows.groupBy("task_id").transformWithStateInPandas(
        processor, OUTPUT, "Append", "EventTime" if event_time else "ProcessingTime"
    )
