"""The token bucket per client as a stateful streaming operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "client string, at_seconds double, allowed boolean"
STATE = "tokens double, last double"
IDLE_MS = 5 * 60 * 1000


def rate_limited(requests: DataFrame, rate: float = 10.0, burst: float = 20.0) -> DataFrame:
    """``client, at_seconds, allowed`` for a stream of ``client, at_seconds``.

    Only a bucket (two numbers) is kept per client, and dropped after five idle minutes.
    Requests of one batch are taken in the order of their times.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = sorted(t for frame in frames for t in frame["at_seconds"].tolist())
        tokens, last = state.get if state.exists else (burst, times[0])
        rows = []
        for t in times:
            tokens, last = min(burst, tokens + max(t - last, 0.0) * rate), max(last, t)
            allowed = tokens >= 1
            tokens -= allowed
            rows.append((key[0], t, bool(allowed)))
        state.update((float(tokens), float(last)))
        state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame(rows, columns=["client", "at_seconds", "allowed"])

    return requests.groupBy("client").applyInPandasWithState(
        step, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )
