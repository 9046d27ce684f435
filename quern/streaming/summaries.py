"""When a conversation needs a summary, as messages arrive.

The state of a conversation is small: the units its text is estimated by, summed up, and the
messages since the last one that a summary covers. A new mark drops the messages it covers;
what arrives late is counted where its position lies. After every batch the changed
conversations come out with the same four columns as ``operators.conversation.needs_summary``,
and for the same messages and marks the last row of each equals it, in whatever order they came.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.functions.text import token_units
from quern.operators.conversation import CONTEXT_BUDGET
from quern.session import ship_package
from quern.streaming.claims import ROCKS

TOTALS = "wide long, units long, mark_id string, mark_at long"
OUTPUT = "conversation_id string, total_tokens long, unsummarized long, needs_summary boolean"


class Summaries(StatefulProcessor):
    """Sums of a conversation's units, its mark, and the positions of messages after it."""

    def __init__(self, budget: int, least: int):
        self.budget, self.least = budget, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", TOTALS)
        self.open = handle.getMapState("open", "message_id string", "position long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        wide, units, mark_id, mark_at = self.totals.get() if self.totals.exists() else (0, 0, None, None)
        for frame in rows:
            for m in frame.itertuples():
                if m.is_mark:
                    mark_id, mark_at = m.message_id, None  # found below, unless its message is still to come
                    continue
                wide, units = wide + int(m.wide), units + int(m.units)
                self.open.updateValue((m.message_id,), (int(m.position),))
        if mark_id is not None and mark_at is None and self.open.containsKey((mark_id,)):
            mark_at = self.open.getValue((mark_id,))[0]
        held = [(k[0], v[0]) for k, v in self.open.iterator()]
        if mark_at is not None:
            for message, position in held:
                # the marked message itself stays known, so that the same mark may come again
                if position <= mark_at and message != mark_id:
                    self.open.removeKey((message,))
        self.totals.update((wide, units, mark_id, mark_at))
        n = sum(mark_at is None or position > mark_at for _, position in held)
        total = -(-(2 * wide + units) // 4)
        yield pd.DataFrame({"conversation_id": [key[0]], "total_tokens": [total], "unsummarized": [n], "needs_summary": [bool(total > self.budget and n >= self.least)]})


def summary_needs(messages: DataFrame, *, budget: int = CONTEXT_BUDGET, least: int = 4) -> DataFrame:
    """``conversation_id, total_tokens, unsummarized, needs_summary`` of the changed
    conversations of each batch, for a stream of messages and marks.

    ``messages``: conversation_id, message_id, position, content, is_mark. A mark is a row with
    ``is_mark`` and the id of the last message that a summary covers; it may come before that
    message, and until then every message counts. The latest mark holds, and marks move forward:
    one of a message that an earlier mark covers counts as unknown. Messages are expected once; null content counts as empty, and rows without a conversation or an id are left out.
    """
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ship_package(spark)
    wide, units = token_units(F.col("content"))
    rows = messages.filter("conversation_id IS NOT NULL AND message_id IS NOT NULL").select(
        "conversation_id", "message_id", F.col("position").cast("long"), F.coalesce("is_mark", F.lit(False)).alias("is_mark"),
        wide.cast("long").alias("wide"), units.cast("long").alias("units"),
    )
    return rows.groupBy("conversation_id").transformWithStateInPandas(Summaries(budget, least), OUTPUT, "Update", "None")
