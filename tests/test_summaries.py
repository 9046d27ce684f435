"""The streaming summary trigger against the batch predicate, on random batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quern import fixtures
from quern.operators.conversation import needs_summary
from quern.streaming.summaries import summary_needs

KIND = "conversation_id string, message_id string, position long, content string, is_mark boolean"
SF = "/root/testdata/sf0.001"


def last_rows(spark, folder, batches, **options):
    """The last row per conversation; the query starts again for every batch."""
    found: dict = {}

    def keep(batch, _):
        found.update({r.conversation_id: tuple(r)[1:] for r in batch.collect()})

    for rows in batches:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = summary_needs(spark.readStream.schema(KIND).parquet(f"{folder}/in"), **options)
        query = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
    return found


@pytest.mark.parametrize("seed", [1])
def test_conversations_in_random_batches(spark, tmp_path, seed):
    said = fixtures.messages(spark, SF).withColumn("conversation_id", F.col("conversation_id").cast("string"))
    rows = [(r.conversation_id, r.message_id, r.position, r.content, False) for r in said.collect()]
    rng = random.Random(seed)
    marked = {r[0]: r[1] for r in rng.sample(rows, len(rows) // 8)}
    everything = rows + [(c, m, None, None, True) for c, m in marked.items()] + [("1", "unknown", None, None, True)] * ("1" not in marked)
    rng.shuffle(everything)
    cuts = [0, len(everything) // 4, len(everything) // 2, len(everything)]
    got = last_rows(spark, str(tmp_path), [everything[a:b] for a, b in zip(cuts, cuts[1:])], budget=150)
    marks = spark.createDataFrame(list(marked.items()), "conversation_id string, message_id string")
    want = {r.conversation_id: tuple(r)[1:] for r in needs_summary(said, marks, budget=150).collect()}
    assert got == want and any(v[2] for v in want.values()) and not all(v[2] for v in want.values())


def test_marks_before_and_after_their_message(spark, tmp_path):
    say = lambda c, k, text="请假 policy": (c, f"{c}{k}", k, text, False)
    mark = lambda c, k: (c, f"{c}{k}", None, None, True)
    first = [say("a", 1), say("a", 2), mark("b", 2), say("b", 1), (None, "x", 1, "y", False), say("c", 3, None)]
    second = [mark("a", 1), say("a", 4), say("b", 2), say("b", 5), say("c", 1, "")]
    third = [say("a", 3), mark("a", 1), say("b", 0), mark("b", 5)]
    got = last_rows(spark, str(tmp_path), [first, second, third], budget=8, least=3)
    each = 2 / 2 + 6 / 4
    assert got == {"a": (int(-(-4 * each // 1)), 3, True), "b": (int(-(-4 * each // 1)), 0, False), "c": (0, 2, False)}
