"""Sentences of long paragraphs, cut once and in batches."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quern.functions.text import sentences
from quern.operators import chunking
from quern.operators.indexing import deterministic_provider


def test_batches_give_the_same_sentences(spark):
    draw = random.Random(4)
    texts = ["", "\n", "a", "a\n\n b。c", None, *("".join(draw.choices("ab é。！？\n\u0085\u3000😀", k=draw.randrange(60))) for _ in range(600))]
    rows = spark.createDataFrame([(f"k{n}", n, t) for n, t in enumerate(texts)], "_at string, id long, text string").repartition(1)
    want = rows.select("_at", "id", F.posexplode(sentences(F.col("text"))).alias("chunk_index", "s"))
    found = chunking._sentences_of(rows, "id")
    assert found.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []


def test_sentences_are_cut_once(spark, monkeypatch):
    tags, put = [], chunking.materialize
    monkeypatch.setattr(chunking, "materialize", lambda df, tag: tags.append(tag) or put(df, tag))
    text = "\n".join(f"line {k} of a paragraph" for k in range(60))
    blocks = spark.createDataFrame([("d", 0, "paragraph", text, 0, len(text))], "document_id string, block int, type string, text string, start int, stop int")
    made = chunking.semantic_segments(blocks, target=100, provider=deterministic_provider)
    assert tags.count("sentences") == 1
    assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() > 10
