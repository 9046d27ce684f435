"""The chunker as a table function against the chunker of DataFrames."""

from __future__ import annotations

import random

import pytest

from quern.operators import chunk_function
from quern.operators.chunking import chunk_documents


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    pieces = ["word", " ", "\n", "\n\n", "\n\n\n\n", "　", "\x85", "é", "请假", "😀", "x" * 30]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(80)] + [None, "", " \n\n ", "﻿"]
    chunk_function.register(spark)
    table = spark.createDataFrame([(k, t, "ab"[k % 2]) for k, t in enumerate(texts)], "document_id long, text string, lang string")
    table.createOrReplaceTempView("chunked_docs")
    return table


@pytest.mark.parametrize("strategy", ["recursive", "paragraph"])
@pytest.mark.parametrize(("target", "overlap"), [(40, 0), (25, 10), (0, 5), (12, 12)])
def test_results_are_those_of_the_data_frames(spark, docs, strategy, target, overlap):
    got = spark.sql(f"SELECT * FROM chunk(TABLE(chunked_docs) PARTITION BY (lang), '{strategy}', {target}, {overlap})")
    assert got.columns == ["document_id", "lang", "chunk_index", "chunk", "start", "stop"]
    want = chunk_documents(docs, strategy, target=target, overlap=overlap).select("document_id", "chunk_index", "text", "start", "stop")
    assert sorted(map(tuple, got.drop("lang").collect())) == sorted(map(tuple, want.collect()))


def test_columns_follow_the_table_and_wrong_calls_are_refused(spark, docs):
    other = spark.sql("SELECT * FROM chunk(TABLE(SELECT document_id AS id, text AS body FROM chunked_docs), 'Recursive', 9, 0, text => 'body')")
    assert other.columns[0] == "id" and other.count() > 0
    for call, says in (
        ("chunk(TABLE(chunked_docs), 'odd')", "strategy"), ("chunk('x', 'paragraph')", "table"),
        ("chunk(TABLE(chunked_docs), 'paragraph', text => 'none')", "no column"),
        ("chunk(TABLE(SELECT text, 1 AS start FROM chunked_docs), 'paragraph')", "own names"),
    ):
        with pytest.raises(Exception, match=says):
            spark.sql(f"SELECT * FROM {call}").collect()
