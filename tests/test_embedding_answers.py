"""Answers of an embedding service: each way to fail, and vectors put in order."""

from __future__ import annotations

import json

from quern.operators.embedding_answers import read_answers


def body(*items, **more):
    return json.dumps({"data": [{"index": i, "embedding": v} for i, v in items], **more})


CASES = {
    "good": (200, body((1, [3, 4]), (0, [1, 2])), None),
    "leading empty": (200, body((0, []), (1, [1])), None),
    "not reached": (None, None, ("provider-request-failed", True)),
    "busy": (429, "later", ("provider-http-error", True)),
    "down": (503, None, ("provider-http-error", True)),
    "refused": (401, body((0, [1]), (1, [1])), ("provider-http-error", False)),
    "no json": (200, "<html>", ("provider-response-parse-failed", False)),
    "empty": (200, "", ("provider-response-parse-failed", False)),
    "other type": (200, '{"data": "x"}', ("provider-response-parse-failed", False)),
    "told": (200, body(error={"message": " bad model "}), ("provider-api-error", False)),
    "fewer": (200, body((0, [1])), ("provider-vector-count-mismatch", False)),
    "none": (200, "{}", ("provider-vector-count-mismatch", False)),
    "twice": (200, body((0, [1]), (0, [1])), ("provider-vector-index-missing", False)),
    "beyond": (200, body((0, [1]), (2, [1])), ("provider-vector-index-missing", False)),
    "lengths": (200, body((0, [1, 2]), (1, [1])), ("provider-dimension-mismatch", False)),
    "empty later": (200, body((0, [1]), (1, [])), ("provider-dimension-mismatch", False)),
}


def test_answers(spark):
    rows = [(name, ["a", "b"], status, text) for name, (status, text, _) in CASES.items()]
    answers = spark.createDataFrame(rows, "request_id string, chunk_ids array<string>, status int, body string")
    got = {r.request_id: r for r in read_answers(answers, "p", "m").collect()}
    for name, (_, _, want) in CASES.items():
        error = got[name].error
        assert (None if error is None else (error.reason, error.retryable)) == want, name
        assert (got[name].artifacts is None) == (want is not None), name
    assert got["busy"].error.provider == "p" and got["busy"].error.model == "m"
    assert [tuple(a) for a in got["good"].artifacts] == [("a", [1.0, 2.0], 2), ("b", [3.0, 4.0], 2)]
    assert read_answers(answers.filter("false"), "p", "m").isEmpty()


def test_a_request_without_chunks(spark):
    answers = spark.createDataFrame([(1, [], 200, "{}"), (2, None, 200, '{"data": []}')], "request_id int, chunk_ids array<string>, status int, body string")
    got = {r.request_id: r for r in read_answers(answers, "p", "m").collect()}
    assert got[1].error is None and got[1].artifacts == [] and got[2].error is None
