"""What an embedding service answered: vectors by index, or why there are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons, and whether a request may be repeated (of an HTTP error: 429 and
#: from 500 on).
RETRYABLE = {
    "provider-request-failed": True, "provider-http-error": None, "provider-response-parse-failed": False, "provider-api-error": False,
    "provider-vector-count-mismatch": False, "provider-vector-index-missing": False, "provider-dimension-mismatch": False,
}
_BODY = "data array<struct<index:int,embedding:array<float>>>, error struct<message:string>, _corrupt string"


def embedding_error(reason: Column, status: Column, provider: str, model: str) -> Column:
    """``struct<provider, model, reason, retryable>`` of a reason, null without one."""
    again = F.lit(False)
    for name, value in RETRYABLE.items():
        again = F.when(reason == name, F.lit(value) if value is not None else (status == 429) | (status >= 500)).otherwise(again)
    error = F.struct(F.lit(provider).alias("provider"), F.lit(model).alias("model"), reason.alias("reason"), again.alias("retryable"))
    return F.when(reason.isNotNull(), error)


def read_answers(answers: DataFrame, provider: str, model: str) -> DataFrame:
    """``request_id, error, artifacts`` of ``request_id, chunk_ids, status, body``.

    ``artifacts`` (chunk_id, vector, dimensions) are in the order of the request and null where
    there is an error; a null status is a service that was not reached. Vectors of one answer
    must have one length; leading empty ones are let through. Where an index is missing, that
    is the reason, whatever the lengths.
    """
    told = F.from_json("body", _BODY, {"columnNameOfCorruptRecord": "_corrupt"})
    by_index = F.array_sort(
        F.transform("_a.data", lambda d: F.struct(F.coalesce(d["index"], F.lit(0)).alias("index"), F.coalesce(d["embedding"], F.array().cast("array<float>")).alias("v")))
    )
    n = F.coalesce(F.size("chunk_ids"), F.lit(0))
    rows = answers.withColumn("_a", told).withColumn("_items", F.coalesce(by_index, F.array().cast("array<struct<index:int,v:array<float>>>")))
    rows = rows.withColumn("_n", F.transform("_items", lambda d: F.size(d["v"])))
    filled = F.slice("_n", F.greatest(F.array_position(F.transform("_n", lambda k: k > 0), True), F.lit(1)).cast("int"), F.greatest(n, F.lit(1)))
    reason = (
        F.when(F.col("status").isNull(), "provider-request-failed")
        .when((F.col("status") < 200) | (F.col("status") >= 300), "provider-http-error")
        .when(F.col("_a").isNull() | F.col("_a._corrupt").isNotNull(), "provider-response-parse-failed")
        .when(F.col("_a.error").isNotNull(), "provider-api-error")
        .when(F.size("_items") != n, "provider-vector-count-mismatch")
        .when(F.exists(F.transform("_items", lambda d, i: d["index"] != i), lambda x: x), "provider-vector-index-missing")
        .when(F.size(F.array_distinct(filled)) > 1, "provider-dimension-mismatch")
    )
    rows = rows.withColumn("_reason", reason)
    made = F.zip_with("chunk_ids", "_items", lambda c, d: F.struct(c.alias("chunk_id"), d["v"].alias("vector"), F.size(d["v"]).alias("dimensions")))
    return rows.select(
        "request_id", embedding_error(F.col("_reason"), F.col("status"), provider, model).alias("error"), F.when(F.col("_reason").isNull(), made).alias("artifacts")
    )
