"""Orders, cuts and fusions of ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 20
RETRIEVAL_WEIGHT, RERANK_WEIGHT = 0.3, 0.7


def clamp_top_k(k: Column) -> Column:
    """6 where missing or not positive, 20 at most."""
    return F.least(F.when(F.coalesce(k, F.lit(0)) <= 0, F.lit(6)).otherwise(k), F.lit(20))


def top_k(
    scored: DataFrame, k: int | Column, *, by: Sequence[str] = ("query_id",), score: str = "score", tie: str = "chunk_id"
) -> DataFrame:
    """The best ``k`` rows of each query with their ``rank``: score descending, ties by the
    smaller id. A literal ``k`` lets Spark cut each task's rows before the shuffle."""
    window = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def page(rows: DataFrame, order: Sequence[Column], size: int, number: int) -> DataFrame:
    """A page (from 1) of the ordered rows."""
    return rows.orderBy(*order).offset(size * (number - 1)).limit(size)


def min_max(scored: DataFrame, score: str = "score", by: Sequence[str] = ("query_id",)) -> DataFrame:
    """``normalized``: scores scaled to [0, 1] within each query; 0.5 where all are equal."""
    window = Window.partitionBy(*by)
    low, high = F.min(score).over(window), F.max(score).over(window)
    return (
        scored.withColumns({"_low": low, "_high": high})
        .withColumn(
            "normalized",
            F.when(F.col("_high") == F.col("_low"), F.lit(0.5)).otherwise(
                (F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low"))
            ),
        )
        .drop("_low", "_high")
    )


def weighted_fusion(candidates: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """``score``: 0.3 of the scaled retrieval score and 0.7 of the scaled rerank score."""
    first = min_max(candidates, "retrieval_score", by).withColumnRenamed("normalized", "_r")
    both = min_max(first, "rerank_score", by).withColumnRenamed("normalized", "_k")
    return both.withColumn("score", RETRIEVAL_WEIGHT * F.col("_r") + RERANK_WEIGHT * F.col("_k")).drop("_r", "_k")


def reciprocal_rank_fusion(
    lists: Sequence[DataFrame], *, k: int = 60, by: Sequence[str] = ("query_id",), tie: str = "chunk_id"
) -> DataFrame:
    """``query, chunk, score``: the sum of 1 / (k + rank) over the lists that hold a chunk."""
    window = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(tie))
    ranked = None
    for one in lists:
        part = one.select(*by, tie, (1.0 / (k + F.row_number().over(window))).alias("_part"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy(*by, tie).agg(F.sum("_part").alias("score"))


def with_fallback(primary: DataFrame, secondary: DataFrame, by: str = "query_id") -> DataFrame:
    """The primary rows, and the secondary ones of queries that have no primary row, with
    ``source`` telling which."""
    served = primary.select(by).distinct()
    return primary.withColumn("source", F.lit("primary")).unionByName(
        secondary.join(served, by, "left_anti").withColumn("source", F.lit("fallback"))
    )


def low_quality(scored: DataFrame, by: str = "query_id", least: float = 0.3) -> DataFrame:
    """``query, max_score, low_quality``: whether no hit reaches the threshold."""
    return scored.groupBy(by).agg(F.max("score").alias("max_score")).withColumn(
        "low_quality", F.col("max_score") < least
    )
