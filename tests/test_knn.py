"""Nearest vectors by blocks against pairs one by one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import knn
from quern.operators.ranking import top_k

VECTORS = "record_id long, vector array<float>"


def _rows(n: int, seed: int) -> list:
    rng = np.random.default_rng(seed)
    rows = [(i, rng.integers(-2, 3, 4 if i % 5 else 3).astype(float).tolist()) for i in range(n)]  # many ties, zeros, two sizes
    return rows + [(n, None), (n + 1, []), (n + 2, [1.0, None, 2.0, 0.0]), (n + 3, [float("nan"), 1.0, 0.0, 0.0]), (n + 4, [float("inf"), 1.0, 0.0, 0.0])]


@pytest.mark.parametrize(("least", "digits", "block"), [(None, 6, 1000), (0.3, None, 1000), (0.3, 6, 7)])
def test_blocks_are_exact(spark, monkeypatch, least, digits, block):
    monkeypatch.setattr(knn, "TILE", 50)
    records = spark.createDataFrame(_rows(300, 1), VECTORS).repartition(5)
    asked = spark.createDataFrame(_rows(40, 2), VECTORS).toDF("query_id", "query_vector")
    scored = knn.cosine_scores(records, asked)
    scored = scored if least is None else scored.filter(F.col("score") >= least)
    scored = scored if digits is None else scored.withColumn("score", F.round("score", digits))
    show = lambda df: sorted(map(str, df.select("query_id", "record_id", "score", "rank").collect()))
    got = knn.nearest(records, asked, 6, least=least, digits=digits, block=block)
    assert show(got) == show(top_k(scored, 6, tie="record_id"))


def test_no_pair_is_a_row(spark, capsys):
    """Pairs are entries of a product of matrices, not rows of a join."""
    rows = [(i, [float(i % 7), 1.0]) for i in range(50)]
    records = spark.createDataFrame(rows, VECTORS)
    asked = records.toDF("query_id", "query_vector")
    knn.nearest(records, asked, 3).explain()
    assert "Join" not in capsys.readouterr().out


def test_rounding_is_sparks(spark):
    values = [0.0000005, 0.1234565, -0.1234565, 0.9999995, 0.2500005, 1.0, -0.0000015, 0.1234564999]
    want = [r.r for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6).alias("r")).collect()]
    assert knn._rounded(np.array(values), 6).tolist() == want
