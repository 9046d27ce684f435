"""Grounding texts cut to a budget."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quern.functions.text import estimate_tokens
from quern.operators.conversation import truncate_grounding


def test_cut_by_one_pass(spark, capsys):
    """The cuts are those of the repeated estimate, which is not repeated."""
    rng = random.Random(4)
    alphabet = "ab \n\u4e00\u3400\uf900\U0001f600\x85"
    texts = [None, "", " " * 3000, "a" * 101] + ["".join(rng.choices(alphabet, k=rng.randrange(2000))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string").repartition(4)
    cut = rows.select("n", truncate_grounding(F.col("text"), budget=40).alias("t"))
    cut.explain()
    assert "aggregate(" not in capsys.readouterr().out
    got = {r.n: r.t for r in cut.collect()}
    left = spark.createDataFrame([(n, k, t[:k]) for n, t in enumerate(texts) if t for k in _lengths(len(t))], "n long, k long, t string")
    fits = {(r.n, r.k) for r in left.filter((estimate_tokens(F.col("t")) <= 40) | (F.col("k") <= 100)).collect()}
    for n, text in enumerate(texts):
        want = text if not text else text[: next(k for k in _lengths(len(text)) if (n, k) in fits)]
        assert got[n] == want


def _lengths(n: int) -> list[int]:
    out = [n]
    while out[-1] > 100:
        out.append(int(out[-1] * 0.8))
    return out
