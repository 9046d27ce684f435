"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

import pytest

#: Columns whose names operators use inside.
CLASHING = ("_id", "_text", "_fp", "g", "bucket", "score", "keep_id", "_order", "_digest", "spans", "length", "_x")


def documents(spark, rows):
    """A documents table of (doc_id, text) with clashing extra columns, some of them null."""
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    data = [(i, t, *(None if k % 2 else "x" for k, _ in enumerate(CLASHING))) for i, t in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, {extra}")


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


def awkward_rows():
    """Nulls, empty and blank texts, repeated rows, ties, a very long text."""
    passage = words(1, 40)
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, passage), (5, passage), (5, passage), (6, passage + " tail"),
        (7, "head " + passage), (None, passage), (None, None), (8, words(2, 60_000)), (9, "ß É ñ 日本語 😀 x"),
        (10, "a"), (11, "a"),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    return documents(spark, awkward_rows()).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, [])


@pytest.fixture()
def make(spark):
    return lambda rows: documents(spark, rows)
