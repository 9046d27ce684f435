"""The whole search, rounds of an agent, entities."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.operators import entities
from quern.operators.search import lexical_reranker, search, search_rounds, valid_queries

RECORDS = [
    ("k::c1", "kb_ops", "d1", "c1", "Rollback", "rollback checklist for a failed deployment", [1.0, 0.0], "t1", {"section": "ops"}),
    ("k::c2", "kb_ops", "d2", "c2", "Leave", "leave policy and rollback of requests", [0.0, 1.0], "t1", {"section": "policy"}),
    ("k::c3", "kb_hr", "d3", "c3", "Other", "unrelated words here", [0.9, 0.1], "t2", {"section": "policy"}),
    ("k::c4", "kb_hr", "d4", "c4", "Short", "rollback", [0.1], "t2", {}),
]
QUERIES = [
    ("q1", "rollback checklist", [1.0, 0.0], "", {}, []), ("q2", "rollback checklist", [1.0, 0.0], "t2", {}, []),
    ("q3", "rollback", [], "", {"section": " POLICY "}, []), ("q4", " ", [1.0, 0.0], "", {}, []),
    ("q5", "rollback", [0.0, 1.0, 0.0], "", {}, ["kb_hr"]),
]


@pytest.fixture(scope="module")
def tables(spark):
    records = spark.createDataFrame(
        RECORDS,
        "record_id string, knowledge_base_id string, document_id string, chunk_id string, title string, content string, "
        "vector array<float>, tenant_id string, metadata map<string,string>",
    ).withColumn("org_id", F.lit(None).cast("string"))
    queries = spark.createDataFrame(
        QUERIES,
        "query_id string, query string, query_vector array<float>, tenant_id string, filters map<string,string>, knowledge_base_ids array<string>",
    )
    return records, queries


def hits(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.chunk_id, r.score_source))
    return out


def test_vector_mode(tables):
    got = hits(search(*tables, "vector"))
    assert got["q1"] == [("c1", "vector"), ("c3", "vector")] and got["q2"] == [("c3", "vector")]
    assert set(got) == {"q1", "q2"}  # no vector, other dimensions, blank text


def test_keyword_mode(tables):
    got = hits(search(*tables, "keyword"))
    assert got["q1"][0][0] == "c1" and {c for c, _ in got["q1"]} == {"c1", "c2", "c4"}
    assert got["q2"] == [("c4", "keyword")] and got["q3"] == [("c2", "keyword")] and got["q5"] == [("c4", "keyword")]


def test_hybrid_falls_back_to_keywords(tables):
    got = hits(search(*tables, "hybrid"))
    assert got["q1"][0] == ("c1", "hybrid") and got["q3"] == [("c2", "keyword")] and got["q5"] == [("c4", "keyword")]
    assert "q4" not in got


def test_reranker(tables):
    rows = search(*tables, "keyword", reranker=lexical_reranker).collect()
    best = {r.query_id: r.chunk_id for r in rows if r["rank"] == 1}
    assert best["q1"] == "c1" and all(0 <= r.score <= 1 for r in rows)
    with pytest.raises(ValueError):
        search(*tables, "other")


def test_top_k_is_clamped(tables):
    queries = tables[1].withColumn("top_k", F.lit(99))
    assert {r.top_k for r in valid_queries(queries).collect()} == {20}
    assert valid_queries(tables[1].drop("filters", "tenant_id")).count() == 4


def test_rounds(spark):
    turns = spark.createDataFrame([("a", "x", ["x", "y"]), ("b", "z", ["z", "y"]), ("c", "n", ["n"])], "query_id string, rewritten string, sub_queries array<string>")
    scores = {"x": 0.1, "y": 0.9, "z": 0.5}

    def find(asked):
        return asked.filter(F.col("query").isin(*scores)).withColumn("score", F.create_map(*[F.lit(x) for p in scores.items() for x in p])[F.col("query")])

    got = sorted((r.query_id, r.query, r["round"]) for r in search_rounds(turns, find).collect())
    assert got == [("a", "x", 0), ("a", "y", 1), ("b", "z", 0)]


def test_entities(spark):
    kbs = spark.createDataFrame([("k1", "one", None, " "), ("k2", "two", "t", "o")], "kb string, name string, tenant_id string, org_id string")
    docs = spark.createDataFrame([("k1", "d1"), ("k2", "d2")], "kb string, d string")
    parents, children = entities.delete_with_children(kbs, docs, F.col("kb") == "k1", "kb")
    assert [r.kb for r in parents.collect()] == ["k2"] and [r.d for r in children.collect()] == ["d2"]
    scoped = {r.kb: (r.tenant_id, r.org_id) for r in entities.normalized_scope(kbs).collect()}
    assert scoped == {"k1": ("default", "default"), "k2": ("t", "o")}
    new = spark.createDataFrame([("k2", "TWO", "t", "o"), ("k3", "three", "t", "o")], kbs.schema)
    assert sorted(r.name for r in entities.upsert_rows(kbs, new, "kb").collect()) == ["TWO", "one", "three"]
    actor = F.struct(F.lit("u").alias("user_id"), F.lit("user").alias("role"), F.lit("t").alias("tenant_id"), F.lit("").alias("org_id"))
    tools = spark.range(1).select(entities.visible_tools({"list": "tenant", "admin": "admin"}, actor).alias("t")).first().t
    assert tools == ["list"]


@pytest.mark.parametrize("block", [1000, 1])
def test_containment(spark, block):
    from quern.operators.local import containment_scores

    docs = spark.createDataFrame([("a", "rollback plan"), ("b", None), ("c", "xxplanxx")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", ["plan", "plan", "roll"]), ("r", []), ("s", None), ("t", ["zz"])], "query_id string, terms array<string>")
    got = sorted(tuple(r) for r in containment_scores(docs, asked, block=block).collect())
    assert got == [("q", "a", 3.0), ("q", "c", 2.0)]
    assert containment_scores(docs, asked.limit(0)).count() == 0


def test_containment_by_weights_and_scopes(spark):
    import random

    from quern.operators.local import containment_scores

    rng = random.Random(2)
    word = lambda: rng.choice(["plan", "roll", "back", "an", "zz"])
    docs = [(n, rng.choice(["x", "y", None]), " ".join(word() for _ in range(4)), rng.choice([word(), None])) for n in range(60)]
    asked = [(n, rng.choice(["x", "y", None]), [word() for _ in range(rng.randrange(4))]) for n in range(30)]
    want = sorted(
        (q, c, float(s))
        for q, at, terms in asked
        for c, scope, text, title in docs
        if (at is None or at == scope) and (s := sum((t in text) + 0.5 * (title is not None and t in title) for t in terms)) > 0
    )
    chunks = spark.createDataFrame(docs, "chunk_id long, s string, text string, title string")
    queries = spark.createDataFrame(asked, "query_id long, q string, terms array<string>")
    for bounds in ({}, {"characters": 20}, {"block": 7}):
        found = containment_scores(chunks, queries, weights={"text": 1.0, "title": 0.5}, chunk_scope="s", query_scope="q", **bounds)
        assert sorted(map(tuple, found.collect())) == want


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_containment_cuts_in_tasks(spark, kind):
    """Each task sends the best of a query only."""
    import random

    from quern.operators import local
    from quern.operators.ranking import top_k

    rng = random.Random(3)
    pool = ["plan", "roll", "planroll", "an", "zz", "é。plan", "Zan"]
    docs = [(n, rng.choice([None, "", " ".join(rng.choices(pool, k=rng.randrange(1, 5)))])) for n in range(400)]
    asked = [(n, rng.choices(["plan", "an", "l r", "zz", "oll", "é"], k=rng.randrange(4))) for n in range(12)]
    chunks = spark.createDataFrame(docs, "chunk_id long, text string").withColumn("chunk_id", F.col("chunk_id").cast(kind)).repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, terms array<string>")
    whole = local.containment_scores(chunks, queries)
    found = local.containment_scores(chunks, queries, best=4)
    rows = lambda df: sorted(map(tuple, top_k(df, 4).collect()))
    assert rows(found) == rows(whole) != []
    want = sorted((q, float(s)) for q, terms in asked for c, t in docs if (s := sum(w in (t or "") for w in terms)) > 0)
    assert sorted((r.query_id, r.score) for r in whole.collect()) == want
    assert found.count() <= 3 * 4 * 12 or kind == "string"


def test_copies_tie_whatever_the_order_of_additions(spark):
    """Copies have one score, so that the smaller id comes first."""
    from quern.operators import bm25

    words = [f"w{n}" for n in range(40)]
    rows = [(n, " ".join(words[n % 17 :] + words[: n % 17])) for n in range(200)] + [(1000 + n, " ".join(words[: n % 39 + 1])) for n in range(400)]
    docs = spark.createDataFrame(rows, "chunk_id long, text string").repartition(16)
    asked = spark.createDataFrame([(1, " ".join(words))], "query_id long, query string")
    scores = {r.score for r in bm25.bm25_scores(docs, asked).filter("chunk_id < 200").collect()}
    assert len(scores) == 1
