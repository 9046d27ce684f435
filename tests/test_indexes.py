"""Vector and postings indexes against exact searches; words by dictionary."""

from __future__ import annotations

import itertools
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.text import tokenize_terms
from quern.operators import bm25, knn, segmentation
from quern.operators.postings import PostingsIndex
from quern.operators.ranking import top_k
from quern.operators.vector_index import VectorIndex, recall

KIND = "record_id long, vector array<double>, tenant string"


def vectors(spark, n=600, clumps=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clumps, 8)) * 3
    rows = [(k, (centres[k % clumps] + rng.normal(size=8)).tolist(), "a" if k % 3 else "b") for k in range(n)]
    rows += [(n + k, rows[5][1], "a") for k in range(40)]  # ties: one vector many times
    rows += [(n + 50, [0.0] * 8, "a"), (n + 51, [1.0, 2.0], "a"), (n + 52, [], "a"), (n + 53, None, "b")]
    return spark.createDataFrame(rows, KIND)


def ask(spark, *vectors_):
    return spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(vectors_)], "query_id long, query_vector array<double>")


def listed(df):
    return [(r.query_id, r.record_id, round(r.score, 6)) for r in df.orderBy("query_id", "rank").collect()]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return VectorIndex.build(vectors(spark), f"file://{tmp_path_factory.mktemp('v')}/i", cells=12)


def queries(spark):
    some = [r.vector for r in vectors(spark).orderBy("record_id").limit(6).collect()]
    return ask(spark, *some, [0.0] * 8, np.ones(8), -np.ones(8), [1.0, 2.0])


def test_exact_search_is_that_of_the_scan(spark, index):
    usable = vectors(spark).filter(F.size("vector") == 8)
    want = knn.nearest(usable, queries(spark).filter(F.size("query_vector") == 8), 7, least=None, digits=6)
    assert listed(index.search(queries(spark), 7, exact=True, digits=6, probes=1)) == listed(want)
    least = knn.nearest(usable, queries(spark).filter(F.size("query_vector") == 8), 7, least=0.5, digits=6)
    assert listed(index.search(queries(spark), 7, exact=True, digits=6, probes=2, least=0.5)) == listed(least)


def test_probes_reach_their_recall_and_read_only_their_cells(spark, index):
    asked = queries(spark).filter("query_id < 6")
    found = recall(index.search(asked, 10), index.search(asked, 10, exact=True)).agg(F.sum("n_found") / F.sum("n")).first()[0]
    assert found >= 0.9 and index.probes() < len(index.cells())
    cell = index.cells()[1].cell
    plan = index.read([cell])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and f"(cell#" in plan and f"= {cell})" in plan


def test_filters_reach_the_reader(spark, index):
    found = index.search(ask(spark, np.ones(8)), 5, exact=True, digits=6, where=F.col("tenant") == "b")
    usable = vectors(spark).filter("size(vector) = 8 AND tenant = 'b'")
    assert listed(found) == listed(knn.nearest(usable, ask(spark, np.ones(8)), 5, least=None, digits=6))


def test_added_vectors_are_found(spark, tmp_path):
    first, second = vectors(spark).filter("record_id % 2 = 0"), vectors(spark).filter("record_id % 2 = 1")
    grown = VectorIndex.build(first, f"file://{tmp_path}/g", dimensions=8, cells=5)
    grown.add(second)
    want = knn.nearest(vectors(spark).filter(F.size("vector") == 8), ask(spark, np.ones(8)), 9, least=None, digits=6)
    again = VectorIndex(spark, f"file://{tmp_path}/g")
    assert listed(again.search(ask(spark, np.ones(8)), 9, exact=True, digits=6)) == listed(want)


def test_one_vector_and_string_ids(spark, tmp_path):
    one = spark.createDataFrame([("x", [1.0, 0.0])], "id string, v array<float>")
    small = VectorIndex.build(one, f"file://{tmp_path}/o", record="id", vector="v")
    assert [tuple(r) for r in small.search(ask(spark, [2.0, 0.0]), 3).collect()] == [(0, "x", 1.0, 1)]


WORDS = ["alpha", "beta", "gamma", "delta", "rare", "the", "of", "and", "omega", "词语"]


def chunks(spark, seed=1, n=400):
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choices(WORDS, weights=[5, 4, 3, 2, 1, 60, 50, 40, 1, 1], k=rng.randint(0, 40))) + f" w{k % 97}", rng.choice(WORDS), f"s{k % 2}") for k in range(n)]
    return spark.createDataFrame([*rows, (9001, None, None, "s0"), (9002, "", "", "s1")], "chunk_id long, text string, title string, tenant string")


def searches(spark):
    rows = [(1, "alpha the of rare", "s0"), (2, "the", "s1"), (3, "unknown words", "s0"), (4, "omega w5 and beta", "s1"), (5, "", "s0"), (6, None, "s1")]
    return spark.createDataFrame(rows, "query_id long, query string, tenant string")


@pytest.mark.parametrize("columns", [bm25.Columns(), bm25.Columns(title="title"), bm25.Columns(title="title", scope="tenant")])
def test_postings_have_the_scores_of_the_scan(spark, tmp_path, columns, monkeypatch):
    monkeypatch.setattr("quern.operators.postings.GROUP", 8)
    index = PostingsIndex.build(chunks(spark).filter("chunk_id < 300"), f"file://{tmp_path}/p", columns)
    assert index.add(chunks(spark).filter("chunk_id >= 300"), columns) == 2
    for k in (1, 6):
        want = top_k(bm25.bm25_scores(chunks(spark), searches(spark), columns).withColumn("score", F.round("score", 6)), k)
        search = index.search(searches(spark), k, columns, digits=6)
        assert sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in search.hits().collect()) == sorted(
            (r.query_id, r["rank"], r.chunk_id, r.score) for r in want.collect()
        )
    counted = {r.query_id: r for r in index.search(searches(spark), 1, columns, digits=6).blocks().collect()}
    assert all(r.n_read + r.n_skipped == r.n_blocks for r in counted.values()) and sum(r.n_skipped for r in counted.values()) > 0
    before = bm25.bm25_scores(chunks(spark).filter("chunk_id < 300"), searches(spark), columns).withColumn("score", F.round("score", 6))
    old = index.search(searches(spark), 5, columns, version=1, digits=6).hits()
    assert sorted(map(tuple, old.select("query_id", "chunk_id", "score").collect())) == sorted(map(tuple, top_k(before, 5).select("query_id", "chunk_id", "score").collect()))


def test_a_search_reads_no_text(spark, tmp_path):
    index = PostingsIndex.build(chunks(spark), f"file://{tmp_path}/p")
    assert "text" not in index.read().columns and "title" in index.read().columns  # the mark of title postings
    hits = index.search(searches(spark), 3).hits()
    assert "text:string" not in "".join(line for line in hits._jdf.queryExecution().toString().splitlines() if "ReadSchema" in line)


def cheapest(run, costs, unknown):
    """By trying every way to cut."""
    best = None
    for n in range(len(run)):
        for ends in itertools.combinations(range(1, len(run)), n):
            at = [0, *ends, len(run)]
            parts = [run[a:b] for a, b in zip(at, at[1:])]
            if any(p not in costs and len(p) > 1 for p in parts):
                continue
            cost = sum(costs.get(p, unknown) for p in parts)
            key = (cost, [-len(p) for p in parts])
            if best is None or key < best[0]:
                best = (key, parts)
    out, apart = [], False
    for p in best[1]:
        if p not in costs and apart:
            out[-1] += p
        else:
            out.append(p)
        apart = p not in costs
    return out


def test_cuts_are_the_cheapest_of_all(spark):
    rng = random.Random(1)
    for _ in range(60):
        words = {"".join(rng.choices("请假流程单", k=rng.randint(1, 3))): rng.randint(1, 9) for _ in range(7)}
        trie = segmentation.Trie(words.items())
        costs = {w: segmentation.word_cost(n, sum(words.values())) for w, n in words.items()}
        for _ in range(6):
            run = "".join(rng.choices("请假流程单天", k=rng.randint(1, 8)))
            assert trie.cut(run) == cheapest(run, costs, trie.unknown)


def test_terms_of_mixed_texts(spark):
    words = spark.createDataFrame([("请假", 10), ("流程", 5), ("年假申请", 2), ("", 3), (None, 1), ("坏", 0)], "word string, frequency long")
    terms = segmentation.tokenizer(segmentation.segmenter(words))
    rows = spark.createDataFrame([("请假 policy 流程",), ("请假流程",), ("年假申请单 X",), ("the quick brown fox",), ("",), (None,)], "t string")
    got = [set(r.x) for r in rows.select(terms(F.col("t")).alias("x")).collect()]
    plain = [set(r.x) for r in rows.select(tokenize_terms(F.col("t")).alias("x")).collect()]
    assert all(p <= g for p, g in zip(plain, got)) and {"请假", "policy", "流程"} <= got[0] and "请假" in got[1]
    assert "年假申请" in got[2] and "年假申请" not in plain[2] and "quick" in got[3] and got[4] == got[5] == set()


def test_a_dictionary_that_is_too_large_is_refused(spark):
    words = spark.range(100).select(F.col("id").cast("string").alias("word"), F.lit(1).alias("frequency"))
    with pytest.raises(ValueError, match="bytes of words"):
        segmentation.segmenter(words, most_bytes=50)


def test_dictionary_terms_are_searched(spark, tmp_path):
    words = spark.createDataFrame([("年假申请", 2)], "word string, frequency long")
    columns = bm25.Columns(tokenize=segmentation.tokenizer(segmentation.segmenter(words)))
    texts = spark.createDataFrame([(1, "年假申请单"), (2, "年 假 申 请")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "年假申请")], "query_id long, query string")
    want = {r.chunk_id: round(r.score, 9) for r in bm25.bm25_scores(texts, asked, columns).collect()}
    index = PostingsIndex.build(texts, f"file://{tmp_path}/{uuid.uuid4().hex}", columns)
    assert {r.chunk_id: round(r.score, 9) for r in index.search(asked, 5, columns).hits().collect()} == want and want[1] > want[2]


def test_blocks_of_a_group():
    """A group's terms become blocks in one task, without a row per posting."""
    import pyarrow as pa

    from quern.operators.postings import _blocks_of

    group = pa.table(
        {
            "_scope": pa.array([0, 0]), "_group": pa.array([5, 5]), "_chunk": pa.array(["a", "b"]), "_terms": pa.array([["x", "y"], ["y"]]),
            "_title_terms": pa.array([[], ["y"]], pa.list_(pa.string())), "_dl": pa.array([2, 1], pa.int32()), "_tl": pa.array([0, 1], pa.int32()),
        }
    )
    got = sorted((r["term"], r["title"], r["n"], r["shortest"], sorted((c["chunk"], c["length"]) for c in r["chunks"])) for r in _blocks_of(group).to_pylist())
    assert got == [("x", False, 1, 2, [("a", 2)]), ("y", False, 2, 1, [("a", 2), ("b", 1)]), ("y", True, 1, 1, [("b", 1)])]


def shuffled_records(spark):
    """By all stages of the session so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_postings_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Of a large vocabulary neither building nor searching an index moves more than the queries' blocks."""
    monkeypatch.setattr("quern.operators.postings.TERMS", 0)
    rows = [(k, " ".join([f"own{k}x{n}" for n in range(60)] + ["alpha", "beta"][k % 2 :])) for k in range(400)]
    texts = spark.createDataFrame(rows, "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "alpha own7x3"), (2, "beta own8x1 own9x2")], "query_id long, query string")
    before = shuffled_records(spark)
    index = PostingsIndex.build(texts, f"file://{tmp_path}/p")
    built = shuffled_records(spark)
    hits = index.search(asked, 5).hits().collect()
    assert len(hits) == 10 and built - before < 100 and shuffled_records(spark) - built < 2000


def test_blocks_are_cut_to_the_queries_terms_before_they_are_shuffled(spark, tmp_path, monkeypatch):
    """Also where Spark broadcasts nothing by itself."""
    monkeypatch.setattr("quern.operators.postings.TERMS", 0)
    monkeypatch.setattr("quern.operators.postings.GROUP", 8)
    rows = [(k, " ".join([f"own{k}x{n}" for n in range(60)] + ["alpha", "beta"][k % 2 :])) for k in range(400)]
    texts = spark.createDataFrame(rows, "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "query_id long, query string")
    search = PostingsIndex.build(texts, f"file://{tmp_path}/p").search(asked, 1)
    before = shuffled_records(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [(r.query_id, r.chunk_id) for r in search.hits().orderBy("query_id").collect()] == [(1, 0), (2, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert shuffled_records(spark) - before < 2000


def test_small_batches_leave_the_session_as_it_was(spark):
    from quern.session import batches_of

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), batches_of(spark, 1 << 20):
        assert spark.conf.get(key) == f"{1 << 20}b"
        1 / 0  # noqa: B018
    assert spark.conf.get(key) == before


def test_passes_of_queries_text_ids_and_long_sums(spark, tmp_path, monkeypatch):
    """A query to a pass; ids are texts; copies tie and the id decides."""
    monkeypatch.setattr("quern.operators.postings.PASS", 1)
    monkeypatch.setattr("quern.operators.postings.GROUP", 4)
    texts = chunks(spark, n=60).withColumn("chunk_id", F.concat(F.lit("c"), F.col("chunk_id")))
    texts = texts.unionByName(texts.withColumn("chunk_id", F.concat("chunk_id", F.lit("b"))))
    index = PostingsIndex.build(texts, f"file://{tmp_path}/p")
    got = index.search(searches(spark), 5).hits().collect()
    want = top_k(bm25.bm25_scores(texts, searches(spark)), 5).collect()
    assert sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in got) == sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in want)
    members = index.groups().select(F.explode("members.chunk").alias("c"))
    assert members.count() == members.distinct().count() == texts.count()


def test_an_empty_index_can_be_built(spark, tmp_path):
    assert PostingsIndex.build(chunks(spark).filter("false"), f"file://{tmp_path}/e").segments() == 0


def test_sums_beyond_exact_doubles_are_whole_numbers():
    from quern.operators.postings import _Pass

    row = {"_query": 1, "_scope": 0, "_w": ["a", "b"], "_idfs": [1.0, 1.0], "_essentials": [True, False], "_mean": 1.0, "_low": 0.0, "_reached": None}
    codes, shares = np.array([0, 1]), np.array([[2.0**53], [2.0]])
    able, scores = _Pass([row], 5, 0.0).scores(codes, shares, np.array([0]))
    assert list(able) == [0] and scores[0, 0] == (2.0**53 + 2) / bm25.STEPS


def test_repeated_runs_give_their_terms_once(spark):
    words = spark.createDataFrame([("请假", 10), ("流程", 5)], "word string, frequency long")
    terms = segmentation.tokenizer(segmentation.segmenter(words))
    row = spark.createDataFrame([("流程请假 ab 请假流程 流程请假 ab cd 请假流程", "流程请假 ab 请假流程 cd")], "t string, u string")
    r = row.select(terms(F.col("t")).alias("t"), terms(F.col("u")).alias("u"), tokenize_terms(F.col("t")).alias("p"), tokenize_terms(F.col("u")).alias("q")).first()
    assert r.t == r.u and r.p == r.q and r.t[:2] == ["流程", "请假"]
