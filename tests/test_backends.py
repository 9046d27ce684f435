"""Stores that stop half way, collections, cached postings, the runner's clock, bad rules."""

from __future__ import annotations

import datetime as dt
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.operators import backends, bm25, planning
from quern.operators.search import scope_members, search, valid_queries
from quern.operators.tasks import succeed
from quern.schemas import schema
from quern.sources import parsers
from quern.sources.stores import TableStore
from quern.streaming.runner import start_runner


def bases(spark, *names):
    columns = schema("knowledge_bases").fieldNames()
    return spark.createDataFrame([tuple({"knowledge_base_id": n}.get(c) for c in columns) for n in names], schema("knowledge_bases"))


def names(store):
    return sorted(r.knowledge_base_id for r in store.read("knowledge_bases").collect())


def test_a_replacement_that_stops_half_way_loses_nothing(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    store.overwrite("knowledge_bases", bases(spark, "a"))
    table = Path(tmp_path, "knowledge_bases")
    # stopped while the new files were written: the old table is still in place
    Path(f"{table}__new").mkdir()
    assert names(store) == ["a"]
    store.overwrite("knowledge_bases", bases(spark, "b"))
    assert names(store) == ["b"] and not Path(f"{table}__new").exists() and not Path(f"{table}__old").exists()
    # stopped after the old table was set aside: the new one if complete, else the old one
    bases(spark, "c").write.parquet(f"file://{table}__new")
    table.rename(f"{table}__old")
    assert names(store) == ["c"]
    store.overwrite("knowledge_bases", bases(spark, "d"))
    table.rename(f"{table}__old")
    assert names(store) == ["d"]


def test_collection(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    collection = backends.VectorCollection(store)
    assert not collection.ping() and collection.count() == 0
    collection.create()
    assert collection.ping()
    kind = "record_id string, knowledge_base_id string, document_id string, tenant_id string, vector array<float>, metadata map<string,string>"
    rows = [("a", "k1", "d1", "t", [1.0, 0.0], {"flag": "true", "n": "1"}), ("b", "k2", "d2", "t", [0.0, 1.0], {}), ("c", "k2", "d2", "u", [1.0], {}), ("d", "k3", "d3", "u", [], {})]
    own = spark.createDataFrame(rows, kind)
    records = own.select(*(F.col(c) if c in own.columns else F.lit(None).cast(schema("index_records")[c].dataType).alias(c) for c in schema("index_records").fieldNames()))
    assert sorted(r.record_id for r in collection.upsert(records).collect()) == ["a", "b"]
    assert collection.count(backends.store_filter(filters={"flag": True, "n": 1})) == 1
    assert collection.count(backends.store_filter(filters={"flag": "TRUE"})) == 0  # exact, not loose
    assert collection.count(backends.store_filter(tenant_id=" t ", knowledge_base_ids=("k1", " "), document_id="")) == 1
    assert collection.count(backends.store_filter()) == 2
    asked = spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, query_vector array<float>")
    assert [r.record_id for r in collection.search(asked).orderBy("rank").collect()] == ["a", "b"]
    assert [r.record_id for r in backends.scroll(collection.read(), 1, after="a").collect()] == ["b"]
    assert collection.delete(backends.store_filter(knowledge_base_ids=("k1", "k9"))) == 1 and collection.count() == 1


def test_cached_postings_notice_changed_texts(spark, tmp_path):
    cache = backends.PostingsCache(TableStore(spark, f"file://{tmp_path}"), columns=bm25.Columns(chunk="id", text="t"))
    one = spark.createDataFrame([(1, "alpha beta")], "id long, t string")
    cache.terms(one)
    assert cache.terms(one).first()["_dl"] == 2 and (cache.hits, cache.misses) == (1, 1)
    assert cache.terms(one.withColumn("t", F.lit("alpha"))).first()["_dl"] == 1
    assert cache.statistics()["hit_rate"] == "33.3%" and cache.key(one.limit(0)) == "empty"


def test_health_answers_in_time(spark):
    began = time.perf_counter()
    got = {r.name: r.status for r in backends.health(spark, {"slow": lambda: time.sleep(3), "good": lambda: None}, 0.5).collect()}
    assert got == {"slow": "unhealthy: timed out", "good": "ok"} and time.perf_counter() - began < 30


def test_values_as_json(spark):
    row = spark.range(1).select(
        backends.json_value(F.lit('a"b')).alias("a"), backends.json_value(F.lit(None).cast("int")).alias("b"),
        backends.json_value(F.create_map(F.lit("k"), F.lit(None).cast("string"))).alias("c"), backends.json_value(F.lit(1.5)).alias("d"),
    ).first()
    assert tuple(row) == ('"a\\"b"', "null", '{"k":null}', "1.5")


def test_due_retries_do_not_wait_for_new_tasks(spark, tmp_path):
    """A task that becomes due while nothing arrives is run by the clock's next batch."""
    store = TableStore(spark, f"file://{tmp_path}/store")
    columns = schema("tasks").fieldNames()
    now = dt.datetime.now()
    value = {
        "task_id": "t", "status": "pending", "attempt_count": 0, "max_attempts": 3, "updated_at": now,
        "next_run_at": now + dt.timedelta(seconds=8),
    }
    spark.createDataFrame([tuple(value.get(c) for c in columns)], schema("tasks")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema("tasks")).parquet(str(tmp_path / "in"))
    query = start_runner(stream, store, str(tmp_path / "cp"), lambda c: succeed(c, F.current_timestamp()), interval="1 second")
    try:
        until = time.time() + 90
        while time.time() < until and store.read("tasks").filter("status = 'succeeded'").isEmpty():
            time.sleep(1)
        assert [r.status for r in store.read("tasks").collect()] == ["succeeded"] and query.isActive
    finally:
        query.stop()


def test_one_bad_rule_stops_no_other(spark):
    rows = spark.createDataFrame([("q", "hello world")], "query_id string, query string")
    rules = [
        {"intent_id": str(k), "priority": 1, "enabled": True, "route_expression": e, "knowledge_base_ids": ["kb"]}
        for k, e in enumerate(("/(?P<x>hel)lo/", "/hel+o/", "world", "/(/"))
    ]
    assert sorted(r.intent_id for r in planning.matching_intents(rows, rules).collect()) == ["1", "2"]


def test_broken_archives_are_rows(spark):
    files = spark.createDataFrame([("a", b"PK\x03\x04 broken"), ("b", None), ("c", b"")], "source_uri string, content binary")
    assert {r.error for r in parsers.parse_docx(files).collect()} == {"bad-archive"}
    errors = spark.range(1).select(parsers.error_struct(F.lit("timed-out"), "pdf").alias("e")).first().e
    assert (errors.code, errors.source, errors.retryable) == ("timed-out", "pdf", True)


def test_scopes_are_joined_without_texts(spark):
    kind = "record_id string, document_id string, chunk_id string, knowledge_base_id string, tenant_id string, org_id string, title string, content string, vector array<float>, metadata map<string,string>"
    records = spark.createDataFrame([(str(k), "d", "c", f"k{k % 2}", "t", "", "", f"word{k} shared", [], {}) for k in range(6)], kind)
    asked = spark.createDataFrame([("a", "shared", ["k0"]), ("b", "shared", []), ("c", "word1", ["k0"])], "query_id string, query string, knowledge_base_ids array<string>")
    members = scope_members(records, valid_queries(asked))
    assert members.columns == ["scope", "record_id"] and members.count() == 9
    got = {(r.query_id, r.record_id) for r in search(records, asked).collect()}
    assert got == {("a", k) for k in "024"} | {("b", k) for k in "012345"}
