"""Kept stages and bitmap filters."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.operators import stages as operators_stages
from quern.operators.bitmaps import All, Any, BitmapIndex, Equals, all_of
from quern.operators.filters import exact_metadata_matches, metadata_matches
from quern.operators.stages import Stage, StageStore


def stages(broken=False, version="1"):
    def split(rows):
        return rows.select("_key", F.explode(F.filter(F.split("text", " "), lambda w: w != "")).alias("word"))

    def embed(rows):
        return rows.select("_key", F.length("word").alias("size"))

    def index(rows):
        return rows.select("_key", F.raise_error(F.lit("the store is down")).cast("int").alias("place") if broken else F.col("size").alias("place"))

    return [
        Stage("split", "1", ["text"], "word string", split), Stage("embed", version, ["word"], "size int", embed),
        Stage("index", "1", ["size"], "place int", index),
    ]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_a_run_resumes_at_the_stage_that_failed(spark, tmp_path):
    store = StageStore(spark, f"file://{tmp_path}/s")
    rows = docs(spark, "a bb", "bb ccc", "", None, "a bb")
    with pytest.raises(Exception, match="the store is down"):
        store.run_all(stages(broken=True), rows)
    found, worked = store.run_all(stages(), rows)
    assert worked == {"split": 0, "embed": 0, "index": 3}
    assert sorted((r.id, r.word, r.place) for r in found.collect()) == [(0, "a", 1), (0, "bb", 2), (1, "bb", 2), (1, "ccc", 3), (4, "a", 1), (4, "bb", 2)]
    assert store.run_all(stages(), docs(spark, "a bb", "dd a", "bb ccc"))[1] == {"split": 1, "embed": 1, "index": 0}
    assert store.run_all(stages(version="2"), rows)[1] == {"split": 0, "embed": 3, "index": 0}


def test_outputs_of_an_unmarked_try_are_replaced(spark, tmp_path):
    store, rows = StageStore(spark, f"file://{tmp_path}/s"), docs(spark, "a bb")
    stage = stages()[0]
    want = sorted(map(tuple, store.run(stage, rows)[0].collect()))
    _, done = store._tables(stage)
    done.overwrite(done.read().limit(0))  # stopped before the mark
    again, n = store.run(stage, rows)
    assert n == 1 and sorted(map(tuple, again.collect())) == want


def test_a_later_stage_reads_outputs_that_were_replaced(spark, tmp_path):
    store, rows = StageStore(spark, f"file://{tmp_path}/s"), docs(spark, "a bb", "ccc")
    store.run(stages()[0], rows)
    _, done = store._tables(stages()[0])
    done.overwrite(done.read().limit(0))  # stopped before the mark
    found, worked = store.run_all(stages(), rows)
    assert worked == {"split": 2, "embed": 3, "index": 3}
    assert sorted((r.id, r.word, r.place) for r in found.collect()) == [(0, "a", 1), (0, "bb", 2), (1, "ccc", 3)]


def test_rows_are_written_once_and_later_stages_read_kept_outputs(spark, tmp_path, monkeypatch):
    written, put = [], operators_stages.materialize
    monkeypatch.setattr(operators_stages, "materialize", lambda df, tag: written.append(df.columns) or put(df, tag))
    store = StageStore(spark, f"file://{tmp_path}/s")
    store.run_all(stages(), docs(spark, "gone and"))
    found, worked = store.run_all(stages(), docs(spark, "a bb", "bb ccc", "a bb"))
    assert worked == {"split": 2, "embed": 3, "index": 2}  # "gone" and "and" are kept, but not of these rows
    assert sorted(map(tuple, found.collect())) == [
        (0, "a bb", "a", 1, 1), (0, "a bb", "bb", 2, 2), (1, "bb ccc", "bb", 2, 2), (1, "bb ccc", "ccc", 3, 3), (2, "a bb", "a", 1, 1), (2, "a bb", "bb", 2, 2),
    ]
    assert sum("text" in c for c in written) == 2 and not any("word" in c for c in written)


def test_a_stage_may_read_rows_and_outputs(spark, tmp_path):
    def both(rows):
        return rows.select("_key", F.concat_ws("/", "text", "word").alias("both"))

    chain = [stages()[0], Stage("both", "1", ["text", "word"], "both string", both), Stage("again", "1", ["word", "both"], "n int", lambda r: r.select("_key", F.length("both").alias("n")))]
    found, worked = StageStore(spark, f"file://{tmp_path}/s").run_all(chain, docs(spark, "a bb", "bb"))
    assert worked == {"split": 2, "both": 3, "again": 3}
    assert sorted((r.id, r.both, r.n) for r in found.collect()) == [(0, "a bb/a", 6), (0, "a bb/bb", 7), (1, "bb/bb", 5)]


KIND = "record_id string, metadata map<string,string>, tenant string"


def records(spark):
    rows = [(f"r{k}", {"flag": ["true", "TRUE ", "false"][k % 3], "n": str(k % 5), "none": None}, f"t{k % 2}") for k in range(300)]
    return spark.createDataFrame([*rows, ("x", None, "t1"), ("y", {}, None), ("r1", {"flag": "true"}, "t0")], KIND).repartition(5)


def test_bitmaps_meet_what_the_scans_meet(spark, tmp_path):
    index = BitmapIndex.build(records(spark), f"file://{tmp_path}/b", columns=("tenant",))
    loose = {"flag": True, "n": 3}
    scan = records(spark).filter(metadata_matches(loose, F.col("metadata"), {}))
    ids = lambda df: sorted(r.record_id for r in df.collect())
    assert ids(index.records(all_of(loose))) == ids(scan) != [] and index.count(all_of(loose)) == scan.count()
    exact = {"flag": "true", "n": "3"}
    assert ids(index.records(all_of(exact, loose=False))) == ids(records(spark).filter(exact_metadata_matches(exact, F.col("metadata"))))
    either = Any(Equals("tenant", "T1"), All(Equals("n", "0"), Equals("flag", "false")))
    want = records(spark).filter("coalesce(tenant = 't1', false) OR (metadata['n'] = '0' AND metadata['flag'] = 'false')")
    assert ids(index.records(either)) == ids(want)
    assert index.count(Equals("none", "None")) == 0 == index.count(Equals("unknown", "1"))
    plan = index.records(either)._jdf.queryExecution().executedPlan().toString()
    assert "map<" not in plan and "metadata" not in plan.replace("_metadata", "")


def test_an_empty_table_meets_nothing(spark, tmp_path):
    index = BitmapIndex.build(records(spark).limit(0), f"file://{tmp_path}/e")
    assert index.count(Equals("flag", "true")) == 0 and index.records(Equals("flag", "true")).collect() == []
