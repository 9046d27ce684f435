"""The versioned table store: snapshots, conflicts, deletions without rewriting."""

from __future__ import annotations

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from quern.sources.versions import Conflict, Missing, VersionedTable

SCHEMA = StructType().add("k", LongType()).add("v", StringType())


@pytest.fixture()
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def content(table, number=None):
    return sorted(map(tuple, table.read(number).collect()), key=repr)


def size(tmp_path):
    return sum(p.stat().st_size for p in Path(tmp_path).rglob("*.parquet"))


def test_versions_are_snapshots(spark, table):
    assert content(table) == [] and table.version().number == 0
    table.append(rows(spark, (1, "a"), (2, "b")))
    table.upsert(rows(spark, (2, "B"), (3, "c"), (None, "n")), ["k"])
    table.delete(F.col("k") == 1)
    table.overwrite(table.read().withColumn("v", F.upper("v")))
    assert content(table, 1) == [(1, "a"), (2, "b")]
    assert content(table, 2) == sorted([(1, "a"), (2, "B"), (3, "c"), (None, "n")], key=repr)
    assert content(table, 3) == sorted([(2, "B"), (3, "c"), (None, "n")], key=repr)
    assert content(table) == sorted([(2, "B"), (3, "C"), (None, "N")], key=repr)
    with pytest.raises(Missing):
        table.read(9)


def test_nothing_to_delete_makes_no_version(spark, table):
    table.append(rows(spark, (1, "a")))
    assert table.delete(F.col("k") == 7).number == 1


def test_of_two_writers_one_wins_and_the_other_starts_again(spark, table):
    table.append(rows(spark, (1, "a")))
    base = table.version()
    first = table._commit(base, list(base.data), [])
    with pytest.raises(Conflict):
        table._commit(base, [], [])
    assert first.number == 2 and content(table) == [(1, "a")]
    threads = [threading.Thread(target=lambda k=k: table.upsert(rows(spark, (1, f"w{k}"), (10 + k, "new")), ["k"])) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    found = content(table)
    assert table.version().number == 6 and [k for k, _ in found] == [1, 10, 11, 12, 13]


def test_a_change_is_made_from_the_winners_version(spark, table):
    table.append(rows(spark, (1, "a")))
    calls = []

    def change(old):
        if not calls:
            table.append(rows(spark, (2, "b")))  # another writer comes first
        calls.append(1)
        return old.withColumn("v", F.concat("v", F.lit("!")))

    table.update(change)
    assert len(calls) == 2 and content(table) == [(1, "a!"), (2, "b!")]


def test_readers_go_on_while_a_table_is_replaced(spark, table):
    table.overwrite(spark.range(2000).select(F.col("id").alias("k"), F.lit("0").alias("v")))
    reader = table.read()
    reader.limit(1).collect()
    for n in range(3):
        table.overwrite(spark.range(2000).select(F.col("id").alias("k"), F.lit(str(n)).alias("v")))
    assert reader.select("v").distinct().collect()[0].v == "0" and reader.count() == 2000


def test_an_upsert_writes_only_its_rows(spark, table, tmp_path):
    table.append(spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")).coalesce(2))
    before = size(tmp_path)
    table.upsert(rows(spark, *((k, "x") for k in range(10))), ["k"])
    assert size(tmp_path) - before < before / 50
    assert table.read().count() == 200_000 and table.read().filter("v = 'x'").count() == 10


def test_compaction_and_vacuum(spark, table):
    for n in range(4):
        table.upsert(rows(spark, (1, str(n)), (n + 2, "x")), ["k"])
    want = content(table)
    made = table.compact()
    assert len(made.data) == 1 and made.deleted == () and content(table) == want
    assert table.vacuum(keep=1) > 0 and content(table) == want and table.versions() == [made.number]


def test_other_formats_write_anew(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/j", SCHEMA, "json")
    table.append(rows(spark, (1, "a"), (2, "b")))
    table.upsert(rows(spark, (2, "B")), ["k"])
    table.delete(F.col("k") == 1)
    assert content(table) == [(2, "B")]
