"""Versioned tables as a data source."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, MapType, StringType, StructType

from quern.sources import table_source
from quern.sources.versions import VersionedTable

SCHEMA = (
    StructType().add("k", LongType()).add("v", StringType()).add("x", DoubleType())
    .add("tags", ArrayType(StringType())).add("m", MapType(StringType(), StringType()))
)


@pytest.fixture()
def table(spark, tmp_path):
    table_source.register(spark)
    return VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)


def numbers(spark, start, stop):
    i = F.col("id")
    return spark.range(start, stop, 1, 3).select(
        i.alias("k"), F.when(i % 7 != 0, F.concat(F.lit("v"), (i % 5).cast("string"))).alias("v"), (i / 3).alias("x"),
        F.array((i % 2).cast("string")).alias("tags"), F.when(i % 3 == 0, F.create_map(F.lit("a"), i.cast("string"))).alias("m"),
    )


def source(spark, table, schema=SCHEMA, **options):
    return spark.read.format(table_source.NAME).schema(schema).options(path=table.path, **options).load()


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_reads_what_the_table_reads(spark, table):
    assert content(source(spark, table)) == []
    table.append(numbers(spark, 0, 3000))
    table.upsert(numbers(spark, 2990, 3010).withColumn("v", F.lit("new")), ["k"])
    table.delete(F.col("k") % 4 == 1)
    for version in (None, 1, 2, 3):
        options = {} if version is None else {"version": version}
        assert content(source(spark, table, **options)) == content(table.read(version))
    small = source(spark, table, splitBytes=1000)
    assert small.rdd.getNumPartitions() > 5
    assert content(small) == content(table.read())
    narrow = source(spark, table, "k long, v string")
    assert content(narrow) == content(table.read().select("k", "v"))


@pytest.mark.parametrize(
    "condition",
    [
        "v = 'v2'", "v in ('v1', 'v3', null)", "v is null", "v is not null and k >= 2500", "k < 10", "k <= 10 and k > 3",
        "v like 'v%' and k = 77", "v <> 'v2'", "x > 10.0", "m['a'] = '9'", "v <=> null", "v = 'v2' or k = 1",
    ],
)
def test_filters(spark, table, condition):
    table.append(numbers(spark, 0, 3000))
    table.delete(F.col("k") % 4 == 1)
    assert content(source(spark, table).filter(condition)) == content(table.read().filter(condition))


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_reach_the_scan(spark, table):
    table.append(numbers(spark, 0, 100))
    text = plan(source(spark, table).filter("v = 'v2' and k in (2, 12, 22) and x > 1.0"))
    listed = next(line for line in text.splitlines() if "PushedFilters" in line)
    assert "EqualTo(v,v2)" in listed.replace(" ", "") and "In(k" in listed.replace(" ", "")
    assert "GreaterThan(x" not in listed  # fractions stay with Spark


def test_row_groups_without_matches_are_not_read(spark, table, tmp_path):
    table.append(numbers(spark, 0, 3000).repartitionByRange(3, "k"))
    reader = table_source.TableReader({"path": table.path}, SCHEMA)
    assert list(reader.pushFilters([table_source.EqualTo(("k",), 2999)])) == []
    files = [p for p, _ in table_source.TableFolder(table.path).data_files(table.version().data)]
    rows = [sum(b.num_rows for b in reader.batches(table_source.Splits(((f, 0, 1 << 30),)))) for f in files]
    assert sorted(rows) == [0, 0, 1]


def test_writes(spark, table):
    def write(df, mode):
        df.write.format(table_source.NAME).option("path", table.path).mode(mode).save()

    write(numbers(spark, 0, 50), "append")
    write(numbers(spark, 50, 60), "append")
    assert content(table.read()) == content(numbers(spark, 0, 60))
    table.delete(F.col("k") == 55)
    assert content(source(spark, table)) == content(numbers(spark, 0, 60).filter("k <> 55"))
    write(numbers(spark, 0, 5), "overwrite")
    assert content(table.read()) == content(numbers(spark, 0, 5))
    assert content(table.read(2)) == content(numbers(spark, 0, 60))
    write(numbers(spark, 0, 5).filter("k < 0"), "append")
    assert table.version().number == 5 and content(table.read()) == content(numbers(spark, 0, 5))
    write(numbers(spark, 0, 5).filter("k < 0"), "overwrite")
    assert content(table.read()) == []


def test_an_aborted_write_leaves_nothing(spark, table, tmp_path):
    table.append(numbers(spark, 0, 10))
    before = sorted(p for p in Path(tmp_path).rglob("*"))
    bad = numbers(spark, 0, 3000).withColumn("x", F.when(F.col("k") == 2500, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="stop"):
        bad.write.format(table_source.NAME).option("path", table.path).mode("append").save()
    assert sorted(p for p in Path(tmp_path).rglob("*")) == before
    assert content(table.read()) == content(numbers(spark, 0, 10))


def test_the_second_writer_goes_on_from_the_first(spark, table, monkeypatch):
    table.append(numbers(spark, 0, 10))
    writer = table_source.TableWriter({"path": table.path}, SCHEMA, False)
    rows = numbers(spark, 10, 20).toArrow()
    message = writer.write(iter(rows.to_batches()))
    put, tried = table_source.TableFolder.put_if_absent, []

    def late(self, number, manifest):
        tried.append(number)
        if len(tried) == 1:
            table.append(numbers(spark, 20, 30))  # another writer is first
        return put(self, number, manifest)

    monkeypatch.setattr(table_source.TableFolder, "put_if_absent", late)
    writer.commit([message, None])
    assert tried == [2, 3]
    assert content(table.read()) == content(numbers(spark, 0, 30))


def test_files_of_attempts_that_do_not_count_are_not_read(spark, table):
    writer = table_source.TableWriter({"path": table.path}, SCHEMA, False)
    batches = numbers(spark, 0, 10).toArrow().to_batches()
    writer.write(iter(batches))
    writer.commit([writer.write(iter(batches))])
    assert content(table.read()) == content(source(spark, table)) == content(numbers(spark, 0, 10))


def test_a_stream_reads_what_each_version_adds(spark, table, tmp_path):
    seen = []

    def run():
        stream = (
            spark.readStream.format(table_source.NAME).schema("k long, v string").option("path", table.path).load()
            .writeStream.foreachBatch(lambda df, n: seen.extend(r.k for r in df.collect()))
            .option("checkpointLocation", f"file://{tmp_path}/state").trigger(once=True).start()
        )
        assert stream.awaitTermination(120)
        found, seen[:] = sorted(seen), []
        return found

    table.append(numbers(spark, 0, 5))
    table.append(numbers(spark, 5, 8))
    assert run() == list(range(8))
    table.upsert(numbers(spark, 7, 10), ["k"])
    table.delete(F.col("k") == 1)
    table.compact()
    table.append(numbers(spark, 20, 22))
    assert run() == [7, 8, 9, 20, 21]  # after a restart; the compaction adds nothing
    assert run() == []


def test_a_path_and_a_schema_are_asked_for(spark, table):
    with pytest.raises(Exception, match="path"):
        spark.read.format(table_source.NAME).schema(SCHEMA).load().collect()
    with pytest.raises(Exception, match="give a schema"):
        spark.read.format(table_source.NAME).option("path", table.path).load()
    with pytest.raises(ValueError, match="not to"):
        table_source.TableWriter({"path": "mock:///x"}, SCHEMA, False)
