"""Stages whose outputs are kept, so that a rerun does only what is new.

What a stage makes of a row depends on the row's inputs and on the stage's version. Their
digest is the key under which the outputs are stored, in a versioned table per stage. A run
looks up the keys of its rows, lets the stage work on the missing ones (equal inputs once),
stores what it made, and joins the outputs to the rows. A run that stops, whatever the reason,
leaves the stages before it done: the next one takes them from the store. Raising a stage's
version makes it work anew, and so do the later stages whose inputs change with it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quern.session import materialize
from quern.sources.versions import VersionedTable

KEY = "_key"


@dataclass(frozen=True)
class Stage:
    """``make`` gets the distinct missing inputs with their key, and returns rows with that key
    and the columns ``outputs`` (a DDL schema): one, several or none for each key."""

    name: str
    version: str
    inputs: Sequence[str]
    outputs: str
    make: Callable[[DataFrame], DataFrame]


class StageStore:
    """The kept outputs, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _tables(self, stage: Stage) -> tuple[VersionedTable, VersionedTable]:
        key = StructType().add(KEY, StringType())
        made = StructType(key.fields + StructType.fromDDL(stage.outputs).fields)
        return (
            VersionedTable(self.spark, f"{self.root}/{stage.name}/made", made),
            VersionedTable(self.spark, f"{self.root}/{stage.name}/done", key),
        )

    def run(self, stage: Stage, rows: DataFrame) -> tuple[DataFrame, int]:
        """``rows`` with the outputs beside them (rows without any go), and the number of
        inputs that the stage had to work on.

        Null inputs are inputs like any other. Outputs are written before the mark that they
        are done, and replace those of an earlier, unmarked try. Columns of ``rows`` must not
        have the outputs' names.
        """
        found, worked = self.run_all([stage], rows)
        return found, worked[stage.name]

    def run_all(self, stages: Sequence[Stage], rows: DataFrame) -> tuple[DataFrame, dict[str, int]]:
        """All stages, each on what the one before it returned.

        ``rows`` are written once, with the keys of the first stage. A later stage whose inputs
        are outputs of the one before it takes them from that one's kept outputs, where each
        lies once; only keys of rows travel to find out which are meant. What is returned joins
        all of it by the keys when it is read.
        """
        if not stages:
            return rows, {}
        columns, worked = list(rows.columns), {}
        for k, stage in enumerate(stages):
            made, done = self._tables(stage)
            key = f"{KEY}_{k}"
            if k == 0:
                rows = materialize(rows.withColumn(key, _digest(stage)), stage.name)
                inputs = keys = _placed(_with_rows(rows))
            elif set(stage.inputs) <= set(outputs.columns):
                rows = rows.join(outputs.withColumn(key, _digest(stage)), before)
                inputs = _placed(kept.withColumnRenamed(KEY, before)).withColumn(key, _digest(stage))
                # not a semi-join, which Spark would put below the digest: the inputs would travel then
                keys = inputs.join(used, before)
            else:
                rows = rows.join(outputs, before).withColumn(key, _digest(stage))
                inputs = keys = _placed(_with_rows(materialize(rows.select(key, *stage.inputs), stage.name)))
            worked[stage.name] = self._work(stage, made, done, keys.select(F.col(key).alias(KEY), _PLACE), inputs.withColumnRenamed(key, KEY))
            kept, before, used = made.placed(), key, rows.select(key).distinct()
            outputs = kept.drop("_file", "_row").withColumnRenamed(KEY, key)
            columns += [c for c in outputs.columns if c != key]
        return rows.join(outputs, before).select(*columns), worked

    def _work(self, stage: Stage, made: VersionedTable, done: VersionedTable, keys: DataFrame, inputs: DataFrame) -> int:
        """Make and keep what is missing for ``keys``, and how many keys that were. ``inputs``
        has the inputs at the places that go with the keys."""
        marked = done.read().withColumn("_done", F.lit(True))
        one = keys.groupBy(KEY).agg(F.min(_PLACE).alias(_PLACE))
        # an outer join, for an anti-join would be put below the digest too
        new = materialize(one.join(marked, KEY, "left").filter("_done is null").select(KEY, _PLACE), f"{stage.name}-new")
        n = new.count()
        if n:
            made.upsert(stage.make(_at(inputs, new).select(KEY, *stage.inputs)), [KEY])
            done.append(new)
        return n


_PLACE, _ROWS_BITS = "_place", 40
#: A bitmap has a bit for each of so many places.
_BITMAP_BITS = 15


def _with_rows(kept: DataFrame) -> DataFrame:
    return kept.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def _placed(kept: DataFrame) -> DataFrame:
    """The rows with their place as one number, of the file's number and the row's number in it."""
    names = sorted(path.rsplit("/", 1)[-1] for path in kept.inputFiles())
    numbers = kept.sparkSession.createDataFrame(list(enumerate(names)), "_number long, _file string")
    place = F.shiftleft("_number", _ROWS_BITS) + F.col("_row")
    return kept.join(F.broadcast(numbers), "_file").withColumn(_PLACE, place).drop("_file", "_row", "_number")


def _at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The rows at the places. These go as bitmaps, a bit for each row, so that the rows need
    not travel unless their number is so large that Spark does not broadcast the bitmaps."""
    bucket, bit = F.shiftright(_PLACE, _BITMAP_BITS), F.col(_PLACE).bitwiseAND((1 << _BITMAP_BITS) - 1)
    maps = materialize(places.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_bits")), "places")
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = F.expr(f"shiftright(_byte, cast({_PLACE} & 7 as int)) & 1 = 1")
    return rows.withColumn("_bucket", bucket).join(maps, "_bucket").withColumn("_byte", byte).filter(set_).drop("_bucket", "_bits", "_byte", _PLACE)


def _digest(stage: Stage) -> Column:
    inputs = F.to_json(F.struct(*stage.inputs), {"ignoreNullFields": "false"})
    return F.sha2(F.concat_ws("\n", F.lit(stage.name), F.lit(stage.version), inputs), 256)
