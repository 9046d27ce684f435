"""Metadata filters by bitmaps of record numbers.

When records are indexed each gets a number, and every key and value of their metadata (and of
the columns that filters may name) a set of bits per 32,768 numbers. A filter is then a few
bitmaps combined by OR and AND; how many records it meets is the number of bits, and which
ones, a look at one bit of the records in the buckets that are left. No map is read, and a
filter's cost follows the buckets its values occur in.

Equality is that of the scans in ``filters``: loose (trimmed, whatever the case) or exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Equals:
    """A key has a value; ``loose``: as trimmed text, whatever the case."""

    key: str
    value: str
    loose: bool = True


@dataclass(frozen=True)
class All:
    """Every part holds."""

    parts: tuple

    def __init__(self, *parts):
        object.__setattr__(self, "parts", parts)


@dataclass(frozen=True)
class Any:
    """At least one part holds."""

    parts: tuple

    def __init__(self, *parts):
        object.__setattr__(self, "parts", parts)


Condition = Equals | All | Any


def all_of(filters: Mapping[str, object], *, loose: bool = True) -> All:
    """The condition of a mapping: every key has its value; truth values are ``true``, ``false``."""
    shown = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    return All(*(Equals(k, shown(v), loose) for k, v in filters.items()))


def _plain(value: Column) -> Column:
    return F.lower(F.trim(value))


class BitmapIndex:
    """Bitmaps and record numbers in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(
        cls, records: DataFrame, path: str, *, record: str = "record_id", metadata: str | None = "metadata", columns: Sequence[str] = ()
    ) -> BitmapIndex:
        """Index the map ``metadata`` and the given columns, under their names as keys.

        Null values are not indexed, so no filter meets them; repeated ids are records of their
        own; an empty table gives an index that meets nothing. The rows are written with their
        numbers first, so that every later reading has the same ones.
        """
        path = path.rstrip("/")
        pairs = [F.map_entries(F.coalesce(metadata, F.create_map().cast("map<string,string>")))] if metadata else []
        pairs.append(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns)).cast("array<struct<key:string,value:string>>"))
        rows = records.select(F.monotonically_increasing_id().alias("number"), F.col(record).alias("record"), F.concat(*pairs).alias("pairs"))
        rows.write.parquet(f"{path}/rows")
        kept = records.sparkSession.read.parquet(f"{path}/rows")
        numbered = kept.select("record", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").cast("int").alias("place"))
        # buckets lie together, so a search skips the row groups of those that it has excluded
        numbered.repartitionByRange("bucket").sortWithinPartitions("bucket").write.parquet(f"{path}/numbers")
        entries = kept.select("number", F.inline("pairs")).filter("value IS NOT NULL")
        bits = entries.groupBy("key", "value", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
        bits.withColumn("plain", _plain(F.col("value"))).sortWithinPartitions("key", "plain").write.parquet(f"{path}/bits")
        return cls(records.sparkSession, path)

    def _leaf(self, test: Equals) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/bits").filter(F.col("key") == test.key)
        # the literal is trimmed and lowered by the same functions as the values
        same = F.col("plain") == _plain(F.lit(test.value)) if test.loose else F.col("value") == test.value
        return rows.filter(same).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def bits(self, condition: Condition) -> DataFrame:
        """``bucket, bits`` of the records that meet the condition."""
        if isinstance(condition, Equals):
            return self._leaf(condition)
        if not condition.parts:
            raise ValueError("a condition needs at least one part")
        parts = [self.bits(p) for p in condition.parts]
        every = reduce(DataFrame.unionByName, parts).groupBy("bucket")
        if isinstance(condition, Any):
            return every.agg(F.bitmap_or_agg("bits").alias("bits"))
        # a part has one row per bucket, and a bucket that a part lacks has no record that meets all
        both = every.agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("_n"))
        return both.filter(F.col("_n") == len(parts)).drop("_n")

    def count(self, condition: Condition) -> int:
        return self.bits(condition).agg(F.sum(F.bitmap_count("bits"))).first()[0] or 0

    def records(self, condition: Condition, name: str = "record_id") -> DataFrame:
        """The ids of the records that meet the condition."""
        numbers = self.spark.read.parquet(f"{self.path}/numbers")
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = numbers.join(self.bits(condition), "bucket").filter(F.expr("1") == F.getbit(byte, F.col("place") % 8))
        return found.select(F.col("record").alias(name))
