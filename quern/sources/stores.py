"""Stores of domain tables: versioned Parquet as the canonical form, JSON lines for exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.schemas import schema
from quern.sources.versions import VersionedTable


class TableStore:
    """Versioned tables in one folder, with their explicit schemas; a missing table reads as
    empty. See ``versions.VersionedTable`` for what readers and concurrent writers can rely on.

    A table that an earlier release wrote as plain files is read as it is, and takes on
    versions with its first change.
    """

    def __init__(self, spark: SparkSession, root: str, file_format: str = "parquet"):
        if file_format not in ("parquet", "json", "orc"):
            raise ValueError(f"unknown format {file_format}")
        self.spark, self.root, self.format = spark, root.rstrip("/"), file_format

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, self.path(name), schema(name), self.format)

    def _plain(self, name: str):
        """The file system and the paths of a plain table, its successor and its predecessor."""
        jvm = self.spark._jvm
        paths = [jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}{end}") for end in ("", "__new", "__old")]
        return paths[0].getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), *paths

    def exists(self, name: str) -> bool:
        """Whether there is a table; a plain one whose replacement was cut short is put back
        first: the successor if it is complete, else the predecessor."""
        system, now, new, old = self._plain(name)
        if system.exists(now):
            return True
        done = self.spark._jvm.org.apache.hadoop.fs.Path(new, "_SUCCESS")
        for left in ([new] if system.exists(done) else []) + ([old] if system.exists(old) else []):
            if system.rename(left, now):
                return True
        return False

    def read(self, name: str, version: int | None = None) -> DataFrame:
        table = self.table(name)
        if self.exists(name) and not table.versions():
            return self.spark.read.format(self.format).schema(schema(name)).load(self.path(name))
        return table.read(version)

    def _versioned(self, name: str) -> VersionedTable:
        """The table, with a first version of its plain files if it has any."""
        table = self.table(name)
        if self.exists(name) and not table.versions():
            table.overwrite(self.read(name))
        system, _, new, old = self._plain(name)
        for left in (new, old):
            system.delete(left, True)
        return table

    def append(self, name: str, rows: DataFrame) -> None:
        self._versioned(name).append(rows)

    def overwrite(self, name: str, rows: DataFrame) -> None:
        """Replace a table, also by rows that are computed from it."""
        self._versioned(name).overwrite(rows)

    def upsert(self, name: str, rows: DataFrame, *keys: str) -> None:
        """Replace the rows of the same keys and add the others; only these are written."""
        self._versioned(name).upsert(rows, list(keys))

    def delete(self, name: str, condition: Column) -> None:
        self._versioned(name).delete(condition)

    def overwrite_partitions(self, name: str, rows: DataFrame, by: list[str]) -> None:
        """Replace only the rows that share the values of ``by`` with one of ``rows``."""
        self._versioned(name).upsert(rows, by)

    def bootstrap(self, name: str, json_path: str, key: str) -> bool:
        """Fill an empty table from JSON lines whose key is not blank; whether it did."""
        if not self.read(name).isEmpty():
            return False
        rows = self.spark.read.schema(schema(name)).json(json_path).filter(F.trim(key) != "")
        self.overwrite(name, rows)
        return True


def project_task(tasks: DataFrame) -> DataFrame:
    """The promoted columns of a task beside its JSON; missing attempts default to 3."""
    most = F.when(F.coalesce("max_attempts", F.lit(0)) <= 0, F.lit(3)).otherwise(F.col("max_attempts"))
    used = F.coalesce("attempt_count", F.lit(0))
    promoted = [c for c in tasks.columns if c not in ("source", "plan", "trace", "max_attempts", "attempt_count")]
    return tasks.select(
        *promoted,
        used.alias("attempt_count"),
        most.alias("max_attempts"),
        F.greatest(most - used, F.lit(0)).alias("attempts_remaining"),
        F.to_json(F.struct(*tasks.columns)).alias("task_json"),
    )


def ndjson(events: DataFrame) -> DataFrame:
    """Rows as JSON lines (a column ``value``), as a text sink takes them."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def stream_pieces(text_column: str = "text", size: int = 48):
    """A text in pieces of at most ``size`` characters of a line (line ends are left out)."""
    return F.regexp_extract_all(F.col(text_column), F.lit(f"(.{{1,{size}}})"), F.lit(1))
