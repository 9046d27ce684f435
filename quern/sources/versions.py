"""Tables of immutable files with a chain of manifests.

Every change writes new files beside the old ones and then one manifest, numbered by the
version it makes, that names all folders of that version. A manifest is put in place only if
there is none of its number: of two writers that started from the same version one wins, and
the other starts again from the winner's. A reader takes the latest manifest (or an earlier
one) and reads exactly its files, which nothing changes or replaces, so it never fails while
a table is written.

Rows are replaced without rewriting the files they lie in: a change notes their places (file
and row number) in a folder of deletions, and readers leave these out. ``compact`` writes a
table anew without them, and ``vacuum`` deletes what no recent version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_DELETED = "_file string, _row long"


class Conflict(Exception):
    """Another writer has made the version that this one wanted to make."""


class Missing(Exception):
    """The table has no such version."""


@dataclass(frozen=True)
class Version:
    number: int
    data: tuple[str, ...] = ()
    deleted: tuple[str, ...] = ()
    compacted: bool = False


class VersionedTable:
    """A table in the folder ``path``; one without a manifest is empty (version 0).

    Deletions need Parquet; with other formats, changes of single rows write the table anew.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, file_format: str = "parquet", *, attempts: int = 10):
        self.spark, self.path, self.schema, self.format, self.attempts = spark, path.rstrip("/"), schema, file_format, attempts
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.path).getFileSystem(self._conf)

    # manifests

    def _manifest(self, number: int) -> str:
        return f"{self.path}/_log/{number:020d}.json"

    def versions(self) -> list[int]:
        log = self._path(f"{self.path}/_log")
        if not self._files.exists(log):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        if number is None:
            number = (self.versions() or [0])[-1]
        if number == 0:
            return Version(0)
        path = self._path(self._manifest(number))
        if not self._files.exists(path):
            raise Missing(f"{self.path} has no version {number}")
        stream = self._files.open(path)
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(number, tuple(found["data"]), tuple(found["deleted"]), found.get("compacted", False))

    def _commit(self, base: Version, data: list[str], deleted: list[str], compacted: bool = False) -> Version:
        """Make the version after ``base``, or raise ``Conflict`` if it is there."""
        number = base.number + 1
        target, draft = self._path(self._manifest(number)), self._path(f"{self.path}/_log/.{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(json.dumps({"version": number, "data": data, "deleted": deleted, "compacted": compacted}).encode())
        stream.close()
        try:
            self._put_if_absent(draft, target)
        finally:
            self._files.delete(draft, False)
        return Version(number, tuple(data), tuple(deleted), compacted)

    def _put_if_absent(self, draft, target) -> None:
        """A new name for the draft, which must not be taken: a hard link on a local disk,
        elsewhere a rename that does not overwrite."""
        jvm = self.spark._jvm
        if self._files.exists(target):
            raise Conflict(target.toString())
        try:
            if self._files.getScheme() == "file":
                at = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(at(target), at(draft))
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(draft, target, none)
        except Exception as problem:
            if "FileAlreadyExists" in str(problem):
                raise Conflict(target.toString()) from None
            raise

    def _retried(self, change: Callable[[Version], tuple[list[str], list[str]] | None], compacted: bool = False) -> Version:
        """Commit what ``change`` makes of the latest version; after a conflict, of the newer
        one. ``None`` changes nothing. ``compacted``: the rows stay the same."""
        for _ in range(self.attempts):
            base = self.version()
            made = change(base)
            if made is None:
                return base
            try:
                return self._commit(base, *made, compacted)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {self.attempts} other writers came first")

    # rows

    def _write(self, rows: DataFrame, kind: str, file_format: str | None = None) -> str:
        folder = f"{kind}-{uuid.uuid4().hex}"
        rows.write.format(file_format or self.format).save(f"{self.path}/{folder}")
        return folder

    def _placed(self, version: Version) -> DataFrame:
        """All rows, also deleted ones, with their places."""
        found = self.spark.read.format(self.format).schema(self.schema).load([f"{self.path}/{d}" for d in version.data])
        return found.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def _present(self, version: Version) -> DataFrame:
        placed = self._placed(version)
        if not version.deleted:
            return placed
        gone = self.spark.read.schema(_DELETED).parquet(*(f"{self.path}/{d}" for d in version.deleted))
        return placed.join(gone, ["_file", "_row"], "left_anti")

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default."""
        version = self.version(number)
        if not version.data:
            return self.spark.createDataFrame([], self.schema)
        if not version.deleted:
            return self.spark.read.format(self.format).schema(self.schema).load([f"{self.path}/{d}" for d in version.data])
        return self._present(version).select(*self.schema.fieldNames())

    def placed(self, number: int | None = None) -> DataFrame:
        """The rows of a version with their places, ``_file`` and ``_row``."""
        version = self.version(number)
        if not version.data:
            return self.spark.createDataFrame([], StructType(self.schema.fields + StructType.fromDDL(_DELETED).fields))
        return self._present(version)

    def append(self, rows: DataFrame) -> Version:
        folder = self._write(rows.select(*self.schema.fieldNames()), "data")
        return self._retried(lambda base: ([*base.data, folder], list(base.deleted)))

    def overwrite(self, rows: DataFrame) -> Version:
        """Replace all rows; ``rows`` may be computed from the table itself."""
        folder = self._write(rows.select(*self.schema.fieldNames()), "data")
        return self._retried(lambda base: ([folder], []))

    def update(self, change: Callable[[DataFrame], DataFrame], *, compacted: bool = False) -> Version:
        """Replace all rows by what ``change`` makes of them; after a conflict, of the winner's."""

        def made(base: Version):
            return [self._write(change(self.read(base.number)).select(*self.schema.fieldNames()), "data")], []

        return self._retried(made, compacted)

    def _without(self, base: Version, found: Callable[[DataFrame], DataFrame]) -> str | None:
        """A folder with the places of the rows that ``found`` picks, or None if there are none."""
        if not base.data:
            return None
        places = self._write(found(self._present(base)).select("_file", "_row"), "deleted", "parquet")
        return None if self.spark.read.parquet(f"{self.path}/{places}").isEmpty() else places

    def upsert(self, rows: DataFrame, keys: list[str]) -> Version:
        """Put rows in the place of those with their keys, and add the others. Writes the new
        rows and the places of the old ones, and nothing else. Rows with a null key are only
        added; rows of one key within ``rows`` are all kept."""
        rows = rows.select(*self.schema.fieldNames())
        if self.format != "parquet":
            return self.update(lambda old: old.join(rows.select(*keys), keys, "left_anti").unionByName(rows))
        folder = self._write(rows, "data")
        fresh = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").select(*keys)

        def made(base: Version):
            places = self._without(base, lambda old: old.join(fresh, keys, "left_semi"))
            return [*base.data, folder], [*base.deleted, *([places] if places else [])]

        return self._retried(made)

    def delete(self, condition: Column) -> Version:
        """Leave out the rows that meet the condition (null does not)."""
        if self.format != "parquet":
            return self.update(lambda old: old.filter(~F.coalesce(condition, F.lit(False))))

        def made(base: Version):
            places = self._without(base, lambda old: old.filter(condition))
            return None if places is None else (list(base.data), [*base.deleted, places])

        return self._retried(made)

    # care

    def compact(self) -> Version:
        """Write the latest version anew, as one folder without deletions. If another writer
        comes first, nothing is lost: the work is done again from its version."""
        return self.update(lambda rows: rows, compacted=True)

    def vacuum(self, keep: int = 10) -> int:
        """Delete the folders that none of the last ``keep`` versions names, and the older
        manifests; readers of older versions fail from then on. How many folders went. Call it
        when no write is under way: files that are not yet committed are named nowhere."""
        numbers = self.versions()
        named = {f for n in numbers[-keep:] for v in [self.version(n)] for f in (*v.data, *v.deleted)}
        for n in numbers[:-keep]:
            self._files.delete(self._path(self._manifest(n)), False)
        gone = 0
        for status in self._files.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name.startswith(("data-", "deleted-")) and name not in named:
                gone += bool(self._files.delete(status.getPath(), True))
        return gone
