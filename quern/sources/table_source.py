"""Versioned tables as a data source: ``spark.read.format("quern_table")``.

Batch reads take a snapshot and leave out deleted rows; filters on columns of text, whole
numbers and truth values are pushed into the scan, where the statistics of row groups skip
what cannot match. Batch writes put one manifest in place when all tasks are done, and a
write that fails leaves no file. A stream reads the rows that each version added.

Options: ``path`` (the table's folder), ``table`` (the name of a domain table, whose schema it
has; otherwise give ``.schema(...)``, also to read fewer columns), ``version`` (a snapshot, the
latest by default), ``splitBytes`` (file bytes per task, 128 MB by default) and, for a stream,
``startingVersion`` (versions after this one, 0 by default). A batch of a stream takes all the
versions there are: Spark does not tell Python readers where a batch begins when it asks where
it shall end. Tables are Parquet. Reads work on every file system that Arrow knows,
writes on local disks and HDFS, whose renames do not overwrite.

Pushing filters needs ``spark.sql.python.filterPushdown.enabled``, which ``register`` sets.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
    In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from quern.schemas import DDL
from quern.session import ship_package

NAME = "quern_table"
SPLIT_BYTES = 128 << 20
ATTEMPTS = 10
#: Columns whose comparisons Arrow and Spark agree on (fractions differ in NaN).
_PUSHED = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TableSource)


@dataclass(frozen=True)
class Manifest:
    number: int
    data: tuple[str, ...] = ()
    deleted: tuple[str, ...] = ()
    compacted: bool = False


class TableFolder:
    """The files of a versioned table, without a Spark session."""

    def __init__(self, path: str):
        uri = path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = f"file://{uri[5:]}"
        self.files, self.root = pafs.FileSystem.from_uri(uri)
        self.root = self.root.rstrip("/")

    def at(self, *names: str) -> str:
        return posixpath.join(self.root, *names)

    def listed(self, *names: str) -> list[pafs.FileInfo]:
        found = self.files.get_file_info(pafs.FileSelector(self.at(*names), allow_not_found=True))
        return sorted((f for f in found if f.type == pafs.FileType.File), key=lambda f: f.base_name)

    def newest(self) -> int:
        names = [f.base_name for f in self.listed("_log")]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, number: int) -> Manifest:
        if number == 0:
            return Manifest(0)
        with self.files.open_input_stream(self.at("_log", f"{number:020d}.json")) as stream:
            found = json.loads(stream.read())
        return Manifest(number, tuple(found["data"]), tuple(found["deleted"]), found.get("compacted", False))

    def data_files(self, folders: Iterable[str]) -> list[tuple[str, int]]:
        """Paths and sizes of the Parquet files that are visible."""
        infos = [f for folder in folders for f in self.listed(folder)]
        return [(f.path, f.size) for f in infos if not f.base_name.startswith((".", "_")) and f.size]

    def put_if_absent(self, number: int, manifest: dict) -> bool:
        """Whether the manifest is now that of its number; False if another one is."""
        self.files.create_dir(self.at("_log"))
        draft, target = self.at("_log", f".{uuid.uuid4().hex}"), self.at("_log", f"{number:020d}.json")
        with self.files.open_output_stream(draft) as stream:
            stream.write(json.dumps(manifest).encode())
        try:
            if self.files.type_name == "local":
                os.link(draft, target)
            else:
                self.files.move(draft, target)  # HDFS renames to no name that is taken
            return True
        except OSError:
            if self.files.get_file_info(target).type == pafs.FileType.NotFound:
                raise
            return False
        finally:
            if self.files.get_file_info(draft).type != pafs.FileType.NotFound:
                self.files.delete_file(draft)


@dataclass
class Splits(InputPartition):
    """Byte ranges of files, (path, start, stop), and the folders of deletions."""

    ranges: tuple[tuple[str, int, int], ...]
    deleted: tuple[str, ...] = ()


def _splits(files: list[tuple[str, int]], deleted: tuple[str, ...], size: int) -> list[Splits]:
    """Files cut into ranges of ``size`` bytes, and small ranges put together."""
    made: list[Splits] = []
    held: list[tuple[str, int, int]] = []
    total = 0
    for path, length in files:
        for start in range(0, length, size):
            stop = min(start + size, length)
            if held and total + stop - start > size:
                made.append(Splits(tuple(held), deleted))
                held, total = [], 0
            held.append((path, start, stop))
            total += stop - start
    return [*made, Splits(tuple(held), deleted)] if held else made


def _expression(wanted: Filter, schema: T.StructType) -> pc.Expression | None:
    """The filter as Arrow evaluates it, or None where the two could differ."""
    path = getattr(wanted, "attribute", ())
    if len(path) != 1 or path[0] not in schema.fieldNames():
        return None
    kind = schema[path[0]].dataType
    column = pc.field(path[0])
    if isinstance(wanted, IsNull):
        return column.is_null()
    if isinstance(wanted, IsNotNull):
        return column.is_valid()
    if not isinstance(kind, _PUSHED) or (isinstance(kind, T.StringType) and kind != T.StringType()):
        return None
    arrow = to_arrow_schema(T.StructType([T.StructField("x", kind)])).field(0).type
    if isinstance(wanted, In):
        return column.isin(pa.array([v for v in wanted.value if v is not None], arrow))
    value = getattr(wanted, "value", None)
    if value is None:
        return None
    if isinstance(wanted, StringStartsWith):
        return pc.starts_with(column, value)
    value = pa.scalar(value, arrow)
    for kind_of, test in (
        (EqualTo, lambda: column == value), (GreaterThan, lambda: column > value), (GreaterThanOrEqual, lambda: column >= value),
        (LessThan, lambda: column < value), (LessThanOrEqual, lambda: column <= value),
    ):
        if isinstance(wanted, kind_of):
            return test()
    return None


class _Scan:
    """What batch and stream readers share: reading splits into Arrow batches."""

    folder_path: str
    fields: T.StructType
    filters: tuple[Filter, ...] = ()

    def _gone(self, files: pafs.FileSystem, folders: tuple[str, ...], names: set[str]) -> dict[str, np.ndarray]:
        """Numbers of the deleted rows of some files."""
        here = TableFolder(self.folder_path)
        paths = [p for p, _ in here.data_files(folders)]
        if not paths:
            return {}
        rows = ds.dataset(paths, filesystem=files, format="parquet").to_table(filter=pc.field("_file").isin(sorted(names)))
        of, at = rows["_file"].to_numpy(zero_copy_only=False), rows["_row"].to_numpy()
        return {n: at[of == n] for n in names}

    def batches(self, part: Splits) -> Iterator[pa.RecordBatch]:
        files = TableFolder(self.folder_path).files
        target = to_arrow_schema(self.fields)
        names = self.fields.fieldNames()
        condition = None
        for test in (_expression(f, self.fields) for f in self.filters):
            condition = test if condition is None else condition & test
        gone = self._gone(files, part.deleted, {posixpath.basename(p) for p, _, _ in part.ranges}) if part.deleted else {}
        for path, start, stop in part.ranges:
            with files.open_input_file(path) as stream:
                held = pq.ParquetFile(stream)
                first, groups = 0, []
                for g in range(held.metadata.num_row_groups):
                    about = held.metadata.row_group(g)
                    chunk = about.column(0)
                    begin = chunk.data_page_offset
                    if chunk.has_dictionary_page:
                        begin = min(begin, chunk.dictionary_page_offset)
                    if start <= begin < stop:  # every group begins in one range
                        groups.append((g, first))
                    first += about.num_rows
                if condition is not None and groups:
                    fragment = ds.ParquetFileFormat().make_fragment(path, files)
                    likely = {r.id for r in fragment.subset(condition, schema=held.schema_arrow).row_groups}
                    groups = [(g, at) for g, at in groups if g in likely]
                out = gone.get(posixpath.basename(path), ())
                for g, at in groups:
                    for batch in held.iter_batches(row_groups=[g], columns=names):
                        keep = ~np.isin(np.arange(at, at + batch.num_rows), out) if len(out) else None
                        at += batch.num_rows
                        rows = pa.Table.from_batches([batch])
                        rows = rows if keep is None else rows.filter(pa.array(keep))
                        rows = rows if condition is None else rows.filter(condition)
                        if rows.num_rows:
                            yield from rows.select(names).cast(target).to_batches()


class TableReader(_Scan, DataSourceReader):
    def __init__(self, options: dict[str, str], fields: T.StructType):
        self.folder_path, self.fields = options["path"], fields
        self.size = int(options.get("splitBytes", SPLIT_BYTES))
        folder = TableFolder(self.folder_path)
        # the snapshot is chosen once, when the plan is made
        self.number = int(options["version"]) if "version" in options else folder.newest()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        taken = []
        for wanted in filters:
            if _expression(wanted, self.fields) is None:
                yield wanted
            else:
                taken.append(wanted)
        self.filters = tuple(taken)

    def partitions(self) -> list[Splits]:
        folder = TableFolder(self.folder_path)
        manifest = folder.manifest(self.number)
        # a table without files has one empty part, as Spark asks for one at least
        return _splits(folder.data_files(manifest.data), manifest.deleted, self.size) or [Splits(())]

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class TableStreamReader(_Scan, DataSourceStreamReader):
    """The rows that each version added, whatever became of them later; those of a compaction
    are not new. An offset is a version, so a batch that is repeated gives the same rows, as
    long as ``vacuum`` keeps the versions."""

    def __init__(self, options: dict[str, str], fields: T.StructType):
        self.folder_path, self.fields = options["path"], fields
        self.size = int(options.get("splitBytes", SPLIT_BYTES))
        self.first = int(options.get("startingVersion", 0))

    def initialOffset(self) -> dict:
        return {"version": self.first}

    def latestOffset(self) -> dict:
        return {"version": max(self.first, TableFolder(self.folder_path).newest())}

    def partitions(self, start: dict, end: dict) -> list[Splits]:
        folder = TableFolder(self.folder_path)
        old, added = set(folder.manifest(start["version"]).data), []
        for number in range(start["version"] + 1, end["version"] + 1):
            manifest = folder.manifest(number)
            if not manifest.compacted:
                added += [d for d in manifest.data if d not in old]
            old = set(manifest.data)
        return _splits(folder.data_files(added), (), self.size) or [Splits(())]

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class TableWriter(DataSourceArrowWriter):
    """Tasks write files under hidden names; the commit names those of the attempts that
    count, and then puts the manifest in place. Append and overwrite are repeated from the
    winner's version where another writer comes first."""

    def __init__(self, options: dict[str, str], fields: T.StructType, overwrite: bool):
        self.folder_path, self.fields, self.overwrite = options["path"], fields, overwrite
        self.token = uuid.uuid4().hex
        if (kind := TableFolder(self.folder_path).files.type_name) not in ("local", "hdfs"):
            raise ValueError(f"{NAME} writes to local disks and HDFS, not to {kind}")

    @property
    def data(self) -> str:
        return f"data-{self.token}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder = TableFolder(self.folder_path)
        name = f"part-{uuid.uuid4().hex}.parquet"
        path, writer = folder.at(self.data, f".{name}"), None
        schema = to_arrow_schema(self.fields)
        try:
            for batch in iterator:
                if batch.num_rows:
                    if writer is None:
                        folder.files.create_dir(folder.at(self.data))
                        writer = pq.ParquetWriter(path, schema, filesystem=folder.files)
                    writer.write_table(pa.Table.from_batches([batch]).cast(schema))
            if writer is not None:
                writer.close()
        except BaseException:
            if writer is not None:
                writer.close()
                folder.files.delete_file(path)
            raise
        return Written(name if writer is not None else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        folder = TableFolder(self.folder_path)
        names = [m.name for m in messages if isinstance(m, Written) and m.name]
        for name in names:
            folder.files.move(folder.at(self.data, f".{name}"), folder.at(self.data, name))
        made = [self.data] if names else []
        for _ in range(ATTEMPTS):
            base = folder.manifest(folder.newest())
            data, deleted = (made, []) if self.overwrite else ([*base.data, *made], list(base.deleted))
            if folder.put_if_absent(base.number + 1, {"version": base.number + 1, "data": data, "deleted": deleted}):
                return
        raise RuntimeError(f"{self.folder_path}: {ATTEMPTS} other writers came first")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        folder = TableFolder(self.folder_path)
        if folder.files.get_file_info(folder.at(self.data)).type != pafs.FileType.NotFound:
            folder.files.delete_dir(folder.at(self.data))


class TableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        if not options.get("path"):
            raise ValueError(f"{NAME} needs a path")

    def schema(self) -> str:
        table = self.options.get("table", "")
        if table not in DDL:
            raise ValueError(f"give a schema, or one of these as the option table: {', '.join(sorted(DDL))}")
        return DDL[table]

    def reader(self, schema: T.StructType) -> TableReader:
        return TableReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> TableStreamReader:
        return TableStreamReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> TableWriter:
        return TableWriter(self.options, schema, overwrite)
