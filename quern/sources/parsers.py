"""Parsers: kinds of sources, data URIs, text and markdown sections, DOCX, PDF, metadata."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
import zipfile
import zlib
from collections.abc import Callable
from io import BytesIO
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.columns import let
from quern.functions.text import is_blank, unicode_trim
from quern.session import ship_package

PLAIN, MARKDOWN, PDF = "text/plain", "text/markdown", "application/pdf"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
SECTION = "struct<section_id:string,title:string,level:int,text:string,start_offset:int,end_offset:int>"
#: Error codes of a parse, each with whether trying again may help.
ERRORS = {
    "file-read-failed": True, "unsupported-scheme": False, "bad-data-uri": False, "bad-archive": False,
    "dependency-missing": False, "too-large": False, "timed-out": True,
}


def detect_kind(mime: Column, filename: Column, uri: Column) -> Column:
    """A known MIME type, else the name's suffix, else the data URI's type, else plain."""
    mime, name, uri = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (mime, filename, uri))

    def ends(*suffixes: str) -> Column:
        return F.exists(F.array(*map(F.lit, suffixes)), lambda s: F.endswith(name, s))

    kind = F.when(mime.isin(PLAIN, MARKDOWN, PDF, DOCX), mime)
    kind = kind.when(ends(".md", ".markdown"), MARKDOWN).when(ends(".txt"), PLAIN)
    kind = kind.when(ends(".pdf"), PDF).when(ends(".docx"), DOCX)
    for known in (MARKDOWN, PLAIN, PDF, DOCX):
        kind = kind.when(F.startswith(uri, F.lit(f"data:{known}")), known)
    return kind.otherwise(PLAIN)


def data_uri_bytes(uri: Column) -> Column:
    """What a data URI holds: base64, or query-escaped text (a plus is a space); null if it
    is not a data URI or cannot be decoded."""
    body = F.regexp_replace(F.trim(uri), "^data:", "")
    comma = F.locate(",", body)
    meta, payload = F.substring(body, F.lit(1), comma - 1), F.substring(body, comma + 1, F.length(body))
    text = F.try_url_decode(payload)
    value = F.when(F.endswith(meta, F.lit(";base64")), F.try_to_binary(payload, F.lit("base64"))).otherwise(
        F.encode(text, "UTF-8")
    )
    return F.when(F.startswith(F.trim(uri), F.lit("data:")) & (comma > 0), value)


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """``source_uri, content`` of files, through Spark's own readers."""
    found = spark.read.format("binaryFile").load(list(paths))
    return found.select(F.col("path").alias("source_uri"), "content")


def normalize_lines(text: Column) -> Column:
    return unicode_trim(F.regexp_replace(text, "\r\n?", "\n"))


def fallback_title(filename: Column, default: Column) -> Column:
    """The file's base name without its extension, else the default."""
    base = F.trim(F.regexp_extract(F.coalesce(filename, F.lit("")), r"([^/]*)/*$", 1))
    bare = F.trim(F.regexp_replace(base, r"\.[^.]*$", ""))
    name = F.when(bare != "", bare).otherwise(F.lit(""))
    return F.when(name != "", name).otherwise(default)


def text_sections(content: Column, title: Column) -> Column:
    """One section with the title, or the first line that is not blank."""
    lines = F.filter(F.transform(F.split(content, "\n", -1), unicode_trim), lambda x: x != "")
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("Untitled text document"))
    name = F.when(is_blank(title), first).otherwise(title)
    return F.array(
        F.struct(
            F.lit("section-1").alias("section_id"), name.alias("title"), F.lit(1).alias("level"), content.alias("text"),
            F.lit(0).alias("start_offset"), F.octet_length(content).alias("end_offset"),
        )
    )


def markdown_sections(content: Column, title: Column) -> Column:
    """A section per line that starts with ``#`` and has a title; places in bytes. Text
    before the first heading belongs to none. Without headings, one section as for text."""
    # one pass: (bytes so far, headings so far)
    empty = F.array().cast("array<struct<at:int,title:string,level:int>>")
    state = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(s: Column, line: Column) -> Column:
        trimmed = unicode_trim(line)
        marks = F.length(F.regexp_extract(trimmed, "^(#*)", 1))
        name = unicode_trim(F.substring(trimmed, marks + 1, F.length(trimmed)))
        one = F.array(F.struct(s["at"].alias("at"), name.alias("title"), marks.alias("level")))
        out = F.when((marks > 0) & (name != ""), F.concat(s["out"], one)).otherwise(s["out"])
        return F.struct((s["at"] + F.octet_length(line) + 1).alias("at"), out.alias("out"))

    def sections(headings: Column, data: Column) -> Column:
        def section(h: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(headings, k + 1)["at"], F.octet_length(data))
            text = unicode_trim(F.substring(data, h["at"] + 1, stop - h["at"]).cast("string"))
            return F.struct(
                F.concat(F.lit("section-"), (k + 1).cast("string")).alias("section_id"), h["title"].alias("title"),
                h["level"].alias("level"), text.alias("text"), h["at"].alias("start_offset"), stop.alias("end_offset"),
            )

        return F.transform(headings, section)

    default = F.when(is_blank(title), F.lit("Untitled markdown document")).otherwise(title)
    headings = F.aggregate(F.split(content, "\n", -1), state, step, lambda s: s["out"])
    found = let(headings, lambda h: let(F.encode(content, "UTF-8"), lambda data: sections(h, data)))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(text_sections(content, default)))


def parse_text(sources: DataFrame) -> DataFrame:
    """``document_id, title, text, sections`` from ``document_id, kind, filename, content``
    (text); markdown by headings, everything else as plain text."""
    rows = sources.select("document_id", "kind", "filename", normalize_lines(F.col("content")).alias("text"))
    title = fallback_title(F.col("filename"), F.lit(""))
    sections = F.when(F.col("kind") == MARKDOWN, markdown_sections(F.col("text"), title)).otherwise(
        text_sections(F.col("text"), title)
    )
    parsed = rows.withColumn("sections", sections)
    first = F.element_at("sections", 1)
    heads = (F.col("kind") == MARKDOWN) & (F.size(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(#+\s*\S)"), F.lit(1))) > 0)
    shown = F.when(heads | (title == ""), first["title"]).otherwise(title)
    return parsed.select("document_id", shown.alias("title"), "text", "sections")


#: Rows and bytes of archives that a worker has open at once.
SLICE, SLICE_BYTES = 256, 4 << 20
#: Bytes that a part of an archive may have when it is unpacked.
MOST_UNPACKED = 1 << 28


def _docx(data: bytes | None) -> dict:
    try:
        with zipfile.ZipFile(BytesIO(data or b"")) as archive:
            names = set(archive.namelist())
            if any(i.file_size > MOST_UNPACKED for i in archive.infolist()):
                return {"title": None, "text": None, "error": "too-large"}
            body = ElementTree.fromstring(archive.read("word/document.xml"))
            title = ""
            if "docProps/core.xml" in names:
                for node in ElementTree.fromstring(archive.read("docProps/core.xml")).iter():
                    if node.tag.rpartition("}")[2].lower() == "title":
                        title = (node.text or "").strip()
                        break
    except (zipfile.BadZipFile, zlib.error, KeyError, RuntimeError, NotImplementedError, EOFError, ElementTree.ParseError):
        return {"title": None, "text": None, "error": "bad-archive"}
    paragraphs = []
    for paragraph in body.iter():
        if paragraph.tag.rpartition("}")[2] != "p":
            continue
        pieces = []
        for node in paragraph.iter():
            kind = node.tag.rpartition("}")[2]
            if kind == "t":
                pieces.append(node.text or "")
            elif kind == "tab":
                pieces.append("\t")
            elif kind in ("br", "cr"):
                pieces.append("\n")
        text = "".join(pieces).strip()
        if text:
            paragraphs.append(text)
    return {"title": title, "text": "\n\n".join(paragraphs), "error": None}


def parse_docx(files: DataFrame) -> DataFrame:
    """``source_uri, title, text, error`` from ``source_uri, content`` (bytes): paragraphs
    joined by blank lines, the title from the core properties."""

    return in_slices(files.select("source_uri", "content"), "content", "title string, text string, error string", lambda data: _docx(data).values())


def in_slices(rows: DataFrame, column: str, made: str, make: Callable) -> DataFrame:
    """``rows`` without ``column``, and with what ``make`` returns for each of its values (as the
    schema ``made`` has it). A worker holds the objects of ``SLICE`` rows, or of ``SLICE_BYTES``,
    and not those of a whole batch."""
    ship_package(rows.sparkSession)
    kept = [f for f in rows.schema if f.name != column]
    names = [f.name for f in kept] + [part.split()[0] for part in made.split(", ")]
    kinds = [pa.binary() if part.endswith(" binary") else pa.string() for part in made.split(", ")]

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            before, start = np.append(0, np.cumsum(sizes, dtype=np.int64)), 0
            while start < batch.num_rows:
                stop = int(np.searchsorted(before, before[start] + SLICE_BYTES, "right")) - 1
                some = batch.slice(start, min(max(1, stop - start), SLICE))
                out = [tuple(make(v.as_py())) for v in some.column(column)]
                columns = [pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(some.column(f.name) for f in kept), *columns], names)
                start += some.num_rows

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), made])
    return rows.mapInArrow(run, schema)


def _pdf(data: bytes | None) -> dict:
    binary = shutil.which("pdftotext")
    if binary is None:
        return {"text": None, "error": "dependency-missing"}
    with tempfile.NamedTemporaryFile(suffix=".pdf") as held:  # read back by the same task only
        held.write(data or b"")
        held.flush()
        try:
            done = subprocess.run([binary, "-layout", held.name, "-"], capture_output=True, timeout=60, check=False)
        except subprocess.TimeoutExpired:
            return {"text": None, "error": "timed-out"}
    if done.returncode:
        return {"text": None, "error": "file-read-failed"}
    return {"text": done.stdout.decode("utf-8", "replace"), "error": None}


def parse_pdf(files: DataFrame) -> DataFrame:
    """``source_uri, text, page_count, error``: form feeds part pages. Without the
    converter on the workers every row has the error ``dependency-missing``."""

    @F.pandas_udf("struct<text:string,error:string>")
    def parse(content):
        import pandas as pd

        return pd.DataFrame([_pdf(x) for x in content], columns=["text", "error"])

    pages = F.size(F.filter(F.split("d.text", "\f"), lambda p: ~is_blank(p)))
    return files.withColumn("d", parse("content")).select(
        "source_uri",
        normalize_lines(F.regexp_replace("d.text", "\f", "\n\n")).alias("text"),
        F.when(F.col("d.text").isNotNull(), pages).alias("page_count"),
        "d.error",
    )


#: Keys under which a document server may report each property, best first.
SERVER_KEYS = {
    "title": ("dc:title", "title", "Title"),
    "language": ("dc:language", "language", "Content-Language"),
    "page_count": ("xmpTPg:NPages", "meta:page-count", "Page-Count"),
}


def server_metadata(metadata: Column) -> Column:
    """Title, language and page count from a document server's JSON answer (an object or a
    list of them)."""
    single = F.when(F.startswith(F.trim(metadata), F.lit("[")), F.get_json_object(metadata, "$[0]")).otherwise(metadata)
    answer = F.from_json(single, "map<string,string>")

    def first(name: str) -> Column:
        return F.coalesce(*(F.try_element_at(answer, F.lit(k)) for k in SERVER_KEYS[name]))

    return F.struct(
        first("title").alias("title"), first("language").alias("language"),
        first("page_count").try_cast("int").alias("page_count"),
    )


def route_parser(provider: Column, kind: Column) -> Column:
    """Which parser a document goes to; unknown providers and ``auto`` go by kind."""
    by_kind = F.when(kind == PDF, "pdf").when(kind == DOCX, "docx").otherwise("text")
    named = F.lower(F.trim(F.coalesce(provider, F.lit(""))))
    return F.when(named.isin("text", "simple"), "text").when(named == "tika", "tika").otherwise(by_kind)


def with_parse_fallback(primary: DataFrame, sources: DataFrame, fallback) -> DataFrame:
    """Rows that parsed, and for the others the fallback's with ``fallback_reason``."""
    good = primary.filter("error is null").drop("error").withColumn("fallback_reason", F.lit(None).cast("string"))
    bad = primary.filter("error is not null").select("source_uri", F.col("error").alias("fallback_reason"))
    again = fallback(sources.join(bad, "source_uri", "left_semi")).drop("error").join(bad, "source_uri")
    return good.unionByName(again, allowMissingColumns=True)


def error_struct(code: Column, source: str) -> Column:
    """``struct<code, source, retryable>`` of an error code, null without one."""
    retryable = F.lit(False)
    for name, value in ERRORS.items():
        retryable = F.when(code == name, value).otherwise(retryable)
    return F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit(source).alias("source"), retryable.alias("retryable")))
