"""Chunkers: paragraphs, windows, structural blocks, semantic merging, section paths.

Places are code points (``unit="char"``) or UTF-8 bytes (``unit="byte"``; a window that
cuts a character then shows the replacement character at its edge).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.columns import let
from quern.functions.text import GO_SPACE, unicode_trim
from quern.operators.indexing import embedding_inputs
from quern.session import materialize, ship_package

SEGMENT = "struct<text:string,start:int,stop:int>"


def chunk_parameters(target: int | None, overlap: int | None) -> tuple[int, int]:
    """Defaults: 1200 for a target that is not positive, no negative overlap, and a quarter
    of the target for an overlap that reaches it."""
    target = target if target and target > 0 else 1200
    overlap = max(overlap or 0, 0)
    return target, target // 4 if overlap >= target else overlap


def _size(text: Column, unit: str) -> Column:
    return F.octet_length(text) if unit == "byte" else F.length(text)


def _trimmed(text: Column, start: Column, unit: str) -> Column:
    """The trimmed text as a segment whose places follow what the trim took away."""

    def segment(part: Column) -> Column:
        lead = _size(part, unit) - _size(F.ltrim(part, F.lit(GO_SPACE)), unit)
        at = (start + lead).cast("int")
        return let(
            unicode_trim(part),
            lambda inner: F.struct(
                inner.alias("text"), at.alias("start"), (at + _size(inner, unit)).cast("int").alias("stop")
            ),
        )

    return let(text, segment)


def _non_empty(segments: Column) -> Column:
    return F.filter(segments, lambda s: s["text"] != "")


def paragraph_segments(text: Column, unit: str = "char") -> Column:
    """Trimmed parts between blank lines; the whole trimmed text if there is none."""
    parts = F.split(text, "\n\n", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SEGMENT}>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        return F.struct(
            (state["at"] + _size(part, unit) + 2).alias("at"),
            F.concat(state["out"], F.array(_trimmed(part, state["at"], unit))).alias("out"),
        )

    found = _non_empty(F.aggregate(parts, start, step, lambda s: s["out"]))
    whole = unicode_trim(text)
    alone = F.array(F.struct(whole.alias("text"), F.lit(0).alias("start"), _size(whole, unit).cast("int").alias("stop")))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(alone))


def window_segments(text: Column, target: int, overlap: int, unit: str = "char", base: Column | None = None) -> Column:
    """Windows of ``target`` stepping by ``target - overlap``; the last ends with the text.
    Windows that trim to nothing are left out."""
    step = target - overlap
    base = F.lit(0) if base is None else base

    def cut(n: Column, part) -> Column:
        last = F.when(n <= target, F.lit(0)).otherwise(F.ceil((n - target) / step).cast("int"))
        windows = F.transform(F.sequence(F.lit(0), last), lambda i: _trimmed(part(i), base + i * step, unit))
        return F.when(n > 0, _non_empty(windows)).otherwise(F.array().cast(f"array<{SEGMENT}>"))

    if unit == "byte":

        def from_bytes(data: Column) -> Column:
            def part(i: Column) -> Column:
                return F.make_valid_utf8(F.substring(data, i * step + 1, F.lit(target)).cast("string"))

            return cut(F.octet_length(data), part)

        return let(F.encode(text, "UTF-8"), from_bytes)

    # characters have no fixed width, so the text is cut into steps once and windows are joined from these
    width = -(-target // step)

    def from_steps(pieces: Column) -> Column:
        def part(i: Column) -> Column:
            return F.substring(F.array_join(F.slice(pieces, i + 1, width), ""), 1, target)

        return let(F.length(text), lambda n: cut(n, part))

    return let(F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{step}}})"), F.lit(1)), from_steps)


def enforce_size(segments: Column, target: int, overlap: int, unit: str = "char") -> Column:
    """Segments over the target are cut into windows."""

    def cut(s: Column) -> Column:
        return F.when(_size(s["text"], unit) <= target, F.array(s)).otherwise(
            window_segments(s["text"], target, overlap, unit, s["start"])
        )

    return F.flatten(F.transform(segments, cut))


def section_path(sections: Column, start: Column) -> Column:
    """The title (or id) of the first section that holds the place, else of the last one."""

    def name(s: Column) -> Column:
        return F.when(F.coalesce(s["title"], F.lit("")) == "", s["section_id"]).otherwise(s["title"])

    inside = F.filter(sections, lambda s: (start >= s["start_offset"]) & (start < s["end_offset"]))
    chosen = F.when(F.size(inside) > 0, F.element_at(inside, 1)).otherwise(F.try_element_at(sections, F.lit(-1)))
    return F.when(F.coalesce(F.size(sections), F.lit(0)) <= 0, F.array().cast("array<string>")).otherwise(
        F.array(name(chosen))
    )


# --- structural blocks -----------------------------------------------------------------

#: What the lines of each kind look like.
HEADING = r"^#{1,6}\s+\S"
QUESTION = r"^\s*(?:Q|A|问|答|FAQ|注意|说明|提示|警告|Note|Tip|Warning|Important)[：:]\s*\S"
DIVIDER = r"^(?:\-{3,}|\*{3,}|_{3,})\s*$"
NUMBERED = r"^\s*(?:\d+[\.\)、]|[(（]\d+[)）]|[①②③④⑤⑥⑦⑧⑨⑩]|[一二三四五六七八九十]+[、.）\)])"
BULLET = r"^\s*[-*•·]\s+\S"


def line_type(line: Column) -> Column:
    """heading, qa, divider, list or paragraph, tested in this order."""
    return (
        F.when(line == "", "paragraph")
        .when(line.rlike(HEADING), "heading")
        .when(line.rlike(QUESTION), "qa")
        .when(line.rlike(DIVIDER), "divider")
        .when(line.rlike(NUMBERED) | line.rlike(BULLET), "list")
        .otherwise("paragraph")
    )


def structural_blocks(docs: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """``key, block, type, text, start, stop``: typed blocks, places in bytes.

    Lines are rows: fences are found by the parity of a running count, and a block starts
    where the type changes, at each heading or divider, and after a blank line that ended
    a paragraph. All windows are per document, in the order of its lines.
    """
    lines = docs.select(F.col(key).alias("_k"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("i", "line"))
    by_doc = Window.partitionBy("_k").orderBy("i")
    before = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy("_k")
    lines = lines.withColumns(
        {
            "trimmed": unicode_trim(F.col("line")),
            "size": F.octet_length("line"),
            "last": F.max("i").over(total),
        }
    ).withColumns(
        {
            "at": F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)),
            "width": F.col("size") + (F.col("i") < F.col("last")).cast("int"),
            "fence": F.startswith("trimmed", F.lit("```")),
        }
    )
    lines = lines.withColumn("fences", F.sum(F.col("fence").cast("int")).over(by_doc))
    opens = F.col("fence") & (F.col("fences") % 2 == 1)
    in_code = F.col("fence") | (F.col("fences") % 2 == 1)
    blank = ~in_code & (F.col("trimmed") == "")
    lines = lines.withColumns(
        {
            "opens": opens,
            "code": in_code,
            "blank": blank,
            "type": F.when(in_code, "code").when(~blank, line_type(F.col("trimmed"))),
        }
    )
    # the state a line meets: a closed fence or the start leaves an empty paragraph
    previous = F.last("type", ignorenulls=True).over(before)
    blank_since = F.coalesce(F.lag("blank").over(by_doc), F.lit(False))
    own = F.col("type")
    starts = F.when(own == "code", F.col("opens")).otherwise(
        own.isNotNull()
        & (
            previous.isNull()
            | (previous != own)
            | own.isin("heading", "divider")
            | ((own == "paragraph") & blank_since)
        )
    )
    lines = lines.withColumn("starts", F.coalesce(starts, F.lit(False)))
    lines = lines.withColumn("block", F.sum(F.col("starts").cast("int")).over(by_doc)).filter("block > 0")
    # blank lines inside a list or the like belong to it, after a paragraph they end it
    kind = F.first("type", ignorenulls=True).over(Window.partitionBy("_k", "block").orderBy("i"))
    lines = lines.withColumn("kind", kind).filter(~(F.col("blank") & F.col("kind").isin("paragraph", "code")))
    grouped = lines.groupBy("_k", "block", "kind").agg(
        F.array_sort(F.collect_list(F.struct("i", "line"))).alias("rows"),
        F.min("at").alias("start"),
        F.max(F.col("at") + F.col("width")).alias("stop"),
    )
    body = unicode_trim(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    numbered = F.row_number().over(Window.partitionBy("_k").orderBy("start")) - 1
    return (
        grouped.select("_k", "kind", body.alias("text"), "start", "stop")
        .filter("text <> ''")
        .select(F.col("_k").alias(key), numbered.alias("block"), F.col("kind").alias("type"), "text", "start", "stop")
    )


# --- semantic merging ------------------------------------------------------------------


def semantic_breakpoints(
    vectors: DataFrame, key: str, order: str, vector: str = "vector", least: float = 0.6, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``key, order, breaks`` (and the columns to keep): whether a sentence is unlike the one before it (cosine below
    the threshold, or not comparable)."""
    from quern.functions.vector import cosine

    window = Window.partitionBy(key).orderBy(order)
    before = F.lag(vector).over(window)
    similarity = cosine(before, F.col(vector))
    first = F.row_number().over(window) == 1
    return vectors.withColumn("_first", first).withColumn("_s", similarity).select(
        key, order, (~F.col("_first") & (F.col("_s").isNull() | (F.col("_s") < least))).alias("breaks"), *keep
    )


def merge_sentences(spans: Column, breaks: Column, target: int) -> Column:
    """Sentences joined into segments: a break or a reached target closes one.

    ``spans`` is ``array<struct<text, start, stop>>`` and ``breaks`` the numbers (from 0) of
    sentences that start anew. One fold over the array.
    """
    empty = F.array().cast(f"array<{SEGMENT}>")
    state = F.struct(
        F.lit(0).alias("i"), F.lit("").alias("text"), F.lit(-1).alias("start"), F.lit(-1).alias("stop"),
        F.lit(0).alias("size"), F.lit(0).alias("n"), empty.alias("out"),
    )

    def segment(s: Column) -> Column:
        return F.array(F.struct(unicode_trim(s["text"]).alias("text"), s["start"].alias("start"), s["stop"].alias("stop")))

    def step(s: Column, span: Column) -> Column:
        fresh = F.array_contains(breaks, s["i"]) & (s["size"] > 0)
        out = F.when(fresh, F.concat(s["out"], segment(s))).otherwise(s["out"])
        empty_now = fresh | (s["n"] == 0)
        text = F.when(empty_now, span["text"]).otherwise(F.concat(s["text"], span["text"]))
        start = F.when(empty_now, span["start"]).otherwise(s["start"])
        size = F.when(fresh, F.lit(0)).otherwise(s["size"]) + F.length(span["text"])
        n = F.when(empty_now, F.lit(1)).otherwise(s["n"] + 1)
        full = (F.lit(target) > 0) & (size >= target) & (n > 1)
        closed = F.array(F.struct(unicode_trim(text).alias("text"), start.alias("start"), span["stop"].alias("stop")))
        return F.struct(
            (s["i"] + 1).alias("i"),
            F.when(full, F.lit("")).otherwise(text).alias("text"),
            F.when(full, F.lit(-1)).otherwise(start).alias("start"),
            span["stop"].alias("stop"),
            F.when(full, F.lit(0)).otherwise(size).alias("size"),
            F.when(full, F.lit(0)).otherwise(n).alias("n"),
            F.when(full, F.concat(out, closed)).otherwise(out).alias("out"),
        )

    return F.aggregate(
        spans, state, step, lambda s: F.when(s["n"] > 0, F.concat(s["out"], segment(s))).otherwise(s["out"])
    )


def split_list(text: str, start: int, stop: int, target: int) -> list[tuple[str, int, int]] | None:
    """A long list block cut between items, packed up to ``target`` characters; None if it
    has a single item."""
    marker = re.compile(f"{BULLET}|{NUMBERED}")
    items: list[list[str]] = []
    for line in text.split("\n"):
        if not line.strip():
            if items:
                items[-1].append(line)
        elif marker.match(line.strip()) or not items:
            items.append([line])
        else:
            items[-1].append(line)
    joined = ["\n".join(lines).strip() for lines in items]
    if len(joined) <= 1:
        return None
    out, held, held_at, at = [], "", start, start
    for k, item in enumerate(joined):
        if held and len(held) + len(item) > target:
            out.append((held.strip(), held_at, at))
            held, held_at = "", at
        held += item + ("\n" if k < len(joined) - 1 else "")
        at += len(item.encode("utf-8")) + 1
    if held:
        out.append((held.strip(), held_at, stop))
    return out


def _sentences_of(paragraphs: DataFrame, key: str) -> DataFrame:
    """``_at, key, chunk_index, s``: the sentences of ``functions.text.sentences``, a row for each."""
    ship_package(paragraphs.sparkSession)

    def cut(batches):
        import pyarrow as pa

        part = re.compile("[^。！？\n]*[。！？\n]|[^。！？\n]+")
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                few = batch.slice(first, 256)
                rows, numbers, texts, starts, stops = [], [], [], [], []
                for row, text in enumerate(few.column(2).to_pylist()):
                    at = n = 0
                    for found in part.findall(text or ""):
                        stop = at + len(found.encode())
                        if trimmed := found.strip(GO_SPACE):
                            rows.append(row)
                            numbers.append(n)
                            texts.append(trimmed)
                            starts.append(at)
                            stops.append(stop)
                            n += 1
                        at = stop
                spans = pa.StructArray.from_arrays(
                    [pa.array(texts, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], ["text", "start", "stop"]
                )
                own = few.take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(numbers, pa.int32()), spans], ["_at", key, "chunk_index", "s"]
                )

    kind = paragraphs.schema[key].dataType.simpleString()
    schema = f"_at string, `{key}` {kind}, chunk_index int, s struct<text:string,start:int,stop:int>"
    return paragraphs.select("_at", key, "text").mapInArrow(cut, schema)


def _by_similarity(paragraphs: DataFrame, key: str, target: int, provider, least: float) -> DataFrame:
    """``_at, _merged``: sentences of long paragraphs (``_at`` is unique) joined where their
    vectors are alike; paragraphs of which a sentence has no vector are left out."""
    parted = materialize(_sentences_of(paragraphs, key), "sentences")  # read twice below
    rows = parted.select(
        "_at", F.col(key).cast("string").alias("document_id"), F.concat_ws("_sent_", "_at", "chunk_index").alias("chunk_id"), "chunk_index",
        F.col("s.text").alias("text"), F.length("s.text").alias("char_count"), "s",
    )
    vectors = provider(embedding_inputs(rows)).select("chunk_id", "vector")
    compared = semantic_breakpoints(rows.join(vectors, "chunk_id", "left"), "_at", "chunk_index", least=least, keep=("s", "vector"))
    whole = compared.groupBy("_at").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "s"))).alias("spans"),
        F.collect_list(F.when(F.col("breaks"), F.col("chunk_index"))).alias("starts"),
        F.count_if(F.coalesce(F.size("vector"), F.lit(0)) > 0).alias("n"),
    )
    spans = F.transform("spans", lambda x: x["s"])
    return whole.filter((F.size("spans") > 1) & (F.size("spans") == F.col("n"))).select(
        "_at", merge_sentences(spans, F.col("starts"), target).alias("_merged")
    )


def semantic_segments(
    blocks: DataFrame,
    key: str = "document_id",
    target: int = 1200,
    provider: Callable[[DataFrame], DataFrame] | None = None,
    least: float = 0.6,
) -> DataFrame:
    """``key, block, segment, text, start, stop``: blocks within the target stay; longer lists
    are cut between items, longer paragraphs where neighbouring sentences are unlike (by the
    vectors of ``provider``, as for ``indexing.embed``) and, without a provider, vectors for
    all sentences or a second segment, into windows with a tenth of overlap; other kinds
    stay whole. The blocks are written once and read for each kind."""
    ship_package(blocks.sparkSession)

    @F.pandas_udf("array<struct<text:string,start:int,stop:int>>")
    def lists(text, start, stop):
        import pandas as pd

        def one(t, a, b):
            cut = split_list(t, a, b, target)
            return None if cut is None else [{"text": x, "start": s, "stop": e} for x, s, e in cut]

        return pd.Series([one(*row) for row in zip(text, start.tolist(), stop.tolist())])

    blocks = materialize(blocks, "blocks")
    long = F.length("text") > target
    first = F.col("start").cast("int")
    same = F.array(F.struct("text", first.alias("start"), F.col("stop").cast("int").alias("stop")))
    windows = window_segments(F.col("text"), target, target // 10, "byte", first)
    listed = blocks.filter(long & (F.col("type") == "list"))
    cut = listed.withColumn("_s", F.coalesce(lists("text", "start", "stop"), windows))
    others = blocks.filter(~(long & F.col("type").isin("list", "paragraph"))).withColumn("_s", same)
    paragraphs = blocks.filter(long & (F.col("type") == "paragraph"))
    if provider is None:
        parted = paragraphs.withColumn("_s", windows)
    else:
        at = F.concat_ws("_block_", F.col(key).cast("string"), F.col("block").cast("string"))
        named = paragraphs.withColumn("_at", at)
        merged = _by_similarity(named, key, target, provider, least)
        moved = F.transform(
            "_merged", lambda x: F.struct(x["text"].alias("text"), (x["start"] + first).alias("start"), (x["stop"] + first).alias("stop"))
        )
        several = F.coalesce(F.size("_merged"), F.lit(0)) > 1
        parted = named.join(merged, "_at", "left").withColumn("_s", F.when(several, moved).otherwise(windows)).drop("_at", "_merged")
    return others.unionByName(cut).unionByName(parted).select(
        F.col(key), "block", F.posexplode("_s").alias("segment", "s")
    ).select(key, "block", "segment", "s.text", "s.start", "s.stop")


def chunk_documents(
    docs: DataFrame,
    strategy: str = "paragraph",
    *,
    target: int = 1200,
    overlap: int = 0,
    key: str = "document_id",
    text: str = "text",
    sections: str | None = None,
    unit: str = "char",
    provider: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``key, chunk_id, chunk_index, text, char_count, start, stop`` (and ``section_path``).

    Strategies: paragraph (also for unknown names), recursive, semantic (which cuts long
    paragraphs by the vectors of a ``provider``, if there is one). Blank documents
    give no chunk. Chunk numbers follow the places in the text.
    """
    target, overlap = chunk_parameters(target, overlap)
    named = (strategy or "").strip().lower()
    rows = docs.filter(unicode_trim(F.coalesce(F.col(text), F.lit(""))) != "")
    if named == "semantic":
        parts = semantic_segments(structural_blocks(rows, key, text), key, target, provider)
        segments = F.array(F.struct("text", "start", "stop"))
        parts = parts.select(key, "block", "segment", F.explode(enforce_size(segments, target, overlap, "byte")).alias("s"))
        order = Window.partitionBy(key).orderBy("block", "segment", "s.start")
        found = parts.select(key, (F.row_number().over(order) - 1).alias("chunk_index"), "s")
        if sections:
            found = found.join(rows.select(key, F.col(sections).alias("_sections")), key)
        unit = "byte"
    else:
        first = (
            window_segments(F.col(text), target, overlap, unit) if named == "recursive" else paragraph_segments(F.col(text), unit)
        )
        parts = enforce_size(first, target, overlap, unit)
        extra = [F.col(sections).alias("_sections")] if sections else []
        found = rows.select(key, *extra, F.posexplode(parts).alias("chunk_index", "s"))
    columns = [
        F.col(key),
        F.concat_ws("_chunk_", F.col(key).cast("string"), (F.col("chunk_index") + 1).cast("string")).alias("chunk_id"),
        "chunk_index",
        F.col("s.text").alias("text"),
        _size(F.col("s.text"), unit).alias("char_count"),
        F.col("s.start").alias("start"),
        F.col("s.stop").alias("stop"),
    ]
    if sections:
        columns.append(section_path(F.col("_sections"), F.col("s.start")).alias("section_path"))
    return found.select(*columns)
