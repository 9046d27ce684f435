"""Line deduplication over content-defined chunks.

A document's lines are hashed, and a rolling hash over the last ``window`` line hashes
decides after which lines a chunk ends (about one in ``modulus``). So boundaries depend
on nearby lines only: where a passage recurs in another place, the chunks inside it are
the same again after at most ``window`` lines. Chunks of two lines or more that occur
before (in a document of smaller id, or earlier in the same one) are removed.

Chunks are grouped by digest *and* bytes, with map-side combining, so a passage that a
third of the documents share reaches a task as one row per map task. Only digests that
the byte comparison finds twice go on, and from there on only numbers move until the
removed lines meet their documents. What the digests' join finds is written before it is
grouped by document: so the join is the last step of its job, and adaptive execution can
split a hot digest. Should one digest ever stand for two texts, its chunks stay.

Chunks are disjoint, so the ends of a repeated passage, and a passage of a few lines as a
whole, lie in chunks that also hold the neighbours' lines. With ``least_words`` these are
found by *windows* that overlap: from every line the shortest run of lines with more than
that many words that starts there and the shortest that ends there. A repeated run of
that many words is the union of such windows (each of its lines has enough words after it
in the run, or else lies in the window that ends with the run), so every line of every
such run goes, single long lines included. Windows are compared by SHA-256 of their
bytes; only numbers and digests move. Both rules judge the input, not what the other
leaves; what either removes stands at an earlier place, so of every line the first stays.

Everything is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import materialize

_LAST = (1 << 63) - 1  # the order of a null id: after all others


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks(text: Column, window: int = 3, modulus: int = 4) -> Column:
    """``array<struct<no, start, n_lines, text>>``: the chunks of a text, in order.

    Line hashes are the first 32 bits of MD5; the rolling hash after a line is the sum of
    the last ``window`` line hashes, each multiplied by 31 once per line it lies back.
    """

    def of_lines(lines: Column) -> Column:
        hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
        return _let(hashes, lambda h: of_hashes(lines, h))

    def of_hashes(lines: Column, hashes: Column) -> Column:
        rolled = hashes
        for back in range(1, window):
            earlier = F.slice(F.concat(F.array_repeat(F.lit(0).cast("long"), back), hashes), 1, F.size(hashes))
            factor = F.lit(31**back).cast("long")
            rolled = F.zip_with(rolled, F.transform(earlier, lambda x: x * factor), lambda a, b: a + b)
        ends = F.filter(
            F.transform(rolled, lambda r, i: F.when(r % modulus == 0, i + 1).otherwise(0)), lambda e: e > 0
        )
        return _let(F.array_union(ends, F.array(F.size(lines))), lambda e: of_ends(lines, e))

    def of_ends(lines: Column, ends: Column) -> Column:
        def chunk(end: Column, k: Column) -> Column:
            start = F.when(k == 0, 0).otherwise(F.element_at(ends, F.greatest(k, F.lit(1))))
            own = F.slice(lines, start + 1, end - start)
            return F.struct(
                k.alias("no"), start.alias("start"), (end - start).alias("n_lines"), F.array_join(own, "\n").alias("text")
            )

        return F.transform(ends, chunk)

    return _let(F.split(text, "\n", -1), of_lines)


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _order, _row, _text``: rows of one ``_order`` and ``_row`` share id and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    return docs.select(
        F.col(id_col).alias("_id"), order.alias("_order"), F.xxhash64(text).alias("_row"), text.alias("_text")
    )


def _repeated_chunks(rows: DataFrame, window: int, modulus: int, least_lines: int, digest) -> DataFrame:
    """``_order, _row, _spans, _n``: the lines of the chunks that occur before, per document."""
    parts = rows.select("_order", "_row", F.explode(chunks(F.col("_text"), window, modulus)).alias("c")).filter(
        F.col("c.n_lines") >= least_lines
    )
    compared = (
        parts.groupBy(digest(F.col("c.text")).alias("_digest"), F.col("c.text").alias("_chunk"))
        .agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .groupBy("_digest")
        .agg(F.min("_first").alias("_first"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_texts"))
        .filter("_n > 1 and _texts = 1")
        .select(F.col("_digest").alias("_d"), "_first")
    )
    span = F.struct(F.col("c.start").alias("start"), (F.col("c.start") + F.col("c.n_lines")).alias("stop"))
    here = parts.select("_order", "_row", span.alias("_span"), digest(F.col("c.text")).alias("_digest"))
    seen = materialize(
        here.join(materialize(compared, "chunks"), F.col("_digest") == F.col("_d")).select(
            "_order", "_row", "_span", "_digest", (F.col("_order") == F.col("_first")).alias("_first")
        ),
        "chunks",
    )
    # rows of one document are few: its repeated chunks
    own = seen.filter("_first").groupBy("_order", "_row", "_digest").agg(F.sort_array(F.collect_set("_span")).alias("_at"))
    again = own.select("_order", "_row", F.explode(F.slice("_at", 2, F.size("_at"))).alias("_span"))
    later = seen.filter("not _first").select("_order", "_row", "_span").unionByName(again)
    spans = later.groupBy("_order", "_row").agg(F.collect_set("_span").alias("_spans"))
    return spans.withColumn("_n", F.size("_spans").cast("long"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    window: int = 3,
    modulus: int = 4,
    least_lines: int = 2,
    least_words: int | None = None,
    digest=sha256_digest,
) -> DataFrame:
    """Per row: ``id, text, n_lines, n_chunks, n_removed_chunks, n_removed_runs,
    n_removed_lines, kept_sha256`` where ``text`` is what remains after the repeated chunks
    and, with ``least_words``, the repeated runs of more words than that are removed;
    ``n_removed_runs`` counts maximal runs of removed lines.

    Ids must be integers. Defined results: null text counts as empty (one empty line, one
    chunk of one line, never removed); a null id comes after all others; rows that share
    an id are one document seen twice for the chunks (the first occurrence stays in each of
    them), and for the windows too if their texts are equal, else different documents in the
    order of a hash; an empty table gives an empty table; other columns are ignored.
    ``digest`` may be any function of a chunk (chunks of a digest that two share stay).
    """
    rows = _rows(docs, id_col, text_col)
    removed = _repeated_chunks(rows, window, modulus, least_lines, digest)
    if least_words is not None:
        runs = _repeated_windows(rows, least_words).withColumn("_n", F.lit(0).cast("long"))
        removed = (
            removed.unionByName(runs)
            .groupBy("_order", "_row")
            .agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.sum("_n").alias("_n"))
        )
    more = [
        F.size(chunks(F.col("_text"), window, modulus)).cast("long").alias("n_chunks"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_removed_chunks"),
    ]
    found = _without(rows, removed, id_col, more)
    names = ["text", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_runs", "n_removed_lines", "kept_sha256"]
    return found.select(id_col, *names)


_WORD = r"[^ \t\r\f\x0B]+"
_SPAN = "array<struct<start:int,stop:int>>"


def windows(text: Column, least_words: int = 50) -> Column:
    """``array<struct<start, stop, digest>>``: the windows of a text, each once.

    Lines without words are left out of the comparison; ``stop`` (exclusive) lies behind
    those that follow a window. A window has at most ``least_words + 1`` lines with words.
    """
    most = least_words + 1

    def of_lines(lines: Column) -> Column:
        counted = F.transform(
            lines,
            lambda x, i: F.struct(
                i.alias("no"), F.regexp_count(x, F.lit(_WORD)).alias("n"), x.alias("line")
            ),
        )
        return _let(F.filter(counted, lambda x: x["n"] > 0), lambda s: of_spoken(s, F.size(lines)))

    def of_spoken(spoken: Column, size: Column) -> Column:
        parts = F.struct(spoken["no"].alias("no"), spoken["n"].alias("n"), spoken["line"].alias("line"))
        return _let(parts, lambda p: of_parts(p["no"], p["n"], p["line"], size))

    def shortest(counts: Column) -> Column:
        """How many of the first ``counts`` exceed ``least_words`` together; null if all do not."""
        none = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
        return F.aggregate(
            counts,
            none,
            lambda a, n: F.when(a["sum"] > least_words, a).otherwise(
                F.struct((a["sum"] + n).alias("sum"), (a["n"] + 1).alias("n"))
            ),
            lambda a: F.when(a["sum"] > least_words, a["n"]),
        )

    def of_parts(no: Column, counts: Column, lines: Column, size: Column) -> Column:
        def packed(first: Column, n: Column) -> Column:  # numbers are told apart by hash, structs are not
            return first.cast("long") * (1 << 31) + n

        starting = F.transform(counts, lambda _, k: packed(k, shortest(F.slice(counts, k + 1, most))))
        ending = F.transform(
            counts,
            lambda _, k: _let(
                shortest(
                    F.reverse(F.slice(counts, F.greatest(k - least_words, F.lit(0)) + 1, F.least(k + 1, F.lit(most))))
                ),
                lambda n: packed(k - n + 1, n),
            ),
        )

        def window(first: Column, n: Column) -> Column:
            own = F.array_join(F.slice(lines, first + 1, n), "\n")
            return F.struct(
                F.get(no, first).alias("start"),
                F.coalesce(F.get(no, first + n), size).alias("stop"),
                F.unhex(F.sha2(own, 256)).alias("digest"),
            )

        spans = F.filter(F.array_distinct(F.concat(starting, ending)), lambda x: x.isNotNull())
        return F.transform(
            spans, lambda x: window(F.shiftright(x, 31).cast("int"), (x % (1 << 31)).cast("int"))
        )

    return _let(F.split(text, "\n", -1), of_lines)


def _merged(spans: Column) -> Column:
    """Sorted spans as the fewest that cover the same lines."""
    none = F.array().cast(_SPAN)

    def span(start: Column, stop: Column) -> Column:
        return F.struct(start.alias("start"), stop.alias("stop"))

    def state(done: Column, start: Column, stop: Column) -> Column:
        return F.struct(done.alias("done"), start.alias("start"), stop.alias("stop"))

    def closed(s: Column) -> Column:
        return F.when(s["stop"] < 0, none).otherwise(F.concat(s["done"], F.array(span(s["start"], s["stop"]))))

    return F.aggregate(
        spans,
        state(none, F.lit(-1), F.lit(-1)),
        lambda s, g: F.when(
            g["start"] <= s["stop"], state(s["done"], s["start"], F.greatest(s["stop"], g["stop"]))
        ).otherwise(state(closed(s), g["start"], g["stop"])),
        closed,
    )


def _repeated_windows(rows: DataFrame, least_words: int) -> DataFrame:
    """``_order, _row, _spans``: the lines of the windows that occur before, per document."""
    place = F.struct("_order", "_row", "start")
    parts = materialize(
        rows.select("_order", "_row", F.explode(windows(F.col("_text"), least_words)).alias("w")).select(
            "_order", "_row", "w.*"
        ),
        "windows",
    )
    repeated = materialize(
        parts.groupBy(F.col("digest").alias("_d"))
        .agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select("_d", "_first"),
        "windows",
    )
    later = materialize(
        parts.join(repeated, F.col("digest") == F.col("_d"))
        .filter(place != F.col("_first"))
        .select("_order", "_row", F.struct("start", "stop").alias("_span")),
        "windows",
    )
    return later.groupBy("_order", "_row").agg(F.collect_set("_span").alias("_spans"))


def _without(rows: DataFrame, removed: DataFrame, id_col: str, more: list[Column] = ()) -> DataFrame:
    """``rows`` without the lines of ``removed`` (``_order, _row, _spans``)."""
    removed = materialize(
        removed.withColumnsRenamed({"_order": "_o", "_row": "_r"}).withColumn(
            "_gone", _merged(F.sort_array("_spans").cast(_SPAN))
        ),
        "removed",
    ).drop("_spans")
    # a merge join at every size: a broadcast that only small inputs allow would hide what large ones shuffle
    joined = rows.join(
        removed.hint("merge"), (F.col("_order") == F.col("_o")) & (F.col("_row") == F.col("_r")), "left"
    )
    gone = F.coalesce("_gone", F.array().cast(_SPAN))

    def result(x: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(x["gone"], lambda g: g["stop"]))
        stops = F.concat(F.transform(x["gone"], lambda g: g["start"]), F.array(F.size(x["lines"])))
        stays = F.zip_with(starts, stops, lambda a, b: F.slice(x["lines"], a + 1, b - a))
        lost = F.aggregate(x["gone"], F.lit(0).cast("long"), lambda a, g: a + (g["stop"] - g["start"]))
        return F.struct(
            F.array_join(F.flatten(stays), "\n").alias("text"),
            F.size(x["lines"]).cast("long").alias("n_lines"),
            F.size(x["gone"]).cast("long").alias("n_removed_runs"),
            lost.alias("n_removed_lines"),
        )

    parted = F.struct(gone.alias("gone"), F.split("_text", "\n", -1).alias("lines"))
    final = joined.select(F.col("_id").alias(id_col), *more, F.explode(F.array(_let(parted, result))).alias("x"))
    return final.select(*(c for c in final.columns if c != "x"), "x.*", F.sha2("x.text", 256).alias("kept_sha256"))


def dedup_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_words: int = 50
) -> DataFrame:
    """The windows' part of ``dedup_lines`` alone. Per row: ``id, text, n_lines, n_removed_runs,
    n_removed_lines, kept_sha256`` where ``text`` is what remains after every run of lines with more than ``least_words`` words
    that also stands at an earlier place (a smaller id, or earlier in the text) is removed.

    Every distinct line stays at least once. Ids must be integers. Defined results: words
    are what blanks separate; lines without words do not count in a run and go with the line
    before them; null text counts as empty; a null id comes after all others; of rows that
    share an id, different texts are different documents (in the order of a hash), and equal
    texts are one document seen twice, whose first occurrences stay in each; an empty table
    gives an empty table; other columns are ignored.
    """
    rows = _rows(docs, id_col, text_col)
    return _without(rows, _repeated_windows(rows, least_words), id_col)
