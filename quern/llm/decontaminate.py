"""Benchmark decontamination with training suffix arrays.

The training documents are cut into shards (the Arrow pieces of each task). A shard gets
a suffix array over its words; every test suffix that starts a window is binary-searched
in it, which gives the range of training suffixes that share the window. Windows on one
diagonal are joined to the longest verbatim matches with their places in both texts; a
document's hit words are those its matches cover, and documents that they cover by more
than a share are removed.

Only suffixes that could match are sorted and searched: windows of both sides are hashed
(a rolling hash over word hashes, all of them in a few array operations), and a suffix or
window whose hash the other side lacks has no match. This loses nothing, and what is left
is compared by its words.

The benchmark travels to the tasks in blocks of at most ``block_bytes`` of text (the
size is checked while the items are read, never assumed; a task holds about six times
that). One block is the usual case and needs no shuffle at all; for more, the driver reads
one block at a time, each is one pass whose matches are written, and the passes' matches
are merged per document.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._arrow import text_slices
from quern.session import materialize, ship_package

#: A-Z to lower case; everything but digits, letters and bytes from 0x80 to a space.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_BLOCK = 1 << 20  # bytes whose words are hashed at once
_PAIRS = 1 << 21  # pairs of places that are joined to matches at once
_BASE = 0x9E3779B97F4A7C15
MATCH = np.dtype([(name, np.int64) for name in ("doc", "item", "doc_word", "item_word", "n_words")])


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: lower-cased runs of digits, letters and non-ASCII characters."""
    return text.encode("utf-8").translate(_WORD_BYTES).split() if text else []


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2^64."""
    step = np.full(n, _BASE, np.uint64)
    back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    step[:1] = back[:1] = 1
    return np.cumprod(step), np.cumprod(back)


class Words:
    """The words of some texts: places in ``data`` and the text that each is in."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode("utf-8").translate(_WORD_BYTES) for t in texts]
        self.data = b" ".join([*parts, b""])
        inside = np.frombuffer(self.data, np.uint8) != 0x20
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.r_[0, edges]
        self.starts, self.ends = edges[::2], edges[1::2]
        #: the number of the first word of each text, and the number of words
        self.first = np.searchsorted(self.starts, np.cumsum([0, *(len(p) + 1 for p in parts)]))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, word: int, n: int) -> bytes:
        """``n`` words from one on, each with a space behind it."""
        return b" ".join([*self.data[self.starts[word] : self.ends[word + n - 1]].split(), b""])

    def hashes(self) -> np.ndarray:
        data, out, at = np.frombuffer(self.data, np.uint8), np.zeros(len(self), np.uint64), 0
        while at < len(self):
            low = int(self.starts[at])
            end = max(at + 1, int(np.searchsorted(self.ends, low + _BLOCK, "right")))
            part = data[low : int(self.ends[end - 1])].astype(np.uint64)
            step, back = _powers(max(_BLOCK, len(part)))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part + np.uint64(1)) * step[: len(part)], out=sums[1:])
            a, b = self.starts[at:end] - low, self.ends[at:end] - low
            h = (sums[b] - sums[a]) * back[a]
            out[at:end], at = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93), end
        return out ^ (out >> np.uint64(29))

    def windows(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """A hash of the ``n`` words from each word on."""
        count = max(0, len(hashes) - n + 1)
        out = hashes[:count].copy()
        for k in range(1, n):
            out *= np.uint64(_BASE)
            out += hashes[k : k + count]
        return out ^ (out >> np.uint64(31))

    def within(self, n: int) -> np.ndarray:
        """Whether the ``n`` words from each word on are in one text."""
        count = max(0, len(self) - n + 1)
        return self.doc[:count] == self.doc[n - 1 : n - 1 + count]


class TestWindows:
    """The windows of a block of benchmark items, ordered by hash."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int = 13):
        self.items = [i for i, _ in items]
        self.words = Words([t for _, t in items])
        size = np.minimum(window, np.diff(self.words.first))
        hashes = self.words.hashes()
        #: (words of a window, hashes in order, first words in the same order, which high bits occur)
        self.searches = []
        for n in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(self.words.within(n))
            at = at[size[self.words.doc[at]] == n]
            h = self.words.windows(hashes, n)[at]
            order = np.argsort(h, kind="stable")
            bits = int(np.clip(len(h) * 16, 1 << 10, 1 << 24)).bit_length() - 1
            high = np.zeros(1 << bits, bool)
            high[h >> np.uint64(64 - bits)] = True
            self.searches.append((n, h[order], at[order].astype(np.int32), high))

    def find(self, shard: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each window with occurrences: its size, its places here and those in the shard."""
        hashes = shard.hashes()
        for n, known, at, high in self.searches:
            h, shift = shard.windows(hashes, n), np.uint64(64 - (len(high).bit_length() - 1))
            chosen = np.flatnonzero(high[h >> shift] & shard.within(n))
            low = np.searchsorted(known, h[chosen])
            chosen = chosen[known[np.minimum(low, len(known) - 1)] == h[chosen]]
            if len(chosen) == 0:
                continue
            keys = [shard.text(k, n) for k in chosen.tolist()]
            order = sorted(range(len(keys)), key=keys.__getitem__)  # the suffix array of what may match
            suffixes, keys = chosen[order], [keys[k] for k in order]
            for value in np.unique(h[chosen]):
                windows: dict[bytes, list[int]] = {}
                for k in at[np.searchsorted(known, value, "left") : np.searchsorted(known, value, "right")].tolist():
                    windows.setdefault(self.words.text(k, n), []).append(k)
                for text, own in windows.items():
                    a, b = bisect_left(keys, text), bisect_right(keys, text)
                    if a < b:
                        yield n, np.array(own, np.int64), suffixes[a:b]


def shard_matches(tests: TestWindows, texts: list[str | None]) -> tuple[Words, Iterator[np.ndarray]]:
    """The shard's words and its longest verbatim matches of at least one window: arrays of
    ``MATCH``, ordered by document, each document in one array."""
    shard = Words(texts)
    found = list(tests.find(shard))
    weight = np.zeros(len(texts), np.int64)
    for _, own, places in found:
        np.add.at(weight, shard.doc[places], len(own))
    turn = np.cumsum(weight) // _PAIRS

    def joined(low: int, high: int) -> np.ndarray:
        parts = []
        for n, own, places in found:
            places = places[(shard.doc[places] >= low) & (shard.doc[places] < high)]
            parts.append((np.tile(own, len(places)), np.repeat(places, len(own)), np.full(len(own) * len(places), n)))
        own, place, size = (np.concatenate(x) for x in zip(*parts))
        doc, item = shard.doc[place], tests.words.doc[own]
        start, inner = place - shard.first[doc], own - tests.words.first[item]
        order = np.lexsort((start, start - inner, item, doc))
        doc, item, start, inner, size = (x[order] for x in (doc, item, start, inner, size))
        go_on = (np.diff(doc) == 0) & (np.diff(item) == 0) & (np.diff(start) == 1) & (np.diff(inner) == 1)
        a = np.flatnonzero(np.r_[True, ~go_on])
        out = np.zeros(len(a), MATCH)
        for name, column in zip(MATCH.names, (doc, item, start, inner)):
            out[name] = column[a]
        out["n_words"] = np.diff(np.r_[a, len(doc)]) + size[a] - 1
        return out

    def each() -> Iterator[np.ndarray]:
        hit = np.flatnonzero(weight)
        for t in np.unique(turn[hit]).tolist():
            own = hit[turn[hit] == t]
            yield joined(int(own[0]), int(own[-1]) + 1)

    return shard, each()


def covered(matches: np.ndarray) -> list[tuple[int, int]]:
    """The words that a document's matches cover, as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(zip(matches["doc_word"].tolist(), matches["n_words"].tolist())):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], a + n)
        else:
            out.append((a, a + n))
    return out


def longest(matches: np.ndarray, items: list[str]) -> tuple[int, int, str, int]:
    """(words, first word in the document, item, first word in the item) of the longest
    match; of equals the first in the document, of the least item id, first in the item."""
    best = matches[matches["n_words"] == matches["n_words"].max()]
    best = best[best["doc_word"] == best["doc_word"].min()]
    item, at = min((items[k], j) for k, j in zip(best["item"].tolist(), best["item_word"].tolist()))
    return int(best["n_words"][0]), int(best["doc_word"][0]), item, at


def by_document(tests: TestWindows, texts: list[str | None]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Each text's number of words, and the matches of each text that has some."""
    shard, arrays = shard_matches(tests, texts)
    found = {}
    for array in arrays:
        cuts = np.flatnonzero(np.r_[True, np.diff(array["doc"]) != 0, True])
        for a, b in zip(cuts, cuts[1:]):
            found[int(array["doc"][a])] = array[a:b]
    return np.diff(shard.first), found


def benchmark_blocks(
    benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int
) -> Iterator[TestWindows]:
    """The benchmark read item by item into blocks of bounded size, one at a time."""
    ship_package(benchmark.sparkSession)
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    for row in rows.toLocalIterator():
        grown = len((row.t or "").encode("utf-8"))
        if size and size + grown > block_bytes:
            yield TestWindows(block, window)
            block, size = [], 0
        block.append((str(row.i), row.t))
        size += grown
    yield TestWindows(block, window)


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode("utf-8")).hexdigest()


_LONGEST = "longest_words long, longest_at long, longest_item string, longest_item_at long"
_VERDICT = f"n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, {_LONGEST}"


def _verdict(n_words: int, matches: np.ndarray | None, items: list[str], share: int) -> tuple:
    if matches is None:
        return n_words, 0, 0, _digest(set()), False, 0, None, None, None
    n_hit = sum(b - a for a, b in covered(matches))
    own = {items[k] for k in np.unique(matches["item"]).tolist()}
    return n_words, n_hit, len(own), _digest(own), share * n_hit >= n_words, *longest(matches, items)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    window: int = 13,
    share: int = 20,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """``id, n_words, n_hit, n_items, items_sha256, contaminated`` per row of ``docs``, and of
    its longest verbatim match ``longest_words`` (0 without one), ``longest_at`` (first word
    in the document, from 0), ``longest_item`` and ``longest_item_at``.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not
    none, is one window. A document is contaminated if it has hit words and they are at
    least 1/``share`` of its words. Defined results: null or wordless texts have no
    words and are clean; null or wordless items have no windows; a null item id is the item
    ``None``; repeated items count by their ids; rows with a null id and repeated rows are
    judged like any others; an empty benchmark hits nothing; an empty table gives an empty
    table; other columns are ignored.
    """
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    tests, more = next(blocks), next(blocks, None)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    if more is None:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        names = [part.split()[0] for part in _VERDICT.split(", ")]

        def judge(batches):
            for batch in text_slices(batches, 1):
                n_words, found = by_document(tests, batch.column(1).to_pylist())
                rows = [_verdict(int(n), found.get(k), tests.items, share) for k, n in enumerate(n_words)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_id", *names])

        return rows.mapInArrow(judge, f"_id {kind}, {_VERDICT}").withColumnRenamed("_id", id_col)

    text = F.coalesce("_text", F.lit(""))
    rows = rows.withColumn("_key", F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), F.sha2(text, 256)))
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def one_pass(tests: TestWindows, number: int) -> DataFrame:
        def hit(batches):
            for batch in text_slices(batches, 1):
                _, found = by_document(tests, batch.column(1).to_pylist())
                some = sorted(found)
                best = list(zip(*(longest(found[k], tests.items) for k in some))) or [[]] * 4
                items = [sorted({tests.items[i] for i in np.unique(found[k]["item"]).tolist()}) for k in some]
                spans = [[dict(zip(("start", "stop"), s)) for s in covered(found[k])] for k in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(2).take(pa.array(some, pa.int64())),
                        pa.array(spans, pa.list_(span)),
                        pa.array(items, pa.list_(pa.string())),
                        *(pa.array(c, t) for c, t in zip(best, (pa.int64(), pa.int64(), pa.string(), pa.int64()))),
                    ],
                    ["_key", "_spans", "_items", "longest_words", "longest_at", "longest_item", "longest_item_at"],
                )

        schema = f"_key string, _spans array<struct<start:bigint,stop:bigint>>, _items array<string>, {_LONGEST}"
        # equal rows repeat the same matches: one of them is enough
        return materialize(rows.mapInArrow(hit, schema).dropDuplicates(["_key"]), "matches").withColumn("_pass", F.lit(number))

    passes, number = one_pass(tests, 0), 0
    while more is not None:
        number += 1
        passes, tests = passes.unionByName(one_pass(more, number)), None
        more = next(blocks, None)
    order = F.struct(
        (-F.col("longest_words")).alias("n"), F.col("longest_at").alias("at"), F.col("longest_item").alias("item"),
        F.col("longest_item_at").alias("item_at"),
    )
    # one row per pass and document
    merged = passes.groupBy("_key").agg(
        F.array_sort(F.flatten(F.collect_list("_spans"))).alias("_spans"),
        F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"),
        F.min(order).alias("_best"),
    )

    def count(batches):
        for batch in text_slices(batches, 1):
            n = pa.array(np.diff(Words(batch.column(1).to_pylist()).first), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["_id", "_key", "n_words"])

    counted = rows.mapInArrow(count, f"_id {kind}, _key string, n_words long")
    zero = F.lit(0).cast("long")
    state = F.struct(zero.alias("n"), zero.alias("end"))
    n_hit = F.aggregate(
        F.coalesce("_spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")),
        state,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["stop"] - F.greatest(x["start"], s["end"]), zero)).alias("n"),
            F.greatest(s["end"], x["stop"]).alias("end"),
        ),
        lambda s: s["n"],
    )
    items = F.coalesce("_items", F.array().cast("array<string>"))
    hits = counted.join(merged, "_key", "left").withColumn("n_hit", n_hit)
    return hits.select(
        F.col("_id").alias(id_col),
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
        F.coalesce(-F.col("_best.n"), zero).alias("longest_words"),
        F.col("_best.at").alias("longest_at"),
        F.col("_best.item").alias("longest_item"),
        F.col("_best.item_at").alias("longest_item_at"),
    )


def verbatim_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    window: int = 13,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """The longest verbatim matches: ``id, item_id, doc_word, item_word, n_words``, with
    places counted in words from 0. Nulls and empty texts match nothing; repeated rows and
    rows with a null id have their matches like any others; an empty table or benchmark
    gives an empty table. Of several blocks, each one's matches are written."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["_id", "item_id", "doc_word", "item_word", "n_words"]

    def one_pass(tests: TestWindows) -> DataFrame:
        def match(batches):
            for batch in text_slices(batches, 1):
                for found in shard_matches(tests, batch.column(1).to_pylist())[1]:
                    item = [tests.items[k] for k in found["item"].tolist()]
                    places = [pa.array(found[c]) for c in ("doc_word", "item_word", "n_words")]
                    own = batch.column(0).take(pa.array(found["doc"]))
                    yield pa.RecordBatch.from_arrays([own, pa.array(item, pa.string()), *places], names)

        return rows.mapInArrow(match, f"_id {kind}, item_id string, doc_word long, item_word long, n_words long")

    blocks = benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    out, more = one_pass(next(blocks)), next(blocks, None)
    if more is not None:
        out = materialize(out, "matches")
    while more is not None:
        out, more = out.unionByName(materialize(one_pass(more), "matches")), next(blocks, None)
    return out.withColumnRenamed("_id", id_col)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    window: int = 13,
    share: int = 20,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """``docs`` without the contaminated rows, all columns as they were.

    With one benchmark block this is one map without a shuffle. Texts that are null or
    without words stay, whatever their ids; repeated rows go or stay together; an empty
    table stays empty.
    """
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    tests = next(blocks)
    if next(blocks, None) is None:
        at = docs.columns.index(text_col)

        def keep(batches):
            for batch in text_slices(batches, at):
                n_words, found = by_document(tests, batch.column(at).to_pylist())
                hit = {k: sum(b - a for a, b in covered(m)) for k, m in found.items()}
                clean = [k not in hit or share * hit[k] < n for k, n in enumerate(n_words.tolist())]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return docs.mapInArrow(keep, docs.schema)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(F.sha2(text, 256).alias("_sha"), text.alias("_text"))
    judged = contamination(
        named, benchmark, "_sha", "_text", item_col, item_text_col, window=window, share=share, block_bytes=block_bytes
    )
    gone = materialize(judged.filter("contaminated").select("_sha").distinct(), "gone")
    return docs.join(gone, F.sha2(text, 256) == gone["_sha"], "left_anti")
