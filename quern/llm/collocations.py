"""Phrase collocations, counted level by level with hashed buckets.

A phrase of k words is frequent only if its first and its last k - 1 words are (the
Apriori rule), and only if the bucket that its hash falls in was counted often enough
while the texts were read for phrases of k - 1 words. So each pass over the texts does
two things: it counts the phrases of k words that both tests let through, exactly and by
their words, and it counts the phrases of k + 1 words into buckets. Then

* the buckets' counts of all tasks are added and become a bitmap (``BUCKETS`` bits),
* the frequent phrases of the pass become a bitmap of the same size (two bits each),

and both are broadcast to the next pass. Their size is fixed whatever the corpus holds; a
bitmap that fills up only lets more phrases through to the exact count, which decides.

Within a task, words get local numbers by their bytes, and a phrase's number comes from
the number of its first words and that of its last one: hashes serve the bitmaps alone,
and two phrases are never taken for one. Counts are combined per block of texts before
they are shuffled, so a frequent phrase costs one row per block.

Texts are trimmed as passes go on: from the second pass on, each writes only the words that
lie in a phrase which its tests let through, and the next pass reads these. Texts are thus
read whole twice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm._arrow import text_slices
from quern.session import materialize, ship_package, shuffle_partitions

#: What ends a piece, what parts words, and the language of rows without one.
ENDS, SPACES, NO_LANGUAGE = b".,;:!?\n\x0b\x0c\r", b" \t", "und"
#: Buckets of a pass, and how many of them travel in one row.
BUCKETS, BLOCK = 1 << 22, 1 << 16
#: Arrays of counts that one task adds up at a time.
FAN_IN = 64
#: Bytes of text that are counted together.
SLICE = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(ENDS)] = 2

_ROWS = "lang string, phrase string, n long, block int, counts binary, task int, text binary"
_SCHEMA = pa.schema(
    [("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("block", pa.int32()), ("counts", pa.binary()), ("task", pa.int32()), ("text", pa.binary())]
)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their first words and of their last word."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _word_hashes(lang: str, spelled: pa.Array) -> np.ndarray:
    """Hashes of the words of a language: sums of their bytes times powers of an odd number,
    which wrap around at 64 bits."""
    import xxhash

    offsets = np.frombuffer(spelled.buffers()[1], np.int64)[spelled.offset : spelled.offset + len(spelled) + 1]
    data = np.frombuffer(spelled.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    if not len(data):
        return np.zeros(len(spelled), np.uint64)
    starts, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    sums = np.add.reduceat((data + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(starts, lengths)], starts)
    return _mixed(sums, np.full(1, xxhash.xxh64_intdigest(lang), np.uint64))


class Bitmap:
    """Bits by hash; ``probes`` places are looked at for each."""

    def __init__(self, bits: np.ndarray, probes: int):
        self.bits, self.probes = bits, probes

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in places(hashes, 8 * len(self.bits), self.probes):
            found &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return found


def places(hashes: np.ndarray, buckets: int, probes: int = 1) -> list[np.ndarray]:
    return [((hashes >> np.uint64(27 * k)) % np.uint64(buckets)).astype(np.int64) for k in range(probes)]


class Words:
    """The words of a block of texts of one language: numbers by their bytes, in order, and
    which words are followed by another of their piece."""

    def __init__(self, lang: str, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        at = offsets - offsets[0]
        kind = _KIND[raw]
        inside = kind == 0
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = at[(at > 0) & (at < len(raw))]  # texts part words that touch
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
        starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.lang, self.letters, self.lengths = lang, _LOWER[raw[inside]], stops - starts
        coded = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(self.lengths)]), pa.py_buffer(self.letters)]
        ).dictionary_encode()
        self.number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.spelled = coded.dictionary
        self.hashes = _word_hashes(lang, self.spelled)
        ends = np.flatnonzero(kind == 2)
        last = np.searchsorted(stops, np.r_[ends, at[1:-1]], "right") - 1  # the last word before each end
        self.followed = np.ones(len(starts), bool)
        self.followed[-1:] = False
        self.followed[last[last >= 0]] = False

    def trimmed(self, kept: np.ndarray) -> bytes:
        """The kept words, spaces between those that follow each other and line ends elsewhere."""
        lengths = self.lengths[kept] + 1
        out = np.empty(int(lengths.sum()), np.uint8)
        ends = np.cumsum(lengths) - 1
        letters = np.ones(len(out), bool)
        letters[ends] = False
        out[letters] = self.letters[np.repeat(kept, self.lengths)]
        joined = self.followed & np.r_[kept[1:], False]
        out[ends] = np.where(joined[kept], 0x20, 0x0A)
        return out.tobytes()


@dataclass
class Level:
    """Phrases of one length in a block: each place's phrase number (-1: none or pruned), and
    of each phrase its hash and first place."""

    number: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def keep(self, wanted: np.ndarray) -> None:
        some = self.number >= 0
        self.number[some] = np.where(wanted[self.number[some]], self.number[some], -1)


def _first_places(numbers: np.ndarray, places_: np.ndarray, n: int) -> np.ndarray:
    first = np.zeros(n, np.int64)
    first[numbers[::-1]] = places_[::-1]
    return first


def first_level(words: Words) -> Level:
    n = len(words.spelled)
    return Level(words.number.copy(), words.hashes, _first_places(words.number, np.arange(len(words.number)), n))


def longer_places(words: Words, level: Level) -> np.ndarray:
    """Where a phrase of one word more may stand: both its parts are there."""
    some = level.number >= 0
    return np.flatnonzero(some[:-1] & some[1:] & words.followed[:-1])


def next_level(words: Words, level: Level, k: int) -> Level:
    """Phrases of ``k`` words from those of k - 1."""
    at = longer_places(words, level)
    last = words.number[at + k - 1]
    coded = pa.array(level.number[at] * max(len(words.spelled), 1) + last).dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full(len(words.number), -1, np.int64)
    out[at] = numbers
    first = _first_places(numbers, at, len(coded.dictionary))
    return Level(out, _mixed(level.hashes[level.number[first]], words.hashes[words.number[first + k - 1]]), first)


def _rows(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in _SCHEMA], schema=_SCHEMA)


def _block_rows(counts: np.ndarray, task: int):
    for block in range(0, len(counts), BLOCK):
        part = counts[block : block + BLOCK]
        if part.any():
            yield _rows(1, block=pa.array([block // BLOCK], pa.int32()), counts=pa.array([part.tobytes()], pa.binary()), task=pa.array([task], pa.int32()))


def by_language(batch: pa.RecordBatch):
    """The texts of a batch (language, text), a language at a time."""
    langs = pc.fill_null(batch.column(0), NO_LANGUAGE)
    for lang in langs.unique():
        yield lang.as_py(), batch.column(1).filter(pc.equal(langs, lang))


def count_pass(rows: DataFrame, k: int, filters, buckets, longest: int, least: int, n_buckets: int) -> DataFrame:
    """One pass: partial counts of phrases of ``k`` words, buckets for k + 1 words, and from
    the second pass on the trimmed texts.

    ``rows``: language and text. ``filters``: a broadcast list of bitmaps of the frequent
    phrases of 1 to k - 1 words; ``buckets``: a broadcast bitmap for k words (None at first).
    """
    kind = np.min_scalar_type(2 * least)

    def counted(words: Words, hot: np.ndarray):
        level = first_level(words)
        for j in range(2, k + 1):
            level.keep(filters.value[j - 2].has(level.hashes))
            level = next_level(words, level, j)
        if buckets is not None:
            level.keep(buckets.value.has(level.hashes))
        counts = np.bincount(level.number[level.number >= 0], minlength=len(level.hashes))
        seen = np.flatnonzero(counts)
        if len(seen):
            at = level.first[seen]
            parts = [words.spelled.take(pa.array(words.number[at + i])) for i in range(k)]
            phrases = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
            langs = pa.array([words.lang], pa.string()).take(pa.array(np.zeros(len(seen), np.int64)))
            yield _rows(len(seen), lang=langs, phrase=phrases.cast(pa.binary()).cast(pa.string()), n=pa.array(counts[seen], pa.int64()))
        if k == longest:
            return
        at = longer_places(words, level)
        if len(at) == 0:
            return
        hashes = _mixed(level.hashes[level.number[at]], words.hashes[words.number[at + k]])
        np.add.at(hot, places(hashes, n_buckets)[0], np.uint32(1))
        if k > 1:
            kept = np.zeros(len(words.number), bool)
            for i in range(k + 1):
                kept[at + i] = True
            yield _rows(1, lang=pa.array([words.lang], pa.string()), text=pa.array([words.trimmed(kept)], pa.binary()))

    def run(batches):
        hot = np.zeros(n_buckets, np.uint32)
        for batch in text_slices(batches, 1, SLICE):
            for lang, texts in by_language(batch):
                words = Words(lang, texts)
                if len(words.number):
                    yield from counted(words, hot)
        if k < longest:
            yield from _block_rows(np.minimum(hot, least).astype(kind), TaskContext.get().partitionId())

    return rows.mapInArrow(run, _ROWS)


def marked(frequent: DataFrame, k: int, n_buckets: int) -> DataFrame:
    """The places in a bitmap of the frequent phrases of ``k`` words, as block rows."""

    def run(batches):
        hot = np.zeros(n_buckets, np.uint8)
        for batch in batches:
            for lang, phrases in by_language(batch):
                words = pc.split_pattern(phrases.cast(pa.large_string()), " ")
                hashes = _word_hashes(lang, words.flatten().cast(pa.large_binary()))
                starts = np.asarray(words.offsets)[:-1] - np.asarray(words.offsets)[0]
                whole = hashes[starts]
                for i in range(1, k):
                    whole = _mixed(whole, hashes[starts + i])
                for at in places(whole, n_buckets, 2):
                    hot[at] = 1
        yield from _block_rows(hot, TaskContext.get().partitionId())

    return frequent.select("lang", "phrase").mapInArrow(run, _ROWS)


def bitmap(blocks: DataFrame, least: int, n_buckets: int, probes: int) -> Bitmap:
    """Add the tasks' counts, ``FAN_IN`` arrays at a time, and mark what reaches ``least``.

    A round leaves a row per block and ``FAN_IN`` tasks, so no group grows with the number
    of tasks. Only the finished bitmap comes to the driver."""
    kind = np.min_scalar_type(2 * least)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for x in table.column("counts"):
            part = np.frombuffer(x.as_buffer(), kind)
            total[: len(part)] += part
        found = np.minimum(total, least).astype(kind).tobytes()
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([found], pa.binary()), "task": pa.array([table.column("task")[0].as_py() // FAN_IN], pa.int32())})

    rows = blocks.filter("block is not null").select("block", "counts", "task")
    tasks = (rows.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        rows = rows.groupBy("block", F.floor(F.col("task") / FAN_IN).alias("_g")).applyInArrow(add, "block int, counts binary, task int")
        tasks = -(-tasks // FAN_IN)
        if tasks == 1:
            break
    pack = F.udf(lambda x: bytes(np.packbits(np.frombuffer(x, kind) >= least)), "binary")
    bits = np.zeros(-(-n_buckets // 8), np.uint8)
    for block, data in rows.select("block", pack("counts")).collect():
        part = np.frombuffer(data, np.uint8)
        start = block * BLOCK // 8
        bits[start : start + len(part)] = part[: len(bits) - start]
    return Bitmap(bits, probes)


def frequent_phrases(
    docs: DataFrame, lang_col: str, text_col: str, *, longest: int = 5, least: int = 100, n_buckets: int = BUCKETS
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of every phrase with at least ``least`` occurrences, and
    ``lang, n`` with the number of all word occurrences."""
    ship_package(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast
    rows = docs.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    filters: list[Bitmap] = []
    found, totals, buckets = [], None, None
    for k in range(1, longest + 1):
        known = share(filters)
        counted = materialize(count_pass(rows, k, known, None if buckets is None else share(buckets), longest, least, n_buckets), f"phrases-{k}")
        sums = counted.filter("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if k == 1:
            totals = materialize(counted.filter("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        frequent = materialize(sums.filter(F.col("f") >= least).select("lang", "phrase", F.lit(k).alias("words"), "f"), "frequent")
        found.append(frequent)
        if k < longest:
            filters = [*filters, bitmap(marked(frequent, k, n_buckets), 1, n_buckets, 2)]
            buckets = bitmap(counted, least, n_buckets, 1)
        if k > 1:
            rows = counted.filter("text is not null").select("lang", "text")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, totals


def best_of_each(rows: DataFrame, keys: list[str], order: list, k: int, spread_by: str) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``. Hot groups are cut in parts
    first, and these in 16: no task ranks a whole group or all its parts at once."""
    salts = shuffle_partitions(rows.sparkSession)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    for salt in (F.col("_salt"), F.col("_salt") % 16):
        window = Window.partitionBy(*keys, "_part").orderBy(*order)
        salted = salted.withColumn("_part", salt).withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).drop("rank", "_part")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return salted.drop("_salt").withColumn("rank", last.cast("long")).filter(F.col("rank") <= k)


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    *,
    longest: int = 5,
    least: int = 100,
    absorbed: int = 100,
    top: int = 2000,
    n_buckets: int = BUCKETS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``top`` phrases.

    Phrases of 2 to ``longest`` words with at least ``least`` occurrences are scored by their
    weakest cut: floor(1000 * a * n / (l * r)), in integers of up to 38 digits. One that lies
    within a longer candidate that has ``absorbed`` hundredths of its occurrences is dropped.

    Defined results: null text has no words; a null language is ``und``; repeated rows count
    as often as they occur; an empty table gives an empty table; ids and other columns are
    ignored. A text is never cut, so a very long one is one block. The rows are read once for
    each phrase length.
    """
    phrases, totals = frequent_phrases(docs, lang_col, text_col, longest=longest, least=least, n_buckets=n_buckets)
    candidates = phrases.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    left = F.expr("substring_index(phrase, ' ', k)")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn("_left", left)
    cuts = cuts.withColumn("_right", F.expr("substring(phrase, length(_left) + 2)"))
    count_of = lambda part, name: phrases.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias(name))
    for part, name in (("_left", "l"), ("_right", "r")):
        known = count_of(part, name)
        cuts = cuts.join(known, (cuts["lang"] == known["_lang"]) & (cuts[part] == known["_phrase"])).drop("_lang", "_phrase", part)
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * ({wide('a')} * {wide('n')})) div ({wide('l')} * {wide('r')})")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r", "n", "a")).alias("w")
    scored = cuts.join(totals, "lang").groupBy("lang", "phrase").agg(weakest).select("lang", "phrase", "w.*").drop("k")
    inner = F.expr(
        "flatten(transform(sequence(1, words), i -> transform(filter(sequence(2, words - 1), m -> i + m - 1 <= words),"
        " m -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    )
    held = candidates.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "a")
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    alone = scored.join(held, ["lang", "phrase"], "left").filter(f"_longer IS NULL OR 100 * _longer < {absorbed} * a").drop("_longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = best_of_each(materialize(alone, "scored"), ["lang"], order, top, "phrase")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
