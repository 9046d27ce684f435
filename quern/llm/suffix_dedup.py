"""Removal of repeated byte strings with suffix arrays built by bucket-pointer refinement.

Every byte covered by a ``length``-byte window that also starts earlier (in an earlier
document, or earlier in the same one) is removed. The suffixes that matter are those that
may share a window with another:

1. *Anchors.* The anchor of a window is its q-gram of least hash, the leftmost of equals.
   Equal windows have equal q-grams at the same place, so the q-grams at anchors are the
   initial buckets of the refinement, and no repeat crosses two buckets. There are about
   2 / (length - q + 2) anchors per byte.
2. *Counting.* Anchors' hashes, packed and counted per group of documents, are counted
   over all groups; only q-grams that occur twice or more stay.
3. *Segments.* For each remaining anchor the bytes of its windows go to the anchor's
   bucket.
4. *Refinement.* A task sorts its buckets' suffixes: positions start in buckets of 8
   bytes; a bucket is refined by sorting its positions on the bucket identifiers at a
   later offset, and each round reuses the identifiers that the round before has updated,
   so the sorted depth doubles (8, 16, 32, ...) up to the window's length. Buckets of one
   are done and are not sorted again. Windows in one final bucket are equal byte for byte;
   all but the first are reported.
5. *Removal.* Reported windows go back to their documents.

Equal segments, which is what longer copies are made of, are reduced to the first before
refinement. Segments of a q-gram with more than ``hot`` occurrences are first reduced
within each group of documents; what is left of them is cut into *pieces* of at most
``_PIECE`` windows, which are bucketed by all bytes that these windows share, so a frequent
phrase in many contexts is dealt by its contexts. A piece that is the same everywhere
reaches a task once per group of documents, and from more than ``fan_in`` groups in two
steps: sets of groups first, then what each set has left. Arrays are packed into one row
per group and bucket, and long documents are read in blocks, so memory is bounded
everywhere.

Documents are known by a unique number in their order: the id or, where ids repeat or are
null, the row's place among all rows sorted by id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._arrow import runs
from quern.session import materialize, ship_package, shuffle_partitions

Q = 32  # bytes of a q-gram
_BLOCK = 1 << 20
_LOW = np.uint64((1 << 24) - 1)
_PIECE = 9  # windows of a hot q-gram that travel together
SEGMENT = np.dtype([("h", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("anchor", "<u4"), ("size", "<u4")])
WINDOWS = np.dtype([("doc", "<i8"), ("start", "<i8"), ("last", "<i8")])


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, as numbers whose order is the bytes' order."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    return x


def _qgram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``Q`` bytes from each place."""
    x = _words(data)
    n = len(data) - Q + 1
    h = x[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k, factor in enumerate((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93), 1):
        h ^= h >> np.uint64(32)
        h += x[8 * k : 8 * k + n]
        h *= np.uint64(factor)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _least_over(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, bounds: np.ndarray, length: int):
    """(hash, place, first window, last window) of the anchors of ``data``, where the
    documents lie between ``bounds``; a window never crosses a bound."""
    parts = []
    for low in range(0, len(data) - length + 1, _BLOCK):
        part = data[low : low + _BLOCK + length - 1]
        hashes = _qgram_hashes(part)
        places = np.arange(len(hashes), dtype=np.uint64)
        least = _least_over((hashes & ~_LOW) | places, length - Q + 1)
        at = (least & _LOW).astype(np.int64)
        windows = np.arange(len(at)) + low
        inside = windows + length <= bounds[np.searchsorted(bounds, windows, "right")]
        at, windows = at[inside], windows[inside]
        a, b = runs(at)
        if len(a):
            parts.append((hashes[at[a]], at[a] + low, windows[a], windows[b - 1]))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    h, place, first, last = (np.concatenate(x) for x in zip(*parts))
    a, b = runs(place)  # an anchor's windows may go on in the next block
    return h[a], place[a], first[a], last[b - 1]


class Group:
    """The documents of a group, in the order of their numbers, as one byte array."""

    def __init__(self, table: pa.Table):
        keys = table.column("_key").to_numpy()
        order = np.argsort(keys, kind="stable")
        texts = [(t or "").encode("utf-8") for t in table.column("_text").to_pylist()]
        self.keys = keys[order]
        self.ids = table.column("_id").take(pa.array(order)).combine_chunks()
        self.texts = [texts[k] for k in order.tolist()]
        self.bounds = np.cumsum([0, *map(len, self.texts)])
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, places, "right") - 1

    def anchors(self, length: int):
        return anchors(self.data, self.bounds, length)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes data[start : start + size], one after another."""
    offsets = np.cumsum(sizes) - sizes
    return data[np.arange(int(sizes.sum())) + np.repeat(starts - offsets, sizes)]


# --- counting ------------------------------------------------------------------------


def _count(length: int, buckets: int):
    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h, counts = np.unique(Group(table).anchors(length)[0], return_counts=True)
        bucket = _bucket(h, buckets)
        order = np.lexsort((counts > 1, bucket))
        h, counts, bucket = h[order], counts[order], bucket[order]
        rows = []
        for a, b in zip(*runs(bucket)):
            many = np.flatnonzero(counts[a:b] > 1)
            rows.append((int(bucket[a]), h[a:b].tobytes(), counts[a:b][many].astype("<u4").tobytes()))
        cells = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))] if rows else [
            pa.array([], t) for t in (pa.int64(), pa.binary(), pa.binary())
        ]
        group = pa.array([key[0].as_py()] * len(rows), pa.int64())
        return pa.Table.from_arrays([cells[0], group, cells[1], cells[2]], ["bucket", "g", "hashes", "counts"])

    return count


def _repeated(hot: int):
    def repeated(table: pa.Table) -> pa.Table:
        groups = table.column("g").to_numpy()
        parts = [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
        counts = []
        for part, cell in zip(parts, table.column("counts").to_pylist()):
            many = np.frombuffer(cell, "<u4")
            counts.append(np.r_[np.ones(len(part) - len(many), np.int64), many])
        h, n = np.concatenate(parts), np.concatenate(counts)
        source = np.repeat(np.arange(len(parts)), list(map(len, parts)))
        order = np.argsort(h, kind="stable")
        a, b = runs(h[order])
        total = np.repeat(np.add.reduceat(n[order], a), b - a)
        keep = total > 1
        source, h, is_hot = source[order][keep], h[order][keep], (total > hot)[keep]
        order = np.lexsort((h, is_hot, source))
        source, h, is_hot = source[order], h[order], is_hot[order]
        rows = {"g": [], "plain": [], "hot": []}
        for a, b in zip(*runs(source)):
            cut = a + int(np.searchsorted(is_hot[a:b], True))
            rows["g"].append(int(groups[source[a]]))
            rows["plain"].append(h[a:cut].tobytes())
            rows["hot"].append(h[cut:b].tobytes())
        return pa.table(
            [pa.array(rows["g"], pa.int64()), pa.array(rows["plain"], pa.binary()), pa.array(rows["hot"], pa.binary())],
            ["g", "plain", "hot"],
        )

    return repeated


# --- refinement ------------------------------------------------------------------------


def refined_buckets(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifiers of the places of ``data`` sorted by their next ``length`` bytes.

    ``ends`` is the end of the segment that each place lies in; places with fewer than
    ``length`` bytes to it keep the identifier of a smaller depth. Identifiers are the
    buckets' first positions in the (partial) suffix array.
    """
    q, n = 8, len(data)
    pointer = np.full(n, -1, np.int64)
    places = np.flatnonzero(np.arange(n) + q <= ends)
    if len(places) == 0:
        return pointer
    code = np.zeros(n, np.uint64)
    code[: n - q + 1] = _words(data)
    suffixes = places[np.argsort(code[places], kind="stable")]
    a, b = runs(code[suffixes])
    pointer[suffixes] = np.repeat(a, b - a)
    depth, active = q, suffixes[np.repeat(b - a > 1, b - a)]
    while depth < length and len(active):
        step = min(depth, length - depth)
        active = active[active + depth + step <= ends[active]]
        old, later = pointer[active], pointer[active + step]
        order = np.lexsort((later, old))
        active, old, later = active[order], old[order], later[order]
        a, b = runs(old * np.int64(n + 1) + later)
        bucket_start, _ = runs(old)
        first = bucket_start[np.searchsorted(bucket_start, a, "right") - 1]
        fresh = np.repeat(old[a] + a - first, b - a)
        pointer[active] = fresh
        active, depth = active[np.repeat(b - a > 1, b - a)], depth + step
    return pointer


def later_windows(meta: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the segments are equal to an earlier one.

    Returns the segment of each window and whether it has an earlier equal, in the
    segments' order. Segments with equal h may share windows, others do not.
    """
    sizes = meta["size"].astype(np.int64)
    offsets = np.cumsum(sizes) - sizes
    n_windows = sizes - length + 1
    whole = text.tobytes()
    content = [whole[a : a + n] for a, n in zip(offsets.tolist(), sizes.tolist())]
    by_content, _ = pd.factorize(np.array([*content, None], object)[:-1])
    # equal bytes, bucket and anchor: the same segment; its first occurrence represents it
    order = np.lexsort((meta["start"], meta["doc"], meta["anchor"], by_content, meta["h"]))
    h, c, anchor = meta["h"][order], by_content[order], meta["anchor"][order]
    first = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (anchor[1:] != anchor[:-1])]
    is_first = np.zeros(len(meta), bool)
    is_first[order[first]] = True
    segment = np.repeat(np.arange(len(meta)), n_windows)
    later = ~is_first[segment]
    # buckets that still hold two different segments are refined
    _, inverse, counts = np.unique(meta["h"][is_first], return_inverse=True, return_counts=True)
    chosen = np.flatnonzero(is_first)[counts[inverse] > 1]
    if len(chosen):
        kept_sizes = sizes[chosen]
        data = _gather(text, offsets[chosen], kept_sizes)
        ends = np.repeat(np.cumsum(kept_sizes), kept_sizes)
        pointer = refined_buckets(data, ends, length)
        places = np.flatnonzero(np.arange(len(data)) + length <= ends)
        owner = np.repeat(np.arange(len(chosen)), kept_sizes)[places]
        starts = np.cumsum(kept_sizes) - kept_sizes
        inner = places - starts[owner]
        chosen_meta = meta[chosen[owner]]
        order = np.lexsort((chosen_meta["start"] + inner, chosen_meta["doc"], pointer[places]))
        a, _ = runs(pointer[places][order])
        again = np.ones(len(places), bool)
        again[order[a]] = False
        window_offsets = np.cumsum(n_windows) - n_windows
        later[window_offsets[chosen[owner]] + inner] |= again
    return segment, later


def _as_ranges(meta: np.ndarray, segment: np.ndarray, chosen: np.ndarray, length: int) -> np.ndarray:
    """The chosen windows as ranges of starts, per segment."""
    n_windows = meta["size"].astype(np.int64) - length + 1
    inner = np.arange(len(segment)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = np.flatnonzero(chosen)
    breaks = np.r_[True, (segment[at][1:] != segment[at][:-1]) | (inner[at][1:] != inner[at][:-1] + 1)] if len(at) else []
    a = np.flatnonzero(breaks)
    b = np.r_[a[1:], len(at)].astype(np.int64)
    out = np.zeros(len(a), WINDOWS)
    out["doc"] = meta["doc"][segment[at[a]]]
    out["start"] = meta["start"][segment[at[a]]] + inner[at[a]]
    out["last"] = out["start"] + (b - a) - 1
    return out


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array ``of``."""
    if len(of) == 0:
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _hashes(text: np.ndarray, n: int, length: int) -> np.ndarray:
    """A hash of each of the ``n`` strings of ``length`` bytes laid one after another."""
    rows = np.zeros((n, -(-length // 8) * 8), np.uint8)
    rows[:, :length] = text.reshape(n, length)
    h = np.zeros(n, np.uint64)
    for column in rows.view("<u8").T:
        h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def pieces(meta: np.ndarray, segment: np.ndarray, chosen: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The chosen windows of the segments as pieces: runs of windows whose places before
    the anchor have the same quotient by ``_PIECE``. Equal windows are in pieces of one
    quotient, which share the bytes from ``quotient * _PIECE`` before the anchor on.

    Returns the pieces (``h`` not set yet, ``start`` as in ``meta``) and where these bytes
    begin.
    """
    n_windows = meta["size"].astype(np.int64) - length + 1
    inner = np.arange(len(segment)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = np.flatnonzero(chosen)
    owner, inner = segment[at], inner[at]
    before = meta["anchor"].astype(np.int64)[owner] - inner
    quotient = before // _PIECE
    if len(at):
        same = (owner[1:] == owner[:-1]) & (inner[1:] == inner[:-1] + 1) & (quotient[1:] == quotient[:-1])
        a = np.flatnonzero(np.r_[True, ~same])
    else:
        a = np.zeros(0, np.int64)
    n = np.diff(np.r_[a, len(at)])
    out = np.zeros(len(a), SEGMENT)
    out["doc"], out["start"] = meta["doc"][owner[a]], meta["start"][owner[a]] + inner[a]
    out["anchor"], out["size"] = before[a], n + length - 1
    return out, out["start"] + before[a] - quotient[a] * _PIECE


_SEGMENTS = "bucket long, g long, meta binary, bytes binary"


def _pack(meta: np.ndarray, text: np.ndarray, bucket: np.ndarray, g: np.ndarray, rows: list) -> None:
    """One row per bucket and group."""
    order = np.lexsort((g, bucket))
    sizes = meta["size"].astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    text = _gather(text, starts[order], sizes[order])
    meta, bucket, g, ends = meta[order], bucket[order], g[order], np.cumsum(sizes[order])
    if len(order):
        a = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (g[1:] != g[:-1])])
        for i, j in zip(a, np.r_[a[1:], len(order)]):
            low = int(ends[i] - meta["size"][i])
            rows.append((int(bucket[i]), int(g[i]), meta[i:j].tobytes(), text[low : int(ends[j - 1])].tobytes()))


def _as_table(rows: list) -> pa.Table:
    cells = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], ["bucket", "g", "meta", "bytes"])


def _segments(length: int, buckets: int, sets: int):
    """Segments of a group of documents by bucket. Pieces of hot q-grams have buckets of
    their own from ``buckets`` on, each ``sets`` times, one for each set of groups."""

    def segments(key: tuple[pa.Scalar, ...], docs: pa.Table, replies: pa.Table) -> pa.Table:
        g, rows = key[0].as_py(), []
        plain = np.sort(np.frombuffer(b"".join(replies.column("plain").to_pylist()), "<u8"))
        hot = np.sort(np.frombuffer(b"".join(replies.column("hot").to_pylist()), "<u8"))
        if docs.num_rows and len(plain) + len(hot):
            group = Group(docs)
            h, place, first, last = group.anchors(length)

            def cut(chosen):
                h_, place_, first_, last_ = h[chosen], place[chosen], first[chosen], last[chosen]
                meta = np.zeros(len(h_), SEGMENT)
                meta["h"], meta["anchor"] = h_, place_ - first_
                meta["doc"] = group.documents(first_)
                meta["start"] = first_  # within the group; both are made global below
                meta["size"] = last_ - first_ + length
                return meta, _gather(group.data, first_, meta["size"].astype(np.int64))

            def named(found: np.ndarray) -> np.ndarray:
                doc = found["doc"].copy()
                found["start"] -= group.bounds[doc]
                if "last" in found.dtype.names:
                    found["last"] -= group.bounds[doc]
                found["doc"] = group.keys[doc]
                return found

            if len(plain):
                meta, text = cut(np.flatnonzero(_member(h, plain)))
                _pack(named(meta), text, _bucket(meta["h"], buckets), np.full(len(meta), g), rows)
            if len(hot):
                meta, text = cut(np.flatnonzero(_member(h, hot)))
                segment, later = later_windows(meta, text, length)
                known = _as_ranges(meta, segment, later, length)
                if len(known):  # already known to be removed: passed on as they are
                    rows.append((g % buckets, g, b"", named(known).tobytes()))
                part, shared = pieces(meta, segment, ~later, length)
                common = length - _PIECE + 1
                part["h"] = _hashes(_gather(group.data, shared, np.full(len(part), common)), len(part), common)
                text = _gather(group.data, part["start"], part["size"].astype(np.int64))
                bucket = buckets + _bucket(part["h"], _HOT_BUCKETS * buckets) * sets + g % sets
                _pack(named(part), text, bucket, np.full(len(part), g), rows)
        return _as_table(rows)

    return segments


_HOT_BUCKETS = 16  # buckets of pieces for each plain one


def _refine(length: int, buckets: int, sets: int, last: bool):
    """Rows of a bucket to the removed windows of each group, in rows without ``meta``.
    Of a set's pieces, if another step follows, those with a window left go on."""

    def refine(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        rows, parts = [], []
        for g, meta, data in zip(*(table.column(c).to_pylist() for c in ("g", "meta", "bytes"))):
            if meta:
                parts.append((g, np.frombuffer(meta, SEGMENT), np.frombuffer(data, np.uint8)))
            else:
                rows.append((g % buckets, g, b"", data))
        if parts:
            meta = np.concatenate([p[1] for p in parts])
            text = np.concatenate([p[2] for p in parts])
            segment, later = later_windows(meta, text, length)
            cuts = np.cumsum([0, *(len(p[1]) for p in parts)])
            n_windows = meta["size"].astype(np.int64) - length + 1
            ends = np.r_[0, np.cumsum(n_windows)]
            for k, (g, own, _) in enumerate(parts):
                low, high = int(ends[cuts[k]]), int(ends[cuts[k + 1]])
                ranges = _as_ranges(own, segment[low:high] - cuts[k], later[low:high], length)
                if len(ranges):
                    rows.append((g % buckets, g, b"", ranges.tobytes()))
            if not last and bucket >= buckets:
                stays = np.add.reduceat(~later, ends[:-1]) > 0
                sizes = meta["size"].astype(np.int64)
                text = _gather(text, (np.cumsum(sizes) - sizes)[stays], sizes[stays])
                group = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])[stays]
                _pack(meta[stays], text, np.full(int(stays.sum()), buckets + (bucket - buckets) // sets * sets), group, rows)
        return _as_table(rows)

    return refine


# --- removal ------------------------------------------------------------------------


def _removed_runs(ranges: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows cover, from ranges of one document."""
    out: list[tuple[int, int]] = []
    for start, last in sorted(zip(ranges["start"].tolist(), ranges["last"].tolist())):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], last + length)
        else:
            out.append((start, last + length))
    return out


def _remove(length: int):
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def remove(docs: pa.Table, removals: pa.Table) -> pa.Table:
        group = Group(docs) if docs.num_rows else None
        n_bytes, n_removed, n_spans, digests, kept, spans = [], [], [], [], [], []
        ranges = np.frombuffer(b"".join(removals.column("bytes").to_pylist()), WINDOWS)
        ranges = ranges[np.lexsort((ranges["start"], ranges["doc"]))]
        for k, text in enumerate(group.texts if group else ()):
            low, high = (np.searchsorted(ranges["doc"], group.keys[k], side) for side in ("left", "right"))
            cut = _removed_runs(ranges[low:high], length)
            parts, at = [], 0
            for a, b in cut:
                parts.append(text[at:a])
                at = b
            parts.append(text[at:])
            rest = b"".join(parts)
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(rest))
            n_spans.append(len(cut))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
            spans.append([{"start": a, "stop": b} for a, b in cut])
        return pa.Table.from_arrays(
            [
                group.ids if group else pa.array([], pa.int64()),
                *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)),
                pa.array(digests, pa.string()),
                pa.array(spans, pa.list_(span)),
                pa.array(kept, pa.binary()),
            ],
            ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
        )

    return remove


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (``_id, _text``) with ``_key``, a unique number in the order of the ids.

    Where no id repeats or is null it is the id. Else rows are sorted by id (null first),
    hash of the text and a number of the row as it was read, so that a range of equal ids
    can part, and their place in that order is the key; the sorted rows are written once.
    """
    repeated = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or _id is null")
    if repeated.isEmpty():
        return rows.withColumn("_key", F.col("_id"))
    order = ["_id", "_h", "_n"]
    marked = rows.select("_id", "_text", F.xxhash64("_text").alias("_h"), F.monotonically_increasing_id().alias("_n"))
    most = shuffle_partitions(rows.sparkSession)
    ordered = marked.repartitionByRange(most, *order).sortWithinPartitions(*order)
    return materialize(ordered.select("_id", "_text", F.monotonically_increasing_id().alias("_key")), "numbered")


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    length: int = 100,
    hot: int = 1 << 14,
    group_bytes: int = 2 << 20,
    fan_in: int = 1 << 16,
) -> DataFrame:
    """Per row: ``id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept`` where
    ``spans`` are the maximal removed runs in bytes and ``kept`` the remaining bytes.

    Ids must be integers. Defined results: null text counts as empty; texts shorter than
    ``length`` lose nothing; a null id comes before all others; rows that repeat an id are
    taken one after another, in the order of a hash of their texts, and are dealt like any
    others; an empty table gives an empty table; other columns are ignored.

    ``hot`` bounds what a task holds of one q-gram (about 200 bytes for each occurrence) and
    ``fan_in`` from how many groups of about ``group_bytes`` a task takes the same piece;
    neither changes the result.
    """
    if length < Q + 8:
        raise ValueError(f"windows need at least {Q + 8} bytes")
    spark = docs.sparkSession
    ship_package(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = numbered(docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text")))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    least = shuffle_partitions(spark)
    groups = max(least, size // group_bytes)
    buckets = max(least, size * 2 // (length - Q + 2) >> 17)
    sets = -(-groups // fan_in)
    dealt = rows.select(F.pmod(F.xxhash64("_key"), F.lit(groups)).alias("g"), "_id", "_key", "_text")
    counted = dealt.groupBy("g").applyInArrow(
        _count(length, buckets), "bucket long, g long, hashes binary, counts binary"
    )
    replies = counted.groupBy("bucket").applyInArrow(_repeated(hot), "g long, plain binary, hot binary")
    segments = dealt.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(_segments(length, buckets, sets), _SEGMENTS)
    ranges = segments.groupBy("bucket").applyInArrow(_refine(length, buckets, sets, sets == 1), _SEGMENTS)
    if sets > 1:
        ranges = ranges.groupBy("bucket").applyInArrow(_refine(length, buckets, 1, True), _SEGMENTS)
    schema = (
        "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<start:bigint,stop:bigint>>, kept binary"
    )
    return (
        dealt.groupBy("g")
        .cogroup(ranges.select("g", "bytes").groupBy("g"))
        .applyInArrow(_remove(length), schema)
        .withColumnRenamed("_id", id_col)
    )
