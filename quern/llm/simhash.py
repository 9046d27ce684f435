"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints link if they differ in at most ``radius`` bits. If each of two keys is
within half the radius of a common variant, their balls meet there: every fingerprint
emits all variants within half the radius, variants are shuffled, and colliding pairs
are verified. The ball of radius 2 over 64 bits has 2,081 variants, far more data than
the documents themselves, so the ball is taken over two thirds of the bits: of two
fingerprints with at most 4 differing bits, one third has at least 2 of them, so without
it at most 2 are left, and there balls of radius 1 meet. Each third is left out in turn,
with 132 variants of 42 or 43 bits in all. No pair is lost; colliding pairs are verified
on all 64 bits. Chance collisions grow with the square of the number of fingerprints
over 2^42: below one per fingerprint up to some 10^9 distinct ones, about 4 at 10^10.

Equal fingerprints are one point: rows are first grouped by fingerprint. A variant that
more than ``hot`` fingerprints share is not compared pair by pair: its members emit their
full balls over 64 bits instead, where all members of a variant are within the radius of
each other by the triangle inequality and link to one of them. So no step emits the
pairs of a group, and the work per fingerprint has a bound.

Variants travel as packed arrays of 10 bytes each (the fingerprint and the number of the
flip, from which the variant is computed again), one row per task and bucket of variants.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._arrow import runs, text_slices
from quern.llm.components import components
from quern.llm.exact_dedup import drop_rows, text_digest
from quern.session import materialize, ship_package, shuffle_partitions

SEED = 42
_BLOCK = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """The 64-bit SimHash: a bit is 1 if set in over half of the shingles' XXH64.

    A-Z count as a-z; words are parted by ASCII white space; a text of fewer words than a
    shingle is one shingle, a text without words has fingerprint zero.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]].tolist()
    n = max(1, len(words) - shingle_words + 1)
    last = ends[min(shingle_words, len(words)) - 1 :] - 1
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    spans = list(zip(starts[:n], last.tolist()))
    for at in range(0, n, _BLOCK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in spans[at : at + _BLOCK]])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, digest: bool = False
) -> DataFrame:
    """``_id, _fp`` per row, the fingerprint as a signed long, and on demand ``_sha``, the text's digest."""
    ship_package(docs.sparkSession)
    more = [text_digest(F.col(text_col)).alias("_sha")] if digest else []
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *more)
    kind = rows.schema["_id"].dataType.simpleString()

    def compute(batches):
        for batch in text_slices(batches, 1):
            found = [fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()]
            column = pa.array(np.array(found, np.uint64).view(np.int64))
            own = [batch.column(2)] if digest else []
            names = ["_id", "_fp", "_sha"] if digest else ["_id", "_fp"]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, *own], names)

    return rows.mapInArrow(compute, f"_id {kind}, _fp long" + (", _sha string" if digest else ""))


def _masks(places, radius: int) -> np.ndarray:
    """All bit patterns of at most ``radius`` ones at the places."""
    ones = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(places, r)]
    return np.array(ones, np.uint64)


def _mixed(keys: np.ndarray) -> np.ndarray:
    """A bijection that spreads keys over buckets."""
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return keys ^ (keys >> np.uint64(29))


@dataclass(frozen=True)
class Ball:
    """Variants of a fingerprint: some of its bits, with each of the flips applied."""

    bits: np.uint64
    flips: np.ndarray

    def variants(self, fps: np.ndarray, flip: np.ndarray) -> np.ndarray:
        return (fps & self.bits) ^ self.flips[flip]


def part_balls(radius: int, parts: int = 3) -> list[Ball]:
    """Balls over the bits outside each of ``parts`` parts. Without the part that holds the
    most of at most ``radius`` differing bits, ``radius * (parts - 1) // parts`` are left at
    most, and half of that is the balls' radius."""
    reach = -(-(radius * (parts - 1) // parts) // 2)
    cuts = [64 * k // parts for k in range(parts + 1)]
    balls = []
    for low, high in zip(cuts, cuts[1:]):
        places = [b for b in range(64) if not low <= b < high]
        bits = np.uint64(sum(1 << b for b in places))
        balls.append(Ball(bits, _masks(places, reach)))
    return balls


def full_ball(radius: int) -> list[Ball]:
    return [Ball(np.uint64(0xFFFFFFFFFFFFFFFF), _masks(range(64), radius // 2))]


#: A variant: its fingerprint and the number of its flip.
VARIANT = np.dtype([("fp", "<u8"), ("flip", "<u2")])


def _emit(balls: list[Ball], buckets: int, at_once: int):
    """A function over batches of fingerprints that packs their variants by bucket; the
    buckets of ball k are k * buckets and following."""

    def emit(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                fps = batch.column(0).slice(start, at_once).to_numpy(zero_copy_only=False).view(np.uint64)
                for k, ball in enumerate(balls):
                    rows = np.zeros((len(fps), len(ball.flips)), VARIANT)
                    rows["fp"], rows["flip"] = fps[:, None], np.arange(len(ball.flips))
                    rows = rows.ravel()
                    bucket = (_mixed(ball.variants(rows["fp"], rows["flip"])) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    rows, bucket = rows[order], bucket[order]
                    a, b = runs(bucket)
                    packed = [rows[i:j].tobytes() for i, j in zip(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket[a] + k * buckets), pa.array(packed, pa.binary())], ["bucket", "packed"]
                    )

    return emit


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest node of its component, roots left out."""
    nodes, index = np.unique(np.r_[a, b], return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        least = np.minimum(label[left], label[right])
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _sorted_variants(ball: Ball, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The variants of a bucket in order, and their fingerprints."""
    rows = np.frombuffer(b"".join(table.column("packed").to_pylist()), VARIANT)
    fps = rows["fp"].copy()
    variants = ball.variants(fps, rows["flip"])
    order = np.lexsort((fps, variants))
    return variants[order], fps[order]


def _links(a: np.ndarray, b: np.ndarray, hot: np.ndarray) -> pa.Table:
    """Links between fingerprints (a > b as signed numbers), and members of hot variants."""
    m = len(hot)
    return pa.table(
        {
            "a": pa.array(np.r_[a.view(np.int64), hot.view(np.int64)]),
            "b": pa.array(np.r_[b.view(np.int64), np.zeros(m, np.int64)]),
            "hot": pa.array(np.r_[np.zeros(len(a), bool), np.ones(m, bool)]),
        }
    )


def _verify(balls: list[Ball], buckets: int, radius: int, hot: int):
    """Links of one bucket: colliding pairs that are near on all bits, as a forest; and
    the members of hot variants."""

    def verify(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        variants, fp = _sorted_variants(balls[key[0].as_py() // buckets], table)
        starts, ends = runs(variants)
        sizes = ends - starts
        members = np.unique(fp[np.repeat(sizes > hot, sizes)])
        at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= hot), sizes))
        left, right, step, held = [], [], 1, 0
        while len(at):
            at = at[at + step < len(fp)]
            at = at[variants[at] == variants[at + step]]
            near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
            left.append(fp[near].view(np.int64))
            right.append(fp[near + step].view(np.int64))
            step, held = step + 1, held + len(near)
            if held > 1 << 20:
                a, b = forest(np.concatenate(left), np.concatenate(right))
                left, right, held = [a], [b], 0
        none = np.zeros(0, np.int64)
        a, b = forest(np.concatenate(left), np.concatenate(right)) if left else (none, none)
        return _links(a, b, members)

    return verify


def _join_cliques(ball: Ball):
    def join(table: pa.Table) -> pa.Table:
        """All members of a full variant link to the first."""
        variants, fp = _sorted_variants(ball, table)
        starts, ends = runs(variants)
        first = np.repeat(starts, ends - starts)
        rest = np.flatnonzero(first != np.arange(len(fp)))
        a, b = forest(fp[rest].view(np.int64), fp[first[rest]].view(np.int64))
        return _links(a, b, fp[:0])

    return join


_LINKS = "a long, b long, hot boolean"


def links(points: DataFrame, radius: int = 4, hot: int = 4096, parts: int = 3) -> DataFrame:
    """``a, b`` (a > b): links whose components are those of all pairs of ``points``
    (``_fp``, distinct fingerprints) within ``radius`` bits. Nodes are fingerprints or, if
    the points have one, their ``_rep``."""
    if radius % 2 or radius < 2:
        raise ValueError("the radius must be even: two balls of half of it meet")
    spark = points.sparkSession
    fps, balls = points.select("_fp"), part_balls(radius, parts)
    buckets = max(shuffle_partitions(spark), points.count() * len(balls[0].flips) >> 18)
    found = materialize(
        fps.mapInArrow(_emit(balls, buckets, 4096), "bucket long, packed binary")
        .groupBy("bucket")
        .applyInArrow(_verify(balls, buckets, radius, hot), _LINKS),
        "near",
    )
    linked, members = found.filter("not hot").select("a", "b"), found.filter("hot").select("a").distinct()
    if not members.isEmpty():
        ball = full_ball(radius)
        full = (
            members.mapInArrow(_emit(ball, 8 * buckets, 256), "bucket long, packed binary")
            .groupBy("bucket")
            .applyInArrow(_join_cliques(ball[0]), _LINKS)
        )
        linked = linked.unionByName(full.select("a", "b"))
    linked = linked.distinct()
    if "_rep" not in points.columns:
        return linked
    linked = materialize(linked, "near")
    for end in ("a", "b"):  # from fingerprints to the points' ids
        ids = points.select(F.col("_fp").alias("_f"), F.col("_rep").alias("_id"))
        linked = linked.join(ids, linked[end] == ids["_f"]).drop(end, "_f").withColumnRenamed("_id", end)
    return linked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle_words: int = 4,
    radius: int = 4,
    hot: int = 4096,
) -> DataFrame:
    """``id, fingerprint, component_id`` per row; ids must be integers.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the
    smallest id reachable. Defined results: null and wordless texts have fingerprint zero
    and are linked like any other; rows with a null id have their fingerprint's component
    (null if no row of the fingerprint has an id); repeated rows repeat in the result; rows
    that share an id but not the text are each in their own fingerprint's component, which
    the id names without joining them; an empty table gives an empty table; other columns
    are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    return _classified(prints, radius, hot).select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"),
    )


def _classified(prints: DataFrame, radius: int, hot: int) -> DataFrame:
    """``prints`` with each row's ``_class``, the least fingerprint (as a signed number) of
    its component, and ``_component``, the component's smallest id. A fingerprint without
    any id links to nothing."""
    points = materialize(prints.groupBy("_fp").agg(F.min("_id").alias("_least")), "points")
    known = points.filter("_least is not null")
    roots = components(links(known.select("_fp"), radius, hot))
    nodes = materialize(
        points.join(roots, points["_fp"] == roots["node"], "left").select(
            "_fp", F.coalesce("root", "_fp").alias("_class"), "_least"
        ),
        "nodes",
    )
    # only components of several fingerprints need the least of their ids
    several = nodes.join(roots.select("root").distinct(), nodes["_class"] == F.col("root"), "left_semi")
    least = materialize(several.groupBy(F.col("_class").alias("_c")).agg(F.min("_least").alias("_component")), "least")
    classes = materialize(
        nodes.join(least, nodes["_class"] == least["_c"], "left").select(
            F.col("_fp").alias("_f"), "_class", F.coalesce("_component", "_least").alias("_component")
        ),
        "classes",
    )
    return prints.join(classes, prints["_fp"] == classes["_f"], "left").drop("_f")


def drop_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle_words: int = 4,
    radius: int = 4,
    hot: int = 4096,
) -> DataFrame:
    """``docs`` with one row of each component, one of the smallest id; all columns stay.

    Rows that share an id but not the text are told apart: of those that share the component's
    smallest id, the least text digest stays, and of rows that repeat id and text any one. Rows
    with a null id go with a component that has an id; where all ids of a fingerprint are null,
    one row of the fingerprint stays. An empty table stays empty.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle_words, digest=True), "fingerprints")
    pairs = materialize(
        _classified(prints, radius, hot).groupBy("_class", "_id", "_sha").agg(F.count(F.lit(1)).alias("_n")), "pairs"
    )
    first = F.struct(F.col("_id").isNull().alias("unknown"), F.col("_id").alias("id"), F.col("_sha").alias("sha"))
    winners = materialize(
        pairs.groupBy(F.col("_class").alias("_c")).agg(F.min(first).alias("_w"), F.sum("_n").alias("_rows")).filter("_rows > 1"),
        "winners",
    )
    stays = F.col("_id").eqNullSafe(F.col("_w.id")) & (F.col("_sha") == F.col("_w.sha"))
    verdicts = (
        pairs.join(winners, pairs["_class"] == winners["_c"])
        .filter(~stays | (F.col("_n") > 1))
        .select(F.col("_id").alias("_v_id"), F.col("_sha").alias("_v_sha"), stays.alias("_v_stays"))
    )
    return drop_rows(docs, verdicts, id_col, text_col)
