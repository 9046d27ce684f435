"""Vector search: exact cosine neighbours of a stated set of queries."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.vector import cosine, dimension_problem, norm
from quern.operators.filters import SCORE_THRESHOLD
from quern.operators.ranking import top_k
from quern.session import ship_package, spread

#: Queries per pass, and bytes of their vectors; a pass's queries are broadcast.
BLOCK, BLOCK_BYTES = 16_384, 16 << 20
#: Pairs of a product of matrices, pairs that are scored exactly at once, hits that are held uncut.
TILE, EXACT, HELD = 1 << 21, 1 << 16, 1 << 20
#: How far a product of matrices may be from the sum from left to right, at most.
NEAR = 1e-9


def cosine_scores(
    records: DataFrame,
    queries: DataFrame,
    *,
    record: str = "record_id",
    vector: str = "vector",
    query: str = "query_id",
    query_vector: str = "query_vector",
    broadcast: bool = False,
) -> DataFrame:
    """``query, record, score`` of every pair of equal dimensions: the stated query set
    against all records. Norms are computed once per row, before the pairing. ``broadcast``
    is for queries whose number and size the caller has checked."""
    left = records.select(F.col(record).alias("_record"), F.col(vector).alias("_v"), norm(F.col(vector)).alias("_vn"))
    right = queries.select(
        F.col(query).alias("_query"), F.col(query_vector).alias("_q"), norm(F.col(query_vector)).alias("_qn")
    )
    if broadcast:
        right = F.broadcast(right)
    pairs = left.join(right, (F.size("_v") == F.size("_q")) & (F.size("_v") > 0))
    score = cosine(F.col("_v"), F.col("_q"), F.col("_vn"), F.col("_qn"))
    return pairs.select(F.col("_query").alias(query), F.col("_record").alias(record), score.alias("score"))


def nearest(
    records: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    least: float | None = SCORE_THRESHOLD,
    record: str = "record_id",
    vector: str = "vector",
    query: str = "query_id",
    query_vector: str = "query_vector",
    block: int = BLOCK,
    digits: int | None = None,
) -> DataFrame:
    """The ``k`` nearest records of each query, with ``rank``; none below ``least``. Scores may
    be rounded to ``digits`` before they are ranked.

    More than ``block`` queries, or ``BLOCK_BYTES`` of vectors, are taken in blocks (by a hash
    of the query), each sent to all tasks. A task multiplies its records with a block as
    matrices, scores exactly what may be among the best ``k``, and passes on these alone.
    Vectors with nulls, NaN or extreme values are paired one by one.
    """
    odd_query, odd_record = _odd(F.col(query_vector)), _odd(F.col(vector))
    found = queries.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.size(query_vector), F.lit(0))).alias("values"), F.count_if(odd_query).alias("odd")
    ).first()
    blocks = max(1, -(-found.n // block), -(-8 * (found["values"] or 0) // BLOCK_BYTES))
    if blocks == 1:
        parts = [queries]
    else:
        numbered = F.pmod(F.xxhash64(query), F.lit(2 * blocks))
        parts = [queries.filter(numbered == i) for i in range(2 * blocks)]
    names = {"record": record, "vector": vector, "query": query, "query_vector": query_vector}
    odd = not records.filter(odd_record).isEmpty()
    plain = records.filter(~odd_record) if odd else records
    out = None
    for part in parts:
        scored = [_best_scores(plain, part.filter(~odd_query) if found.odd else part, k, least, digits, **names)]
        if odd:
            scored.append(_paired(records.filter(odd_record), part, least, digits, **names))
        if found.odd:
            scored.append(_paired(plain, part.filter(odd_query), least, digits, **names))
        for one in scored:
            out = one if out is None else out.unionByName(one)
    return top_k(out, k, by=(query,), tie=record)


def _odd(vector: Column) -> Column:
    """Whether a vector has a value for which products of matrices are no guide."""
    usual = lambda x: (x == 0) | F.abs(x).between(1e-100, 1e100)
    return F.coalesce(F.exists(vector, lambda x: ~F.coalesce(usual(x), F.lit(False))), F.lit(False))


def _paired(records: DataFrame, queries: DataFrame, least: float | None, digits: int | None, **names: str) -> DataFrame:
    scored = cosine_scores(records, queries, **names, broadcast=True)
    if least is not None:
        scored = scored.filter(F.col("score") >= least)
    return scored if digits is None else scored.withColumn("score", F.round("score", digits))


class Best:
    """The best ``k`` records of each query (by its number) so far: score descending, ties by
    the smaller record."""

    def __init__(self, queries: int, k: int):
        self.k, self.parts, self.size = k, [], 0
        #: the score of the k-th record; minus infinity while there are fewer
        self.worst = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, record: pa.Array, score: np.ndarray) -> None:
        if len(query):
            self.parts.append(pa.table([pa.array(query, pa.int32()), record, pa.array(score)], ["_query", "_record", "score"]))
            self.size += len(query)
            if self.size > 2 * HELD:
                self.cut()

    def cut(self) -> pa.Table | None:
        if not self.parts:
            return None
        if len(self.parts) > 1 or self.parts[0].num_rows == self.size:
            rows = pa.concat_tables(self.parts)
            rows = rows.take(pc.sort_indices(rows, [("_query", "ascending"), ("score", "descending"), ("_record", "ascending")])).combine_chunks()
            query = rows["_query"].to_numpy()
            starts = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
            rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
            last = rank == self.k - 1
            self.worst[query[last]] = rows["score"].to_numpy()[last]
            self.parts = [rows.filter(pa.array(rank < self.k))]
        self.size = 0
        return self.parts[0]


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(x * x, axis=1)[:, -1])


def _rounded(score: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, by the number's decimal digits, as Spark rounds."""
    scaled = np.abs(score) * 10.0**digits
    out = np.sign(score) * np.floor(scaled + 0.5) / 10.0**digits
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(score[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _best_scores(
    records: DataFrame, queries: DataFrame, k: int, least: float | None, digits: int | None, *, record: str, vector: str, query: str, query_vector: str
) -> DataFrame:
    """``query, record, score`` of the best ``k`` of each task; scores as ``cosine_scores`` has
    them, added from left to right."""
    spark = records.sparkSession
    ship_package(spark)
    usable = lambda df, c: df.filter(F.size(c) > 0)
    asked = usable(queries, query_vector).select(F.col(query).alias("_q"), F.col(query_vector).cast("array<double>").alias("_v")).toArrow().combine_chunks()
    sizes = pc.list_value_length(asked["_v"]).to_numpy() if asked.num_rows else np.zeros(0, int)
    known = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        q = asked["_v"].take(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        known[int(d)] = (at, q, _norms(q))
    shared = spark.sparkContext.broadcast((asked["_q"].combine_chunks() if asked.num_rows else asked["_q"], known))
    rows = spread(usable(records, vector).select(F.col(record).alias("_record"), F.col(vector).cast("array<double>").alias("_v")))
    slack = NEAR + (0.0 if digits is None else 10.0**-digits)

    def scan(batches):
        names, known = shared.value
        best = Best(len(names), k)
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for d, (numbers, q, q_norm) in known.items():
                at = pa.array(np.flatnonzero(lengths == d))
                if not len(at):
                    continue
                ids = batch.column(0).take(at)
                x = batch.column(1).take(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                x_norm = _norms(x)
                unit = np.divide(x, x_norm[:, None], out=np.zeros_like(x), where=x_norm[:, None] > 0).T
                step = max(1, TILE // len(x))
                for start in range(0, len(q), step):
                    some = slice(start, start + step)
                    length = q_norm[some, None]
                    near = np.divide(q[some], length, out=np.zeros_like(q[some]), where=length > 0) @ unit
                    bar = best.worst[numbers[some]]
                    if len(x) > k and np.isinf(bar).any():
                        bar = np.maximum(bar, np.partition(near, -k, axis=1)[:, -k])
                    if least is not None:
                        bar = np.maximum(bar, least)
                    which, where = np.nonzero(near >= bar[:, None] - slack)
                    for first in range(0, len(which), EXACT):
                        a, b = which[first : first + EXACT] + start, where[first : first + EXACT]
                        both = q_norm[a] * x_norm[b]
                        dot = np.cumsum(x[b] * q[a], axis=1)[:, -1]
                        # a norm of 0 gives 0, and so does a product of norms only then
                        score = np.divide(dot, both, out=np.zeros(len(a)), where=both != 0)
                        if least is not None:
                            kept = score >= least
                            a, b, score = a[kept], b[kept], score[kept]
                        best.add(numbers[a], ids.take(pa.array(b)), score if digits is None else _rounded(score, digits))
                best.cut()
        found = best.cut()
        if found is not None:
            named = pa.table([names.take(found["_query"].combine_chunks()), found["_record"], found["score"]], ["_q", "_record", "score"])
            yield from named.combine_chunks().to_batches(max_chunksize=HELD)

    kind = {c: f.schema[c].dataType.simpleString() for f, c in ((rows, "_record"), (queries.select(F.col(query).alias("_q")), "_q"))}
    scored = rows.mapInArrow(scan, f"_q {kind['_q']}, _record {kind['_record']}, score double")
    return scored.withColumnsRenamed({"_q": query, "_record": record})


def dimension_report(records: DataFrame, query_dimensions: int, vector: str = "vector") -> DataFrame:
    """One row: how many records are comparable, empty, or of other dimensions."""
    target = F.array_repeat(F.lit(0.0), query_dimensions)
    problem = dimension_problem(F.col(vector), target)
    return records.select(problem.alias("p")).agg(
        F.count_if(F.col("p").isNull()).alias("comparable"),
        F.count_if(F.col("p") == "empty-vector").alias("empty_vector"),
        F.count_if(F.col("p") == "dimension-mismatch").alias("dimension_mismatch"),
    )
