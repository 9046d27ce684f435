"""An index of vectors by inverted lists: approximate search, and exact search with bounds.

Vectors are dealt to cells, each the vectors nearest to one centre by cosine. The centres
are fitted by k-means on a bounded sample; every vector is assigned. The lists are Parquet
partitioned by cell, so a search reads the folders of the cells it probes and no others. A
cell with very many vectors is written in several files, by as many tasks.

A query probes the cells whose centres are nearest and scores their vectors exactly. How many
that must be depends on the vectors: those that lie in clumps need few cells, those that lie
anywhere need many. So the index measures it, on some of its own vectors as queries against
all others, and takes the fewest probes that find the wanted share of the true neighbours.

Each cell knows how far its vectors lie from the centre, and with the angle between query and
centre this bounds the score of everything in the cell. An exact search reads, in a second
step, the cells whose bound reaches the score of the k-th hit so far, and skips the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.vector import norm
from quern.operators.knn import HELD, TILE, Best
from quern.operators.ranking import top_k
from quern.session import materialize, ship_package

#: Vectors of the fitting sample per cell, most cells, and bytes of all centres.
SAMPLE_PER_CELL, MOST_CELLS, CENTRE_BYTES = 64, 16_384, 64 << 20
#: Vectors in one file of a cell, about.
FILE_ROWS = 200_000
#: Queries of a pass and bytes of their vectors; a pass's queries go to all tasks.
BLOCK, BLOCK_BYTES = 16_384, 16 << 20
#: Pairs of a query and a cell that the driver weighs at once.
PAIRS = 4 << 20
#: Probes are chosen so that this share of the best ``TARGET_K`` is found for about
#: ``TRIALS`` of the index's own vectors.
TARGET, TARGET_K, TRIALS = 0.95, 20, 100
#: The cell of vectors without a direction; they score 0.
NOWHERE = -1
_SLACK = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def fit_centres(vectors: DataFrame, cells: int, vector: str, seed: int = 7) -> np.ndarray:
    """Centres of ``cells`` groups of a sample of about ``SAMPLE_PER_CELL`` vectors each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    wanted = cells * SAMPLE_PER_CELL
    share = min(1.0, wanted / max(1, vectors.count()))
    chosen = vectors.filter(F.pmod(F.xxhash64(vector), F.lit(1 << 20)) < int(share * (1 << 20)))
    points = materialize(chosen.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")), "sample")
    model = KMeans(k=cells, distanceMeasure="cosine", maxIter=6, initSteps=1, seed=seed).fit(points)
    return _unit(np.array([np.asarray(c) for c in model.clusterCenters()], np.float64))


def nearest_cells(records: DataFrame, centres: np.ndarray, vector: str) -> DataFrame:
    """``records`` with ``_cell`` and ``_cos``, the cosine to that cell's centre."""
    ship_package(records.sparkSession)
    shared = records.sparkSession.sparkContext.broadcast(centres)
    at = records.columns.index(vector)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)

    def assign(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _unit(_matrix(batch.column(at), shared.value.shape[1]))
            cell, cos = np.zeros(len(x), np.int32), np.zeros(len(x))
            for start in range(0, len(x), 1024):
                score = x[start : start + 1024] @ shared.value.T
                best = score.argmax(1)
                cell[start : start + 1024], cos[start : start + 1024] = best, score[np.arange(len(best)), best]
            cell[~x.any(1)] = NOWHERE
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(cos)], [*batch.schema.names, "_cell", "_cos"])

    return records.mapInArrow(assign, f"{fields}, _cell int, _cos double")


class VectorIndex:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.record, self.vector, self.dimensions = about["record"], about["vector"], about["dimensions"]

    @classmethod
    def build(
        cls, records: DataFrame, path: str, *, record: str = "record_id", vector: str = "vector", dimensions: int | None = None, cells: int | None = None
    ) -> VectorIndex:
        """Fit, assign and write. All columns of ``records`` are kept, to filter by.

        ``dimensions`` defaults to the most frequent size. Records of another size cannot be
        compared with the index's queries and are left out, as are null vectors; vectors of
        zeros stay and score 0. ``cells`` defaults to the square root of the number of
        vectors, within the bounds above. An empty table gives an index without cells.
        """
        spark, path = records.sparkSession, path.rstrip("/")
        if dimensions is None:
            sizes = records.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count()
            found = sizes.orderBy(F.desc("count"), "d").first()
            dimensions = found["d"] if found else 0
        usable = records.filter(F.size(vector) == dimensions) if dimensions else records.limit(0)
        pointed = usable.filter(norm(F.col(vector)) > 0)
        n = pointed.count()
        most = max(1, min(MOST_CELLS, CENTRE_BYTES // (8 * max(dimensions, 1))))
        cells = min(most, cells or max(1, round(n**0.5)))
        centres = fit_centres(pointed, cells, vector) if n > 1 else np.zeros((1, max(dimensions, 1)))
        spark.createDataFrame([(record, vector, dimensions)], "record string, vector string, dimensions int").write.parquet(f"{path}/about")
        rows = [(k, c.tolist()) for k, c in enumerate(centres)]
        spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        index = cls(spark, path)
        index._write(usable, centres)
        index.calibrate()
        return index

    def add(self, records: DataFrame) -> None:
        """More records; they go to the cells that there are, as new files."""
        self._write(records.filter(F.size(self.vector) == self.dimensions), self._centres())

    def calibrate(self, target: float = TARGET, k: int = TARGET_K, trials: int = TRIALS) -> int:
        """Measure how many probes find ``target`` of the best ``k``, and keep the number. About
        ``trials`` vectors, chosen by a hash, are the queries; their exact hits and the cells of
        these hits come to the driver."""
        held = self.cells()
        total = sum(c.n for c in held if c.cell != NOWHERE)
        share = min(1.0, trials / max(1, total))
        some = self.read().filter((F.pmod(F.xxhash64(self.vector), F.lit(1 << 20)) < int(share * (1 << 20))) & (F.col("cell") != NOWHERE)) if total else None
        probes = len(held)
        if total:
            asked = materialize(some.select(F.col(self.record).alias("query_id"), F.col(self.vector).alias("query_vector")), "trials")
            hits = self.search(asked, k, probes=len(held)).select("query_id", F.col(self.record).alias("_hit"))
            of = self.read().select(F.col(self.record).alias("_hit"), "cell")
            found = materialize(hits, "hits").join(of, "_hit").join(asked, "query_id").collect()
            centres, cells = self._centres(), np.array([c.cell for c in held])
            ranks = []
            for r in found:
                near = np.where(cells == NOWHERE, 0.0, _unit(np.array(r.query_vector, np.float64)) @ centres[np.maximum(cells, 0)].T)
                ranks.append(int(np.flatnonzero(np.argsort(-near, kind="stable") == np.flatnonzero(cells == r.cell)[0])[0]) + 1)
            if ranks:
                probes = int(np.sort(ranks)[int(np.ceil(target * len(ranks))) - 1])
        self.spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/probes")
        return probes

    def probes(self) -> int:
        return self.spark.read.parquet(f"{self.path}/probes").first().probes

    def _centres(self) -> np.ndarray:
        return np.array([r.centre for r in self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()])

    def _write(self, records: DataFrame, centres: np.ndarray) -> None:
        assigned = materialize(nearest_cells(records, centres, self.vector), "assigned")
        sizes = materialize(assigned.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_cos").alias("least_cos")), "cells")
        parts = F.greatest(F.ceil(F.col("n") / FILE_ROWS), F.lit(1)).alias("_parts")
        dealt = assigned.join(sizes.select("_cell", parts), "_cell").withColumn("_part", F.pmod(F.xxhash64(self.record), F.col("_parts")))
        written = dealt.repartition("_cell", "_part").drop("_cos", "_parts", "_part").withColumnRenamed("_cell", "cell")
        written.write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")
        sizes.withColumnRenamed("_cell", "cell").coalesce(1).write.mode("append").parquet(f"{self.path}/cells")

    def cells(self) -> list:
        """Rows ``cell, n, least_cos`` of the cells that hold vectors; as many as there are cells."""
        known = self.spark.read.schema("cell int, n long, least_cos double").parquet(f"{self.path}/cells")
        return known.groupBy("cell").agg(F.sum("n").alias("n"), F.min("least_cos").alias("least_cos")).orderBy("cell").collect()

    def read(self, cells: Sequence[int] | None = None) -> DataFrame:
        """The vectors of the given cells: Spark reads only their folders."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        return rows if cells is None else rows.filter(F.col("cell").isin([int(c) for c in cells]))

    def _scan(self, rows: DataFrame, wanted: dict[int, np.ndarray], vectors: np.ndarray, k: int, least: float | None, digits: int | None) -> DataFrame:
        """``_query`` (its number), record and score of the best ``k`` of each task."""
        ship_package(self.spark)
        shared = self.spark.sparkContext.broadcast((wanted, vectors))
        rows = rows.select(F.col(self.record).alias("_record"), self.vector, "cell")
        dimensions = self.dimensions

        def scan(batches):
            wanted, vectors = shared.value
            best = Best(len(vectors), k)
            for batch in batches:
                cells, ids = batch.column(2).to_numpy(zero_copy_only=False), batch.column(0)
                for cell in np.unique(cells).tolist():
                    asked = wanted.get(cell)
                    if asked is None:
                        continue
                    at = np.flatnonzero(cells == cell)
                    x = _unit(_matrix(batch.column(1).take(pa.array(at)), dimensions))
                    own, step = ids.take(pa.array(at)), max(1, TILE // len(at))
                    for some in (asked[start : start + step] for start in range(0, len(asked), step)):
                        scores = vectors[some] @ x.T
                        if digits is not None:
                            scores = np.sign(scores) * np.floor(np.abs(scores) * 10**digits + 0.5) / 10**digits
                        bar = best.worst[some]
                        if len(at) > k and np.isinf(bar).any():
                            bar = np.maximum(bar, np.partition(scores, -k, axis=1)[:, -k])
                        if least is not None:
                            bar = np.maximum(bar, least)
                        query, near = np.nonzero(scores >= bar[:, None])
                        best.add(some[query], own.take(pa.array(near)), scores[query, near])
            found = best.cut()
            if found is not None:
                yield from found.combine_chunks().to_batches(max_chunksize=HELD)

        kind = rows.schema["_record"].dataType.simpleString()
        return rows.mapInArrow(scan, f"_query int, _record {kind}, score double")

    def search(
        self,
        queries: DataFrame,
        k: int,
        *,
        probes: int | None = None,
        exact: bool = False,
        least: float | None = None,
        digits: int | None = None,
        where: Column | None = None,
        query: str = "query_id",
        query_vector: str = "query_vector",
    ) -> DataFrame:
        """``query, record, score, rank`` of the best ``k`` records of each query, as
        ``knn.nearest`` has them: all of them if ``exact``, else those in the ``probes`` cells
        nearest to the query (as many as were measured, by default). ``where`` filters by any column that was indexed.

        Queries are a stated set and are taken in blocks of ``BLOCK`` (and ``BLOCK_BYTES``);
        a block's vectors are read by the driver, which chooses the cells, and sent to all
        tasks. Queries of another size have no hits; a query of zeros scores 0 everywhere.
        """
        asked = queries.filter(F.size(query_vector) == self.dimensions).select(F.col(query).alias("_q"), F.col(query_vector).alias("_v"))
        centres, held, probes = self._centres(), self.cells(), self.probes() if probes is None else probes
        size = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(self.dimensions, 1)), PAIRS // max(1, len(held))))
        blocks = max(1, -(-asked.count() // size))
        number = F.pmod(F.xxhash64("_q"), F.lit(2 * blocks))
        parts = [asked] if blocks == 1 else [asked.filter(number == i) for i in range(2 * blocks)]
        name = queries.schema[query].dataType.simpleString()
        out = self.spark.createDataFrame([], f"_q {name}, _record {self._kind()}, score double, rank int") if not held else None
        for part in parts if held else []:
            found = self._block(part.collect(), name, centres, held, k, probes, exact, least, digits, where)
            out = found if out is None else out.unionByName(found)
        return out.select(F.col("_q").alias(query), F.col("_record").alias(self.record), "score", "rank")

    def _kind(self) -> str:
        return self.spark.read.parquet(f"{self.path}/rows").schema[self.record].dataType.simpleString()

    def _block(self, asked: list, name: str, centres, held, k, probes, exact, least, digits, where) -> DataFrame:
        ids = self.spark.createDataFrame([(i, r["_q"]) for i, r in enumerate(asked)], f"_query int, _q {name}")
        vectors = _unit(np.array([r["_v"] for r in asked], np.float64).reshape(len(asked), self.dimensions))
        cells = np.array([c.cell for c in held])
        near = np.where(cells == NOWHERE, 0.0, vectors @ centres[np.maximum(cells, 0)].T)
        first = np.zeros(near.shape, bool)
        order = np.argsort(-near, axis=1, kind="stable")[:, : max(1, probes)]
        np.put_along_axis(first, order, True, axis=1)

        def scanned(chosen: np.ndarray) -> DataFrame:
            wanted = {int(cells[c]): np.flatnonzero(chosen[:, c]) for c in np.flatnonzero(chosen.any(0))}
            rows = self.read(list(wanted))
            return self._scan(rows if where is None else rows.filter(where), wanted, vectors, k, least, digits)

        hits = scanned(first)
        if exact:
            hits = materialize(top_k(hits, k, by=("_query",), tie="_record").drop("rank"), "probed")
            reached = np.full(len(asked), -np.inf if least is None else least)
            full = hits.groupBy("_query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).filter(F.col("n") >= k)
            for r in full.collect():  # one row per query of the block
                reached[r["_query"]] = max(reached[r["_query"]], r.worst)
            radius = np.arccos(np.clip([c.least_cos for c in held], -1, 1))
            bound = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - radius)) + _SLACK
            bound = np.where(cells == NOWHERE, _SLACK, bound)
            bound[~vectors.any(1)] = _SLACK
            rest = ~first & (bound >= reached[:, None] - (0 if digits is None else 10.0**-digits))
            if rest.any():
                hits = hits.unionByName(scanned(rest))
        return top_k(hits.join(F.broadcast(ids), "_query").drop("_query"), k, by=("_q",), tie="_record")


def recall(found: DataFrame, exact: DataFrame, query: str = "query_id", record: str = "record_id") -> DataFrame:
    """Per query of ``exact``: ``n`` of its hits and how many of these ``found`` has."""
    known = found.select(query, record).distinct().withColumn("_found", F.lit(1))
    joined = exact.join(known, [query, record], "left")
    return joined.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.count("_found").alias("n_found"))
