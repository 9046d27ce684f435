"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are enough: with pi the share of good text in
the web, the risk of a scorer g is pi * R_p(g, +) + R_u(g, -) - pi * R_p(g, -), and its
non-negative form takes max(0, R_u(g, -) - pi * R_p(g, -)) so that a flexible scorer
cannot push the estimate below zero. g is linear in a few measures of the whole text
(character classes, symbols, case, repetition, word and line shapes) and their squares;
no label, language, source or id is among them. Training minimises the risk with the
sigmoid loss by full-batch gradient steps; where the second part falls below zero, the
step goes against it, as the method prescribes.

The class prior is estimated from the training labels. The learnt score orders texts but
is no probability, so a last step fits its slope and offset on the training labels.

Measures are computed for every document, in one map without a shuffle, and written to
the shared folder (a few dozen bytes per document). Mean and spread of the measures and
the unlabelled part of the risk are taken over all rows that are not held out: they are
dealt by a hash into random groups of about ``sample``, each group's risk is minimised by
one task, and the learnt weights are averaged by the groups' sizes. Only labelled rows are
sampled, about ``sample`` of them by a hash of the id, one row per id; this documented
bound does not grow with the corpus. All rows are scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._arrow import text_slices
from quern.session import materialize, ship_package

NAMES = (
    "log_bytes", "upper", "digits", "sentence_marks", "symbols", "exclamations", "bars", "non_ascii", "word_bytes",
    "distinct_words", "distinct_pairs", "distinct_lines", "words_per_line", "letters", "marked_words",
)

_CLASSES = np.zeros((6, 256))
_CLASSES[0, 0x41:0x5B] = 1  # upper case
_CLASSES[1, 0x30:0x3A] = 1  # digits
_CLASSES[2, [ord(c) for c in ".,;:?'\"-()"]] = 1
_CLASSES[3, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 1
_CLASSES[4, 0x80:] = 1
_CLASSES[5, 0x41:0x5B] = _CLASSES[5, 0x61:0x7B] = _CLASSES[5, 0x80:] = 1
_MARKS = bytes(range(0x21, 0x30)) + b":;<=>?@[\\]^_`{|}~"


def measures(text: str | None) -> list[float]:
    """The measures of a text, in the order of ``NAMES``; all zero for an empty one."""
    data = (text or "").encode("utf-8")
    words = data.split()
    if not words:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, digits, marks, symbols, high, letters = (_CLASSES @ counts).tolist()
    n, w = len(data), len(words)
    lines = data.split(b"\n")
    bare = data.translate(None, _MARKS).split()
    return [
        np.log1p(n),
        upper / max(letters, 1),
        digits / n,
        marks / n,
        symbols / n,
        counts[0x21] / w,
        counts[0x7C] / w,
        high / n,
        min((n - w) / w, 50.0),
        len(set(words)) / w,
        len(set(zip(words, words[1:]))) / max(w - 1, 1),
        len(set(lines)) / len(lines),
        np.log1p(w / len(lines)),
        letters / n,
        (w - len(bare)) / w,
    ]


def is_held_out(id_value) -> bool:
    """Rows whose labels are never learnt from."""
    return zlib.crc32(str(id_value).encode()) % 4 == 2


def held_out(id_column):
    """The same as a column: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Scorer:
    """score = sigmoid(slope * (w . z) + offset), z the standardised measures and squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _expanded((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(x) + self.offset)


def _expanded(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.concatenate([z, z * z / 6, np.ones((len(z), 1))], axis=1)


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -60, 60)))


def fit_pu(
    positive: np.ndarray,
    unlabelled: np.ndarray,
    prior: float,
    *,
    rounds: int = 600,
    rate: float = 0.05,
    decay: float = 1e-3,
    moments: tuple[np.ndarray, np.ndarray] | None = None,
) -> Scorer:
    """Minimise the non-negative unbiased risk; see the module's text.

    Without positives the score is 0 and without unlabelled rows it is the positives' own
    spread; both are constant after calibration. ``moments`` are the measures' mean and
    scale, by default those of the rows given.
    """
    every = np.concatenate([positive, unlabelled])
    mean, scale = moments or (every.mean(axis=0), every.std(axis=0) + 1e-9)
    scorer = Scorer(mean, scale, np.zeros(2 * every.shape[1] + 1))
    xp, xu = (_expanded((x - mean) / scale) for x in (positive, unlabelled))
    if len(xp) == 0 or len(xu) == 0:
        return scorer
    w, m, v = scorer.weights, np.zeros_like(scorer.weights), np.zeros_like(scorer.weights)
    for t in range(1, rounds + 1):
        sp, su = _sigmoid(xp @ w), _sigmoid(xu @ w)  # the loss of calling them negative
        slope_p, slope_u = sp * (1 - sp), su * (1 - su)
        negative_risk = su.mean() - prior * sp.mean()
        rising_p = (slope_p @ xp) / len(xp)
        rising_u = (slope_u @ xu) / len(xu)
        if negative_risk >= 0:
            gradient = -prior * rising_p + (rising_u - prior * rising_p)
        else:
            gradient = -(rising_u - prior * rising_p)
        gradient = gradient + decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    scorer.weights = w
    return scorer


def calibrate(scorer: Scorer, x: np.ndarray, label: np.ndarray, rounds: int = 50) -> Scorer:
    """Slope and offset by Newton's steps for the labels' log-loss, with a weak pull to
    zero and labels smoothed as for small samples. Needs both labels; else unchanged."""
    ones, zeros = int(label.sum()), int(len(label) - label.sum())
    if not ones or not zeros:
        return scorer
    raw = scorer.raw(x)
    size = np.abs(raw).mean() + 1e-9
    design = np.stack([raw / size, np.ones(len(raw))], axis=1)
    goal = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    w = np.zeros(2)
    for _ in range(rounds):
        p = _sigmoid(design @ w)
        gradient = design.T @ (p - goal) + 1e-3 * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    scorer.slope, scorer.offset = float(w[0] / size), float(w[1])
    return scorer


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _x array<double>`` for every row."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def measure(batches):
        for batch in text_slices(batches, 1):
            x = [measures(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["_id", "_x"])

    return rows.mapInArrow(measure, f"_id {kind}, _x array<double>")


def hash_sample(rows: DataFrame, most: int, seed: int = 1) -> DataFrame:
    """All rows if there are at most ``most``, else those whose id hashes below the share
    that gives ``most`` of them: about ``most`` rows, the same ones at every run. Tasks
    send only what is chosen, however many there are."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.col("_id"), F.lit(seed)), F.lit(1 << 32)) < int(most / n * (1 << 32)))


def label_rows(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """One label (0 or 1, the larger if they differ) per id that may be learnt from, about
    ``most`` of them; sent to every task if their counted number allows it."""
    learnt = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
    )
    chosen = materialize(hash_sample(materialize(learnt, "labels"), most, 2), "labels")
    return F.broadcast(chosen) if chosen.count() <= 2 * most else chosen


def rows_to_learn(table: DataFrame) -> DataFrame:
    """The rows of ``table`` that are not held out."""
    return table.filter(~held_out(F.col("_id")))


def labelled_rows(table: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row (the least) of ``table`` per id of ``chosen``, with its label."""
    rest = F.struct(*(c for c in table.columns if c != "_id"))
    one = rows_to_learn(table).join(chosen, "_id").groupBy("_id", "_label").agg(F.min(rest).alias("_least"))
    return one.select("_label", "_least.*")


def mean_over_groups(table: DataFrame, fit, size: int, seed: int = 1) -> np.ndarray | None:
    """The mean, by rows, of the numbers that ``fit`` (a function of a pandas frame) finds in
    random groups of about ``size`` rows, which all rows of ``table`` are dealt into; None
    without rows. Where there are at most ``size`` rows, they are one group."""
    groups = -(-table.count() // size)
    if not groups:
        return None
    columns = [c for c in table.columns if c != "_id"]

    def found(group: pa.Table) -> pa.Table:
        frame = group.sort_by("_h").to_pandas()  # rows come in any order; the fit must not depend on it
        values = np.asarray(fit(frame), float)
        return pa.table({"k": np.arange(len(values)), "v": values * len(frame), "n": np.full(len(values), len(frame))})

    dealt = table.select(F.xxhash64("_id", *columns, F.lit(seed)).alias("_h"), *columns)
    sums = dealt.groupBy(F.pmod("_h", F.lit(groups)).alias("_g")).applyInArrow(found, "k long, v double, n long").groupBy("k")
    rows = sums.agg((F.sum("v") / F.sum("n")).alias("v")).toPandas().sort_values("k")
    return rows["v"].to_numpy(float)


def train(
    table: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    *,
    sample: int = 20_000,
    prior: float | None = None,
) -> Scorer:
    """Fit on about ``sample`` labelled rows and all unlabelled rows of ``table``
    (``_id, _x``). Held-out rows are used neither way."""
    width = len(NAMES)
    known = labelled_rows(table, label_rows(labels, id_col, label_col, sample)).toPandas()
    x = np.array(known["_x"].tolist(), float).reshape(-1, width)
    y = known["_label"].to_numpy(int)
    if not len(x):
        return Scorer(np.zeros(width), np.ones(width), np.zeros(2 * width + 1))
    order = np.lexsort(np.c_[x, y].T)  # rows come in any order; the fit must not depend on it
    x, y = x[order], y[order]
    web = rows_to_learn(table)
    found = web.agg(*(f(F.get("_x", F.lit(k))) for f in (F.avg, F.stddev_pop) for k in range(width))).first()
    mean, scale = np.array(found[:width], float), np.array(found[width:], float) + 1e-9
    share = prior if prior is not None else float((y.sum() + 1) / (len(y) + 2))
    good = x[y == 1]

    def weights(frame):
        u = np.array(frame["_x"].tolist(), float).reshape(-1, width)
        return fit_pu(good, u, share, moments=(mean, scale)).weights

    return calibrate(Scorer(mean, scale, mean_over_groups(web, weights, sample)), x, y)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    *,
    threshold: float = 0.7,
    sample: int = 20_000,
    prior: float | None = None,
) -> DataFrame:
    """``id, held_out, score, predicted`` per row of ``docs``.

    Defined results: null and wordless texts have all measures zero and get the score of
    that point; ids without a label, and labels that are null or not 0 or 1, only count
    as unlabelled; with labels of one kind or none, or no rows, scores are 0.5; rows with
    a null id are scored and not held out; repeated rows are scored alike; other columns
    are ignored.
    """
    table = materialize(measured(docs, id_col, text_col), "measures")
    scorer = train(table, labels, id_col, label_col, sample=sample, prior=prior)
    kind = table.schema["_id"].dataType.simpleString()

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.score(x))], ["_id", "score"])

    scored = table.mapInArrow(score, f"_id {kind}, score double")
    return scored.select(
        F.col("_id").alias(id_col),
        held_out(F.col("_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    *,
    threshold: float = 0.7,
    sample: int = 20_000,
    prior: float | None = None,
) -> DataFrame:
    """``docs`` without the rows scored below ``threshold``; all columns stay. Rows are
    measured again where they lie, so no text is shuffled."""
    table = materialize(measured(docs, id_col, text_col), "measures")
    scorer = train(table, labels, id_col, label_col, sample=sample, prior=prior)
    at = docs.columns.index(text_col)

    def keep(batches):
        for batch in text_slices(batches, at):
            x = np.array([measures(t) for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(scorer.score(x) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
