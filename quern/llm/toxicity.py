"""Toxicity scores by weak supervision.

*Voters.* Every voter reads the whole text and votes toxic, clean or not at all. There
are lexicon voters (a short list of insults given below), pattern voters (word beginnings
that go with toxic texts, mined from the labelled training rows in any language) and
shape voters (several different hits, a high share of hits, no hit, one hit in a long
text).

*Label model.* A generative model of the votes is fitted by expectation maximisation
without labels. Given the class, a voter's vote depends on the vote of one other voter, its
parent in the tree of the strongest correlations (the spanning tree of greatest
conditional mutual information). The model so has each voter's accuracy, how often it votes
which way for toxic and for clean texts, and how voters go together beyond that: a
voter that repeats its parent adds no evidence.

*Classifier.* A linear classifier is trained on the model's posterior labels, over the
hits' counts and shares, so it also weighs what voters cannot say. Slope and offset of
its score are then fitted on the training labels.

Mining and calibration use about ``sample`` labelled rows, one per id, chosen by a hash of
the id (the documented bound); every term in them is a candidate. The label model and the
classifier are fitted on all rows that are not held out, dealt by a hash into random groups
of about ``sample``: correlations, prior, vote tables, mean and spread are the means of the
groups' ones, and so are the classifier's weights for the posterior of that common model.
Every text is measured whole and every row is scored; measuring is one map without a
shuffle and writes a few dozen numbers per row.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._arrow import text_slices
from quern.llm.quality import Scorer, _sigmoid, calibrate, held_out, label_rows, labelled_rows, mean_over_groups, rows_to_learn
from quern.session import materialize, ship_package

#: Insults of the lexicon voters; the mined patterns extend them.
INSULTS = (
    "bastard", "clown", "creep", "cretin", "disgusting", "dumb", "filthy", "fool", "idiot", "imbecile", "jerk",
    "loser", "lowlife", "moron", "pathetic", "pig", "scum", "stupid", "trash", "useless", "vermin",
    "worthless", "wretch",
)
#: Mined terms that vote alone, and voters that the further ones make up.
MINED_ALONE, BUNDLES = 64, 8
LEXICON = tuple(f"{w}$" for w in INSULTS)  # "$": the whole word

_letters = re.compile(r"[^\W\d_]+").findall
_SHORTEST, _LONGEST = 3, 8


def words_of(text: str | None) -> list[str]:
    return _letters(text.lower()) if text else []


def beginnings(words: list[str]) -> set[str]:
    """The beginnings (3 to 8 letters) of the words, and the whole words with a ``$``."""
    out: set[str] = set()
    for w in set(words):
        out.add(f"{w}$")
        for k in range(_SHORTEST, min(len(w), _LONGEST) + 1):
            out.add(w[:k])
    return out


@dataclass(frozen=True)
class Patterns:
    """Terms: word beginnings, or whole words if they end with ``$``. The first ``alone`` (all,
    if None) are a voter each; the further ones vote together, in ``BUNDLES`` of them."""

    terms: tuple[str, ...]
    alone: int | None = None

    @property
    def voters(self) -> list[int]:
        """The number of each term's voter."""
        n, alone = len(self.terms), len(self.terms) if self.alone is None else min(self.alone, len(self.terms))
        return [k if k < alone else alone + (k - alone) * min(BUNDLES, n - alone) // (n - alone) for k in range(n)]

    @property
    def width(self) -> int:
        return max(self.voters, default=-1) + 1

    def counter(self):
        """A function from a text to (words, hit words, [words that match each voter's terms])."""
        voter, width = self.voters, self.width
        whole = {t[:-1]: k for k, t in enumerate(self.terms) if t.endswith("$")}
        starts = {t: k for k, t in enumerate(self.terms) if not t.endswith("$")}
        lengths = sorted({len(t) for t in starts})
        heads = {t[:_SHORTEST] for t in [*whole, *starts]}

        def count(text: str | None) -> tuple[int, int, list[int]]:
            words = words_of(text)
            found = [0] * width
            hits = 0
            for w in [w for w in words if w[:_SHORTEST] in heads]:
                at = {whole[w]} if w in whole else set()
                at |= {starts[w[:k]] for k in lengths if w[:k] in starts}
                hits += bool(at)
                for k in {voter[k] for k in at}:
                    found[k] += 1
            return len(words), hits, found

        return count


# --- mining ------------------------------------------------------------------------------


def _term_counts(labelled: DataFrame) -> DataFrame:
    """``term, a, b``: in how many toxic and clean rows (``_text, _label``) a term occurs."""

    def count(batches):
        for batch in text_slices(batches, 0):
            seen: tuple[Counter[str], Counter[str]] = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[label].update(beginnings(words_of(text)))
            terms = list(seen[0] | seen[1])
            columns = [pa.array([seen[k][t] for t in terms], pa.int64()) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *columns], ["term", "a", "b"])

    rows = labelled.select("_text", F.col("_label").cast("int"))
    return rows.mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _surprise(n_toxic: int, n_clean: int):
    """The log-likelihood ratio of a term's share (``a`` toxic, ``b`` clean rows) of toxic
    rows against the overall one, zero for terms that toxic rows do not favour."""
    a, b, share = F.col("a"), F.col("b"), n_toxic / (n_toxic + n_clean)
    expected = (a + b) * share
    rest = F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0)
    return F.when(a > expected, 2 * (a * F.log(a / expected) + rest)).otherwise(0.0)


def mine_patterns(
    labelled: DataFrame, *, alone: int = MINED_ALONE, least_rows: int = 4, least_surprise: float = 20.0
) -> Patterns:
    """Terms that go with toxic rows of ``labelled`` (``_text, _label``), most surprising
    first; a term that says the same as a chosen one (of one pair one begins the other) is
    left out.

    Every term of the rows is a candidate, and each that passes the test is counted: it needs
    ``least_rows`` toxic rows and ``least_surprise``, about the square of 4.5 standard
    deviations. The ``alone`` most surprising are a voter each, the further ones vote in
    bundles of neighbours in surprise, so the model's size is bounded and no term is left out.
    """
    sizes = {r["_label"]: r["count"] for r in labelled.groupBy("_label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Patterns(LEXICON)
    surprising = (
        _term_counts(labelled)
        .filter((F.col("a") >= least_rows) & (F.col("a") >= 2 * F.col("b")))
        .withColumn("g", F.round(_surprise(n_toxic, n_clean), 9))
        .filter(F.col("g") >= least_surprise)
    )
    chosen: list[str] = list(LEXICON)
    # of equal surprise, the longer beginning and then the whole word says more precisely what was seen
    ordered = surprising.select("term").orderBy(F.desc("g"), F.desc(F.length("term")), "term")
    for row in ordered.toLocalIterator():
        bare = row.term.rstrip("$")
        if not any(bare.startswith(c.rstrip("$")) or c.rstrip("$").startswith(bare) for c in chosen):
            chosen.append(row.term)
    return Patterns(tuple(chosen), len(LEXICON) + alone)


# --- votes and the label model -----------------------------------------------------------


def votes_of(n_words: np.ndarray, hits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Votes (rows x voters): 1 toxic, -1 clean, 0 none."""
    share = hits / np.maximum(n_words, 1)
    different = (counts > 0).sum(axis=1)
    shapes = np.stack(
        [
            (different >= 2) * 1,
            (hits >= 3) * 1,
            (share >= 0.01) * 1,
            (share >= 0.003) * 1,
            (hits == 0) * -1,
            ((hits == 1) & (n_words > 600)) * -1,
            (share < 0.002) * -1,
        ],
        axis=1,
    )
    return np.concatenate([(counts > 0) * 1, shapes], axis=1).astype(np.int8)


@dataclass
class LabelModel:
    """The class prior, P(vote | class) per voter, each voter's parent (-1 for the root) and
    P(vote | class, parent's vote)."""

    prior: float
    table: np.ndarray  # voters x (clean, toxic) x (-1, 0, 1)
    parent: np.ndarray
    given: np.ndarray  # voters x (clean, toxic) x parent's (-1, 0, 1) x own (-1, 0, 1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        evidence = np.log(self.given[:, 1] / self.given[:, 0]).reshape(len(self.parent), 9)
        total = evidence[np.arange(len(self.parent)), _states(votes, self.parent)].sum(axis=1)
        return _sigmoid(total + np.log(self.prior / (1 - self.prior)))


_SMOOTH = 0.3  # rows of each vote, and of the voter's own table for each vote of its parent, that are taken as seen


def _states(votes: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """3 * parent's vote + own vote, votes counted from 0; a root's parent votes 0."""
    own = votes.astype(np.int64) + 1
    return 3 * np.where(parent >= 0, own[:, parent], 1) + own


def _model(votes: np.ndarray, weight: np.ndarray, p: np.ndarray, parent: np.ndarray) -> LabelModel:
    """The model of greatest likelihood if row k is toxic with probability p[k]."""
    m, states = votes.shape[1], _states(votes, parent)
    cell = (np.arange(m) * 9 + states).ravel()
    counts = np.stack(
        [np.bincount(cell, np.repeat(q * weight, m), 9 * m).reshape(m, 3, 3) for q in (1 - p, p)], axis=1
    )
    table = counts.sum(axis=2) + _SMOOTH
    table /= table.sum(axis=2, keepdims=True)
    given = counts + _SMOOTH * table[:, :, None, :]
    given /= given.sum(axis=3, keepdims=True)
    prior = float(np.clip((p * weight).sum() / weight.sum(), 1e-3, 0.5))
    return LabelModel(prior, table, parent, given)


def _rows(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of votes and how often each occurs."""
    if not len(votes):
        return votes, np.zeros(0)
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    return rows, counts.astype(float)


def expectation_maximisation(
    votes: np.ndarray, parent: np.ndarray, p: np.ndarray, weight: np.ndarray, rounds: int = 40
) -> LabelModel:
    """From the rows' first probabilities of being toxic."""
    model = None
    for _ in range(rounds):
        model = _model(votes, weight, p, parent)
        new = model.posterior(votes)
        done, p = np.abs(new - p).max() < 1e-6, new
        if done:
            break
    return model


def no_parents(m: int) -> np.ndarray:
    return np.full(m, -1)


def unfitted(m: int) -> LabelModel:
    return LabelModel(0.1, np.full((m, 2, 3), 1 / 3), no_parents(m), np.full((m, 2, 3, 3), 1 / 3))


def first_guess(votes: np.ndarray) -> np.ndarray:
    """The start: two toxic votes mean toxic."""
    return 0.02 + 0.96 * ((votes == 1).sum(axis=1) >= 2)


def correlations(votes: np.ndarray, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The mutual information of each two voters' votes given the class, in nats."""
    n, m = votes.shape
    seen = (votes[:, :, None] == np.array([-1, 0, 1])).reshape(n, 3 * m).astype(float)
    total = np.zeros((m, m))
    for q in (1 - p, p):
        own = (q * weight).sum()
        both = (seen * (q * weight)[:, None]).T @ seen
        alone = np.diag(both)
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(both > 0, both * np.log(both * own / np.outer(alone, alone)), 0)
        total += part.reshape(m, 3, m, 3).sum(axis=(1, 3)) / max(weight.sum(), 1)
    return total


def spanning_tree(information: np.ndarray) -> np.ndarray:
    """Each voter's parent in the tree of greatest information, grown from voter 0; of
    equals (to 9 digits) the voter, then the parent, of the smallest number."""
    information = np.round(information, 9)
    m = len(information)
    parent, best = no_parents(m), information[0].copy() if m else np.zeros(0)
    link, outside = np.zeros(m, int), np.arange(m) > 0
    while outside.any():
        j = int(np.argmax(np.where(outside, best, -np.inf)))
        parent[j], outside[j] = link[j], False
        closer = outside & ((information[j] > best) | ((information[j] == best) & (j < link)))
        best, link = np.where(closer, information[j], best), np.where(closer, j, link)
    return parent


def fit_label_model(votes: np.ndarray) -> LabelModel:
    """Of one group of rows. The tree is that of the start: a class that is fitted without
    it would follow voters that repeat each other, and so hide that they do."""
    rows, weight = _rows(votes)
    if not len(rows):
        return unfitted(votes.shape[1])
    p = first_guess(rows)
    return expectation_maximisation(rows, spanning_tree(correlations(rows, weight, p)), p, weight)


# --- the classifier ------------------------------------------------------------------------


def features_of(n_words: np.ndarray, hits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    share = hits / np.maximum(n_words, 1)
    return np.concatenate(
        [
            np.minimum(counts, 3) / 1.0,
            np.log1p(hits)[:, None],
            np.log1p(1000 * share)[:, None],
            np.log1p((counts > 0).sum(axis=1))[:, None],
            np.log1p(n_words)[:, None],
        ],
        axis=1,
    )


class LinearScorer(Scorer):
    """sigmoid(slope * (w . x) + offset) without squares."""

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weights


def fit_linear(
    x: np.ndarray,
    soft: np.ndarray,
    rounds: int = 60,
    decay: float = 1e-2,
    moments: tuple[np.ndarray, np.ndarray] | None = None,
) -> LinearScorer:
    """Logistic regression on soft labels by Newton's steps; ``moments`` are the features' mean
    and scale, by default those of the rows given."""
    mean, scale = moments or (x.mean(axis=0), x.std(axis=0) + 1e-2)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = _sigmoid(z @ w)
        gradient = z.T @ (p - soft) / len(z) + decay * w
        curve = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z / len(z) + decay * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return LinearScorer(mean, scale, w)


@dataclass
class ToxicityModel:
    patterns: Patterns
    labels: LabelModel
    scorer: LinearScorer

    def score(self, n_words: np.ndarray, hits: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.scorer.score(features_of(n_words, hits, counts))


def _matrix(frame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.array(frame["_counts"].tolist(), float).reshape(-1, width)
    return frame["_words"].to_numpy(float), frame["_hits"].to_numpy(float), counts


def fit_model(patterns: Patterns, web: DataFrame, known, sample: int) -> ToxicityModel:
    """From all unlabelled rows (measured, with ``_id``) and a pandas frame of labelled ones.

    Three passes over the measures, each the mean over random groups: the voters'
    correlations; the model along their tree; the classifier.
    """
    width = patterns.width
    m = votes_of(np.zeros(0), np.zeros(0), np.zeros((0, width))).shape[1]

    def voters(frame) -> np.ndarray:
        n, h, c = _matrix(frame, width)
        rows, weight = _rows(votes_of(n, h, c))
        x = features_of(n, h, c)
        together = correlations(rows, weight, first_guess(rows))
        return np.concatenate([together.ravel(), x.mean(axis=0), (x * x).mean(axis=0)])

    found = mean_over_groups(web, voters, sample)
    if found is None:
        zeros = np.zeros(width + 4)
        return ToxicityModel(patterns, unfitted(m), LinearScorer(zeros, zeros + 1, np.zeros(width + 5)))
    together, mean, squares = np.split(found, np.cumsum([m * m, width + 4]))
    parent = spanning_tree(together.reshape(m, m))
    scale = np.sqrt(np.maximum(squares - mean * mean, 0)) + 1e-2

    def tables(frame) -> np.ndarray:
        rows, weight = _rows(votes_of(*_matrix(frame, width)))
        model = expectation_maximisation(rows, parent, first_guess(rows), weight)
        return np.concatenate([[model.prior], model.table.ravel(), model.given.ravel()])

    prior, table, given = np.split(mean_over_groups(web, tables, sample), np.cumsum([1, 6 * m]))
    labels = LabelModel(float(prior[0]), table.reshape(m, 2, 3), parent, given.reshape(m, 2, 3, 3))

    def weights(frame) -> np.ndarray:
        n, h, c = _matrix(frame, width)
        soft = labels.posterior(votes_of(n, h, c))
        return fit_linear(features_of(n, h, c), soft, moments=(mean, scale)).weights

    scorer = LinearScorer(mean, scale, mean_over_groups(web, weights, sample))
    kn, kh, kc = _matrix(known, width)
    calibrate(scorer, features_of(kn, kh, kc), known["_label"].to_numpy(int))
    return ToxicityModel(patterns, labels, scorer)


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    *,
    threshold: float = 0.3,
    sample: int = 20_000,
) -> DataFrame:
    """``id, held_out, score, predicted`` per row of ``docs``.

    Defined results: null and wordless texts have no hits and get that point's score; ids
    without a label, and labels that are null or not 0 or 1, count as unlabelled; with
    labels of one kind or none the lexicon's votes alone decide; rows with a null id are
    scored and not held out; repeated rows are scored alike; an empty table gives an
    empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    chosen = label_rows(labels, id_col, label_col, sample)
    patterns = mine_patterns(labelled_rows(rows, chosen))

    def measure(batches):
        count = patterns.counter()
        for batch in text_slices(batches, 1):
            found = [count(t) for t in batch.column(1).to_pylist()]
            n, hits, counts = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, hits)), pa.array(counts, pa.list_(pa.int32()))],
                ["_id", "_words", "_hits", "_counts"],
            )

    table = materialize(
        rows.mapInArrow(measure, f"_id {kind}, _words long, _hits long, _counts array<int>"), "hits"
    )
    known = labelled_rows(table, chosen).toPandas()
    # rows come in any order; the fit must not depend on it
    known = known.iloc[known.astype(str).agg("|".join, axis=1).argsort(kind="stable")] if len(known) else known
    model = fit_model(patterns, rows_to_learn(table), known, sample)
    width = patterns.width

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                n, h = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (1, 2))
                counts = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(model.score(n, h, counts.astype(float)))], ["_id", "score"]
                )

    return table.mapInArrow(score, f"_id {kind}, score double").select(
        F.col("_id").alias(id_col),
        held_out(F.col("_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
