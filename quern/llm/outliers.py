"""Quality rules by robust multivariate outliers.

Each text gets a vector of transformed statistics (logarithms of sizes, square roots of
shares). Per language and source, the minimum-covariance-determinant estimate says where
the usual vectors lie: concentration steps look for the part of the rows (three quarters)
whose covariance has the least determinant, so that junk neither moves the centre nor
widens the spread. A row whose Mahalanobis distance from its own group's centre is too
large is rejected, as are rows that fail the base rules.

All of it is DataFrame functions. Rows are read once for their statistics, which are
written (a few dozen bytes per document); everything after that reads this narrow table.
A concentration step is two aggregations per group, both combined before the shuffle, so
a source that holds a third of all rows costs as much as the others:

* a histogram of the rows' distances, whose running sum gives the distance below which
  three quarters of the group lie (its cells are bounded in number);
* number, sums and sums of products of the rows below it, hence mean and covariance.

Vectors are fixed-point integers and sums are exact, so the estimates and verdicts do not
depend on the order in which rows are read, nor on the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.columns import let
from quern.session import materialize

#: White space between words, and the symbols that are counted.
SPACE, SYMBOLS = r"\x20\x09-\x0D", r"#*$%&|<>"
#: Base rules: least words; most repeated words, in hundredths.
LEAST_WORDS, MOST_REPEATED = 20, 30
WINDOW = 8
#: Statistics of a vector, and for each the least spread (a standard deviation) that is
#: taken as real: below it a statistic hardly varies and no distance is read into it.
STATISTICS = {
    "log_words": 0.25, "log_word_chars": 0.05, "root_symbols": 0.05, "root_capitals": 0.05, "root_dup_lines": 0.25, "root_repeats": 0.2,
}
#: Steps of a unit in the fixed-point vectors.
UNIT = 4096
#: Cells of a unit of distance, and the last cell, which takes everything beyond.
CELLS, LAST_CELL = 64, 8191
#: Rows of the fixed-point vectors that share a cell of the first estimate's histogram.
COARSE = 64
#: Share of a group that the estimate covers, concentration steps, least rows of a group,
#: and the share of usual rows that stay.
COVERED, STEPS, LEAST_ROWS, STAY = 0.75, 4, 64, 0.9999


def chi_square(x: float, p: int) -> float:
    """The distribution function with ``p`` degrees of freedom."""
    a, half = p / 2, x / 2
    term = total = 1 / a
    k = 0
    while term > total * 1e-16:
        k += 1
        term *= half / (a + k)
        total += term
    return total * math.exp(a * math.log(half) - half - math.lgamma(a)) if half > 0 else 0.0


def chi_square_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, p) < q:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, p) < q else (low, middle)
    return round(high, 6)


def text_statistics(text: Column) -> Column:
    """A struct of ``n_words, word_chars, n_symbols, n_capitals, n_lines, n_dup_lines,
    n_repeat_words`` of a text; null counts as empty."""

    def of(words: Column) -> Column:
        joined = F.array_join(words, "")
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
        chars = F.length(joined).cast("long")
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            chars.alias("word_chars"),
            (chars - F.length(F.regexp_replace(joined, f"[{SYMBOLS}]+", ""))).alias("n_symbols"),
            (chars - F.length(F.regexp_replace(joined, "[A-Z]+", ""))).alias("n_capitals"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            repeated_words(words).alias("n_repeat_words"),
        )

    text = F.coalesce(text.cast("string"), F.lit(""))
    return let(F.array_remove(F.split(text, f"[{SPACE}]+"), ""), of)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that the text holds twice or more.

    Windows are told apart by a 64-bit hash of their words: among a text's own million
    windows two that differ are taken for equal with a chance of 3e-8. Texts without a
    repeated window, which is most of them, are done after a look for distinct hashes.
    """
    n = F.size(words) - (window - 1)

    def covered(hashes: Column) -> Column:
        at = F.struct
        ordered = F.array_sort(F.transform(hashes, lambda x, i: at(x.alias("h"), i.alias("i"))))

        def twice(o: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(o, k)["h"] == x["h"], F.lit(False))
            places = F.transform(
                F.filter(F.transform(o, lambda x, k: at(x["i"].alias("i"), (same(x, k - 1) | same(x, k + 1)).alias("twice"))), lambda x: x["twice"]),
                lambda x: x["i"],
            )
            start = at(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("words"))
            step = lambda s, i: at(i.alias("last"), (s["words"] + F.least(i - s["last"], F.lit(window))).alias("words"))
            return F.aggregate(F.array_sort(places), start, step, lambda s: s["words"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, twice))

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, n), lambda _, i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))

    some = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), covered))
    return F.when(n >= 2, some).otherwise(F.lit(0).cast("long"))


def _fixed(x: Column) -> Column:
    return F.floor(x * UNIT + 0.5).cast("long")


def _share(part: Column, whole: Column) -> Column:
    return F.sqrt(part.cast("double") / F.greatest(whole, F.lit(1)).cast("double"))


def vector() -> list[Column]:
    """The transformed statistics as fixed-point numbers, in the order of ``STATISTICS``."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return [
        _fixed(F.log(words.cast("double") + 1)),
        _fixed(F.log((chars.cast("double") + 1) / (words.cast("double") + 1))),
        _fixed(_share(F.col("n_symbols"), chars)),
        _fixed(_share(F.col("n_capitals"), chars)),
        _fixed(_share(F.col("n_dup_lines"), F.col("n_lines"))),
        _fixed(_share(F.col("n_repeat_words"), words)),
    ]


def _number(x: float) -> str:
    """A literal that SQL reads as this very double."""
    return f"{x:.17e}"


class Estimates:
    """Centres ``_m0..`` and lower-triangular whitening weights ``_w0_0..`` per group of rows
    with the fixed-point columns ``_x0..``. The many small expressions are SQL text, which the
    tests read too."""

    def __init__(self, floors: list[float]):
        self.p = len(floors)
        self.floors = [(f * UNIT) ** 2 for f in floors]
        p = self.p
        y = [" + ".join(f"_w{i}_{j} * (_x{j} - _m{j})" for j in range(i + 1)) for i in range(p)]
        #: The squared Mahalanobis distance of a row joined with its group's estimate.
        self.distance = " + ".join(f"({t}) * ({t})" for t in y)
        self.cell = f"CAST(least(floor(sqrt({self.distance}) * {_number(CELLS)}), {_number(LAST_CELL)}) AS INT)"
        self.columns = ["_group", *(f"_m{i}" for i in range(p)), *(f"_w{i}_{j}" for i in range(p) for j in range(i + 1))]
        #: Sums that mean and covariance are made of; exact, and doubles only at the end.
        self.sums = [
            "CAST(count(*) AS DOUBLE) AS _n",
            *(f"CAST(sum(_x{i}) AS DOUBLE) AS _s{i}" for i in range(p)),
            *(f"CAST(sum(CAST(_x{i} * _x{j} AS DECIMAL(28, 0))) AS DOUBLE) AS _p{i}_{j}" for i in range(p) for j in range(i + 1)),
        ]

    def whitening(self) -> list[list[str]]:
        """From the sums to the centres and the inverse of the covariance's Cholesky factor:
        lists of expressions, each list of what the lists before it have made."""
        p = self.p

        def rest(i: int, j: int) -> str:
            floor = f" + {_number(self.floors[j])}" if i == j else ""
            return f"(_p{i}_{j} - _s{i} * _m{j}) / _n{floor}" + "".join(f" - _l{i}_{k} * _l{j}_{k}" for k in range(j))

        levels = [[f"_s{i} / _n AS _m{i}" for i in range(p)]]
        for j in range(p):
            levels.append([f"sqrt(greatest({rest(j, j)}, {_number(self.floors[j] / 1024)})) AS _l{j}_{j}"])
            levels.append([f"({rest(i, j)}) / _l{j}_{j} AS _l{i}_{j}" for i in range(j + 1, p)])
        levels.append([f"{_number(1)} / _l{i}_{i} AS _w{i}_{i}" for i in range(p)])
        for d in range(1, p):
            below = lambda i, j: " + ".join(f"_l{i}_{k} * _w{k}_{j}" for k in range(j, i))
            levels.append([f"-({below(j + d, j)}) / _l{j + d}_{j + d} AS _w{j + d}_{j}" for j in range(p - d)])
        return [x for x in levels if x]

    def whitened(self, sums: DataFrame) -> DataFrame:
        for level in self.whitening():
            sums = sums.selectExpr("*", *level)
        return sums.select(*self.columns)

    def first(self, rows: DataFrame) -> DataFrame:
        """Medians, and spreads from the quartiles, of each statistic alone."""
        cells = ", ".join(f"struct({i} AS s, CAST(floor(_x{i} / {COARSE}) AS INT) AS c)" for i in range(self.p))
        counted = rows.selectExpr("_group", f"inline(array({cells}))").groupBy("_group", "s", "c").agg(F.count(F.lit(1)).alias("_n"))
        quartiles = _running(counted, ["_group", "s"], "c").groupBy("_group", "s").agg(
            *(_at_share(q, "c").cast("double").alias(n) for q, n in ((0.25, "a"), (0.5, "b"), (0.75, "c")))
        )
        spread = f"((c - a) * {_number(COARSE / 1.349)})"
        floor = f"element_at(array({', '.join(map(_number, self.floors))}), s + 1)"
        each = quartiles.selectExpr("_group", "s", f"(b + 5e-1) * {_number(COARSE)} AS m", f"1e0 / sqrt({spread} * {spread} + {floor}) AS w")
        of = [f"max(CASE WHEN s = {i} THEN {c} END) AS _{c}{i}" + f"_{i}" * (c == "w") for c in "mw" for i in range(self.p)]
        found = each.groupBy("_group").agg(*map(F.expr, of))
        return found.selectExpr("*", *(f"0e0 AS _w{i}_{j}" for i in range(self.p) for j in range(i))).select(*self.columns)

    def limits(self, rows: DataFrame, estimates: DataFrame, share: float) -> DataFrame:
        """``_group, _limit``: the cell of distance within which the share of a group lies."""
        counted = rows.join(estimates, "_group").selectExpr("_group", f"{self.cell} AS _cell").groupBy("_group", "_cell")
        cells = _running(counted.agg(F.count(F.lit(1)).alias("_n")), ["_group"], "_cell")
        return cells.groupBy("_group").agg(_at_share(share, "_cell").alias("_limit"))

    def concentrated(self, rows: DataFrame, estimates: DataFrame) -> DataFrame:
        """The next estimates: mean and covariance of the covered share of each group."""
        near = rows.join(estimates, "_group").filter(f"{self.cell} <= _limit")
        return self.whitened(near.groupBy("_group").agg(*map(F.expr, self.sums)))


def _running(cells: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """``cells`` (keys, cell, _n) with the running sum ``_run`` and the group's total ``_all``;
    a group has a bounded number of cells."""
    whole = Window.partitionBy(*keys)
    return cells.withColumns({"_run": F.sum("_n").over(whole.orderBy(cell)), "_all": F.sum("_n").over(whole)})


def _at_share(share: float, cell: str) -> Column:
    """The first cell at which the running sum has reached the share of the total."""
    return F.expr(f"min(CASE WHEN _run >= {_number(share)} * _all THEN {cell} END)")


def group_estimates(rows: DataFrame, floors: list[float], *, covered: float = COVERED, steps: int = STEPS) -> DataFrame:
    """The minimum-covariance-determinant estimate of each ``_group`` of ``rows``: centres,
    weights, and ``_scale``, by which squared distances are comparable with the chi-square
    distribution (the covered share's own spread is too small; floors only widen it)."""
    e = Estimates(floors)
    found = materialize(e.first(rows), "start")
    for _ in range(steps):
        limits = e.limits(rows, found, covered)
        found = materialize(e.concentrated(rows, found.join(limits, "_group")), "centres")
    middle = f"((_limit + 5e-1) / {_number(CELLS)})"
    scale = f"least(1e0, {_number(chi_square_quantile(0.5, e.p))} / ({middle} * {middle})) AS _scale"
    limits = e.limits(rows, found, 0.5).selectExpr("_group", scale)
    return materialize(found.join(limits, "_group"), "estimates")


def quality_verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_cols: tuple[str, str] = ("lang", "source"),
    *,
    least_rows: int = LEAST_ROWS,
    covered: float = COVERED,
    steps: int = STEPS,
    stay: float = STAY,
    floors: dict[str, float] = STATISTICS,
    text_of: Callable[[Column], Column] = text_statistics,
) -> DataFrame:
    """``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``
    and ``distance`` (squared and scaled; null without an estimate) per row.

    ``stay`` is the share of rows that would stay if a group's usual vectors were normal.
    Rows that fail a base rule are rejected and take no part in the estimates. Sources with
    fewer than ``least_rows`` others are taken together with the small sources of their
    language; where these are too few as well, base rules alone decide.

    Defined results: null text counts as empty, which fails the base rules; null language
    and null source are a language and a source of their own; repeated rows and null ids
    count as often as they occur; an empty table gives an empty table; other columns are
    ignored. Very long texts are one row's arrays of words and of hashes.
    """
    lang, source = group_cols
    counted = docs.select(
        F.col(id_col).alias("_id"), F.col(lang).cast("string").alias("_lang"), F.col(source).cast("string").alias("_source"),
        text_of(F.col(text_col)).alias("_s"),
    )
    plain = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_repeat_words")
    stats = materialize(
        counted.select("_id", "_lang", "_source", *(f"_s.{c}" for c in plain), F.col("_s.lines.n").alias("n_lines"), F.col("_s.lines.dup").alias("n_dup_lines")),
        "statistics",
    )
    names = [f"_x{i}" for i in range(len(floors))]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    named = stats.withColumns({"base_failed": failed, **dict(zip(names, vector()))})
    usual = named.filter("not base_failed")
    # lengths before the names, and a mark for null, keep every pair's key its own
    part = lambda c: F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-"))
    sizes = usual.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_size"))
    groups = sizes.select(
        F.col("_lang").alias("_gl"), F.col("_source").alias("_gs"), "_size",
        F.concat(part(F.col("_lang")), F.when(F.col("_size") >= least_rows, part(F.col("_source"))).otherwise(F.lit("*"))).alias("_group"),
    )
    total = F.sum("_size").over(Window.partitionBy("_group"))
    enough = groups.withColumn("_total", total).filter(F.col("_total") >= least_rows).select("_gl", "_gs", "_group")
    known = materialize(enough, "groups")
    own = F.col("_lang").eqNullSafe(F.col("_gl")) & F.col("_source").eqNullSafe(F.col("_gs"))
    rows = usual.join(known, own).select("_group", *names)
    found = group_estimates(materialize(rows, "vectors"), list(floors.values()), covered=covered, steps=steps)
    judged = named.join(known, own, "left").join(found, "_group", "left")
    distance = F.expr(f"({Estimates(list(floors.values())).distance}) * _scale")
    limit = chi_square_quantile(stay, len(names))
    shown = judged.withColumn("distance", F.when(~F.col("base_failed"), distance))
    return shown.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))).alias("kept"),
        "distance",
    )
