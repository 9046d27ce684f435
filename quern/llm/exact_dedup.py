"""Exact deduplication by skew-safe combining.

Three steps, each comparing the whole text and not only its digest:

1. *locally*: the salt is the number of the reading task, so the map-side partial
   aggregate merges all equal texts of a task before anything moves;
2. *per salt*: the shuffle key is (digest, check, text, salt), so the tasks' winners of a
   text that holds a third of all rows are dealt over as many tasks as there are salts;
3. *globally*: the winners of the salts, at most one per salt and text, are merged by
   (digest, check, text).

Rows get their verdict by a narrow join on (digest, check), which carries no text. The
join is safe because step 3 proves that one (digest, check) pair stands for one text;
should two texts ever share both SHA-256 and MD5, the query stops with an error instead
of merging them. Only groups of two or more rows are joined. Their winners are written to
the shared folder first: the join then has a plain scan on either side, so Spark broadcasts
the winners if their measured size allows it, and otherwise adaptive execution splits a
hot digest.

Everything is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import materialize, shuffle_partitions


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def task_salt(salts: int) -> Column:
    """The reading task's number as a salt: equal texts of one task share it, so they are
    merged before the shuffle, and the tasks' winners of one text part. A task that runs
    again after a loss has the same number."""
    return F.pmod(F.spark_partition_id(), F.lit(salts))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    digest=sha256_digest,
    salts: int | None = None,
) -> DataFrame:
    """One row per input row: its group of equal texts and whether it stays.

    Returns ``id, keep_id, group_size, kept, text_sha256`` where ``id`` has the name
    ``id_col``. Of equal texts the row with the largest id stays. Defined results:

    * null text counts as the empty text;
    * a row with a null id belongs to its group and counts in ``group_size``; it is kept
      only when it is alone (``keep_id`` null);
    * rows that repeat id and text are equal rows: all of them carry the same verdict;
    * an empty table gives an empty table; other columns are ignored.

    ``digest`` may be any function of the text (a weak one only costs time): the MD5
    check and the text comparison keep different texts apart. ``salts`` defaults to the
    session's shuffle partitions, so that the spread of a hot text follows the cluster.
    """
    salts = salts or shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("_id"),
        digest(text).alias("_digest"),
        F.unhex(F.md5(text)).alias("_check"),
        text.alias("_text"),
    )
    per_salt = (
        keyed.withColumn("_salt", task_salt(salts))
        .groupBy("_digest", "_check", "_text", "_salt")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    )
    winners = (
        per_salt.groupBy("_digest", "_check", "_text")
        .agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
        .groupBy("_digest", "_check")
        .agg(
            F.max("_keep").alias("_keep"),
            F.sum("_n").alias("_n"),
            F.count(F.lit(1)).alias("_texts"),
        )
        .withColumn(
            "_n",
            F.when(F.col("_texts") == 1, F.col("_n")).otherwise(
                F.raise_error(F.lit("two different texts share a digest and its check")).cast("long")
            ),
        )
        .filter("_n > 1")
        .select("_digest", "_check", F.col("_keep").alias("_w_keep"), F.col("_n").alias("_w_n"))
    )
    rows = docs.select(
        F.col(id_col).alias("_id"),
        digest(text).alias("_digest"),
        F.unhex(F.md5(text)).alias("_check"),
        F.sha2(text, 256).alias("_sha"),
    )
    joined = rows.join(materialize(winners, "winners"), ["_digest", "_check"], "left")
    alone = F.col("_w_n").isNull()
    keep = F.when(alone, F.col("_id")).otherwise(F.col("_w_keep"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_w_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.coalesce(F.col("_id") == F.col("_w_keep"), F.lit(False)))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def text_digest(text: Column) -> Column:
    """The digest by which verdicts find their texts."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def drop_rows(docs: DataFrame, verdicts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` after ``verdicts`` (``_v_id, _v_sha, _v_stays``, a row per id and text digest):
    rows named there go, but one row stays of those with ``_v_stays``. All columns stay."""
    verdicts = materialize(verdicts, "verdicts")
    named = docs[id_col].eqNullSafe(verdicts["_v_id"]) & (text_digest(docs[text_col]) == verdicts["_v_sha"])
    # a merge join at every size: a broadcast that only small inputs allow would hide what large ones shuffle
    rest = docs.join(verdicts.hint("merge"), named, "left_anti")
    repeated = verdicts.filter("_v_stays")
    if repeated.isEmpty():
        return rest
    equal = docs.join(repeated, named, "left_semi")
    one = equal.groupBy(F.col(id_col).alias("_v_id"), text_digest(F.col(text_col)).alias("_v_sha")).agg(
        F.first(F.struct(*(equal[c] for c in equal.columns))).alias("_v_row")
    )
    return rest.unionByName(one.select("_v_row.*"))


def drop_exact_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    digest=sha256_digest,
    salts: int | None = None,
) -> DataFrame:
    """``docs`` with one row of each group of equal texts, one of the largest id; all columns
    stay.

    The same three steps as ``exact_groups``, but the winner of a group carries its other
    columns along, so no join brings them back and a text moves twice in all. A null id
    stays only if its group has no other. Of rows that repeat id and text any one stays;
    rows that share an id but not the text are told apart; null and empty texts are equal,
    and the winner keeps its own.
    """
    salts = salts or shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(F.col(text_col).isNull().alias("no_text"), F.struct(*(F.col(c) for c in others)).alias("others"))
    keyed = docs.select(
        digest(text).alias("_digest"),
        F.unhex(F.md5(text)).alias("_check"),
        text.alias("_text"),
        task_salt(salts).alias("_salt"),
        F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id")).alias("_order"),
        row.alias("_row"),
    )
    best = (F.max_by("_row", "_order").alias("_row"), F.max("_order").alias("_order"))
    per_salt = keyed.groupBy("_digest", "_check", "_text", "_salt").agg(*best)
    winners = per_salt.groupBy("_digest", "_check", "_text").agg(*best)
    kept_text = F.when(~F.col("_row.no_text"), F.col("_text").cast(docs.schema[text_col].dataType))
    return winners.select(
        *(kept_text.alias(c) if c == text_col else F.col("_row.others")[c].alias(c) for c in docs.columns)
    )
