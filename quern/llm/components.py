"""Connected components over a table of links, distributed and round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import materialize


def components(links: DataFrame, larger: str = "a", smaller: str = "b") -> DataFrame:
    """``node, root`` for every node of ``links`` but the roots; a root is the smallest
    node of its component.

    Every link points from a larger to a smaller node. A round *hooks* (all smaller
    neighbours of a node are linked to the smallest of them) and *jumps* (a link to a
    node is moved to that node's own smallest neighbour), which keeps what is connected
    connected and halves paths. It ends when each node has one link and that leads to a
    root. The joins of a round read written tables on both sides, so Spark broadcasts a
    side of small measured size and otherwise splits a hot node's links; nothing is
    gathered on the driver but row counts.
    """
    now = materialize(
        links.select(F.col(larger).alias("a"), F.col(smaller).alias("b")).filter("a > b").distinct(), "links"
    )
    while True:
        least = materialize(now.groupBy("a").agg(F.min("b").alias("p")), "least")
        of_least = least.select(F.col("a").alias("q"), F.col("p").alias("pq"))
        single = now.count() == least.count()
        if single and now.join(of_least, now["b"] == of_least["q"], "left_semi").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        hooked = now.join(least, "a").select(
            F.when(F.col("b") == F.col("p"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("p").alias("b")
        )
        jumped = hooked.join(of_least, F.col("b") == F.col("q"), "left").select(
            "a", F.coalesce("pq", "b").alias("b")
        )
        now = materialize(jumped.distinct(), "links")
