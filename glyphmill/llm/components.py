"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of all nodes of ``edges`` (a, b): the smallest node of their component.

    Nothing is collected; a node with very many neighbours is one row of a grouped minimum, and its rows of the join
    can be split. The number of rounds grows with the logarithm of the longest path. It ends when a round changes no
    edge: a set of edges that a round gives again is one of stars, which no further round changes.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    count = now.count()
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = written(small.distinct(), "edges")
        before, count, old = count, after.count(), now
        now = after
        if before == count and old.join(now, ["a", "b"], "left_anti").isEmpty():  # equal sets of equal size
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
