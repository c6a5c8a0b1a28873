"""Ranks by a prefix sum over ranges of rows, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.session import fresh_path


def placed(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """The rows with the range of ``order`` they fall in (``__part``) and their place in it (``__place``, from 0), written once.

    The bounds come from a sample of all columns of the order, so that many rows of one leading value are cut by the
    others. What is written has fixed parts and places; a plan that was run again would draw other bounds.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, "placed")
    row = F.monotonically_increasing_id()  # the partition in the upper bits, the row's place in the lower 33
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__row", row)
    ranged.write.parquet(path)
    read = spark.read.schema(ranged.schema).parquet(path)
    return read.select(*[F.col(f"`{c}`") for c in rows.columns], F.shiftright("__row", 33).cast("int").alias("__part"), F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)).alias("__place"))


def ranked(rows: DataFrame, within: list[str], order: list[str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds the rank (from 1) of each row by ``order`` among the rows of its group ``within`` (none: among all).

    The first pass counts each group's rows in each range (for one group a row a range), sums of the counts are the
    numbers before, and the second pass adds the places. No task holds more than a range, however large a group is.
    Equal rows get different ranks in no fixed order; nulls come first.
    """
    some = placed(rows, [*within, *order], parts)
    keys = ["__part", *[f"__g{i}" for i in range(len(within))]]
    some = some.withColumns({f"__g{i}": F.col(f"`{c}`") for i, c in enumerate(within)})
    counts = some.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    line = Window.partitionBy(*keys[1:]).orderBy("__part")
    before = counts.select(*[F.col(k).alias(f"{k}_") for k in keys], (F.sum("__n").over(line) - F.col("__n") - F.col("__first")).alias("__before"))
    same: Column = F.col("__part") == F.col("__part_")
    for k in keys[1:]:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    if not within:
        before = F.broadcast(before)  # a row a range
    out = some.join(before, same)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__place") + F.col("__before") + 1).alias(name))
