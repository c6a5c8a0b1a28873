"""Accuracy, confusions and the threshold sweep over predictions (mode, text, ground_truth, conf, syntax_valid)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import constants as C
from glyphmill.functions.session import fresh_path


def _matches():
    """Equal characters at equal places, over the shorter length."""
    n = F.least(F.length("text"), F.length("ground_truth"))
    hits = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda s, i: s + (F.substr("text", i, F.lit(1)) == F.substr("ground_truth", i, F.lit(1))).cast("int"))
    return n, hits


def leaderboard(predictions: DataFrame) -> DataFrame:
    """Per mode: fields, characters compared, character accuracy and exact rate in percent, error rate."""
    n, hits = _matches()
    per = predictions.select("mode", n.alias("n"), hits.alias("hits"), (F.col("text") == F.col("ground_truth")).cast("int").alias("exact"))
    out = per.groupBy("mode").agg(F.count("*").alias("fields"), F.sum("n").alias("chars"), F.sum("hits").alias("hits"), F.sum("exact").alias("exact"))
    accuracy = F.round(100.0 * F.col("hits") / F.greatest(F.col("chars"), F.lit(1)), 2)
    return out.select("mode", "fields", "chars", "exact", accuracy.alias("char_accuracy"), F.round(100.0 * F.col("exact") / F.col("fields"), 2).alias("exact_rate"), F.round(100.0 - accuracy, 2).alias("error_rate"))


def edit_error_rate(predictions: DataFrame) -> DataFrame:
    """An extension: edits per true character and mode, in percent."""
    out = predictions.groupBy("mode").agg(F.sum(F.levenshtein("text", "ground_truth")).cast("long").alias("edits"), F.sum(F.length("ground_truth")).alias("chars"))
    return out.select("mode", "edits", "chars", F.round(100.0 * F.col("edits") / F.col("chars"), 2).alias("cer"))


def confusions(predictions: DataFrame, mode: str = "raw_cnn") -> DataFrame:
    """Counts of (true, read) characters that differ at the same place."""
    n, _ = _matches()
    at = predictions.where(F.col("mode") == mode).where(n > 0).select("text", "ground_truth", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    pairs = at.select(F.substr("ground_truth", F.col("i"), F.lit(1)).alias("truth"), F.substr("text", F.col("i"), F.lit(1)).alias("pred"))
    return pairs.where("truth <> pred").groupBy("truth", "pred").agg(F.count("*").alias("n"))


def top_confusions(predictions: DataFrame, mode: str = "raw_cnn", k: int = 10) -> DataFrame:
    return confusions(predictions, mode).orderBy(F.desc("n"), "truth", "pred").limit(k)


def threshold_sweep(predictions: DataFrame, mode: str = "tri_engine", conf: str = "conf", thresholds=C.THRESHOLDS) -> DataFrame:
    """Per threshold the accepted share, their accuracy and the review share; one pass over the predictions."""
    rows = predictions.where(F.col("mode") == mode).select(F.col(conf).alias("conf"), (F.col("text") == F.col("ground_truth")).alias("right"))
    named = [(t, f"t{i}") for i, t in enumerate(thresholds)]
    sums = rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("conf") >= t).alias(f"{n}_auto") for t, n in named], *[F.count_if((F.col("conf") >= t) & F.col("right")).alias(f"{n}_right") for t, n in named])
    cells = F.array(*[F.struct(F.lit(t).alias("theta"), F.col(f"{n}_auto").alias("accepted"), F.col(f"{n}_right").alias("right")) for t, n in named])
    flat = sums.select("total", F.explode(cells).alias("c")).select("total", "c.*")
    auto = F.round(100.0 * F.col("accepted") / F.greatest("total", F.lit(1)), 1)
    return flat.select("theta", "accepted", auto.alias("auto_rate"), F.round(100.0 * F.col("right") / F.greatest("accepted", F.lit(1)), 1).alias("accuracy"), F.round(100.0 * (F.col("total") - F.col("accepted")) / F.greatest("total", F.lit(1)), 1).alias("review_rate"))


BUCKETS = 4096


def confidence_table(predictions: DataFrame, by: tuple[str, ...] = ("mode", "field_type", "is_comb_box"), conf: str = "conf") -> DataFrame:
    """For every combination of ``by``, each also as ``all``, and each distinct confidence: what a gate at it lets through.

    Rows (by..., conf, lower, total, accepted, approved, right): fields at or above the confidence, those of them with
    valid syntax, those that are right; ``lower``: the next smaller confidence of the combination, so that the row holds
    for every threshold in (lower, conf]. The predictions are read once; after one aggregate the sums run over distinct
    confidences, within ``BUCKETS`` of them and then over the buckets, so that no task needs all of a combination. A null
    confidence is below every threshold; a null syntax or truth counts as not valid or not right.
    """
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    flat = predictions.select(*[F.col(c).cast("string").alias(c) for c in by], F.coalesce(F.col(conf), F.lit(-1.0)).alias("conf"), yes(F.col("syntax_valid")).alias("valid"), yes(F.col("text") == F.col("ground_truth")).alias("right"))
    once = flat.groupBy(*by, "conf").agg(F.count("*").alias("n"), F.sum("valid").alias("valid"), F.sum("right").alias("right"))
    path = fresh_path(predictions.sparkSession, "confidences")
    once.write.parquet(path)  # what follows reads it several times, the predictions never again
    once = predictions.sparkSession.read.schema(once.schema).parquet(path)
    sets = [[c for i, c in enumerate(by) if k >> i & 1] + ["conf"] for k in range(1 << len(by))]
    cubed = once.groupingSets([[F.col(c) for c in s] for s in sets], *by, "conf").agg(*[F.when(F.grouping(c) == 1, "all").otherwise(F.coalesce(c, F.lit("none"))).alias(f"g_{c}") for c in by], F.sum("n").alias("n"), F.sum("valid").alias("valid"), F.sum("right").alias("right"))
    rows = cubed.select(*[F.col(f"g_{c}").alias(c) for c in by], "conf", "n", "valid", "right")
    top = rows.select(*by).distinct().select(*by, F.lit(float("inf")).alias("conf"), *[F.lit(0).cast("long").alias(c) for c in ("n", "valid", "right")])
    rows = rows.union(top).withColumn("bucket", F.least(F.floor(F.greatest("conf", F.lit(0.0)) * BUCKETS), F.lit(BUCKETS)))
    names = ("n", "valid", "right")
    sums = rows.groupBy(*by, "bucket").agg(*[F.sum(c).alias(c) for c in names], F.max("conf").alias("highest"))
    above = Window.partitionBy(*by).orderBy(F.desc("bucket"))
    ends = sums.select(*by, "bucket", F.lead("highest").over(above).alias("next_below"), F.sum("n").over(Window.partitionBy(*by)).alias("total"), *[(F.sum(c).over(above) - F.col(c)).alias(f"over_{c}") for c in names])
    inside = Window.partitionBy(*by, "bucket").orderBy(F.desc("conf"))
    placed = rows.withColumns({"lower": F.lead("conf").over(inside), **{f"own_{c}": F.sum(c).over(inside) for c in names}})
    joined = placed.join(ends, [*by, "bucket"])
    value = lambda c: F.col(f"over_{c}") + F.col(f"own_{c}")
    return joined.select(*by, "conf", F.coalesce("lower", "next_below", F.lit(float("-inf"))).alias("lower"), "total", value("n").alias("accepted"), value("valid").alias("approved"), value("right").alias("right"))


def at_thresholds(table: DataFrame, thetas: list[float]) -> DataFrame:
    """The table's rows that hold for each threshold (0 or more): (by..., theta, total, accepted, approved, right); no join."""
    wanted = F.array(*[F.lit(float(t)) for t in thetas])
    own = F.filter(wanted, lambda t: (t > F.col("lower")) & (t <= F.col("conf")))
    return table.withColumn("theta", F.explode(own)).drop("conf", "lower")


def calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """An extension: mean confidence and exact share per mode and confidence bin."""
    level = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).cast("int")
    return predictions.groupBy("mode", level.alias("bin")).agg(F.count("*").alias("fields"), F.round(F.avg("conf"), 4).alias("mean_conf"), F.round(F.avg((F.col("text") == F.col("ground_truth")).cast("int")), 4).alias("exact_share"))
