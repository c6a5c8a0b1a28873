"""Masked softmax and top-k alternatives over logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import constants as C


def masked_softmax(logits: Column, vocabulary: str, allowed: str) -> Column:
    """Probabilities over the allowed classes, as ARRAY<STRUCT<p, ch>>; a class that is not allowed has none."""
    places = [i for i, ch in enumerate(vocabulary) if ch in allowed]
    top = F.greatest(*[logits[i] for i in places]) if len(places) > 1 else logits[places[0]]
    exps = F.array(*[F.struct(F.exp(logits[i] - top).alias("p"), F.lit(vocabulary[i]).alias("ch")) for i in places])
    total = F.aggregate(exps, F.lit(0.0), lambda s, x: s + x["p"])
    return F.transform(exps, lambda x: F.struct((x["p"] / total).alias("p"), x["ch"].alias("ch")))


def top_k(probabilities: Column, k: int = 4) -> Column:
    """The k likeliest, ties by character."""
    ranked = F.array_sort(F.transform(probabilities, lambda x: F.struct((-x["p"]).alias("q"), x["ch"].alias("ch"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: F.struct(x["ch"].alias("ch"), (-x["q"]).alias("p")))


def hypotheses(glyphs: DataFrame, allowed: str, logits: str = "logits", vocabulary: str = C.FULL_VOCABULARY, k: int = 4) -> DataFrame:
    """Adds ch, conf (unrounded) and alts (rounded to 4 places) to rows with logits; ``?`` at 0.5 without any."""
    best = glyphs.withColumn("__top", F.when(F.col(logits).isNotNull(), top_k(masked_softmax(F.col(logits), vocabulary, allowed), min(k, len(allowed)))))
    first = F.get("__top", F.lit(0))
    return best.withColumns({"ch": F.coalesce(first["ch"], F.lit("?")), "conf": F.coalesce(first["p"], F.lit(0.5)), "alts": F.coalesce(F.transform(F.slice("__top", 2, k), lambda x: F.struct(x["ch"].alias("ch"), F.round(x["p"], 4).alias("p"))), F.array().cast("array<struct<ch:string,p:double>>"))}).drop("__top")
