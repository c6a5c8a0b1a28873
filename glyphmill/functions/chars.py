"""Column helpers over character hypotheses: ``ARRAY<STRUCT<ch, conf, alts: ARRAY<STRUCT<ch, p>>>>``."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

HYPOTHESES = "array<struct<ch:string,conf:double,alts:array<struct<ch:string,p:double>>>>"


def is_digit(c: Column) -> Column:
    return (F.length(c) == 1) & c.between("0", "9")


def is_letter(c: Column) -> Column:
    return (F.length(c) == 1) & (c.between("A", "Z") | c.between("a", "z"))


def alternatives(item: Column) -> Column:
    """Its alternatives; none for null."""
    return F.coalesce(item["alts"], F.array().cast("array<struct<ch:string,p:double>>"))


def digit_alternatives(item: Column) -> Column:
    return F.filter(alternatives(item), lambda a: is_digit(a["ch"]))


def letter_alternatives(item: Column) -> Column:
    return F.filter(alternatives(item), lambda a: is_letter(a["ch"]))


def first_alternative(some: Column) -> Column:
    """The first one's character, or null."""
    return F.get(some, F.lit(0))["ch"]


def char_at(hyp: Column, pos: int, default: str) -> Column:
    return F.coalesce(F.get(hyp, F.lit(pos))["ch"], F.lit(default))


def raw_text(hyp: Column) -> Column:
    return F.array_join(F.transform(hyp, lambda x: x["ch"]), "")


def least_confidence(hyp: Column) -> Column:
    return F.coalesce(F.array_min(F.transform(hyp, lambda x: x["conf"])), F.lit(0.0))


def mean_confidence(hyp: Column) -> Column:
    total = F.aggregate(hyp, F.lit(0.0), lambda s, x: s + x["conf"])
    return F.when(F.size(hyp) > 0, total / F.size(hyp)).otherwise(F.lit(0.0))


def literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])


def field_kind(label: Column) -> Column:
    """date, pin, code or other, by the first of these words in a label."""
    low = F.lower(label)
    return F.when(low.contains("date"), "date").when(low.contains("pin"), "pin").when(low.contains("code"), "code").otherwise("other")
