"""Rule-based repair of decoded texts; one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import constants as C
from glyphmill.functions.chars import digit_alternatives, first_alternative, is_digit, is_letter, letter_alternatives


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _digit_at(hyp: Column, i: Column) -> Column:
    return first_alternative(digit_alternatives(F.get(hyp, i)))


def verified_date(text: Column, hyp: Column) -> Column:
    """Separators, digits, then day and month brought into range; texts under ten characters stay."""
    sep = F.when(text.contains("/"), "/").otherwise("-")

    def fixed(c: Column, i: Column) -> Column:
        digit = F.when(is_digit(c), c).otherwise(F.coalesce(_digit_at(hyp, i), F.when(i >= 6, "2").otherwise("1")))
        return F.when(i.isin(2, 5), F.when(c.isin("/", "-"), c).otherwise(sep)).otherwise(digit)

    ten = F.array_join(F.transform(F.slice(_chars(text), 1, 10), fixed), "")
    number = lambda at: F.substring(ten, at, 2)
    day = F.when(number(1) > "31", F.concat(F.lit("2"), F.substring(ten, 2, 9))).otherwise(ten)
    month = F.when(number(4) > "12", F.concat(F.substring(day, 1, 3), F.lit("0"), F.substring(day, 5, 6))).otherwise(day)
    return F.when(F.length(text) >= 10, month).otherwise(text)


def verified_code(text: Column, hyp: Column) -> Column:
    split = F.when(F.length(text) <= 7, 2).otherwise(3)

    def fixed(c: Column, i: Column) -> Column:
        letter = F.when(is_letter(c), c).when(i < F.size(hyp), F.coalesce(F.upper(first_alternative(letter_alternatives(F.get(hyp, i)))), F.lit("A"))).otherwise(c)
        digit = F.when(is_digit(c), c).when(i < F.size(hyp), F.coalesce(_digit_at(hyp, i), F.lit("0"))).otherwise(c)
        return F.when(i == split, "-").when(i < split, letter).otherwise(digit)

    return F.array_join(F.transform(_chars(text), fixed), "")


def verified_pin(text: Column, hyp: Column) -> Column:
    return F.array_join(F.transform(F.slice(_chars(text), 1, 6), lambda c, i: F.when(is_digit(c), c).otherwise(F.coalesce(_digit_at(hyp, i), F.lit("0")))), "")


def verify(decoded: DataFrame, text: str = "text", hyp: str = "hyp", kind: str = "field_type") -> DataFrame:
    """Adds verified_text, sem_conf and sem_note."""
    t, h, k = F.col(text), F.col(hyp), F.col(kind)
    out = F.when(k == "date", verified_date(t, h)).when(k == "code", verified_code(t, h)).when(k == "pin", verified_pin(t, h)).otherwise(t)
    conf = F.when((k == "date") & (F.length(t) >= 10), C.VERIFIED["date"]).when(k == "code", C.VERIFIED["code"]).when(k == "pin", C.VERIFIED["pin"]).otherwise(C.VERIFIED["other"])
    return decoded.withColumn("verified_text", out).withColumn("sem_conf", conf).withColumn("sem_note", F.when(F.col("verified_text") != t, F.concat(t, F.lit(" to "), "verified_text")).otherwise(""))
