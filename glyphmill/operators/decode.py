"""Constrained decoding of character hypotheses: dates, PINs and short codes.

Each decoder adds ``text``, ``fsm_conf``, ``valid`` and ``notes`` to its rows, without a shuffle. A lexicon is an
argument: a DataFrame (kind, entry, prefix), read once; see ``lexicon`` for how its nearest entries are found.

Defined cases: a null reading is an empty one; an empty or short reading is invalid; a kind that is null or none of the
three passes as read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import constants as C
from glyphmill.functions.chars import HYPOTHESES, char_at, digit_alternatives, first_alternative, is_digit, is_letter, least_confidence, letter_alternatives, literal_map, raw_text
from glyphmill.operators.lexicon import DIGITS, Finder


def _note(when: Column, *parts) -> Column:
    return F.when(when, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def read_of(hyp: str) -> Column:
    """The reading; an empty one for null."""
    return F.coalesce(F.col(hyp), F.array().cast(HYPOTHESES))


# --- dates ------------------------------------------------------------------------------------------------------


def date_separator(hyp: Column) -> Column:
    return F.when((char_at(hyp, 2, "/") == "/") | (char_at(hyp, 5, "/") == "/"), "/").otherwise("-")


def _snapped(item: Column) -> Column:
    fixed = F.coalesce(F.element_at(literal_map(C.DIGIT_FOR.items()), item["ch"]), F.lit("0"))
    return F.when(is_digit(item["ch"]), item["ch"]).otherwise(F.coalesce(first_alternative(digit_alternatives(item)), fixed))


def _settled(hyp: Column) -> Column:
    """Per place the read character, its digit, and at places 0 and 3 the digit as the tens of a day or month."""

    def tens(alts: Column, digit: Column, allowed: str) -> Column:
        fitting = F.filter(alts, lambda a: a["ch"].isin(*allowed))
        return F.when(digit.isin(*allowed), digit).otherwise(F.coalesce(first_alternative(fitting), F.lit("1")))

    digits = F.transform(F.slice(hyp, 1, 10), lambda x: F.struct(x["ch"].alias("ch"), _snapped(x).alias("digit"), x["alts"].alias("alts")))
    return F.transform(digits, lambda x, i: F.struct(x["ch"], x["digit"], F.when(i == 3, tens(x["alts"], x["digit"], "01")).when(i == 0, tens(x["alts"], x["digit"], "0123")).otherwise(x["digit"]).alias("tens")))


def _date_char(hyp: Column, item: Column, i: Column, sep: Column) -> Column:
    digit, century = item["digit"], char_at(hyp, 7, "0")
    return (
        F.when(i.isin(2, 5), sep)
        .when(
            i == 6,
            F.when((digit == "9") & (century == "0"), "2")
            .when(digit.isin("9", "2") & century.isin("7", "8", "9"), "1")
            .when(digit == "9", F.when(century.isin("0", "1", "2"), "2").otherwise("1"))
            .otherwise(digit),
        )
        .when((i == 3) & (item["tens"] == "0") & (char_at(hyp, 4, "0") == "0"), "1")
        .otherwise(item["tens"])
    )


def _date_note(hyp: Column, item: Column, i: Column, sep: Column) -> Column:
    """The notes of one position, joined by a bar."""
    digit, tens, final, at = item["digit"], item["tens"], _date_char(hyp, item, i, sep), F.concat(F.lit("pos "), i.cast("string"))
    place = ~i.isin(2, 5)
    return F.concat_ws(
        "|",
        _note(i.isin(2, 5) & (item["ch"] != sep), at, ": separator ", sep),
        _note(place & ~is_digit(item["ch"]), at, ": digit ", digit),
        _note(i.isin(0, 3) & (tens != digit), at, ": tens ", tens),
        _note((i == 3) & (final != tens), at, ": month 10"),
        _note((i == 6) & (((digit == "9") & (char_at(hyp, 7, "0") == "0")) | (digit.isin("9", "2") & char_at(hyp, 7, "0").isin("7", "8", "9"))), at, ": century ", final),
    )


def in_calendar_range(text: Column) -> Column:
    """Day 1-31, month 1-12, year 1900-2099; the length of a month is not looked at."""
    part = lambda k: F.coalesce(F.try_to_number(F.regexp_extract(text, r"^(\d{2})[/.-](\d{2})[/.-](\d{4})$", k), F.lit("9999")).cast("int"), F.lit(0))
    return text.rlike(r"^[0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}$") & part(1).between(1, 31) & part(2).between(1, 12) & part(3).between(1900, 2099)


def date_text(hyp: Column) -> Column:
    sep = date_separator(hyp)
    return F.array_join(F.transform(_settled(hyp), lambda x, i: _date_char(hyp, x, i, sep)), "")


def date_notes(hyp: Column) -> Column:
    sep = date_separator(hyp)
    return F.array_join(F.filter(F.transform(_settled(hyp), lambda x, i: _date_note(hyp, x, i, sep)), lambda n: n != ""), "|")


def decode_dates(fields: DataFrame, hyp: str = "hyp") -> DataFrame:
    out = fields.withColumn("text", date_text(read_of(hyp))).withColumn("notes", date_notes(read_of(hyp)))
    return out.withColumn("valid", in_calendar_range(F.col("text"))).withColumn("fsm_conf", F.when(F.col("valid"), C.DATE_VALID).otherwise(C.DATE_INVALID))


# --- lattices ---------------------------------------------------------------------------------------------------


def digit_lattice(hyp: Column, n: int) -> Column:
    """Per position the read digit with its confidence, then up to three digit alternatives."""
    top = lambda x: F.when(is_digit(x["ch"]), x["ch"]).otherwise(F.coalesce(first_alternative(digit_alternatives(x)), F.lit("0")))
    return F.transform(F.slice(hyp, 1, n), lambda x: F.concat(F.array(F.struct(top(x).alias("ch"), x["conf"].alias("p"))), F.slice(digit_alternatives(x), 1, 3)))


def prefix_lattice(hyp: Column, n: Column) -> Column:
    top = lambda x: F.upper(F.when(is_letter(x["ch"]), x["ch"]).otherwise(F.coalesce(first_alternative(letter_alternatives(x)), F.lit("A"))))
    return F.transform(F.slice(hyp, F.lit(1), n), lambda x: F.concat(F.array(F.struct(top(x).alias("ch"), x["conf"].alias("p"))), F.slice(letter_alternatives(x), 1, 3)))


def lattice_text(lattice: Column) -> Column:
    return F.array_join(F.transform(lattice, lambda c: F.get(c, F.lit(0))["ch"]), "")


def lattice_confidence(lattice: Column) -> Column:
    return F.coalesce(F.array_min(F.transform(lattice, lambda c: F.get(c, F.lit(0))["p"])), F.lit(0.0))


def code_split(n: Column) -> Column:
    return F.when(n <= 7, 2).otherwise(3)


def _suffix(hyp: Column, split: Column) -> Column:
    digits = F.transform(hyp, lambda x, i: F.when(i > split, F.when(is_digit(x["ch"]), x["ch"]).otherwise(F.coalesce(first_alternative(digit_alternatives(x)), F.lit("0")))).otherwise(""))
    return F.array_join(digits, "")


# --- all kinds in one projection --------------------------------------------------------------------------------

RESULTS = ["text", "fsm_conf", "valid", "notes", "score"]


def decode(fields: DataFrame, lexicon: DataFrame, hyp: str = "hyp", kind: str = "field_type", registry_substitution: bool = False) -> DataFrame:
    """Adds text, fsm_conf, valid, notes, score and touched (lexicon nodes looked at) to fields of all kinds.

    PINs: exact entries keep their confidence, others take the nearest entry. Codes: the prefix is repaired by the
    prefixes of its length and the read digits are kept; ``registry_substitution`` takes the whole registered code of the
    prefix instead, digits included. What is neither date, PIN nor code passes as read, with its least confidence.
    """
    finder = Finder(lexicon)
    k, h, split = F.coalesce(F.col(kind), F.lit("other")), F.col("__hyp"), code_split(F.size("__hyp"))
    pin, code = k == "pin", k == "code"
    rows = fields.withColumn("__hyp", read_of(hyp))
    rows = rows.withColumn("__lattice", F.when(pin, digit_lattice(h, DIGITS)).when(code, prefix_lattice(h, split)))
    rows = rows.withColumn("__found", finder.column(F.when(pin, "pin").when(code, F.concat(F.lit("code"), split.cast("string"))), F.col("__lattice")))
    rows = rows.withColumn("__raw", lattice_text(F.col("__lattice"))).withColumn("__text", F.when(k == "date", date_text(h)))
    lattice, raw, found = F.col("__lattice"), F.col("__raw"), F.col("__found")
    entry, exact, score = found["entry"], found["exact"], found["score"]
    own = exact | F.lit("pin" not in finder.groups)
    close = F.coalesce(score > C.PIN_FLOOR, F.lit(False))
    whole = F.size(lattice) == DIGITS
    ended = F.size(h) > split + 1  # prefix, separator and a digit at least
    in_range = in_calendar_range(F.col("__text"))
    kept = F.when(F.size(h) > 0, F.concat(F.coalesce(entry, raw), F.lit("-"), _suffix(h, split))).otherwise("")
    registered = F.coalesce(found["whole"], kept) if registry_substitution else kept
    of = lambda date, pin_, code_, other: F.when(k == "date", date).when(pin, pin_).when(code, code_).otherwise(other)
    return rows.select(
        *[F.col(f"`{c}`") for c in fields.columns],
        of(F.col("__text"), F.when(own, raw).otherwise(F.coalesce(entry, raw)), registered, raw_text(h)).alias("text"),
        of(
            F.when(in_range, C.DATE_VALID).otherwise(C.DATE_INVALID),
            F.when(own, lattice_confidence(lattice)).when(close & whole, C.PIN_SNAPPED).otherwise(C.PIN_FAR),
            F.when(~ended, C.PIN_FAR).when(exact, C.CODE_EXACT).when(entry.isNotNull(), C.CODE_SNAPPED).otherwise(C.CODE_FALLBACK),
            least_confidence(h),
        ).alias("fsm_conf"),
        of(in_range, whole & (own | close), ended, F.lit(True)).alias("valid"),
        of(
            date_notes(h),
            F.when(~own & (entry != raw), F.concat(F.lit("pin "), raw, F.lit(" to "), entry)).otherwise(""),
            F.when(~exact & entry.isNotNull(), F.concat(F.lit("prefix "), raw, F.lit(" to "), entry)).otherwise(""),
            F.lit(""),
        ).alias("notes"),
        F.when(~exact, score).alias("score"),
        found["touched"].alias("touched"),
    )


def _of_kind(fields: DataFrame, lexicon: DataFrame, hyp: str, kind: str, registry_substitution: bool = False) -> DataFrame:
    rows = decode(fields.withColumn("__kind", F.lit(kind)), lexicon, hyp, "__kind", registry_substitution)
    return rows.drop("__kind")


def decode_pins(fields: DataFrame, lexicon: DataFrame, hyp: str = "hyp") -> DataFrame:
    return _of_kind(fields, lexicon, hyp, "pin")


def decode_codes(fields: DataFrame, lexicon: DataFrame, hyp: str = "hyp", registry_substitution: bool = False) -> DataFrame:
    return _of_kind(fields, lexicon, hyp, "code", registry_substitution)
