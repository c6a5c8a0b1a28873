"""Field lists and responses: filters, look-ups, defaults, labels and display values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import constants as C
from glyphmill.functions.chars import field_kind

# Labels that the screens show, and the names they stand for.
MODE_LABELS = {"raw": "raw_cnn", "grammar": "grammar_fsm", "tri": "tri_engine"}


def list_fields(fields: DataFrame, kind: str | None = None, comb: bool | None = None) -> DataFrame:
    """Fields of one type (any case; None, '' or 'all': every type) and one layout (None: both)."""
    out = fields
    if kind and kind.lower() != "all":
        out = out.where(F.lower("field_type") == kind.lower())
    return out if comb is None else out.where(F.col("is_comb_box") == comb)


def search_fields(fields: DataFrame, kind: str | None = None, comb: bool | None = None, text: str | None = None) -> DataFrame:
    """Also by a part of the id, the true text or the type, in any case."""
    out = list_fields(fields, kind, comb)
    if not text:
        return out
    low = text.lower()
    return out.where(F.col("id").cast("string").contains(low) | F.lower("ground_truth").contains(low) | F.lower("field_type").contains(low))


def capitalized(c: Column) -> Column:
    """The first letter upper, the rest lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000)))


def basename(path: Column) -> Column:
    """The last part of a path with either kind of separator."""
    return F.element_at(F.split(path, r"[\\/]"), -1)


def described(fields: DataFrame) -> DataFrame:
    """One row per field for display: type label, file name, layout, cell count (num_chars, then the text's length), url."""
    name = F.coalesce("filename", basename(F.col("image_path")))
    return fields.select("id", capitalized(F.col("field_type")).alias("type_label"), name.alias("filename"), F.when(F.col("is_comb_box"), "Comb Box").otherwise("Freeform").alias("layout"), F.coalesce("num_chars", F.length("ground_truth")).alias("cells"), F.concat(F.lit("/api/image/"), name).alias("image_url"))


def lookup(fields: DataFrame, kind: str, field_id: int) -> DataFrame:
    return fields.where((F.col("field_type") == kind) & (F.col("id") == field_id)).orderBy("id").limit(1)


def enriched(requests: DataFrame, fields: DataFrame) -> DataFrame:
    """Requests with the known field's type, layout and cell count in place of the caller's."""
    known = fields.select(F.col("field_type").alias("k_type"), "id", F.col("is_comb_box").alias("k_comb"), F.col("num_chars").alias("k_cells"))
    out = requests.join(known, "id", "left")
    return out.select("id", F.coalesce("k_type", "field_type").alias("field_type"), F.coalesce("k_comb", "is_comb_box").alias("is_comb_box"), F.coalesce("k_cells", "cells").alias("cells"))


def enriched_stored(requests, fields) -> DataFrame:
    """The same from two stores with as many buckets on the id: they are merged bucket by bucket, without an exchange."""
    if requests.buckets != fields.buckets:
        raise ValueError("both stores need as many buckets")
    return enriched(requests.table(), fields.table().hint("merge"))


def confidence_split(rows: DataFrame, theta: float, conf: str = "conf") -> DataFrame:
    return rows.withColumn("bucket", F.when(F.col(conf) >= theta, "accepted").otherwise("flagged"))


def badge(conf: Column) -> Column:
    return F.when(conf >= 0.90, "success").when(conf >= 0.75, "warning").otherwise("danger")


def vocabulary_for(label: Column) -> tuple[Column, Column]:
    """(allowed characters, default length) of a type label."""
    kind = field_kind(label)
    chars = F.when(kind == "date", C.DATE_VOCABULARY).when(kind == "pin", C.PIN_VOCABULARY).otherwise(C.FULL_VOCABULARY)
    length = F.when(kind == "date", C.DEFAULT_LENGTH["date"]).when(kind == "pin", C.DEFAULT_LENGTH["pin"]).otherwise(C.DEFAULT_LENGTH["code"])
    return chars, length


def mode_from_label(label: Column) -> Column:
    """The mode of a screen label; an unknown one means tri_engine."""
    low = F.lower(label)
    out = F.lit("tri_engine")
    for part, mode in MODE_LABELS.items():
        out = F.when(low.startswith(part), mode).otherwise(out)
    return out


def response(predictions: DataFrame) -> DataFrame:
    """Display values: rounded and percent confidences, exactness (null without truth), badge."""
    return predictions.select("field_type", "id", "mode", "text", F.round("conf", 4).alias("min_conf"), F.round("mean_conf", 4).alias("mean_conf"), F.round(F.col("conf") * 100, 1).alias("conf_pct"), F.when(F.col("ground_truth").isNotNull(), F.col("text") == F.col("ground_truth")).alias("exact"), badge(F.col("conf")).alias("badge"))


def presets(fields: DataFrame, n: int = 6) -> DataFrame:
    return fields.orderBy("id", "field_type").limit(n)


def swapped(text: Column, at: Column, ch: Column) -> Column:
    """The text with another character at a place (from 0)."""
    return F.overlay(text, ch, at + 1, F.lit(1))


def data_uri(content: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def from_data_uri(text: Column) -> Column:
    """The bytes behind an optional data-URI prefix; null if they are not base64."""
    body = F.when(F.instr(text, ",") > 0, F.substring(text, F.instr(text, ",") + F.lit(1), F.length(text))).otherwise(text)
    return F.try_to_binary(body, F.lit("base64"))
