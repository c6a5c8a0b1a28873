"""Log documents of varying shape: JSON texts as VARIANT, typed fields by path, bad documents kept apart with a reason.

A field of a document is read by its path with the type that is wanted: numbers in quotes count, what can't be cast (an
object or list where a number is wanted) is null and named in ``retyped``. Fields that are missing, or null in the
document, are null and are not named.

Defined cases: a null or blank text is ``empty``, one that is no JSON (cut off) ``broken``, a number, text,
list or null at the top ``not an object``; all others are ``ok``. Of a key that a document repeats VARIANT refuses the
whole document, so that it is ``broken``. What follows a whole document in its text is not read. Other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``doc`` (VARIANT, null unless ok) and ``reason``."""
    body = F.col(f"`{text}`")
    raw = F.try_parse_json(body)
    shape = F.schema_of_variant(raw)
    reason = F.when(body.isNull() | (F.trim(body) == ""), "empty").when(raw.isNull(), "broken").when(~shape.startswith("OBJECT"), "not an object").otherwise("ok")
    out = rows.withColumn("reason", reason)
    return out.withColumn("doc", F.when(F.col("reason") == "ok", raw))


def typed(rows: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds the fields (name -> (path, type)) of ``doc`` and ``retyped``, the names of those that are there but of another type."""
    doc = F.col("doc")

    def there(path: str) -> Column:
        """Whether a document has a value there that is not null."""
        value = F.try_variant_get(doc, path, "variant")
        return value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(False))

    out = rows.select("*", *[F.try_variant_get(doc, path, kind).alias(name) for name, (path, kind) in fields.items()])
    wrong = F.array(*[F.when(F.col(name).isNull() & there(path), F.lit(name)) for name, (path, _) in fields.items()])
    return out.withColumn("retyped", F.array_compact(wrong))


def shape_of(rows: DataFrame) -> DataFrame:
    """One row: the shape that all documents that are ok have in common, and how many documents have each reason."""
    counts = F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n"))))
    by = rows.groupBy("reason").agg(F.count("*").alias("n")).agg(counts.alias("documents"))  # a row a reason
    return rows.agg(F.schema_of_variant_agg("doc").alias("shape")).join(F.broadcast(by))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents that are ok, and the others without ``doc``."""
    return rows.where("reason = 'ok'"), rows.where("reason <> 'ok'").drop("doc")
