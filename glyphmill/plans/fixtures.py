"""Deterministic inputs for the field operators, from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import constants as C
from glyphmill.functions.session import importable

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# What a character is misread as, by type.
DATE_SWAP = ("218-/0345679", "970.4-------")
PIN_SWAP = ("2184035679", "9706222222")
CODE_SWAP = ("OQDPMHEFABCGIJKLNRSTUVWXYZ2184035679-", "QOPDHMFE777777777777777777" + "9706BBBBBB" + ".")
KEYS = ["field_type", "id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(key):
    letters = [F.substring(F.lit(LETTERS), ((key * (2 * i + 3) + 5 * i) % 26 + 1).cast("int"), F.lit(1)) for i in range(3)]
    return F.concat(letters[0], letters[1], F.when(key % 2 == 1, letters[2]).otherwise(""), F.lit("-"), (1000 + (key * 37) % 9000).cast("string"))


def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_type, id, ground_truth, is_comb_box, num_chars): dates from orders, PINs from customers, codes from parts."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    dates = orders.select(F.lit("date").alias("field_type"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "dd-MM-yyyy")).alias("ground_truth"))
    pins = table(spark, sf_dir, "customer").select(F.lit("pin").alias("field_type"), F.col("c_custkey").alias("id"), (100000 + (F.col("c_custkey") * 7919) % 900000).cast("string").alias("ground_truth"))
    codes = table(spark, sf_dir, "part").select(F.lit("code").alias("field_type"), F.col("p_partkey").alias("id"), _code(F.col("p_partkey")).alias("ground_truth"))
    return dates.union(pins).union(codes).withColumn("is_comb_box", F.col("id") % 2 == 0).withColumn("num_chars", F.length("ground_truth"))


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields with a noisy reading of every character.

    The lambda looks at what it is given only: with a column of the table in it, below the union of the fields and under a
    filter, Spark 4.1 took that column for one of the lambda's own in a fresh session (``key not found: c_custkey``).
    """
    fields = form_fields(spark, sf_dir)

    def swapped(field, c):
        return F.when(field["field_type"] == "date", F.translate(c, *DATE_SWAP)).when(field["field_type"] == "pin", F.translate(c, *PIN_SWAP)).otherwise(F.translate(c, *CODE_SWAP))

    def one(field, pos):
        h = (field["id"] * 31 + pos * 17) % 23
        truth = F.substr(field["ground_truth"], pos + 1, F.lit(1))
        alternatives = F.array(F.struct(truth.alias("ch"), F.lit(0.40).alias("p")), F.struct(F.lit("1").alias("ch"), F.lit(0.03).alias("p")), F.struct(F.lit("A").alias("ch"), F.lit(0.01).alias("p")))
        none = F.array().cast("array<struct<ch:string,p:double>>")
        return F.struct(
            F.when(h == 0, swapped(field, truth)).when(h == 11, "Z").otherwise(truth).alias("ch"),
            F.when(h == 0, 0.55).when(h == 5, 0.82).when(h == 11, 0.45).otherwise(0.99).alias("conf"),
            F.when(h == 0, alternatives).otherwise(none).alias("alts"),
        )

    return fields.withColumn("hyp", F.transform(F.array_repeat(F.struct("field_type", "id", "ground_truth"), F.col("num_chars")), one))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, entry, prefix), not built from the texts that are evaluated."""
    key = F.col("s_suppkey")
    pins = table(spark, sf_dir, "supplier").select(F.lit("pin").alias("kind"), (100000 + (key * 5 * 7919) % 900000 + key % 2).cast("string").alias("entry"), F.lit(None).cast("string").alias("prefix"))
    part = F.col("p_partkey")
    code = _code(part)
    prefix = F.substring_index(code, "-", 1)
    codes = table(spark, sf_dir, "part").where("p_partkey % 7 = 0").select(F.lit("code").alias("kind"), F.concat(prefix, F.lit("-"), (F.substring_index(code, "-", -1).cast("int") + part % 2).cast("string")).alias("entry"), prefix.alias("prefix"))
    return pins.union(codes)


def large_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, entry, prefix): a PIN for each line of an order, at most a million different ones."""
    number = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) * 7919) % 1_000_000
    return table(spark, sf_dir, "lineitem").select(F.lit("pin").alias("kind"), F.lpad(number.cast("string"), 6, "0").alias("entry"), F.lit(None).cast("string").alias("prefix"))


def odd_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of all kinds and of none, with readings that are whole, cut short, empty or missing."""
    rows = hypotheses(spark, sf_dir).withColumn("kept", F.when(F.col("id") % 3 == 0, F.col("num_chars")).otherwise((F.col("id") % (F.col("num_chars") + 1)).cast("int")))
    kind = F.when(F.col("id") % 11 == 4, F.lit(None)).when(F.col("id") % 11 == 7, F.lit("name")).otherwise(F.col("field_type"))
    return rows.select(F.col("field_type").alias("source"), "id", kind.alias("field_type"), "ground_truth", F.when(F.col("id") % 13 == 5, F.lit(None)).otherwise(F.slice("hyp", F.lit(1), F.col("kept"))).alias("hyp"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, logits) over the whole vocabulary."""
    n = len(C.FULL_VOCABULARY)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, n), lambda v: v.cast("double") * 10).alias("logits"))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type") == "signup", "CORRECT").when(F.col("event_type") == "error", "REJECT").otherwise("ACCEPT")
    field = F.when(F.col("user_id") % 4 == 0, "date").when(F.col("user_id") % 4 == 1, "pin").when(F.col("user_id") % 4 == 2, "code")
    return table(spark, sf_dir, "events").select("event_id", "ts", action.alias("action"), field.alias("field_type"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("verified_text"), F.col("value").alias("latency_s"), F.when(F.col("event_type") == "error", "unreadable").alias("notes"), F.when(F.col("event_id") % 3 == 0, "FLAGGED").otherwise("APPROVED").alias("status"))


#: Texts of log documents, by SQL: cut off, nested, retyped, lists, no objects, blank, missing and as they are.
DOCUMENT = """CASE event_id % 9 WHEN 0 THEN substr(props, 1, length(props) - 2) WHEN 1 THEN concat('{"k": {"v": 1}, "who": {"id": ', user_id, '}}')
  WHEN 2 THEN concat('{"k": "', user_id, '", "note": "{', event_type, ', or so}"}') WHEN 3 THEN concat('{"k": [', user_id, ', 2], "who": null}') WHEN 4 THEN concat('[', user_id, ']')
  WHEN 5 THEN ' ' WHEN 6 THEN NULL WHEN 7 THEN concat('{"who": {"id": "x', user_id, '"}, "k": ', user_id, '}') ELSE props END"""


def documents_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, body): JSON texts of many shapes from the events."""
    return table(spark, sf_dir, "events").select("event_id", F.expr(DOCUMENT).alias("body"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img_id, cells): an image for each supplier, with 5 wide or 12 narrow cells."""
    key = F.col("s_suppkey").cast("long")
    return table(spark, sf_dir, "supplier").select(key.alias("img_id"), F.when(key % 2 == 0, 5).otherwise(12).alias("cells"))


def pixels(spark: SparkSession, sf_dir: str, side: int = 40) -> DataFrame:
    """(img_id, y, x, v): dark pixels by integer arithmetic, a line in row 30 and none, two or one line columns.

    Every seventh image has no dark pixel.
    """
    grid = images(spark, sf_dir).select("img_id", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("y")).select("img_id", "y", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("x"))
    inside = F.col("y").between(3, side - 4) & F.col("x").between(3, side - 4) & (F.col("img_id") % 7 != 0)
    line = F.when(F.col("img_id") % 3 == 1, F.col("x").isin(5, 33)).when(F.col("img_id") % 3 == 2, F.col("x") == 12).otherwise(False)
    dark = inside & ((F.col("y") == 30) | line | ((F.col("x") * 7 + F.col("y") * 13 + F.col("img_id") * 5) % 11 < 3))
    return grid.withColumn("v", F.when(dark, (F.col("x") * 3 + F.col("y") * 5 + F.col("img_id")) % 200).otherwise(255 - (F.col("x") + F.col("y")) % 40).cast("int"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img_id, seq, x, y, w, h, area): the boxes of each order, by integer arithmetic; lines of a number may repeat."""
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    w, h = 2 + part % 23, 1 + part % 31
    area = F.least(w * h, F.greatest(w, h) + part % 4)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("img_id"), line.cast("int").alias("seq"), (line * 22 + part % 9 - 22).cast("int").alias("x"), ((part * 5) % 39).cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"), area.cast("int").alias("area"))
