"""The registered query of each operator: the operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import oracles
from glyphmill.llm.common import table

TOKENIZER, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from glyphmill.llm.pieces import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), keep=["doc_id"])


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.digests import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.ngram_join import join_components

    return join_components(table(spark, sf_dir, "documents"), n=4, percent=85).drop("class_id")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.repeats import repeats

    return repeats(table(spark, sf_dir, "documents")).drop("starts", "ends")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.common import held_out
    from glyphmill.llm.langid import identify, learn

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs), keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from glyphmill.llm.token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from glyphmill.llm.middle import fill_in_middle, restored

    moved = fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"])
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return restored(moved).select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_join": oracles.OP5, "op13_fill_in_middle": oracles.OP13}
