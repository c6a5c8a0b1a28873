"""Corpus preparation: documents in, token pieces out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Defined cases: documents without text, without a letter or without a recognized language go in the first stage; repeated
rows of a doc_id stay or go together; of documents that tie the smallest doc_id stays; texts of any length are worked on
whole; other columns pass, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glyphmill.functions.session import fresh_path
from glyphmill.llm.common import small_batches, table
from glyphmill.llm.decontam import clean
from glyphmill.llm.langid import learn, recognized
from glyphmill.llm.ngram_join import one_of_each
from glyphmill.llm.pieces import encode
from glyphmill.llm.repeats import without_repeats

PIECES = "piece_bpe_32k.model"
#: The stages are custom operators without an SQL form; tests hold them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognized language go."""
    small_batches(spark)
    return recognized(docs, learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word sets (0.8 or more) connect, the one with the smallest doc_id stays."""
    return one_of_each(docs, n=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every later copy of a 100-byte string is cut out; documents with nothing left go."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every text, with its N best segmentations' scores."""
    return encode(docs, public_tokenizers.path(PIECES), keep=["doc_id"])


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("sentence_pieces", sentence_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
