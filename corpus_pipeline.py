"""The corpus pipeline: documents -> packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet before the next stage reads it. All but the last return the columns
of documents.

Defined cases, in every stage: a null text is an empty one (line dedup writes it
as such); rows without an id stay until their text is rejected or holds a
benchmark item, and are never near-duplicates; of rows that repeat an id each is
judged by its own text, and of those that repeat id and text near-dedup keeps
one; other columns are dropped before the first stage; on an empty table every
stage gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobweir.llm import decontaminate, line_dedup, near_dedup, packing, quality_gam
from jobweir.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not reject."""
    model = quality_gam.train(docs, _table(spark, sf_dir, "labels"))
    return quality_gam.keep_good(docs, model).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; n_chars follows the text."""
    cut = line_dedup.dedup(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near-duplicates."""
    return near_dedup.keep_one(docs).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("decontamination", clean),
    ("packing", pack),
]

#: The classifier, the sampling and the tokenizer have no SQL; tests hold the
#: pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
