"""The corpus pipeline: language, lines, near copies, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import language, lines, packing, resemblance, secrets
from logloom.session import written

SEQUENCE = 4096

#: No SQL can express the language model, the fingerprints or the token ids; each stage is tested
#: against a plain version instead.
ORACLE_SQL = None


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: those that are null or have no letters."""
    model = language.learn(docs.select("text", "lang"))
    found = language.label_languages(docs, model)
    return found.filter(F.col("lang_pred") != language.UNKNOWN).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that recur in two or more documents, and documents of which nothing is left; n_chars follows the text."""
    kept = lines.drop_recurring(docs, recur=2, share=0.75)
    emptied = (F.col("n_dropped") > 0) & (F.trim("text") == "")
    return with_text(kept.filter(~F.coalesce(emptied, F.lit(False))), F.col("text"), docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: 0.8 of their runs of five words in common."""
    return resemblance.keep_one(docs, words=5, least=0.8, most=3)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets in the texts; every document stays; n_chars follows the text."""
    return with_text(secrets.mask_secrets(docs), F.col("text"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences: one row per piece."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE)
    return packing.pack_pieces(pieces, SEQUENCE)


def with_text(df: DataFrame, text, columns: list[str]) -> DataFrame:
    """The columns of documents with another text and, where there is n_chars, its new length."""
    new = df.withColumn("text", text)
    if "n_chars" in columns:
        new = new.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return new.select(*columns)


STAGES = [
    ("language", keep_languages),
    ("lines", drop_lines),
    ("near_copies", keep_one_copy),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
