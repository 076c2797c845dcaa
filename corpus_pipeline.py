"""The cleaning pipeline over `documents`: each stage works on all that its predecessor kept.

Stages but the last return the columns of `documents`; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meridian.llm import langid, lines, near, packing, substring
from meridian.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID does not reject, with the language it finds in place of theirs.

    The model learns from the sample that `langid.train` takes of `docs`. Null texts and those without a letter are rejected; rows
    that repeat each other meet the same fate, equal cosines go to the first language by name; an empty table gives an empty one. Extra columns pass through.
    """
    found = langid.identify(docs, langid.train(docs)).where("not rejected")
    return found.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the runs of lines that an earlier one has; those that lose all but white space go.

    Earlier is a smaller (doc_id, hash of the text). Null texts stay as they are, as do rows without a doc_id, which are compared with nothing; rows
    that repeat doc_id and text get equal results; an empty table gives an empty one. Extra columns pass through.
    """
    return _measured(lines.line_dedup(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by 0.8 or more of common 5-word shingles.

    SimHash trees find the pairs, whole sets decide. Null and empty texts are equal; rows without a doc_id stay; a repeated
    doc_id stays or goes with all its rows; an empty table gives an empty one. Extra columns pass through.
    """
    return near.near_dedup(docs).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages of 20 words or more that start earlier; those that lose all but white space go.

    Texts without such a passage stay as they are, null and empty ones too; from others the words that stay are joined by one
    space. Rows that repeat doc_id and text get equal results; an empty table gives an empty one. Extra columns pass through.
    """
    out = substring.substring_dedup(docs)
    return _measured(out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece, with the columns of `packing.pack` in place of those of documents.

    A null text counts as empty and is one token long; repeated rows are packed each for itself; an empty table gives no pieces.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), digest=True)


def _measured(out: DataFrame, docs: DataFrame) -> DataFrame:
    kept = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pack", pack),
]

#: Shingle sets, substring search and token ids are not SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
