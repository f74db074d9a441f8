"""Corpus pipeline: language, near copies, benchmark passages, secrets, packing.

Every stage takes the documents that its predecessor kept and returns them
with the columns of ``documents``; the last returns the packed pieces.
``run`` writes each stage's rows as Parquet in the session's checkpoint
folder and reads them back, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, and long texts that are ambiguous."""
    from doeffect.llm import langid

    return langid.accept(docs, langid.fit(docs.where(~langid.held_out())))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of near copies: texts whose
    five-word shingles have a similarity of 0.8 or more."""
    from doeffect.llm.ngram_join import one_each

    return one_each(docs, k=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    from doeffect.llm.decontam import clean

    return clean(docs, _table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; the other columns stay, but for the length."""
    from doeffect.llm import secrets

    return secrets.without_secrets(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the documents into pieces of power-of-two length."""
    from doeffect.llm.packing import digest, pack, vocabulary

    return digest(pack(docs, vocabulary()))


STAGES = [
    ("language", known_language),
    ("near_copies", near_copies),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]
# Languages, n-gram sets and token ids are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    from doeffect.session import scratch_dir

    folder = scratch_dir(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
