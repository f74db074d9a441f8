"""Registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontam,
    langid,
    license_scan,
    lm_mixing,
    ngram_join,
    packing,
    permutation_index,
    quality_js,
    resampling,
    secrets,
    url_lm,
    warc,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.judge(_table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_table(spark, sf_dir, "documents"), packing.vocabulary()))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(_table(spark, sf_dir, "documents")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_js.judge(_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.digest(lm_mixing.score(_table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.round_trip(_table(spark, sf_dir, "pages")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(_table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_quality": op5_quality,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_language_id": op7_language_id,
    "op8_ngram_join": op8_ngram_join,
    "op9_warc": op9_warc,
    "op10_secret_scan": op10_secret_scan,
    "op11_permutation_index": op11_permutation_index,
    "op12_whitening": op12_whitening,
    "op13_resampling": op13_resampling,
}

# The other queries are tested against brute force, round trips or held-out accuracy.
ORACLE: dict[str, str] = {
    "op1_url_filter": url_lm.oracle_sql(),
    "op3_decontamination": decontam.oracle_sql(),
    "op5_quality": quality_js.oracle_sql(),
    "op8_ngram_join": ngram_join.oracle_sql(),
    "op9_warc": warc.oracle_sql(),
}
