"""The registered queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .sql import ORACLES  # noqa: F401


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_spans

    return secret_spans(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnowing import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_spans

    return personal_spans(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features

    return media_features(table(spark, sf_dir, "documents"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import license_spans

    return license_spans(table(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import minhash_components

    return minhash_components(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    w = whitened(table(spark, sf_dir, "embeddings"))
    # A deviation beyond a long is null here; the operator's own column is a decimal.
    return w.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_secret_scans, op3_ngram_jaccard, op4_quality, op5_license_scans, op6_mixing, op7_packing, op8_pii, op9_winnowing, op10_media,
        op11_minhash, op12_spelling, op13_whitening,
    )
}
