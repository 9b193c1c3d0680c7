"""The registered queries: every operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newsrate.llm import (
    collocations,
    decontaminate,
    language_model,
    licenses,
    mixing,
    near_dup,
    neighbours,
    quality,
    resampling,
    token_counts,
    toxicity,
    warc,
    wavelet,
)
from newsrate.session import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "llm-warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.page_records(spark, path)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "llm-tokens")
    wavelet.write_token_files(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json")
    )
    return wavelet.read_token_files(spark, path)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbour_quality(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


QUERIES = {
    "op1_warc": op1_warc,
    "op2_token_counts": op2_token_counts,
    "op3_near_dup": op3_near_dup,
    "op4_mixing": op4_mixing,
    "op5_token_output": op5_token_output,
    "op6_quality": op6_quality,
    "op7_language_model": op7_language_model,
    "op8_decontamination": op8_decontamination,
    "op9_licenses": op9_licenses,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_quality_neighbours": op12_quality_neighbours,
    "op13_resampling": op13_resampling,
}
