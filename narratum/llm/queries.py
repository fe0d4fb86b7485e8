"""The registered queries of this subpackage, each over its whole table, and DuckDB SQL where that can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, codebook, countjoin, decontam, gru, licences, manifest, simhash, substring, toxicity, warc, wavelet
from .common import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.digests(read(spark, sf_dir, "documents"))


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(read(spark, sf_dir, "documents"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(read(spark, sf_dir, "embeddings"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.fixity(read(spark, sf_dir, "pages"))


def op10_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.score(read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebook.digests(read(spark, sf_dir, "embeddings"))


def op12_count_rtree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countjoin.groups(read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digests(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_wavelet_tokens, op3_simhash_groups, op4_substring_dedup, op5_licences, op6_nearest, op7_decontamination, op8_bpe_roundtrip, op9_warc_fixity, op10_gru_scores, op11_vector_codes, op12_count_rtree_join, op13_merkle_manifest)}
SQL: dict[str, str] = {"op4_substring_dedup": substring.SQL, "op5_licences": licences.sql(), "op7_decontamination": decontam.SQL, "op9_warc_fixity": warc.SQL, "op11_vector_codes": codebook.SQL, "op12_count_rtree_join": countjoin.SQL, "op13_merkle_manifest": manifest.SQL}
