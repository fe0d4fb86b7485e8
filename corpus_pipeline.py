"""A training-data pipeline: five stages, each the predecessor's documents through one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narratum.llm import bpe, decontam, simhash, substring, toxicity
from narratum.llm.common import read, stored


# All stages: other columns of any name pass through, repeated rows are treated alike, texts of any length are read whole, and an
# empty table gives an empty one.


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. Null and empty texts score the share of toxic labels; a null id doesn't matter."""
    return toxicity.reject(docs, read(spark, sf_dir, "labels"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8 or more): the one with the smallest id.

    Null ids come last, ties go by the text's hash. Texts without words, null ones too, are one group.
    """
    return simhash.keep_one(docs)


def repeated_passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds; every document stays. Rows with a null id neither lose nor count."""
    return substring.dedup(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Texts and items are searched by their texts, so null and clashing ids don't matter."""
    return decontam.without_items(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source if there, the token ids of the text (null: empty), their number, and whether they decode to the text."""
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    done = bpe.encode(docs.select(*keep, "text"), decoded="decoded")
    return done.select(*keep, F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_near_dedup", near_duplicates_out),
    ("substring_dedup", repeated_passages_out),
    ("benchmark_decontamination", benchmark_out),
    ("bpe_encoding", tokens),
]
#: SQL expresses neither the learned toxicity nor the library's encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
