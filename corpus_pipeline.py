"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Each stage works on every row its predecessor kept.  All but the last return the columns of ``documents``; the last writes token
files and returns what they hold for each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosewell.llm import decontamination, minhash, mixing, quality, token_output
from prosewell.llm.scratch import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).filter("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group whose word shingles are at least 0.8 alike."""
    return minhash.deduplicate(docs, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten consecutive words with a benchmark item, nor all words of a shorter one."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, as read back: doc_id, start, n_tokens, ids_crc32."""
    return token_output.digest(docs.select("doc_id", "text"), token_output.default_tokenizer())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mix_sources),
    ("token_output", token_ids),
]

#: A fitted classifier and random rounding have no SQL; the tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    scratch = Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
