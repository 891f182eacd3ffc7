"""A training corpus from raw documents: quality rules, exact and near dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeframe.llm import exact_dedup, mixing, near_dedup, packing, quality
from lodeframe.llm.common import stored

#: Least similarity, in percent, from which the near-dedup stage links two texts.
NEAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base counts or a rule of the cascade rejects go."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts, the one with the smallest id stays."""
    return near_dedup.drop_near_copies(docs, percent=NEAR)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, each part file with rows of one shard in shuffled order; the document
    where a source's target ends has its first words only. Shard and copy are in the order of rows, not in columns."""
    mixed = mixing.mix(docs).select(*docs.columns)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their places in sequences; row_id tells copies of a document apart."""
    return packing.pack(docs, with_ids=True)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("source_mixing", source_mix), ("best_fit_packing", packed)]
#: SQL has no tokenizer; a test holds the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared folder and read again, so that no later scan makes it anew;
    common.forget() deletes these tables when the result has been written elsewhere.

    Nulls in any column, empty and very long texts, repeated rows and empty tables pass through: each stage defines what
    becomes of them, in its operator's docstring. Columns besides those of documents are carried up to packing.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
