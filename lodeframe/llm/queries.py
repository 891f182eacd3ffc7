"""The queries opN_<name> over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, conversations, hard_negatives, language_id, toxicity
from .common import read
from .exact_dedup import exact_dedup
from .mixing import mix_plan
from .near_dedup import near_dedup
from .oracles import ORACLE_SQL
from .packing import pack
from .quality import quality_cascade
from .sharding import shard_documents
from .suffix_dedup import dedup_substrings
from .url_filter import filter_urls


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = language_id.learn(docs, ~language_id.held_out(F.col("id"), 3, 1))
    found = language_id.predict(docs, profiles)
    return found.select("doc_id", language_id.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("id")))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade(read(spark, sf_dir, "documents")).drop("failed_rule")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), digest_all=True)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(read(spark, sf_dir, "documents"))
    shards = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["copy"].cast("string"), d["shard"].cast("string"))), ",")
    return plan.select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(read(spark, sf_dir, "documents"), with_text=True)
    digits = F.array_join(F.transform("ids", lambda k: k.cast("string")), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _, digests = conversations.repair(conversations.damaged(read(spark, sf_dir, "conversations")))
    digests = digests.withColumnRenamed("conv_id", "_id")
    return report.join(digests, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = hard_negatives.relabelled(hard_negatives.points(read(spark, sf_dir, "embeddings")))
    return hard_negatives.mine(points, F.col("id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_language_id, op3_toxicity, op4_url_filter, op5_quality_rules, op6_exact_dedup, op7_best_fit_packing, op8_minhash_near_dedup, op9_source_mixing, op10_sharding, op11_bpe, op12_conversation_repair, op13_hard_negatives)}


__all__ = ["ORACLE_SQL", "QUERIES"]
