"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, codebooks, embeddings, htmltext, langid, lm, merkle, mixing, quality, repair, sharding, simhash, toxicity
from .common import table


def op1_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digests(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.roundtrip_digests(table(spark, sf_dir, "documents"))


def op8_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_flow_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), order=3)


def op11_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_documents(table(spark, sf_dir, "documents"))


def op13_kd_tree_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compressed(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_rank_order_language": op1_rank_order_language,
        "op2_bpe_roundtrip": op2_bpe_roundtrip,
        "op3_histogram_shards": op3_histogram_shards,
        "op4_main_text": op4_main_text,
        "op5_simhash_pivots": op5_simhash_pivots,
        "op6_fertility_rules": op6_fertility_rules,
        "op7_repair_token_ids": op7_repair_token_ids,
        "op8_subspace_pigeonhole": op8_subspace_pigeonhole,
        "op9_flow_mixture": op9_flow_mixture,
        "op10_elias_fano_lm": op10_elias_fano_lm,
        "op11_segment_toxicity": op11_segment_toxicity,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_kd_tree_codebooks": op13_kd_tree_codebooks,
    }


def oracle_sql() -> dict[str, str]:
    return {}
