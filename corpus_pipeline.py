"""A corpus pipeline: identify language, filter by quality, drop near copies, mix sources, tokenise.

Every stage takes the documents its predecessor kept. A stage that decides about documents lets those decisions take
effect and returns the columns of its input; the last one returns token ids and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmagraph.llm import bpe, langid, mixing, quality, simhash
from lemmagraph.llm.common import scratch_path, table

#: A text that is less like every profile than this is in none of the languages: between the least of 2,500 held-out
#: documents of sf0.1 (0.389) and foreign or random texts (up to 0.293).
LEAST_LIKENESS = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: `und` and texts unlike every profile go. Profiles are learned from the labels."""
    found = langid.predict(docs, langid.profiles(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LIKENESS)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the fertility band of their language."""
    return quality.measure(docs).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked fingerprints one row, the first by id and hash of its text; null ids come last."""
    text = F.xxhash64("text")
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), text.alias("hash")).alias("__key"), "text")
    groups = simhash.near_duplicates(keyed, id_col="__key").where(F.col("__key").eqNullSafe(F.col("component_id")))
    row = lambda ident, text: F.xxhash64(ident.isNull(), ident, text).alias("__row")
    kept = groups.select(row(F.col("__key.id"), F.col("__key.hash")))
    rows = docs.select(*docs.columns, text.alias("__text"), row(F.col("doc_id"), text))
    # rows are dealt once, by __row, for the join and for the choice among equal rows; other rows of its 64 bits would stay, too
    return rows.join(kept, "__row", "left_semi").dropDuplicates(["__row", "doc_id", "__text"]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: left out, once or twice."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digests of ids and decoded text."""
    return bpe.roundtrip_digests(docs, keep=["doc_id", "lang", "source"], with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("source mixing", mix_sources),
    ("BPE encoding", encode),
]

#: SQL has neither the vocabulary nor the fingerprints; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
