"""The corpus pipeline: toxic documents go, copies go, near copies go, sources are mixed, the rest is packed.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs.
Nulls, empty and repeated rows mean what the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flankwise.llm.common import stored
from flankwise.llm.exact_dedup import exact_survivors
from flankwise.llm.mixing import mix_sources
from flankwise.llm.near_dup import near_survivors
from flankwise.llm.packing import harmonic_packing
from flankwise.llm.queries import held_out
from flankwise.llm.toxicity import toxicity_scores


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_scores(docs, labels, usable=~held_out(F.col("doc_id"))).where("score < 0.5").select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_survivors(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the row with the smallest doc_id."""
    return near_survivors(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the one where a source's budget ends rounded to a whole one."""
    copies = mix_sources(docs).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return copies.select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    packed = harmonic_packing(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        F.col("doc").alias("doc_id"), "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing),
]

#: A trained classifier, sketches, a hash order and a tokenizer are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
