"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from floorlake.llm import decontaminate, minhash, mixing, quality, sharding
from floorlake.llm.common import table
from floorlake.staging import staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return minhash.drop_near_duplicates(docs, n=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the target weights of their sources ask for, each once at least.

    Files and their rows are in the order of the mix.
    """
    mixed = mixing.mix_sources(docs)
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents with their shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("sharding", sharding_stage),
]

#: Connected components of MinHash candidates and an earliest-deadline-first schedule aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
