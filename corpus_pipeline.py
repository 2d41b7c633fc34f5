"""Documents to training shards: language ID, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.staging import join_small, materialize
from ledgerlake.llm import decontaminate, langid, mixing, neardup, sharding


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without letters."""
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate group; rows are known by id and text, so null and repeated ids lose nothing else."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more stands in the benchmark, whatever their ids."""
    key = F.xxhash64("text")
    found = decontaminate.decontaminate(docs.select(key.alias("k"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="k")
    bad = found.filter("contaminated").select("k").distinct()
    return join_small(docs.select(key.alias("k"), F.struct("*").alias("row")), bad, "k", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources' words come near their targets."""
    return mixing.mixed_rows(docs)


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every row a shard and a slot; shards have nearly equal bytes. All columns of the documents come along."""
    return sharding.shard(docs, carry=[c for c in docs.columns if c != "doc_id"])


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_rows),
]

#: Statistical and fixed-point stages are not expressible in SQL; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
