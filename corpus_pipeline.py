"""From raw documents to training shards: the operators one after the other.

Each stage takes what its predecessor kept, as a Parquet table, and all but the
last return the columns of documents, extra ones of any name included. Empty
tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evenreel.llm import decontamination, language, mixing, sharding, simhash
from evenreel.llm.common import unpacked
from evenreel.session import written

N_SHARDS = 40


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language: those with a letter and a clear winner.

    Null and empty texts have none.
    """
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group linked by fingerprints at most 3 bits apart.

    Texts without words link with each other; null ids stand last.
    """
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark item stands; in null and empty texts none does."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as its source's target asks, in training order.

    Documents without words are taken 0 times; null sources are one source.
    """
    order = mixing.curriculum(mixing.mix(docs, carry=True))
    return unpacked(order, "_doc", docs.columns)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document copy; slots follow the training order, in which the table was written.

    Equal texts share a shard; null texts count as empty ones.
    """
    return sharding.shard(docs, N_SHARDS, order=sharding.table_order(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("sharding", deal_shards),
]

#: Language codes, fingerprints and shards are not expressible in SQL; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
