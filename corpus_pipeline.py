"""A training corpus from the table of documents: known languages, no near copies, no benchmark items, mixed and sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm import decontamination, jaccard, language, mixing, native, sharding
from gaugeframe.llm.queries import held_out, with_quality
from gaugeframe.llm.storage import stored
from gaugeframe.llm.tables import table

N_SHARDS = 24


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned, as far as their letters tell; those without a letter, or without a text, go."""
    out = F.coalesce(held_out(F.col("doc_id"), 4, 2), F.lit(False))
    return language.likely(docs, language.fit(docs, ~out))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    labels = table(spark, sf_dir, "labels")
    return mixing.mixed_copies(docs, lambda slim: with_quality(slim, labels))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus in random order, with the shard and the place in it of each row."""
    size = F.octet_length(native.utf8(F.col("text"))) + 8
    return sharding.two_pass_shuffle(docs, ["doc_id", "text"], N_SHARDS, size)


STAGES = [
    ("language", known_language),
    ("near_copies", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Language identification has no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
