"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import documents


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substring_dedup import substring_dedup

    return substring_dedup(documents(spark, sf_dir)).drop("kept_text")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(documents(spark, sf_dir)).drop("kept")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import simhash_groups

    return simhash_groups(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import shard

    return shard(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that selection keeps, with their scores."""
    from tidemark.llm.quality import grades, train

    docs = documents(spark, sf_dir)
    return grades(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).where("p_clean >= 0.5")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import pii_digest

    return pii_digest(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import contaminated

    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.media import media_digest

    return media_digest(documents(spark, sf_dir))


_ALL = (op1_token_counts, op2_substring_dedup, op3_suffix_dedup, op4_quality, op5_pii, op6_decontamination, op7_simhash, op8_media, op9_sharding, op10_packing)
QUERIES = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {}
