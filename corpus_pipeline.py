"""From raw documents to packed sequences, in five written stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All
stages but the last return the columns of documents."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near_dup, packing, pii, quality, simhash
from tidemark.llm.common import documents, materialize, may_match, shared_dir


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose probability of the best grade is at least a half."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


#: What tells rows apart: doc_id and 128 bits of the text.
KEY = ["doc_id", "_h1", "_h2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _h1 and _h2, 128 bits of the text: rows that agree in doc_id and these are copies."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(1), text)})


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the smallest doc_id (null
    last), of those that share it one text, of equal rows one. What is in no group stays, whatever
    its doc_id.

    Links are SimHash's tiled comparison, verified by the texts' five-word shingles, and what an
    exact join finds besides at similarity 0.8 (see near_dup). Only documents that may have to go
    are shuffled with their texts."""
    rows = _keyed(docs)
    own = materialize(near_dup.shingled(rows, KEY), "shingles")
    row = F.struct(F.col("doc_id").isNull().alias("none"), *KEY)
    distinct = materialize(own.groupBy("node").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("rows")), "distinct")
    roots = simhash.components(near_dup.links(rows, own))
    nodes = distinct.join(roots, distinct["node"] == roots["u"], "left").select("node", "first", "rows", F.coalesce("root", "node").alias("root"))
    # most texts stand alone: only groups of several rows have anything to drop
    groups = nodes.groupBy("root").agg(F.min("first").alias("keep"), F.sum("rows").alias("rows")).where("rows > 1").select("root", "keep")
    members = materialize(nodes.select("node", "root").join(groups, "root").select("node", "keep"), "members")
    held = own.select(*KEY, "node").join(members, "node").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.first("keep").alias("keep"))
    gone = ~row.eqNullSafe(F.col("keep"))
    named = [F.col(c).alias(f"_of_{c}") for c in KEY]
    decided = materialize(held.where(gone | (F.col("n") > 1)).select(*named, gone.alias("_gone")), "decided")
    marked = may_match(rows, decided.withColumn("_h1", F.col("_of__h1")), "_h1")
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_of_{c}")), KEY[1:], F.col(KEY[0]).eqNullSafe(F.col(f"_of_{KEY[0]}")))
    some = marked.where("_maybe").join(decided, same, "left").where("_gone is null or not _gone")
    alone, repeated = some.where("_gone is null"), some.where("_gone is not null")
    return marked.where("not _maybe").select(*docs.columns).unionAll(alone.select(*docs.columns)).unionAll(_first_of_each(repeated, docs.columns))


def _first_of_each(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of rows that agree in doc_id and text, one."""
    row = F.struct("text", *(c for c in columns if c != "text"))
    got = df.groupBy(*KEY).agg(F.min_by(row, F.xxhash64(*columns)).alias("r"))
    return got.select(*(F.col(f"r.{c}").alias(c) for c in columns))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality", stage_quality), ("near_dedup", stage_near_dedup), ("decontaminate", stage_decontaminate), ("pii", stage_pii), ("pack", stage_pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = documents(spark, sf_dir), f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
