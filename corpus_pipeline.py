"""Corpus cleaning in five stages, each a training-data operator over what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, mixture, ngram_join, pii, quality_knn
from tidemark.llm.scratch import bounded_broadcast, materialize

# The classifier and the near-duplicate classes cannot be said in SQL together; tests use brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote rejects go."""
    return quality_knn.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _odd_ids(docs: DataFrame) -> DataFrame:
    """doc_ids that say no single row: null, or on more than one row."""
    return materialize(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select("doc_id"), "odd-ids")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest doc_id.

    Rows without an id and rows that share one take part by a number made of id and text, larger than
    any usual id: of rows alike in both, one stays; texts that differ are documents of their own.
    """
    odd = _odd_ids(docs)
    if odd.isEmpty():
        first = ngram_join.near_duplicates(docs).filter("component_id = doc_id").select("doc_id")
        return docs.join(bounded_broadcast(materialize(first, "first")), "doc_id", "left_semi")
    odd = bounded_broadcast(odd.select(F.col("doc_id").alias("odd_id"), F.lit(True).alias("odd")))
    made = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 61))
    number = F.when(F.col("odd"), made).otherwise(F.col("doc_id"))
    marked = docs.join(odd, F.col("doc_id").eqNullSafe(F.col("odd_id")), "left").withColumn("number", number).drop("odd_id")
    classes = ngram_join.near_duplicates(marked.select(F.col("number").alias("doc_id"), "text"))
    first = materialize(classes.filter("component_id = doc_id").select(F.col("doc_id").alias("number")).distinct(), "first")
    kept = marked.join(bounded_broadcast(first), "number", "left_semi")
    single = kept.filter("odd").dropDuplicates(["number"])
    return kept.filter("odd is null").unionByName(single).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, told by id and text, so rows without an id or with a shared one are judged too."""
    judged = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_hash=True)
    bad = materialize(judged.filter("contaminated").select(F.col("doc_id").alias("bad_id"), "text_hash").distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("text_hash"))
    return docs.join(bounded_broadcast(bad), same, "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mixture takes of each document."""
    return mixture.mix_sources(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir).select("doc_id", "text", "lang", "source", "n_chars"), name)
    return STAGES[-1][1](spark, docs, sf_dir)
