"""A corpus from raw documents to a training mix: quality rules, near duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the last return the
columns of documents. Every stage is written as Parquet to the shared folder and read again as the next one's documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.runtime import stage
from quillgraph.llm import decontaminate, mixing, near_dedup, quality, secrets
from quillgraph.llm.common import small_or_joined


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fences of their language and source reject go. Null and empty texts are rejected."""
    return quality.judge(docs).filter("_kept").select(docs.columns)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id stays, once. Rows without an
    id cannot be named in a group and stay."""
    verdict = stage(near_dedup.near_duplicates(docs), "verdict")
    gone = small_or_joined(verdict.filter("not kept").select("doc_id").distinct())
    again = small_or_joined(verdict.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    stay = docs.join(gone, "doc_id", "left_anti")
    once = stay.join(again, "doc_id", "left_anti")
    return once.unionByName(stay.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go. A document without an id goes with the others that have none, if one overlaps."""
    found = decontaminate.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = small_or_joined(found.select(F.col("doc_id").alias("_leak")).distinct())
    return docs.join(leaks, F.col("doc_id").cast("long").eqNullSafe(F.col("_leak")), "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every span found is replaced by a mark and n_chars follows the text."""
    found = secrets.scan(docs).withColumn("_text", secrets.masked(F.col("text"), F.col("_spans")))
    out = found.withColumn("text", F.col("_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target and the words taken, one row per document."""
    return mixing.plan(docs).drop("pieces")


STAGES = [("quality rules", keep_quality), ("near duplicates", keep_first_copies), ("decontamination", drop_leaks),
          ("secret scans", mask_secrets), ("mixing", mix_sources)]

# Set similarity over bands, reachability and aligned overlaps have no sensible SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
