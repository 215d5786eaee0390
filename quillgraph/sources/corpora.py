"""Text files as a corpus table, content de-duplication and manifest audit."""
from __future__ import annotations

import os
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.runtime import make_folder
from quillgraph.functions.text import is_blank
from quillgraph.functions.udfs import decode_batches

MANIFEST_VERSION = 1


def decode_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, content) rows to (corpus, rejects). Undecodable and blank files are rejected with a reason."""
    rows = files.select("path", "content").mapInArrow(decode_batches, "path string, text string, encoding string")
    reason = F.when(F.col("text").isNull(), "undecodable").when(is_blank(F.col("text")), "blank")
    judged = rows.withColumn("reason", reason)
    corpus = judged.filter(F.col("reason").isNull()).select(
        "path", "encoding", "text", F.sha2("text", 256).alias("source_hash"),
        (F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))).cast("bigint").alias("replacement_chars"))
    return corpus, judged.filter(F.col("reason").isNotNull()).select("path", "reason")


def scan_text_corpus(spark: SparkSession, path: str, pattern: str = "*.txt") -> tuple[DataFrame, DataFrame]:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return decode_files(files)


def write_texts(files: DataFrame, folder: str) -> None:
    """(name, text) rows as text files ``name``.txt of one folder, each text ended by a line break; names differ.

    Hadoop's local file system starts a process for the mode of every file, so the files of a mounted folder are written by the tasks
    themselves, each under its name only when whole. In other stores Spark writes a file per row, under names of its own.
    """
    make_folder(files.sparkSession, folder)
    at = urlsplit(folder)
    if at.scheme not in ("", "file"):
        files.select("text").write.mode("append").option("maxRecordsPerFile", 1).text(folder)
        return

    def put(batches):
        for batch in batches:
            for name, text in zip(batch.column("name"), batch.column("text")):
                path = os.path.join(at.path, name.as_py())
                with open(f"{path}.{os.getpid()}.part", "wb") as file:
                    file.write(text.as_py() + b"\n")
                os.replace(file.name, f"{path}.txt")
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    files.select(F.col("name").cast("string").alias("name"), F.col("text").cast("binary").alias("text")).mapInArrow(put, "n long").agg(F.sum("n")).collect()


def encoding_census(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("encoding").agg(
        F.count("*").alias("texts"), F.sum(F.length("text").cast("bigint")).alias("characters"),
        F.sum("replacement_chars").alias("replacement_chars"))


def dedup_corpora(corpus: DataFrame) -> DataFrame:
    """One corpus per decoded text: the earliest ``created_at``, then the smallest id.

    The winner comes from an aggregate with map-side combine, so a text with very many copies does not
    gather in one task; the rows are then picked by their unique id.
    """
    hashed = corpus.withColumn("source_hash", F.sha2("text", 256))
    winners = hashed.groupBy("source_hash").agg(
        F.min(F.struct("created_at", "corpus_id")).alias("w"), F.count("*").alias("copies"))
    return hashed.join(winners.select(F.col("w.corpus_id").alias("corpus_id"), "copies"), "corpus_id")


def audit_manifests(manifests: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifests against recomputed texts; bad rows carry their reasons and are set apart.

    Manifests: directory, version, novel_id, filename, source_hash, encoding, created_at.
    """
    actual = corpus.select(F.col("corpus_id").alias("directory"), F.sha2("text", 256).alias("_hash"), F.col("encoding").alias("_encoding"))
    rows = manifests.join(actual, "directory", "left")
    required = ["version", "novel_id", "filename", "source_hash", "encoding", "created_at"]
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    note = lambda cond, text: F.when(F.coalesce(cond, F.lit(False)), F.lit(text))
    reasons = F.array_compact(F.array(
        note(missing, "missing_field"),
        note(F.col("version") != MANIFEST_VERSION, "unsupported_version"),
        note(F.col("novel_id") != F.col("directory"), "id_mismatch"),
        note((F.length("filename") == 0) | F.col("filename").rlike(r"[/\\]"), "bad_filename"),
        note(~F.col("source_hash").rlike("^[0-9a-fA-F]{64}$"), "bad_hash"),
        note(F.col("created_at").isNotNull() & F.col("created_at").try_cast("timestamp").isNull(), "bad_created_at"),
        note(F.col("_hash").isNull(), "missing_source"),
        note(F.col("source_hash") != F.col("_hash"), "hash_mismatch"),
        note(F.col("encoding") != F.col("_encoding"), "encoding_mismatch")))
    judged = rows.withColumn("reasons", reasons).drop("_hash", "_encoding")
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)
