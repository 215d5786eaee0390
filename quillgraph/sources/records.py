"""Conversation snapshots and trace records: strict JSON in, append-only JSON out."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.runtime import stage

CONVERSATION_VERSION = 1
CONVERSATION = ("version bigint, conversation_id string, novel_id string, title string, created_at string, updated_at string, "
                "turns array<struct<turn_id:string, run_id:string, question:string, status:string, created_at:string, "
                "max_steps:bigint, updated_at:string, completed_at:string, error:string, retryable:boolean, resumable:boolean, "
                "events:array<string>, snapshot:string>>")
TRACE = "timestamp string, node string, update string"


def parse_conversations(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, json) rows to (conversations, invalid). ``name`` is the file name without its ending."""
    parsed = files.withColumn("c", F.from_json("json", CONVERSATION + ", _corrupt string",
                                               {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    need = [F.col(f"c.{k}").isNull() for k in ("version", "conversation_id", "novel_id", "title", "created_at", "updated_at", "turns")]
    missing = need[0]
    for n in need[1:]:
        missing = missing | n
    turn_bad = F.exists("c.turns", lambda t: t["turn_id"].isNull() | t["run_id"].isNull() | t["question"].isNull()
                        | t["status"].isNull() | t["created_at"].isNull()
                        | (t["snapshot"].isNotNull() & ~t["snapshot"].startswith("{")))
    note = lambda cond, text: F.when(F.coalesce(cond, F.lit(False)), F.lit(text))
    reason = F.coalesce(note(F.col("c").isNull() | F.col("c._corrupt").isNotNull(), "not_json"), note(missing, "missing_field"),
                        note(F.col("c.version") != CONVERSATION_VERSION, "unsupported_version"),
                        note(F.col("c.conversation_id") != F.col("name"), "id_mismatch"), note(turn_bad, "invalid_turn"))
    judged = parsed.withColumn("reason", reason)
    good = judged.filter(F.col("reason").isNull()).select("c.*").drop("_corrupt")
    return good, judged.filter(F.col("reason").isNotNull()).select("name", "reason")


def scan_conversations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("name"), F.col("value").alias("json"))
    return parse_conversations(files)


def parse_trace(lines: DataFrame) -> DataFrame:
    """JSON lines (column ``value``) to typed rows; unparsable lines are left out."""
    rec = F.from_json("value", TRACE)
    return lines.select("*", rec.alias("r")).filter(F.col("r.node").isNotNull() & F.col("r.timestamp").isNotNull()).select(
        *[c for c in lines.columns if c != "value"], F.to_timestamp("r.timestamp").alias("timestamp"), F.col("r.node").alias("node"),
        F.col("r.update").alias("update"))


def scan_trace(spark: SparkSession, path: str) -> DataFrame:
    return parse_trace(spark.read.text(path))


FILE_ROWS = 500_000


def write_trace(df: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Appends rows (run_id, timestamp, node, update) as JSON lines, one folder per day.

    Days bound the number of folders; a folder per run would make one tiny file per run at scale. A day has a file per ``file_rows``
    rows, cut by ranges of (run, timestamp): a day or a run of any size is written by many tasks, and the files of a run lie together.
    """
    stamped = F.date_format(F.col("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    out = stage(df.select("run_id", stamped.alias("timestamp"), "node", "update", F.to_date("timestamp").alias("day")), "trace")
    rows = out.count()
    out.repartitionByRange(max(1, -(-rows // file_rows)), "day", "run_id", "timestamp").sortWithinPartitions("day", "run_id", "timestamp").write.mode(
        "append").partitionBy("day").json(path)
