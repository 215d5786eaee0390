"""Registered streaming queries: each runs the stream over the event table to the end and returns its table."""
from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions.runtime import scratch_path
from quillgraph.operators.runs import normalize_usage
from quillgraph.plans import run_queries as R
from quillgraph.plans.adapters import table
from quillgraph.sources.corpora import write_texts
from quillgraph.streaming import pipelines as P

QUERIES, SQL = {}, {}


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn
    return keep


class _Streamed:
    """Looks like a session to the batch adapters but reads the event table as a stream."""

    def __init__(self, spark):
        self.spark, self.read = spark, self

    def parquet(self, path):
        folder, name = path.rsplit("/", 1)
        return self.spark.readStream.schema(self.spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder)


def _stream(spark, sf):
    return table(_Streamed(spark), sf, "events")


def _collect(spark, stream, mode, label):
    path = scratch_path(spark, label)
    P.write_batches(stream, f"{path}/out", f"{path}/checkpoint", mode)
    return f"{path}/out"


@register("w01_corpus_intake", "SELECT md5(text || chr(10)) AS text_md5, count(*) AS n FROM (SELECT DISTINCT text FROM documents) GROUP BY 1")
def w01(spark, sf):
    """The documents become one text file each (the writer ends a file with a line break), then the stream takes them in."""
    path = scratch_path(spark, "intake")
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    files = docs.repartition("doc_id").groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    # one folder: a folder per document is slow to write and to list
    write_texts(files.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("name"), "text"), f"{path}/in")
    P.stream_corpus(spark, f"{path}/in", f"{path}/store", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/store/corpus").groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"))


@register("w02_event_dedup", "SELECT user_id AS run_id, count(*) AS events, max(event_id) AS last_sequence FROM events GROUP BY 1")
def w02(spark, sf):
    one = lambda: _stream(spark, sf).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence"), F.col("ts").cast("timestamp").alias("timestamp"))
    path = _collect(spark, P.unique_events(one().unionByName(one()), "60 days"), "append", "dedup")
    return spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("events"), F.max("sequence").alias("last_sequence"))


@register("w03_live_turns", R.SQL["t03_turn_state"])
def w03(spark, sf):
    path, events = scratch_path(spark, "turns"), R.run_events(_Streamed(spark), sf)
    types = dict(events.dtypes)
    store = P.turn_store(spark, f"{path}/out", types["run_id"], types["timestamp"])
    P.stream_turns(events, store, f"{path}/checkpoint")
    return P.turns_now(store)


@register("w04_live_usage", R.SQL["t02_usage_by_node"])
def w04(spark, sf):
    usage = normalize_usage(R.usage_events(_Streamed(spark), sf))
    path = scratch_path(spark, "usage")
    store = P.usage_store(spark, f"{path}/out", dict(usage.dtypes)["run_id"])
    P.stream_usage(usage, store, f"{path}/checkpoint")
    return P.usage_now(store)


@register("w05_inactive_sweep", """SELECT user_id AS run_id, max(event_id) + 1 AS sequence, 'failed' AS status FROM events GROUP BY 1
 HAVING arg_max(event_type, event_id) IN ('signup','view','click') AND max(ts) + INTERVAL 120 MINUTE < (SELECT max(ts) FROM events)""")
def w05(spark, sf):
    t = F.col("event_type")
    e = _stream(spark, sf).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence"), F.col("ts").cast("timestamp").alias("timestamp"),
                                  F.when(t == "signup", "queued").when(t.isin("view", "click"), "running").when(t == "purchase", "completed").otherwise("failed").alias("status"))
    path = _collect(spark, P.sweep_inactive(e, 120), "append", "sweep")
    return spark.read.parquet(path).select("run_id", "sequence", "status")
