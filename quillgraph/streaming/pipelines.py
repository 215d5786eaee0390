"""Structured Streaming: corpus intake, event intake, live turn state and usage, inactivity sweep.

Results go to Parquet in the shared folder through foreachBatch. Every micro-batch owns one sub-folder that a
replay overwrites, so a restarted query neither loses nor repeats rows. Turn state and usage keep no operator state: a batch is folded
to one part per run, parts merge in any order, and a ``BatchStore`` holds them in few folders.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgraph.functions.runtime import cut_lineage, forget
from quillgraph.operators.runs import ACTIVE, finished_turns, finished_usage, merged_turns, merged_usage, turn_parts, usage_parts
from quillgraph.sources.corpora import decode_files
from quillgraph.streaming.store import BatchStore

EVENT_SCHEMA = "run_id string, sequence bigint, timestamp timestamp, type string, status string, node string, detail string, snapshot string, error string"


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs the stream over everything available now; each micro-batch is one replaceable folder."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()


def merge_batches(stream: DataFrame, store: BatchStore, checkpoint: str, fold: Callable[[DataFrame], DataFrame]) -> None:
    """Runs the stream over everything available now; the folded rows of each micro-batch go to the store."""
    save = lambda batch, batch_id: store.add(fold(batch), batch_id)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()


HASH_PREFIX = 2  # hex digits: 256 folders of hashes


def known_hashes(spark: SparkSession, store: str) -> BatchStore:
    """The content hashes of a store, laid out by their first digits."""
    return BatchStore(spark, f"{store}/hashes", "source_hash string, prefix string", by="prefix")


def stream_corpus(spark: SparkSession, path: str, store: str, checkpoint: str, pattern: str = "*.txt", files_per_batch: int | None = None) -> None:
    """New text files only; a text whose content the store already has, or that repeats inside the batch, is left out.

    A batch reads only the known hashes whose first digits it meets itself, from a number of files that does not follow the number
    of batches before it. A replayed batch compares itself with earlier batches alone.
    """
    files = (spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
             .schema("path string, modificationTime timestamp, length bigint, content binary"))
    files = (files.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else files).load(path)

    def intake(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # small files are slow to open: they are read once, for the texts, their winners and the rejects
        content, opened = cut_lineage(batch.select("path", "content"), "content")
        corpus, rejects = decode_files(content)
        winners = corpus.groupBy("source_hash").agg(F.min("path").alias("path"))
        decoded, scratch = cut_lineage(corpus.join(winners, ["source_hash", "path"], "left_semi"), "intake")
        prefix = F.substring("source_hash", 1, HASH_PREFIX)
        met = [r[0] for r in decoded.select(prefix).distinct().collect()]
        hashes = known_hashes(session, store)
        known = hashes.read(before=batch_id).filter(F.col("prefix").isin(met)).select("source_hash")
        fresh = decoded.join(known, "source_hash", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{store}/corpus/batch={batch_id}")
        rejects.write.mode("overwrite").parquet(f"{store}/rejects/batch={batch_id}")
        hashes.add(fresh.select("source_hash", prefix.alias("prefix")), batch_id)
        forget(session, scratch)
        forget(session, opened)

    # a batch's files are looked up by a job with a task per file, up to this number, in the session that reads the stream
    conf, name = spark.conf, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = conf.get(name)
    conf.set(name, 4 * spark.sparkContext.defaultParallelism)
    try:
        files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(intake).start().awaitTermination()
    finally:
        conf.set(name, before)


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).json(path)


def unique_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """At-least-once input to one row per (run, sequence); state is dropped once the watermark has passed."""
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["run_id", "sequence"])


_TURN = ("run_id {key}, last_sequence bigint, event_count bigint, status struct<at: bigint, v: string>, timestamp struct<at: bigint, v: {time}>, "
         "snapshot struct<at: bigint, v: string>, error struct<at: bigint, v: string>, retryable struct<at: bigint, v: boolean>, "
         "resumable struct<at: bigint, v: boolean>, completed_at struct<at: bigint, v: {time}>")
_USAGE = ("run_id {key}, node string, input_tokens bigint, output_tokens bigint, total_tokens bigint, reasoning_tokens bigint, cached_tokens bigint, "
          "elapsed_seconds double, reported_call_count bigint, unknown_call_count bigint")


def turn_store(spark: SparkSession, path: str, key: str = "string", time: str = "timestamp") -> BatchStore:
    """``key`` and ``time``: the types of the events' run_id and timestamp."""
    return BatchStore(spark, path, _TURN.format(key=key, time=time), merged_turns)


def stream_turns(events: DataFrame, store: BatchStore, checkpoint: str) -> None:
    """Turn state of a stream of events: no run stays in an operator's state, ended or not. ``turns_now`` reads the result."""
    merge_batches(events, store, checkpoint, turn_parts)


def turns_now(store: BatchStore) -> DataFrame:
    """The turn of every run after all batches, as ``fold_turns`` has it; an event that came late has replaced nothing newer."""
    return finished_turns(store.read())


def usage_store(spark: SparkSession, path: str, key: str = "string") -> BatchStore:
    return BatchStore(spark, path, _USAGE.format(key=key), merged_usage)


def stream_usage(usage: DataFrame, store: BatchStore, checkpoint: str) -> None:
    """Token usage of a stream of calls, one part per batch, run and node. ``usage_now`` reads the result."""
    merge_batches(usage, store, checkpoint, usage_parts)


def usage_now(store: BatchStore) -> DataFrame:
    """Totals by node and for the run after all batches, as ``usage_rollup`` has them."""
    return finished_usage(store.read())


_SWEPT = "run_id {key}, sequence bigint, timestamp timestamp, type string, status string, error string"
_STATE = "sequence bigint, status string, seen timestamp"


def sweep_inactive(events: DataFrame, idle_minutes: int, delay: str = "0 seconds", keep_minutes: int = 7 * 24 * 60) -> DataFrame:
    """Interruption events for runs that stay active without any event for longer than the idle time.

    Events: run_id, sequence, timestamp, status. One small state per run holds its newest event; the
    event-time timer fires when the watermark passes the last event plus the idle time. The interruption takes
    the highest sequence plus one, whether events repeat or have gaps; it stays in the state for ``keep_minutes``
    after it, so a run that goes on is numbered onwards. Then, and for ended runs at once, the state is dropped.
    """
    key = dict(events.dtypes)["run_id"]
    schema = _SWEPT.format(key=key)
    columns = ["run_id", "sequence", "timestamp", "type", "status", "error"]

    def sweep(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            sequence, status, seen = state.get
            if status not in ACTIVE:
                state.remove()
                return
            at = pd.Timestamp(seen) + pd.Timedelta(minutes=idle_minutes)
            state.update((sequence + 1, "failed", seen))
            state.setTimeoutTimestamp(max(int(at.timestamp() * 1000), state.getCurrentWatermarkMs()) + keep_minutes * 60_000)
            yield pd.DataFrame([[keys[0], sequence + 1, at, "error", "failed", "run_interrupted"]], columns=columns)
            return
        sequence, status, seen = state.get if state.exists else (-1, None, None)
        for frame in frames:
            top = frame.loc[frame["sequence"].idxmax()]
            if int(top["sequence"]) > sequence:
                sequence, status = int(top["sequence"]), str(top["status"])
            newest = frame["timestamp"].max().to_pydatetime()
            seen = newest if seen is None or newest > seen else seen
        state.update((sequence, status, seen))
        due = int(pd.Timestamp(seen).timestamp() * 1000) + idle_minutes * 60_000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=columns)

    return events.withWatermark("timestamp", delay).groupBy("run_id").applyInPandasWithState(
        sweep, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
