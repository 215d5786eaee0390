"""Evidence folding, turn state and the streaming forms of both."""
import glob
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import evidence as A
from quillgraph.operators import runs as T
from quillgraph.sources import records as J
from quillgraph.streaming import pipelines as P
from quillgraph.streaming.store import BatchStore


def test_skipped_proposals_reserve_nothing(spark):
    rows = [(1, 0, 0, "e1", "t", "same quote", False), (1, 0, 1, "e2", "t", "same quote", True), (1, 0, 2, "e2", "t", "other", True), (1, 0, 3, "e9", "t", "fourth", True),
            (1, 1, 0, "e1", "t", "“same  quote”", True), (1, 1, 1, "e1", "t", "fresh", True)]
    got = {(r.round, r.pos): r.outcome for r in A.accept_evidence(spark.createDataFrame(rows, "run_id bigint, round bigint, pos bigint, evidence_id string, task_id string, quote string, valid boolean")).collect()}
    assert got == {(0, 0): "rejected", (0, 1): "accepted", (0, 2): "skipped", (1, 0): "skipped", (1, 1): "accepted"}


def test_unknown_tokens_are_not_zero(spark):
    raw = [("r", "n", 1.0, json.dumps({"usage_metadata": {"input_tokens": 3, "output_tokens": True}})), ("r", "n", 1.0, "{}"), ("r", "m", 1.0, json.dumps({"response_metadata": {"usage": {"prompt_tokens": 2, "completion_tokens": 5}}}))]
    rows = T.normalize_usage(spark.createDataFrame(raw, "run_id string, node string, elapsed_seconds double, raw string"))
    first = rows.collect()
    assert (first[0].input_tokens, first[0].output_tokens, first[0].total_tokens) == (3, None, None) and not first[1].usage_reported and first[2].total_tokens == 7
    total = T.usage_rollup(rows).filter("is_total = 1").first()
    assert (total.input_tokens, total.reported_call_count, total.unknown_call_count) == (5, 2, 1)


EVENTS = "run_id string, sequence bigint, timestamp timestamp, type string, status string, node string, detail string, snapshot string, error string"


def event(run, seq, minute, status, detail="{}", snapshot="{}", error=None):
    return {"run_id": run, "sequence": seq, "timestamp": f"2024-01-01T00:{minute:02d}:00Z", "type": "x", "status": status, "node": "n", "detail": detail, "snapshot": snapshot, "error": error}


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_live_turns_and_dedup_equal_the_batch(spark, tmp_path):
    rows = [event("a", 1, 0, "queued"), event("a", 2, 1, "running", snapshot='{"s":1}'), event("a", 4, 3, "failed", '{"retryable":true}', error="boom"), event("b", 1, 0, "running"), event("a", 2, 1, "running", snapshot='{"s":1}'),
            event("a", 3, 2, "running", snapshot='{"s":2}'), event("b", 2, 5, "completed")]
    src = tmp_path / "in"
    write(src, "1.json", rows[:4])
    plain = lambda df: sorted(tuple(r) for r in df.drop("event_count").collect())
    store = P.turn_store(spark, str(tmp_path / "out"))
    run = lambda: P.stream_turns(P.stream_events(spark, str(src)), store, str(tmp_path / "mark"))
    run()
    write(src, "2.json", rows[4:])  # a repeat, and sequence 3 arriving after sequence 4
    run()
    live = P.turns_now(store)
    batch = T.fold_turns(spark.read.schema(EVENTS).json(str(src)))
    assert plain(live.select(batch.columns)) == plain(batch)
    a = live.filter("run_id = 'a'").first()
    assert (a.status, a.error, a.retryable, a.snapshot) == ("failed", "boom", True, '{"s":2}')
    P.write_batches(P.unique_events(P.stream_events(spark, str(src))), str(tmp_path / "u"), str(tmp_path / "um"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 6


def test_turns_of_many_batches_stay_in_few_folders(spark, tmp_path):
    """Many batches, late events and ended runs: the same turns as in one go, a bounded number of folders, replays without effect."""
    rng = random.Random(2)
    rows = [event(f"r{i % 7}", i // 7, i % 60, rng.choice(["running", "completed", "failed"]), snapshot=f'{{"s":{i}}}', error="e" if i % 5 == 0 else None) for i in range(210)]
    rng.shuffle(rows)
    frame = lambda part: spark.createDataFrame([json.dumps(r) for r in part], "string").select(F.from_json("value", EVENTS).alias("e")).select("e.*")
    store = BatchStore(spark, str(tmp_path / "s"), P.turn_store(spark, "").schema, T.merged_turns, width=4)
    most = 0
    for n in range(70):
        part = T.turn_parts(frame(rows[3 * n:3 * n + 3]).coalesce(1)).coalesce(1)
        store.add(part, n)
        if n in (2, 15, 63):  # replayed: the batch sees none of its own rows before, and adds none twice
            seen = store.read(before=n).agg(F.sum("event_count")).first()[0]
            store.add(part, n)
            assert seen == 3 * n
        most = max(most, len(store.folders()))
    assert most <= 4 * 8 and len(store.covering()) <= 4 * 3
    batch = T.fold_turns(frame(rows))
    assert sorted(map(tuple, P.turns_now(store).select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    assert BatchStore(spark, str(tmp_path / "none"), store.schema, T.merged_turns).read().count() == 0
    with pytest.raises(ValueError, match="the store keeps"):
        store.add(part.withColumn("event_count", F.col("event_count").cast("int")), 70)


def test_live_usage_equals_the_batch(spark, tmp_path):
    raw = [(f"r{i % 3}", f"n{i % 2}", 0.1 * i, json.dumps({"usage_metadata": {"input_tokens": i}}) if i % 4 else "{}") for i in range(40)]
    rows = T.normalize_usage(spark.createDataFrame(raw, "run_id string, node string, elapsed_seconds double, raw string"))
    store = BatchStore(spark, str(tmp_path / "u"), P.usage_store(spark, "").schema, T.merged_usage, width=2)
    for n in range(4):
        store.add(T.usage_parts(rows.filter(F.pmod(F.hash("raw", "elapsed_seconds"), F.lit(4)) == n)), n)
    whole = T.usage_rollup(rows)
    key = lambda r: (r[0], r[1] or "")
    assert sorted(map(tuple, P.usage_now(store).select(whole.columns).collect()), key=key) == sorted(map(tuple, whole.collect()), key=key)


def test_intake_opens_only_the_hashes_it_meets(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    for i in range(40):
        (src / f"{i:02d}.txt").write_text(f"text {i % 30}\n")
    P.stream_corpus(spark, str(src), store, str(tmp_path / "mark"), files_per_batch=4)
    got = spark.read.parquet(f"{store}/corpus")
    assert got.count() == got.select("source_hash").distinct().count() == 30 and got.select("batch").distinct().count() >= 7
    hashes = P.known_hashes(spark, store)
    assert hashes.read().count() == 30 and len(hashes.covering()) <= 4
    one = hashes.read().first().prefix
    plan = hashes.read().filter(F.col("prefix").isin([one]))
    scans = [line for line in plan._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line]
    laid = [line for line in scans if "prefix=" in line or "PartitionFilters: [isnotnull(prefix" in line]
    assert laid and all("PartitionFilters: [isnotnull(prefix" in line for line in laid) and len(scans) <= 4
    assert plan.count() == sum(r.prefix == one for r in hashes.read().collect())


def test_inactive_runs_are_interrupted(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "1.json", [event("idle", 1, 0, "running"), event("done", 1, 0, "completed"), event("busy", 1, 0, "running")])
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    run = lambda: P.write_batches(P.sweep_inactive(P.stream_events(spark, str(src)).select("run_id", "sequence", "timestamp", "status"), 10), out, mark)
    run()
    write(src, "2.json", [event("busy", 2, 30, "running")])
    run()
    rows = spark.read.parquet(out).collect()
    assert [(r.run_id, r.sequence, r.status) for r in rows if r.run_id != "busy"] == [("idle", 2, "failed")]


def test_interruptions_are_numbered_onwards(spark, tmp_path):
    """Gaps and repeats do not change the number, and a run that goes on after a sweep is not numbered from one again."""
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    run = lambda: P.write_batches(P.sweep_inactive(P.stream_events(spark, str(src)).select("run_id", "sequence", "timestamp", "status"), 5), out, mark)
    for name, rows in (("1", [event("idle", 4, 0, "running"), event("idle", 4, 0, "running"), event("clock", 1, 0, "completed")]), ("2", [event("clock", 2, 20, "completed")]),
                       ("3", [event("idle", 6, 21, "running"), event("clock", 3, 21, "completed")]), ("4", [event("clock", 4, 50, "completed")])):
        write(src, f"{name}.json", rows)
        run()
    assert sorted((r.sequence, r.status) for r in spark.read.parquet(out).filter("run_id = 'idle'").collect()) == [(5, "failed"), (7, "failed")]


def test_corpus_intake_takes_new_content_once(spark, tmp_path):
    src, store, mark = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "mark")
    src.mkdir()
    (src / "a.txt").write_bytes("旧城\n".encode("gb18030"))
    (src / "b.txt").write_bytes("旧城\n".encode())
    P.stream_corpus(spark, str(src), store, mark)
    (src / "c.txt").write_bytes("旧城\n".encode("utf-16"))
    (src / "d.txt").write_bytes("渡口\n".encode())
    P.stream_corpus(spark, str(src), store, mark)
    assert sorted(r.text for r in spark.read.parquet(f"{store}/corpus").collect()) == ["旧城\n", "渡口\n"]


def test_conversation_files_are_checked(spark, tmp_path):
    good = {"version": 1, "conversation_id": "a", "novel_id": "n", "title": "t", "created_at": "x", "updated_at": "y", "turns": [{"turn_id": "1", "run_id": "r", "question": "q", "status": "queued", "created_at": "z", "events": [], "snapshot": {}}]}
    for name, value in (("a", good), ("b", good), ("c", {**good, "conversation_id": "c", "turns": [{"turn_id": "1"}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    (tmp_path / "d.json").write_text("{")
    ok, bad = J.scan_conversations(spark, str(tmp_path))
    assert [r.conversation_id for r in ok.collect()] == ["a"]
    assert {r.name: r.reason for r in bad.collect()} == {"b": "id_mismatch", "c": "invalid_turn", "d": "not_json"}


def test_intake_lays_its_files_in_one_folder_and_opens_them_once(spark, tmp_path, monkeypatch):
    """Rows of one id are one file; copies of a text are taken in once; a null text is blank."""
    from quillgraph.plans.stream_queries import w01
    from quillgraph.streaming import pipelines
    rows = [(1, "alpha"), (2, "beta\nbeta"), (3, "alpha"), (4, None), (5, "gamma"), (5, "gamma"), (None, "delta")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    decoded, plain = [], pipelines.decode_files
    monkeypatch.setattr(pipelines, "decode_files", lambda files: decoded.append(files) or plain(files))
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{shared}/intake-*"))
    got = {r.text_md5: r.n for r in w01(spark, str(tmp_path)).collect()}
    assert got == {hashlib.md5(t.encode()).hexdigest(): 1 for t in ("alpha\n", "beta\nbeta\n", "gamma\ngamma\n", "delta\n")}
    made, = set(glob.glob(f"{shared}/intake-*")) - before
    assert not glob.glob(f"{made}/in/*/") and len(glob.glob(f"{made}/in/*.txt")) == 6
    assert "binaryFile" not in decoded[0]._jdf.queryExecution().toString()


def test_texts_are_written_as_files_and_taken_in(spark, tmp_path):
    """Bytes of each text and a line break under its name, nothing else in the folder; taking them in leaves the session's settings alone."""
    from quillgraph.sources.corpora import write_texts
    files = spark.createDataFrame([(str(i), f"text {i}\nMéé") for i in range(300)] + [("none", "")], "name string, text string")
    write_texts(files, str(tmp_path / "in"))
    names = sorted(p.name for p in (tmp_path / "in").iterdir())
    assert names == sorted([f"{i}.txt" for i in range(300)] + ["none.txt"])
    assert (tmp_path / "in/7.txt").read_bytes() == "text 7\nMéé\n".encode() and (tmp_path / "in/none.txt").read_bytes() == b"\n"
    P.stream_corpus(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "mark"))
    assert spark.read.parquet(str(tmp_path / "store/corpus")).count() == 300
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
