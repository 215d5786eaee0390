"""Registered queries of the sources, sinks and integrity checks, with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions.runtime import scratch_path
from quillgraph.operators import dense
from quillgraph.plans import retrieval_queries as RQ
from quillgraph.plans.adapters import sql, table
from quillgraph.sources import corpora as C
from quillgraph.sources import records as J

QUERIES, SQL = {}, {}


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn
    return keep


def files(spark, sf):
    """The documents as file contents in four encodings; some blank."""
    d = F.col("doc_id")
    body = F.when(d % 50 == 49, F.lit(" \n\t ")).otherwise(F.col("text"))
    utf8 = F.encode(body, "UTF-8")
    content = (F.when(d % 4 == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).when(d % 4 == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(body, "UTF-16LE")))
               .when(d % 4 == 3, F.concat(F.unhex(F.lit("FEFF")), F.encode(body, "UTF-16BE"))).otherwise(utf8))
    return table(spark, sf, "documents").select(d.cast("string").alias("path"), content.alias("content"))


@register("s01_text_corpus_scan", """SELECT CAST(doc_id AS VARCHAR) AS path, CASE doc_id%4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16-le' ELSE 'utf-16-be' END AS encoding, sha256(text) AS source_hash,
 length(text) - length(replace(text, chr(65533), '')) AS replacement_chars FROM documents WHERE doc_id%50 <> 49""")
def s01(spark, sf):
    return C.decode_files(files(spark, sf))[0].drop("text")


@register("s01_rejected_files", "SELECT CAST(doc_id AS VARCHAR) AS path, 'blank' AS reason FROM documents WHERE doc_id%50 = 49")
def s01_rejects(spark, sf):
    return C.decode_files(files(spark, sf))[1]


@register("s01_encoding_census", """SELECT CASE doc_id%4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16-le' ELSE 'utf-16-be' END AS encoding, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS characters,
 CAST(sum(length(text) - length(replace(text, chr(65533), ''))) AS BIGINT) AS replacement_chars FROM documents WHERE doc_id%50 <> 49 GROUP BY 1""")
def s01_census(spark, sf):
    return C.encoding_census(C.decode_files(files(spark, sf))[0])


@register("s02_content_dedup", """SELECT doc_id AS corpus_id, sha256(text) AS source_hash, count(*) OVER (PARTITION BY text) AS copies FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY n_chars + doc_id%7, doc_id) = 1""")
def s02(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("corpus_id"), "text", (F.col("n_chars") + F.col("doc_id") % 7).alias("created_at"))
    return C.dedup_corpora(docs).select("corpus_id", "source_hash", "copies")


MANIFEST = """mf AS (SELECT CAST(doc_id AS VARCHAR) AS directory, CASE doc_id%12 WHEN 1 THEN 'unsupported_version' WHEN 2 THEN 'id_mismatch' WHEN 3 THEN 'bad_filename' WHEN 4 THEN 'bad_hash,hash_mismatch' WHEN 5 THEN 'hash_mismatch' WHEN 6 THEN 'encoding_mismatch'
  WHEN 7 THEN 'missing_field' WHEN 8 THEN 'bad_created_at' WHEN 9 THEN 'missing_source' END AS reasons FROM documents)"""


def _manifests(spark, sf):
    d = F.col("doc_id")
    n = d % 12
    key = d.cast("string")
    docs = table(spark, sf, "documents")
    manifests = docs.select(
        key.alias("directory"), F.when(n == 1, 2).otherwise(1).alias("version"), F.when(n == 2, "other").otherwise(key).alias("novel_id"), F.when(n == 3, "a/b.txt").otherwise("book.txt").alias("filename"),
        F.when(n == 4, "xyz").when(n == 5, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256)).alias("source_hash"), F.when(n == 6, "gb18030").otherwise("utf-8").alias("encoding"),
        F.when(n == 7, F.lit(None).cast("string")).when(n == 8, "yesterday").otherwise("2024-01-01T00:00:00+00:00").alias("created_at"))
    corpus = docs.filter(n != 9).select(key.alias("corpus_id"), "text", F.lit("utf-8").alias("encoding"))
    return C.audit_manifests(manifests, corpus)


@register("s03_manifest_audit", sql(MANIFEST, "SELECT directory, reasons FROM mf WHERE reasons IS NOT NULL"))
def s03(spark, sf):
    return _manifests(spark, sf)[1].select("directory", F.array_join("reasons", ",").alias("reasons"))


@register("s03_sound_manifests", sql(MANIFEST, "SELECT directory FROM mf WHERE reasons IS NULL"))
def s03_ok(spark, sf):
    return _manifests(spark, sf)[0].select("directory")


def _snapshots(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'")
    n = F.col("conv_id") % 9
    turn = F.struct(F.col("turn").cast("string").alias("turn_id"), F.when(n != 4, F.concat(F.lit("r"), "turn")).alias("run_id"), F.col("text").alias("question"), F.lit("completed").alias("status"),
                    F.lit("2024-01-01").alias("created_at"), F.when(n == 5, "[1]").otherwise("{}").alias("snapshot"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("l"))
    body = F.to_json(F.struct(F.when(F.col("conv_id") % 9 == 1, 2).otherwise(1).alias("version"), F.when(F.col("conv_id") % 9 == 2, "other").otherwise(F.col("conv_id").cast("string")).alias("conversation_id"),
                              F.lit("n").alias("novel_id"), F.when(F.col("conv_id") % 9 != 3, "t").alias("title"), F.lit("2024").alias("created_at"), F.lit("2024").alias("updated_at"), F.transform("l", lambda x: x["t"]).alias("turns")))
    return rows.select(F.col("conv_id").cast("string").alias("name"), F.when(F.col("conv_id") % 9 == 6, F.concat(F.lit("{"), body)).otherwise(body).alias("json"))


SNAP = """sn AS (SELECT conv_id, count(*) AS turns FROM conversations WHERE role='user' GROUP BY 1)"""


@register("s04_conversation_scan", sql(SNAP, "SELECT CAST(conv_id AS VARCHAR) AS conversation_id, turns FROM sn WHERE conv_id%9 IN (0,7,8)"))
def s04(spark, sf):
    return J.parse_conversations(_snapshots(spark, sf))[0].select("conversation_id", F.size("turns").alias("turns"))


@register("s04_quarantined", sql(SNAP, """SELECT CAST(conv_id AS VARCHAR) AS name, CASE conv_id%9 WHEN 1 THEN 'unsupported_version' WHEN 2 THEN 'id_mismatch' WHEN 3 THEN 'missing_field' WHEN 6 THEN 'not_json' ELSE 'invalid_turn' END AS reason FROM sn WHERE conv_id%9 IN (1,2,3,4,5,6)"""))
def s04_bad(spark, sf):
    return J.parse_conversations(_snapshots(spark, sf))[1]


def _trace(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("node"), F.col("props").alias("update"))


@register("s05_trace_scan", "SELECT node, count(*) AS n, CAST(sum(CAST(json_extract(props,'$.k') AS BIGINT)) AS BIGINT) AS k FROM (SELECT event_type AS node, props FROM events WHERE event_id%10 <> 9) GROUP BY 1")
def s05(spark, sf):
    e = table(spark, sf, "events")
    line = F.concat(F.lit('{"timestamp":"2024-01-01T00:00:00+00:00","node":"'), "event_type", F.lit('","update":'), "props", F.lit("}"))
    broken = F.when(F.col("event_id") % 10 == 9, F.substring(line, 1, 40)).otherwise(line)
    t = J.parse_trace(e.select(broken.alias("value")))
    return t.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.get_json_object("update", "$.k").cast("bigint")).alias("k"))


@register("s06_trace_sink", "SELECT user_id AS run_id, event_type AS node, 2 * count(*) AS n FROM events GROUP BY 1, 2")
def s06(spark, sf):
    path = scratch_path(spark, "trace")
    rows = _trace(spark, sf)
    J.write_trace(rows, path)
    J.write_trace(rows, path)  # appending again must keep both
    back = spark.read.schema("run_id bigint, timestamp string, node string, update string").json(path)
    return back.groupBy("run_id", "node").agg(F.count("*").alias("n"))


@register("s08_vector_validation", sql(RQ.VEC, """SELECT corpus_id, count(*) AS passages, CASE WHEN CAST(substr(corpus_id,4) AS INT)%5=0 THEN count(*)-1 ELSE count(*) END AS vectors,
  CASE WHEN CAST(substr(corpus_id,4) AS INT)%5=0 THEN 'count_mismatch' WHEN CAST(substr(corpus_id,4) AS INT)%5=1 THEN 'bad_dimension' WHEN CAST(substr(corpus_id,4) AS INT)%5=2 THEN 'not_finite' WHEN CAST(substr(corpus_id,4) AS INT)%5=3 THEN 'zero_vector' END AS reason FROM vl GROUP BY 1"""))
def s08(spark, sf):
    lib, vectors, _ = RQ._hybrid_parts(spark, sf)
    n = F.substring("corpus_id", 4, 9).cast("int") % 5
    first = lib.groupBy("corpus_id").agg(F.min("passage_id").alias("_first"))
    v = vectors.join(first, "corpus_id")
    e, hit = F.col("embedding"), F.col("_first") == F.col("passage_id")
    spoiled = (F.when(hit & (n == 1), F.slice(e, 1, 63)).when(hit & (n == 2), F.concat(F.slice(e, 1, 63), F.array(F.lit(float("nan")).cast("float"))))
               .when(hit & (n == 3), F.transform(e, lambda x: F.lit(0.0).cast("float"))).otherwise(e))
    return dense.validate_vectors(v.withColumn("embedding", spoiled), lib).select("corpus_id", "passages", "vectors", "reason")
