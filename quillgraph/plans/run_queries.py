"""Registered queries of usage, turns, conversations and failures, with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import runs as T
from quillgraph.plans.adapters import sql, table

QUERIES, SQL = {}, {}


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn
    return keep


def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


USAGE = """us AS (SELECT event_id, user_id AS run_id, event_type AS node, value AS elapsed_seconds, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events),
nu AS (SELECT *, CASE WHEN node='signup' OR k%7=0 THEN NULL ELSE k END AS input_tokens, CASE WHEN node='signup' OR k%5=0 THEN NULL ELSE k*2 END AS output_tokens FROM us),
nt AS (SELECT *, CASE WHEN node='signup' THEN NULL WHEN k%3=0 THEN k*4 ELSE input_tokens + output_tokens END AS total_tokens, CASE WHEN node='signup' OR k%4<>0 THEN NULL ELSE k END AS reasoning_tokens,
   CASE WHEN node='signup' OR k%6<>0 THEN NULL ELSE k END AS cached_tokens FROM nu),
nr AS (SELECT *, coalesce(input_tokens, output_tokens, total_tokens, reasoning_tokens, cached_tokens) IS NOT NULL AS usage_reported FROM nt)"""


def usage_events(spark, sf):
    """Raw responses in both vendor shapes; some counters are absent and some calls report nothing."""
    e = table(spark, sf, "events")
    k, t = _k(), F.col("event_type")
    inp, out, tot = F.when(k % 7 != 0, k), F.when(k % 5 != 0, k * 2), F.when(k % 3 == 0, k * 4)
    reason, cached = F.when(k % 4 == 0, k), F.when(k % 6 == 0, k)
    one = F.to_json(F.struct(F.struct(inp.alias("input_tokens"), out.alias("output_tokens"), tot.alias("total_tokens"), F.struct(cached.alias("cache_read")).alias("input_token_details"),
                                      F.struct(reason.alias("reasoning")).alias("output_token_details")).alias("usage_metadata")))
    body = F.struct(inp.alias("prompt_tokens"), out.alias("completion_tokens"), tot.alias("total_tokens"), F.struct(cached.alias("cached_tokens")).alias("prompt_tokens_details"),
                    F.struct(reason.alias("reasoning_tokens")).alias("completion_tokens_details"))
    two = F.to_json(F.struct(F.struct(body.alias("token_usage")).alias("response_metadata")))
    raw = F.when(t == "signup", "{}").when(F.col("event_id") % 2 == 0, one).otherwise(two)
    return e.select("event_id", F.col("user_id").alias("run_id"), t.alias("node"), F.col("value").alias("elapsed_seconds"), raw.alias("raw"))


@register("t01_usage_normalisation", sql(USAGE, "SELECT event_id, input_tokens, output_tokens, total_tokens, reasoning_tokens, cached_tokens, usage_reported FROM nr"))
def t01(spark, sf):
    return T.normalize_usage(usage_events(spark, sf)).select("event_id", *T.COUNTERS, "usage_reported")


ROLLUP = """SELECT run_id, node, CAST(coalesce(sum(input_tokens),0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens),0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(total_tokens),0) AS BIGINT) AS total_tokens,
 CAST(coalesce(sum(reasoning_tokens),0) AS BIGINT) AS reasoning_tokens, CAST(coalesce(sum(cached_tokens),0) AS BIGINT) AS cached_tokens, round(sum(elapsed_seconds),6) AS elapsed_seconds,
 count(*) FILTER (usage_reported) AS reported_call_count, count(*) FILTER (NOT usage_reported) AS unknown_call_count, grouping(node) AS is_total FROM nr GROUP BY GROUPING SETS ((run_id, node), (run_id))"""


@register("t02_usage_by_node", sql(USAGE, ROLLUP))
def t02(spark, sf):
    return T.usage_rollup(T.normalize_usage(usage_events(spark, sf)))


def run_events(spark, sf):
    """The event table as run events; sequence and timestamp are the event id."""
    e = table(spark, sf, "events")
    k, t, i = _k(), F.col("event_type"), F.col("event_id")
    status = F.when(t == "signup", "queued").when(t.isin("view", "click"), "running").when(t == "purchase", "completed").otherwise("failed")
    detail = (F.when((t == "click") & (k % 3 == 0), '{"code":"manual_retry_requested"}').when((t == "error") & (i % 2 == 0), '{"retryable":true}')
              .when(t == "error", '{"retryable":false,"resumable":true}').otherwise("{}"))
    return e.select(F.col("user_id").alias("run_id"), i.alias("sequence"), i.alias("timestamp"), status.alias("status"), F.when(t == "error", F.concat(F.lit("failed "), k)).alias("error"),
                    detail.alias("detail"), F.when(t == "view", F.concat(F.lit('{"step":'), k, F.lit("}"))).otherwise("{}").alias("snapshot"))


FOLD = """re AS (SELECT user_id AS run_id, event_id AS sequence, CAST(json_extract(props,'$.k') AS BIGINT) AS k, event_type AS t, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status FROM events),
tc AS (SELECT *, CASE WHEN t='view' THEN sequence END AS s_snap, CASE WHEN t='error' OR t='purchase' OR (t='click' AND k%3=0) THEN sequence END AS s_err,
  CASE WHEN t IN ('error','purchase') THEN sequence END AS s_retry, CASE WHEN t='purchase' OR (t='error' AND sequence%2=1) THEN sequence END AS s_res FROM re),
tn AS (SELECT run_id, max(sequence) AS last_sequence, count(*) AS event_count, arg_max(status, sequence) AS status, max(sequence) AS updated_at, arg_max('{"step":' || k || '}', s_snap) AS snapshot,
  arg_max(struct_pack(v := CASE WHEN t='error' THEN 'failed ' || k END), s_err).v AS error, coalesce(arg_max(t='error' AND sequence%2=0, s_retry), false) AS retryable, coalesce(arg_max(t='error', s_res), false) AS resumable,
  arg_max(struct_pack(v := CASE WHEN status IN ('completed','failed') THEN sequence END), sequence).v AS completed_at FROM tc GROUP BY 1)"""


@register("t03_turn_state", sql(FOLD, "SELECT * FROM tn"))
def t03(spark, sf):
    return T.fold_turns(run_events(spark, sf))


TURNS = """tu AS (SELECT conv_id AS conversation_id, turn AS turn_index, 'r' || conv_id || '.' || turn AS run_id, text AS question, CASE WHEN nr='assistant' THEN nt END AS answer,
  CASE WHEN nr='assistant' THEN 'completed' WHEN conv_id%3=0 THEN 'failed' ELSE 'queued' END AS status FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role='user')"""


def turns(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("nr", F.lead("role").over(w)).withColumn("nt", F.lead("text").over(w)).filter("role = 'user'")
    done = F.col("nr") == "assistant"
    return c.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("turn_index"), F.concat(F.lit("r"), "conv_id", F.lit("."), "turn").alias("run_id"), F.col("text").alias("question"),
                    F.when(done, F.col("nt")).alias("answer"), F.when(done, "completed").when(F.col("conv_id") % 3 == 0, "failed").otherwise("queued").alias("status"))


@register("t04_conversation_list", sql(TURNS, """, cv AS (SELECT conv_id AS conversation_id, conv_id%10 AS corpus_id, max(turn)*1000 + conv_id AS updated_at FROM conversations GROUP BY 1),
 pt AS (SELECT conversation_id, count(*) AS turn_count, arg_max(status, turn_index) AS latest_status, arg_max(run_id, turn_index) FILTER (status='queued') AS active_run_id FROM tu GROUP BY 1)
 SELECT cv.*, coalesce(turn_count,0) AS turn_count, latest_status, active_run_id, row_number() OVER (PARTITION BY corpus_id ORDER BY updated_at DESC, conversation_id) AS position FROM cv LEFT JOIN pt USING (conversation_id)""").replace("\n, cv AS", ", cv AS"))
def t04(spark, sf):
    cv = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("conversation_id")).agg(F.max("turn").alias("m")).select(
        "conversation_id", (F.col("conversation_id") % 10).alias("corpus_id"), (F.col("m") * 1000 + F.col("conversation_id")).alias("updated_at"))
    return T.ordered_list(T.conversation_list(cv, turns(spark, sf)))


@register("t05_history_window", sql(TURNS, """, h AS (SELECT * FROM tu WHERE status='completed' AND length(answer)>0 QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY turn_index DESC) <= 10)
 SELECT conversation_id, turn_index, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_index) AS position, md5(question) AS question_md5, md5(answer) AS answer_md5 FROM h""").replace("\n, h AS", ", h AS"))
def t05(spark, sf):
    return T.history(turns(spark, sf)).select("conversation_id", "turn_index", "position", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


@register("t06_titles", sql(TURNS, """, f AS (SELECT conversation_id, trim(regexp_replace(arg_min(question, turn_index), '\\s+', ' ', 'g')) AS q FROM tu GROUP BY 1)
 SELECT conversation_id, CASE WHEN length(q) <= 32 THEN q ELSE rtrim(substr(q,1,32)) || '…' END AS title FROM f""").replace("\n, f AS", ", f AS"))
def t06(spark, sf):
    return T.titles(turns(spark, sf))


@register("t07_interrupted_turns", sql(FOLD, "SELECT run_id, CASE WHEN status IN ('queued','running') THEN 'failed' ELSE status END AS status, status IN ('queued','running') AS interrupted FROM tn"))
def t07(spark, sf):
    e = run_events(spark, sf)
    return T.interrupt_active(T.fold_turns(e).select("run_id", "status"), e, F.lit(0))[0]


@register("t07_interruption_events", sql(FOLD, """SELECT run_id, event_count + 1 AS sequence, 'error' AS type, 'failed' AS status, '{"code":"run_interrupted","level":"error","retryable":false,"resumable":false}' AS detail FROM tn WHERE status IN ('queued','running')"""))
def t07_events(spark, sf):
    e = run_events(spark, sf)
    return T.interrupt_active(T.fold_turns(e).select("run_id", "status"), e, F.lit(0))[1].select("run_id", "sequence", "type", "status", "detail")


@register("t08_events_after_cursor", "SELECT user_id AS run_id, event_id AS sequence FROM events WHERE event_id - 1 >= user_id * 31")
def t08(spark, sf):
    e = run_events(spark, sf)
    cursors = e.select("run_id").distinct().withColumn("after", F.col("run_id") * 31)
    return T.events_after(e, cursors).select("run_id", "sequence")


CHAINS = ["ReadTimeout OSError", "AuthenticationError", "RateLimitError HTTPStatusError", "ConnectError", "RuntimeError", "ValueError KeyError", "KeyError RuntimeError", "PermissionDenied"]
CODES = ["model_timeout", "model_authentication_failed", "model_rate_limited", "model_connection_failed", "runtime_configuration_error", "runtime_configuration_error", "agent_execution_failed", "model_authentication_failed"]


@register("t09_failure_taxonomy", f"""SELECT code, count(*) AS failures, code NOT IN ('model_authentication_failed','runtime_configuration_error') AS retryable FROM
 (SELECT ({CODES})[CAST(json_extract(props,'$.k') AS BIGINT)%8+1] AS code FROM events WHERE event_type='error') GROUP BY 1""")
def t09(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'error'").select(F.element_at(F.array(*[F.lit(c) for c in CHAINS]), (_k() % 8 + 1).cast("int")).alias("chain"))
    return T.classify_failures(e).groupBy("code", "retryable").agg(F.count("*").alias("failures"))


@register("t10_retry_report", """SELECT user_id AS version, 'u' || (k%10) AS unit_id, count(*) AS attempts, count(*) FILTER (k%4=0) AS timeouts, count(*) FILTER (k%4=1) AS rate_limits, count(*) FILTER (k%4=2) AS output_limits, 0 AS format_failures,
 count(*) FILTER (event_type='error') AS failed, count(*) FILTER (event_type='signup') AS interrupted FROM (SELECT *, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events) GROUP BY 1,2""")
def t10(spark, sf):
    k, t = _k(), F.col("event_type")
    a = table(spark, sf, "events").select(F.col("user_id").alias("version"), F.concat(F.lit("u"), k % 10).alias("unit_id"), F.when(t == "error", "failed").when(t == "signup", "interrupted").otherwise("completed").alias("status"),
                                          F.when(k % 4 == 0, "graph_model_timeout").when(k % 4 == 1, "graph_model_rate_limited").when(k % 4 == 2, "graph_model_output_limit").alias("error_code"))
    return T.retry_report(a)
