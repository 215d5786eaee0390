"""Registered queries of investigation analytics, with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import evidence as A
from quillgraph.operators import presets
from quillgraph.operators.search import verify_quotes
from quillgraph.plans.adapters import CHUNKS, line_chunks, sql, table

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


EV = """ev AS (SELECT *, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events)"""

PROPOSALS = CHUNKS + """,
pp AS (SELECT corpus_id AS run_id, section_order AS round, chunk_in_section AS pos, 'e' || (length(text)%7) AS evidence_id, 't' || (section_order%2) AS task_id,
   CASE WHEN chunk_order%6=5 THEN 'forged words' ELSE substr(text, 1 + (chunk_order%2)::INT, 12) END AS quote, text FROM ck QUALIFY row_number() OVER (PARTITION BY corpus_id, section_order ORDER BY chunk_order) <= 3),
it AS (SELECT *, regexp_replace(regexp_replace(quote, '\\s+', '', 'g'), '^[，。；：、,.!！?？"''“”‘’]+|[，。；：、,.!！?？"''“”‘’]+$', '', 'g') AS q,
   length(trim(quote)) > 0 AND contains(text, regexp_replace(quote, '^\\s+|\\s+$', '', 'g')) AS valid, row_number() OVER (PARTITION BY run_id ORDER BY round, pos) AS n FROM pp),
fold AS (SELECT run_id, 0::BIGINT AS n, []::VARCHAR[] AS ids, []::VARCHAR[] AS qs, []::VARCHAR[] AS ts, 0::BIGINT AS round, 0::BIGINT AS pos, '' AS evidence_id, '' AS outcome FROM (SELECT DISTINCT run_id FROM it)
  UNION ALL SELECT run_id, n, CASE WHEN o='accepted' THEN list_append(ids, eid) ELSE ids END, CASE WHEN o='accepted' THEN list_append(qs, q) ELSE qs END, CASE WHEN o='accepted' THEN list_append(ts, task_id) ELSE ts END, round, pos, eid, o FROM (
    SELECT f.run_id, i.n, f.ids, f.qs, f.ts, i.round, i.pos, i.evidence_id AS eid, i.q, i.task_id,
      CASE WHEN len(list_filter(f.ts, lambda t: t = i.task_id)) >= 6 OR list_contains(f.ids, i.evidence_id) OR i.q = '' OR list_contains(f.qs, i.q) THEN 'skipped' WHEN NOT i.valid THEN 'rejected' ELSE 'accepted' END AS o
    FROM fold f JOIN it i ON i.run_id = f.run_id AND i.n = f.n + 1))"""


def _proposals(spark, sf):
    c = line_chunks(spark, sf)
    quote = F.when(F.col("chunk_order") % 6 == 5, "forged words").otherwise(F.substring("text", F.when(F.col("chunk_order") % 2 == 0, 1).otherwise(2), F.lit(12)))
    asked = c.select("corpus_id", "chunk_id", F.col("corpus_id").alias("run_id"), F.col("section_order").alias("round"), F.col("chunk_in_section").alias("pos"),
                     F.concat(F.lit("e"), F.length("text") % 7).alias("evidence_id"), F.concat(F.lit("t"), F.col("section_order") % 2).alias("task_id"), quote.alias("quote"))
    return verify_quotes(asked, c)


@register("a01_accept_evidence", sql(PROPOSALS, "SELECT run_id, round, pos, evidence_id, outcome FROM fold WHERE n > 0"))
def a01(spark, sf):
    return A.accept_evidence(_proposals(spark, sf))


@register("a02_hypothesis_upsert", sql(EV, """, h AS (SELECT user_id AS run_id, 'h' || (k%12) AS hypothesis_id, arg_max(CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'revised' ELSE 'rejected' END, event_id) AS status, min(event_id) AS first_seen FROM ev GROUP BY 1,2)
 SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY status NOT IN ('active','revised'), first_seen, hypothesis_id) AS position FROM h QUALIFY position <= 8""").replace("\n, h AS", ", h AS"))
def a02(spark, sf):
    t = F.col("event_type")
    return A.latest_hypotheses(table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.concat(F.lit("h"), _k() % 12).alias("hypothesis_id"), F.when(t == "view", "active").when(t == "click", "revised").otherwise("rejected").alias("status"),
        F.col("event_id").alias("sequence")))


@register("a03_bounded_unique", sql(EV, """, f AS (SELECT user_id AS run_id, trim(value) AS value, min(event_id) AS p FROM (SELECT user_id, event_id, CASE WHEN k%5=0 THEN '   ' ELSE '  ' || event_type || (k%6) || ' ' END AS value FROM ev) WHERE trim(value) <> '' GROUP BY 1,2),
 b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY p DESC, value DESC) AS b FROM f QUALIFY b <= 8)
 SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY b DESC) AS rank, value FROM b""").replace("\n, f AS", ", f AS"))
def a03(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("position"),
                                             F.when(_k() % 5 == 0, "   ").otherwise(F.concat(F.lit("  "), "event_type", _k() % 6, F.lit(" "))).alias("value"))
    return A.bounded_unique(rows, 8)


CALLS = EV + """,
hist AS (SELECT user_id AS run_id, event_id AS sequence, event_type AS tool, CASE WHEN k%11=0 THEN event_type || ':unknown' ELSE 'ask_' || event_type || ':{"a":' || k%3 || ',"b":"' || event_type || '"}' END AS fingerprint,
  event_type <> 'error' AS ok, CASE WHEN event_type='error' THEN '{"error":"e' || k || '"}' WHEN k%10=3 THEN 'plain ' || k ELSE '{"graph_version":"g' || k%4 || '","truncated":' || CASE WHEN event_id%2=0 THEN 'true' ELSE 'false' END || '}' END AS content, k, event_id FROM ev)"""


def _calls(spark, sf):
    e = table(spark, sf, "events")
    k, t = _k(), F.col("event_type")
    calls = e.select(F.col("user_id").alias("run_id"), F.col("event_id").cast("string").alias("call_id"), F.concat(F.lit("ask_"), t).alias("name"),
                     F.concat(F.lit('{"b": "'), t, F.lit('", "a": '), k % 3, F.lit("}")).alias("args"))
    content = (F.when(t == "error", F.concat(F.lit('{"error":"e'), k, F.lit('"}'))).when(k % 10 == 3, F.concat(F.lit("plain "), k))
               .otherwise(F.concat(F.lit('{"graph_version":"g'), k % 4, F.lit('","truncated":'), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit("}"))))
    results = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence"), F.when(k % 11 == 0, "lost").otherwise(F.col("event_id").cast("string")).alias("call_id"),
                       t.alias("tool"), content.alias("content"))
    return calls, results


@register("a04_tool_history", sql(CALLS, """SELECT run_id, sequence, tool, fingerprint, ok, length(content) AS result_size, CASE WHEN content LIKE '{"graph%' THEN 'g' || k%4 END AS graph_version, content LIKE '{"graph%' AND event_id%2=0 AS truncated FROM hist"""))
def a04(spark, sf):
    return A.tool_history(*_calls(spark, sf))


@register("a05_repeated_calls", sql(EV, """, h AS (SELECT user_id AS run_id, event_id//60 AS turn, event_id AS sequence, event_type IN ('view','click','purchase','signup') AS f FROM ev),
 l AS (SELECT *, lag(f,1) OVER (PARTITION BY run_id ORDER BY sequence) AS a, lag(f,2) OVER (PARTITION BY run_id ORDER BY sequence) AS b FROM h),
 t AS (SELECT *, first_value(a) OVER w AS fa, first_value(b) OVER w AS fb FROM l WINDOW w AS (PARTITION BY run_id, turn ORDER BY sequence))
 SELECT run_id, turn, bool_and(coalesce(f = fa AND f = fb, false)) AS repeated FROM t GROUP BY 1,2""").replace("\n, h AS", ", h AS"))
def a05(spark, sf):
    h = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.floor(F.col("event_id") / 60).alias("turn"), F.col("event_id").alias("sequence"),
                                          F.when(F.col("event_type") == "error", "failed").otherwise("search").alias("fingerprint"))
    return A.detect_loops(h)


TASKS = """li AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag='A') AS ev FROM lineitem GROUP BY 1),
tk AS (SELECT o_custkey AS run_id, o_orderkey AS task_id, o_orderkey AS position, CASE WHEN o_orderkey%5=0 THEN 'completed' WHEN o_orderkey%5=1 THEN 'in_progress' ELSE 'pending' END AS status, o_orderkey%3=0 AS claimed,
  coalesce(ev,0) AS evidence, coalesce(n,0) AS attempts, o_orderkey%5=1 AS current, o_orderkey%7=0 AS requested FROM orders LEFT JOIN li ON l_orderkey=o_orderkey),
t1 AS (SELECT * EXCLUDE (status), CASE WHEN claimed AND evidence>0 THEN 'completed' WHEN current AND status='in_progress' AND attempts>=2 THEN CASE WHEN evidence>0 THEN 'completed' ELSE 'blocked' END ELSE status END AS st FROM tk),
nx AS (SELECT run_id, arg_min(task_id, struct_pack(r := NOT requested, p := position)) AS next_task_id FROM t1 WHERE st IN ('pending','in_progress') GROUP BY 1),
t2 AS (SELECT t1.*, next_task_id, CASE WHEN task_id = next_task_id AND st='pending' THEN 'in_progress' ELSE st END AS status FROM t1 LEFT JOIN nx USING (run_id))"""


def _tasks(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    per = l.groupBy("l_orderkey").agg(F.count("*").alias("attempts"), F.count_if(F.col("l_returnflag") == "A").alias("evidence"))
    k = F.col("o_orderkey")
    return o.join(per, k == F.col("l_orderkey"), "left").select(
        F.col("o_custkey").alias("run_id"), k.alias("task_id"), k.alias("position"), F.when(k % 5 == 0, "completed").when(k % 5 == 1, "in_progress").otherwise("pending").alias("status"),
        (k % 3 == 0).alias("claimed"), F.coalesce("evidence", F.lit(0)).alias("evidence"), F.coalesce("attempts", F.lit(0)).alias("attempts"), (k % 5 == 1).alias("current"), (k % 7 == 0).alias("requested"))


@register("a06_task_status", sql(TASKS, "SELECT run_id, task_id, status FROM t2"))
def a06(spark, sf):
    return A.task_status(_tasks(spark, sf))[0].select("run_id", "task_id", "status")


@register("a06_runs_resolved", sql(TASKS, "SELECT run_id, bool_and(status IN ('completed','blocked')) AS all_resolved, any_value(next_task_id) AS next_task_id FROM t2 GROUP BY 1"))
def a06_runs(spark, sf):
    return A.task_status(_tasks(spark, sf))[1]


def _runs(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("run_id"), (k % 2 == 0).alias("sufficient"), (k % 3 != 0).alias("all_resolved"), (k % 13).alias("step_count"), F.lit(10).alias("max_steps"),
        F.when(k % 5 == 0, "simple").otherwise("complex").alias("mode"), (k % 4 != 0).alias("should_replan"), (k % 3).alias("replan_count"), F.lit(2).alias("max_replans"),
        F.when(k % 17 == 0, "repeated_tool_call").alias("previous"))


TERM = """tm AS (SELECT c_custkey AS run_id, CASE WHEN c_custkey%2=0 AND c_custkey%3<>0 THEN 'evidence_sufficient' WHEN c_custkey%13 >= 10 THEN 'max_steps_reached'
  WHEN c_custkey%3<>0 AND (c_custkey%5=0 OR c_custkey%4=0 OR c_custkey%3>=2) THEN 'tasks_resolved' WHEN c_custkey%17=0 THEN 'repeated_tool_call' END AS termination_reason FROM customer)"""


@register("a07_termination_reason", sql(TERM, "SELECT * FROM tm"))
def a07(spark, sf):
    return A.termination(_runs(spark, sf)).select("run_id", "termination_reason")


@register("a08_limitations", sql(TERM, """, li AS (SELECT run_id, unnest(list_concat(list_concat(list_transform(range(0, run_id%7), lambda i: '缺失信息：gap' || i%3), list_transform(range(0, run_id%5), lambda i: '证据矛盾：clash' || i)),
   CASE termination_reason WHEN 'max_steps_reached' THEN ['stopped: steps'] WHEN 'repeated_tool_call' THEN ['repeated_tool_call'] ELSE [] END)) AS value,
   generate_subscripts(list_concat(list_concat(list_transform(range(0, run_id%7), lambda i: ''), list_transform(range(0, run_id%5), lambda i: '')), CASE WHEN termination_reason IN ('max_steps_reached','repeated_tool_call') THEN [''] ELSE [] END), 1) AS p FROM tm),
 f AS (SELECT run_id, value, min(p) AS p FROM li GROUP BY 1,2), b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY p DESC) AS b FROM f QUALIFY b <= 8)
 SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY b DESC) AS rank, value FROM b""").replace("\n, li AS", ", li AS"))
def a08(spark, sf):
    k = F.col("run_id")
    some = lambda n: F.when(k % n > 0, F.sequence(F.lit(0).cast("bigint"), k % n - 1)).otherwise(F.array().cast("array<bigint>"))
    runs = A.termination(_runs(spark, sf)).select(
        "run_id", F.transform(some(7), lambda i: F.concat(F.lit("gap"), i % 3)).alias("missing"), F.transform(some(5), lambda i: F.concat(F.lit("clash"), i)).alias("contradictions"), "termination_reason")
    return A.limitations(runs, {"max_steps_reached": "stopped: steps"})


@register("a09_question_complexity", """SELECT conv_id, turn, CASE WHEN length(regexp_replace(text, '\\s+', '', 'g')) <= 60 AND NOT regexp_matches(regexp_replace(text, '\\s+', '', 'g'), '分析|为什么|为何|如何体现|变化|成长|关系|动机|原因|意义|象征|主题|对比|评价|解读|发展|矛盾|影响|阶段')
  THEN 'simple' ELSE 'complex' END AS mode FROM (SELECT conv_id, turn, CASE WHEN conv_id%6=1 THEN '为什么 ' || substr(text, 1, 20) ELSE text END AS text FROM conversations WHERE role='user')""")
def a09(spark, sf):
    t = table(spark, sf, "conversations").filter("role = 'user'")
    q = t.withColumn("question", F.when(F.col("conv_id") % 6 == 1, F.concat(F.lit("为什么 "), F.substring("text", 1, 20))).otherwise(F.col("text")))
    return A.classify_questions(q).select("conv_id", "turn", "mode")


@register("a10_run_metrics", sql(CALLS, TASKS, """SELECT c.c_custkey AS run_id, coalesce(h.n,0) AS tool_call_count, CASE WHEN coalesce(h.n,0)>0 THEN round(h.u*1.0/h.n,3) ELSE 0 END AS unique_tool_call_ratio, coalesce(e.n,0) AS evidence_count,
  coalesce(e.against,false) AS counter_evidence_found, CASE WHEN coalesce(t.n,0)>0 THEN round(coalesce(e.u,0)*1.0/t.n,3) ELSE 0 END AS evidence_coverage, coalesce(t.r,0) AS resolved_task_count
 FROM customer c LEFT JOIN (SELECT run_id, count(*) AS n, count(DISTINCT fingerprint) AS u FROM hist GROUP BY 1) h ON h.run_id=c.c_custkey
 LEFT JOIN (SELECT o_custkey AS run_id, count(*) AS n, count(DISTINCT o_orderkey) AS u, bool_or(l_linestatus='F') AS against FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE l_returnflag='A' GROUP BY 1) e ON e.run_id=c.c_custkey
 LEFT JOIN (SELECT run_id, count(*) AS n, count(*) FILTER (status IN ('completed','blocked')) AS r FROM t2 GROUP BY 1) t ON t.run_id=c.c_custkey"""))
def a10(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    evidence = l.filter("l_returnflag = 'A'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("task_id"), (F.col("l_linestatus") != "F").alias("supports"))
    runs = table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"))
    return A.run_metrics(runs, A.tool_history(*_calls(spark, sf)), evidence, A.task_status(_tasks(spark, sf))[0])


@register("a11_event_detail", sql(EV, """SELECT event_id, CASE event_type WHEN 'signup' THEN 'a plan' WHEN 'click' THEN 'researcher' WHEN 'view' THEN 'tools' WHEN 'error' THEN 'assessor' ELSE 'an answer' END AS label,
  CASE WHEN event_type='signup' THEN k%4 END AS task_count, CASE WHEN event_type='click' THEN CASE WHEN k%2=0 THEN 'find{"q":' || k || ',"in":["a"]},read{}' ELSE 'find{"q":' || k || ',"in":["a"]}' END END AS tool_calls,
  CASE WHEN event_type='view' THEN 'find,graph' END AS tools, CASE WHEN event_type='view' THEN k%5 END AS graph_nodes, CASE WHEN event_type='error' THEN k%3 END AS evidence_count, CASE WHEN event_type='error' THEN k%2=0 END AS sufficient, CASE WHEN event_type='error' THEN CASE WHEN k%2=0 THEN '' ELSE 'gap ' || k END END AS rationale,
  CASE WHEN event_type='purchase' THEN k%3<>0 END AS answer_ready FROM ev"""))
def a11(spark, sf):
    t, k = F.col("event_type"), _k()
    node = F.when(t == "signup", "planner").when(t == "click", "researcher").when(t == "view", "tools").when(t == "error", "assessor").otherwise("writer")
    listed = lambda n: F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit('{"x":1}'), n.cast("int")), ","), F.lit("]"))
    call = F.concat(F.lit('{"messages":[{"tool_calls":[{"name":"find","args":{"q":'), k, F.lit(',"in":["a"]}}'), F.when(k % 2 == 0, ',{"name":"read"}').otherwise(""), F.lit("]}]}"))
    inner = F.concat(F.lit('{"graph_version":"g1","nodes":'), listed(k % 5), F.lit("}"))
    tools = F.to_json(F.struct(F.array(F.struct(F.lit("find").alias("name"), F.lit("plain").alias("content")), F.struct(F.lit("graph").alias("name"), inner.alias("content"))).alias("messages")))
    update = F.when(t == "click", call).when(t == "view", tools).otherwise("{}")
    snap = F.concat(F.lit('{"plan":'), listed(k % 4), F.lit(',"evidence":'), listed(k % 3), F.lit(',"review":{"sufficient":'), F.when(k % 2 == 0, "true").otherwise(F.concat(F.lit('false,"rationale":"gap '), k, F.lit('"'))),
                    F.lit('},"final_answer":"'), F.when(k % 3 != 0, "yes").otherwise(""), F.lit('"}'))
    d = A.event_detail(table(spark, sf, "events").select("event_id", node.alias("node"), update.alias("update"), snap.alias("snapshot")), {"planner": "a plan", "writer": "an answer"})
    calls = F.transform("tool_calls", lambda c: F.concat(c["name"], c["args"]))
    return d.select("event_id", "label", F.col("task_count").cast("bigint").alias("task_count"), F.array_join(calls, ",").alias("tool_calls"), F.array_join("tools", ",").alias("tools"),
                    F.col("graph_queries")[0]["node_count"].cast("bigint").alias("graph_nodes"), F.col("evidence_count").cast("bigint").alias("evidence_count"), "sufficient", "rationale", "answer_ready")


_TOOLS = list(presets.CAPS)


@register("u07_tool_views", "WITH caps AS (SELECT * FROM (VALUES " + ",".join(
    f"('{t}',{i},'{p}',{d},{a},{b})" for i, (t, caps) in enumerate(presets.CAPS.items()) for p, (d, a, b) in caps.items()) + """) v(tool, i, parameter, d, a, b))
 SELECT o_orderkey AS request_id, tool, parameter, least(greatest(CASE WHEN o_orderkey%3=0 THEN d ELSE o_orderkey%40 - 5 END, a), b) AS value FROM orders JOIN caps ON i = o_orderkey%""" + str(len(_TOOLS)))
def u07(spark, sf):
    k = F.col("o_orderkey")
    names = sorted({p for caps in presets.CAPS.values() for p in caps})
    given = F.create_map(*[x for n in names for x in (F.lit(n), k % 40 - 5)])
    rq = table(spark, sf, "orders").select(k.alias("request_id"), F.element_at(F.array(*[F.lit(t) for t in _TOOLS]), (k % len(_TOOLS) + 1).cast("int")).alias("tool"),
                                           F.when(k % 3 != 0, given).otherwise(F.create_map().cast("map<string,bigint>")).alias("params"))
    return presets.tool_views(rq)
