"""Registered queries of the evidence-graph build, with their SQL.

Candidates come from the documents: the capitalised words of a window's core are its entities, neighbouring
ones are related, and planted slips (wrong quotes, repeated ids, missing evidence) exercise every rejection.
"""
from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.runtime import scratch_path, stage
from quillgraph.functions.udfs import extract_candidates, fold_name
from quillgraph.operators import extraction as X
from quillgraph.operators import resolution as R
from quillgraph.operators.components import components
from quillgraph.operators.ontology import ENTITY_TYPES, RELATIONS
from quillgraph.plans.adapters import CHUNKS, chunk_bounds, line_chunks, raw_corpus, sql, table
from quillgraph.sources import graph_store as G
from quillgraph.sources.candidates import ingest_candidates

QUERIES, SQL = {}, {}
VERSION = "v1"


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn
    return keep


def _list(values):
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


# --------------------------------------------------------------------------------------- SQL blocks
WIN = CHUNKS + """,
w0 AS (SELECT corpus_id, chunk_order, start_char AS s, end_char AS e, lag(start_char) OVER w AS ps, lead(end_char) OVER w AS ne FROM ck WINDOW w AS (PARTITION BY corpus_id ORDER BY chunk_order)),
w1 AS (SELECT *, unnest(range(0, (e-s-1)//2500 + 1)) AS n FROM w0),
w2 AS (SELECT *, s + n*2500 AS core_start, least(s + (n+1)*2500, e) AS core_end FROM w1),
win AS (SELECT corpus_id, 'extract:' || chunk_order || ':' || n AS unit_id, chunk_order, core_start, core_end,
   greatest(CASE WHEN core_start = s AND ps IS NOT NULL THEN ps ELSE s END, core_start - 300) AS left_start,
   least(CASE WHEN core_end = e AND ne IS NOT NULL THEN ne ELSE e END, core_end + 300) AS right_end FROM w2),
spn AS (SELECT corpus_id, unit_id, span_id, a, b, substr(text, a+1, b-a) AS text FROM (
   SELECT corpus_id, unit_id, 'core' AS span_id, core_start AS a, core_end AS b FROM win
   UNION ALL SELECT corpus_id, unit_id, 'before', left_start, core_start FROM win UNION ALL SELECT corpus_id, unit_id, 'after', core_end, right_end FROM win)
   JOIN documents ON doc_id = corpus_id WHERE a < b)"""
CANDS = WIN + f""",
nm0 AS (SELECT corpus_id, unit_id, unnest(regexp_extract_all(text, '\\p{{Lu}}\\p{{Ll}}{{2,}}')) AS name, generate_subscripts(regexp_extract_all(text, '\\p{{Lu}}\\p{{Ll}}{{2,}}'), 1) AS i FROM spn WHERE span_id = 'core'),
nm AS (SELECT corpus_id, unit_id, name, row_number() OVER (PARTITION BY corpus_id, unit_id ORDER BY min(i)) - 1 AS k FROM nm0 GROUP BY 1, 2, 3),
ent AS (SELECT corpus_id, unit_id, k AS pos, CASE WHEN k%7=6 THEN 'e1' ELSE 'e' || k END AS local_id, ({_list(ENTITY_TYPES)})[length(name)%6+1] AS type, name,
   CASE WHEN k%5=4 THEN 'before' ELSE 'core' END AS span_id, CASE WHEN k%9=8 THEN name || 'x' ELSE name END AS quote, CASE WHEN k%11=10 THEN 2 ELSE 1 END AS occurrence FROM nm),
pr AS (SELECT b.corpus_id, b.unit_id, b.k, a.name AS sn, b.name AS tn, z.name AS zn FROM nm b JOIN nm a ON a.corpus_id=b.corpus_id AND a.unit_id=b.unit_id AND a.k=b.k-1
   LEFT JOIN nm z ON z.corpus_id=b.corpus_id AND z.unit_id=b.unit_id AND z.k=b.k-2),
rel AS (SELECT corpus_id, unit_id, k AS pos, 'e' || (k-1) AS source, CASE WHEN k%13=12 THEN 'e' || (k-1) ELSE 'e' || k END AS target,
   ({_list(RELATIONS)})[(length(sn)+length(tn)+k)%14+1] AS type, CASE WHEN k%5=0 THEN 'denied' ELSE 'affirmed' END AS polarity,
   CASE WHEN k%3=0 THEN 'character_claim' ELSE 'narration' END AS statement_mode, [sn, CASE WHEN k%8=7 THEN 'missing evidence' ELSE tn END] AS quotes FROM pr),
lnk AS (SELECT corpus_id, unit_id, k AS pos, 'e' || (k-2) AS source, 'e' || k AS target, CASE WHEN k%4=0 THEN [zn] ELSE [zn, tn] END AS quotes FROM pr WHERE k >= 2),
anc AS (SELECT corpus_id, unit_id, 'entity' AS kind, pos, 0 AS part, span_id, quote, occurrence FROM ent
   UNION ALL SELECT corpus_id, unit_id, 'relation', pos, unnest(range(0, len(quotes))), 'core', unnest(quotes), 1 FROM rel
   UNION ALL SELECT corpus_id, unit_id, 'link', pos, unnest(range(0, len(quotes))), 'core', unnest(quotes), 1 FROM lnk),
loc0 AS (SELECT anc.*, s.a, s.text, strpos(s.text, quote) AS p1 FROM anc LEFT JOIN spn s USING (corpus_id, unit_id, span_id)),
loc1 AS (SELECT *, CASE WHEN occurrence = 1 THEN nullif(p1, 0) WHEN p1 > 0 THEN p1 + nullif(strpos(substr(text, p1+1), quote), 0) END AS p FROM loc0),
loc AS (SELECT corpus_id, unit_id, kind, pos, part, quote, a + p - 1 AS start_char, a + p - 1 + length(quote) AS end_char FROM loc1),
att AS (SELECT l.*, c.chunk_id, c.chunk_order, c.section_order FROM loc l LEFT JOIN ck c ON c.corpus_id = l.corpus_id AND c.start_char <= l.start_char AND l.end_char <= c.end_char
   QUALIFY row_number() OVER (PARTITION BY l.corpus_id, unit_id, kind, pos, part ORDER BY c.chunk_order) = 1)"""
VALID = CANDS + """,
ve0 AS (SELECT e.*, a.start_char, a.end_char, a.section_order, a.chunk_id, a.chunk_id IS NOT NULL AND a.quote = e.name AS sound FROM ent e JOIN att a USING (corpus_id, unit_id, pos) WHERE a.kind = 'entity'),
ve AS (SELECT *, sound AND row_number() OVER (PARTITION BY corpus_id, unit_id, local_id, sound ORDER BY pos) = 1 AS valid FROM ve0),
ok AS (SELECT * FROM ve WHERE valid),
rules AS (SELECT * FROM (VALUES """ + ",".join(
    f"('{k}','{a}','{b}')" for k, (x, y) in RELATIONS.items() for a in x for b in y if k not in ("subordinate_to", "part_of") or a == b) + """) t(type, st, tt)),
ev AS (SELECT corpus_id, unit_id, kind, pos, count(*) = count(chunk_id) AS located, list(start_char ORDER BY part) AS starts, list(end_char ORDER BY part) AS ends,
   string_agg(quote, '' ORDER BY part) AS joined, min(section_order) AS first_section, max(section_order) AS last_section FROM att WHERE kind <> 'entity' GROUP BY 1,2,3,4),
vr AS (SELECT r.*, s.type AS st, t.type AS tt, s.name AS sn, t.name AS tn, s.start_char AS sa, s.end_char AS sb, t.start_char AS ta, t.end_char AS tb, ev.starts, ev.ends, ev.first_section, ev.last_section,
   CASE WHEN u.type IS NULL OR r.source = r.target OR NOT ev.located THEN 'rejected'
        WHEN len(list_filter(list_concat(ev.starts, [s.start_char, t.start_char]), lambda x: x >= w.core_start AND x < w.core_end)) > 0 THEN 'kept' ELSE 'outside' END AS status
   FROM rel r JOIN win w USING (corpus_id, unit_id) JOIN ev ON ev.corpus_id=r.corpus_id AND ev.unit_id=r.unit_id AND ev.pos=r.pos AND ev.kind='relation'
   LEFT JOIN ok s ON s.corpus_id=r.corpus_id AND s.unit_id=r.unit_id AND s.local_id=r.source
   LEFT JOIN ok t ON t.corpus_id=r.corpus_id AND t.unit_id=r.unit_id AND t.local_id=r.target
   LEFT JOIN rules u ON u.type=r.type AND u.st=s.type AND u.tt=t.type),
vk AS (SELECT l.*, s.type AS st, s.name AS sn, s.start_char AS sa, s.end_char AS sb, t.name AS tn, t.start_char AS ta, t.end_char AS tb, ev.starts,
   coalesce(ev.located AND s.type = t.type AND contains(ev.joined, s.name) AND contains(ev.joined, t.name), false) AS valid
   FROM lnk l JOIN ev ON ev.corpus_id=l.corpus_id AND ev.unit_id=l.unit_id AND ev.pos=l.pos AND ev.kind='link'
   LEFT JOIN ok s ON s.corpus_id=l.corpus_id AND s.unit_id=l.unit_id AND s.local_id=l.source
   LEFT JOIN ok t ON t.corpus_id=l.corpus_id AND t.unit_id=l.unit_id AND t.local_id=l.target)"""
# NFKC folding of the names in these texts is lower case with the sharp s written out
ENTITIES = VALID + """,
en AS (SELECT corpus_id, unit_id, local_id, unit_id || '|' || local_id AS entity_key, type, name, replace(lower(name),'ß','ss') AS folded, start_char AS position, end_char, section_order, chunk_id FROM ok),
g AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, type, folded ORDER BY position, entity_key) AS rn, position % 5 AS p FROM en)"""


def _judged_sql(decided: bool) -> str:
    """The entities of a name one after the other, with the list of its identities (first entity, spans) as the state."""
    return f""",
st AS (SELECT corpus_id, type, folded, 0 AS k, CAST([] AS STRUCT(key VARCHAR, s STRUCT(a BIGINT, b BIGINT)[])[]) AS ids, NULL::VARCHAR AS entity_key, NULL::VARCHAR AS outcome, NULL::VARCHAR AS joins,
    CAST([] AS STRUCT(apart INT, d BIGINT, i BIGINT, key VARCHAR)[]) AS ranked FROM (SELECT DISTINCT corpus_id, type, folded FROM g)
  UNION ALL SELECT corpus_id, type, folded, k, CASE WHEN joins IS NULL THEN list_append(ids, struct_pack(key := entity_key, s := [span]))
      ELSE list_transform(ids, lambda x: struct_pack(key := x.key, s := CASE WHEN x.key = joins THEN list_append(x.s, span) ELSE x.s END)) END, entity_key, outcome, joins, ranked FROM (
   SELECT *, CASE outcome WHEN 'shared_span' THEN ranked[1].key WHEN 'merged' THEN wanted WHEN 'same_name_reused' THEN ranked[1].key END AS joins FROM (
    SELECT *, CASE WHEN n > 0 AND ranked[1].apart = 0 THEN 'shared_span' WHEN n = 0 THEN 'new' WHEN merging AND list_contains(list_transform(ranked[1:5], lambda x: x.key), wanted) THEN 'merged'
       WHEN apart THEN 'kept_apart' WHEN n = 1 THEN 'same_name_reused' ELSE 'ambiguous' END AS outcome FROM (
     SELECT st.corpus_id, st.type, st.folded, st.k + 1 AS k, st.ids, len(st.ids) AS n, g.entity_key, struct_pack(a := g.position, b := g.end_char) AS span,
        {'g.p = 0' if decided else 'false'} AS merging, {'g.p = 1' if decided else 'false'} AS apart, CASE WHEN len(st.ids) > 0 THEN st.ids[1].key END AS wanted,
        list_sort(list_transform(st.ids, lambda x, i: struct_pack(apart := CASE WHEN list_contains(x.s, struct_pack(a := g.position, b := g.end_char)) THEN 0 ELSE 1 END,
          d := list_min(list_transform(x.s, lambda y: abs(y.a - g.position))), i := i, key := x.key))) AS ranked
     FROM st JOIN g ON g.corpus_id = st.corpus_id AND g.type = st.type AND g.folded = st.folded AND g.rn = st.k + 1)))),
jn AS (SELECT * FROM st WHERE k > 0),
cl AS (SELECT corpus_id, entity_key, coalesce(joins, entity_key) AS cluster FROM jn)"""


DECIDE = ENTITIES + _judged_sql(True) + """,
hd AS (SELECT cl.*, en.type, first_value(en.name) OVER (PARTITION BY cl.corpus_id, cluster ORDER BY en.position, en.entity_key) AS head FROM cl JOIN en USING (corpus_id, entity_key)),
lo AS (SELECT k.corpus_id, k.unit_id || '|' || k.pos AS link_key, s.cluster AS sc, t.cluster AS tc,
   CASE WHEN s.cluster = t.cluster THEN 'same' WHEN k.pos%6 = 0 THEN 'merged' ELSE 'ambiguous' END AS outcome FROM vk k
   JOIN hd s ON s.corpus_id=k.corpus_id AND s.entity_key = k.unit_id || '|' || k.source JOIN hd t ON t.corpus_id=k.corpus_id AND t.entity_key = k.unit_id || '|' || k.target WHERE k.valid)"""
CANON = ENTITIES + f""",
idn AS (SELECT *, min(entity_key) OVER (PARTITION BY corpus_id, type, folded) AS identity FROM en),
ms AS (SELECT corpus_id, identity, position, end_char, any_value(type) AS type, arg_min(name, name) AS quote, min(section_order) AS section_order FROM idn GROUP BY 1,2,3,4),
ce AS (SELECT corpus_id, identity, any_value(type) AS type, arg_min(quote, struct_pack(a := position, b := end_char)) AS name, min(struct_pack(a := position, b := end_char)) AS f, min(section_order) AS first_section_order, count(*) AS mention_count FROM ms GROUP BY 1,2),
can AS (SELECT *, sha256('["{VERSION}",[' || f.a || ',' || f.b || ',"' || type || '"]]') AS entity_id FROM ce),
kr0 AS (SELECT r.corpus_id, r.unit_id, r.pos, r.type, r.polarity, r.statement_mode, r.starts, r.ends, r.first_section, r.last_section, a.entity_id AS s, b.entity_id AS t,
   r.type IN ('sibling_of','spouse_of','friend_of','knows','cooperates_with','hostile_to') AS sym FROM vr r
   JOIN idn i ON i.corpus_id=r.corpus_id AND i.entity_key = r.unit_id || '|' || r.source JOIN can a ON a.corpus_id=i.corpus_id AND a.identity=i.identity
   JOIN idn j ON j.corpus_id=r.corpus_id AND j.entity_key = r.unit_id || '|' || r.target JOIN can b ON b.corpus_id=j.corpus_id AND b.identity=j.identity
   WHERE r.status = 'kept' AND a.entity_id <> b.entity_id),
kr1 AS (SELECT * EXCLUDE (s, t, sym), CASE WHEN sym THEN least(s,t) ELSE s END AS source_id, CASE WHEN sym THEN greatest(s,t) ELSE t END AS target_id FROM kr0),
kr AS (SELECT *, sha256('["{VERSION}","' || source_id || '","' || type || '","' || target_id || '","' || polarity || '","' || statement_mode || '"]') AS relation_id,
   sha256('[' || array_to_string(list_transform(list_sort(list_zip(starts, ends)), lambda z: '[' || z[1] || ',' || z[2] || ']'), ',') || ']') AS evidence_hash FROM kr1),
gr AS (SELECT *, sha256('["' || relation_id || '","' || evidence_hash || '"]') AS group_id FROM kr)"""


SEGMENTS = """,
rg0 AS (SELECT *, least(120, (core_end-core_start)//2) AS z FROM win),
rg AS (SELECT corpus_id, unit_id, 'core' AS region, 0 AS rr, core_start AS a, core_end AS b FROM rg0 UNION ALL SELECT corpus_id, unit_id, 'before', 1, greatest(left_start, core_start - z), core_start FROM rg0
  UNION ALL SELECT corpus_id, unit_id, 'after', 2, core_end, least(right_end, core_end + z) FROM rg0),
rn AS (SELECT rg.corpus_id, unit_id, region, rr, greatest(a, c.start_char) AS s, least(b, c.end_char) AS e, c.text, c.start_char AS c0 FROM rg JOIN ck c ON c.corpus_id = rg.corpus_id AND c.start_char < b AND c.end_char > a AND a < b),
se0 AS (SELECT *, regexp_extract_all(substr(text, s-c0+1, e-s), '[^。！？!?；;\\n]+[。！？!?；;\\n]*|[。！？!?；;\\n]+') AS parts FROM rn),
se1 AS (SELECT corpus_id, unit_id, region, rr, s, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM se0),
se AS (SELECT *, s + CAST(sum(length(x)) OVER (PARTITION BY corpus_id, unit_id, region, s ORDER BY i) AS BIGINT) - length(x) AS o FROM se1),
sg0 AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((length(x)-180)/150.0)) AS BIGINT) + 1)) AS j FROM se),
sg AS (SELECT corpus_id, unit_id, region, o + j*150 AS start_char, least(o + j*150 + 180, o + length(x)) AS end_char, md5(substr(x, j*150+1, 180)) AS text_md5,
  's' || (row_number() OVER (PARTITION BY corpus_id, unit_id ORDER BY rr, o + j*150) - 1) AS span_id FROM sg0)"""


# ------------------------------------------------------------------------------------- Spark adapters
def _windows(spark, sf):
    chunks = chunk_bounds(spark, sf)
    return X.with_context(X.cores(chunks), chunks)


def _spans(spark, sf):
    return X.window_spans(_windows(spark, sf), raw_corpus(spark, sf))


def _at(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def candidate_tables(spans):
    """Entities, relations and links with anchors, from the capitalised words of each core."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}{2,}"), F.lit(0)))
    units = spans.filter("span_id = 'core'").select("corpus_id", "unit_id", names.alias("names"))
    each = units.select("corpus_id", "unit_id", "names", F.posexplode("names").alias("k", "name")).withColumn("pos", F.col("k").cast("bigint"))
    k = F.col("k")
    label = lambda n: F.concat(F.lit("e"), n)
    anchor = lambda span, quote, nth: F.struct(span.alias("span_id"), quote.alias("quote"), nth.cast("bigint").alias("occurrence"))
    core, one = F.lit("core"), F.lit(1)
    entities = each.select(
        "corpus_id", "unit_id", "pos", F.when(k % 7 == 6, "e1").otherwise(label(k)).alias("local_id"),
        _at(ENTITY_TYPES, F.length("name") % 6).alias("type"), "name",
        F.array(anchor(F.when(k % 5 == 4, "before").otherwise("core"), F.when(k % 9 == 8, F.concat("name", F.lit("x"))).otherwise(F.col("name")),
                       F.when(k % 11 == 10, 2).otherwise(1))).alias("mentions"))
    paired = each.filter("k >= 1").withColumn("sn", F.element_at("names", k)).withColumn("zn", F.when(k >= 2, F.get("names", k - 2)))
    relations = paired.select(
        "corpus_id", "unit_id", "pos", label(k - 1).alias("source"), F.when(k % 13 == 12, label(k - 1)).otherwise(label(k)).alias("target"),
        _at(list(RELATIONS), (F.length("sn") + F.length("name") + k) % 14).alias("type"),
        F.when(k % 5 == 0, "denied").otherwise("affirmed").alias("polarity"),
        F.when(k % 3 == 0, "character_claim").otherwise("narration").alias("statement_mode"),
        F.array(anchor(core, F.col("sn"), one), anchor(core, F.when(k % 8 == 7, "missing evidence").otherwise(F.col("name")), one)).alias("evidence"))
    first, second = anchor(core, F.col("zn"), one), anchor(core, F.col("name"), one)
    links = paired.filter("k >= 2").select(
        "corpus_id", "unit_id", "pos", label(k - 2).alias("source"), label(k).alias("target"),
        F.when(k % 4 == 0, F.array(first)).otherwise(F.array(first, second)).alias("evidence"))
    return entities, relations, links


class Build:
    """The stages of one build, wired once and shared by the queries below."""

    def __init__(self, spark, sf):
        self.chunks, self.corpus = stage(chunk_bounds(spark, sf), "chunks"), raw_corpus(spark, sf)
        self.windows = stage(X.with_context(X.cores(self.chunks), self.chunks), "windows")
        self.spans = stage(X.window_spans(self.windows, self.corpus), "spans")
        self.entities, self.relations, self.links = candidate_tables(self.spans)
        anchors = (X.anchor_rows(self.entities, "mentions", "entity").unionByName(X.anchor_rows(self.relations, "evidence", "relation"))
                   .unionByName(X.anchor_rows(self.links, "evidence", "link")))
        self.located = X.locate(anchors, self.spans)
        self.placed = X.attribute(self.located, self.chunks)

    @cached_property
    def placed_once(self):
        return stage(self.placed, "placed")

    @cached_property
    def valid_entities(self):
        return stage(X.validate_entities(self.entities, self.placed_once), "entities")

    def valid(self):
        e = self.valid_entities
        good = e.filter("valid")
        return (e, X.validate_relations(self.relations, good, self.placed_once, self.windows),
                X.validate_links(self.links, good, self.placed_once))

    @cached_property
    def table(self):
        return stage(R.entity_table(self.valid_entities), "entity-table")

    @cached_property
    def canonical(self):
        _, r, _ = self.valid()
        ids = stage(R.dependency_groups(self.table).withColumnRenamed("group_key", "identity"), "identities")
        heads, mapping, mentions = R.canonical_entities(self.table, ids, VERSION)
        relations = stage(R.canonical_relations(r.filter("status = 'kept'"), mapping, VERSION), "relations")
        return heads, mentions, relations


# ------------------------------------------------------------------------------------------- queries
@register("k01_extraction_windows", sql(WIN, "SELECT corpus_id, unit_id, core_start, core_end, left_start, right_end FROM win"))
def k01(spark, sf):
    return _windows(spark, sf).select("corpus_id", "unit_id", "core_start", "core_end", "left_start", "right_end")


@register("k01_window_payload_hash", sql(WIN, """SELECT corpus_id, unit_id, sha256(to_json(struct_pack(core := 'core', spans := list(struct_pack(span_id := span_id, text := text)
  ORDER BY CASE span_id WHEN 'core' THEN 0 WHEN 'before' THEN 1 ELSE 2 END)))::VARCHAR) AS input_hash FROM spn GROUP BY 1, 2"""))
def k01_hash(spark, sf):
    return X.window_payload(_spans(spark, sf)).select("corpus_id", "unit_id", "input_hash")


@register("k02_split_windows", sql(WIN, """, h AS (SELECT win.*, (core_start+core_end)//2 AS mid, substr(text, core_start+1, core_end-core_start) AS body FROM win JOIN documents ON doc_id=corpus_id WHERE core_end-core_start >= 1000),
 p AS (SELECT *, unnest(range(greatest(core_start+500, mid-100), least(core_end-500, mid+100)+1)) AS p FROM h),
 c AS (SELECT corpus_id, unit_id, arg_min(p, struct_pack(g := abs(p-mid), p := p)) AS best FROM p WHERE substr(body, p-core_start, 1) IN ('。','！','？',chr(10)) GROUP BY 1,2),
 m AS (SELECT h.corpus_id, h.unit_id, core_start, core_end, coalesce(best, mid) AS spot FROM h LEFT JOIN c USING (corpus_id, unit_id))
 SELECT corpus_id, unit_id || ':a' AS unit_id, core_start, spot AS core_end FROM m UNION ALL SELECT corpus_id, unit_id || ':b', spot, core_end FROM m
 UNION ALL SELECT corpus_id, unit_id, core_start, core_end FROM win WHERE core_end-core_start < 1000""").replace("\n, h AS", ", h AS"))
def k02(spark, sf):
    full = _windows(spark, sf).withColumn("saturated", F.lit(True))
    return X.split_windows(full, chunk_bounds(spark, sf), raw_corpus(spark, sf)).select("corpus_id", "unit_id", "core_start", "core_end")


@register("k03_evidence_segments", sql(WIN + SEGMENTS, "SELECT corpus_id, unit_id, span_id, region, start_char, end_char, text_md5 FROM sg"))
def k03(spark, sf):
    return X.segments(_windows(spark, sf), chunk_bounds(spark, sf), raw_corpus(spark, sf)).select(
        "corpus_id", "unit_id", "span_id", "region", "start_char", "end_char", F.md5("text").alias("text_md5"))


@register("k04_evidence_id_expansion", sql(CANDS + SEGMENTS, """, ids AS (SELECT DISTINCT corpus_id, unit_id, pos, unnest(['s' || (pos%4), 's' || (pos%3), 's0']) AS span_id FROM rel)
 SELECT i.corpus_id, i.unit_id, i.pos, count(sg.span_id) < count(*) AS rejected, count(*) AS parts FROM ids i LEFT JOIN sg USING (corpus_id, unit_id, span_id) GROUP BY 1, 2, 3""").replace("\n, ids AS", ", ids AS"))
def k04(spark, sf):
    b = Build(spark, sf)
    segs = X.segments(b.windows, b.chunks, b.corpus)
    cands = b.relations.select("corpus_id", "unit_id", "pos", F.array(
        F.concat(F.lit("s"), F.col("pos") % 4), F.concat(F.lit("s"), F.col("pos") % 3), F.lit("s0")).alias("evidence_ids"))
    return X.expand_compact(cands, segs).select("corpus_id", "unit_id", "pos", "rejected", F.size("evidence").alias("parts"))


@register("k05_anchor_location", sql(CANDS, "SELECT corpus_id, unit_id, kind, pos, part, start_char, end_char FROM loc"))
def k05(spark, sf):
    return Build(spark, sf).located.select("corpus_id", "unit_id", "kind", "pos", "part", "start_char", "end_char")


@register("k06_chunk_attribution", sql(CANDS, "SELECT corpus_id, unit_id, kind, pos, part, chunk_id, section_order FROM att"))
def k06(spark, sf):
    return Build(spark, sf).placed.select("corpus_id", "unit_id", "kind", "pos", "part", "chunk_id", "section_order")


@register("k07_entity_validation", sql(VALID, "SELECT corpus_id, unit_id, pos, local_id, name, valid FROM ve"))
def k07(spark, sf):
    b = Build(spark, sf)
    return X.validate_entities(b.entities, b.placed).select("corpus_id", "unit_id", "pos", "local_id", "name", "valid")


@register("k08_relation_validation", sql(VALID, "SELECT corpus_id, unit_id, pos, source, target, type, status FROM vr"))
def k08(spark, sf):
    return Build(spark, sf).valid()[1].select("corpus_id", "unit_id", "pos", "source", "target", "type", "status")


@register("k09_identity_link_validation", sql(VALID, "SELECT corpus_id, unit_id, pos, source, target, valid FROM vk"))
def k09(spark, sf):
    return Build(spark, sf).valid()[2].select("corpus_id", "unit_id", "pos", "source", "target", "valid")


@register("k10_rejection_census", sql(VALID, """SELECT corpus_id, unit_id, CAST(sum(e) AS BIGINT) AS entities, CAST(sum(r) AS BIGINT) AS relations, CAST(sum(l) AS BIGINT) AS identity_links FROM
 (SELECT corpus_id, unit_id, 1 AS e, 0 AS r, 0 AS l FROM ve WHERE NOT valid UNION ALL SELECT corpus_id, unit_id, 0, 1, 0 FROM vr WHERE status = 'rejected' UNION ALL SELECT corpus_id, unit_id, 0, 0, 1 FROM vk WHERE NOT valid) GROUP BY 1, 2"""))
def k10(spark, sf):
    return X.rejection_counts(*Build(spark, sf).valid())


@register("k11_core_density", sql(VALID, """, i AS (SELECT corpus_id, unit_id, count(DISTINCT struct_pack(t := type, n := name, a := start_char, b := end_char)) AS n FROM ok JOIN win USING (corpus_id, unit_id) WHERE start_char >= core_start AND start_char < core_end GROUP BY 1,2),
 f AS (SELECT corpus_id, unit_id, count(DISTINCT struct_pack(st := st, sn := sn, sa := sa, sb := sb, ty := type, tt := tt, tn := tn, ta := ta, tb := tb, p := polarity, m := statement_mode)) AS n FROM vr WHERE status='kept' GROUP BY 1,2),
 s AS (SELECT corpus_id, unit_id, count(DISTINCT struct_pack(st := st, x := least(sn || '|' || sa, tn || '|' || ta), y := greatest(sn || '|' || sa, tn || '|' || ta))) AS n FROM vk JOIN win w USING (corpus_id, unit_id)
   WHERE valid AND len(list_filter(starts, lambda x: x >= w.core_start AND x < w.core_end)) > 0 GROUP BY 1,2)
 SELECT w.corpus_id, w.unit_id, coalesce(i.n,0) AS entities, coalesce(f.n,0) AS relations, coalesce(s.n,0) AS identity_links,
   coalesce(i.n,0) >= 32 OR coalesce(f.n,0) >= 48 OR coalesce(s.n,0) >= 12 AS saturated
 FROM win w LEFT JOIN i USING (corpus_id, unit_id) LEFT JOIN f USING (corpus_id, unit_id) LEFT JOIN s USING (corpus_id, unit_id)""").replace("\n, i AS", ", i AS"))
def k11(spark, sf):
    b = Build(spark, sf)
    return X.density(*b.valid(), b.windows, mode="compact").select("corpus_id", "unit_id", "entities", "relations", "identity_links", "saturated")


@register("k12_mention_contexts", sql(VALID, """SELECT o.corpus_id, o.unit_id || '|' || o.local_id AS entity_key, greatest(c.start_char, o.start_char-100) AS context_start, least(c.end_char, o.end_char+150) AS context_end,
 md5(substr(c.text, greatest(c.start_char, o.start_char-100) - c.start_char + 1, least(c.end_char, o.end_char+150) - greatest(c.start_char, o.start_char-100))) AS context_md5
 FROM ok o JOIN ck c ON c.corpus_id = o.corpus_id AND c.chunk_id = o.chunk_id"""))
def k12(spark, sf):
    b = Build(spark, sf)
    good = X.validate_entities(b.entities, b.placed).filter("valid")
    mentions = good.select("corpus_id", F.concat_ws("|", "unit_id", "local_id").alias("entity_key"), F.posexplode("spans").alias("part", "s")).select(
        "corpus_id", "entity_key", "part", "s.chunk_id", "s.start_char", "s.end_char")
    return X.mention_contexts(mentions, line_chunks(spark, sf)).select("corpus_id", "entity_key", "context_start", "context_end", F.md5("context").alias("context_md5"))


OFFERED = """SELECT corpus_id, entity_key, r.key AS candidate_key, r.apart = 0 AS shared, r.d AS distance, rank, truncated FROM
 (SELECT corpus_id, entity_key, unnest(ranked[1:5]) AS r, unnest(range(1, least(len(ranked), 5) + 1)) AS rank, len(ranked) > 5 AS truncated FROM jn)"""


@register("k13_blocking_candidates", sql(ENTITIES + _judged_sql(True), OFFERED))
def k13(spark, sf):
    """Names get homonyms by planted decisions; those with more than five identities are truncated."""
    return R.offers(_judged(spark, sf)[2]).select("corpus_id", "entity_key", "candidate_key", "shared", "distance", "rank", "truncated")


@register("k13_undecided_candidates", sql(ENTITIES + _judged_sql(False), OFFERED))
def k13_undecided(spark, sf):
    """What is offered before anything is decided: one identity a name, however many mentions."""
    return R.candidates(Build(spark, sf).table).select("corpus_id", "entity_key", "candidate_key", "shared", "distance", "rank", "truncated")


@register("k14_representative_contexts", sql(ENTITIES, """, it AS (SELECT DISTINCT corpus_id || '|' || type || '|' || folded AS group_key, max(position) OVER (PARTITION BY corpus_id, type, folded) // 2 AS pp, position AS s, end_char AS e FROM en),
 rk AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY abs(s-pp), s, e) AS nr, row_number() OVER (PARTITION BY group_key ORDER BY s, e) AS fr FROM it),
 ins AS (SELECT *, max((fr=1 AND nr<=2)::INT) OVER (PARTITION BY group_key) = 1 AS inside FROM rk)
 SELECT group_key, s AS start_char, e AS end_char FROM ins WHERE nr <= 2 OR (inside AND nr <= 3) OR (NOT inside AND fr = 1)""").replace("\n, it AS", ", it AS"))
def k14(spark, sf):
    from pyspark.sql import Window
    e = Build(spark, sf).table.withColumn("group_key", F.concat_ws("|", "corpus_id", "type", "folded"))
    middle = F.floor(F.max("position").over(Window.partitionBy("group_key")) / 2)
    items = e.withColumn("_p", middle).select("group_key", F.col("_p").alias("position"), F.col("entity_key").alias("item"), F.explode("spans").alias("s")).select(
        "group_key", "position", "item", "s.start_char", "s.end_char")
    return R.representative_contexts(items).select("group_key", "start_char", "end_char")


@register("k15_dependency_groups", sql(ENTITIES, "SELECT corpus_id, entity_key, min(entity_key) OVER (PARTITION BY corpus_id, type, folded) AS group_key FROM en"))
def k15(spark, sf):
    return R.dependency_groups(Build(spark, sf).table)


@register("k15_shared_line_components", """WITH RECURSIVE m AS (SELECT DISTINCT doc_id AS id, unnest(string_split(text, chr(10))) AS k FROM documents),
 hub AS (SELECT id, min(id) OVER (PARTITION BY k) AS h FROM m), edge AS (SELECT id AS a, h AS b FROM hub WHERE id <> h UNION SELECT h, id FROM hub WHERE id <> h),
 reach AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM reach r JOIN edge e ON e.a = r.id AND r.c < e.b)
 SELECT id, min(c) AS component FROM reach GROUP BY 1""")
def k15_lines(spark, sf):
    """Documents that share any line, however far apart."""
    docs = table(spark, sf, "documents")
    return components(docs.select(F.col("doc_id").alias("id")), docs.select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("key")))


def _judged(spark, sf):
    """Planted decisions, by position: a supported merge into the name's first identity, a supported or an unsupported split, doubt,
    a merge into nobody."""
    from pyspark.sql import Window
    b = Build(spark, sf)
    e = b.table
    first = F.first("entity_key").over(Window.partitionBy("corpus_id", "type", "folded").orderBy("position", "entity_key"))
    p, none = F.col("position") % 5, F.array().cast("array<string>")
    decisions = e.select("corpus_id", "entity_key", F.when(p.isin(0, 3), "merge").when(p.isin(1, 4), "new").otherwise("ambiguous").alias("decision"),
                         F.when(p == 0, first).when(p == 3, F.lit("nobody")).alias("candidate_key"),
                         F.when(p.isin(0, 1, 3), F.array(first)).otherwise(none).alias("supporting"), F.array(first).alias("allowed"))
    return b, e, stage(R.resolve(e, decisions), "outcomes")


@register("k16_merge_decisions", sql(DECIDE, "SELECT corpus_id, entity_key, outcome, joins FROM jn"))
def k16(spark, sf):
    return _judged(spark, sf)[2].select("corpus_id", "entity_key", "outcome", "joins")


@register("k16_clusters", sql(DECIDE, "SELECT corpus_id, entity_key, cluster FROM cl"))
def k16_clusters(spark, sf):
    return R.clusters(_judged(spark, sf)[2])


def _identities(spark, sf):
    b, e, resolved = _judged(spark, sf)
    links = b.valid()[2].filter("valid").select(
        "corpus_id", F.concat_ws("|", "unit_id", "pos").alias("link_key"), F.concat_ws("|", "unit_id", "source").alias("source_key"),
        F.concat_ws("|", "unit_id", "target").alias("target_key"), "pos",
        F.transform("spans", lambda s: F.concat_ws("-", s["start_char"], s["end_char"])).alias("evidence_refs"))
    links = links.withColumn("context_refs", F.array("source_key", "target_key"))
    decisions = links.select("corpus_id", "link_key", F.when(F.col("pos") % 3 == 2, "ambiguous").otherwise("merge").alias("decision"),
                             F.when(F.col("pos") % 2 == 0, F.col("target_key")).otherwise(F.col("source_key")).alias("candidate_key"),
                             F.when(F.col("pos") % 3 == 0, F.array(F.col("evidence_refs")[0], F.col("source_key"))).otherwise(
                                 F.array(F.col("evidence_refs")[0], F.lit("foreign"))).alias("supporting"))
    return R.merge_identities(e, stage(R.clusters(resolved), "clusters"), stage(links.drop("pos"), "links"), decisions)


@register("k17_identity_links", sql(DECIDE, "SELECT corpus_id, link_key, outcome FROM lo"))
def k17(spark, sf):
    return _identities(spark, sf)[1]


@register("k17_identities", sql(DECIDE, """, eg AS (SELECT corpus_id, sc AS a, tc AS b FROM lo WHERE outcome='merged' UNION SELECT corpus_id, tc, sc FROM lo WHERE outcome='merged'),
 rch AS (SELECT DISTINCT corpus_id, cluster AS id, cluster AS c FROM cl UNION SELECT r.corpus_id, e.b, r.c FROM rch r JOIN eg e ON e.corpus_id=r.corpus_id AND e.a=r.id),
 fin AS (SELECT corpus_id, id, min(c) AS identity FROM rch GROUP BY 1, 2)
 SELECT cl.corpus_id, entity_key, identity FROM cl JOIN fin ON fin.corpus_id=cl.corpus_id AND fin.id=cl.cluster""").replace("\n, eg AS", ", eg AS"))
def k17_ids(spark, sf):
    return _identities(spark, sf)[0]


@register("k18_canonical_entities", sql(CANON, """, al AS (SELECT corpus_id, identity, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM idn GROUP BY 1,2)
 SELECT c.corpus_id, entity_id, c.type, c.name, coalesce((SELECT string_agg(DISTINCT i.name, '|' ORDER BY i.name) FROM idn i WHERE i.corpus_id=c.corpus_id AND i.identity=c.identity AND i.name <> c.name), '') AS aliases,
 first_section_order, mention_count FROM can c""").replace("\n, al AS", ", al AS"))
def k18(spark, sf):
    heads, _, _ = Build(spark, sf).canonical
    return heads.select("corpus_id", "entity_id", "type", "name", F.array_join("aliases", "|").alias("aliases"), "first_section_order", "mention_count")


@register("k19_canonical_relations", sql(CANON, "SELECT corpus_id, relation_id, source_id, target_id, type, polarity, statement_mode, count(*) AS statements FROM kr GROUP BY ALL"))
def k19(spark, sf):
    return R.relation_table(Build(spark, sf).canonical[2])


@register("k20_evidence_groups", sql(CANON, "SELECT corpus_id, relation_id, group_id, evidence_hash, first_section, last_section, count(*) AS copies FROM gr GROUP BY ALL"))
def k20(spark, sf):
    return R.evidence_groups(Build(spark, sf).canonical[2]).drop("spans")


PAYLOADS = """,
pl AS (SELECT corpus_id, unit_id, sha256(to_json(struct_pack(core := 'core', spans := list(struct_pack(span_id := span_id, text := text)
  ORDER BY CASE span_id WHEN 'core' THEN 0 WHEN 'before' THEN 1 ELSE 2 END)))::VARCHAR) AS input_hash FROM spn GROUP BY 1, 2),
un AS (SELECT corpus_id, unit_id, CASE WHEN corpus_id%7=0 THEN sha256(input_hash) ELSE input_hash END AS input_hash,
   CASE corpus_id%5 WHEN 0 THEN 'completed' WHEN 1 THEN 'extracted' WHEN 2 THEN 'split' ELSE 'pending' END AS status FROM pl WHERE corpus_id%11 <> 0)"""


@register("k21_pending_units", sql(WIN + PAYLOADS, """SELECT w.corpus_id, w.unit_id, CASE WHEN u.status IN ('completed','extracted','split') AND u.input_hash = w.input_hash
   THEN CASE WHEN u.status='extracted' THEN 'validate' ELSE 'reuse' END WHEN u.status IN ('completed','extracted','split') THEN 'checkpoint_changed' ELSE 'pending' END AS action
 FROM pl w LEFT JOIN un u USING (corpus_id, unit_id)"""))
def k21(spark, sf):
    """Stored units against the payload hashes of the windows as they are now; in every seventh corpus the text has changed."""
    w = stage(X.window_payload(_spans(spark, sf)).select("corpus_id", "unit_id", "input_hash"), "payloads")
    c = F.col("corpus_id")
    units = w.filter(c % 11 != 0).select("corpus_id", "unit_id", F.when(c % 7 == 0, F.sha2("input_hash", 256)).otherwise(F.col("input_hash")).alias("input_hash"),
                                         F.when(c % 5 == 0, "completed").when(c % 5 == 1, "extracted").when(c % 5 == 2, "split").otherwise("pending").alias("status"))
    return G.pending_units(w, units).select("corpus_id", "unit_id", "action")


PROGRESS = """un AS (SELECT user_id AS version, CASE WHEN event_id%3=0 THEN 'resolve:' ELSE 'extract:' END || event_id AS unit_id, CASE WHEN event_id%3=0 THEN 'resolve' ELSE 'extract' END AS kind,
   CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'extracted' WHEN 'click' THEN 'split' ELSE 'pending' END AS status, CAST(json_extract(props,'$.k') AS BIGINT) AS k,
   CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'interrupted' ELSE 'completed' END AS attempt, value, event_id, event_type FROM events)"""


def _progress(spark, sf):
    e = table(spark, sf, "events")
    t, i = F.col("event_type"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.when(i % 3 == 0, "resolve").otherwise("extract")
    unit = F.concat(kind, F.lit(":"), i)
    units = e.select(F.col("user_id").alias("version"), unit.alias("unit_id"), kind.alias("kind"),
                     F.when(t == "purchase", "completed").when(t == "view", "extracted").when(t == "click", "split").otherwise("pending").alias("status"))
    usage = F.when(t != "signup", F.to_json(F.struct(k.alias("input_tokens"), F.when(k % 7 != 0, k * 2).alias("output_tokens"))))
    attempts = e.select(F.col("user_id").alias("version"), unit.alias("unit_id"),
                        F.when(t == "error", "failed").when(t == "signup", "interrupted").otherwise("completed").alias("status"),
                        usage.alias("usage_json"), F.when(t != "signup", F.col("value") * 1000).alias("elapsed_ms"))
    events = e.select(F.col("user_id").alias("version"), "event_id", t.alias("code"))
    return G.build_progress(units, attempts, events)


@register("k22_build_progress", sql(PROGRESS, """SELECT version, count(*) FILTER (kind='extract' AND status='completed') AS extract_completed, count(*) FILTER (kind='extract' AND status<>'split') AS extract_total,
 count(*) FILTER (kind='extract' AND status='extracted') AS extract_cached, count(*) FILTER (kind='resolve' AND status='completed') AS resolve_completed, count(*) FILTER (kind='resolve' AND status<>'split') AS resolve_total,
 count(*) AS request_count, CAST(coalesce(sum(k) FILTER (event_type<>'signup'),0) AS BIGINT) AS reported_input_tokens, CAST(coalesce(sum(k*2) FILTER (event_type<>'signup' AND k%7<>0),0) AS BIGINT) AS reported_output_tokens,
 count(*) FILTER (event_type='signup' OR k%7=0) AS unknown_request_count, count(*) FILTER (attempt IN ('failed','interrupted')) AS failed_request_count,
 round(coalesce(sum(value) FILTER (kind='extract' AND event_type<>'signup'),0), 6) AS extracting_seconds, round(coalesce(sum(value) FILTER (kind='resolve' AND event_type<>'signup'),0), 6) AS resolving_seconds FROM un GROUP BY 1"""))
def k22(spark, sf):
    p, _ = _progress(spark, sf)
    return p.withColumn("extracting_seconds", F.round("extracting_seconds", 6)).withColumn("resolving_seconds", F.round("resolving_seconds", 6))


@register("k22_recent_events", "SELECT user_id AS version, event_id, event_type AS code, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events QUALIFY age <= 50")
def k22_recent(spark, sf):
    return _progress(spark, sf)[1]


@register("u03_pluggable_extractor", sql(WIN, """SELECT corpus_id, unit_id, len(regexp_extract_all(string_agg(text, ' ' ORDER BY CASE span_id WHEN 'core' THEN 0 WHEN 'before' THEN 1 ELSE 2 END), '\\p{Lu}\\p{Ll}{2,}')) AS found FROM spn GROUP BY 1, 2"""))
def u03(spark, sf):
    import json
    import regex

    def gazetteer(payload):
        text = " ".join(s["text"] for s in json.loads(payload)["spans"])
        return json.dumps({"found": len(regex.findall(r"\p{Lu}\p{Ll}{2,}", text))})
    out = extract_candidates(X.window_payload(_spans(spark, sf)), gazetteer)
    return out.select("corpus_id", "unit_id", F.get_json_object("payload", "$.found").cast("bigint").alias("found"))


@register("u06_unicode_fold", """SELECT name, replace(lower(name),'ß','ss') AS folded FROM (SELECT p_name AS name FROM part UNION SELECT c_name FROM customer UNION SELECT n_name FROM nation UNION SELECT s_name FROM supplier)""")
def u06(spark, sf):
    names = None
    for t, c in (("part", "p_name"), ("customer", "c_name"), ("nation", "n_name"), ("supplier", "s_name")):
        part = table(spark, sf, t).select(F.col(c).alias("name"))
        names = part if names is None else names.union(part)
    return names.distinct().withColumn("folded", fold_name(F.col("name")))


# ------------------------------------------------------------------------------- ingest and storage
def _payloads(b):
    """The candidate tables as one JSON batch per unit, with planted faults by unit."""
    def packed(df, name, cols):
        return df.groupBy("corpus_id", "unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", *cols))),
                                                                    lambda x: F.struct(*[x[c].alias(c) for c in cols])).alias(name))
    e = packed(b.entities, "entities", ["local_id", "type", "name", "mentions"])
    r = packed(b.relations, "relations", ["source", "target", "type", "polarity", "statement_mode", "evidence"])
    rows = e.join(r, ["corpus_id", "unit_id"], "left")
    text = F.to_json(F.struct("entities", "relations"))
    c = F.col("corpus_id") % 10
    broken = (F.when(c == 1, F.expr("left(text, length(text) - 3)")).when(c == 2, F.replace("text", F.lit('"local_id"'), F.lit('"localId"')))
              .when(c == 3, F.replace("text", F.lit('"occurrence":1'), F.lit('"occurrence":0')))
              .when(c == 4, F.replace("text", F.lit('"quote"'), F.lit('"text":"","quote"'))).otherwise(F.col("text")))
    return rows.withColumn("text", text).select("corpus_id", "unit_id", broken.alias("payload"))


@register("s07_candidate_ingest", sql(CANDS, """SELECT corpus_id, unit_id, count(*) AS entities, NULL AS reason FROM ent WHERE corpus_id%10 NOT IN (1,2,3,4) GROUP BY 1,2
 UNION ALL SELECT DISTINCT corpus_id, unit_id, NULL::BIGINT, CASE corpus_id%10 WHEN 1 THEN 'not_json' WHEN 3 THEN 'invalid_value' ELSE 'unknown_field' END FROM ent WHERE corpus_id%10 IN (1,2,3,4)"""))
def s07(spark, sf):
    entities, _, _, rejects = ingest_candidates(_payloads(Build(spark, sf)))
    good = entities.groupBy("corpus_id", "unit_id").agg(F.count("*").alias("entities")).withColumn("reason", F.lit(None).cast("string"))
    return good.unionByName(rejects.withColumn("entities", F.lit(None).cast("bigint")).select("corpus_id", "unit_id", "entities", "reason"))


def _tables(spark, sf):
    heads, mentions, rel_rows = Build(spark, sf).canonical
    return G.graph_tables(heads, mentions, R.relation_table(rel_rows), R.evidence_groups(rel_rows))


@register("s09_materialize_graph", sql(CANON, """SELECT name, n, n AS stored FROM (SELECT 'entities' AS name, count(*) AS n FROM can
 UNION ALL SELECT 'aliases', (SELECT count(*) FROM (SELECT DISTINCT corpus_id, identity, folded FROM idn))
 UNION ALL SELECT 'mentions', count(*) FROM (SELECT DISTINCT corpus_id, position, end_char, type FROM ms)
 UNION ALL SELECT 'relations', count(DISTINCT (corpus_id, relation_id)) FROM kr UNION ALL SELECT 'evidence_groups', count(DISTINCT (corpus_id, group_id)) FROM gr
 UNION ALL SELECT 'evidence_spans', 2 * count(DISTINCT (corpus_id, group_id)) FROM gr)"""))
def s09(spark, sf):
    path = scratch_path(spark, "graph")
    G.materialize_graph(_tables(spark, sf), path, VERSION)
    tables = G.read_graph(spark, path, VERSION, verify=True)
    counted = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])
    # the stored counts beside the rows that a reader gets
    return counted.join(G.version_counts(spark, path).select(F.col("table").alias("name"), F.col("rows").alias("stored")), "name")


@register("s11_fingerprint", sql(CHUNKS, """, m AS (SELECT corpus_id, sha256('[' || string_agg('["' || chunk_id || '","' || section_id || '",' || start_char || ',' || end_char || ']', ',' ORDER BY chunk_order) || ']') AS mapping FROM ck GROUP BY 1),
 s AS (SELECT corpus_id, '{"mapping":"' || mapping || '","parser":"1","source_hash":"' || sha256(d.text) || '"}' AS source_identity FROM m JOIN documents d ON d.doc_id = corpus_id)
 SELECT corpus_id, source_identity, sha256('{"model":"m1","rules":"3","source":"' || replace(source_identity, '"', '\\"') || '"}') AS fingerprint FROM s""").replace("\n, m AS", ", m AS"))
def s11(spark, sf):
    return G.fingerprint(raw_corpus(spark, sf), line_chunks(spark, sf), {"rules": "3", "model": "m1", "parser": "1"})
