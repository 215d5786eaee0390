"""Registered queries of the retrieval family, with their SQL."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.operators import dense, lexical, search
from quillgraph.plans.adapters import (CHUNKS, LIBRARY, QUERIES as QRY, library, library_queries, library_sections,
                                       line_chunks, raw_corpus, sql, table)

QUERIES, SQL = {}, {}


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn
    return keep


def norm_sql(x):
    return f"replace(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), 'ß', 'ss')"


def tokens_sql(x, words="regexp_extract_all({n}, '[\\p{{L}}\\p{{N}}]+')"):
    n = norm_sql(x)
    both = (f"list_concat(list_filter({words.format(n=n)}, lambda w: length(w) >= 2), "
            f"flatten(list_transform(list_filter(regexp_extract_all({n}, '[\\x{{3400}}-\\x{{9fff}}A-Za-z0-9]+'), lambda r: length(r) >= 2), "
            f"lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))")
    return f"(CASE WHEN len({both}) = 0 AND length({n}) > 0 THEN [{n}] ELSE {both} END)"


def occ_sql(h, t):
    return f"((length({h}) - length(replace({h}, {t}, ''))) // length({t}))"


TERMS = f"""tq AS (SELECT *, {norm_sql('query')} AS whole FROM qry),
terms AS (SELECT query_id, corpus_id, k, list(term ORDER BY pos) AS terms FROM (
   SELECT query_id, corpus_id, k, term, min(pos) AS pos FROM (
     SELECT query_id, corpus_id, k, whole AS term, 0 AS pos FROM tq
     UNION ALL SELECT query_id, corpus_id, k, unnest(string_split(whole,' ')), generate_subscripts(string_split(whole,' '),1) FROM tq)
   GROUP BY ALL) GROUP BY ALL)"""
INDEX = LIBRARY + f""",
toks AS (SELECT corpus_id, passage_id, section_order, start_char, {tokens_sql("text || ' ' || coalesce(section_title,'')")} AS tokens FROM lib),
tk AS (SELECT corpus_id, passage_id, section_order, start_char, len(tokens) AS doc_length, unnest(tokens) AS token FROM toks),
post AS (SELECT corpus_id, passage_id, section_order, start_char, doc_length, token, count(*) AS tf FROM tk GROUP BY ALL),
size AS (SELECT corpus_id, count(*) AS n, avg(len(tokens)) AS mean_length FROM toks GROUP BY 1),
raw AS (SELECT corpus_id, token, df, n, mean_length, ln(n - df + 0.5) - ln(df + 0.5) AS raw_idf FROM
   (SELECT corpus_id, token, count(*) AS df FROM post GROUP BY 1,2) JOIN size USING (corpus_id)),
voc AS (SELECT r.*, CASE WHEN raw_idf < 0 THEN 0.25 * m.mean_idf ELSE raw_idf END AS idf FROM raw r
   JOIN (SELECT corpus_id, avg(raw_idf) AS mean_idf FROM raw GROUP BY 1) m USING (corpus_id))"""
SCORES = INDEX + "," + QRY + "," + TERMS + f""",
qtok AS (SELECT DISTINCT query_id, corpus_id, unnest({tokens_sql('query')}) AS token FROM qry),
bm AS (SELECT query_id, corpus_id, passage_id, section_order, start_char,
   sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_length / mean_length))) AS score
   FROM qtok JOIN post USING (corpus_id, token) JOIN voc USING (corpus_id, token) GROUP BY ALL),
hay AS (SELECT corpus_id, passage_id, section_order, start_char, replace(lower(text),'ß','ss') AS t, replace(lower(section_title),'ß','ss') AS ti FROM lib),
bo AS (SELECT query_id, corpus_id, passage_id, section_order, start_char,
   5.0 * ({occ_sql('t','terms[1]')} + {occ_sql('ti','terms[1]')})
   + list_sum(list_transform(CASE WHEN len(terms) > 1 THEN terms[2:] ELSE terms END, lambda x: {occ_sql('t','x')} + {occ_sql('ti','x')}))
   + 2.0 * list_sum(list_transform(terms, lambda x: {occ_sql('ti','x')})) AS score
   FROM hay JOIN terms USING (corpus_id) WHERE len(list_filter(terms, lambda x: contains(t || ti, x))) > 0),
lex AS (SELECT query_id, corpus_id, passage_id, section_order, start_char, sum(score) AS score FROM
   (SELECT * FROM bm UNION ALL SELECT * FROM bo) GROUP BY ALL)"""
SCOPE = """, sect AS (SELECT source AS corpus_id, CAST(doc_id AS VARCHAR) AS section_id, doc_id AS section_order FROM documents),
scoped AS (SELECT q.*, a.section_order AS scope_from, b.section_order AS scope_to,
   CASE WHEN start_section_id IS NOT NULL AND a.section_order IS NULL THEN 'unknown_start_section'
        WHEN end_section_id IS NOT NULL AND b.section_order IS NULL THEN 'unknown_end_section'
        WHEN a.section_order > b.section_order THEN 'reversed_range' END AS scope_error
   FROM qry q LEFT JOIN sect a ON a.corpus_id = q.corpus_id AND a.section_id = q.start_section_id
   LEFT JOIN sect b ON b.corpus_id = q.corpus_id AND b.section_id = q.end_section_id)"""
RANKED = SCORES + SCOPE + """,
ranked AS (SELECT l.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, start_char, passage_id) AS rank FROM lex l
   JOIN scoped s USING (query_id, corpus_id) WHERE scope_error IS NULL AND (scope_from IS NULL OR section_order >= scope_from)
   AND (scope_to IS NULL OR section_order <= scope_to) QUALIFY rank <= 30)"""


def flagship(spark, sf):
    q = library_queries(spark, sf)
    index = lexical.build_index(library(spark, sf), wanted=lexical.query_tokens(q))
    return lexical.lexical_ranking(lexical.bm25(q, index), limit=10).select(
        "query_id", "corpus_id", "passage_id", "rank", F.round("score", 6).alias("score"))


@register("r01_query_terms", sql(QRY, TERMS, "SELECT query_id, array_to_string(terms, '|') AS terms, len(terms) AS n FROM terms"))
def r01(spark, sf):
    return lexical.query_terms(library_queries(spark, sf)).select(
        "query_id", F.array_join("terms", "|").alias("terms"), F.size("terms").alias("n"))


@register("r02_tokens", sql(LIBRARY, f"SELECT passage_id, len(t) AS n, len(list_distinct(t)) AS distinct_n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT passage_id, {tokens_sql('text')} AS t FROM lib)"))
def r02(spark, sf):
    t = lexical.with_tokens(library(spark, sf), F.col("text"), "t")
    return t.select("passage_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("distinct_n"),
                    F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@register("r03_inverted_index", sql(INDEX, """SELECT v.corpus_id, v.token, v.df, round(v.idf, 6) AS idf, p.total_tf, p.max_tf FROM voc v
 JOIN (SELECT corpus_id, token, sum(tf) AS total_tf, max(tf) AS max_tf FROM post GROUP BY 1,2) p USING (corpus_id, token)"""))
def r03(spark, sf):
    index = lexical.build_index(library(spark, sf))
    per_token = index.postings.groupBy("corpus_id", "token").agg(F.sum("tf").alias("total_tf"), F.max("tf").alias("max_tf"))
    return index.vocabulary.join(per_token, ["corpus_id", "token"]).select(
        "corpus_id", "token", "df", F.round("idf", 6).alias("idf"), "total_tf", "max_tf")


@register("r04_bm25", sql(SCORES, "SELECT query_id, passage_id, round(score, 6) AS score FROM bm"))
def r04(spark, sf):
    q = library_queries(spark, sf)
    index = lexical.build_index(library(spark, sf), wanted=lexical.query_tokens(q))
    return lexical.bm25(q, index).select("query_id", "passage_id", F.round("score", 6).alias("score"))


@register("r05_phrase_title_boosts", sql(SCORES, "SELECT query_id, passage_id, CAST(score AS DOUBLE) AS score FROM bo"))
def r05(spark, sf):
    return lexical.boosts(library_queries(spark, sf), library(spark, sf)).select("query_id", "passage_id", "score")


@register("r05_boosts_through_runs", sql(SCORES, "SELECT query_id, passage_id, CAST(score AS DOUBLE) AS score FROM bo"))
def r05_runs(spark, sf):
    """The way of large batches, whatever the size of this one."""
    return lexical.boosts(library_queries(spark, sf), library(spark, sf), scanned=0).select("query_id", "passage_id", "score")


def _scoped(spark, sf):
    return lexical.section_scope(library_queries(spark, sf), library_sections(spark, sf))


def _lexical(spark, sf):
    scoped = _scoped(spark, sf)
    return lexical.lexical_ranking(lexical.lexical_scores(scoped, library(spark, sf)), scoped)


@register("r06_lexical_topk", sql(RANKED, "SELECT query_id, passage_id, rank, round(score, 6) AS score FROM ranked"))
def r06(spark, sf):
    return _lexical(spark, sf).select("query_id", "passage_id", "rank", F.round("score", 6).alias("score"))


@register("r07_section_scope", sql(QRY.replace("CASE WHEN item_id%3=1 THEN CAST(item_id AS VARCHAR) END", "CASE item_id%4 WHEN 0 THEN CAST(item_id AS VARCHAR) WHEN 1 THEN CAST(item_id+100 AS VARCHAR) WHEN 2 THEN 'none' END").replace(
    "CASE WHEN item_id%4=1 THEN CAST(item_id+100 AS VARCHAR) END", "CASE WHEN item_id%5<>0 THEN CAST(item_id+40 AS VARCHAR) END") + SCOPE,
    "SELECT query_id, scope_from, scope_to, scope_error FROM scoped"))
def r07(spark, sf):
    i = F.col("query_id")
    q = library_queries(spark, sf).withColumn("start_section_id", F.when(i % 4 == 0, i.cast("string")).when(
        i % 4 == 1, (i + 100).cast("string")).when(i % 4 == 2, "none")).withColumn(
        "end_section_id", F.when(i % 5 != 0, (i + 40).cast("string")))
    return lexical.section_scope(q, library_sections(spark, sf)).select("query_id", "scope_from", "scope_to", "scope_error")


# ------------------------------------------------------------------------------------------------ vectors
# Passages of the vector library are the documents that have a vector; the label is the section.
VEC = """vl AS (SELECT d.source AS corpus_id, e.vec_id AS passage_id, e.vec_id//2 AS parent_chunk_id, CAST(e.label AS VARCHAR) AS section_id, CAST(e.label AS BIGINT) AS section_order,
   d.lang || ' ' || d.source AS section_title, e.vec_id AS start_char, d.text, list_transform(e.embedding, lambda x: x::DOUBLE) AS embedding
   FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
unit AS (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x*x))) AS norm FROM vl),
uv AS (SELECT * EXCLUDE (embedding, norm), list_transform(embedding, lambda x: x/norm) AS u FROM unit)"""
VQ = """, vq AS (SELECT corpus_id, row_number() OVER (ORDER BY corpus_id) AS rn, arg_min(passage_id, passage_id) AS query_id, arg_min(u, passage_id) AS vector,
   arg_min(text, passage_id) AS query, 8 AS k FROM uv GROUP BY 1)"""


def vector_library(spark, sf):
    docs = table(spark, sf, "documents")
    return table(spark, sf, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id")).select(
        F.col("source").alias("corpus_id"), F.col("vec_id").alias("passage_id"), F.floor(F.col("vec_id") / 2).alias("parent_chunk_id"),
        F.col("label").cast("string").alias("section_id"), F.col("label").cast("bigint").alias("section_order"),
        F.concat_ws(" ", "lang", "source").alias("section_title"), F.col("vec_id").alias("start_char"),
        F.lit(1).cast("bigint").alias("start_line"), F.lit(1).cast("bigint").alias("end_line"), "text", "embedding")


def vector_queries(spark, sf):
    """One query per corpus: the whole text and the vector of its first passage."""
    lib = dense.normalize_vectors(vector_library(spark, sf))
    null = F.lit(None).cast("bigint")
    return lib.groupBy("corpus_id").agg(
        F.min("passage_id").alias("query_id"), F.min_by("embedding", "passage_id").alias("vector"),
        F.min_by("text", "passage_id").alias("query")).select(
        "query_id", "corpus_id", "query", "vector", F.lit(8).cast("bigint").alias("k"), null.alias("scope_from"), null.alias("scope_to"),
        F.lit(None).cast("string").alias("scope_error"))


DENSE = VEC + VQ + """,
dn AS (SELECT q.query_id, p.corpus_id, p.passage_id, p.start_char, p.section_order, list_dot_product(p.u, q.vector) AS score,
   row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_dot_product(p.u, q.vector), 9) DESC, p.start_char, p.passage_id) AS rank
   FROM uv p JOIN vq q USING (corpus_id) QUALIFY rank <= 30)"""


@register("r08_normalize_vectors", sql(VEC, "SELECT passage_id, round(u[1], 6) AS first, round(u[64], 6) AS last, round(list_sum(list_transform(u, lambda x: x*x)), 6) AS length FROM uv"))
def r08(spark, sf):
    v = dense.normalize_vectors(vector_library(spark, sf))
    e = F.col("embedding")
    return v.select("passage_id", F.round(e[0], 6).alias("first"), F.round(e[63], 6).alias("last"),
                    F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"))


@register("r09_dense_topk", sql(DENSE, "SELECT query_id, passage_id, rank, round(score, 6) AS score FROM dn"))
def r09(spark, sf):
    v = dense.normalize_vectors(vector_library(spark, sf))
    return dense.dense_ranking(vector_queries(spark, sf), v, block_rows=16).select(
        "query_id", "passage_id", "rank", F.round("score", 6).alias("score"))


def _vsql(lib, library=VEC, queries=VQ):
    """The lexical SQL over the vector library instead of the line library."""
    body = SCORES.split("toks AS", 1)[1]
    body = body.replace(QRY + "," + TERMS, "qry AS (SELECT query_id, corpus_id, query, k FROM vq)," + TERMS)
    return library + queries + ", lib AS (SELECT * FROM uv),\ntoks AS" + body + lib


# planted: the corpora whose number is a multiple of five lack the vector of their last passage
HYBRID = _vsql("""
, dn0 AS (SELECT q.query_id, p.corpus_id, p.passage_id, p.start_char, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_dot_product(p.u, q.vector), 9) DESC, p.start_char, p.passage_id) AS rank
   FROM uv p JOIN vq q USING (corpus_id) WHERE CAST(substr(p.corpus_id, 4) AS INT) % 5 <> 0 QUALIFY rank <= 30),
lx0 AS (SELECT query_id, corpus_id, passage_id, start_char, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, start_char, passage_id) AS rank FROM lex QUALIFY rank <= 30),
fused AS (SELECT query_id, corpus_id, passage_id, start_char, sum(1.0/(60+rank)) AS fused FROM (SELECT * FROM dn0 UNION ALL SELECT * FROM lx0) GROUP BY ALL),
fr AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY round(fused,12) DESC, start_char, passage_id) AS fused_rank FROM fused f),
par AS (SELECT fr.*, parent_chunk_id, section_id FROM fr JOIN lib USING (corpus_id, passage_id) QUALIFY row_number() OVER (PARTITION BY query_id, parent_chunk_id ORDER BY fused_rank) = 1),
spread AS (SELECT *, row_number() OVER (PARTITION BY query_id, section_id ORDER BY fused_rank) > 2 AS late FROM par),
sel AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, fused_rank) AS position FROM spread QUALIFY position <= 8)""")


def _hybrid_parts(spark, sf):
    lib = vector_library(spark, sf)
    number = F.substring("corpus_id", 4, 9).cast("int")
    last = lib.groupBy("corpus_id").agg(F.max("passage_id").alias("passage_id")).filter(number % 5 == 0)
    vectors = lib.select("corpus_id", "passage_id", "section_order", "start_char", "embedding").join(
        last, ["corpus_id", "passage_id"], "left_anti")
    return lib.drop("embedding"), vectors, vector_queries(spark, sf)


@register("r10_rank_fusion", sql(HYBRID, "SELECT query_id, passage_id, fused_rank, round(fused, 9) AS fused FROM fr"))
def r10(spark, sf):
    lib, vectors, q = _hybrid_parts(spark, sf)
    able = dense.validate_vectors(vectors, lib).filter("usable").select("corpus_id")
    near = dense.dense_ranking(q.join(able, "corpus_id"), dense.normalize_vectors(vectors))
    words = lexical.lexical_ranking(lexical.lexical_scores(q, lib))
    return search.rrf(words, near).select("query_id", "passage_id", "fused_rank", F.round("fused", 9).alias("fused"))


@register("r11_section_diversity", sql(HYBRID, "SELECT query_id, position, passage_id, parent_chunk_id, section_id FROM sel"))
def r11(spark, sf):
    hits, _ = _hybrid(spark, sf)
    return hits.select("query_id", "position", "passage_id", F.col("chunk_id").alias("parent_chunk_id"), "section_id")


def _hybrid(spark, sf):
    lib, vectors, q = _hybrid_parts(spark, sf)
    return search.hybrid_search(q, lib, vectors)


HITS = """, h AS (SELECT s.*, l.text, l.section_title, t.terms, list_filter(t.terms, lambda x: contains(replace(lower(l.text || ' ' || l.section_title),'ß','ss'), x)) AS matched,
   regexp_replace(l.text, '^\\s+|\\s+$', '', 'g') AS body FROM sel s JOIN lib l USING (corpus_id, passage_id) JOIN terms t USING (query_id)),
 p AS (SELECT *, list_min(list_filter(list_transform(CASE WHEN len(matched)>0 THEN matched ELSE terms END, lambda x: strpos(replace(lower(body),'ß','ss'), x) - 1), lambda v: v >= 0)) AS first FROM h)
 SELECT query_id, position, parent_chunk_id AS chunk_id, section_title, round(fused*1000, 6) AS score, array_to_string(matched, '|') AS matched_terms,
   md5(CASE WHEN length(body) <= 600 THEN body ELSE regexp_replace(substr(body, greatest(0, coalesce(first,0)-120)::BIGINT + 1, 600), '^\\s+|\\s+$', '', 'g') END) AS snippet_md5 FROM p"""


@register("r12_hits", sql(HYBRID, HITS))
def r12(spark, sf):
    hits, _ = _hybrid(spark, sf)
    return hits.select("query_id", "position", "chunk_id", "section_title", "score", F.array_join("matched_terms", "|").alias("matched_terms"),
                       F.md5("snippet").alias("snippet_md5"))


# Every document is a passage of its source here, with or without a vector; benchmark items ask.
WHOLE = VEC.replace("FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id", "FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id").replace(
    "e.vec_id//2", "d.doc_id//2").replace("e.vec_id AS", "d.doc_id AS").replace("e.label", "coalesce(e.label, d.doc_id % 10)")
WHOLE_QUERIES = ", vq AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS corpus_id, text AS query, 8 AS k FROM benchmark)"
USABLE = "(SELECT corpus_id FROM vl GROUP BY 1 HAVING count(*) = count(embedding))"


def _whole(spark, sf):
    docs, null = table(spark, sf, "documents"), F.lit(None).cast("bigint")
    label = F.coalesce("label", F.col("doc_id") % 10)
    lib = docs.join(table(spark, sf, "embeddings"), F.col("vec_id") == F.col("doc_id"), "left").select(
        F.col("source").alias("corpus_id"), F.col("doc_id").alias("passage_id"), F.floor(F.col("doc_id") / 2).alias("parent_chunk_id"),
        label.cast("string").alias("section_id"), label.cast("bigint").alias("section_order"),
        F.concat_ws(" ", "lang", "source").alias("section_title"), F.col("doc_id").alias("start_char"),
        F.lit(1).cast("bigint").alias("start_line"), F.lit(1).cast("bigint").alias("end_line"), "text", "embedding")
    asked = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("corpus_id"), F.col("text").alias("query"),
        F.lit(None).cast("array<double>").alias("vector"), F.lit(8).cast("bigint").alias("k"), null.alias("scope_from"), null.alias("scope_to"),
        F.lit(None).cast("string").alias("scope_error"))
    return search.hybrid_search(asked, lib.drop("embedding"), lib.filter("embedding is not null"))


@register("r12_hits_without_vectors", sql(_vsql(""", fr AS (SELECT query_id, corpus_id, passage_id, start_char, 1.0/(60+rank) AS fused, rank AS fused_rank FROM (
   SELECT query_id, corpus_id, passage_id, start_char, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, start_char, passage_id) AS rank FROM lex QUALIFY rank <= 30)),
par AS (""" + HYBRID.split("par AS (", 1)[1], WHOLE, WHOLE_QUERIES), HITS))
def r12_whole(spark, sf):
    """Hits among all documents: a source with a document that has no vector is searched by words, that document too."""
    return _whole(spark, sf)[0].select("query_id", "position", "chunk_id", "section_title", "score", F.array_join("matched_terms", "|").alias("matched_terms"),
                                       F.md5("snippet").alias("snippet_md5"))


@register("r13_fallback_without_vectors", sql(WHOLE + WHOLE_QUERIES, f"SELECT query_id, corpus_id, 'bm25_fallback' AS code, 'count_mismatch' AS reason FROM vq WHERE corpus_id NOT IN {USABLE}"))
def r13_whole(spark, sf):
    return _whole(spark, sf)[1]


@register("r13_hybrid_fallback", sql(VEC + VQ, "SELECT query_id, corpus_id, 'bm25_fallback' AS code, 'count_mismatch' AS reason FROM vq WHERE CAST(substr(corpus_id, 4) AS INT) % 5 = 0"))
def r13(spark, sf):
    return _hybrid(spark, sf)[1]


# ----------------------------------------------------------------------------------------------- reading
@register("r14_read_context", sql(CHUNKS, """, rq AS (SELECT doc_id AS request_id, doc_id AS corpus_id, doc_id || ':' || (quality*3+toxic) AS chunk_id,
   least(greatest(doc_id%9-1,0),5) AS b, least(doc_id%7,5) AS a FROM labels),
 f AS (SELECT rq.*, ck.chunk_order AS spot FROM rq LEFT JOIN ck USING (corpus_id, chunk_id))
 SELECT f.request_id, c.chunk_order, c.chunk_id, md5(c.text) AS text_md5, NULL AS error FROM f JOIN ck c ON c.corpus_id=f.corpus_id AND c.chunk_order BETWEEN spot-b AND spot+a
 UNION ALL SELECT request_id, NULL, chunk_id, NULL, 'unknown_chunk' FROM f WHERE spot IS NULL""").replace("\n, rq AS", ", rq AS"))
def r14(spark, sf):
    d = F.col("doc_id")
    rq = table(spark, sf, "labels").select(
        d.alias("request_id"), d.cast("bigint").alias("corpus_id"), F.concat_ws(":", "doc_id", F.col("quality") * 3 + F.col("toxic")).alias("chunk_id"),
        (d % 9 - 1).alias("before"), (d % 7).alias("after"))
    return search.read_context(rq, line_chunks(spark, sf)).select(
        "request_id", "chunk_order", "chunk_id", F.md5("text").alias("text_md5"), "error")


@register("r15_read_section", sql(CHUNKS, """SELECT r.doc_id AS request_id, c.chunk_id, c.chunk_in_section FROM labels r JOIN ck c ON c.corpus_id = r.doc_id
  AND c.section_id = r.doc_id || '/' || r.quality AND c.chunk_in_section BETWEEN r.toxic AND r.toxic + least(greatest(r.doc_id%8,1),5) - 1"""))
def r15(spark, sf):
    d = F.col("doc_id")
    rq = table(spark, sf, "labels").select(
        d.alias("request_id"), d.cast("bigint").alias("corpus_id"), F.concat_ws("/", "doc_id", "quality").alias("section_id"),
        F.col("toxic").cast("bigint").alias("start_chunk"), (d % 8).alias("limit"))
    return search.read_section(rq, line_chunks(spark, sf)).select("request_id", "chunk_id", "chunk_in_section")


@register("r16_quote_verification", sql(CHUNKS, """, q AS (SELECT corpus_id, chunk_order, corpus_id || ':' || (chunk_order + CASE WHEN corpus_id%3=0 THEN 1 ELSE 0 END) AS chunk_id,
   CASE WHEN chunk_order%11=10 THEN '   ' ELSE '  ' || substr(text, 3, 50) || ' ' END AS quote FROM ck)
 SELECT q.corpus_id, q.chunk_order, coalesce(length(trim(q.quote))>0 AND contains(c.text, regexp_replace(q.quote,'^\\s+|\\s+$','','g')), false) AS valid
 FROM q LEFT JOIN ck c ON c.corpus_id = q.corpus_id AND c.chunk_id = q.chunk_id""").replace("\n, q AS", ", q AS"))
def r16(spark, sf):
    ck = line_chunks(spark, sf)
    quotes = ck.select(
        "corpus_id", "chunk_order", F.concat_ws(":", "corpus_id", F.col("chunk_order") + F.when(F.col("corpus_id") % 3 == 0, 1).otherwise(0)).alias("chunk_id"),
        F.when(F.col("chunk_order") % 11 == 10, "   ").otherwise(F.concat(F.lit("  "), F.substring("text", 3, 50), F.lit(" "))).alias("quote"))
    return search.verify_quotes(quotes, ck).select("corpus_id", "chunk_order", "valid")


TELEMETRY = """tel AS (SELECT user_id AS corpus_id, event_id AS sequence,
   CASE event_type WHEN 'view' THEN 'document' WHEN 'click' THEN 'query' WHEN 'error' THEN 'query' WHEN 'purchase' THEN 'cache_hit' ELSE CASE WHEN event_id%2=0 THEN 'fallback' ELSE 'progress' END END AS kind,
   CAST(json_extract(props,'$.k') AS BIGINT) AS k, value AS elapsed, event_type='error' AS failed,
   CASE WHEN event_type='error' THEN 'embedding_query_failed' WHEN event_type='signup' AND event_id%2=0 THEN 'bm25_fallback' END AS code FROM events)"""


def telemetry(spark, sf):
    t, even = F.col("event_type"), F.col("event_id") % 2 == 0
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("corpus_id"), F.col("event_id").alias("sequence"),
        F.when(t == "view", "document").when(t.isin("click", "error"), "query").when(t == "purchase", "cache_hit")
        .when(even, "fallback").otherwise("progress").alias("kind"),
        k.alias("texts"), (k * 100).alias("characters"), F.col("value").alias("elapsed_seconds"), (t == "error").alias("failed"),
        k.alias("completed"), (k + F.col("event_id") % 50).alias("total"),
        F.when(t == "error", "embedding_query_failed").when((t == "signup") & even, "bm25_fallback").alias("code"))


@register("r17_retrieval_counters", sql(TELEMETRY, """SELECT *, CASE WHEN coalesce(total,0)=0 THEN 100 ELSE CAST(round_even(completed*100.0/total, 0) AS BIGINT) END AS percentage FROM (
 SELECT corpus_id, count(*) FILTER (kind='document') AS document_request_count, CAST(coalesce(sum(k) FILTER (kind='document'),0) AS BIGINT) AS document_text_count,
 CAST(coalesce(sum(k*100) FILTER (kind='document'),0) AS BIGINT) AS document_input_characters, count(*) FILTER (kind='query') AS query_request_count,
 CAST(coalesce(sum(k*100) FILTER (kind='query'),0) AS BIGINT) AS query_input_characters, count(*) FILTER (kind='cache_hit') AS query_cache_hit_count,
 count(*) FILTER (kind IN ('document','query') AND failed) AS failed_request_count, count(*) FILTER (kind='fallback') AS fallback_count,
 round(arg_max(elapsed, sequence) FILTER (kind IN ('document','query')), 3) AS last_request_elapsed_seconds,
 arg_max(k, sequence) FILTER (kind='progress') AS completed, arg_max(k + sequence%50, sequence) FILTER (kind='progress') AS total FROM tel GROUP BY 1)"""))
def r17(spark, sf):
    return search.retrieval_status(telemetry(spark, sf))[0]


@register("r17_recent_events", sql(TELEMETRY, "SELECT corpus_id, sequence, code, row_number() OVER (PARTITION BY corpus_id ORDER BY sequence DESC) AS age FROM tel WHERE code IS NOT NULL QUALIFY age <= 50"))
def r17_recent(spark, sf):
    return search.retrieval_status(telemetry(spark, sf))[1].select("corpus_id", "sequence", "code", "age")


def _letters(texts):
    return [[float(t.lower().count(c)) + 1.0 for c in "aeiou"] for t in texts]


EMB = """, e0 AS (SELECT corpus_id, passage_id, list_transform(['a','e','i','o','u'], lambda c: 1.0 + length(text) - length(replace(replace(text, c, ''), upper(c), ''))) AS v FROM lib),
 e1 AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x*x))) AS n FROM e0)"""


@register("r18_embed_passages", sql(LIBRARY + EMB, "SELECT corpus_id, passage_id, round(v[1]/n, 6) AS a, round(v[5]/n, 6) AS u, 1 AS attempts FROM e1 WHERE corpus_id <> 'src3'"))
def r18(spark, sf):
    lib = library(spark, sf)
    done = lib.filter("corpus_id = 'src3'").select("corpus_id").distinct()
    out = dense.embed_passages(lib, _letters, existing=done)
    e = F.col("embedding")
    return out.select("corpus_id", "passage_id", F.round(e[0], 6).alias("a"), F.round(e[4], 6).alias("u"), "attempts")


@register("u02_pluggable_vectors", sql(LIBRARY + EMB, "SELECT corpus_id, count(*) AS n, round(avg(v[2]/n), 6) AS mean_e FROM e1 GROUP BY 1"))
def u02(spark, sf):
    return dense.embed_passages(library(spark, sf), _letters).groupBy("corpus_id").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("embedding")[1]), 6).alias("mean_e"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _by_blank(texts: pd.Series) -> pd.Series:
    return texts.str.split(" ")


@register("u04_pluggable_words", sql(LIBRARY, f"""SELECT passage_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM
 (SELECT passage_id, {tokens_sql('text', "string_split({n}, ' ')")} AS t FROM lib)"""))
def u04(spark, sf):
    t = lexical.with_tokens(library(spark, sf), F.col("text"), "t", words=_by_blank)
    return t.select("passage_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))
