"""Registered queries of the corpus-preparation family, with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions.runtime import stage
from quillgraph.operators import headings as H
from quillgraph.operators import sections as S
from quillgraph.operators.lines import line_of, line_table
from quillgraph.plans.adapters import BOOK, BOOK_LINES, CHUNKS, books, line_chunks, sql

QUERIES, SQL = {}, {}


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn
    return keep


# ------------------------------------------------------------------------------------ SQL building blocks
_ENDS = "right(normalized_text,1) IN ('，','。','；','！','？',',','.','!','?',';','：',':')"
CAND = BOOK_LINES + f""",
lc AS (SELECT *, coalesce(lag(normalized_text) OVER w,'')='' AS blank_before, coalesce(lead(normalized_text) OVER w,'')='' AS blank_after,
    coalesce(length(lead(normalized_text) OVER w),0) AS next_length, length(normalized_text) AS n
  FROM ln WINDOW w AS (PARTITION BY corpus_id ORDER BY line_no)),
cand AS (
  SELECT *, 'di_unit' AS detector, 0 AS detector_rank, CAST(regexp_extract(normalized_text,'^第 *([0-9]+) *[章节回卷部篇集幕]',1) AS BIGINT) AS number_value,
     regexp_extract(normalized_text,'^第 *[0-9]+ *([章节回卷部篇集幕])',1) AS unit, 2 AS level_hint, 5.0::DOUBLE AS local_score
   FROM lc WHERE n BETWEEN 1 AND 80 AND regexp_matches(normalized_text,'^第 *[0-9]+ *[章节回卷部篇集幕]')
  UNION ALL SELECT *, 'numeric', 1, CAST(regexp_extract(normalized_text,'([0-9]{{1,5}})',1) AS BIGINT), NULL, 2, 2.5
   FROM lc WHERE n BETWEEN 1 AND 60 AND (regexp_matches(normalized_text,'^[（(【\\[] *[0-9]{{1,5}} *[）)】\\]]')
      OR regexp_matches(normalized_text,'^[0-9]{{1,5}} *[、.．:：\\-—]') OR regexp_matches(normalized_text,'^[0-9]{{1,5}}$'))
  UNION ALL SELECT *, 'english', 3,
     coalesce(TRY_CAST(word AS BIGINT), CASE word WHEN 'one' THEN 1 WHEN 'two' THEN 2 WHEN 'three' THEN 3 WHEN 'four' THEN 4 WHEN 'five' THEN 5
       WHEN 'six' THEN 6 WHEN 'seven' THEN 7 WHEN 'eight' THEN 8 WHEN 'nine' THEN 9 WHEN 'ten' THEN 10
       WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 WHEN 'm' THEN 1000 END),
     unit, CASE unit WHEN 'chapter' THEN 2 ELSE 1 END, 5.0
   FROM (SELECT *, regexp_extract(lower(normalized_text),'^(chapter|part|book|volume) +([0-9]+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten)',2) AS word,
           regexp_extract(lower(normalized_text),'^(chapter|part|book|volume) +',1) AS unit FROM lc WHERE n BETWEEN 1 AND 80) WHERE word <> ''
  UNION ALL SELECT *, 'special', 4, NULL, NULL, 1, 4.0 FROM lc WHERE n BETWEEN 1 AND 60
     AND regexp_matches(lower(normalized_text),'^(prologue|epilogue|preface|appendix)( .*)?$')
  UNION ALL SELECT *, 'plain', 5, NULL, NULL, 2, 1.0 FROM lc WHERE n BETWEEN 2 AND 30 AND NOT {_ENDS}
     AND NOT regexp_matches(normalized_text,'^[“‘"—]') AND NOT regexp_matches(normalized_text,'[”’"]$')
     AND n - length(regexp_replace(normalized_text,'[，。；！？,.!?;：:、]','','g')) <= 1
     AND (blank_before OR blank_after) AND (blank_after OR next_length >= 50))"""
# the english branch projects two helper columns; normalise the column set
CAND = CAND.replace("FROM (SELECT *, regexp_extract(lower", "FROM (SELECT *, regexp_extract(lower").replace(
    "UNION ALL SELECT *, 'english', 3,", "UNION ALL SELECT * EXCLUDE (word, unit), 'english', 3,")
STATS = CAND + """,
gaps AS (SELECT *, start_char - lag(start_char) OVER w AS char_gap, line_no - lag(line_no) OVER w AS line_gap,
    last_value(number_value IGNORE NULLS) OVER (PARTITION BY corpus_id, detector ORDER BY start_char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM cand WINDOW w AS (PARTITION BY corpus_id, detector ORDER BY start_char)),
st AS (SELECT corpus_id, detector, count(*) AS items,
    coalesce(avg(CASE WHEN number_value IS NOT NULL AND prev IS NOT NULL THEN CAST(number_value = prev + 1 AS INT) END), 0) AS sequence_ratio,
    coalesce(median(char_gap), 0) AS median_char_gap, coalesce(median(line_gap), 0) AS median_line_gap FROM gaps GROUP BY 1, 2)"""
SCORE = STATS + f""",
sc0 AS (SELECT c.*, s.items, s.sequence_ratio, s.median_char_gap, s.median_line_gap, local_score
    + CASE WHEN blank_before AND blank_after THEN 2 WHEN blank_before OR blank_after THEN 1 ELSE 0 END
    + CASE WHEN n BETWEEN 2 AND 30 THEN 1 ELSE 0 END + CASE WHEN items >= 2 THEN 2 ELSE 0 END
    + CASE WHEN sequence_ratio >= 0.6 THEN 3 WHEN sequence_ratio >= 0.3 THEN 1 ELSE 0 END
    + CASE WHEN median_char_gap >= 300 THEN 1 ELSE 0 END
    - CASE WHEN median_line_gap > 0 AND median_line_gap <= 3 THEN 4 ELSE 0 END
    - CASE WHEN n > 60 THEN 3 ELSE 0 END - CASE WHEN {_ENDS} THEN 3 ELSE 0 END AS final_score
  FROM cand c JOIN st s USING (corpus_id, detector)),
sc AS (SELECT *, final_score >= CASE WHEN detector='plain' THEN 5.5 ELSE 4 END
    AND (detector <> 'plain' OR (items >= 3 AND median_char_gap >= 300 AND median_line_gap >= 4)) AS passes FROM sc0),
best AS (SELECT * FROM sc WHERE passes QUALIFY row_number() OVER (PARTITION BY corpus_id, line_no ORDER BY final_score DESC, detector_rank) = 1),
isl AS (SELECT *, sum(brk) OVER (PARTITION BY corpus_id ORDER BY start_char) AS island FROM
   (SELECT *, CASE WHEN start_char - lag(start_char) OVER (PARTITION BY corpus_id ORDER BY start_char) < 180 THEN 0 ELSE 1 END AS brk FROM best)),
dense AS (SELECT *, count(*) OVER (PARTITION BY corpus_id, island) >= 3 AS dense FROM isl),
acc AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY corpus_id) AS acc_n FROM dense WHERE NOT dense) WHERE acc_n >= 2)"""
SECTIONS = SCORE + """,
sec0 AS (SELECT a.corpus_id, regexp_replace(a.raw_text,'^\\s+|\\s+$','','g') AS title, detector AS title_type, level_hint, least(1.0, final_score/10) AS confidence, start_char,
    coalesce(lead(start_char) OVER (PARTITION BY a.corpus_id ORDER BY start_char), length(b.text)) AS end_char, a.end_char AS body_start
  FROM acc a JOIN book b USING (corpus_id)
  UNION ALL SELECT corpus_id, '卷首内容', 'front_matter', 0, 1.0, 0, f, 0 FROM (SELECT corpus_id, min(start_char) AS f FROM acc GROUP BY 1) JOIN book USING (corpus_id)
   WHERE regexp_matches(substr(text, 1, f), '\\S')),
sec AS (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY start_char, end_char) - 1 AS section_order,
    'section_' || lpad(CAST(row_number() OVER (PARTITION BY corpus_id ORDER BY start_char, end_char) AS VARCHAR), 4, '0') AS section_id FROM sec0)"""


def split_sql(name, src, minimum, target, maximum, overlap):
    """The boundary split as a recursive query over ``src`` (kid, text, s, e); ends in ``name`` (kid, n, a, b)."""
    def ends(pattern, kind):
        parts, hits = f"string_split_regex(win, '{pattern}')", f"regexp_extract_all(win, '{pattern}')"
        total = f"list_sum(list_transform({parts}[1:i], lambda x: length(x))) + list_sum(list_transform({hits}[1:i], lambda x: length(x)))"
        return f"list_transform(range(1, len({hits}) + 1), lambda i: struct_pack(g := abs({minimum} + {total} - {target}), k := {kind}, p := {total}))"
    choices = "list_concat(list_concat(" + ends("\\n\\s*\\n", 0) + ", " + ends("[。！？!?]\\s*", 1) + "), " + ends("\\n", 2) + ")"
    lead, bare = "length(regexp_extract({b}, '^\\s*'))", "length(regexp_replace({b}, '^\\s+|\\s+$', '', 'g'))"
    back = "strpos(reverse(substr(text, cur+2, resume-cur)), chr(10) || chr(10))"
    return f"""{name}0 AS (SELECT kid, text, s + {lead.format(b='body')} AS cur, s + {lead.format(b='body')} + {bare.format(b='body')} AS e FROM (SELECT kid, text, s, substr(text, s+1, e-s) AS body FROM {src})),
{name}r AS (SELECT kid, text, e, cur, NULL::BIGINT AS a, NULL::BIGINT AS b FROM {name}0 WHERE cur < e
  UNION ALL SELECT kid, text, e, CASE WHEN last THEN e WHEN para > cur THEN para + 2 ELSE resume END, cur + {lead.format(b='body')}, cur + {lead.format(b='body')} + {bare.format(b='body')} FROM (
    SELECT *, CASE WHEN resume < e AND {back} > 0 THEN cur + (resume-cur) - {back} ELSE -1 END AS para FROM (
      SELECT *, substr(text, cur+1, stop-cur) AS body, greatest(cur+1, stop-{overlap}) AS resume FROM (
        SELECT *, e-cur <= {maximum} AS last, CASE WHEN e-cur <= {maximum} THEN e ELSE coalesce(cur + {minimum} + best, cur + {maximum}) END AS stop FROM (
          SELECT *, CAST(list_min({choices}).p AS BIGINT) AS best FROM (SELECT *, substr(text, cur+{minimum}+1, {maximum-minimum}) AS win FROM {name}r WHERE cur < e)))))),
{name} AS (SELECT kid, row_number() OVER (PARTITION BY kid ORDER BY a, b) AS n, a, b FROM {name}r WHERE b > a)"""


WHOLE_SPLIT = BOOK + ",\nsrc AS (SELECT corpus_id AS kid, text, 0 AS s, length(text) AS e FROM book),\n" + split_sql("pc", "src", 1000, 1800, 2500, 180)
CHUNKED = SECTIONS + """,
src AS (SELECT struct_pack(c := s.corpus_id, o := s.section_order) AS kid, b.text, s.body_start AS s, s.end_char AS e FROM sec s JOIN book b USING (corpus_id)
  UNION ALL SELECT struct_pack(c := corpus_id, o := -1), text, 0, length(text) FROM book WHERE corpus_id NOT IN (SELECT corpus_id FROM acc)),
""" + split_sql("pc", "src", 1000, 1800, 2500, 180) + """,
ch0 AS (SELECT kid.c AS corpus_id, kid.o = -1 AS loose, CASE WHEN kid.o = -1 THEN n-1 ELSE kid.o END AS section_order, CASE WHEN kid.o = -1 THEN 1 ELSE n END AS k, a, b FROM pc),
ch AS (SELECT c.*, 'section_' || lpad(CAST(c.section_order+1 AS VARCHAR), 4, '0') AS section_id, 'section_' || lpad(CAST(c.section_order+1 AS VARCHAR), 4, '0') || '_chunk_' || lpad(CAST(k AS VARCHAR), 3, '0') AS chunk_id,
  row_number() OVER (PARTITION BY c.corpus_id ORDER BY c.section_order, k) - 1 AS chunk_order, substr(bk.text, a+1, b-a) AS text FROM ch0 c JOIN book bk USING (corpus_id))"""
PASSAGED = CHUNKED + ",\nsrc2 AS (SELECT struct_pack(c := corpus_id, d := chunk_id, a := a) AS kid, text, 0 AS s, length(text) AS e FROM ch),\n" + split_sql("ps", "src2", 250, 500, 700, 80)


def _lines(spark, sf):
    return line_table(books(spark, sf))


def _candidates(spark, sf):
    return H.detect_candidates(_lines(spark, sf))


def _scored(spark, sf):
    return H.score_candidates(H.detector_stats(_candidates(spark, sf)))


@register("c01_line_table", sql(BOOK, BOOK_LINES, "SELECT corpus_id, line_no, start_char, end_char, length(raw_text) AS raw_length, md5(raw_text) AS raw_md5 FROM ln"))
def c01(spark, sf):
    return _lines(spark, sf).select("corpus_id", "line_no", "start_char", "end_char",
                                    F.length("raw_text").alias("raw_length"), F.md5("raw_text").alias("raw_md5"))


@register("c02_match_normalisation", sql(BOOK, BOOK_LINES, "SELECT corpus_id, line_no, length(normalized_text) AS n, md5(normalized_text) AS text_md5 FROM ln"))
def c02(spark, sf):
    return _lines(spark, sf).select("corpus_id", "line_no", F.length("normalized_text").alias("n"),
                                    F.md5("normalized_text").alias("text_md5"))


_CCOLS = ["corpus_id", "line_no", "detector", "number_value", "unit", "level_hint", "local_score"]
_CSEL = "SELECT corpus_id, line_no, detector, number_value, unit, level_hint, local_score FROM cand WHERE detector "


@register("c03_numbered_headings", sql(BOOK, CAND, _CSEL + "IN ('di_unit','numeric','english')"))
def c03(spark, sf):
    lines = _lines(spark, sf)
    return H.detect_candidates(lines, (H.di_unit, H.numeric, H.chinese_numeric, H.english)).select(_CCOLS)


@register("c04_special_headings", sql(BOOK, CAND, _CSEL + "= 'special'"))
def c04(spark, sf):
    return H.detect_candidates(_lines(spark, sf), (H.special,)).select(_CCOLS)


@register("c05_plain_headings", sql(BOOK, CAND, _CSEL + "= 'plain'"))
def c05(spark, sf):
    return H.detect_candidates(_lines(spark, sf), (H.plain,)).select(_CCOLS)


@register("c06_sequence_ratio", sql(BOOK, STATS, "SELECT corpus_id, detector, items, round(sequence_ratio,6) AS sequence_ratio FROM st"))
def c06(spark, sf):
    return H.detector_stats(_candidates(spark, sf)).groupBy("corpus_id", "detector").agg(
        F.first("items").alias("items"), F.round(F.first("sequence_ratio"), 6).alias("sequence_ratio"))


@register("c07_median_gaps", sql(BOOK, STATS, "SELECT corpus_id, detector, median_char_gap, median_line_gap FROM st"))
def c07(spark, sf):
    return H.detector_stats(_candidates(spark, sf)).groupBy("corpus_id", "detector").agg(
        F.first("median_char_gap").alias("median_char_gap"), F.first("median_line_gap").alias("median_line_gap"))


@register("c08_heading_scores", sql(BOOK, SCORE, "SELECT corpus_id, line_no, detector, final_score, passes FROM sc"))
def c08(spark, sf):
    return _scored(spark, sf).select("corpus_id", "line_no", "detector", "final_score", "passes")


@register("c09_best_detector_per_line", sql(BOOK, SCORE, "SELECT corpus_id, line_no, detector, final_score FROM best"))
def c09(spark, sf):
    return H.best_per_line(_scored(spark, sf)).select("corpus_id", "line_no", "detector", "final_score")


@register("c10_dense_run_removal", sql(BOOK, SCORE, "SELECT corpus_id, line_no, detector FROM dense WHERE NOT dense"))
def c10(spark, sf):
    return H.drop_dense_runs(H.best_per_line(_scored(spark, sf))).select("corpus_id", "line_no", "detector")


@register("c11_structure_report", sql(BOOK, SCORE, """, r AS (SELECT b.corpus_id, coalesce(c.n,0) AS cn, coalesce(k.kept,0) AS kept, coalesce(k.dn,0) AS dn, k.ms, k.used, k.un
 FROM book b LEFT JOIN (SELECT corpus_id, count(*) AS n FROM cand GROUP BY 1) c USING (corpus_id)
 LEFT JOIN (SELECT corpus_id, count(*) FILTER (NOT dense) AS kept, count(*) FILTER (dense) AS dn, avg(least(final_score,10)) FILTER (NOT dense) AS ms,
   string_agg(DISTINCT detector, ',' ORDER BY detector) FILTER (NOT dense) AS used, count(DISTINCT detector) FILTER (NOT dense) AS un FROM dense GROUP BY 1) k USING (corpus_id))
 SELECT corpus_id, CASE WHEN kept<2 THEN 'fallback_chunks' WHEN un>1 THEN 'mixed_headings' ELSE 'detected_headings' END AS strategy,
  round(CASE WHEN kept<2 THEN 0 ELSE least(0.99, greatest(0.5, ms/10)) END, 6) AS confidence, CASE WHEN kept<2 THEN 0 ELSE kept END AS heading_count,
  CASE WHEN kept<2 THEN '' ELSE used END AS detectors_used, CASE WHEN kept<2 THEN cn ELSE cn-kept END AS rejected_count, kept<2 AS fallback_used,
  CASE WHEN dn>0 AND kept<2 THEN 'dense_candidates_filtered,too_few_headings' WHEN dn>0 THEN 'dense_candidates_filtered' WHEN kept<2 THEN 'too_few_headings' ELSE '' END AS warnings FROM r""").replace("\n, r AS", ", r AS"))
def c11(spark, sf):
    r = H.structure_report(books(spark, sf), _scored(spark, sf))
    return r.withColumn("detectors_used", F.array_join("detectors_used", ",")).withColumn(
        "warnings", F.array_join("warnings", ",")).withColumn("confidence", F.round("confidence", 6))


@register("c12_sections", sql(BOOK, SECTIONS, "SELECT corpus_id, section_order, section_id, title, title_type, level_hint, round(confidence,6) AS confidence, start_char, end_char FROM sec"))
def c12(spark, sf):
    out = S.heading_sections(books(spark, sf), H.accepted_headings(_scored(spark, sf)))
    return out.select("corpus_id", "section_order", "section_id", "title", "title_type", "level_hint",
                      F.round("confidence", 6).alias("confidence"), "start_char", "end_char")


def _chunks(spark, sf):
    return S.chunks_and_sections(books(spark, sf), H.accepted_headings(_scored(spark, sf)))


@register("c13_fallback_sections", sql(BOOK, CHUNKED, "SELECT corpus_id, section_id, a AS start_char, b AS end_char, 0.0::DOUBLE AS confidence FROM ch WHERE loose"))
def c13(spark, sf):
    _, sections = _chunks(spark, sf)
    return sections.filter(~F.col("detected")).select("corpus_id", "section_id", "start_char", "end_char", "confidence")


@register("c14_boundary_split", sql(WHOLE_SPLIT, "SELECT kid AS corpus_id, n - 1 AS piece, a AS start_char, b AS end_char FROM pc"))
def c14(spark, sf):
    from quillgraph.functions.spans import SplitSpans
    spark.udtf.register("split_spans", SplitSpans)
    books(spark, sf).createOrReplaceTempView("quill_books")
    return spark.sql("SELECT corpus_id, piece, start_char, end_char FROM quill_books, "
                     "LATERAL split_spans(text, 0, CAST(length(text) AS INT), 1000, 1800, 2500, 180)")


@register("c15_chunk_table", sql(BOOK, CHUNKED, "SELECT c.corpus_id, c.chunk_id, c.section_id, s.title AS section_title, c.chunk_order, c.a AS start_char, c.b AS end_char, md5(c.text) AS text_md5 FROM ch c LEFT JOIN sec s ON s.corpus_id = c.corpus_id AND s.section_order = c.section_order"))
def c15(spark, sf):
    chunks, _ = _chunks(spark, sf)
    return chunks.select("corpus_id", "chunk_id", "section_id", "section_title", "chunk_order", "start_char", "end_char",
                         F.md5("text").alias("text_md5"))


@register("c16_passage_table", sql(BOOK, PASSAGED, """SELECT p.kid.c AS corpus_id, p.kid.d || '_passage_' || lpad(CAST(p.n AS VARCHAR), 3, '0') AS passage_id, p.kid.d AS parent_chunk_id, p.kid.a + p.a AS start_char, p.kid.a + p.b AS end_char,
 md5(substr(c.text, p.a+1, p.b-p.a)) AS text_md5 FROM ps p JOIN ch c ON c.corpus_id = p.kid.c AND c.chunk_id = p.kid.d"""))
def c16(spark, sf):
    chunks, _ = _chunks(spark, sf)
    return S.passage_table(chunks).select("corpus_id", "passage_id", "parent_chunk_id", "start_char", "end_char",
                                          F.md5("text").alias("text_md5"))


@register("c17_char_to_line", sql(BOOK, SECTIONS, """SELECT s.corpus_id, s.section_order, a.line_no AS start_line, b.line_no AS end_line FROM sec s
 ASOF JOIN ln a ON s.corpus_id = a.corpus_id AND s.start_char >= a.start_char
 ASOF JOIN ln b ON s.corpus_id = b.corpus_id AND greatest(s.start_char, s.end_char - 1) >= b.start_char"""))
def c17(spark, sf):
    lines = _lines(spark, sf)
    sections = S.heading_sections(books(spark, sf), H.headings_of(lines)).select(
        "corpus_id", "section_order", "start_char", F.greatest("start_char", F.col("end_char") - 1).alias("last_char"))
    out = line_of(line_of(sections, lines, "start_char", "start_line"), lines, "last_char", "end_line")
    return out.select("corpus_id", "section_order", "start_line", "end_line")


@register("c18_structure_summary", sql(BOOK, CHUNKED, """SELECT b.corpus_id, length(b.text) AS character_count, coalesce(l.n, 0) AS line_count, coalesce(s.n, 0) AS section_count, coalesce(c.n, 0) AS chunk_count FROM book b
 LEFT JOIN (SELECT corpus_id, count(*) AS n FROM ln GROUP BY 1) l USING (corpus_id)
 LEFT JOIN (SELECT corpus_id, count(*) AS n FROM (SELECT corpus_id, section_id FROM sec UNION ALL SELECT corpus_id, section_id FROM ch WHERE loose) GROUP BY 1) s USING (corpus_id)
 LEFT JOIN (SELECT corpus_id, count(*) AS n FROM ch GROUP BY 1) c USING (corpus_id)"""))
def c18(spark, sf):
    texts = stage(books(spark, sf), "books")
    chunks, sections = S.chunks_and_sections(texts, H.accepted_headings(_scored(spark, sf)))
    chunks = stage(chunks, "chunks")
    return S.structure_summary(texts, line_table(texts), sections, chunks)


@register("c18_section_page", sql(CHUNKS, """SELECT corpus_id, section_id, section_order, chunk_count, total FROM
 (SELECT corpus_id, section_id, section_order, count(*) AS chunk_count, count(*) OVER (PARTITION BY corpus_id) AS total FROM ck GROUP BY 1,2,3)
 WHERE section_order >= corpus_id%3 AND section_order < corpus_id%3 + 1 + corpus_id%20"""))
def c18_page(spark, sf):
    chunks = line_chunks(spark, sf)
    sections = chunks.select("corpus_id", "section_id", "section_order").distinct()
    asked = sections.select("corpus_id").distinct().select(
        "corpus_id", (F.col("corpus_id") % 3).alias("offset"), (F.col("corpus_id") % 20 + 1).alias("limit"))
    return S.section_page(asked, sections, chunks).select("corpus_id", "section_id", "section_order", "chunk_count", "total")


@register("u01_pluggable_detector", sql(BOOK, CAND, """SELECT corpus_id, line_no, detector, number_value, unit, level_hint, local_score FROM cand
 UNION ALL SELECT corpus_id, line_no, 'shouted', NULL, NULL, 2, 3.0 FROM lc WHERE right(normalized_text,1)='!'"""))
def u01(spark, sf):
    def shouted():
        return H._found(F.col("normalized_text").endswith("!"), "shouted", 3.0, 2)
    return H.detect_candidates(_lines(spark, sf), H.DEFAULT_DETECTORS + (shouted,)).select(_CCOLS)


@register("u05_split_spans_udtf", sql(CHUNKS, "src AS (SELECT chunk_id AS kid, text, 0 AS s, length(text) AS e FROM ck)", split_sql("pc", "src", 250, 500, 700, 80), "SELECT kid AS chunk_id, n - 1 AS piece, a AS piece_start, b AS piece_end FROM pc"))
def u05(spark, sf):
    from quillgraph.functions.spans import SplitSpans
    spark.udtf.register("split_spans", SplitSpans)
    line_chunks(spark, sf).createOrReplaceTempView("quill_line_chunks")
    return spark.sql("SELECT chunk_id, piece, s.start_char AS piece_start, s.end_char AS piece_end FROM quill_line_chunks c, "
                     "LATERAL split_spans(text, 0, CAST(length(text) AS INT), 250, 500, 700, 80) s")


@register("u05_split_sections_udtf", sql(BOOK, SECTIONS, """src AS (SELECT struct_pack(c := s.corpus_id, o := s.section_order) AS kid, b.text, s.body_start AS s, s.end_char AS e FROM sec s JOIN book b USING (corpus_id))""",
    split_sql("pc", "src", 250, 500, 700, 80), "SELECT kid.c AS corpus_id, kid.o AS section_order, n - 1 AS piece, a AS start_char, b AS end_char FROM pc"))
def u05_sections(spark, sf):
    """All sections of a text in one call: the text is passed and searched once."""
    from quillgraph.functions.spans import SplitSections
    spark.udtf.register("split_sections", SplitSections)
    texts = books(spark, sf)
    sections = S.heading_sections(texts, H.accepted_headings(_scored(spark, sf)))
    listed = sections.groupBy("corpus_id").agg(F.array_sort(F.collect_list(F.struct("section_order", "body_start", "end_char"))).alias("s"))
    texts.join(listed, "corpus_id").select("corpus_id", "text", F.col("s.section_order").alias("orders"), F.transform("s", lambda x: x["body_start"].cast("int")).alias("starts"),
                                           F.transform("s", lambda x: x["end_char"].cast("int")).alias("ends")).createOrReplaceTempView("quill_sectioned")
    return spark.sql("SELECT corpus_id, orders[span] AS section_order, piece, start_char, end_char FROM quill_sectioned, LATERAL split_sections(text, starts, ends, 250, 500, 700, 80)")
