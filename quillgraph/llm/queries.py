"""One registered query per training-data operator, the pipeline, and the SQL of those that SQL can express."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import (decontaminate, fill_middle, language_id, licenses, mixing, near_dedup, pitman_yor, quality, secrets, token_counts, url_rules,
                            vector_codes, warc)

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[k] || ' ' || w[k + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS k FROM d) UNION SELECT doc_id, w[1] FROM d WHERE len(w) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, ways.b FROM r JOIN ways ON r.b = ways.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_rules.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                       ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT row_number() OVER () AS i, page_id,
             translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
             translate(coalesce(regexp_extract(url, '://((?s:.*))$', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS rest FROM pages),
f AS (SELECT p.i, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.i ORDER BY length(r.host || r.path) DESC, r.host || r.path) AS k
      FROM p JOIN r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN regexp_matches(p.rest, '(^|[^a-z0-9])(casino-[^ ]*\.|cheap-pills\.|adult-[^ ]*\.|poker-[^ ]*\.)')
                                  OR regexp_matches(p.rest, '\.exe([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f ON p.i = f.i AND f.k = 1"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), *token_counts.sentencepiece_vocabulary())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("pieces").select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s AS (SELECT source, sum(size) AS ss, (ARRAY[3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS w FROM d GROUP BY source),
l AS (SELECT *, 2.0 * ss / w AS soon, sum(ss) OVER () * 1.5 AS goal FROM s),
v AS (SELECT *, (goal - (SELECT coalesce(sum(2.0 * b.ss), 0) FROM l AS b WHERE b.soon < a.soon))
             / (SELECT sum(b.w) FROM l AS b WHERE b.soon >= a.soon) AS level FROM l AS a),
t AS (SELECT source, ss, least(2.0 * ss, w * (SELECT min_by(level, soon) FROM v WHERE soon > level))::DOUBLE AS target FROM v),
p AS (SELECT d.*, ss, target, sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS x
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, ss::BIGINT AS source_size, target,
       (least(greatest(floor(target) - x, 0), size) + least(greatest(floor(target) - ss - x, 0), size))::BIGINT AS taken FROM p"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", F.col("_repeated").alias("n_repeat_words"),
                         F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT i, k, array_to_string(w[k:k + 7], ' ') AS g FROM (SELECT i, w, unnest(range(1, len(w) - 6)) AS k FROM d)),
twin AS (SELECT i, k FROM (SELECT i, k, count(*) OVER (PARTITION BY i, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT i, count(DISTINCT p) AS n FROM (SELECT i, unnest(range(k, k + 8)) AS p FROM twin) GROUP BY i),
m AS (SELECT d.i, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(array_to_string(w, '')) - length(regexp_replace(array_to_string(w, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines,
             length(array_to_string(w, '')) - length(regexp_replace(array_to_string(w, ''), '\p{{Lu}}', '', 'g')) AS n_upper
      FROM d LEFT JOIN rep ON d.i = rep.i),
s AS (SELECT i, lang, source, e.k, e.v, e.slack FROM (SELECT i, lang, source, unnest([
        {{'k': 'word_length', 'v': word_chars / n_words, 'slack': 0.5}}, {{'k': 'symbol_share', 'v': n_symbols / n_words, 'slack': 0.1}},
        {{'k': 'upper_share', 'v': n_upper / word_chars, 'slack': 0.1}}, {{'k': 'dup_line_share', 'v': n_dup_lines / n_lines, 'slack': 0.35}}]) AS e
      FROM m WHERE n_words > 0)),
b AS (SELECT *, CASE WHEN v <= 0 THEN -100000 ELSE ceil(ln(v) / {quality.math.log(quality.GAMMA)!r})::INT END AS bin FROM s),
lv AS (SELECT 0 AS level, lang, source, k, bin, slack, count(*) AS n FROM b GROUP BY ALL
       UNION ALL SELECT 1, lang, NULL, k, bin, slack, count(*) FROM b GROUP BY ALL
       UNION ALL SELECT 2, NULL, NULL, k, bin, slack, count(*) FROM b GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, k ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, k) AS total FROM lv),
q AS (SELECT level, lang, source, k, max(slack) AS slack, max(total) AS total,
             min(bin) FILTER (upto >= 0.25 * total) AS b1, min(bin) FILTER (upto >= 0.75 * total) AS b3 FROM c GROUP BY level, lang, source, k),
f AS (SELECT level, lang, source, k, total, slack, CASE WHEN b1 = -100000 THEN 0 ELSE 2 * power({quality.GAMMA!r}, b1) / {quality.GAMMA + 1!r} END AS q1,
             CASE WHEN b3 = -100000 THEN 0 ELSE 2 * power({quality.GAMMA!r}, b3) / {quality.GAMMA + 1!r} END AS q3 FROM q),
u AS (SELECT s.i, bool_or(s.v < x.q1 - 6 * (x.q3 - x.q1) - x.slack OR s.v > x.q3 + 6 * (x.q3 - x.q1) + x.slack) AS outside
      FROM s JOIN f AS x ON s.k = x.k
      JOIN f AS own ON own.level = 0 AND own.k = s.k AND own.lang IS NOT DISTINCT FROM s.lang AND own.source IS NOT DISTINCT FROM s.source
      JOIN f AS bl ON bl.level = 1 AND bl.k = s.k AND bl.lang IS NOT DISTINCT FROM s.lang
      WHERE (own.total >= 100 AND x.level = 0 AND x.lang IS NOT DISTINCT FROM s.lang AND x.source IS NOT DISTINCT FROM s.source)
         OR (own.total < 100 AND bl.total >= 100 AND x.level = 1 AND x.lang IS NOT DISTINCT FROM s.lang)
         OR (own.total < 100 AND bl.total < 100 AND x.level = 2)
      GROUP BY s.i),
v AS (SELECT m.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce(outside, false) AS outside FROM m LEFT JOIN u ON m.i = u.i)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT outside AS kept FROM v"""


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model, limits = language_id.fit(docs.filter(~F.coalesce(held_out, F.lit(False))))
    return language_id.identify(docs, model, limits).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                        F.sha2(secrets.listed(F.col("_base")), 256).alias("base_sha256"), secrets.listed(F.col("_spans")).alias("spans"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        "base_labels", "labels", "score")


def _listed(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


# The rule without an index: every place of every template against every word.
_TEMPLATES = [licenses.template(*t) for t in licenses.TEMPLATES]
OP11_SQL = rf"""
WITH t(t, label, j, word, is_key, need, n_keys, m) AS (VALUES {_listed([(k, t.label, j, w, j in t.keys, t.need, len(t.keys), len(t.words)) for k, t in enumerate(_TEMPLATES) for j, w in enumerate(t.words)])}),
d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT i, unnest(w) AS word, unnest(range(0, len(w))) AS k FROM d),
n AS (SELECT i, k, word, lead(word) OVER o AS n1, lead(word, 2) OVER o AS n2 FROM p WINDOW o AS (PARTITION BY i ORDER BY k)),
b AS (SELECT i, k, CASE WHEN word = 'mit' AND n1 = 'license' THEN 'mit' WHEN word = 'apache' AND n1 = 'license' THEN 'apache'
                        WHEN word = 'general' AND n1 = 'public' AND n2 = 'license' THEN 'gpl' END AS label FROM n),
a AS (SELECT p.i, t.label, count(*) / t.m AS share FROM p JOIN t ON p.word = t.word GROUP BY p.i, t.t, t.label, t.need, t.n_keys, t.m, p.k - t.j
      HAVING count(*) >= t.need AND count(*) FILTER (t.is_key) = t.n_keys),
x AS (SELECT i, count(*) AS n, min(k) AS f, max(k) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM b WHERE label IS NOT NULL GROUP BY i),
y AS (SELECT i, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM (SELECT i, label FROM b WHERE label IS NOT NULL UNION ALL SELECT i, label FROM a) GROUP BY i),
s AS (SELECT i, max(share) AS share FROM a GROUP BY i)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(x.n, 0)::BIGINT AS n_base, x.f::BIGINT AS first_word, x.l::BIGINT AS last_word, coalesce(x.ls, '') AS base_labels,
       coalesce(y.ls, '') AS labels, CASE WHEN x.n > 0 THEN 1.0::DOUBLE ELSE coalesce(s.share, 0)::DOUBLE END AS score
FROM d LEFT JOIN x ON d.i = x.i LEFT JOIN y ON d.i = y.i LEFT JOIN s ON d.i = s.i"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                  list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), k, 8))::BIGINT) AS h FROM documents),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
                  WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p),
r AS (SELECT *, CASE form WHEN 'plain' THEN output
       WHEN 'psm' THEN substr(output, 4, strpos(output, '<S>') - 4) || substr(output, strpos(output, '<M>') + 3) || substr(output, strpos(output, '<S>') + 3, strpos(output, '<M>') - strpos(output, '<S>') - 3)
       ELSE substr(output, strpos(output, '<P>') + 3, strpos(output, '<M>') - strpos(output, '<P>') - 3) || substr(output, strpos(output, '<M>') + 3) || substr(output, 4, strpos(output, '<P>') - 4) END AS whole FROM o)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(output) AS output_sha256, sha256(whole) AS restored_sha256 FROM r"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"op1_near_duplicates": op1_near_duplicates, "op2_warc": op2_warc, "op3_decontamination": op3_decontamination, "op4_url_rules": op4_url_rules,
           "op5_token_counts": op5_token_counts, "op6_mixing": op6_mixing, "op7_quality_rules": op7_quality_rules, "op8_pitman_yor": op8_pitman_yor, "op9_language_id": op9_language_id,
           "op10_secret_scan": op10_secret_scan, "op11_license_scan": op11_license_scan, "op12_fill_in_middle": op12_fill_in_middle,
           "op13_vector_codes": op13_vector_codes, "pipeline": pipeline}
SQL = {"op1_near_duplicates": OP1_SQL, "op4_url_rules": OP4_SQL, "op6_mixing": OP6_SQL, "op7_quality_rules": OP7_SQL, "op11_license_scan": OP11_SQL,
       "op12_fill_in_middle": OP12_SQL}
