"""Driver tables in the shape the operators take, and the same derivations as SQL for the checks.

Three views of ``documents``:

* books     one corpus per document; heading lines are set before every fourth line
* lines     one corpus per document; every line is a chunk, four lines make a section
* library   one corpus per source; every line is a passage, three lines share a parent chunk
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def books(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")

    def with_heading(line, i):
        k = (F.floor(i / 4) + 1).cast("string")
        kind = F.col("doc_id") % 5
        heading = (F.when(kind == 0, F.concat(F.lit("\nChapter "), k, F.lit("\n\n")))
                   .when(kind == 1, F.concat(F.lit("\n第"), k, F.lit("章 卷\n\n")))
                   .when(kind == 2, F.concat(F.lit("\n("), k, F.lit(")\n")))
                   .when(kind == 3, F.concat(F.lit("\nPart "), k, F.lit(" - opening\n\n")))
                   .when(k == "1", F.lit("\nPrologue\n\n"))
                   .otherwise(F.concat(F.lit("\nThe turning point "), k, F.lit("\n\n"))))
        return F.when(i % 4 == 1, F.concat(heading, line)).otherwise(line)

    text = F.array_join(F.transform(F.split("text", "\n"), with_heading), "\n")
    return docs.select(F.col("doc_id").cast("bigint").alias("corpus_id"), text.alias("text"),
                       F.concat(F.lit("book-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "source")


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the raw documents with spans that leave the terminator out; prefix lengths come from a window."""
    from pyspark.sql import Window
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text").repartition("doc_id")
    rows = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + F.lit(1).cast("bigint")).over(before), F.lit(0).cast("bigint"))
    return rows.select("doc_id", "source", "lang", F.col("line").cast("bigint").alias("line"), start.alias("start_char"),
                       (start + F.length("text")).alias("end_char"), "text")


def line_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_lines`` without the texts: lengths are taken where a text is read, and only they are placed by document."""
    from pyspark.sql import Window
    lengths = F.transform(F.split("text", "\n"), lambda x: F.length(x))
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(lengths).alias("line", "n"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n") + F.lit(1).cast("bigint")).over(before), F.lit(0).cast("bigint"))
    return rows.select("doc_id", F.col("line").cast("bigint").alias("line"), start.alias("start_char"), (start + F.col("n")).alias("end_char"))


def _as_chunks(lines: DataFrame) -> DataFrame:
    section = F.floor(F.col("line") / 4).cast("bigint")
    return lines.select(
        F.col("doc_id").cast("bigint").alias("corpus_id"), F.col("line").alias("chunk_order"),
        F.concat_ws(":", "doc_id", "line").alias("chunk_id"), section.alias("section_order"),
        F.concat_ws("/", "doc_id", section).alias("section_id"), (F.col("line") % 4).alias("chunk_in_section"),
        "start_char", "end_char", *(["text"] if "text" in lines.columns else []))


def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _as_chunks(doc_lines(spark, sf))


def chunk_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """``line_chunks`` for steps that need no text."""
    return _as_chunks(line_bounds(spark, sf))


def raw_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("corpus_id"), "text")


def library(spark: SparkSession, sf: str) -> DataFrame:
    """Passages; ``start_char`` orders them within a source without numbering the source in one task."""
    return doc_lines(spark, sf).select(
        F.col("source").alias("corpus_id"), F.concat_ws(":", "doc_id", "line").alias("passage_id"),
        F.concat_ws("/", "doc_id", F.floor(F.col("line") / 3)).alias("parent_chunk_id"),
        F.col("doc_id").cast("string").alias("section_id"), F.col("doc_id").cast("bigint").alias("section_order"),
        F.concat_ws(" ", "lang", F.substring_index("text", " ", 2)).alias("section_title"),
        (F.col("doc_id").cast("bigint") * F.lit(4294967296) + F.col("start_char")).alias("start_char"),
        (F.col("line") + 1).alias("start_line"), (F.col("line") + 1).alias("end_line"), "text")


def library_sections(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("source").alias("corpus_id"), F.col("doc_id").cast("string").alias("section_id"),
        F.col("doc_id").cast("bigint").alias("section_order"))


def library_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole benchmark item, asked of one source each; scope bounds on some."""
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").cast("bigint").alias("query_id"),
                    F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("corpus_id"),
                    F.col("text").alias("query"), F.lit(10).cast("bigint").alias("k"),
                    F.when(F.col("item_id") % 3 == 1, F.col("item_id").cast("string")).alias("start_section_id"),
                    F.when(F.col("item_id") % 4 == 1, (F.col("item_id") + 100).cast("string")).alias("end_section_id"))


# --------------------------------------------------------------------------------------- SQL side
BOOK = """book AS (SELECT doc_id AS corpus_id, source, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
  CASE WHEN (i-1)%4=1 THEN chr(10) || (CASE doc_id%5
     WHEN 0 THEN 'Chapter ' || ((i-1)//4+1) || chr(10) || chr(10)
     WHEN 1 THEN '第' || ((i-1)//4+1) || '章 卷' || chr(10) || chr(10)
     WHEN 2 THEN '(' || ((i-1)//4+1) || ')' || chr(10)
     WHEN 3 THEN 'Part ' || ((i-1)//4+1) || ' - opening' || chr(10) || chr(10)
     ELSE CASE WHEN (i-1)//4=0 THEN 'Prologue' || chr(10) || chr(10)
          ELSE 'The turning point ' || ((i-1)//4+1) || chr(10) || chr(10) END END) || l ELSE l END), chr(10)) AS text
  FROM documents)"""
BOOK_LINES = """ln0 AS (SELECT corpus_id, length(text) AS tl, unnest(string_split(text, chr(10))) AS raw_text,
    generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM book),
ln AS (SELECT corpus_id, line_no, raw_text, trim(regexp_replace(raw_text, '\\s+', ' ', 'g')) AS normalized_text, start_char,
    least(start_char + length(raw_text) + 1, tl) AS end_char
  FROM (SELECT *, CAST(sum(length(raw_text)+1) OVER (PARTITION BY corpus_id ORDER BY line_no) - length(raw_text) - 1 AS BIGINT) AS start_char
        FROM ln0) WHERE start_char < tl)"""
DOC_LINES = """dl0 AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS text,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
dl AS (SELECT *, start_char + length(text) AS end_char FROM (SELECT *,
    CAST(sum(length(text)+1) OVER (PARTITION BY doc_id ORDER BY line) - length(text) - 1 AS BIGINT) AS start_char FROM dl0))"""
CHUNKS = DOC_LINES + """,
ck AS (SELECT doc_id AS corpus_id, line AS chunk_order, doc_id || ':' || line AS chunk_id, line//4 AS section_order,
    doc_id || '/' || (line//4) AS section_id, line%4 AS chunk_in_section, start_char, end_char, text FROM dl)"""
LIBRARY = DOC_LINES + """,
lib AS (SELECT source AS corpus_id, doc_id || ':' || line AS passage_id, doc_id || '/' || (line//3) AS parent_chunk_id,
    CAST(doc_id AS VARCHAR) AS section_id, doc_id AS section_order,
    lang || ' ' || array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') AS section_title,
    doc_id * 4294967296 + start_char AS start_char, line+1 AS start_line, line+1 AS end_line, text FROM dl)"""
QUERIES = """qry AS (SELECT item_id AS query_id, 'src' || (item_id%20) AS corpus_id,
    text AS query, 10 AS k,
    CASE WHEN item_id%3=1 THEN CAST(item_id AS VARCHAR) END AS start_section_id,
    CASE WHEN item_id%4=1 THEN CAST(item_id+100 AS VARCHAR) END AS end_section_id FROM benchmark)"""


def sql(*parts: str) -> str:
    """Common table expressions followed by the final select."""
    return "WITH RECURSIVE " + ",\n".join(parts[:-1]) + "\n" + parts[-1] if len(parts) > 1 else parts[0]
