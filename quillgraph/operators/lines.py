"""Line table, match normalisation and the character-to-line lookup."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import LINE_PATTERN, collapse


def line_table(corpus: DataFrame) -> DataFrame:
    """One row per line with its span (terminator included) and normalised text.

    The corpus is placed by ``corpus_id`` once, as one row per text; every corpus-local window
    further down (headings, sections) reuses that placement without another exchange.
    """
    placed = corpus.select("corpus_id", "text").repartition("corpus_id")
    exploded = placed.select(
        "corpus_id", F.posexplode(F.regexp_extract_all("text", F.lit(LINE_PATTERN), F.lit(0))).alias("pos", "piece"))
    order = Window.partitionBy("corpus_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = exploded.withColumn("end_char", F.sum(F.length("piece").cast("bigint")).over(order))
    raw = F.regexp_replace("piece", r"[\r\n]+$", "")
    return ends.select(
        "corpus_id",
        (F.col("pos") + 1).cast("bigint").alias("line_no"),
        (F.col("end_char") - F.length("piece")).alias("start_char"),
        "end_char",
        raw.alias("raw_text"),
        collapse(raw).alias("normalized_text"),
    )


def line_of(points: DataFrame, lines: DataFrame, pos_col: str, out_col: str) -> DataFrame:
    """As-of lookup: the last line starting at or before each position, clamped to the text.

    Points and line starts are merged in position order, so there is no range join.
    """
    bound = points.withColumn("_pos", F.greatest(F.col(pos_col).cast("bigint"), F.lit(0).cast("bigint")))
    row = F.struct(*[F.col(c) for c in points.columns])
    marks = lines.select("corpus_id", F.col("start_char").alias("_pos"), F.col("line_no").alias("_line"),
                         F.lit(None).cast(bound.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    asked = bound.select("corpus_id", "_pos", F.lit(None).cast("bigint").alias("_line"), row.alias("_row"))
    order = (Window.partitionBy("corpus_id").orderBy("_pos", F.col("_line").isNull())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = marks.unionByName(asked).withColumn(out_col, F.last("_line", ignorenulls=True).over(order))
    return merged.filter(F.col("_row").isNotNull()).select(
        "_row.*", F.coalesce(F.col(out_col), F.lit(1).cast("bigint")).alias(out_col))
