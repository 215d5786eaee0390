"""Heading detection, scoring and the structure report.

All detectors are evaluated in one pass over the lines: each one is a function that returns a
nullable struct column, and the non-null structs of a line are exploded. A caller adds a detector
by appending a function to the list.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.numerals import (CN_NUMBER_CLASS, chinese_value, decimal_value, english_value)
from quillgraph.functions.text import strip

# Punctuation sets, word lists, score weights.
ENDING_PUNCTUATION = "，。；！？,.!?;：:"
COUNTED_PUNCTUATION = "，。；！？,.!?;：:、"
SPECIAL_WORDS = "序|序章|楔子|引子|前言|正文|终章|尾声|后记|附录"
SPECIAL_ENGLISH = "prologue|epilogue|preface|appendix"
NUMBER_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten"
DETECTORS = ["di_unit", "numeric", "chinese_numeric", "english", "special", "plain"]

Detector = Callable[[], Column]


def _t() -> Column:
    return F.col("normalized_text")


def _found(condition: Column, name: str, score: float, level: Column | int, number: Column | None = None,
           unit: Column | None = None) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.when(condition, F.struct(
        F.lit(name).alias("detector"),
        (number if number is not None else F.lit(None)).cast("bigint").alias("number_value"),
        (unit if unit is not None else F.lit(None)).cast("string").alias("unit"),
        level.cast("bigint").alias("level_hint"),
        F.lit(score).cast("double").alias("local_score"),
    ))


def _short(limit: int) -> Column:
    return (F.length(_t()) > 0) & (F.length(_t()) <= limit)


def di_unit() -> Column:
    pattern = f"^第 *([0-9]+|[{CN_NUMBER_CLASS}]+) *([章节回卷部篇集幕])"
    number = F.regexp_extract(_t(), pattern, 1)
    unit = F.regexp_extract(_t(), pattern, 2)
    value = F.coalesce(decimal_value(number), chinese_value(number))
    return _found(_short(80) & _t().rlike(pattern), "di_unit", 5.0,
                  F.when(unit.isin("卷", "部", "篇", "集"), 1).otherwise(2), value, unit)


def _listed(number_class: str) -> str:
    return (rf"^(?:[（(【\[] *({number_class}) *[）)】\]]|({number_class}) *[、.．:：\-—]|({number_class})$)")


def _listed_number(pattern: str) -> Column:
    return F.concat(*[F.regexp_extract(_t(), pattern, i) for i in (1, 2, 3)])


def numeric() -> Column:
    pattern = _listed(r"\p{Nd}{1,5}")
    return _found(_short(60) & _t().rlike(pattern), "numeric", 2.5, 2, decimal_value(_listed_number(pattern)))


def chinese_numeric() -> Column:
    pattern = _listed(f"[{CN_NUMBER_CLASS}]+")
    value = chinese_value(_listed_number(pattern))
    return _found(_short(60) & _t().rlike(pattern), "chinese_numeric", 2.5, 2, value)


def english() -> Column:
    pattern = rf"(?i)^(chapter|part|book|volume) +([0-9]+|[ivxlcdm]+|{NUMBER_WORDS})"
    unit = F.lower(F.regexp_extract(_t(), pattern, 1))
    return _found(_short(80) & _t().rlike(pattern), "english", 5.0,
                  F.when(unit == "chapter", 2).otherwise(1), english_value(F.regexp_extract(_t(), pattern, 2)), unit)


def special() -> Column:
    pattern = rf"^(?:{SPECIAL_WORDS}|番外(?: *[0-9{CN_NUMBER_CLASS}]+)?)(?: .*)?$"
    return _found(_short(60) & (_t().rlike(pattern) | _t().rlike(rf"(?i)^(?:{SPECIAL_ENGLISH})(?: .*)?$")),
                  "special", 4.0, 1)


def plain() -> Column:
    text = _t()
    marks = F.length(text) - F.length(F.translate(text, COUNTED_PUNCTUATION, ""))
    shape = (F.length(text).between(2, 30) & ~F.right(text, F.lit(1)).isin(*ENDING_PUNCTUATION)
             & ~text.rlike("^[“‘\"—]") & ~text.rlike("[”’\"]$") & (marks <= 1))
    context = ((F.col("blank_before") | F.col("blank_after"))
               & (F.col("blank_after") | (F.coalesce(F.col("next_length"), F.lit(0)) >= 50)))
    return _found(shape & context, "plain", 1.0, 2)


DEFAULT_DETECTORS: tuple[Detector, ...] = (di_unit, numeric, chinese_numeric, english, special, plain)


def detect_candidates(lines: DataFrame, detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> DataFrame:
    """One row per (line, detector that matched)."""
    order = Window.partitionBy("corpus_id").orderBy("line_no")
    prev, nxt = F.lag("normalized_text").over(order), F.lead("normalized_text").over(order)
    context = lines.select(
        "*", (F.coalesce(prev, F.lit("")) == "").alias("blank_before"),
        (F.coalesce(nxt, F.lit("")) == "").alias("blank_after"), F.length(nxt).alias("next_length"))
    found = F.filter(F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("detector_rank"), d().alias("hit"))
        for i, d in enumerate(detectors)]), lambda x: x["hit"].isNotNull())
    return context.select(
        "corpus_id", "line_no", "start_char", "end_char", strip(F.col("raw_text")).alias("raw_text"),
        "normalized_text", "blank_before", "blank_after", F.explode(found).alias("c"),
    ).select("corpus_id", "line_no", "start_char", "end_char", "raw_text", "normalized_text", "blank_before",
             "blank_after", "c.detector_rank", "c.hit.*")


def detector_stats(candidates: DataFrame) -> DataFrame:
    """Candidates with their group's size, sequence ratio and median gaps, by window only."""
    group = Window.partitionBy("corpus_id", "detector")
    order = group.orderBy("start_char")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    step = (candidates
            .withColumn("previous_number", F.last("number_value", ignorenulls=True).over(before))
            .withColumn("char_gap", F.col("start_char") - F.lag("start_char").over(order))
            .withColumn("line_gap", F.col("line_no") - F.lag("line_no").over(order)))
    compared = F.col("number_value").isNotNull() & F.col("previous_number").isNotNull()
    follows = F.when(compared, F.when(F.col("number_value") == F.col("previous_number") + 1, 1.0).otherwise(0.0))
    half = lambda c: F.coalesce(F.percentile(F.col(c), F.lit(0.5)).over(group), F.lit(0.0))
    return (step.withColumn("items", F.count("*").over(group))
            .withColumn("sequence_ratio", F.coalesce(F.avg(follows).over(group), F.lit(0.0)))
            .withColumn("median_char_gap", half("char_gap"))
            .withColumn("median_line_gap", half("line_gap"))
            .drop("previous_number", "char_gap", "line_gap"))


def score_candidates(stats: DataFrame) -> DataFrame:
    length = F.length("normalized_text")
    add = lambda cond, points: F.when(cond, F.lit(float(points))).otherwise(F.lit(0.0))
    both, either = F.col("blank_before") & F.col("blank_after"), F.col("blank_before") | F.col("blank_after")
    score = (F.col("local_score")
             + F.when(both, 2.0).when(either, 1.0).otherwise(0.0)
             + add(length.between(2, 30), 1)
             + add(F.col("items") >= 2, 2)
             + F.when(F.col("sequence_ratio") >= 0.6, 3.0).when(F.col("sequence_ratio") >= 0.3, 1.0).otherwise(0.0)
             + add(F.col("median_char_gap") >= 300, 1)
             + add((F.col("median_line_gap") > 0) & (F.col("median_line_gap") <= 3), -4)
             + add(length > 60, -3)
             + add(F.right("normalized_text", F.lit(1)).isin(*ENDING_PUNCTUATION), -3))
    is_plain = F.col("detector") == "plain"
    enough = F.col("final_score") >= F.when(is_plain, 5.5).otherwise(4.0)
    supported = ~is_plain | ((F.col("items") >= 3) & (F.col("median_char_gap") >= 300) & (F.col("median_line_gap") >= 4))
    return stats.withColumn("final_score", score).withColumn("passes", enough & supported)


def best_per_line(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("corpus_id", "line_no").orderBy(F.desc("final_score"), "detector_rank")
    return (scored.filter("passes").withColumn("_rank", F.row_number().over(order))
            .filter("_rank = 1").drop("_rank"))


def flag_dense_runs(best: DataFrame, *within: str) -> DataFrame:
    """Marks every member of a run of at least three headings whose successive starts lie under 180 apart."""
    order = Window.partitionBy("corpus_id", *within).orderBy("start_char")
    gap = F.col("start_char") - F.lag("start_char").over(order)
    island = F.sum(F.when(gap < 180, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    run = Window.partitionBy("corpus_id", *within, "_island")
    return (best.withColumn("_island", island)
            .withColumn("dense", F.count("*").over(run) >= 3).drop("_island"))


def drop_dense_runs(best: DataFrame) -> DataFrame:
    return flag_dense_runs(best).filter(~F.col("dense")).drop("dense")


def structure_report(corpus: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per corpus, also for corpora without any candidate. Flags replace filters: one pass over the candidates."""
    order = Window.partitionBy("corpus_id", "line_no", "passes").orderBy(F.desc("final_score"), "detector_rank")
    flagged = flag_dense_runs(scored.withColumn("_best", F.col("passes") & (F.row_number().over(order) == 1)), "_best")
    kept, dense = F.col("_best") & ~F.col("dense"), F.col("_best") & F.col("dense")
    found = flagged.groupBy("corpus_id").agg(
        F.count("*").alias("candidates"), F.count_if(kept).alias("kept"), F.count_if(dense).alias("dense"),
        F.avg(F.when(kept, F.least(F.col("final_score"), F.lit(10.0)))).alias("mean_score"),
        F.sort_array(F.collect_set(F.when(kept, F.col("detector")))).alias("used"))
    joined = corpus.select("corpus_id").join(found, "corpus_id", "left").fillna(0, ["candidates", "kept", "dense"])
    fallback = F.col("kept") < 2
    none = F.array().cast("array<string>")
    return joined.select(
        "corpus_id",
        F.when(fallback, "fallback_chunks").when(F.size("used") > 1, "mixed_headings").otherwise("detected_headings").alias("strategy"),
        F.when(fallback, 0.0).otherwise(F.least(F.lit(0.99), F.greatest(F.lit(0.5), F.col("mean_score") / 10))).alias("confidence"),
        F.when(fallback, 0).otherwise(F.col("kept")).cast("bigint").alias("heading_count"),
        F.when(fallback, none).otherwise(F.col("used")).alias("detectors_used"),
        F.when(fallback, F.col("candidates")).otherwise(F.col("candidates") - F.col("kept")).cast("bigint").alias("rejected_count"),
        fallback.alias("fallback_used"),
        F.array_compact(F.array(F.when(F.col("dense") > 0, F.lit("dense_candidates_filtered")),
                                F.when(fallback, F.lit("too_few_headings")))).alias("warnings"),
    )


def accepted_headings(scored: DataFrame) -> DataFrame:
    """Headings that shape sections: none for a corpus with fewer than two reliable ones."""
    kept = drop_dense_runs(best_per_line(scored))
    n = F.count("*").over(Window.partitionBy("corpus_id"))
    return kept.withColumn("_n", n).filter("_n >= 2").drop("_n")


def headings_of(lines: DataFrame, detectors: Sequence[Detector] = DEFAULT_DETECTORS) -> DataFrame:
    return accepted_headings(score_candidates(detector_stats(detect_candidates(lines, detectors))))
