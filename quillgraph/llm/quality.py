"""Quality rules with thresholds that adapt to language and source, in DataFrame functions only.

Each measure of a text is counted in logarithmic bins: a quantile sketch with a fixed relative error whose merge is the sum of
counts, so partial sketches combine on the map side and give the same quantiles in any order. Quantiles of a (language, source)
group set its fences; a group with few documents takes the merged sketch of its language, then that of all documents.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import free_names, let, small_or_joined, word_array
from quillgraph.llm.words import BLANKS

ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
ZERO_BIN = -100_000
LEAST_DOCUMENTS = 100
SPREADS = 6.0
WINDOW_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

# measure: least distance of a fence from its quartile. A measure of which most texts have none keeps this much slack.
SLACK = {"word_length": 0.5, "symbol_share": 0.1, "upper_share": 0.1, "dup_line_share": 0.35}


def repeated_words(words: Column, size: int = WINDOW_WORDS) -> Column:
    """Words that lie in a window of ``size`` words found twice or more in the text; each word counts once."""
    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spread(s: Column) -> Column:
            twin = F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False))
                            | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
            places = F.sort_array(F.transform(twin, lambda e: e["i"]))
            return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last")),
                               lambda acc, p: F.struct((acc["n"] + F.least(F.lit(size), p - acc["last"])).alias("n"), p.alias("last")))["n"]
        return let(ranked, spread)

    def from_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))
        return F.when(F.size(w) <= size, F.lit(0)).otherwise(
            let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))
    return let(words, from_words).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with ``_m``: n_words, word_chars, n_symbols, n_dup_lines, n_upper, n_chars and n_lines of the whole text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    full, packed = free_names(docs, "_lines", "_squeezed")
    counts = docs.withColumn(full, lines).withColumn(packed, F.regexp_replace(whole, f"{BLANKS}+", ""))
    return counts.withColumn("_m", F.struct(
        F.size(word_array(F.col(text))).cast("long").alias("n_words"),
        F.length(packed).cast("long").alias("word_chars"),
        (F.length(packed) - F.length(F.regexp_replace(packed, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
        (F.length(packed) - F.length(F.regexp_replace(packed, r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        F.size(full).cast("long").alias("n_lines"))).drop(full, packed)


def shares(m: str = "_m") -> dict[str, Column]:
    """The measures that get fences; null for a text without words."""
    some = F.col(f"{m}.n_words") > 0
    per = lambda a, b: F.when(some, F.col(f"{m}.{a}") / F.col(f"{m}.{b}"))
    return {"word_length": per("word_chars", "n_words"), "symbol_share": per("n_symbols", "n_words"),
            "upper_share": per("n_upper", "word_chars"), "dup_line_share": per("n_dup_lines", "n_lines")}


def sketches(measures: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): counts by logarithmic bin; all other sketches are sums of these."""
    stacked = measures.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), c.alias("v")) for k, c in shares().items()])).alias("e"))
    binned = F.when(F.col("e.v") <= 0, F.lit(ZERO_BIN)).otherwise(F.ceil(F.log(F.col("e.v")) / math.log(GAMMA)).cast("int"))
    return stacked.filter("e.v is not null").groupBy("lang", "source", F.col("e.measure").alias("measure"), binned.alias("bin")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, least: int = LEAST_DOCUMENTS, spreads: float = SPREADS) -> DataFrame:
    """One row per (lang, source): ``lo_<measure>`` and ``hi_<measure>``, the quartiles moved out by ``spreads`` quartile distances
    and the slack of the measure, from the finest of the three sketches that holds ``least`` documents."""
    slack = " ".join(f"WHEN '{k}' THEN {v}D" for k, v in SLACK.items())
    one = f"2 * power({GAMMA!r}D, bin) / {GAMMA + 1!r}D"
    levels = sketch.sparkSession.sql(f"""
        WITH merged AS (
          SELECT grouping_id() AS level, lang, source, measure, bin, sum(n) AS n FROM {{sketch}}
          GROUP BY GROUPING SETS ((lang, source, measure, bin), (lang, measure, bin), (measure, bin))),
        ranked AS (
          SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS upto,
                 sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM merged),
        quartiles AS (
          SELECT level, lang, source, measure, max(total) AS total,
                 min(CASE WHEN upto >= 0.25D * total THEN CASE WHEN bin = {ZERO_BIN} THEN 0D ELSE {one} END END) AS q1,
                 min(CASE WHEN upto >= 0.75D * total THEN CASE WHEN bin = {ZERO_BIN} THEN 0D ELSE {one} END END) AS q3
          FROM ranked GROUP BY level, lang, source, measure)
        SELECT level, lang, source, measure, total, q1 - {spreads!r}D * (q3 - q1) - CASE measure {slack} END AS lo,
               q3 + {spreads!r}D * (q3 - q1) + CASE measure {slack} END AS hi FROM quartiles""", sketch=sketch)
    ids = {"own": 0, "lang": 4, "all": 12}
    fine = levels.filter(F.col("level") == ids["own"])
    by_lang = levels.filter(F.col("level") == ids["lang"]).select(F.col("lang").alias("_l"), "measure", F.struct("total", "lo", "hi").alias("b"))
    by_all = levels.filter(F.col("level") == ids["all"]).select("measure", F.struct("lo", "hi").alias("c"))
    chosen = (fine.withColumn("a", F.struct("lo", "hi"))
              .join(by_lang, F.col("lang").eqNullSafe(F.col("_l")) & (fine["measure"] == by_lang["measure"])).drop(by_lang["measure"])
              .join(by_all, "measure")
              .withColumn("f", F.when(F.col("total") >= least, F.col("a"))
                          .when(F.col("b.total") >= least, F.struct(F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))).otherwise(F.col("c"))))
    picks = [F.max(F.when(F.col("measure") == k, F.col(f"f.{side}"))).alias(f"{side}_{k}") for k in SLACK for side in ("lo", "hi")]
    return chosen.groupBy("lang", "source").agg(*picks)


def judge(docs: DataFrame) -> DataFrame:
    """Every input row with ``_m`` (see ``measured``), ``_repeated``, ``_base_failed`` and ``_kept``.

    Base rules: fewer than 20 words, or over 30 % of the words in repeated 8-word windows. The method: a measure outside the fences
    of the row's (lang, source). Null lang or source are groups of their own. A null, empty or blank text has zero counts, fails the
    base rules and has no part in the sketches. Very long texts are measured whole. Repeated rows are judged each; ties at a fence
    stay. Columns named like one of the four results are replaced, all others are kept. An empty table gives no rows.
    """
    narrow = measured(docs.select("text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))).drop("text")
    lang, source, fence = free_names(docs, "_lang", "_source", "_f")
    limits = small_or_joined(fences(sketches(narrow))).select(F.col("lang").alias(lang), F.col("source").alias(source), F.struct(*[f"{s}_{k}" for k in SLACK for s in ("lo", "hi")]).alias(fence))
    full = measured(docs).withColumn("_repeated", repeated_words(word_array(F.col("text"))))
    joined = full.join(limits, F.col("lang").cast("string").eqNullSafe(F.col(lang)) & F.col("source").cast("string").eqNullSafe(F.col(source)), "left")
    outside = F.lit(False)
    for k, value in shares().items():
        outside = outside | F.coalesce((value < F.col(fence)[f"lo_{k}"]) | (value > F.col(fence)[f"hi_{k}"]), F.lit(False))
    failed = (F.col("_m.n_words") < LEAST_WORDS) | (100 * F.col("_repeated") > MOST_REPEATED * F.col("_m.n_words"))
    return (joined.withColumn("_base_failed", failed).withColumn("_kept", ~failed & ~outside).drop(lang, source, fence))
