"""Secrets in texts: fixed expressions, and character Markov models of random strings against ordinary identifiers.

DataFrame functions only. Positions come from the pieces between the matches of an expression: piece and match lengths summed up.
A text without any match stops at one test per expression. The two Markov models are transition counts over a fixed alphabet,
learnt from labelled samples: values that the fixed expressions find and digests (random), words of a bounded set of documents
(ordinary). Their log ratio is a table of fixed size, so the driver may hold it.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import let

# The expressions, the least length of what must be long enough, and which group that is.
_KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = _KEYWORD + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = [("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24)]

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
SAMPLE_DOCUMENTS = 2_000
LEAST_LOG_RATIO = 15.0
BACK_OFF = 5.0
MARK = "[SECRET]"
SAMPLE_WORDS = 2_000
BLOCK = 256  # items whose running sums are gathered in one array
PIECE = 4_096  # code points of a piece of a text that is cut up
SPAN = "struct<start:int,end:int,kind:int>"
NAMES = [k for k, *_ in KINDS] + ["random"]


def in_blocks(items: Column) -> Column:
    """The array cut into arrays of ``BLOCK`` items; one empty array for an empty one."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def running(items: Column, total, join, walk) -> Column:
    """Rows of ``walk(block, carried)`` of all blocks, where ``carried`` joins the totals of the blocks before: what an item adds is
    copied within its own block only, so that a text with very many items costs about linear time."""
    def over(blocks: Column) -> Column:
        return let(F.transform(blocks, total), lambda totals: F.flatten(F.transform(
            blocks, lambda b, i: walk(b, F.aggregate(F.slice(totals, F.lit(1), i), F.lit(0), join)))))
    return let(in_blocks(items), over)


def spans_of(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as (start, end, kind), those with a long enough group; code points, end exclusive."""
    def placed(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), 0)
        values = F.regexp_extract_all(t, F.lit(pattern), group)
        steps = F.arrays_zip(F.transform(F.slice(F.split(t, pattern), 1, F.size(found)), lambda p: F.length(p)).alias("gap"),
                             F.transform(found, lambda m: F.length(m)).alias("len"), F.transform(values, lambda v: F.length(v)).alias("value"))

        def step(acc: Column, s: Column) -> Column:
            start = acc["at"] + s["gap"]
            span = F.array(F.struct(start.alias("start"), (start + s["len"]).alias("end"), F.lit(kind).alias("kind")))
            return F.struct((start + s["len"]).alias("at"), F.when(s["value"] >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        def walk(block: Column, at: Column) -> Column:
            empty = F.struct(at.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
            return F.aggregate(block, empty, step, lambda acc: acc["out"])
        length = lambda block: F.aggregate(block, F.lit(0), lambda n, s: n + s["gap"] + s["len"])
        return let(steps, lambda s: running(s, length, lambda a, b: a + b, walk))
    return F.when(text.rlike(pattern), let(text, placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def cut_up(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points, for ``between``."""
    return F.regexp_extract_all(text, F.lit(f"[\\s\\S]{{1,{PIECE}}}"), 0)


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text that was cut up, without reading the text from its beginning."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    part = lambda k: F.substring(F.get(pieces, k), F.greatest(start - k * PIECE, F.lit(0)) + 1, end - k * PIECE - F.greatest(start - k * PIECE, F.lit(0)))
    return F.when(end <= start, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), part), ""))


def base_spans(text: Column) -> Column:
    """Spans of the fixed expressions by start, then by kind as listed."""
    hints = {"access": text.contains("AKIA")}
    parts = [F.when(hints.get(name, F.lit(True)), spans_of(text, i, p, g, n)).otherwise(F.array().cast(f"array<{SPAN}>")) for i, (name, p, g, n) in enumerate(KINDS)]
    return F.sort_array(F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def label_samples(docs: DataFrame, most: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(sample, random): labelled strings of at most ``most`` distinct texts, those with the smallest hashes. Only hashes
    are sorted; the texts below the last of them are read where they lie.

    Random: a value inside a span of the fixed expressions, and two digests per document. Ordinary: words outside the
    spans that are too short to be judged; of a text with more than ``SAMPLE_WORDS`` of them a share chosen by hash from the whole
    text, about that many.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = docs.select(text.alias("text")).withColumn("h", F.xxhash64("text"))
    last = hashed.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    chosen = hashed.filter(F.col("h") <= F.lit(last)).dropDuplicates(["h"])
    chosen_words = lambda w: F.filter(w, lambda v, i: F.pmod(F.xxhash64(v, i), F.ceil(F.greatest(F.size(w), F.lit(1)) / SAMPLE_WORDS)) == 0)
    spanned = chosen.withColumn("s", base_spans(F.col("text")))
    values = let(cut_up(F.col("text")), lambda t: F.transform("s", lambda s: F.regexp_extract(between(t, s["start"], s["end"]), "[A-Za-z0-9+/_=-]*$", 0)))
    digests = F.array(F.base64(F.unhex(F.sha2(F.col("h").cast("string"), 256))), F.base64(F.unhex(F.sha2(F.concat(F.lit("x"), F.col("h").cast("string")), 256))))
    words = F.regexp_extract_all(masked(F.col("text"), F.col("s"), " "), F.lit("(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{4,15}(?![A-Za-z0-9_-])"), 0)
    return spanned.select(F.explode(F.concat(
        F.transform(F.concat(values, digests), lambda v: F.struct(v.alias("sample"), F.lit(True).alias("random"))),
        F.transform(let(words, chosen_words), lambda v: F.struct(v.alias("sample"), F.lit(False).alias("random"))))).alias("e")).select("e.*")


def log_ratios(samples: DataFrame) -> list[float]:
    """log P(next | previous) under the random model minus that under the ordinary one, row by row over the
    alphabet with the start first: a fixed number of values whatever the samples."""
    n = len(ALPHABET)
    codes = F.transform(F.split("sample", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = let(codes, lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.struct(F.coalesce(F.get(v, i - 1), F.lit(0)).alias("a"), F.get(v, i).alias("b"))))
    counted = samples.filter(F.length("sample") > 0).select("random", F.explode(pairs).alias("p")).groupBy("random", "p.a", "p.b").agg(F.count("*").alias("n"))
    tables = {True: {}, False: {}}
    for r in counted.collect():
        tables[r["random"]][(r["a"], r["b"])] = r["n"]
    sums = {k: [sum(t.get((a, b), 0) for b in range(1, n + 1)) for a in range(n + 1)] for k, t in tables.items()}
    single = {k: [sum(t.get((a, b), 0) for a in range(n + 1)) for b in range(n + 1)] for k, t in tables.items()}
    alone = lambda k, b: (single[k][b] + 0.5) / (sum(single[k]) + 0.5 * n)
    log = lambda k, a, b: math.log((tables[k].get((a, b), 0) + BACK_OFF * alone(k, b)) / (sums[k][a] + BACK_OFF))
    return [log(True, a, b) - log(False, a, b) for a in range(n + 1) for b in range(1, n + 1)]


def model_spans(text: Column, base: Column, ratios: list[float]) -> Column:
    """Runs of at least 16 token characters with a letter and a digit, clear of the base spans, whose summed log ratio says random."""
    table, n = F.array(*[F.lit(float(v)) for v in ratios]), len(ALPHABET)
    code = lambda chars: F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c))
    score = lambda t: let(code(F.split(t, "")), lambda v: F.aggregate(F.sequence(F.lit(0), F.size(v) - 1), F.lit(0.0), lambda acc, i: acc + F.coalesce(F.get(
        table, F.coalesce(F.get(v, i - 1), F.lit(0)) * n + F.get(v, i) - 1), F.lit(0.0))))

    meets = lambda b, s: F.coalesce((b["start"] < s["end"]) & (b["end"] > s["start"]), F.lit(False))
    bounded = F.transform(in_blocks(base), lambda b: F.struct(F.array_min(F.transform(b, lambda x: x["start"])).alias("start"), F.array_max(F.transform(b, lambda x: x["end"])).alias("end"), b.alias("spans")))

    def told(t: Column, blocks: Column, s: Column) -> Column:
        clear = ~F.exists(blocks, lambda b: meets(b, s) & F.exists(b["spans"], lambda x: meets(x, s)))
        random = lambda piece: piece.rlike("[0-9]") & piece.rlike("[A-Za-z]") & (score(piece) > LEAST_LOG_RATIO)
        return clear & let(between(t, s["start"], s["end"]), random)
    runs = spans_of(text, len(KINDS), CANDIDATE, 0, 16)
    some = let(cut_up(text), lambda t: let(bounded, lambda blocks: F.transform(F.filter(runs, lambda s: told(t, blocks, s)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))
    return F.when(text.rlike(CANDIDATE), some).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def masked(text: Column, spans: Column, mark: str = MARK) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mark; spans sorted by start."""
    def cut(pieces: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            fresh = F.array(F.concat(between(pieces, acc["at"], s["start"]), F.lit(mark)))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], fresh)).otherwise(acc["out"]).alias("out"))
        walk = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: acc["out"])
        last = lambda block: F.coalesce(F.array_max(F.transform(block, lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(running(spans, last, lambda a, b: F.greatest(a, b), walk), ""), between(pieces, last(spans), F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(let(cut_up(text), cut))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined; empty without spans."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in NAMES]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Every input row with ``_base`` and ``_spans`` (base and model spans), arrays of (start, kind, end) by start, then kind.

    A null text is an empty one and has no spans. Every text is scanned whole, a very long one or one of very many matches in about
    linear time; repeated rows get the same spans. Columns named like a result are replaced, all others are kept. Ties at one start
    are ordered by kind. Without documents there are no rows, and models learnt from nothing find nothing.
    """
    ratios = log_ratios(label_samples(docs, sample))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("_base", base_spans(text)).withColumn("_spans", F.sort_array(F.concat("_base", model_spans(text, F.col("_base"), ratios))))
