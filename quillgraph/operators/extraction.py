"""Extraction windows, evidence segments, anchoring, and validation of candidate entities and relations.

Candidate tables share (corpus_id, unit_id, pos). Anchors of every kind are located in one pass.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.runtime import stage
from quillgraph.functions.text import cut
from quillgraph.functions.udfs import slice_text
from quillgraph.operators.ontology import allowed

# Window and context sizes, density limits.
CORE, CONTEXT, SEGMENT_CONTEXT = 2500, 300, 120
SEGMENT, SEGMENT_OVERLAP = 180, 30
SENTENCE = "[^。！？!?；;\\n]+[。！？!?；;\\n]*|[。！？!?；;\\n]+"
CUT_MARKS = "。！？\n"
LIMITS = {"full": (80, 120, 40), "compact": (32, 48, 12)}
MIN_CORE = {"full": 500, "compact": 200}
BUCKET = 2500


def cores(chunks: DataFrame) -> DataFrame:
    """Every chunk cut into cores of at most 2500 characters."""
    length = F.col("end_char") - F.col("start_char")
    n = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((length - 1) / CORE))).alias("n")
    return chunks.filter(length > 0).select("corpus_id", "chunk_order", "start_char", "end_char", n).select(
        "corpus_id", F.concat(F.lit("extract:"), "chunk_order", F.lit(":"), "n").alias("unit_id"), "chunk_order",
        (F.col("start_char") + F.col("n") * CORE).alias("core_start"),
        F.least(F.col("start_char") + (F.col("n") + 1) * CORE, F.col("end_char")).alias("core_end"))


def with_context(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds left and right context bounds; they reach into a neighbour chunk only from the chunk's edge."""
    order = Window.partitionBy("corpus_id").orderBy("chunk_order")
    around = chunks.select("corpus_id", "chunk_order", F.col("start_char").alias("_s"), F.col("end_char").alias("_e"),
                           F.lag("start_char").over(order).alias("_ps"), F.lead("end_char").over(order).alias("_ne"))
    left = F.when((F.col("core_start") == F.col("_s")) & F.col("_ps").isNotNull(), F.col("_ps")).otherwise(F.col("_s"))
    right = F.when((F.col("core_end") == F.col("_e")) & F.col("_ne").isNotNull(), F.col("_ne")).otherwise(F.col("_e"))
    return units.join(around, ["corpus_id", "chunk_order"]).select(
        *units.columns, F.greatest(left, F.col("core_start") - CONTEXT).alias("left_start"),
        F.least(right, F.col("core_end") + CONTEXT).alias("right_end"))


def window_spans(windows: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row per named span (core, before, after) with its text."""
    span = lambda name, a, b, rank: F.struct(F.lit(name).alias("span_id"), F.col(a).alias("start_char"),
                                             F.col(b).alias("end_char"), F.lit(rank).alias("region_rank"))
    rows = windows.select("corpus_id", "unit_id", "core_start", "core_end", F.explode(F.array(
        span("core", "core_start", "core_end", 0), span("before", "left_start", "core_start", 1),
        span("after", "core_end", "right_end", 2))).alias("s")).select("corpus_id", "unit_id", "core_start", "core_end", "s.*")
    return slice_text(corpus, rows.filter(F.col("start_char") < F.col("end_char")))


def window_payload(spans: DataFrame) -> DataFrame:
    """The canonical JSON of a window and its hash."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("region_rank", "span_id", "text"))),
                          lambda s: F.struct(s["span_id"].alias("span_id"), s["text"].alias("text")))
    packed = spans.groupBy("corpus_id", "unit_id").agg(
        F.to_json(F.struct(F.lit("core").alias("core"), ordered.alias("spans"))).alias("payload"))
    return packed.withColumn("input_hash", F.sha2("payload", 256))


def split_windows(windows: DataFrame, chunks: DataFrame, corpus: DataFrame, mode: str = "full") -> DataFrame:
    """Saturated windows (column ``saturated``) cut in two near the middle, after a sentence end if one is near.

    Windows too short to split are returned unchanged, as are those that are not saturated.
    """
    least_core = MIN_CORE[mode]
    able = F.col("saturated") & (F.col("core_end") - F.col("core_start") >= 2 * least_core)
    split = windows.filter(able)
    texts = slice_text(corpus, split.withColumnRenamed("core_start", "start_char").withColumnRenamed("core_end", "end_char"))
    middle = F.floor((F.col("start_char") + F.col("end_char")) / 2)
    low = F.greatest(F.col("start_char") + least_core, middle - 100)
    high = F.least(F.col("end_char") - least_core, middle + 100)
    mark = lambda p: F.instr(F.lit(CUT_MARKS), F.substring(F.col("text"), (p - F.col("start_char")).cast("int"), F.lit(1))) > 0
    choices = F.filter(F.sequence(low, high), mark)
    nearest = F.array_min(F.transform(choices, lambda p: F.struct(F.abs(p - middle).alias("gap"), p.alias("p"))))
    at = F.coalesce(nearest["p"], middle)
    halves = texts.withColumn("_at", at).withColumn("_h", F.explode(F.array(
        F.struct(F.lit(":a").alias("suffix"), F.col("start_char").alias("a"), F.col("_at").alias("b")),
        F.struct(F.lit(":b").alias("suffix"), F.col("_at").alias("a"), F.col("end_char").alias("b")))))
    children = halves.select("corpus_id", F.concat("unit_id", "_h.suffix").alias("unit_id"), "chunk_order",
                             F.col("_h.a").alias("core_start"), F.col("_h.b").alias("core_end"))
    kept = windows.filter(~able).select("corpus_id", "unit_id", "chunk_order", "core_start", "core_end")
    return with_context(kept.unionByName(children), chunks)


def split_until_settled(windows: DataFrame, chunks: DataFrame, corpus: DataFrame, judge: Callable[[DataFrame], DataFrame], mode: str = "full") -> DataFrame:
    """Rounds of ``split_windows`` until no window that can be split is saturated; ``saturated`` is kept.

    ``judge`` adds the column ``saturated`` (null: not saturated) and sees each window once: a round judges only the halves of the
    last. Halves are never shorter than the least core, so the rounds end.
    """
    settled = None
    while True:
        judged = stage(judge(windows).withColumn("saturated", F.coalesce("saturated", F.lit(False))), "judged")
        able = F.col("saturated") & (F.col("core_end") - F.col("core_start") >= 2 * MIN_CORE[mode])
        rest = judged.filter(~able).select("corpus_id", "unit_id", "chunk_order", "core_start", "core_end", "left_start", "right_end", "saturated")
        settled = rest if settled is None else settled.unionByName(rest)
        again = judged.filter(able)
        if again.isEmpty():
            return settled
        windows = split_windows(again, chunks, corpus, mode)


def _covering(chunks: DataFrame) -> DataFrame:
    """Chunks repeated for every position bucket they touch, for equi joins instead of range joins."""
    buckets = F.sequence(F.floor(F.col("start_char") / BUCKET), F.floor((F.greatest("end_char", F.col("start_char") + 1) - 1) / BUCKET))
    return chunks.withColumn("_bucket", F.explode(buckets))


def segments(windows: DataFrame, chunks: DataFrame, corpus: DataFrame) -> DataFrame:
    """Short evidence segments with ids s0, s1, ... per window: real chunk text only, no overlap, by sentence."""
    size = F.least(F.lit(SEGMENT_CONTEXT).cast("bigint"), F.floor((F.col("core_end") - F.col("core_start")) / 2))
    region = lambda name, rank, a, b: F.struct(F.lit(name).alias("region"), F.lit(rank).alias("region_rank"), a.alias("a"), b.alias("b"))
    c = F.col
    regions = windows.select("corpus_id", "unit_id", F.explode(F.array(
        region("core", 0, c("core_start"), c("core_end")),
        region("before", 1, F.greatest(c("left_start"), c("core_start") - size), c("core_start")),
        region("after", 2, c("core_end"), F.least(c("right_end"), c("core_end") + size)))).alias("r")).select(
        "corpus_id", "unit_id", "r.*").filter("a < b")
    wanted = regions.withColumn("_bucket", F.explode(F.sequence(F.floor(c("a") / BUCKET), F.floor((c("b") - 1) / BUCKET))))
    real = _covering(chunks.select("corpus_id", "chunk_order", "start_char", "end_char"))
    keys = ["corpus_id", "unit_id", "region", "region_rank", "a", "b", "chunk_order", "start_char", "end_char"]
    met = wanted.join(real, ["corpus_id", "_bucket"]).filter((c("start_char") < c("b")) & (c("end_char") > c("a"))).select(keys).distinct()
    order = Window.partitionBy("corpus_id", "unit_id", "region").orderBy("chunk_order")
    stop = F.least("b", "end_char")
    done = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = (met.withColumn("_from", F.greatest("a", "start_char", F.coalesce(done, c("a")))).withColumn("_to", stop)
            .filter("_from < _to").select("corpus_id", "unit_id", "region", "region_rank", c("_from").alias("start_char"), c("_to").alias("end_char"))
            .withColumn("_key", F.concat_ws("#", "unit_id", "region", "start_char")))
    sentences = slice_text(corpus, runs).select(
        "corpus_id", "unit_id", "region", "region_rank", "_key", "start_char",
        F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))).alias("i", "sentence"))
    inside = Window.partitionBy("corpus_id", "_key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    offset = c("start_char") + F.coalesce(F.sum(F.length("sentence")).over(inside), F.lit(0).cast("bigint"))
    step = SEGMENT - SEGMENT_OVERLAP
    more = F.greatest(F.lit(0), F.ceil((F.length("sentence") - SEGMENT) / step)).cast("int")
    pieces = (sentences.withColumn("_at", offset).withColumn("j", F.explode(F.sequence(F.lit(0), more)))
              .withColumn("segment_start", c("_at") + c("j") * step)
              .withColumn("segment_end", F.least(c("_at") + c("j") * step + SEGMENT, c("_at") + F.length("sentence")))
              .withColumn("text", cut(c("sentence"), c("j") * step, c("j") * step + (c("segment_end") - c("segment_start")))))
    number = F.row_number().over(Window.partitionBy("corpus_id", "unit_id").orderBy("region_rank", "segment_start")) - 1
    return pieces.withColumn("span_id", F.concat(F.lit("s"), number)).select(
        "corpus_id", "unit_id", "span_id", "region", F.col("segment_start").alias("start_char"), F.col("segment_end").alias("end_char"), "text")


def expand_compact(candidates: DataFrame, segs: DataFrame) -> DataFrame:
    """Evidence ids (array ``evidence_ids``) to anchors; any unknown id rejects its candidate.

    Ids are de-duplicated in order. Adds ``evidence`` (array of span_id, quote, occurrence) and ``rejected``.
    """
    keys = ["corpus_id", "unit_id", "pos"]
    ids = candidates.select(*keys, F.posexplode(F.array_distinct("evidence_ids")).alias("i", "span_id"))
    quoted = ids.join(segs.select("corpus_id", "unit_id", "span_id", F.col("text").alias("quote")), ["corpus_id", "unit_id", "span_id"], "left")
    packed = quoted.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "span_id", "quote"))), lambda s: F.struct(
            s["span_id"].alias("span_id"), s["quote"].alias("quote"), F.lit(1).cast("bigint").alias("occurrence"))).alias("evidence"),
        F.bool_or(F.col("quote").isNull()).alias("rejected"))
    return candidates.join(packed, keys, "left")


def nth_position(text: Column, quote: Column, occurrence: Column) -> Column:
    """One-based start of the n-th, possibly overlapping, occurrence; null when there is none."""
    find = lambda after: F.nullif(F.call_function("locate", quote, text, after + 1), F.lit(0))
    walked = F.aggregate(F.sequence(F.lit(1), occurrence.cast("int")), F.lit(0), lambda p, _: find(p))
    return F.when(occurrence == 1, find(F.lit(0))).otherwise(walked)


def locate(anchors: DataFrame, spans: DataFrame) -> DataFrame:
    """Anchors (corpus_id, unit_id, kind, pos, part, span_id, quote, occurrence) to absolute offsets.

    ``start_char`` stays null for an unknown span or a quote that is not there.
    """
    named = spans.select("corpus_id", "unit_id", "span_id", F.col("start_char").alias("_from"), F.col("text").alias("_text"))
    met = anchors.join(named, ["corpus_id", "unit_id", "span_id"], "left")
    start = F.col("_from") + nth_position(F.col("_text"), F.col("quote"), F.col("occurrence")) - 1
    return met.withColumn("start_char", start).withColumn("end_char", F.col("start_char") + F.length("quote")).drop("_from", "_text")


def attribute(located: DataFrame, chunks: DataFrame) -> DataFrame:
    """The earliest chunk that wholly contains each located span; adds chunk and section, null when none does.

    Chunks come as one list per position bucket, so every located row is met once and what located it runs once.
    """
    keys = ["corpus_id", "unit_id", "kind", "pos", "part"]
    holders = _covering(chunks.select("corpus_id", "chunk_order", "chunk_id", "section_order", "start_char", "end_char")).groupBy("corpus_id", "_bucket").agg(
        F.collect_list(F.struct("start_char", "end_char", F.struct("chunk_order", "chunk_id", "section_order").alias("chunk"))).alias("_held"))
    met = located.withColumn("_bucket", F.floor(F.col("start_char") / BUCKET)).join(holders, ["corpus_id", "_bucket"], "left")
    around = F.filter("_held", lambda h: (h["start_char"] <= F.col("start_char")) & (F.col("end_char") <= h["end_char"]))
    own = met.withColumn("_chunk", F.array_min(F.transform(around, lambda h: h["chunk"]))).select(*located.columns, "_chunk")
    best = own.repartition("corpus_id", "unit_id").withColumn("_chunk", F.min("_chunk").over(Window.partitionBy(*keys)))
    return best.select(*located.columns, "_chunk.chunk_order", "_chunk.chunk_id", "_chunk.section_order")


def anchor_rows(candidates: DataFrame, column: str, kind: str) -> DataFrame:
    return candidates.select("corpus_id", "unit_id", F.lit(kind).alias("kind"), "pos", F.posexplode(column).alias("part", "a")).select(
        "corpus_id", "unit_id", "kind", "pos", "part", "a.span_id", "a.quote", F.col("a.occurrence").cast("bigint").alias("occurrence"))


_SPAN = ["start_char", "end_char", "section_order", "chunk_id", "quote"]


UNIT = ["corpus_id", "unit_id"]


def _with_gathered(rows: DataFrame, placed: DataFrame, kind: str) -> DataFrame:
    """Adds the placed anchors of each candidate, ``spans``, and ``located``: whether every one was found. A unit's anchors travel as
    one list, so candidates, ends and windows all meet placed by unit."""
    found = F.col("chunk_id").isNotNull()
    each = placed.filter(F.col("kind") == kind).repartition(*UNIT).groupBy(*UNIT, "pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part", *_SPAN))), lambda s: F.struct(*[s[c].alias(c) for c in _SPAN])).alias("spans"),
        F.every(found).alias("located"))
    lists = each.groupBy(*UNIT).agg(F.collect_list(F.struct("pos", "spans", "located")).alias("_anchors"))
    own = F.get(F.filter("_anchors", lambda x: x["pos"] == F.col("pos")), F.lit(0))
    met = rows.join(lists, UNIT, "left").withColumn("_own", own)
    return met.select(*rows.columns, F.col("_own.spans").alias("spans"), F.col("_own.located").alias("located"))


def validate_entities(entities: DataFrame, placed: DataFrame) -> DataFrame:
    """Every mention located and equal to the name; among those the first of each local id is kept.

    Entities: corpus_id, unit_id, pos, local_id, type, name. Adds ``spans`` and ``valid``.
    """
    joined = _with_gathered(entities, placed, "entity")
    sound = F.coalesce(F.col("located") & F.forall("spans", lambda s: s["quote"] == F.col("name")), F.lit(False))
    first = F.row_number().over(Window.partitionBy("corpus_id", "unit_id", "local_id", "_sound").orderBy("pos")) == 1
    return joined.withColumn("_sound", sound).withColumn("valid", F.col("_sound") & first).drop("_sound", "located")


def _endpoints(rows: DataFrame, valid: DataFrame) -> DataFrame:
    ends = valid.groupBy(*UNIT).agg(F.collect_list(F.struct("local_id", "type", "name", "spans")).alias("_ends"))
    rows = rows.join(ends, UNIT, "left")
    for side in ("source", "target"):
        kept = [c for c in rows.columns if c != "_ends"]
        named = F.filter("_ends", lambda x: x["local_id"] == F.col(side))
        rows = rows.withColumn("_end", F.explode_outer(named)).select(
            *kept, "_ends", *[F.col(f"_end.{c}").alias(f"{side}_{c}") for c in ("type", "name", "spans")])
    return rows.drop("_ends")


def _in_core(spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start_char"] >= F.col("core_start")) & (s["start_char"] < F.col("core_end")))


def validate_relations(relations: DataFrame, valid_entities: DataFrame, placed: DataFrame, windows: DataFrame) -> DataFrame:
    """Status per relation: ``kept``, ``rejected``, or ``outside`` for pairs with nothing inside the core."""
    rows = _with_gathered(_endpoints(relations, valid_entities), placed, "relation")
    rows = rows.join(windows.select("corpus_id", "unit_id", "core_start", "core_end"), UNIT)
    sound = (allowed(F.col("type"), F.col("source_type"), F.col("target_type"))
             & (F.col("source") != F.col("target")) & F.coalesce("located", F.lit(False)))
    inside = _in_core(F.col("spans")) | _in_core(F.col("source_spans")) | _in_core(F.col("target_spans"))
    status = F.when(~F.coalesce(sound, F.lit(False)), "rejected").when(inside, "kept").otherwise("outside")
    return rows.withColumn("status", status).drop("located")


def validate_links(links: DataFrame, valid_entities: DataFrame, placed: DataFrame) -> DataFrame:
    """Identity links hold when both ends share a type and both names stand in the joined evidence."""
    rows = _with_gathered(_endpoints(links, valid_entities), placed, "link")
    text = F.array_join(F.transform("spans", lambda s: s["quote"]), "")
    valid = (F.col("located") & (F.col("source_type") == F.col("target_type"))
             & F.contains(text, F.col("source_name")) & F.contains(text, F.col("target_name")))
    return rows.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("located")


def rejection_counts(entities: DataFrame, relations: DataFrame, links: DataFrame) -> DataFrame:
    """Rejected candidates per unit and kind, pivoted; units without any are absent."""
    kind = lambda df, cond, name: df.filter(cond).select("corpus_id", "unit_id", F.lit(name).alias("kind"))
    every = (kind(entities, ~F.col("valid"), "entities").unionByName(kind(relations, F.col("status") == "rejected", "relations"))
             .unionByName(kind(links, ~F.col("valid"), "identity_links")))
    return (every.groupBy("corpus_id", "unit_id").pivot("kind", ["entities", "relations", "identity_links"])
            .count().fillna(0, ["entities", "relations", "identity_links"]))


def density(entities: DataFrame, relations: DataFrame, links: DataFrame, windows: DataFrame, mode: str = "full") -> DataFrame:
    """Distinct core entities, facts and links per unit and whether they saturate the window."""
    identity = lambda t, n, spans: F.to_json(F.struct(t.alias("t"), n.alias("n"), F.array_sort(F.transform(
        spans, lambda s: F.struct(s["start_char"].alias("a"), s["end_char"].alias("b")))).alias("s")))
    bounds = windows.select("corpus_id", "unit_id", "core_start", "core_end")
    keys = ["corpus_id", "unit_id"]
    own = (entities.filter("valid").join(bounds, keys).filter(_in_core(F.col("spans")))
           .groupBy(*keys).agg(F.count_distinct(identity(F.col("type"), F.col("name"), F.col("spans"))).alias("entities")))
    ends = lambda side: identity(F.col(f"{side}_type"), F.col(f"{side}_name"), F.col(f"{side}_spans"))
    facts = (relations.filter("status = 'kept'").groupBy(*keys).agg(F.count_distinct(
        F.struct(ends("source").alias("a"), "type", ends("target").alias("b"), "polarity", "statement_mode")).alias("relations")))
    same = (links.filter("valid").join(bounds, keys).filter(_in_core(F.col("spans"))).groupBy(*keys).agg(
        F.count_distinct(F.array_sort(F.array(ends("source"), ends("target")))).alias("identity_links")))
    out = bounds.join(own, keys, "left").join(facts, keys, "left").join(same, keys, "left").fillna(0, ["entities", "relations", "identity_links"])
    over = (lambda c, n: F.col(c) >= n) if mode == "compact" else (lambda c, n: F.col(c) > n)
    e, r, i = LIMITS[mode]
    return out.withColumn("saturated", over("entities", e) | over("relations", r) | over("identity_links", i))


def mention_contexts(mentions: DataFrame, chunks: DataFrame, before: int = 100, after: int = 150, first: int = 2) -> DataFrame:
    """Text around the first mentions of each entity, clipped to the chunk.

    Mentions: corpus_id, entity_key, part, chunk_id, start_char, end_char.
    """
    rank = F.row_number().over(Window.partitionBy("corpus_id", "entity_key").orderBy("part"))
    texts = chunks.select("corpus_id", "chunk_id", F.col("start_char").alias("_cs"), F.col("end_char").alias("_ce"), F.col("text").alias("_text"))
    rows = mentions.withColumn("_n", rank).filter(F.col("_n") <= first).drop("_n").join(texts, ["corpus_id", "chunk_id"])
    a = F.greatest(F.col("_cs"), F.col("start_char") - before)
    b = F.least(F.col("_ce"), F.col("end_char") + after)
    return (rows.withColumn("context_start", a).withColumn("context_end", b)
            .withColumn("context", cut(F.col("_text"), a - F.col("_cs"), b - F.col("_cs"))).drop("_cs", "_ce", "_text"))
