"""Rank fusion, diversity, hits, hybrid search, reading context and quote checks."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import cut, fold, let, strip
from quillgraph.operators import dense, lexical

RRF_K = 60
PER_SECTION = 2
SNIPPET, SNIPPET_LEAD = 600, 120


def rrf(*rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """Sum of reciprocal ranks; each ranking brings query_id, corpus_id, passage_id, start_char, rank."""
    keys = ["query_id", "corpus_id", "passage_id", "start_char"]
    merged = None
    for r in rankings:
        part = r.select(*keys, "rank")
        merged = part if merged is None else merged.unionByName(part)
    fused = merged.groupBy(*keys).agg(F.sum(1.0 / (F.col("rank") + k)).alias("fused"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("fused", 12)), "start_char", "passage_id")
    return fused.withColumn("fused_rank", F.row_number().over(order))


def diversify(fused: DataFrame, passages: DataFrame, queries: DataFrame) -> DataFrame:
    """Best passage per parent chunk; at most two per section first, then back-fill in fused order up to k."""
    placed = fused.join(passages.select("corpus_id", "passage_id", "parent_chunk_id", "section_id"), ["corpus_id", "passage_id"])
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("fused_rank"))
    parents = placed.withColumn("_p", rank("query_id", "parent_chunk_id")).filter("_p = 1").drop("_p")
    spread = parents.withColumn("_late", rank("query_id", "section_id") > PER_SECTION)
    final = F.row_number().over(Window.partitionBy("query_id").orderBy("_late", "fused_rank"))
    return (spread.withColumn("position", final).join(queries.select("query_id", "k"), "query_id")
            .filter(F.col("position") <= F.col("k")).drop("_late", "k"))


def hits(selected: DataFrame, passages: DataFrame, queries: DataFrame) -> DataFrame:
    """Texts are joined last, for the selected rows only."""
    texts = passages.select("corpus_id", "passage_id", "section_title", "start_line", "end_line", "text")
    rows = selected.join(texts, ["corpus_id", "passage_id"]).join(
        queries.select("query_id", lexical.terms_of(F.col("query")).alias("terms")), "query_id")
    haystack = fold(F.concat("text", F.lit(" "), F.coalesce("section_title", F.lit(""))))
    rows = rows.withColumn("matched", let(haystack, lambda h: F.filter("terms", lambda t: F.contains(h, t))))
    body = strip(F.col("text"))
    wanted = F.when(F.size("matched") > 0, F.col("matched")).otherwise(F.col("terms"))
    rows = rows.withColumn("_body", body).withColumn("_wanted", wanted)
    first = let(fold(F.col("_body")), lambda f: F.array_min(F.filter(F.transform("_wanted", lambda t: F.instr(f, t) - 1), lambda p: p >= 0)))
    start = F.greatest(F.lit(0), F.coalesce(first, F.lit(0)) - SNIPPET_LEAD)
    around = strip(cut(F.col("_body"), start, start + SNIPPET))
    snippet = F.when(F.length("_body") <= SNIPPET, F.col("_body")).otherwise(around)
    return rows.select("query_id", "position", "corpus_id", "passage_id", F.col("parent_chunk_id").alias("chunk_id"), "section_id",
                       "section_title", "start_line", "end_line", F.round(F.col("fused") * 1000, 6).alias("score"),
                       F.col("matched").alias("matched_terms"), snippet.alias("snippet"))


def hybrid_search(queries: DataFrame, passages: DataFrame, vectors: DataFrame | None = None,
                  index: lexical.Index | None = None) -> tuple[DataFrame, DataFrame]:
    """Fused search where a corpus' vectors are usable, lexical search elsewhere.

    Queries: query_id, corpus_id, query, vector, k, scope_from, scope_to, scope_error.
    Returns (hits, fallback events).
    """
    asked = lexical.query_terms(queries).filter(F.col("error").isNull() & F.col("scope_error").isNull())
    words = lexical.lexical_ranking(lexical.lexical_scores(asked, passages, index), asked)
    rankings = [words]
    if vectors is None:
        status = asked.select("corpus_id").distinct().withColumn("usable", F.lit(False)).withColumn("reason", F.lit("not_configured"))
        dim = asked.select("corpus_id").distinct().withColumn("min_dim", F.lit(0).cast("bigint"))
    else:
        checked = dense.validate_vectors(vectors, passages)
        status, dim = checked.select("corpus_id", "usable", "reason"), checked.select("corpus_id", "min_dim")
        able = checked.filter("usable").select("corpus_id")
        rankings.append(dense.dense_ranking(asked.join(able, "corpus_id"),
                                            dense.normalize_vectors(vectors).join(able, "corpus_id")))
    chosen = diversify(rrf(*rankings), passages, asked)
    notes = asked.join(status, "corpus_id", "left").join(dim, "corpus_id", "left")
    code = (F.when(~F.coalesce("usable", F.lit(False)), "bm25_fallback")
            .when(F.size("vector") != F.col("min_dim"), "embedding_dimension_mismatch"))
    events = notes.withColumn("code", code).filter(F.col("code").isNotNull()).select("query_id", "corpus_id", "code", "reason")
    return hits(chosen, passages, asked), events


def read_context(requests: DataFrame, chunks: DataFrame, most: int = 5) -> DataFrame:
    """A chunk with its neighbours in corpus order, across sections; unknown ids give one error row."""
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(most))
    at = chunks.select("corpus_id", "chunk_id", F.col("chunk_order").alias("_at"))
    found = requests.join(at, ["corpus_id", "chunk_id"], "left")
    wanted = (found.filter(F.col("_at").isNotNull())
              .withColumn("chunk_order", F.explode(F.sequence(F.col("_at") - clamp("before"), F.col("_at") + clamp("after"))))
              .select("request_id", "corpus_id", "chunk_order"))
    rows = wanted.join(chunks, ["corpus_id", "chunk_order"]).select(
        "request_id", "corpus_id", "chunk_order", "chunk_id", "section_id", "text", F.lit(None).cast("string").alias("error"))
    missing = found.filter(F.col("_at").isNull()).select(
        "request_id", "corpus_id", F.lit(None).cast("bigint").alias("chunk_order"), "chunk_id",
        F.lit(None).cast("string").alias("section_id"), F.lit(None).cast("string").alias("text"), F.lit("unknown_chunk").alias("error"))
    return rows.unionByName(missing)


def read_section(requests: DataFrame, chunks: DataFrame, most: int = 5) -> DataFrame:
    """Chunks [start, start+limit) of a section; limit is held to 1..most."""
    limit = F.least(F.greatest(F.col("limit"), F.lit(1)), F.lit(most))
    wanted = requests.filter(F.col("start_chunk") >= 0).withColumn(
        "chunk_in_section", F.explode(F.sequence(F.col("start_chunk"), F.col("start_chunk") + limit - 1)))
    return wanted.select("request_id", "corpus_id", "section_id", "chunk_in_section").join(
        chunks, ["corpus_id", "section_id", "chunk_in_section"])


def verify_quotes(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """A quote holds when its trimmed, non-blank text stands literally in its chunk."""
    trimmed = strip(F.col("quote"))
    texts = chunks.select("corpus_id", "chunk_id", F.col("text").alias("_text"))
    return quotes.join(texts, ["corpus_id", "chunk_id"], "left").withColumn(
        "valid", F.coalesce((F.length(trimmed) > 0) & F.contains(F.col("_text"), trimmed), F.lit(False))).drop("_text")


def retrieval_status(events: DataFrame, recent: int = 50) -> tuple[DataFrame, DataFrame]:
    """Counters per corpus and the latest events.

    Events: corpus_id, sequence, kind (document, query, cache_hit, fallback, progress), texts, characters,
    elapsed_seconds, failed, completed, total, code.
    """
    kind = lambda k: F.col("kind") == k
    total = lambda cond, col: F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0)).cast("bigint")
    request = kind("document") | kind("query")
    counters = events.groupBy("corpus_id").agg(
        F.count_if(kind("document")).alias("document_request_count"),
        total(kind("document"), "texts").alias("document_text_count"),
        total(kind("document"), "characters").alias("document_input_characters"),
        F.count_if(kind("query")).alias("query_request_count"),
        total(kind("query"), "characters").alias("query_input_characters"),
        F.count_if(kind("cache_hit")).alias("query_cache_hit_count"),
        F.count_if(request & F.col("failed")).alias("failed_request_count"),
        F.count_if(kind("fallback")).alias("fallback_count"),
        F.round(F.max_by("elapsed_seconds", F.when(request, F.col("sequence"))), 3).alias("last_request_elapsed_seconds"),
        F.max_by("completed", F.when(kind("progress"), F.col("sequence"))).alias("completed"),
        F.max_by("total", F.when(kind("progress"), F.col("sequence"))).alias("total"))
    percent = F.when(F.coalesce("total", F.lit(0)) == 0, 100).otherwise(F.bround(F.col("completed") * 100.0 / F.col("total"), 0))
    counters = counters.withColumn("percentage", percent.cast("bigint"))
    last = Window.partitionBy("corpus_id").orderBy(F.desc("sequence"))
    history = (events.filter(F.col("code").isNotNull()).withColumn("age", F.row_number().over(last))
               .filter(F.col("age") <= recent))
    return counters, history
