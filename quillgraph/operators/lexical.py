"""Query terms, tokens, inverted index, BM25 with phrase boosts, and the lexical ranking."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillgraph.functions.runtime import small_or_joined, stage
from quillgraph.functions.text import SPACE, collapse, fold, occurrences
from quillgraph.functions.udfs import character_pairs, parts

# BM25 parameters, boost weights, candidate and page bounds.
K1, B, EPSILON = 1.5, 0.75, 0.25
PHRASE_BOOST, TITLE_BOOST = 5.0, 2.0
CANDIDATES = 30
MAX_K = 20
HOT_RUN, SALTS = 100_000, 64
SCANNED_TERMS, BROADCAST_TERMS = 1_000, 100_000
SCANNED_ROWS = 1_024  # passages whose pairs with queries leave a task together
WORD = r"[\p{L}\p{N}]{2,}"

Words = Callable[[Column], Column]


def regex_words(text: Column) -> Column:
    """Default word source: letter and digit runs. Pass another function for a dictionary segmenter."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def folded(text: Column) -> Column:
    return fold(collapse(text))


def terms_of(query: Column) -> Column:
    whole = folded(query)
    return F.when(F.length(whole) > 0, F.array_distinct(F.concat(F.array(whole), F.split(whole, " "))))


def query_terms(queries: DataFrame) -> DataFrame:
    """Adds the term list, a clamped k and the error code of an empty query."""
    terms = terms_of(F.col("query"))
    return (queries.withColumn("terms", terms)
            .withColumn("k", F.least(F.greatest(F.col("k"), F.lit(1).cast("bigint")), F.lit(MAX_K).cast("bigint")))
            .withColumn("error", F.when(terms.isNull(), "empty_query")))


def with_tokens(df: DataFrame, text: Column, out: str, unique: bool = False, words: Words = regex_words) -> DataFrame:
    """Adds words of two or more characters, then the character pairs of every letter/digit/CJK run.

    Staged as columns: the folded text is used three times and must be computed once.
    """
    long_words = F.filter(words(F.col("_norm")), lambda w: F.length(w) >= 2) if words is not regex_words else words(F.col("_norm"))
    staged = df.withColumn("_norm", folded(text)).withColumn("_both", F.concat(long_words, character_pairs(F.col("_norm"))))
    whole = F.when((F.size("_both") == 0) & (F.length("_norm") > 0), F.array("_norm")).otherwise(F.col("_both"))
    return staged.withColumn(out, F.array_distinct(whole) if unique else whole).drop("_norm", "_both")


@dataclass
class Index:
    """Postings carry what ranking needs, so the passage text is not read again for scoring."""
    postings: DataFrame    # corpus_id, token, passage_id, tf, doc_length, section_order, start_char
    vocabulary: DataFrame  # corpus_id, token, df, idf, passages, mean_length

    def write(self, path: str, files_per_token_range: int | None = None) -> None:
        """Range-laid by token inside a corpus, so a reader's token filter prunes row groups."""
        for name, df in (("postings", self.postings), ("vocabulary", self.vocabulary)):
            laid = (df.repartitionByRange(files_per_token_range, "corpus_id", "token")
                    if files_per_token_range else df.repartitionByRange("corpus_id", "token"))
            laid.sortWithinPartitions("corpus_id", "token").write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark, path: str) -> Index:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vocabulary"))


def tokenized(passages: DataFrame, words: Words = regex_words) -> DataFrame:
    text = F.concat(F.col("text"), F.lit(" "), F.coalesce("section_title", F.lit("")))
    return (with_tokens(passages, text, "tokens", words=words)
            .select("corpus_id", "passage_id", "section_order", "start_char", "tokens", F.size("tokens").cast("bigint").alias("doc_length")))


def vocabulary_of(toks: DataFrame) -> DataFrame:
    """Document frequency and idf per corpus token; negative idf becomes a share of the mean idf."""
    # written: the mean below reads it as well, and would count all tokens again
    df = stage(toks.select("corpus_id", F.explode(F.array_distinct("tokens")).alias("token"))
               .groupBy("corpus_id", "token").agg(F.count("*").alias("df")), "frequency")
    size = toks.groupBy("corpus_id").agg(F.count("*").alias("passages"), F.avg("doc_length").alias("mean_length"))
    raw = df.join(size, "corpus_id").withColumn(
        "raw_idf", F.log(F.col("passages") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("corpus_id").agg(F.avg("raw_idf").alias("mean_idf"))
    return raw.join(mean, "corpus_id").select(
        "corpus_id", "token", "df", "passages", "mean_length",
        F.when(F.col("raw_idf") < 0, F.col("mean_idf") * EPSILON).otherwise(F.col("raw_idf")).alias("idf"))


def query_tokens(queries: DataFrame, words: Words = regex_words) -> DataFrame:
    return (with_tokens(queries, F.col("query"), "tokens", unique=True, words=words)
            .select("query_id", "corpus_id", F.explode("tokens").alias("token")))


def build_index(passages: DataFrame, words: Words = regex_words, wanted: DataFrame | None = None) -> Index:
    """The whole index, or with ``wanted`` (corpus_id, token) only the postings a query batch can touch.

    The vocabulary always covers every token: the mean idf depends on all of them. Passages are dealt before their tokens are
    listed, so that counting the tokens of a passage, and summing its scores later, moves nothing.
    """
    toks = stage(tokenized(passages, words), "tokens")
    placed = toks.repartition("corpus_id", "passage_id")
    rows = placed.select("corpus_id", "passage_id", "section_order", "start_char", "doc_length", F.explode("tokens").alias("token"))
    if wanted is not None:
        rows = rows.join(small_or_joined(wanted.select("corpus_id", "token").distinct(), "wanted"), ["corpus_id", "token"], "left_semi")
    postings = (rows.groupBy("corpus_id", "passage_id", "section_order", "start_char", "doc_length", "token")
                .agg(F.count("*").alias("tf")))
    return Index(postings, vocabulary_of(toks))


def bm25(queries: DataFrame, index: Index, words: Words = regex_words) -> DataFrame:
    """(query, passage) pairs that share a token, with the Okapi score summed over the query's unique tokens.

    The query side meets the vocabulary first, so idf travels with the few query tokens and the
    postings are joined once; the join is map-side whenever the query batch is small.
    """
    weighted = small_or_joined(query_tokens(queries, words).join(index.vocabulary, ["corpus_id", "token"]), "weighted")
    tf = F.col("tf")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_length") / F.col("mean_length")))
    return (index.postings.join(weighted, ["corpus_id", "token"])
            .groupBy("query_id", "corpus_id", "passage_id", "section_order", "start_char").agg(F.sum(part).alias("score")))


def runs_of(passages: DataFrame) -> DataFrame:
    """One row per blank-free run of a passage: in the text (kind 0), in the title (1), or where the two touch (2)."""
    texts = passages.select("corpus_id", "passage_id", "section_order", "start_char",
                            fold(F.col("text")).alias("_text"), fold(F.coalesce("section_title", F.lit(""))).alias("_title"))
    split = lambda c: F.filter(F.split(c, SPACE + "+"), lambda r: r != "")
    staged = texts.withColumn("_t", split(F.col("_text"))).withColumn("_s", split(F.col("_title")))
    touching = ~F.col("_text").rlike(SPACE + "$") & ~F.col("_title").rlike("^" + SPACE) & (F.size("_t") > 0) & (F.size("_s") > 0)
    kinds = lambda runs, kind: F.transform(runs, lambda r: F.struct(r.alias("run"), F.lit(kind).alias("kind")))
    both = F.array(F.concat(F.element_at("_t", -1), F.element_at("_s", 1)))
    tagged = F.concat(kinds(F.col("_t"), 0), kinds(F.col("_s"), 1), F.when(touching, kinds(both, 2)).otherwise(F.array().cast("array<struct<run:string,kind:int>>")))
    return staged.select("corpus_id", "passage_id", "section_order", "start_char", F.inline(tagged))


def _pieces(c: Column, lengths: tuple[int, ...]) -> Column:
    """All pieces of the given lengths, overlapping ones too; linear in the run."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]))


def runs_with_terms(terms: DataFrame, runs: DataFrame) -> DataFrame:
    """terms(corpus_id, term), distinct and without blanks; runs(corpus_id, run, n), distinct -> (corpus_id, run, n, term, found):
    the runs that hold a term, and how often.

    A term of up to three characters is its own key, a longer one is met on that of its pieces of three which the fewest runs
    hold; a term with a piece that no run holds is nowhere. Runs meet the key pieces alone, and ``contains`` has the last word.
    """
    own = F.when(F.length("term") <= 3, F.array("term")).otherwise(_pieces(F.col("term"), (3,)))
    asked = stage(terms.withColumn("pieces", own), "terms")
    wanted = small_or_joined(asked.select("corpus_id", F.explode("pieces").alias("piece")).distinct(), "wanted")
    lengths = tuple(r[0] for r in wanted.select(F.length("piece")).distinct().collect())  # one to three
    pieces = F.explode(_pieces(F.col("run"), lengths or (1,))).alias("piece")
    counts = runs.select("corpus_id", pieces).join(wanted, ["corpus_id", "piece"], "left_semi").groupBy("corpus_id", "piece").agg(F.count("*").alias("runs"))
    rarest = (asked.select("corpus_id", "term", F.size("pieces").alias("of"), F.explode("pieces").alias("piece")).join(counts, ["corpus_id", "piece"])
              .groupBy("corpus_id", "term", "of").agg(F.min(F.struct("runs", "piece")).alias("key"), F.count("*").alias("present"))
              .filter("present = of").select("corpus_id", "term", F.col("key.piece").alias("piece")))
    # pieces are cut twice, so that a run is laid out for the pieces that are keys alone; where these are few its terms stay in one place
    return (runs.repartition("corpus_id", "run").select("corpus_id", "run", "n", pieces).join(small_or_joined(rarest, "rarest"), ["corpus_id", "piece"]).filter(F.contains("run", F.col("term")))
            .select("corpus_id", "run", "n", "term", occurrences(F.col("run"), F.col("term")).alias("found")))


def _spread(rows: DataFrame, weights: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join on (corpus_id, run) with a salt. Runs with a thousandth of all rows, so at most a thousand, are dealt by
    passage to ``SALTS`` places; their weights go to each of them."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.filter((F.col("n") * 1_000 >= total) & (F.col("n") >= HOT_RUN)).select("corpus_id", "run", F.lit(SALTS).alias("_of")))
    salted = lambda df: df.join(hot, ["corpus_id", "run"], "left").fillna(1, ["_of"])
    left = salted(rows).withColumn("salt", F.pmod(F.xxhash64("passage_id"), F.col("_of")).cast("int")).drop("_of")
    return left, salted(weights).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_of") - 1))).drop("_of")


def boosts(queries: DataFrame, passages: DataFrame, scanned: int = SCANNED_TERMS) -> DataFrame:
    """Literal counts of the terms in text and title. A one-term query counts its term once more.

    Only pairs with at least one contained term come out. Where a corpus is asked for few terms, reading its passages once for all of
    them is cheapest: their queries are broadcast, if all together are few as well. The other corpora are searched through their runs.
    """
    asked = stage(queries.select("query_id", "corpus_id", terms_of(F.col("query")).alias("terms")).filter(F.col("terms").isNotNull()), "asked")
    sizes = asked.groupBy("corpus_id").agg(F.sum(F.size("terms")).alias("n"))
    counted = sizes.agg(F.coalesce(F.sum(F.when(F.col("n") <= scanned, F.col("n"))), F.lit(0)).alias("few"), F.count(F.when(F.col("n") > scanned, 1)).alias("large")).first()
    if counted["few"] > BROADCAST_TERMS:
        return indexed_boosts(asked, passages)
    if not counted["large"]:
        return scanned_boosts(asked, passages)
    few = sizes.filter(F.col("n") <= scanned).select("corpus_id")
    return scanned_boosts(asked.join(few, "corpus_id", "left_semi"), passages).unionByName(indexed_boosts(asked.join(few, "corpus_id", "left_anti"), passages))


def scanned_boosts(asked: DataFrame, passages: DataFrame) -> DataFrame:
    """asked(query_id, corpus_id, terms) of bounded size against every passage of its corpus, where the passages lie."""
    keys = ["corpus_id", "passage_id", "section_order", "start_char"]
    texts = (passages.join(F.broadcast(asked.select("corpus_id").distinct()), "corpus_id", "left_semi")
             .select(*keys, fold(F.col("text")).alias("text"), fold(F.coalesce("section_title", F.lit(""))).alias("title")))
    ids: list = []
    by_corpus: dict = {}  # of each corpus its terms, with the queries that ask for them and the weights of a place in text and title
    for r in asked.collect():
        for t in r["terms"]:
            once = 0.0 if not t else PHRASE_BOOST + 1 if len(r["terms"]) == 1 else PHRASE_BOOST if t == r["terms"][0] else 1.0
            by_corpus.setdefault(r["corpus_id"], {}).setdefault(t, []).append((len(ids), once, once + TITLE_BOOST if t else 0.0))
        ids.append(r["query_id"])
    out = T.StructType([asked.schema["query_id"], *[texts.schema[k] for k in keys], T.StructField("score", T.DoubleType())])
    id_type = to_arrow_type(asked.schema["query_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
                own = batch.slice(part.start, part.stop - part.start)
                of_corpus: dict = {}
                for i, corpus in enumerate(own.column("corpus_id").to_pylist()):
                    of_corpus.setdefault(corpus, []).append(i)
                texts, titles = own.column("text").to_pylist(), own.column("title").to_pylist()
                for corpus, places in of_corpus.items():
                    for first in range(0, len(places), SCANNED_ROWS):
                        block = [i for i in places[first:first + SCANNED_ROWS] if texts[i] is not None]
                        at, asker, score = [], [], []
                        for i, sums in zip(block, _scan(by_corpus[corpus], [texts[i] for i in block], [titles[i] for i in block])):
                            at += [i] * len(sums)
                            asker += [ids[q] for q in sums]
                            score += sums.values()
                        rows = pa.array(at, pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(asker, id_type), *[own.column(k).take(rows) for k in keys], pa.array(score, pa.float64())], names=out.names)
    return texts.mapInArrow(run, out)


def _scan(terms: dict, texts: list[str], titles: list[str]) -> list[dict[int, float]]:
    """Per passage the scores of the queries with a term in the text, in the title or across both. A term is looked for once for all
    who ask for it, and passage by passage only where the passages together hold it."""
    both = [text + title for text, title in zip(texts, titles)]
    sums: list[dict[int, float]] = [{} for _ in both]
    together = "\n".join(both)
    for t, askers in terms.items():
        if t in together:
            for whole, text, title, own in zip(both, texts, titles, sums):
                if t in whole:
                    n, m = text.count(t), title.count(t)
                    for q, in_text, in_title in askers:
                        own[q] = own.get(q, 0.0) + n * in_text + m * in_title
    return sums


def indexed_boosts(asked: DataFrame, passages: DataFrame) -> DataFrame:
    """The same pairs for any number of terms, without meeting others: a term without blanks lies inside a run without blanks, so
    terms are looked for in the distinct runs of a corpus, once each, and runs lead to passages. A phrase lies where each of its
    words does; pairs that hold its rarest word are compared with the text.
    """
    asked = stage(asked, "asked")
    searched = passages.join(asked.select("corpus_id").distinct(), "corpus_id", "left_semi")
    rows = stage(runs_of(searched), "runs")
    words = asked.select("query_id", "corpus_id", F.size("terms").alias("of"), F.explode(F.filter("terms", lambda t: ~F.contains(t, F.lit(" ")))).alias("term"))
    distinct = stage(rows.groupBy("corpus_id", "run").agg(F.count("*").alias("n")), "distinct-runs")
    # a run's terms, and then its queries, travel as one list: the run is spelled out once a step, not for each of them
    matched = stage(runs_with_terms(words.select("corpus_id", "term").distinct(), distinct).groupBy("corpus_id", "run", "n")
                    .agg(F.collect_list(F.struct("term", "found")).alias("held")), "matched")
    frequency = matched.select("corpus_id", "n", F.inline("held")).groupBy("corpus_id", "term").agg(F.sum("n").alias("n"))
    rarest = (words.filter("of > 1").join(frequency, ["corpus_id", "term"], "left").groupBy("query_id")
              .agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("rarest")))
    alone = F.col("of") == 1
    in_text, in_title = F.when(alone, PHRASE_BOOST + 1).otherwise(1.0), F.when(alone, PHRASE_BOOST + 1 + TITLE_BOOST).otherwise(1.0 + TITLE_BOOST)
    askers = small_or_joined(words.join(rarest, "query_id", "left").select("query_id", "corpus_id", "term", in_text.alias("in_text"), in_title.alias("in_title"),
                             F.coalesce(F.col("term") == F.col("rarest"), F.lit(False)).alias("phrase")), "askers")
    weights = (matched.repartition("corpus_id", "run").select("corpus_id", "run", F.inline("held")).join(askers, ["corpus_id", "term"]).groupBy("corpus_id", "run", "query_id")
               .agg(F.sum(F.col("found") * F.col("in_text")).alias("text_weight"), F.sum(F.col("found") * F.col("in_title")).alias("title_weight"), F.max("phrase").alias("phrase"))
               .groupBy("corpus_id", "run").agg(F.collect_list(F.struct("query_id", "text_weight", "title_weight", "phrase")).alias("weights")))
    left, right = _spread(rows, stage(weights, "weights"), distinct)
    keys = ["query_id", "corpus_id", "passage_id", "section_order", "start_char"]
    part = F.when(F.col("kind") == 0, F.col("text_weight")).when(F.col("kind") == 1, F.col("title_weight")).otherwise(0.0)
    each = left.join(right, ["corpus_id", "run", "salt"]).select(*keys[1:], "kind", F.inline("weights"))
    pairs = each.groupBy(*keys).agg(F.sum(part).alias("score"), F.max("phrase").alias("phrase"))
    held = stage(pairs, "pairs")
    whole = F.col("terms")[0]
    phrased = (held.filter("phrase").join(searched.select("corpus_id", "passage_id", "text", "section_title"), ["corpus_id", "passage_id"])
               .join(asked.select("query_id", "terms"), "query_id")
               .withColumn("_text", fold(F.col("text"))).withColumn("_title", fold(F.coalesce("section_title", F.lit("")))).select(*keys, (F.col("score") + occurrences(F.col("_text"), whole) * PHRASE_BOOST + occurrences(F.col("_title"), whole) * (PHRASE_BOOST + TITLE_BOOST)).alias("score")))
    return held.filter("not phrase").select(*keys, "score").unionByName(phrased)


def lexical_scores(queries: DataFrame, passages: DataFrame, index: Index | None = None, words: Words = regex_words) -> DataFrame:
    """Candidates share a token with the query or contain one of its terms; everything else scores nothing."""
    passages = stage(passages.select("corpus_id", "passage_id", "section_order", "start_char", "section_title", "text"), "passages")
    index = index or build_index(passages, words, query_tokens(queries, words))
    keys = ["query_id", "corpus_id", "passage_id", "section_order", "start_char"]
    return (bm25(queries, index, words).unionByName(boosts(queries, passages))
            .groupBy(*keys).agg(F.sum("score").alias("score")))


def section_scope(queries: DataFrame, sections: DataFrame) -> DataFrame:
    """Resolves inclusive section bounds to orders; unknown ids and reversed ranges become error codes."""
    known = sections.select("corpus_id", "section_id", "section_order")
    side = lambda name, out: known.select("corpus_id", F.col("section_id").alias(name), F.col("section_order").alias(out))
    resolved = (queries.join(side("start_section_id", "scope_from"), ["corpus_id", "start_section_id"], "left")
                .join(side("end_section_id", "scope_to"), ["corpus_id", "end_section_id"], "left"))
    code = (F.when(F.col("start_section_id").isNotNull() & F.col("scope_from").isNull(), "unknown_start_section")
            .when(F.col("end_section_id").isNotNull() & F.col("scope_to").isNull(), "unknown_end_section")
            .when(F.col("scope_from") > F.col("scope_to"), "reversed_range"))
    return resolved.withColumn("scope_error", code)


def in_scope(order: Column) -> Column:
    return ((F.col("scope_from").isNull() | (order >= F.col("scope_from")))
            & (F.col("scope_to").isNull() | (order <= F.col("scope_to"))))


def lexical_ranking(scores: DataFrame, scoped_queries: DataFrame | None = None, limit: int = CANDIDATES) -> DataFrame:
    """Top candidates per query, the section filter applied after corpus-wide scoring.

    Scores are compared at nine decimals: a distributed sum has no fixed order of additions.
    """
    if scoped_queries is not None:
        bounds = scoped_queries.filter(F.col("scope_error").isNull()).select("query_id", "scope_from", "scope_to")
        scores = scores.join(bounds, "query_id").filter(in_scope(F.col("section_order"))).drop("scope_from", "scope_to")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "start_char", "passage_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
