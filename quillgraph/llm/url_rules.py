"""URL rules found through their rarest literal token, in DataFrame functions only.

Every rule has an expression and the literal tokens (runs of a-z, 0-9) that any URL it fits must hold as whole tokens. Counted over
all URLs, the rarest of them becomes the key of the rule. The tokens of a URL fetch the rules with those keys, and only these run
their expressions. A rule without such a token is kept under the empty key, which every URL looks up.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import free_names

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLACE_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
# Pattern language: * any run, ^ a character other than a-z and 0-9 or an end, all else literal; found anywhere after "://".
PATTERN_RULES = [("^casino-*.", "block"), ("^cheap-pills.", "block"), ("^adult-*.", "block"), ("^poker-*.", "block"), (".exe^", "block")]


def fold(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return fold(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, places: list[tuple[str, str]] = PLACE_RULES, patterns: list[tuple[str, str]] = PATTERN_RULES) -> DataFrame:
    rows = [(r, v, True) for r, v in places] + [(r, v, False) for r, v in patterns]
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("place")) for r, v, p in rows])
    return spark.range(1).select(F.inline(listed))


def compiled(rules: DataFrame) -> DataFrame:
    """Adds the expression and the literal tokens of each rule. A place rule ``host/path`` fits the host and its subdomains if the
    path begins with the rule's, so its last path token may go on in the URL and is no literal token."""
    quoted = lambda c: F.regexp_replace(c, r"([^A-Za-z0-9*^])", r"\\$1")
    host, path = F.regexp_extract("rule", "^[^/]*", 0), F.regexp_extract("rule", "/.*$", 0)
    place = F.concat(F.lit(r"^(?:[^/]*\.)?"), quoted(host), quoted(path))
    pattern = F.replace(F.replace(quoted(F.col("rule")), F.lit("^"), F.lit("(?:^|[^a-z0-9]|$)")), F.lit("*"), F.lit("[^ ]*"))
    own = F.when(F.col("place"), F.concat(F.regexp_extract_all(host, F.lit("[a-z0-9]+"), 0), F.regexp_extract_all(fold(path), F.lit("[a-z0-9]+(?=[^a-z0-9])"), 0)))
    return rules.withColumn("expression", F.when(F.col("place"), place).otherwise(pattern)).withColumn(
        "tokens", own.otherwise(F.regexp_extract_all("rule", F.lit("(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), 0)))


def url_tokens(urls: DataFrame) -> DataFrame:
    """(url, token): each distinct token of a URL once, and the empty key."""
    rest = F.regexp_extract("url", r"://([\s\S]*)$", 1)
    tokens = F.array_distinct(F.concat(F.regexp_extract_all(fold(rest), F.lit("[a-z0-9]+"), 0), F.array(F.lit(""))))
    return urls.select("url", F.explode(tokens).alias("token"))


def rule_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row per rule, keyed by that of its tokens which the fewest URLs hold (ties: the smaller token)."""
    listed = compiled(rules)
    wanted = listed.select(F.explode("tokens").alias("token")).distinct()
    counts = tokens.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rare = (listed.select("rule", "place", F.explode("tokens").alias("token")).join(counts, "token", "left")
            .groupBy("rule", "place").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")))
    return listed.drop("tokens").join(rare, ["rule", "place"], "left").fillna("", ["token"])


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Every input row with host, path, rule (the longest place rule that fits, ties by text; else null), pattern (the first
    pattern that fits by text; else null) and verdict: the rule's, else block if a pattern says so, else allow.

    A URL that is null or lacks ``://`` has an empty host and path, fits nothing and is allowed. Repeated URLs are judged once and
    joined back; ids play no part. Very long URLs are judged whole. Columns named like a result are replaced, all others are kept,
    whatever their names. An empty table gives no rows.
    """
    given = pages.drop("host", "path", "rule", "pattern", "verdict")
    urls = given.select(F.col("url").cast("string").alias("url")).filter(F.col("url").contains("://")).distinct()
    tokens = url_tokens(urls)
    index = rule_index(rules, tokens)
    subject = F.when(F.col("place"), F.concat(host_of(F.col("url")), path_of(F.col("url")))).otherwise(fold(F.regexp_extract("url", r"://([\s\S]*)$", 1)))
    fits = tokens.join(index, "token").filter(F.regexp_like(subject, F.col("expression")))
    best = fits.groupBy("url").agg(
        F.min(F.when(F.col("place"), F.struct((-F.length("rule")).alias("n"), "rule", "verdict"))).alias("_p"),
        F.min(F.when(~F.col("place"), F.struct("rule", "verdict"))).alias("_q"))
    key, placed, met = free_names(given, "_url", "_p", "_q")
    best = best.select(F.col("url").alias(key), F.col("_p").alias(placed), F.col("_q").alias(met))
    url = F.col("url").cast("string")
    return (given.join(best, url == F.col(key), "left").withColumns({
        "host": host_of(url), "path": path_of(url), "rule": F.col(placed)["rule"], "pattern": F.col(met)["rule"],
        "verdict": F.coalesce(F.col(placed)["verdict"], F.col(met)["verdict"], F.lit("allow"))}).drop(key, placed, met))
