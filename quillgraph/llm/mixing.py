"""Mixing sources to target weights: exact block quotas, dealt to output shards by a multivariate-hypergeometric splitting tree.

The documents of a source, in a fixed random order, lie end to end on a line of words, twice over; the mix takes the line up to the
source's target, so no document is taken more than twice and every source meets its target to the word. The line is cut into
blocks. A binary tree splits the block quotas of all sources at once: each node draws how many blocks of every source go left,
as if the node's blocks had been shuffled. A shard then owns a run of blocks of each source and orders them by a hash.
"""
from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.functions.runtime import stage
from quillgraph.llm.common import small_or_joined
from quillgraph.llm.words import BLANKS

WEIGHTS = (3, 1, 2)
SHARE, CEILING = 1.5, 2
SHARDS = 16
BLOCK_WORDS = 1_024
MOST_BLOCKS = 500_000_000  # numpy's exact hypergeometric draw ends at 1e9; larger mixes get longer blocks


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text; null: 0), order: the fixed random place, a digest of the id."""
    squeezed = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), f"^{BLANKS}+|{BLANKS}+$", "")
    size = F.when(squeezed == "", F.lit(0)).otherwise(F.size(F.split(squeezed, f"{BLANKS}+"))).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"),
                       F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("order"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, target): shares by weight, no source above ``ceiling`` times its size. Sources sorted by how soon they
    reach the ceiling: those that do are a prefix, the rest divides what is left."""
    sums = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn % len(weights))
    w = sums.withColumn("w", weight).withColumn("most", (F.col("source_size") * ceiling).cast("double"))
    soon = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = soon.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    free = w.withColumn("level", level).withColumn("free", F.col("most") > F.col("level") * F.col("w"))
    final = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("w"), "level")))
    return (free.withColumn("cut", final.over(every)["level"])
            .select("source", F.col("source_size").cast("long").alias("source_size"), F.when(F.col("free"), F.col("w") * F.col("cut")).otherwise(F.col("most")).alias("target")))


def _split(seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        node, shards = int(key[0]), int(rows["shards"].iloc[0])
        counts, lefts = rows["blocks"].to_numpy(np.int64), shards // 2
        total = int(counts.sum())
        draw, rng = total * lefts // shards, np.random.default_rng([seed, node])
        left = np.zeros(len(counts), np.int64)
        for i, c in enumerate(counts):  # one marginal after the other
            total -= int(c)
            left[i] = rng.hypergeometric(c, total, draw) if draw and c else 0
            draw -= int(left[i])
        one = rows.assign(node=2 * node, shards=lefts, blocks=left)
        other = rows.assign(node=2 * node + 1, shards=shards - lefts, blocks=counts - left, first=rows["first"] + left, low=rows["low"] + lefts)
        return pd.concat([one, other])[["node", "rank", "source", "low", "shards", "first", "blocks"]]
    return run


def deal(quotas: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """quotas (source, blocks) -> (source, shard, first, blocks): runs of blocks, disjoint, that use each quota up. A node of the tree
    holds one row per source, so a task's input is the number of sources, whatever the corpus."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    rows = quotas.select(F.lit(1).cast("long").alias("node"), rank.cast("long").alias("rank"), "source", F.lit(0).cast("long").alias("low"),
                         F.lit(shards).cast("long").alias("shards"), F.lit(0).cast("long").alias("first"), F.col("blocks").cast("long").alias("blocks"))
    for _ in range((shards - 1).bit_length()):
        split = rows.filter("shards > 1").groupBy("node").applyInPandas(_split(seed), rows.schema)
        rows = split.unionByName(rows.filter("shards = 1"))
    return rows.select("source", F.col("low").alias("shard"), "first", "blocks").filter("blocks > 0")


def plan(docs: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, **how) -> DataFrame:
    """Every input row as doc_id, source, size, source_size, target, taken and pieces: what each shard takes of it, as
    (shard, place, copy, start, words), place being the order inside the shard.

    Null and blank texts have size 0 and are never taken. A null source is a source, the last one. Rows with a null doc_id share one
    place in the order; ties are ordered by id and size, and repeated rows follow each other. All sizes 0: all targets 0.
    Reruns give the same mix. An empty table gives no rows; other columns are dropped.
    """
    sizes = stage(sized(docs), "sizes")
    goal = stage(targets(sizes, **how), "targets")
    total = goal.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    length = max(block_words, int(total // MOST_BLOCKS) + 1)
    dealt = stage(deal(goal.select("source", F.ceil(F.floor("target") / length).alias("blocks")), shards), "dealt")
    # Prefix sums of a hot source: summed per slice of the order first, so no task holds a whole source.
    sliced = sizes.withColumn("slice", F.substring("order", 1, 3))
    slices = sliced.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    upto = slices.select(F.col("source").alias("_s"), F.col("slice").alias("_c"), F.coalesce(F.sum("n").over(
        W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.sum("size").over(W.partitionBy("source", "slice").orderBy("order", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = (sliced.withColumn("own", own).join(small_or_joined(upto), F.col("source").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("_c")))
              .withColumn("at", F.col("base") + F.col("own")).select("doc_id", "source", "size", "at"))
    runs = dealt.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("first", "blocks", "shard"))).alias("runs"))
    known = goal.join(runs.withColumnRenamed("source", "_r"), F.col("source").eqNullSafe(F.col("_r")), "left").drop("_r").withColumnRenamed("source", "_s")
    joined = placed.join(small_or_joined(known), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    def pieces(copy: int):
        start = F.col("at") + copy * F.col("source_size")
        stop = F.least(start + F.col("size"), F.floor("target"))
        some = F.filter("runs", lambda r: (r["first"] * length < stop) & ((r["first"] + r["blocks"]) * length > start))
        blocks = F.flatten(F.transform(some, lambda r: F.transform(F.sequence(
            F.greatest(r["first"], F.floor(start / length)), F.least(r["first"] + r["blocks"], F.ceil(stop / length)) - 1), lambda b: F.struct(r["shard"].alias("shard"), b.alias("b")))))
        cut = F.transform(blocks, lambda x: F.struct(
            x["shard"].alias("shard"), F.xxhash64(F.lit("block"), F.col("source"), x["b"]).alias("place"), F.lit(copy).alias("copy"),
            (F.greatest(start, x["b"] * length) - start).alias("start"), (F.least(stop, (x["b"] + 1) * length) - F.greatest(start, x["b"] * length)).alias("words")))
        return F.when((F.col("size") > 0) & (stop > start), cut).otherwise(F.array().cast("array<struct<shard:bigint,place:bigint,copy:int,start:bigint,words:bigint>>"))
    out = joined.withColumn("pieces", F.concat(*[pieces(c) for c in range(how.get("ceiling", CEILING))]))
    return out.select("doc_id", "source", "size", "source_size", "target", F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["words"]).alias("taken"), "pieces")


def mixed(plan_rows: DataFrame) -> DataFrame:
    """The mix itself, a row per piece; each shard is sorted by (place, copy, doc_id) inside its own partition."""
    rows = plan_rows.select("doc_id", "source", F.explode("pieces").alias("p")).select("doc_id", "source", "p.*")
    return rows.repartition("shard").sortWithinPartitions("shard", "place", "copy", "doc_id")
