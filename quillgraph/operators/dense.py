"""Vector checks, normalisation, exact nearest neighbours in blocks, and the embedding job."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DENSE_CANDIDATES = 30
BLOCK_ROWS = 4096
QUERY_ROWS = 256  # queries whose scores against a block are held at once
BATCH_SIZE = 10
ATTEMPTS = 3


def _norm(col: str):
    return F.sqrt(F.aggregate(col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalize_vectors(vectors: DataFrame) -> DataFrame:
    """Unit rows in double precision; zero and non-finite vectors become null."""
    norm = _norm("embedding")
    unit = F.transform("embedding", lambda x: x.cast("double") / norm)
    return vectors.withColumn("embedding", F.when((norm > 0) & ~F.isnan(norm) & (norm < float("inf")), unit))


def validate_vectors(vectors: DataFrame, passages: DataFrame) -> DataFrame:
    """Per corpus: do the vectors cover the passages, share one dimension, and hold finite non-zero rows?"""
    sound = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    stats = vectors.groupBy("corpus_id").agg(
        F.count("*").alias("vectors"), F.min(F.size("embedding")).cast("bigint").alias("min_dim"),
        F.max(F.size("embedding")).cast("bigint").alias("max_dim"), F.count_if(~sound).alias("not_finite"),
        F.count_if(_norm("embedding") == 0).alias("zero_rows"))
    counts = passages.groupBy("corpus_id").agg(F.count("*").alias("passages"))
    out = counts.join(stats, "corpus_id", "left").fillna(0)
    reason = (F.when(F.col("vectors") != F.col("passages"), "count_mismatch")
              .when((F.col("min_dim") != F.col("max_dim")) | (F.col("min_dim") <= 0), "bad_dimension")
              .when(F.col("not_finite") > 0, "not_finite").when(F.col("zero_rows") > 0, "zero_vector"))
    return out.withColumn("reason", reason).withColumn("usable", reason.isNull())


def top_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest finite scores of each row; of equal ones the first columns."""
    if scores.shape[1] > k:
        last = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
        above, level = scores > last, scores == last
        chosen = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    else:
        chosen = np.ones(scores.shape, bool)
    return np.nonzero(chosen & np.isfinite(scores))


def _block_top(k: int):
    def best(key, vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "corpus_id", "passage_id", "section_order", "start_char", "score"]
        out = []
        if len(vectors) and len(asked):
            vectors = vectors.sort_values(["start_char", "passage_id"], kind="stable", ignore_index=True)  # equal scores rank in this order
            matrix = np.vstack(vectors["embedding"].to_numpy())
            orders = vectors["section_order"].to_numpy(float, na_value=np.nan)
            asked = asked[[v is not None and len(v) == matrix.shape[1] for v in asked["vector"]]]
            low = asked["scope_from"].to_numpy(float, na_value=np.nan)[:, None]
            high = asked["scope_to"].to_numpy(float, na_value=np.nan)[:, None]
            for at in range(0, len(asked), QUERY_ROWS):
                part = slice(at, at + QUERY_ROWS)
                scores = np.vstack(asked["vector"].iloc[part].to_numpy()) @ matrix.T
                allowed = (np.isnan(low[part]) | (orders >= low[part])) & (np.isnan(high[part]) | (orders <= high[part]))
                row, column = top_columns(np.where(allowed, np.round(scores, 9), -np.inf), k)
                top = vectors.iloc[column][["corpus_id", "passage_id", "section_order", "start_char"]].reset_index(drop=True)
                top.insert(0, "query_id", asked["query_id"].iloc[part].to_numpy()[row])
                top["score"] = scores[row, column]
                if len(top):
                    out.append(top)
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)
    return best


def dense_ranking(queries: DataFrame, vectors: DataFrame, k: int = DENSE_CANDIDATES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact cosine top-k per query over unit vectors, eligible sections filtered before ranking.

    A corpus is cut into blocks of bounded size, so a huge corpus spreads over many tasks. Every
    block multiplies its rows with its corpus' queries, a few hundred at a time, and selects k rows of
    each on the score matrix; only those are merged. Queries: query_id, corpus_id, vector, scope_from, scope_to. Other dimensions find nothing.
    """
    blocks = lambda df, name: df.groupBy("corpus_id").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    number = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    usable = vectors.filter(F.col("embedding").isNotNull())
    counts = blocks(usable, "_vn").join(blocks(queries, "_qn"), "corpus_id")
    left = (usable.select("corpus_id", "passage_id", "section_order", "start_char", "embedding").join(counts, "corpus_id")
            .withColumn("_vb", number("passage_id", "_vn")).withColumn("_qb", every("_qn")).drop("_vn", "_qn"))
    right = (queries.select("query_id", "corpus_id", "vector", "scope_from", "scope_to").join(counts, "corpus_id")
             .withColumn("_qb", number("query_id", "_qn")).withColumn("_vb", every("_vn")).drop("_vn", "_qn"))
    keys = ["corpus_id", "_vb", "_qb"]
    types = {f.name: f.dataType.simpleString() for f in usable.schema} | {"query_id": dict(queries.dtypes)["query_id"]}
    schema = ", ".join(f"{c} {types[c]}" for c in ["query_id", "corpus_id", "passage_id", "section_order", "start_char"]) + ", score double"
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_block_top(k), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "start_char", "passage_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def embed_passages(passages: DataFrame, fn: Callable[[list[str]], list[list[float]]], existing: DataFrame | None = None,
                   passing: tuple[type[Exception], ...] = (OSError, TimeoutError)) -> DataFrame:
    """Calls ``fn`` on fixed-size batches inside the tasks; up to three attempts per batch.

    ``existing`` lists corpora (corpus_id) whose stored vectors are valid; they are left out. A batch
    that keeps failing with one of the errors ``passing`` names (connection errors are OSErrors), or answers
    with another count, leaves null vectors, which makes ``validate_vectors`` report its corpus as lexical only.
    Any other error of ``fn`` is one of its code and fails the job.
    """
    todo = passages if existing is None else passages.join(existing.select("corpus_id").distinct(), "corpus_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            vectors: list = []
            attempts: list[int] = []
            for at in range(0, len(frame), BATCH_SIZE):
                texts = frame["text"].iloc[at:at + BATCH_SIZE].tolist()
                answer, used = None, 0
                while answer is None and used < ATTEMPTS:
                    used += 1
                    try:
                        reply = fn(texts)
                        answer = reply if len(reply) == len(texts) else None
                    except passing:
                        answer = None
                vectors += answer if answer is not None else [None] * len(texts)
                attempts += [used] * len(texts)
            yield pd.DataFrame({"corpus_id": frame["corpus_id"], "passage_id": frame["passage_id"],
                                "embedding": vectors, "attempts": attempts})

    types = dict(passages.dtypes)
    raw = todo.select("corpus_id", "passage_id", "text").mapInPandas(
        run, f"corpus_id {types['corpus_id']}, passage_id {types['passage_id']}, embedding array<double>, attempts bigint")
    return normalize_vectors(raw)
