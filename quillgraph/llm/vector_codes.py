"""Product codes of vectors: parts replaced by the index of their nearest codebook entry, found by equal-average search.

The entries of a codebook are sorted by the sum of their components. By the Cauchy-Schwarz inequality the squared gap of two sums,
divided by the dimension, never exceeds the squared distance; so each part starts between the two entries whose sums enclose its
own, walks outward, always to the side with the smaller gap, and stops once the squared gap over the dimension strictly exceeds the
best distance: whatever lies further out is further away, and equal distances are still met. All parts of a batch walk together.

Every round is one pass: tasks assign their rows and send one sum per entry; floors of the means, a table of fixed size, make the
next codebooks. Components are integers, so sums do not depend on their order and reruns agree to the digit.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.runtime import cut_lineage, forget, stage
from quillgraph.llm.common import BROADCAST_ROWS

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
MOST = 1 << 30  # a component, times the larger of parts and their width; beyond it a square could leave 64 bits
STEP_ROWS = 1 << 14
SUMS = "part int, entry int, n long, sums array<long>"


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry for each row; ties go to the lower index."""
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sorted_sums, own, width = sums[order], parts.sum(axis=1), book.shape[1]
    right = np.searchsorted(sorted_sums, own)
    left = right - 1
    entry, best = np.full(len(parts), len(book), np.int64), np.full(len(parts), np.iinfo(np.int64).max)
    rows = np.arange(len(parts))
    while len(rows):
        far = np.iinfo(np.int64).max
        below = np.where(left >= 0, own[rows] - sorted_sums[np.maximum(left, 0)], far)
        above = np.where(right < len(book), sorted_sums[np.minimum(right, len(book) - 1)] - own[rows], far)
        down = below <= above
        gap = np.where(down, below, above)
        # gap * gap > width * best, divided so that neither side leaves 64 bits
        ended = (gap == far) | ((entry[rows] < len(book)) & (-(-(np.where(gap == far, 0, gap) ** 2) // max(width, 1)) > best[rows]))
        rows, left, right, down = (a[~ended] for a in (rows, left, right, down))
        met = order[np.where(down, left, right)]
        distance = ((parts[rows] - book[met]) ** 2).sum(axis=1)
        better = (distance < best[rows]) | ((distance == best[rows]) & (met < entry[rows]))
        entry[rows[better]], best[rows[better]] = met[better], distance[better]
        left, right = left - down, right + ~down
    return entry, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _assigned(matrix: np.ndarray, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its components, entries, distances) for each part position."""
    size = matrix.shape[1] // len(books)
    for k, book in enumerate(books):
        own = matrix[:, k * size:(k + 1) * size]
        yield k, own, *nearest(own, book)


def _steps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), STEP_ROWS):
            piece = batch.slice(at, STEP_ROWS)
            yield piece, _matrix(piece.column("vector"), width)


def _sums(books, width: int):
    """Per task: count and component sums of every entry that got a part."""
    def run(batches):
        known = books.value
        n = np.zeros((len(known), len(known[0])), np.int64)
        total = np.zeros((*n.shape, width // len(known)), np.int64)
        for _, matrix in _steps(batches, width):
            for k, own, entry, _ in _assigned(matrix, known):
                n[k] += np.bincount(entry, minlength=n.shape[1])
                np.add.at(total[k], entry, own)
        part, entry = np.nonzero(n)
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]),
                               pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])
    return run


def _codes(books, width: int):
    def run(batches):
        known = books.value
        for piece, matrix in _steps(batches, width):
            found = [(entry, distance) for _, _, entry, distance in _assigned(matrix, known)]
            code = ["".join(f"{e:02x}" for e in row) for row in np.stack([e for e, _ in found], axis=1).tolist()]
            error = np.sum([d for _, d in found], axis=0, dtype=np.int64)
            yield pa.record_batch([piece.column("vec_id"), piece.column("label"), pa.array(code, pa.string()), pa.array(error)],
                                  names=["vec_id", "label", "code", "error"])
    return run


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector) with integer components, without vectors that are null or hold null or non-finite components."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    units = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-2.0 * MOST + 1), F.least(F.lit(2.0 * MOST - 1), x * scale))).cast("int"))
    return rows.filter(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", "label", units.alias("vector"))


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """One codebook per part position from the vectors with the smallest ids: at most ``entries`` rows reach the driver."""
    first = np.array([r["vector"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()], np.int64)
    return [np.ascontiguousarray(book) for book in np.split(first, parts, axis=1)] if len(first) else []


def refined(spark: SparkSession, rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round: floors of the means; an entry without parts stays."""
    shared = spark.sparkContext.broadcast(books)
    per_task = rows.select("vector").mapInArrow(_sums(shared, width), SUMS)
    sums = (per_task.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at")
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")))
    out = [book.copy() for book in books]
    for r in sums.collect():  # parts x entries x components of a part, whatever the rows
        out[r["part"]][r["entry"], r["at"]] = int(r["s"]) // r["n"]
    shared.unpersist()
    return out


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error, the errors summed over equal labels, nulls together. Sums are combined before they are moved. Up to
    ``BROADCAST_ROWS`` labels they come back by broadcast; beyond that only labels with a thousandth of the rows do, at most a
    thousand, and the others by a shuffled join whose keys are all small."""
    totals = stage(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "labels")
    numbers = totals.agg(F.count("*").alias("labels"), F.sum("rows").alias("rows")).first()
    joined = lambda left, right: left.alias("c").join(right.alias("t"), F.col("c.label").eqNullSafe(F.col("t.label")))
    columns = ["c.*", "t.label_error"]
    if numbers["labels"] <= BROADCAST_ROWS:
        return joined(codes, F.broadcast(totals)).select(columns)
    hot = totals.filter(F.col("rows") * 1_000 >= numbers["rows"])
    marked = codes.alias("c").join(F.broadcast(hot).alias("t"), F.col("c.label").eqNullSafe(F.col("t.label")), "left").select(*columns)
    rest = marked.filter("label_error is null").drop("label_error")
    return marked.filter("label_error is not null").unionByName(joined(rest, totals.filter(F.col("rows") * 1_000 < numbers["rows"])).select(columns))


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error, label_error), final codebooks); vectors: vec_id, label, embedding.

    Components become floor(scale * x); each part position has its own codebook, started with the smallest ids (ties of ids by the
    vector, null ids last) and refined in ``rounds`` passes over all vectors. A code has two hex digits per part.

    Vectors that are null or hold null or non-finite components are left out. Null ids and labels are carried along. Repeated rows
    are coded alike and count each. With fewer vectors than entries the codebooks are as short; a table without usable vectors gives
    no rows and no codebooks. Equal distances go to the lower index. Other columns are dropped, whatever their names. ValueError
    where vectors differ in length, where ``parts`` does not divide it, or where a scaled component is too large for
    squares of 64 bits (2**27 for 64 components in 8 parts).
    """
    spark = vectors.sparkSession
    rows, path = cut_lineage(whole_vectors(vectors, scale), "vectors")
    size = F.size("vector")
    far = F.greatest(F.abs(F.array_min("vector").cast("long")), F.abs(F.array_max("vector").cast("long")))
    seen = rows.agg(F.min(size).alias("least"), F.max(size).alias("most"), F.max(far).alias("far")).first()
    if seen["least"] is None:
        return rows.selectExpr("vec_id", "label", "'' as code", "0L as error", "0L as label_error"), []
    if seen["least"] != seen["most"] or seen["least"] % parts:
        raise ValueError(f"vectors have {seen['least']} to {seen['most']} components; all must have the same number, a multiple of {parts}")
    width = seen["most"]
    if (seen["far"] or 0) * max(width // parts, parts) > MOST:
        raise ValueError(f"a scaled component reaches {seen['far']}; the limit is {MOST // max(width // parts, parts)}")
    books = first_books(rows, parts, entries)
    for _ in range(rounds):
        books = refined(spark, rows, books, width)
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    codes = stage(rows.mapInArrow(_codes(spark.sparkContext.broadcast(books), width), schema), "codes")
    forget(spark, path)
    return with_label_errors(codes), books


def listed(books: list[np.ndarray]) -> str:
    """All components in decimal by part, entry and position."""
    return ",".join(str(v) for book in books for v in book.ravel().tolist())


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(listed(books).encode()).hexdigest()
