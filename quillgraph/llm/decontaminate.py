"""Benchmark decontamination with spaced seeds: masks that ignore some token positions, joined on hashes, verified around the hits.

A seed is the hash of the words at the selected positions of a mask. Any 12 or 13 words that differ in at most two places share a
seed of two masks with their original. Items of 5 to 11 words have further masks for the changes that those two miss, chosen for the
lengths that the benchmark has, so that every change the verifier accepts is met (the tests try every case). Benchmark seeds set bits of two
tables of bounded size, by their leading and by their trailing bits; training texts look their seeds up there and send only hits, with the words around them. The hits join the benchmark
seeds on the full hash, which gives (document, item, diagonal); each diagonal is verified word by word, substitutions tolerated.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.runtime import stage
from quillgraph.llm.common import need
from quillgraph.llm.words import mix, random_words, word_groups

MASKS = ("11111", "1101011")
WINDOW = 13
SHORT = 12  # from so many words on, items need no masks beside MASKS
TOLERANCE = 0.2
BITS_PER_SEED, LEAST_BITS, MOST_BITS = 128, 16, 26
LONGEST = max(map(len, MASKS))

_FACTORS = random_words(WINDOW, 21) | np.uint64(1)


def _weight(length: int) -> int:
    """Words that a further mask selects in an item of 5 to 11 words."""
    return min(5, length - int(length * TOLERANCE))


def _meets(mask: str, length: int, wrong: tuple[int, ...]) -> bool:
    return any(all(mask[k - at:k - at + 1] != "1" for k in wrong if k >= at) for at in range(length - len(mask) + 1))


def short_masks(lengths: list[int]) -> tuple[str, ...]:
    """Masks beside MASKS for items of these lengths, all under 12: the whole item under 5 words, else few that meet all changes allowed."""
    missed = {(n, wrong) for n in lengths if n >= 5 for wrong in itertools.combinations(range(n), int(n * TOLERANCE)) if not any(_meets(m, n, wrong) for m in MASKS)}
    found = {"1" * n for n in lengths if n < 5}
    choices = sorted({"1" + "".join("1" if k in inner else "0" for k in range(1, span - 1)) + "1" for n in {n for n, _ in missed} for span in range(_weight(n), n + 1)
                      for inner in itertools.combinations(range(1, span - 1), _weight(n) - 2)})
    while missed:
        met = [{(n, wrong) for n, wrong in missed if mask.count("1") == _weight(n) and _meets(mask, n, wrong)} for mask in choices]
        best = max(range(len(choices)), key=lambda k: (len(met[k]), -k))
        found.add(choices[best])
        missed -= met[best]
    return tuple(sorted(found))


def seeds(hashes: np.ndarray, firsts: np.ndarray, short: tuple[str, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, seed hashes) per mask, those of ``short`` last; a seed lies inside one row."""
    ends = np.repeat(firsts[1:], np.diff(firsts))
    for number, mask in enumerate((*MASKS, *short)):
        span = len(mask)
        n = len(hashes) - span + 1
        if n <= 0:
            continue
        at = np.flatnonzero(np.arange(n) + span <= ends[:n])
        total = np.full(n, number * 7_919 + 1, np.uint64)
        for k in range(span):
            if mask[k] == "1":
                total += (hashes[k:k + n] ^ _FACTORS[k]) * _FACTORS[k]
        yield at, mix(total)[at]


def _items(short: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            for first, words in word_groups(batch.column("text")):
                lengths = np.diff(words.firsts)
                row = words.rows()
                for k, (at, seed) in enumerate(seeds(words.hashes, words.firsts, short)):
                    if k >= len(MASKS):  # whole items under 5 words, or items under 12
                        mask = short[k - len(MASKS)]
                        own = [n for n in range(1, SHORT) if (mask == "1" * n if n < 5 else mask.count("1") == _weight(n))]
                        used = np.isin(lengths[row[at]], own)
                        at, seed = at[used], seed[used]
                    yield pa.record_batch([batch.column("item_id").take(pa.array(row[at] + first)), pa.array(seed.view(np.int64)),
                                           pa.array(at - words.firsts[row[at]])], names=["item_id", "seed", "at"])
    return run


def _whole(batches):
    for batch in batches:
        for first, words in word_groups(batch.column("text")):
            own = [words.hashes[a:b].view(np.int64) for a, b in zip(words.firsts, words.firsts[1:])]
            yield pa.record_batch([batch.column("item_id").slice(first, len(own)), pa.array(own, pa.list_(pa.int64()))], names=["item_id", "item"])


def _hits(bits, shift: int, short: tuple[str, ...]):
    """Per run of hits that lie close together: the words around them and where the seeds are."""
    schema = pa.schema([("doc_id", pa.int64()), ("region", pa.int64()), ("words", pa.list_(pa.int64())), ("seeds", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])

    def run(batches):
        known = bits.value
        for batch in batches:
            for first, words in word_groups(batch.column("text")):
                kept = []
                for at, s in seeds(words.hashes, words.firsts, short):
                    for table, place in zip(known, (lambda v: v >> np.uint64(shift), lambda v: v & np.uint64((1 << (64 - shift)) - 1))):
                        at, s = (x[_set(table, place(s))] for x in (at, s))
                    kept.append((at, s))
                at = np.concatenate([a for a, _ in kept]) if kept else np.zeros(0, np.int64)
                if not len(at):
                    continue
                seed = np.concatenate([s for _, s in kept])
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                row = np.searchsorted(words.firsts, at, "right") - 1
                cuts = np.flatnonzero((np.diff(at) > 2 * WINDOW) | (np.diff(row) > 0)) + 1
                out = {n: [] for n in schema.names}
                for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(at)]):
                    begin, end = words.firsts[row[a]], words.firsts[row[a] + 1]
                    left, right = max(begin, at[a] - WINDOW), min(end, at[b - 1] + LONGEST + WINDOW)
                    out["doc_id"].append(batch.column("doc_id")[int(row[a]) + first].as_py())
                    out["region"].append(left - begin)
                    out["words"].append(words.hashes[left:right].view(np.int64))
                    out["seeds"].append(seed[a:b].view(np.int64))
                    out["places"].append(at[a:b] - left)
                yield pa.record_batch([pa.array(out[n], schema.field(n).type) for n in schema.names], schema=schema)
    return run


def _verified(batches):
    """Aligned words of a region and an item on one diagonal: the stretch of windows that differ in few enough places."""
    for batch in batches:
        rows = []
        for doc, region, words, item_id, item, diagonal in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "region", "words", "item_id", "item", "diagonal"))):
            lo, hi = max(0, diagonal), min(len(words), len(item) + diagonal)
            size = min(WINDOW, len(item))
            if hi - lo < size:
                continue
            same = np.asarray(words[lo:hi]) == np.asarray(item[lo - diagonal:hi - diagonal])
            sums = np.concatenate(([0], np.cumsum(same)))
            good = np.flatnonzero(sums[size:] - sums[:-size] >= size - int(size * TOLERANCE))
            if len(good):
                a, b = int(good[0]), int(good[-1]) + size
                covered = np.zeros(len(same), bool)
                for g in good:
                    covered[g:g + size] = True
                rows.append((doc, item_id, region + lo + a, region + lo + b, int(covered.sum()), int((covered & same).sum()), len(item)))
        names = ["doc_id", "item_id", "start_word", "end_word", "overlap_words", "equal_words", "item_words"]
        yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=names)


def _set(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_filter(places: DataFrame, bits: int) -> np.ndarray:
    """A bit per place (column b, below 2**bits). At most 2**bits / 32 numbers reach the driver."""
    rows = (places.groupBy(F.shiftrightunsigned("b", 5).alias("w"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(b & 31 AS int)))").alias("m")).toPandas())
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[rows["w"].to_numpy(np.int64)] = rows["m"].to_numpy(np.int64).astype(np.uint32)
    return table.view(np.uint8)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, overlap_words, equal_words, item_words), one row per pair with an overlap.

    An overlap is an alignment without gaps that holds a window of 13 words (the whole item if shorter) with at most 20 % of them
    unequal, rounded down; start and end are words of the document. Words compare with A-Z lower-cased. Items of fewer than 5 words
    must be found exactly; in longer ones every placement of unequal words that the share allows is found. Null, empty and blank
    texts overlap with nothing; null ids are carried along; repeated rows give the pair once. Either table empty: no rows.
    """
    spark = docs.sparkSession
    items = need(benchmark, item_id="long", text="string").filter("text is not null")
    training = need(docs, doc_id="long", text="string").filter("text is not null")
    whole = stage(items.mapInArrow(_whole, "item_id long, item array<long>").filter("size(item) > 0"), "items")
    short = short_masks([r[0] for r in whole.select(F.size("item").alias("n")).filter(f"n < {SHORT}").distinct().collect()])
    known = stage(items.mapInArrow(_items(short), "item_id long, seed long, at long"), "seeds")
    bits = min(MOST_BITS, max(LEAST_BITS, int(known.count() * BITS_PER_SEED).bit_length()))
    leading, trailing = F.shiftrightunsigned("seed", 64 - bits), F.col("seed").bitwiseAND(F.lit((1 << bits) - 1))
    table = spark.sparkContext.broadcast([bit_filter(known.select(b.alias("b")), bits) for b in (leading, trailing)])
    regions = stage(training.mapInArrow(_hits(table, 64 - bits, short), "doc_id long, region long, words array<long>, seeds array<long>, places array<long>"), "regions")
    hits = regions.select("doc_id", "region", F.xxhash64("words").alias("w"), F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("doc_id", "region", "w", F.col("h.seeds").alias("seed"), F.col("h.places").alias("place"))
    met = hits.join(known, "seed").select("doc_id", "region", "w", "item_id", (F.col("place") - F.col("at")).alias("diagonal")).distinct()
    keyed = regions.select("doc_id", "region", "words", F.xxhash64("words").alias("w")).dropDuplicates(["doc_id", "region", "w"])
    same = F.col("m.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("m.region") == F.col("k.region")) & (F.col("m.w") == F.col("k.w"))
    aligned = (met.alias("m").join(keyed.alias("k"), same).select("m.doc_id", "m.region", "k.words", "m.item_id", "m.diagonal")
               .join(whole.alias("i"), F.col("m.item_id").eqNullSafe(F.col("i.item_id"))).select("m.doc_id", "m.region", "words", "m.item_id", "i.item", "diagonal"))
    found = aligned.mapInArrow(_verified, "doc_id long, item_id long, start_word long, end_word long, overlap_words long, equal_words long, item_words long")
    best = F.max(F.struct("equal_words", "overlap_words", (-F.col("start_word")).alias("s"), "end_word", "item_words"))
    return (found.groupBy("doc_id", "item_id").agg(best.alias("b"))
            .select("doc_id", "item_id", (-F.col("b.s")).alias("start_word"), "b.end_word", "b.overlap_words", "b.equal_words", "b.item_words"))
