"""b-bit MinHash near-duplicate groups.

1. In Arrow batches every text becomes its shingle set: size, a 128-bit digest of the set, the low bits of its minima packed into
   longs, and band keys from whole minima. Equal sets are one class, combined before anything is compared.
2. A band bucket sends its members to one of them, never to each other: the one that has the most company over all its buckets. The packed bits estimate the similarity, corrected for
   the bits that agree by chance; what is near enough is confirmed on the full sets.
3. Members of buckets that still hold more than one component meet over their rarest shingles: a pair that is similar enough must
   share one of the first shingles of both sets in one common order, rarest first. How many are the first ones follows from the
   limit and the set size alone, so no link is lost, and families of texts just under the limit, which differ in rare
   shingles, are not compared pair by pair.

At similarity 0.8 a pair shares no band with probability (1 - 0.8^5)^40 = 1.3e-7; the estimate keeps a margin of six deviations.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.runtime import cut_lineage, forget, stage
from quillgraph.llm.common import need, small_or_joined
from quillgraph.llm.words import mix, random_words, shingles, word_groups

BANDS, BAND_ROWS, BITS = 40, 5, 2
HASHES = BANDS * BAND_ROWS
PER_LONG = 64 // BITS
LONGS = -(-HASHES // PER_LONG)
PERCENT = 80
MARGIN = 0.2
ALWAYS_CONFIRM = 32  # smaller sets skip the estimate: their full sets cost no more

_FACTORS = (random_words(HASHES, 3) | np.uint64(1)).astype(np.uint32)
_BAND_FACTORS = random_words(HASHES, 5).reshape(BANDS, BAND_ROWS) | np.uint64(1)
_BAND_SALT = random_words(BANDS, 9)


def minima(own: np.ndarray) -> np.ndarray:
    """The smallest value of each hash over the set, in blocks of bounded size."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (own >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(short), 2048):
        np.minimum(low, np.multiply.outer(_FACTORS, short[a:a + 2048]).min(axis=1), out=low)
    return low


def signature(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits of the mixed minima, and one key per band."""
    whole = mix(low.astype(np.uint64) + np.arange(HASHES, dtype=np.uint64) * np.uint64(1 << 32))
    lanes = np.zeros(LONGS * PER_LONG, np.uint64)
    lanes[:HASHES] = whole & np.uint64((1 << BITS) - 1)
    packed = (lanes.reshape(LONGS, PER_LONG) << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    keys = mix((whole.reshape(BANDS, BAND_ROWS) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64) ^ _BAND_SALT)
    return packed.view(np.int64), keys.view(np.int64)


def _signed(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("bits", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words in word_groups(batch.column("text")):
                hashes, bounds = shingles(words, size)
                out = {name: [] for name in schema.names}
                for r in range(len(bounds) - 1):
                    own = np.unique(hashes[bounds[r]:bounds[r + 1]])
                    out["n"].append(len(own))
                    if not len(own):
                        for name in ("key", "bits", "bands"):
                            out[name].append(None)
                        continue
                    packed, keys = signature(minima(own))
                    out["key"].append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    out["bits"].append(packed)
                    out["bands"].append(keys)
                out["doc_id"] = batch.column("doc_id").slice(first, len(bounds) - 1)
                yield pa.record_batch([pa.array(out[n], schema.field(n).type) if n != "doc_id" else out[n].cast(pa.int64()) for n in schema.names], schema=schema)
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words in word_groups(batch.column("text")):
                hashes, bounds = shingles(words, size)
                own = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(bounds, bounds[1:])]
                yield pa.record_batch([batch.column("id").slice(first, len(own)), pa.array(own, pa.list_(pa.int64()))], names=["id", "set"])
    return run


def estimated(a: Column, b: Column) -> Column:
    """Similarity from the share of lanes that agree, less those that agree by chance."""
    lanes = int("01" * PER_LONG, 2)

    def unlike(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(lanes)))
    unequal = sum((unlike(k) for k in range(1, LONGS)), unlike(0))
    chance = 1 / (1 << BITS)
    return (1 - unequal / F.lit(float(HASHES)) - chance) / (1 - chance)


def linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    side = lambda n: classes.select(F.col("id").alias(n), F.col("n").alias(f"n{n}"), F.col("bits").alias(f"bits{n}"))
    near = (F.least("na", "nb") <= ALWAYS_CONFIRM) | (estimated(F.col("bitsa"), F.col("bitsb")) >= percent / 100 - MARGIN)
    likely, likely_path = cut_lineage(pairs.join(side("a"), "a").join(side("b"), "b")
                                      .filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).filter(near).select("a", "b", "na", "nb"), "likely")
    wanted = small_or_joined(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi")
    sets = stage(texts.mapInArrow(_sets(size), "id long, set array<long>"), "sets")
    shared = F.size(F.array_intersect("sa", "sb"))
    found = (likely.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
             .join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
             .filter(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b").distinct())
    out = stage(found, "links")
    forget(pairs.sparkSession, likely_path)
    return out


def connected(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, component), the smallest id reachable. Each round takes the smallest label among the neighbours, summed
    up per node before the shuffle, and follows labels of labels; rounds end when none changes."""
    spark = edges.sparkSession
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels, path = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        nearest = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lowered = labels.join(nearest, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        jumped = lowered.join(up, "component", "left").select("id", F.least("component", F.coalesce("up", "component")).alias("component"), "was")
        fresh, fresh_path = cut_lineage(jumped, "labels")
        settled = not fresh.filter("component <> was").limit(1).count()
        forget(spark, path)
        labels, path = fresh.select("id", "component"), fresh_path
        if settled:
            return labels


def joined_up(labels: DataFrame, fresh: DataFrame) -> DataFrame:
    """labels with the components that fresh links (a, b) join: only those components are walked again, not all links."""
    new = fresh.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti")
    known = stage(labels.unionByName(new.select("id", F.col("id").alias("component"))), "known")
    end = lambda n: known.select(F.col("id").alias(n), F.col("component").alias(f"c{n}"))
    ends = fresh.join(end("a"), "a").join(end("b"), "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    over = connected(ends).select(F.col("id").alias("component"), F.col("component").alias("over"))
    return known.join(over, "component", "left").select("id", F.coalesce("over", "component").alias("component"))


def rare_firsts(sets: DataFrame, percent: int) -> DataFrame:
    """Shingles by which similar sets meet: id, component, n, e, its place ``at`` in the set's order, and ``index``.

    Sets are ordered by how many of them hold a shingle, then by the shingle. Two sets with similarity t or more share one of the
    first n - ceil(t * n) + 1 shingles of the larger and of the first n - ceil(2 * t / (1 + t) * n) + 1 of the smaller (``index``).
    Shingles of a single set meet nothing; they only take up places.
    """
    rows = sets.select("id", "component", F.size("set").alias("n"), F.xxhash64("set").alias("own"), F.explode("set").alias("e"))
    shared = rows.groupBy("e").agg(F.count("*").alias("holders")).filter("holders > 1")
    listed = rows.join(shared, "e").groupBy("id", "component", "n", "own").agg(F.sort_array(F.collect_set(F.struct("holders", "e"))).alias("by"))
    listed = listed.withColumn("alone", F.col("n") - F.size("by"))
    alone = F.col("alone")
    larger = F.expr(f"cast(n - ({percent}L * n + 99) div 100 + 1 as int)") - alone
    smaller = F.expr(f"cast(n - ({2 * percent}L * n + {99 + percent}) div {100 + percent} + 1 as int)") - alone
    firsts = listed.filter(larger > 0).select("id", "component", "n", "alone", smaller.alias("smaller"), F.posexplode(F.slice("by", F.lit(1), larger)).alias("at", "s"))
    return firsts.select("id", "component", "n", F.col("s.e").alias("e"), (F.col("at") + F.col("alone")).alias("at"), (F.col("at") < F.col("smaller")).alias("index"))


def rare_pairs(firsts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in a shingle after which enough of both sets is left to be similar.
    Components meet first, by the bounds of their members in that shingle, so the members of one never meet; a member then goes to
    the components in whose bounds it is itself, so a large component is not laid out once for each text that shares a word with it."""
    firsts = firsts.withColumn("rest", F.col("n") - F.col("at"))
    enough = lambda least, smallest: (100 + percent) * F.least(*least) >= percent * (F.col(smallest[0]) + F.col(smallest[1]))
    held = firsts.groupBy("e", "component").agg(F.max("index").alias("index"), F.max("rest").alias("rest"), F.min("n").alias("least"))
    several = held.groupBy("e").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("index").alias("any")).filter("lo <> hi and any").select("e")
    firsts, held = (stage(t.join(several, "e", "left_semi"), "meeting") for t in (firsts, held))
    side = lambda n: held.select("e", F.col("component").alias(f"c{n}"), F.col("index").alias(f"index{n}"), F.col("rest").alias(f"rest{n}"), F.col("least").alias(f"least{n}"))
    # a meeting carries the bounds of its far component, so a member that can be similar to none of it goes no further
    met = (side("a").filter("indexa").join(side("b"), "e").filter((F.col("ca") != F.col("cb")) & enough(("resta", "restb"), ("leasta", "leastb")))
           .select("e", "ca", "cb", F.col("restb").alias("most"), F.col("leastb").alias("small")))
    member = lambda n: firsts.select("e", F.col("component").alias(f"c{n}"), F.col("index").alias(f"index{n}"), F.col("id").alias(n), F.col("n").alias(f"n{n}"), F.col("rest").alias(f"rest{n}"))
    able = met.join(member("a").filter("indexa"), ["e", "ca"]).filter(enough(("resta", "most"), ("na", "small")))
    fits = (F.col("na") <= F.col("nb")) & (100 * F.col("na") >= percent * F.col("nb")) & enough(("resta", "restb"), ("na", "nb"))
    pairs = able.select("e", "cb", "a", "na", "resta").join(member("b"), ["e", "cb"]).filter(fits)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept (doc_id = component_id).

    A text with fewer words than ``size`` has its whole sequence as its one shingle; a null, empty or blank text has an empty set and
    is linked with nothing. A row without a doc_id cannot be named: component_id is null and it is kept. Rows that share a doc_id
    are one document, linked by any of their texts. Repeated rows come back as often as given. Other columns are dropped.
    """
    spark = docs.sparkSession
    given = need(docs, doc_id="long", text="string")
    signed = stage(given.mapInArrow(_signed(size), "doc_id long, n long, key binary, bits array<long>, bands array<long>"), "signed")
    named = signed.filter("doc_id is not null and n > 0")
    members = named.groupBy("key").agg(F.min("doc_id").alias("id"))
    classes = stage(named.join(members, "key").filter("doc_id = id").select("id", "n", "bits", "bands").dropDuplicates(["id", "n"]), "classes")
    buckets = classes.select("id", F.explode("bands").alias("band"))
    # One order for all buckets, the members with the most company first: the text that a family was made from shares buckets with all
    # of it, so its members meet the same centre, and one that they are similar to.
    sizes = buckets.groupBy("band").agg(F.count("*").alias("others")).filter("others > 1")
    shared = stage(buckets.join(small_or_joined(sizes), "band"), "shared")
    company = shared.groupBy("id").agg(F.sum("others").alias("company"))
    ranked = stage(shared.select("band", "id").join(company, "id").select("band", "id", F.struct("company", F.xxhash64("id").alias("by"), "id").alias("rank")), "ranked")
    tops = ranked.groupBy("band").agg(F.max("rank")["id"].alias("hub"))
    crowd = stage(ranked.select("band", "id").join(small_or_joined(tops), "band").filter("id <> hub"), "crowd")
    met = crowd.select(F.col("id").alias("x"), F.col("hub").alias("y"))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = linked(pairs, classes, given, size, percent)
    labels = connected(links)
    labelled = crowd.select("band", "id").join(labels, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    mixed = labelled.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("band")
    left = small_or_joined(labelled.join(mixed, "band", "left_semi").select("id", "component").distinct())
    sets = stage(given.select(F.col("doc_id").alias("id"), "text").join(left.select("id"), "id", "left_semi").mapInArrow(_sets(size), "id long, set array<long>"), "sets")
    met = rare_pairs(stage(rare_firsts(sets.filter(F.size("set") > 0).join(left, "id"), percent), "firsts"), percent)
    fresh = linked(met, classes, given, size, percent)
    if fresh.limit(1).count():
        labels = stage(joined_up(labels, fresh), "labels")
    own = members.join(labels, "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "key").join(own, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
