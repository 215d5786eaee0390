"""Language identification by interpolated Kneser-Ney character models, one per language.

The models are learnt from labelled texts, a bounded number of characters per language (``MOST_CHARACTERS``, a parameter of the
fit), and stored in sorted arrays of n-gram hashes with one column per language. A text gets the language of the lowest
cross-entropy per character. Rejection is calibrated: a text whose entropy is above nearly all of those that the language's own
training texts have is flagged.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.llm.common import need, small_or_joined
from quillgraph.llm.words import mix

ORDER = 4
DISCOUNT = 0.75
MOST_CHARACTERS = 1_500_000
MOST_TOTAL = 60_000_000
SPAN_SHARE = 16
STEP = 1 << 19
_HASH = np.uint64(0x9E3779B97F4A7C15)


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, everything but letters folded to a single blank per run, and the bounds of the texts.
    A text begins and ends with a blank; without letters it is empty."""
    raw = [(" " + (t or "") + " ").lower() for t in texts]
    codes = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in raw])))
    seen, back = np.unique(codes, return_inverse=True)
    is_letter = np.array([chr(c).isalpha() for c in seen], bool)
    keep = is_letter[back]
    codes = np.where(keep, codes, np.uint32(32))
    first = np.ones(len(codes), bool)
    first[1:] = keep[:-1]
    begins = np.zeros(len(codes), bool)
    begins[bounds[:-1][bounds[:-1] < len(codes)]] = True
    used = keep | first | begins
    places = np.concatenate(([0], np.cumsum(used)))[bounds]
    return codes[used], places


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each position; positions with fewer before them get what there is of the array."""
    out = np.zeros(len(codes), np.uint64)
    for k in range(n):
        out[n - 1:] = out[n - 1:] * _HASH + codes[n - 1 - (n - 1 - k):len(codes) - (n - 1 - k)].astype(np.uint64) + np.uint64(1)
    return mix(out + np.uint64(n))


class KneserNey:
    """hashes[n]: sorted n-grams; logs[n]: log10 P of each under each language; back[n]: log10 weights of their contexts."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        per, alphabet = [], set()
        for name in self.languages:
            codes, bounds = letters(samples[name])
            per.append((codes, bounds))
            alphabet.update(np.unique(codes).tolist())
        self.uniform = 1.0 / (len(alphabet) + 1)
        width = len(self.languages)
        grams = [[self._grams(codes, bounds, n) for n in range(1, ORDER + 1)] for codes, bounds in per]
        self.hashes = [np.unique(np.concatenate([g[n][0] for g in grams])) if width else np.zeros(0, np.uint64) for n in range(ORDER)]
        self.logs = [np.full((len(h), width), np.nan) for h in self.hashes]
        self.weights = [np.zeros((1 if n == 0 else len(self.hashes[n - 1]), width)) for n in range(ORDER)]
        for j in range(width):
            self._fit(j, grams[j])
        self._dense()

    @staticmethod
    def _grams(codes: np.ndarray, bounds: np.ndarray, n: int):
        """(hash, count, hash of the context, hash of the shorter gram) of every n-gram inside a text."""
        full, shorter = gram_hashes(codes, n), gram_hashes(codes, n - 1) if n > 1 else np.zeros(len(codes), np.uint64)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        at = np.flatnonzero(np.arange(len(codes)) - bounds[row] >= n - 1) if len(codes) else np.zeros(0, np.int64)
        seen, one, count = np.unique(full[at], return_index=True, return_counts=True)
        place = at[one]
        context = shorter[place - 1] if n > 1 else np.zeros(len(place), np.uint64)
        return seen, count, context, shorter[place]

    def _fit(self, j: int, grams: list) -> None:
        """Lower orders count the distinct characters before a gram; each order is discounted and passes the rest down."""
        for n in range(1, ORDER + 1):
            seen, count, context, shorter = grams[n - 1]
            if n < ORDER:
                # continuation counts: distinct (n+1)-grams that end in this n-gram; a gram at a text's begin keeps its count
                longer = grams[n][3]
                ends, kinds = np.unique(longer, return_counts=True)
                slot = np.minimum(np.searchsorted(ends, seen), max(0, len(ends) - 1))
                count = np.where(ends[slot] == seen, kinds[slot], np.minimum(count, 1)) if len(ends) else count
            if not len(seen):
                continue
            contexts, group = np.unique(context, return_inverse=True)
            totals = np.bincount(group, count)
            kinds = np.bincount(group)
            own = np.searchsorted(self.hashes[n - 1], seen)
            self.logs[n - 1][own, j] = (count - DISCOUNT) / totals[group]
            spot = np.zeros(1, np.int64) if n == 1 else np.searchsorted(self.hashes[n - 2], contexts)
            ok = slice(None) if n == 1 else self.hashes[n - 2][np.minimum(spot, len(self.hashes[n - 2]) - 1)] == contexts
            self.weights[n - 1][spot[ok], j] = (DISCOUNT * kinds / totals)[ok] if n > 1 else DISCOUNT * kinds / totals

    def _dense(self) -> None:
        """Interpolates once, in probabilities, then keeps logs: P(c | context) = own share + weight * P(c | shorter context)."""
        self.floor = np.log10(np.maximum(self.weights[0][0], 1e-9) * self.uniform) if self.languages else np.zeros(0)
        self.share = [np.nan_to_num(p) for p in self.logs]
        self.weights = [np.where(w > 0, w, 1.0) for w in self.weights]

    def _find(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = np.minimum(np.searchsorted(self.hashes[n - 1], hashes), max(0, len(self.hashes[n - 1]) - 1))
        return slot, self.hashes[n - 1][slot] == hashes

    def entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) mean -log10 P per character, and the number of characters; the first blank is given."""
        codes, bounds = letters(texts)
        sums, size = np.zeros((len(texts), len(self.languages))), np.diff(bounds)
        if not len(codes) or not self.languages:
            return sums, size
        row = np.repeat(np.arange(len(texts)), size)
        place = np.arange(len(codes)) - bounds[row]
        # Equal histories give equal logs: every distinct gram of the longest order is looked up once.
        depth = np.minimum(place, ORDER - 1)
        key = gram_hashes(codes, ORDER)
        for d in range(ORDER - 1):
            early = np.flatnonzero(depth == d)
            key[early] = gram_hashes(codes, d + 1)[early] ^ np.uint64(d + 1)
        _, one, back = np.unique(key, return_index=True, return_inverse=True)
        p = self.share_at(1, gram_hashes(codes, 1)[one]) + self.weights[0][0] * self.uniform
        for n in range(2, ORDER + 1):
            deep = depth[one] >= n - 1
            at = one[deep]
            slot, known = self._find(n - 1, gram_hashes(codes, n - 1)[at - 1])
            weight = np.where(known[:, None], self.weights[n - 1][slot], 1.0)
            p[deep] = self.share_at(n, gram_hashes(codes, n)[at]) + weight * p[deep]
        logs = -np.log10(p)[back]
        logs[bounds[:-1][size > 0]] = 0
        np.add.at(sums, np.arange(len(texts))[size > 0], np.add.reduceat(logs, bounds[:-1][size > 0], axis=0))
        return sums / np.maximum(1, size - 1)[:, None], size

    def share_at(self, n: int, hashes: np.ndarray) -> np.ndarray:
        slot, known = self._find(n, hashes)
        return np.where(known[:, None], self.share[n - 1][slot], 0.0)


def bounded_sample(labelled: DataFrame, most: int = MOST_CHARACTERS) -> dict[str, list[str]]:
    """At most ``most`` characters per language, and ``MOST_TOTAL`` in all, cut by running length in hash order.

    A text longer than a ``SPAN_SHARE``-th of the bound is sampled in spans of that length. Each text offers one span, chosen by hash,
    before any offers its others, so no text displaces the rest, and a language with any text has a sample, short of the bound by less
    than a span if it has that many characters.
    """
    sized = labelled.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    most = max(1, min(most, MOST_TOTAL // max(1, sized.select("lang").distinct().count())))
    span = max(1, most // SPAN_SHARE)
    lengths = small_or_joined(sized.groupBy("lang").agg(F.sum(F.least("n", F.lit(span))).alias("first"), F.sum("n").alias("all")))
    spans = F.greatest(F.lit(1), F.ceil(F.col("n") / span).cast("int"))
    chosen = F.pmod(F.xxhash64("h"), spans).cast("int")
    # keep hashes below the share of the range that holds twice the bound, then cut exactly; others are needed where all first spans are
    below = lambda h, characters: F.pmod(h, F.lit(1 << 20)) * characters.cast("double") <= (2.0 * most + 2e5) * (1 << 20)
    others = F.filter(F.sequence(F.lit(0), spans - 1), lambda k: (k != F.col("chosen")) & (F.col("first") < most) & below(F.xxhash64("h", k), F.col("all") - F.col("first")))
    picked = F.concat(F.when(below(F.col("h"), F.col("first")), F.array("chosen")).otherwise(F.array().cast("array<int>")), others)
    texts = F.transform(picked, lambda k: F.struct((k != F.col("chosen")).alias("later"), F.when(k == F.col("chosen"), F.col("h")).otherwise(F.xxhash64("h", k)).alias("h"),
                                                   F.substring(F.col("text"), k * span + 1, F.lit(span)).alias("text")))
    near = sized.join(lengths, "lang").withColumn("chosen", chosen).select("lang", F.explode(texts).alias("s")).select("lang", "s.*")
    order = W.partitionBy("lang").orderBy("later", "h", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = near.withColumn("upto", F.sum(F.length("text")).over(order)).filter(F.col("upto") <= most).select("lang", "text").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def fit(labelled: DataFrame, most: int = MOST_CHARACTERS) -> tuple[KneserNey, np.ndarray]:
    """The models and, per language, the entropy above which a text is rejected: mean + 6 deviations of texts of its own sample of
    at least 100 characters."""
    samples = bounded_sample(labelled, most)
    model = KneserNey(samples)
    limits = []
    for j, name in enumerate(model.languages):
        own = [t for t in samples[name] if len(t) >= 100][:500]
        e = model.entropy(own)[0][:, j] if own else np.zeros(0)
        limits.append(float(e.mean() + 6 * e.std() + 0.05) if len(e) else math.inf)
    return model, np.array(limits)


def identify(docs: DataFrame, model: KneserNey, limits: np.ndarray) -> DataFrame:
    """Per input row: doc_id, lang_pred, score (0 to 1: the posterior of the best language from ten characters' worth of evidence),
    entropy and rejected (entropy above the calibrated limit).

    A null text or one without a letter is ``und`` with score 0, and so is every text if no language was learnt. Ties go to the
    first language in code point order. Repeated rows are judged each; other columns are dropped; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, limits))

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            sizes = np.asarray(pa.compute.fill_null(pa.compute.utf8_length(texts), 0))
            cuts, at = [0], 0
            while at < len(sizes):
                upto = np.cumsum(sizes[at:])
                at += max(1, int(np.searchsorted(upto, STEP)))
                cuts.append(min(at, len(sizes)))
            for a, b in zip(cuts, cuts[1:]):
                yield one(ids.slice(a, b - a), texts.slice(a, b - a).to_pylist())

    def one(ids, texts):
        m, most = shared.value
        e, size = m.entropy(texts)
        lettered = size > 2
        n = len(texts)
        if not m.languages:
            best, score, low, names = np.zeros(n, int), np.zeros(n), np.zeros(n), ["und"]
            lettered = np.zeros(n, bool)
        else:
            best = e.argmin(axis=1)
            low = e[np.arange(n), best]
            score = 1 / np.exp(-(e - low[:, None]) * 10 * math.log(10)).sum(axis=1)
            names = m.languages
        far = low > (most[best] if m.languages else np.inf)
        return pa.record_batch([ids, pa.array([names[k] if ok else "und" for k, ok in zip(best, lettered)], pa.string()), pa.array(np.where(lettered, score, 0.0)),
                                pa.array(np.where(lettered, low, 0.0)), pa.array(lettered & far)], names=["doc_id", "lang_pred", "score", "entropy", "rejected"])
    return need(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")
