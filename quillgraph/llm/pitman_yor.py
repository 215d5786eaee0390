"""A hierarchical Pitman-Yor language model over words, seated anew in every sweep inside Spark tasks.

Restaurants: one per context, the word before, all sharing the unigram restaurant as parent, whose base is uniform over the
vocabulary and one unseen word. Tokens are dealt to buckets by word, so that a bucket holds all customers of its words in every
restaurant: their seats, and their parents' seats, are sampled there without any exchange. What restaurants share across buckets
are numbers of customers, dishes and tables by context: each bucket sends them in classes of contexts, a task adds a class up, and
every bucket gets the sums of its own contexts back, customers and dishes before it samples, tables after it. While it samples, a
bucket takes a context's tables elsewhere to be its dishes there, and as many more for repeated customers as its own pairs have;
scoring uses the exact sums. Probabilities are averaged over the kept samples before the logarithm is taken.

Very frequent words (at most 1 / HOT_SHARE of them) would make single buckets grow without bound: they are dealt by word and
context, a text's repetitions of a pair as one place. Their parents' seats, a table of fixed size, are added up for all buckets.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.runtime import placed, stage
from quillgraph.llm.words import mix, random_words, word_groups

CLASSES = 256  # of contexts, and of texts, in which buckets exchange sums; more of them beyond as many buckets
DISCOUNTS = (0.9, 0.6)  # context restaurants, their parent
STRENGTHS = (20.0, 1.0)
BURN, SAMPLES = 2, 3
HOT_SHARE = 0.0005
BUCKET_TOKENS = 1_000_000
END, START = random_words(2, 41)


def tokens_of(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, context, row): the words of each row and one end token; the context is a bijective hash of the word before."""
    rows = len(words.firsts) - 1
    row = np.repeat(np.arange(rows), np.diff(words.firsts) + 1)
    ends = np.cumsum(np.diff(words.firsts) + 1) - 1
    token = np.empty(len(row), np.uint64)
    inner = np.ones(len(row), bool)
    inner[ends] = False
    token[inner], token[ends] = words.hashes, END
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.concatenate(([0], ends[:-1] + 1))[:rows] if rows else []] = START
    return token, mix(before), row


def seats(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after the customers of each dish sat down one after the other: a new table with odds pull : customers - discount *
    tables. From the 64th on, customers sit down in groups of an eighth of those seated, with odds as at the middle of the group."""
    tables = np.minimum(customers, 1).astype(np.float64)
    open_ = np.flatnonzero(customers > 1)
    at = 1
    while len(open_):
        group = max(1, at // 8) if at >= 64 else 1
        size = np.minimum(customers[open_] - at, group)
        a = pull[open_]
        chance = a / (a + np.maximum(at + (size - 1) / 2 - discount * tables[open_], 1e-9))
        tables[open_] += (rng.random(len(open_)) < chance) if group == 1 else rng.binomial(size, chance)
        at += group
        open_ = open_[customers[open_] > at]
    return tables


class Bucket:
    """Customers by (word, context), and the kept samples of their seating. ``outside``: each context's customers and dishes in other
    buckets; ``hot``: which words have customers in other buckets too; ``vocabulary``: distinct words learnt anywhere."""

    def __init__(self, word: np.ndarray, cls: np.ndarray, count: np.ndarray, words: int, seed: int, parts: int, contexts: int = CLASSES,
                 outside: tuple[np.ndarray, np.ndarray] | None = None, hot: np.ndarray | None = None, vocabulary: int | None = None):
        self.word, self.cls, self.count, self.words, self.contexts = word, cls, count.astype(np.int64), words, contexts
        self.outside = outside or (np.zeros(contexts), np.zeros(contexts))
        self.hot = np.zeros(words, bool) if hot is None else hot
        self.vocabulary = len(np.unique(word[self.count > 0])) if vocabulary is None else vocabulary
        self.samples = list(self._chain(np.random.default_rng([97, seed]), parts)) if words else []

    def _chain(self, rng: np.random.Generator, parts: int):
        d, d0 = DISCOUNTS
        s, s0 = STRENGTHS
        again = self.count > 1
        repeats = max(1, int((self.count[again] - 1).sum()))
        t = np.minimum(self.count, 1).astype(np.float64)
        vocabulary = self.vocabulary + 1
        share = np.where(self.hot, 1, parts)  # a cold word stands for as many in other buckets
        for sweep in range(BURN + SAMPLES):
            up = np.bincount(self.word, t, self.words) * np.where(self.hot, parts, 1)
            t0 = np.minimum(up, 1) if sweep == 0 else t0
            t0 = seats(up.astype(np.int64), np.full(self.words, (s0 + d0 * (share * t0).sum()) / vocabulary), d0, rng)
            p0 = (np.maximum(up - d0 * t0, 0) + (s0 + d0 * (share * t0).sum()) / vocabulary) / (s0 + (share * up).sum())
            more = (t[again] - 1).sum() / repeats
            per_context = np.bincount(self.cls, t, self.contexts) + self.outside[1] + more * (self.outside[0] - self.outside[1])
            t = seats(self.count, (s + d * per_context[self.cls]) * p0[self.word], d, rng)
            if sweep >= BURN:
                up = np.bincount(self.word, t, self.words) * np.where(self.hot, parts, 1)
                t0 = seats(up.astype(np.int64), np.full(self.words, (s0 + d0 * (share * t0).sum()) / vocabulary), d0, rng)
                yield t, t0, up

    def tables(self) -> np.ndarray:
        """Tables by sample and context."""
        return np.array([np.bincount(self.cls, t, self.contexts) for t, _, _ in self.samples] or np.zeros((SAMPLES, self.contexts)))

    def numbers(self) -> np.ndarray:
        """All sums that probabilities need: customers by context, then per sample tables by context, parent customers and parent
        tables, and last the vocabulary. They are whole only where there is one bucket."""
        parts = [np.bincount(self.cls, self.count, self.contexts)]
        for own, (_, t0, up) in zip(self.tables(), self.samples or [(None, np.zeros(1), np.zeros(1))] * SAMPLES):
            parts += [own, [up.sum()], [t0.sum()]]
        return np.concatenate(parts + [[self.vocabulary]])

    def probabilities(self, word: np.ndarray, cls: np.ndarray, at: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """P(word | context) averaged over the samples; ``at``: the place of the pair among the customers, or -1."""
        d, d0 = DISCOUNTS
        s, s0 = STRENGTHS
        n = self.contexts
        seen, vocabulary = totals[:n], totals[-1] + 1
        out = np.zeros(len(word))
        for k, (t, t0, up) in enumerate(self.samples):
            own = totals[n + k * (n + 2):]
            tables, guests, high = own[:n], own[n], own[n + 1]
            p0 = (np.maximum(up - d0 * t0, 0) + (s0 + d0 * high) / vocabulary) / (s0 + guests)
            here = np.where(at >= 0, self.count[at] - d * t[at], 0.0)
            out += (np.maximum(here, 0) + (s + d * tables[cls]) * p0[word]) / (s + seen[cls])
        return out / SAMPLES


def hot_words(batches):
    """Words with a large share of a group's tokens, and the number of tokens (under word null)."""
    for batch in batches:
        for _, words in word_groups(batch.column("text")):
            token, _, _ = tokens_of(words)
            seen, n = np.unique(token, return_counts=True)
            top = n >= max(1, HOT_SHARE * len(token))
            yield pa.record_batch([pa.array([None, *seen[top].view(np.int64).tolist()], pa.int64()), pa.array(np.r_[len(token), n[top]])], names=["word", "n"])


_PACK = "bucket long, hot boolean, words binary, runs binary, contexts binary, classes binary, docs binary, times binary, keys binary, learnt binary"
_NAMES = [f.split()[0] for f in _PACK.split(", ")]
_KEPT = "bucket long, words binary, hot binary, contexts binary, word binary, class binary, count binary, spots binary, doc binary, times binary, keys binary"


def _packed(hot: np.ndarray, parts: int):
    """Tokens of a group by bucket, sorted by word: each distinct word, context and row once, then a context and a row per token; a
    hot word's tokens are dealt by word and context, and those of one row are one place with a number."""
    def run(batches):
        for batch in batches:
            for first, words in word_groups(batch.column("text")):
                n = len(words.firsts) - 1
                token, ctx, row = tokens_of(words)
                key = np.asarray(batch.column("key").slice(first, n)).astype(np.int64)
                learnt = ~np.asarray(batch.column("held_out").slice(first, n).to_pylist(), bool)
                slot = np.minimum(np.searchsorted(hot, token), max(0, len(hot) - 1))
                is_hot = hot[slot] == token if len(hot) else np.zeros(len(token), bool)
                out = {name: [] for name in _NAMES}
                pick = np.flatnonzero(is_hot)
                pair = mix(token[pick] ^ mix(ctx[pick]))
                _, one, times = np.unique(mix(pair ^ (row[pick].astype(np.uint64) << np.uint64(32))), return_index=True, return_counts=True)
                pair, pick = pair[one], pick[one]
                order = np.lexsort((token[pick], _dealt(pair, parts)))
                pair, pick, times = pair[order], pick[order], times[order]
                _emit(out, True, _dealt(pair, parts), token[pick], ctx[pick], row[pick], times, key, learnt)
                cold = np.flatnonzero(~is_hot)
                cold = cold[np.argsort(token[cold], kind="stable")]
                _emit(out, False, _dealt(token[cold], parts), token[cold], ctx[cold], row[cold], None, key, learnt)
                yield pa.record_batch([pa.array(out[k], {"bucket": pa.int64(), "hot": pa.bool_()}.get(k, pa.binary())) for k in _NAMES], names=_NAMES)
    return run


def _dealt(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _narrow(values: np.ndarray, most: int) -> np.ndarray:
    return values.astype(np.uint16 if most < 1 << 16 else np.uint32)


def _wide(cell: bytes, size: int) -> np.ndarray:
    return np.frombuffer(cell, np.uint32 if len(cell) == 4 * size else np.uint16)


def _emit(out, hot, bucket, token, ctx, row, times, key, learnt):
    for b in np.unique(bucket):
        lo, hi = np.searchsorted(bucket, [b, b + np.uint64(1)])
        seen, runs = np.unique(token[lo:hi], return_counts=True)
        contexts, classes = np.unique(ctx[lo:hi], return_inverse=True)
        which, docs = np.unique(row[lo:hi], return_inverse=True)
        often = np.zeros(0, np.uint16) if times is None else _narrow(times[lo:hi], int(times[lo:hi].max()))
        for name, v in zip(_NAMES, (int(b), hot, seen, runs.astype(np.uint32), contexts, _narrow(classes, len(contexts)), _narrow(docs, len(which)), often,
                                    key[which], learnt[which].astype(np.uint8))):
            out[name].append(v if name in ("bucket", "hot") else v.tobytes())


def _joined(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(token, context, learnt, times, document, hot) of every place of a bucket, and its contexts and the keys of its documents.
    Narrow columns filled in place: a bucket's places are held once, contexts and documents are numbers from the start."""
    cells = [(np.frombuffer(r.words, np.uint64), np.frombuffer(r.runs, np.uint32), np.frombuffer(r.keys, np.int64), np.frombuffer(r.contexts, np.uint64)) for r in rows.itertuples(index=False)]
    sizes = [int(c[1].sum(dtype=np.int64)) for c in cells]
    used, doc_of = np.unique(np.concatenate([c[2] for c in cells]), return_inverse=True)
    contexts, ctx_of = np.unique(np.concatenate([c[3] for c in cells]), return_inverse=True)
    doc_of, ctx_of = doc_of.astype(np.uint32), ctx_of.astype(np.uint32)
    n = sum(sizes)
    token, ctx, learnt = np.empty(n, np.uint64), np.empty(n, np.uint32), np.empty(n, bool)
    times, doc, hots = np.ones(n, np.uint32), np.empty(n, np.uint32), np.zeros(n, bool)
    at = first = start = 0
    for r, (words, runs, keys, own), size in zip(rows.itertuples(index=False), cells, sizes):
        here, docs = slice(at, at + size), _wide(r.docs, size)
        token[here], ctx[here] = np.repeat(words, runs), ctx_of[start:start + len(own)][_wide(r.classes, size)]
        doc[here], learnt[here] = doc_of[first:first + len(keys)][docs], (np.frombuffer(r.learnt, np.uint8) > 0)[docs]
        if r.hot:
            times[here], hots[here] = _wide(r.times, size), True
        at, first, start = at + size, first + len(keys), start + len(own)
    return token, ctx, learnt, times, doc, hots, contexts, used


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and the place of each among them, as np.unique gives them, in four bytes a place."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(ranked), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    at = np.empty(len(values), np.uint32)
    at[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return ranked[new], at


def _trained(parts: int):
    """A bucket: its words, contexts and documents, the customers of each pair, and the places of each pair in their order."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        token, ctx, learnt, times, doc, hots, contexts, used = _joined(rows)
        words, word = _numbered(token)
        del token
        is_hot = np.zeros(len(words), bool)
        is_hot[word[hots]] = True
        del hots
        pairs, at = _numbered(word * np.uint64(len(contexts)) + ctx)
        del word, ctx
        number = np.bincount(at, times * learnt, len(pairs)).astype(np.int64)
        del learnt
        spots, order = np.bincount(at, minlength=len(pairs)), np.argsort(at, kind="stable")
        del at
        pack = lambda v, t: np.asarray(v).astype(t, copy=False).tobytes()
        places = pack(doc[order], np.uint32)
        often = pack(times[order], np.uint32 if (times > 255).any() else np.uint8)
        del doc, times, order
        return pd.DataFrame([{"bucket": int(key[0]), "words": words.tobytes(), "hot": pack(is_hot, np.uint8), "contexts": contexts.tobytes(), "word": pack(pairs // np.uint64(len(contexts)), np.uint32),
                              "class": pack(pairs % np.uint64(len(contexts)), np.uint32), "count": pack(number, np.uint32), "spots": pack(spots, np.uint32),
                              "doc": places, "times": often, "keys": used.tobytes()}])
    return run


def _cells(batch: pa.RecordBatch, i: int):
    return lambda name, t: np.frombuffer(batch.column(name)[i].as_py(), t)


def _classes(hashes: np.ndarray, classes: int):
    """(class, slice) of each class that sorted hashes have."""
    own = _dealt(hashes, classes)
    for c in np.unique(own):
        yield int(c), slice(*np.searchsorted(own, [c, c + np.uint64(1)]))


_SHARES = "class int, bucket long, contexts binary, own binary, word long, sums array<double>"


def _share_rows(bucket: int, contexts: np.ndarray, own: np.ndarray, classes: int, sums: list):
    """A bucket's numbers by context (``own``: a row of them per kind) in classes, and its sums by hot word, null for all others."""
    part = [(c, bucket, contexts[at].tobytes(), np.ascontiguousarray(own[:, at]).astype(np.uint32).tobytes(), None, None) for c, at in _classes(contexts, classes)]
    columns = list(zip(*part, *[(-1, bucket, None, None, w, v) for w, v in sums]))
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.float64()))
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in _SHARES.split(", ")])


def _customers(classes: int):
    """Customers and dishes of each context of a bucket, and its customers and words."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = _cells(batch, i)
                contexts, words, hot = get("contexts", np.uint64), get("words", np.uint64), get("hot", np.uint8) > 0
                cls, count = get("class", np.uint32), get("count", np.uint32)
                known = np.bincount(get("word", np.uint32), count, len(words))
                own = np.array([np.bincount(cls, count, len(contexts)), np.bincount(cls, count > 0, len(contexts))])
                cold = known[~hot]
                sums = [(None, [cold.sum(), float((cold > 0).sum())])] + [(int(w), [n, 0.0]) for w, n in zip(words[hot].view(np.int64), known[hot])]
                yield _share_rows(batch.column("bucket")[i].as_py(), contexts, own, classes, sums)
    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """The sums over all buckets of a class of contexts, for each bucket those of its own contexts."""
    cells = [np.frombuffer(c, np.uint64) for c in rows["contexts"]]
    kinds = len(rows["own"].iloc[0]) // (4 * len(cells[0]))
    contexts, at = np.unique(np.concatenate(cells), return_inverse=True)
    own = np.concatenate([np.frombuffer(c, np.uint32).reshape(kinds, -1) for c in rows["own"]], axis=1)
    sums = np.array([np.bincount(at, kind, len(contexts)) for kind in own])
    kind = np.uint32 if sums.max() < 1 << 32 else np.uint64
    ends = np.cumsum([0] + [len(c) for c in cells])
    return pd.DataFrame({"class": rows["class"], "bucket": rows["bucket"], "size": np.dtype(kind).itemsize, "sums": [np.ascontiguousarray(sums[:, at[a:b]]).astype(kind).tobytes() for a, b in zip(ends, ends[1:])]})


def _totals(shares: DataFrame, name: str) -> DataFrame:
    """One row per bucket: the sums of all its contexts, by class."""
    added = shares.filter("class >= 0").select("class", "bucket", "contexts", "own").groupBy("class").applyInPandas(_added, "class int, bucket long, size int, sums binary")
    return added.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("class", "size", "sums"))).alias(name))


def _collected(shares: DataFrame) -> dict:
    """Sums by hot word, at most 1 / HOT_SHARE of them, and under None those of all others."""
    each = shares.filter("class < 0").select("word", F.posexplode("sums").alias("k", "v")).groupBy("word", "k").agg(F.sum("v").alias("v")).collect()
    out: dict = {}
    for r in sorted(each, key=lambda r: r["k"]):
        out.setdefault(r["word"], []).append(r["v"])
    return out


def _unpacked(batch: pa.RecordBatch, i: int, parts: int, vocabulary: int):
    """A bucket as it lies, and its contexts' customers everywhere; seated the same way each time."""
    get = _cells(batch, i)
    word, cls, count = get("word", np.uint32).astype(np.int64), get("class", np.uint32), get("count", np.uint32)
    words, contexts, hot = get("words", np.uint64), get("contexts", np.uint64), get("hot", np.uint8) > 0
    customers, dishes = _whole(batch, i, "customers", 2)
    outside = customers - np.bincount(cls, count, len(contexts)), dishes - np.bincount(cls, count > 0, len(contexts))
    return get, words, contexts, customers, Bucket(word, cls, count, len(words), batch.column("bucket")[i].as_py(), parts, len(contexts), outside, hot, vocabulary)


def _whole(batch: pa.RecordBatch, i: int, name: str, kinds: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(c["sums"], f"u{c['size']}").reshape(kinds, -1) for c in batch.column(name)[i].as_py()], axis=1).astype(np.float64)


def _tables(parts: int, classes: int, vocabulary: int):
    """Tables of each context of a bucket, by sample, and its parents' customers and tables."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, words, contexts, _, bucket = _unpacked(batch, i, parts, vocabulary)
                up, t0 = np.array([s[2] for s in bucket.samples]), np.array([s[1] for s in bucket.samples])
                hot = bucket.hot
                sums = [(None, [*up[:, ~hot].sum(axis=1), *t0[:, ~hot].sum(axis=1)])]
                sums += [(int(w), [*(v / parts), *[0.0] * SAMPLES]) for w, v in zip(words[hot].view(np.int64), up[:, hot].T)]
                yield _share_rows(batch.column("bucket")[i].as_py(), contexts, bucket.tables(), classes, sums)
    return run


class Parents:
    """What all buckets share: tokens and words learnt, hot words' customers, and each sample's parent restaurant."""

    def __init__(self, customers: dict, tables: dict):
        self.hot = np.array(sorted(w for w in customers if w is not None), np.int64)
        self.known = np.array([customers[w][0] for w in self.hot.tolist()])
        cold = customers.get(None, [0.0, 0.0])
        self.tokens, self.vocabulary = cold[0] + self.known.sum(), int(cold[1] + (self.known > 0).sum())
        rest = tables.get(None, [0.0] * 2 * SAMPLES)
        (_, d0), (_, s0) = DISCOUNTS, STRENGTHS
        self.up = np.array([tables[w][:SAMPLES] if w in tables else [0.0] * SAMPLES for w in self.hot.tolist()]).reshape(-1, SAMPLES).T
        self.t0, self.sums = np.minimum(self.up, 1), []
        for k in range(SAMPLES):
            rng = np.random.default_rng([98, k])
            for _ in range(BURN):
                self.t0[k] = seats(np.rint(self.up[k]).astype(np.int64), np.full(len(self.hot), (s0 + d0 * (rest[SAMPLES + k] + self.t0[k].sum())) / (self.vocabulary + 1)), d0, rng)
            self.sums.append((rest[k] + self.up[k].sum(), rest[SAMPLES + k] + self.t0[k].sum()))


def _scores(parts: int, classes: int, shared: Parents):
    """A bucket's part of the scores of its texts, in classes of texts."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get, words, contexts, customers, bucket = _unpacked(batch, i, parts, shared.vocabulary)
                hot = np.flatnonzero(bucket.hot)
                slot = np.searchsorted(shared.hot, words[hot].view(np.int64))
                known = np.bincount(bucket.word, bucket.count, len(words)).astype(np.float64)
                known[hot] = shared.known[slot]
                for k, (_, t0, up) in enumerate(bucket.samples):
                    up[hot], t0[hot] = shared.up[k][slot], shared.t0[k][slot]
                tables = _whole(batch, i, "tables", SAMPLES)
                totals = np.concatenate([customers, *[x for k in range(SAMPLES) for x in (tables[k], shared.sums[k])], [shared.vocabulary]])
                p = np.log10(bucket.probabilities(bucket.word, bucket.cls, np.arange(len(bucket.word)), totals))
                own = known[bucket.word]
                base = np.log10((own + 1) / (shared.tokens + shared.vocabulary + 1))
                doc, keys, spots = get("doc", np.uint32), get("keys", np.int64), get("spots", np.uint32)
                raw = batch.column("times")[i].as_py()
                times = np.frombuffer(raw, np.uint8 if len(raw) == len(doc) else np.uint32).astype(np.float64)
                sums = np.array([np.bincount(doc, np.repeat(v, spots) * times, len(keys)) for v in (np.ones(len(p)), own > 0, base, p)])
                order = np.argsort(keys.view(np.uint64), kind="stable")
                keys, sums = keys[order], sums[:, order]
                part = [(c, keys[at].tobytes(), np.ascontiguousarray(sums[:, at]).tobytes()) for c, at in _classes(keys.view(np.uint64), classes)]
                yield pa.record_batch([pa.array([c for c, *_ in part], pa.int32()), pa.array([k for _, k, _ in part], pa.binary()), pa.array([v for *_, v in part], pa.binary())], names=["class", "keys", "sums"])
    return run


def _per_text(rows: pd.DataFrame) -> pd.DataFrame:
    used, at = np.unique(np.concatenate([np.frombuffer(c, np.int64) for c in rows["keys"]]), return_inverse=True)
    own = np.concatenate([np.frombuffer(c, np.float64).reshape(4, -1) for c in rows["sums"]], axis=1)
    n, known, base, score = (np.bincount(at, v, len(used)) for v in own)
    return pd.DataFrame({"key": used, "n_tokens": np.rint(n).astype(np.int64), "n_known": np.rint(known).astype(np.int64), "base_score": base, "score": score})


def scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """Per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, the model's log10 probability.

    Words have A-Z lower-cased; every text ends with one end token, so a null, empty or blank text is that token alone. Rows for
    which ``held_out`` is false or null are learnt from. Repeated rows are learnt from and scored each, alike. With nothing learnt
    every token has the uniform probability over the one unseen word. Other columns are dropped; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), text).alias("key"))
    counted = stage(given.mapInArrow(hot_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    tokens = counted.filter("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = counted.filter(F.col("word").isNotNull() & (F.col("n") >= max(2.0, HOT_SHARE * tokens))).select("word")
    hot = np.sort(np.array([r[0] for r in frequent.collect()], np.int64).view(np.uint64))
    parts = max(1, -(-tokens // BUCKET_TOKENS))
    classes = CLASSES * -(-parts // CLASSES)
    packed = given.mapInArrow(_packed(hot, parts), _PACK)
    kept = placed(packed.groupBy("bucket").applyInPandas(_trained(parts), _KEPT), "restaurants", "bucket", dealt=True, buckets=2 * parts)  # an Arrow batch holds all buckets of a task
    shares = stage(kept.select("bucket", "words", "hot", "contexts", "word", "class", "count").mapInArrow(_customers(classes), _SHARES), "customers")
    customers = _collected(shares)
    vocabulary = Parents(customers, {}).vocabulary
    with_customers = kept.join(stage(_totals(shares, "customers"), "context-customers").hint("shuffle_hash"), "bucket")
    seated = stage(with_customers.drop("spots", "doc", "times", "keys").mapInArrow(_tables(parts, classes, vocabulary), _SHARES), "tables")
    shared = Parents(customers, _collected(seated))
    whole = with_customers.join(_totals(seated, "tables").hint("shuffle_hash"), "bucket")
    scored = whole.mapInArrow(_scores(parts, classes, shared), "class int, keys binary, sums binary")
    per_text = scored.groupBy("class").applyInPandas(_per_text, "key long, n_tokens long, n_known long, base_score double, score double")
    both = given.select("key", "doc_id", "held_out", F.lit(1).alias("one")).unionByName(per_text, allowMissingColumns=True)
    per = both.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
                                  F.sum("base_score").alias("base_score"), F.sum("score").alias("score"), F.count("one").alias("copies"))
    alike = lambda name: (F.col(name) / F.col("copies")).alias(name)
    count = lambda name: (F.col(name) / F.col("copies")).cast("long").alias(name)
    return (per.select("doc_id", "held_out", count("n_tokens"), count("n_known"), F.lit(int(shared.tokens)).cast("long").alias("train_tokens"),
                       alike("base_score"), alike("score"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_"))).drop("_")
