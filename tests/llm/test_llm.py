"""Each training-data operator against a brute-force version on small rows, and on the rows that break things."""
import base64
import collections
import gzip
import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import (decontaminate, language_id, mixing, near_dedup, pitman_yor, quality, queries, secrets, token_counts, url_rules, warc, words)

SF = "/root/testdata/sf0.001"
AWKWARD = [None, "", " \n\t ", "a", "É!", "x" * 300_000, "word " * 40_000, "one two three"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names operators use inside."""
    rows = [(i, t, "en", None if i % 2 else "s") for i, t in enumerate(AWKWARD)] + [(7, "one two three", "en", "s")] * 2 + [(None, "one two three", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("n", "key", "id", "kept", "rule", "size", "score", "n_words", "set", "words", "h")})


def word_list(text):
    return (text or "").encode().lower().split()


def test_words_and_shingles():
    texts = ["The  cat\nsat", None, "", "É the CAT", "x" * 700_000 + " the"]
    found = list(words.word_groups(pa.array(texts), most=1 << 16))
    split = [found_row for _, w in found for found_row in (w.hashes[a:b].tolist() for a, b in zip(w.firsts, w.firsts[1:]))]
    assert [len(s) for s in split] == [3, 0, 0, 3, 2]
    assert split[0][0] == split[3][1] == split[4][1] and split[0][1] == split[3][2] and len({h for s in split for h in s}) == 5
    w = words.words_of(*words.text_bytes(pa.array(["a b a b", "a", ""])), True)
    hashes, bounds = words.shingles(w, 2)
    assert bounds.tolist() == [0, 3, 4, 4] and hashes[0] == hashes[2] != hashes[1]


def groups(texts, size, percent=80):
    sets = {}
    for i, t in texts.items():
        w = word_list(t)
        sets[i] = {tuple(w)} if 0 < len(w) < size else {tuple(w[k:k + size]) for k in range(len(w) - size + 1)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_brute_force(spark, size):
    """Chains, a crowd of copies of which not every pair is similar, and short texts."""
    rng = random.Random(size)
    base = [f"w{rng.randrange(4000)}" for _ in range(100)]
    texts = {i: " ".join(f"v{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 4, 30]))) for i in range(60)}
    for i in range(60, 200):
        own = list(base)
        for k in rng.sample(range(100), rng.choice([0, 1, 2, 4, 6])):
            own[k] = f"u{rng.randrange(9)}"
        texts[i] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df, size).collect()}
    component, sizes = groups(texts, size)
    assert {i: (r.component_id, r.n_shingles, r.kept) for i, r in got.items()} == {i: (c, sizes[i], c == i) for i, c in component.items()}


def test_signature_estimates():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        pool = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
        n = int(2000 * share / (1 + share) * 2)
        a, b = pool[:2000], np.concatenate([pool[:n], pool[2000:4000 - n]])
        x = near_dedup.signature(near_dedup.minima(a))[0] ^ near_dedup.signature(near_dedup.minima(b))[0]
        lanes = sum(bin((int(v) | int(v) >> 1) & 0x5555555555555555).count("1") for v in x.view(np.uint64))
        assert abs((1 - lanes / near_dedup.HASHES - 0.25) / 0.75 - share) < 0.15


def test_masks_find_every_allowed_substitution():
    spot = lambda m, o: {o + i for i, c in enumerate(m) if c == "1"}
    for length, wrong in ((13, 2), (12, 2), (11, 1), (10, 1), (9, 1)):
        for bad in itertools.combinations(range(length), wrong):
            assert any(not spot(m, o) & set(bad) for m in decontaminate.MASKS for o in range(length - len(m) + 1))


def test_masks_meet_every_change_of_short_items():
    """All placements that the verifier accepts, for every length alone and for all together."""
    spot = lambda m, o: {o + i for i, c in enumerate(m) if c == "1"}
    for length in range(5, 14):
        for given in ([length], range(1, 12)):
            more = [m for m in decontaminate.short_masks([n for n in given if n < 12]) if length < 12 and m.count("1") == decontaminate._weight(length)]
            for wrong in range(int(length * decontaminate.TOLERANCE) + 1):
                for bad in itertools.combinations(range(length), wrong):
                    assert any(not spot(m, o) & set(bad) for m in (*decontaminate.MASKS, *more) for o in range(length - len(m) + 1))


def test_decontamination_of_short_items(spark):
    rng = random.Random(13)
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in range(1, 13)}
    docs, expected, spoilt = [], set(), set()
    for n, own in items.items():
        allowed = int(n * 0.2)
        for wrong in range(allowed + 2):
            for bad in itertools.combinations(range(n), wrong):
                if wrong > allowed and rng.random() > 0.1:
                    continue
                (expected if wrong <= allowed else spoilt).add((len(docs), n))
                docs.append(" ".join(f"f{rng.randrange(10_000)}" for _ in range(20)) + " " + " ".join("no" if k in bad else w for k, w in enumerate(own)) + " end of it")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench).collect()}
    assert got == expected and spoilt


def test_decontamination(spark):
    rng = random.Random(3)
    items = {i: [f"b{rng.randrange(500)}" for _ in range(n)] for i, n in enumerate([30, 20, 13, 9, 3])}
    filler = lambda n: [f"f{rng.randrange(10_000)}" for _ in range(n)]
    docs, expected = {}, set()
    for d in range(40):
        i = d % 5
        own, n = list(items[i]), len(items[i])
        for k in rng.sample(range(n), 0 if n < 9 else 1 if n < 12 else 2 if d % 2 else 0):
            own[k] = "changed"
        docs[d] = " ".join(filler(d * 7) + own + filler(30)).upper()
        expected.add((d, i))
    docs |= {100: " ".join(filler(500)), 101: None, 102: "", 103: " ".join(items[0][:12] + filler(50)), 104: " ".join(items[0][::-1])}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("seed", F.lit(1))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(9, None), (8, "")], "item_id long, text string").withColumn("at", F.lit(2))
    got = decontaminate.overlaps(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= expected
    assert {r.doc_id for r in got} & {100, 101, 102, 104} == set()
    one = next(r for r in got if (r.doc_id, r.item_id) == (0, 0))
    assert (one.start_word, one.end_word, one.equal_words) == (0, 30, 30)
    assert decontaminate.overlaps(frame.limit(0), bench).count() == 0 and decontaminate.overlaps(frame, bench.limit(0)).count() == 0


def test_url_rules(spark):
    urls = [None, "", "nope", "HTTP://WWW.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://a.com/de/", "http://com/fr/1", "http://xorg/", "http://casino-win.net",
            "http://a.casino-x.b.net/p", "http://x.net/a.exe", "http://x.net/a.exec", "http://a.org", "http://a.org?x/es/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(3, urls[3])], "page_id long, url string").withColumn("token", F.lit("x"))
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df, url_rules.rule_table(spark)).orderBy("page_id").collect()]
    by = {g[0]: g[1:] for g in got}
    assert len(got) == len(urls) + 1 and by[0] == by[1] == by[2] == ("", "", None, "allow")
    assert by[3] == ("www.example.org", "/es/x", "example.org/es/", "block") and by[4][2:] == ("example.org/en/1", "block")
    assert by[5][2:] == ("com/de/", "block") and by[6][2:] == ("com/fr/", "allow") and by[7][2:] == (None, "allow")
    assert [by[i][3] for i in (8, 9, 10, 11, 12, 13)] == ["block", "block", "block", "allow", "allow", "allow"]


def test_token_counts_against_word_piece(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(5)
    initial = ["a", "ab", "abc", "b", "c", "abcd", "é"] + ["".join(rng.choices("abcde", k=k)) for k in (2, 3, 4, 5) for _ in range(20)]
    further = ["a", "b", "c", "bc", "é", "cab", "dd"] + ["".join(rng.choices("abcde", k=k)) for k in (2, 3, 4, 5) for _ in range(20)]
    vocabulary = {p: i for i, p in enumerate(dict.fromkeys(initial + ["##" + p for p in further] + ["[UNK]"]))}
    model = tokenizers.models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=1_000_000)
    texts = [" ".join("".join(rng.choices("abcdeé", [6, 6, 6, 3, 3, 1], k=rng.randrange(1, 14))) for _ in range(80)) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts.token_counts(frame, initial, further).collect()}
    for i, t in enumerate(texts):
        pieces = [[x.value for x in model.tokenize(w)] for w in t.split()]
        assert got[i].n_tokens == sum(map(len, pieces)) and got[i].n_unknown == sum("[UNK]" in p for p in pieces)
    assert token_counts.token_counts(odd, initial, further).count() == odd.count()
    assert token_counts.token_counts(frame, [], []).agg(F.sum("n_unknown")).first()[0] == 40 * 80


def test_token_counts_with_the_lone_begin_piece(spark):
    """The real vocabulary: words whose first character has no begin piece start with the lone mark; small ones by brute force."""
    initial, further = token_counts.sentencepiece_vocabulary()
    begin, on = set(initial), set(further)

    def pieces(word, first, then):
        out, at = [], 0
        while at < len(word) or not out:
            known = first if not out else then
            end = next((e for e in range(len(word), at - (not out), -1) if word[at:e] in known), None)
            if end is None:
                return None
            out.append(word[at:end])
            at = end
        return out
    assert "" in begin and pieces("2024", begin, on) == ["", "2", "0", "2", "4"]
    words = ["2024", "3.14", "1", "第一章", "中文没有空格的一行文字", "the", "Häuser", "don't", "(x)", "x2", "\U000f0000", "1\U000f0000", "日本語2024年"]
    rng = random.Random(6)
    words += ["".join(rng.choices("0123456789中文一人the,.é\U000f0000", [9] * 10 + [9] * 4 + [5] * 6 + [1], k=rng.randrange(1, 12))) for _ in range(300)]
    got = {r.doc_id: r for r in token_counts.token_counts(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), initial, further).collect()}
    for i, w in enumerate(words):
        own = pieces(w, begin, on)
        assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == (1, len(own or "?"), own is None)
    small = [["", "a", "abc", "bcd"], ["b", "bc", "d", "ab"]]
    short = ["".join(w) for k in range(1, 6) for w in itertools.product("abcd", repeat=k)]
    row = spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")
    told = {r.doc_id: r.n_tokens * (r.n_unknown == 0) for r in token_counts.token_counts(row, *small).collect()}
    assert told == {i: len(pieces(w, *map(set, small)) or ()) for i, w in enumerate(short)} and sum(map(bool, told.values())) > 50


def test_mixing(spark, odd):
    rows = [(i, " ".join(["w"] * (i % 37)), None if i % 9 == 0 else f"s{i % 4}") for i in range(600)] + [(600, "w " * 9000, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = mixing.plan(df, shards=7, block_words=64)
    got = planned.collect()
    sums = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(p.words for p in r.pieces)
        sums[r.source] += r.taken
    goal = {r.source: r.target for r in got}
    assert all(sums[s] == math.floor(t) for s, t in goal.items())
    assert sum(goal.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(df, shards=7, block_words=64).collect()))
    shards = collections.Counter({r.shard: r.n for r in mixing.mixed(planned).groupBy("shard").agg(F.sum("words").alias("n")).collect()})
    assert len(shards) == 7 and max(shards.values()) - min(shards.values()) < 64 * 12
    spans = mixing.mixed(planned).groupBy("doc_id", "copy", "start").count().filter("count > 1").count()
    assert spans == 0
    assert mixing.plan(odd).count() == odd.count() and mixing.plan(df.limit(0)).count() == 0


def test_pitman_yor(spark, odd):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "of", f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(40))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3]), (500, None)], "doc_id long, text string")
    got = pitman_yor.scores(df, F.col("doc_id") % 5 == 0).collect()
    learnt = collections.Counter(w for i, t in [*enumerate(texts), (3, texts[3])] if i % 5 for w in [*word_list(t), None])
    n, v = sum(learnt.values()), len(learnt)
    assert len(got) == 122
    for r in got:
        own = [*word_list(dict(enumerate(texts)).get(r.doc_id)), None]
        assert r.n_tokens == len(own) and r.n_known == sum(learnt[w] > 0 for w in own) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((learnt[w] + 1) / (n + v + 1)) for w in own)) and r.score < 0
    held = [r for r in got if r.held_out and r.n_tokens > 1]
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)
    out = pitman_yor.scores(odd, F.lit(False))
    assert out.count() == odd.count() and out.filter("score is null").count() == 0
    assert pitman_yor.scores(df.limit(0), F.lit(False)).count() == 0


def test_pitman_yor_hot_words_of_held_out_texts(spark):
    """Every token has its share of both scores: a repeated word that only held-out texts have, and nothing learnt at all."""
    texts = ["the of the", "zzz zzz zzz zzz the", "of zzz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pitman_yor.scores(df, F.col("doc_id") > 0).collect()}
    learnt = collections.Counter([*texts[0].split(), None])
    base = lambda words: sum(math.log10((learnt[w] + 1) / (4 + 3 + 1)) for w in words)
    for i, t in enumerate(texts):
        own = [*t.split(), None]
        assert got[i].base_score == pytest.approx(base(own)) and got[i].n_known == sum(learnt[w] > 0 for w in own)
    extra = {r.doc_id: r for r in pitman_yor.scores(df.union(spark.createDataFrame([(3, "zzz zzz zzz zzz zzz the")], df.schema)), F.col("doc_id") > 0).collect()}
    assert extra[3].score < extra[1].score - 0.1
    nothing = pitman_yor.scores(df, F.lit(True)).collect()
    assert len(nothing) == 3 and all(r.n_known == r.train_tokens == 0 and r.score == pytest.approx(0) and r.base_score == pytest.approx(0) for r in nothing)


def test_pitman_yor_has_a_restaurant_for_each_word_before(spark, monkeypatch):
    """A word that always follows one of a thousand words is expected after it, and not after others that share a hash class with it;
    one bucket and many give nearly the same scores, and all tokens are scored."""
    rng = random.Random(3)
    follows = {f"a{i}": f"b{rng.randrange(40)}" for i in range(1000)}
    pairs = [(a, b) for a, b in follows.items() for _ in range(6)]
    rng.shuffle(pairs)
    lines = [" ".join(f"{a} {b}" for a, b in pairs[i:i + 30]) for i in range(0, len(pairs), 30)]
    asked = rng.sample(sorted(follows), 200)
    right = " ".join(f"{a} {follows[a]}" for a in asked)
    wrong = " ".join(f"{a} b{(int(follows[a][1:]) + 7) % 40}" for a in asked)
    df = spark.createDataFrame([*enumerate(lines), (-1, right), (-2, wrong)], "doc_id long, text string")
    scored = {}
    for size in (10 ** 9, 1500):
        monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", size)
        scored[size] = {r.doc_id: r for r in pitman_yor.scores(df, F.col("doc_id") < 0).collect()}
        got = scored[size]
        assert len(got) == len(lines) + 2 and sum(r.n_tokens for r in got.values()) == 12_000 + len(lines) + 802 and got[-1].train_tokens == 12_000 + len(lines)
        assert got[-1].score > got[-2].score + 200 * 1.2
    assert abs(scored[1500][-1].score - scored[10 ** 9][-1].score) < 0.03 * abs(scored[10 ** 9][-1].score)


def test_pitman_yor_sums_to_one():
    rng = np.random.default_rng(4)
    pairs = np.unique(rng.integers(0, 50 * pitman_yor.CLASSES, 3000))
    bucket = pitman_yor.Bucket(pairs // pitman_yor.CLASSES, (pairs % pitman_yor.CLASSES).astype(np.uint8), rng.integers(1, 300, len(pairs)), 50, 1, 1)
    totals = bucket.numbers()
    place = {p: i for i, p in enumerate(pairs)}
    for c in (0, 77, 255):
        at = np.array([place.get(w * pitman_yor.CLASSES + c, -1) for w in range(50)])
        known = bucket.probabilities(np.arange(50), np.full(50, c), at, totals).sum()
        silent = pitman_yor.Bucket(bucket.word, bucket.cls, bucket.count, 51, 1, 1)
        silent.samples = [(t, np.append(t0, 0), np.append(up, 0)) for t, t0, up in bucket.samples]
        unseen = silent.probabilities(np.array([50]), np.array([c]), np.array([-1]), totals)[0]
        assert known + unseen == pytest.approx(1)


def test_quality(spark, odd):
    got = {(r.doc_id, r.source): r for r in quality.judge(odd).collect()}
    assert got[(None, None)]._base_failed and not got[(2, "s")]._kept and got[(6, "s")]._base_failed
    text = "a b c d e f g h x a b c d e f g h y " + " ".join(f"z{i}" for i in range(20))
    one = quality.judge(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")).first()
    assert one._repeated == 16
    assert quality.judge(odd.limit(0)).count() == 0


def test_language_id(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model, limits = language_id.fit(docs.filter(~out))
    told = language_id.identify(docs.filter(out), model, limits).join(docs.select("doc_id", "lang"), "doc_id")
    right = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98
    got = [(r.lang_pred, r.score) for r in language_id.identify(odd, model, limits).collect()]
    assert len(got) == odd.count() and got[0] == got[1] == got[2] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got)
    nothing = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd, *nothing).collect()} == {"und"}


def test_language_sample_with_very_long_texts(spark):
    """A text longer than the bound that comes first in hash order, one that is all a language has, and copies with one hash."""
    rng = random.Random(12)
    text = lambda letters, n: "".join(rng.choices(letters + " ", k=n))
    short = [("first", text("abcde", 200)) for _ in range(100)]
    h = lambda rows: rows.withColumn("h", F.xxhash64("text"))
    table = lambda rows: spark.createDataFrame(rows, "lang string, text string")
    low = h(table(short)).agg(F.min("h")).first()[0]
    first = h(table([("first", text("abcde", 50_000)) for _ in range(1000)])).filter(F.col("h") < low).drop("h").limit(1).collect()
    assert len(first) == 1
    rows = short + [tuple(first[0])] + [("only", text("vwxyz", 70_000))] + [("copies", "mno " * 50)] * 200 + [("tiny", "q"), ("empty", ""), (None, "abc"), ("null", None)]
    sample = language_id.bounded_sample(table(rows), 10_000)
    sizes = {name: sum(map(len, own)) for name, own in sample.items()}
    assert set(sizes) == {"first", "only", "copies", "tiny", "empty"} and sizes["tiny"] == 1
    assert all(10_000 - 625 < sizes[name] <= 10_000 for name in ("first", "only", "copies"))
    assert len({t for t in sample["first"]} & {t for _, t in short}) > 40 and max(map(len, sample["first"])) <= 625
    whole = rows[101][1]
    assert len(set(sample["only"])) == len(sample["only"]) and all(whole.index(t) % 625 == 0 for t in sample["only"])
    # with all within the bound, every character is in the sample
    assert sorted(map(len, language_id.bounded_sample(table(rows), 1_000_000)["only"])) == [7500] + [62_500]
    model, limits = language_id.fit(table(rows), 10_000)
    probe = spark.createDataFrame([(1, text("abcde", 300)), (2, text("vwxyz", 300))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(probe, model, limits).collect()} == {1: "first", 2: "only"}


def test_kneser_ney_sums_to_one():
    model = language_id.KneserNey({"x": ["abra cadabra", "barb"], "y": ["cabbage"]})
    letters = " abcdegr"
    for before in ("ab", "ra", "zz"):
        e, size = zip(*(model.entropy([before + c + "q"]) for c in letters[1:]))
        assert all(np.isfinite(v).all() for v in e)


def folded(text):
    out = ""
    for c in " " + (text or "") + " ":
        c = c.lower() if c.lower().isalpha() else " "
        out += "" if c == " " and out[-1:] == " " else c
    return out


def kneser_ney_by_hand(texts, alphabet):
    """P(character | history) from dictionaries: counts at the longest order, distinct left neighbours below it."""
    texts, top, d = [folded(t) for t in texts], language_id.ORDER, language_id.DISCOUNT
    seen = {n: [t[i:i + n] for t in texts for i in range(len(t) - n + 1)] for n in range(1, top + 1)}
    counts = {top: {g: seen[top].count(g) for g in set(seen[top])}}
    for n in range(1, top):
        longer = set(seen[n + 1])
        counts[n] = {g: sum(x.endswith(g) for x in longer) or 1 for g in set(seen[n])}

    def p(history, c):
        if history is None:
            return 1 / (alphabet + 1)
        own = {g: k for g, k in counts[len(history) + 1].items() if g[:-1] == history}
        shorter = p(history[1:] if history else None, c)
        total = sum(own.values())
        return max(own.get(history + c, 0) - d, 0) / total + d * len(own) / total * shorter if own else shorter
    return p


def test_kneser_ney_by_dictionaries():
    rng = random.Random(4)
    make = lambda signs, n: "".join(rng.choices(signs, k=n))
    samples = {"x": [make("abcd e", rng.randint(0, 60)) for _ in range(12)] + ["", "a", "Ab!"], "y": [make("bcf, gé", 40) for _ in range(8)]}
    probes = ["abcd", "fog. BCé", "", None, "zz", "c", "1 2"] + [make("abcdefg é", 30) for _ in range(10)]
    model = language_id.KneserNey(samples)
    alphabet = len(set("".join(folded(t) for own in samples.values() for t in own)))
    entropy, size = model.entropy(probes)
    for j, name in enumerate(model.languages):
        p = kneser_ney_by_hand(samples[name], alphabet)
        for i, text in enumerate(map(folded, probes)):
            logs = [-math.log10(p(text[max(0, k - language_id.ORDER + 1):k], text[k])) for k in range(1, len(text))]
            assert size[i] == len(text) and entropy[i, j] == pytest.approx(sum(logs) / max(1, len(logs)), abs=1e-9), (name, text)
        assert sum(p("ab", c) for c in set("".join(folded(t) for own in samples.values() for t in own))) + p("ab", "Z") == pytest.approx(1)


SECRET_TEXTS = ["password: hunter22 token=ab", 'x api_key="AKIA' + "Q" * 20 + '" ' + "0f" * 14, "SECRET=token: abcdefgh", "é password=éabcdef passwd = a.b-c_d/e", "f" * 23 + " " + "a" * 24,
                "key qX9vT2mLw8Zk4RbN7cYp1sHd end", "plain text with nothing", None, "", "the internationalization_of_everything"]


def test_secrets(spark, odd):
    df = spark.createDataFrame(list(enumerate(SECRET_TEXTS)), "doc_id long, text string").withColumn("start", F.lit(1))
    patterns = [(k, re.compile(p), g, n) for k, p, g, n in secrets.KINDS]
    ordinary = spark.createDataFrame([(100 + i, "some ordinary words like configuration parameters or identifiers_v2 in 2024 " * 3 + str(i)) for i in range(50)], "doc_id long, text string").withColumn("start", F.lit(1))
    got = {r.doc_id: r for r in secrets.scan(df.union(ordinary)).withColumn("text", secrets.masked(F.coalesce("text", F.lit("")), F.col("_spans"))).collect()}
    for i, t in enumerate(SECRET_TEXTS):
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(patterns) for m in p.finditer(t or "") if len(m.group(g)) >= n)
        assert [(s.start, s.kind, s.end) for s in got[i]._base] == spans
        assert set(map(tuple, got[i]._base)) <= set(map(tuple, got[i]._spans))
    assert [(s.start, s.end) for s in got[5]._spans] == [(4, 28)] and got[5].text == "key [SECRET] end"
    assert not got[6]._spans and not got[9]._spans and all(not got[100 + i]._spans for i in range(50))
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(odd.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://b/", None), (4, "u", ""), (5, "u", "é" * 200_000), (None, "n", "same"), (2, None, "same")] + [(10 + i, "u", os.urandom(3000).hex()) for i in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("block", F.lit(1))
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(df).collect())
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    expected = collections.Counter()
    for i, _, h in pages:
        body = (h or "").encode()
        own = first[h or ""]
        expected[(i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == own else "revisit", None if i == own else own)] += 1
    assert got == expected
    assert warc.archived(df.limit(0)).count() == 0
    # real files: a monolithic archive in, members and an index out
    whole = b"".join(warc.record_bytes(f"<urn:page:{i}>", "http://x/", f"payload {i} ".encode() * 500, None) for i in range(300))
    (tmp_path / "in").mkdir(), (tmp_path / "out").mkdir()
    (tmp_path / "in" / "m.warc.gz").write_bytes(gzip.compress(whole))
    blocks, index, damaged = warc.normalise(warc.archive_blocks(spark, str(tmp_path / "in")))
    assert damaged.count() == 0
    warc.export_files(blocks, index, str(tmp_path / "out"))
    data = (tmp_path / "out" / "m.warc.gz.warc.gz").read_bytes()
    assert gzip.decompress(data) == whole
    lines = [line.split("\t") for line in (tmp_path / "out" / "m.warc.gz.idx").read_text().splitlines()]
    assert len(lines) == 300
    for offset, length, name in lines[::37]:
        assert name.encode() in zlib.decompress(data[int(offset):int(offset) + int(length)], 31)


def test_damaged_archives_are_reported(spark, tmp_path):
    """Whole records before the damage are kept, and nothing is lost in silence."""
    record = [warc.record_bytes(f"<urn:page:{i}>", "http://x/", os.urandom(4000).hex().encode(), None) for i in range(300)]
    whole = b"".join(record)
    packed = gzip.compress(whole)
    files = {"whole": packed, "members": b"".join(map(gzip.compress, record)), "cut": packed[:len(packed) // 2], "short": gzip.compress(whole[:-1000]),
             "tail": packed + b"no gzip member", "length": gzip.compress(record[0] + b"WARC/1.1\r\nContent-Length: x\r\n\r\n" + record[1]), "zeros": gzip.compress(warc.record_bytes("<urn:page:0>", None, b"0" * 9_000_000, None))}
    for name, data in files.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
    _, index, damaged = warc.normalise(warc.archive_blocks(spark, str(tmp_path)))
    kept = {r.archive.split(".")[0]: r["count"] for r in index.groupBy("archive").count().collect()}
    assert kept["whole"] == kept["members"] == kept["tail"] == 300 and kept["short"] == 299 and 100 < kept["cut"] < 160 and kept["length"] == 1 and kept["zeros"] == 1
    found = {r.archive.split(".")[0]: r for r in damaged.collect()}
    assert set(found) == {"cut", "short", "tail", "length"}
    assert found["cut"].bytes_read == len(files["cut"]) and found["short"].bytes_left == len(record[-1]) - 1000 and "end" in found["cut"].reason
    with pytest.raises(ValueError, match="cut.warc.gz"):
        warc.must_be_whole(damaged)


CLASHING = ("_lang", "_source", "_f", "_Lines", "_squeezed", "_squeezed_")


def test_inputs_may_have_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.withColumns({c: F.lit(c) for c in CLASHING})
    plain = {r.doc_id: (r._kept, r._m) for r in quality.judge(docs).collect()}
    got = quality.judge(wide)
    assert {r.doc_id: (r._kept, r._m) for r in got.collect()} == plain and set(wide.columns) < set(got.columns)
    assert got.filter("_lang <> '_lang' or _f <> '_f' or _lines <> '_Lines'").count() == 0
    assert not [t.name for t in spark.catalog.listTables() if "sketch" in t.name]
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rules = url_rules.rule_table(spark)
    told = lambda df: sorted((r.page_id, r.host, r.rule or "", r.verdict) for r in url_rules.judge_urls(df, rules).collect())
    assert told(pages.withColumns({c: F.lit(1) for c in CLASHING_PAGES})) == told(pages)


CLASHING_PAGES = ("_url", "_p", "_q", "token", "expression", "place", "tokens")


def test_secrets_with_very_many_matches(spark):
    """Positions, model spans and the mask of a dump of keys, across the blocks that sums and texts are cut into."""
    rng = random.Random(3)
    key = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    parts = []
    for i in range(6_000):
        parts.append(rng.choice([f"{rng.getrandbits(128):032x}", f"password = {key(12)}", f"é😀 {key(24)}7a", "plain words here", f"AKIA{key(20).upper()}"]) + rng.choice([" ", "\n", "; "]))
    dump = "".join(parts)
    df = spark.createDataFrame([(1, dump), (2, "no secret"), (3, None), (4, "x" * 300_000), (5, dump + " end")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in secrets.scan(df).withColumn("clean", secrets.masked(F.coalesce("text", F.lit("")), F.col("_spans"))).collect()}
    assert time.time() - began < 120
    for i, t in ((1, dump), (5, dump + " end")):
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(secrets.KINDS) for m in re.finditer(p, t) if len(m.group(g)) >= n)
        assert [(s.start, s.kind, s.end) for s in got[i]._base] == spans and len(got[i]._spans) > len(spans) > 3_000
        runs = {m.span() for m in re.finditer(secrets.CANDIDATE, t)}
        assert all((s.start, s.end) in runs and not any(a < s.end and b > s.start for a, _, b in spans) for s in got[i]._spans if s.kind == 3)
        out, at = [], 0
        for s in got[i]._spans:
            if s.start >= at:
                out += [t[at:s.start], secrets.MARK]
            at = max(at, s.end)
        assert got[i].clean == "".join(out) + t[at:]
    assert got[2].clean == "no secret" and got[3].clean == "" and got[4].clean == "x" * 300_000


def test_token_counts_of_very_long_words():
    initial, further = ["a", "ab", "abc", ""], ["a", "b", "c", "bc", "cab", "é", "éa"]
    made = token_counts.Automaton(initial, further)
    rng = random.Random(5)
    for n in (1, 7, 5_000, 200_000):
        word = "".join(rng.choice("abcé") for _ in range(n)) + rng.choice(["", "z"])
        at, expected, pieces = 0, 0, initial
        while at < len(word):
            size = max((len(p) for p in pieces if word.startswith(p, at)), default=None)
            if size is None:
                expected = 0
                break
            expected, at, pieces = expected + 1, at + size, further
        data = np.frombuffer(word.encode(), np.uint8)
        began = time.time()
        assert made.counts(data, np.array([0]), np.array([len(data)]))[0] == expected and time.time() - began < 5


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.SQL[name])
    columns = [d[0] for d in result.description]
    tidy = lambda rows: sorted(([round(v, 6) if isinstance(v, float) else v for v in r] for r in rows), key=str)
    assert sorted(columns) == sorted(df.columns) and tidy(df.select(columns).collect()) == tidy(result.fetchall())


def test_pipeline(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    once = corpus_pipeline.keep_first_copies(spark, kept, SF)
    component, _ = groups({r.doc_id: r.text for r in kept.collect()}, 5)
    assert sorted(r.doc_id for r in once.collect()) == sorted(set(component.values()))
    clean = corpus_pipeline.drop_leaks(spark, once, SF)
    bench = [word_list(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hold = lambda t, b: any(t[k:k + len(b)] == b for k in range(len(t) - len(b) + 1))
    assert not any(hold(word_list(r.text), b) for r in clean.collect() for b in bench)
    assert once.count() - clean.count() == sum(any(hold(word_list(r.text), b) for b in bench) for r in once.collect())
    masked = corpus_pipeline.mask_secrets(spark, clean, SF)
    assert masked.columns == docs.columns and masked.count() == clean.count()
    assert masked.filter(F.col("text").rlike(secrets.ASSIGN.replace("]+)", "]{6,})"))).count() == 0
    mix = corpus_pipeline.mix_sources(spark, masked, SF)
    assert mix.count() == masked.count()
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, odd.limit(0), SF).count() == 0
        assert function(spark, odd, SF).count() <= odd.count()


def test_near_duplicates_awkward(spark, odd):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None) and all(r.n_shingles == 0 for r in got if r.doc_id in (0, 1, 2))
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_fresh_links_join_components_like_all_links(spark):
    rng = random.Random(5)
    for _ in range(2):
        pairs = [tuple(sorted(rng.sample(range(60), 2))) for _ in range(40)]
        table = lambda rows: spark.createDataFrame(rows, "a long, b long")
        told = lambda df: {r.id: r.component for r in df.collect()}
        assert told(near_dedup.joined_up(near_dedup.connected(table(pairs[:25])), table(pairs[25:]))) == told(near_dedup.connected(table(pairs)))


@pytest.mark.parametrize("percent", [80, 60])
def test_rare_shingles_meet_every_similar_pair(spark, percent):
    """Families around the limit, sets of different sizes, one common shingle: no similar pair is missed, few others meet."""
    rng = random.Random(percent)
    sets = {}
    for family in range(4):
        base = [family * 1000 + k for k in range(60)] + [-1]
        for _ in range(40):
            own = set(rng.sample(base, rng.choice([61, 57, 50]))) | {rng.randrange(10_000, 40_000) for _ in range(rng.choice([0, 2, 5, 14]))}
            sets[len(sets)] = own
    sets |= {200: {5}, 201: {5}, 202: {-1}}
    rows = spark.createDataFrame([(i, i // 2 * 2, sorted(s)) for i, s in sets.items()], "id long, component long, set array<long>")
    found = {(r.a, r.b) for r in near_dedup.rare_pairs(near_dedup.rare_firsts(rows, percent), percent).collect()}
    apart = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if a // 2 != b // 2]
    similar = {(a, b) for a, b in apart if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert similar <= found and all(a < b and a // 2 != b // 2 for a, b in found)
    assert len(similar) > 100 and len(found) < len(apart) / 3


def test_a_large_component_is_not_laid_out_for_each_outsider(spark):
    """A component with one short member, and texts that could be similar to that one alone: rows that joins make, not pairs, are counted."""
    rng = random.Random(3)
    sets = {i: set(range(60)) for i in range(150)} | {150: set(range(50))}
    sets |= {200 + i: set(rng.sample(range(60), 52)) | {2000 + 10 * i + k for k in range(8)} for i in range(60)}
    rows = spark.createDataFrame([(i, 0 if i < 200 else i, sorted(s)) for i, s in sets.items()], "id long, component long, set array<long>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = near_dedup.rare_pairs(near_dedup.rare_firsts(rows, 80), 80)
        found = {(r.a, r.b) for r in pairs.collect()}
        made, left = [], [pairs._jdf.queryExecution().executedPlan()]
        while left:
            node = left.pop()
            if "Join" in node.nodeName():
                made.append(node.metrics().apply("numOutputRows").value())
            left += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    apart = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if b >= 200]
    assert {(a, b) for a, b in apart if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])} <= found
    assert len(made) >= 2 and max(made) < 2_000  # 17 214 when every member went to every component that its own one met


def test_a_bucket_is_trained_in_narrow_columns():
    """Bytes held at once per token; 104 before places were filled in one by one."""
    import tracemalloc
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 5000) for _ in range(500)]
    batch = pa.record_batch([pa.array(texts), pa.array(np.arange(500)), pa.array(np.arange(500) % 7 == 2)], names=["text", "key", "held_out"])
    rows = next(pitman_yor._packed(np.zeros(0, np.uint64), 1)([batch])).to_pandas()
    tokens = sum(int(np.frombuffer(r, np.uint32).sum()) for r in rows.runs)
    tracemalloc.start()
    try:
        out = pitman_yor._trained(1)((0,), rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert tokens == 500 * 401 and np.frombuffer(out["count"][0], np.uint32).sum() == (np.arange(500) % 7 != 2).sum() * 401
    assert peak < 75 * tokens
