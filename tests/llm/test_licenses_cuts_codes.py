"""License scan, fill-in-middle and vector codes against brute-force versions, and on the rows that break things."""
import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import fill_middle, licenses, vector_codes

CLASHING = ("w", "x", "n", "form", "output", "places", "spans", "labels", "score", "words", "part", "entry", "sums", "vector", "code", "error", "label_error", "rows", "c", "t", "f")
LONG = "x" * 300_000
AWKWARD = [None, "", " \n\t ", "a", "É!", LONG, "word " * 40_000, "the license " * 30_000, "one two three", "one two three"]


def with_clashes(df):
    return df.withColumns({c: F.lit(1) for c in CLASHING if c not in df.columns})


def docs_of(spark, texts):
    return with_clashes(spark.createDataFrame([(i if i != 4 else None, t) for i, t in enumerate(texts)], "doc_id long, text string"))


# ------------------------------------------------------------------------------------------------ licenses
def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def license_rule(text, templates):
    words = re.findall(licenses.WORD, lowered(text))
    places = sorted((k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split())
    spans = []
    for t in map(lambda x: licenses.template(*x), templates):
        for at in range(-len(t.words), len(words)):
            same = [0 <= at + j < len(words) and words[at + j] == w for j, w in enumerate(t.words)]
            if sum(same) >= t.need and all(same[j] for j in t.keys):
                spans.append((t.label, max(at, 0), min(at + len(t.words), len(words)), sum(same) / len(t.words)))
    labels = {label for _, label in places} | {s[0] for s in spans}
    return len(words), places, sorted(spans), ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)), 1.0 if places else max((s[3] for s in spans), default=0.0)


def check_licenses(spark, texts, templates):
    got = licenses.license_scan(docs_of(spark, texts), templates).collect()
    tidy = lambda r: (r.doc_id, r.n_words, [tuple(p) for p in r.places], [tuple(s) for s in r.spans], r.base_labels, r.labels, r.score)
    want = [(i if i != 4 else None, *license_rule(t, templates)) for i, t in enumerate(texts)]
    assert sorted(map(tidy, got), key=str) == sorted(want, key=str)
    return got


def test_license_scan_brute_force(spark):
    """Sentences with changed, lost and doubled words, at the ends of texts and beside each other, marks of all kinds between words."""
    rng = random.Random(1)
    noise = ["the", "license", "of", "under", "public", "été", "4", "mit", "general", "free", "and", "software"]
    texts = ["", "MIT License", "x the Apache  License,\nVersion 2.0", "GNU General-Public License"]
    for _ in range(150):
        words = rng.choices(noise, k=rng.choice([0, 1, 8, 40]))
        for _ in range(rng.choice([1, 1, 2])):
            own = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(noise)
            if rng.random() < 0.2:
                del own[rng.randrange(len(own))]
            own = own[rng.choice([0, 0, 0, 1, 3]):len(own) - rng.choice([0, 0, 0, 1, 2])]
            at = rng.choice([0, len(words), rng.randint(0, len(words))])
            words[at:at] = own
        texts.append("".join((w.upper() if rng.random() < 0.2 else w) + rng.choice([" ", ", ", "\n * ", "(", " / "]) for w in words))
    got = check_licenses(spark, texts, licenses.TEMPLATES)
    assert sum(bool(r.spans) for r in got) > 40 and sum(not r.spans for r in got) > 30 and {s.share for r in got for s in r.spans if s.share < 1}


def test_license_index_changes_the_work_only(spark):
    """Rarity turned round gives other postings and the same spans; short templates are found too."""
    templates = [("one", "alpha", "alpha"), ("two", "beta gamma", "gamma"), ("five", "a b a b a", "b a"), ("cc", "licensed under cc by nc 4 0", "cc by nc")]
    texts = ["alpha beta gamma", "beta x gamma", "a b a b a b a b", "a a a b a", "alpha " * 50, "licensed by cc by nc 4 0", "licensed under cc by 4 0"]
    known = [licenses.template(*t) for t in templates]
    check_licenses(spark, texts, templates)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = []
    for sign in (1, -1):
        index = licenses.positional_index(known, {w: sign * len(w) * k for t in known for k, w in enumerate(t.words)})
        found.append([r[0] for r in df.select(licenses.aligned(licenses.words_of(F.col("text")), known, index)).collect()])
    assert found[0] == found[1] and any(found[0])
    with pytest.raises(ValueError):
        licenses.template("x", "a b c", "c b")


def test_license_scan_awkward(spark):
    check_licenses(spark, AWKWARD, licenses.TEMPLATES)
    assert licenses.license_scan(docs_of(spark, AWKWARD).limit(0)).count() == 0
    same = ["Licensed under CC BY-NC 4.0."] * 30 + ["plain words"]
    assert collections.Counter(r.labels for r in check_licenses(spark, same, licenses.TEMPLATES)) == {"cc-by-nc": 30, "": 1}


def test_license_scan_uses_no_python_worker(spark):
    plan = licenses.license_scan(docs_of(spark, AWKWARD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ------------------------------------------------------------------------------------------ fill in middle
def cut_rule(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_brute_force(spark):
    rng = random.Random(2)
    parts = ["a", "wörd", "𠮷𠮷", " ", "\n\n", "\t", "<", "P>", "<P", "\x0b", "\xa0", "<S", ">"]
    texts = AWKWARD + ["<P>", "x <M> y", "<<S>>", "a<P"] + ["".join(rng.choices(parts, k=rng.choice([1, 2, 5, 60]))) for _ in range(400)]
    made = fill_middle.fill_in_middle(docs_of(spark, texts)).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = made.collect()
    want = {(i if i != 4 else None): (cut_rule(i if i != 4 else None, t), t or "") for i, t in enumerate(texts)}
    assert len(got) == len(texts)
    for r in got:
        assert ((r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.back) == want[r.doc_id]
    forms = collections.Counter(r.form for r in got)
    assert forms["plain"] > 100 and forms["spm"] > 100 and forms["psm"] > 20
    assert fill_middle.fill_in_middle(docs_of(spark, AWKWARD).limit(0)).count() == 0


def test_fill_in_middle_shares_are_parameters(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    forms = lambda **k: {r.form for r in fill_middle.fill_in_middle(df, **k).select("form").distinct().collect()}
    assert forms(cut_percent=0) == {"plain"} and forms(cut_percent=100, suffix_first_percent=0) == {"psm"} and forms(cut_percent=100, suffix_first_percent=100) == {"spm"}
    cuts = lambda seed: [r.prefix_chars for r in fill_middle.fill_in_middle(df, seed, 100).orderBy("doc_id").collect()]
    assert cuts("42:") == cuts("42:") != cuts("43:")


def test_borders_of_very_long_texts():
    for text in ("x" * 3_000_000, " " * 3_000_000, "ab " * 500_000, " \n" * 500_000 + "a"):
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        n, low, high = fill_middle.cuts(text, 7, len(units))
        assert (n, low, high) == (len(units), *sorted((sum(map(len, units[:7 % (n + 1)])), len(text))))


# -------------------------------------------------------------------------------------------- vector codes
def code_rule(rows, parts=8, entries=16, rounds=6):
    kept = [(i, label, [math.floor(4096 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    size = len(kept[0][2]) // parts
    cut = lambda v, k: tuple(v[k * size:(k + 1) * size])
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[list(cut(v, k)) for _, _, v in first] for k in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            groups = collections.defaultdict(list)
            for _, _, v in kept:
                groups[near(cut(v, k), books[k])[1]].append(cut(v, k))
            for j, own in groups.items():
                books[k][j] = [sum(c) // len(own) for c in zip(*own)]
    found = [(i, label, [near(cut(v, k), books[k]) for k in range(parts)]) for i, label, v in kept]
    sums = collections.Counter()
    for _, label, f in found:
        sums[label] += sum(d for d, _ in f)
    return [(i, "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), sums[label]) for i, label, f in found], ",".join(str(x) for b in books for e in b for x in e)


def vectors_of(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))


def check_codes(spark, rows):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    codes, books = vector_codes.vector_codes(vectors_of(spark, rows).repartition(3))
    want, listed = code_rule(rows)
    got = [(r.vec_id, r.code, r.error, r.label_error) for r in codes.select("vec_id", "code", "error", "label_error").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and vector_codes.listed(books) == listed
    assert vector_codes.digest(books) == hashlib.sha256(listed.encode()).hexdigest()
    return got


@pytest.mark.parametrize("width, spread", [(16, 1.0), (64, 0.01), (8, 0.0006)])
def test_vector_codes_brute_force(spark, width, spread):
    """Spread components, and components so close that most distances tie."""
    rng = np.random.default_rng(width)
    centres = rng.normal(0, spread, (9, width))
    rows = [(int(i), (centres[rng.integers(9)] + rng.normal(0, spread / 4, width)).tolist(), [None, 1, 2][rng.integers(3)]) for i in rng.permutation(260) * 3 - 90]
    got = check_codes(spark, rows)
    assert len(got) == 260 and len({c for _, c, *_ in got}) > 20


def test_vector_codes_awkward(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=8).tolist(), 1) for i in range(20)]
    odd = [(100, None, 1), (101, [None] * 8, 1), (102, [float("nan")] * 8, None), (103, [float("inf")] + [0.0] * 7, 2), (104, [-0.0] * 8, None), (None, [0.25] * 8, None), (105, [1e-30] * 8, 3), (106, [-1e-30] * 8, 3)]
    assert {i for i, *_ in check_codes(spark, good + odd)} == set(range(20)) | {104, None, 105, 106}
    check_codes(spark, good[:5] + good[:5])  # repeated rows and fewer vectors than entries
    check_codes(spark, [(i, [0.5] * 8, 1) for i in range(40)])  # nothing but ties
    check_codes(spark, [(i, [3e4, -3e4] * 4, None) for i in range(3)] + [(9, [0.0] * 8, 1)])  # the largest components allowed
    for empty in ([(1, None, 1)], []):
        codes, books = vector_codes.vector_codes(vectors_of(spark, empty))
        assert codes.count() == 0 and books == [] and codes.columns == ["vec_id", "label", "code", "error", "label_error"]
    check_codes(spark, [(1, [], 1), (2, [], 2)])
    for bad in ([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], [(1, [1.0] * 9, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(ValueError):
            vector_codes.vector_codes(vectors_of(spark, bad))


def test_many_labels_come_back_by_a_shuffled_join(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist(), None if i % 3 == 0 else i) for i in range(200)]
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 5)
    check_codes(spark, rows)
    rows = [(i, rng.normal(size=8).tolist(), 7 if i % 3 == 0 else i) for i in range(3000)]
    codes, _ = vector_codes.vector_codes(vectors_of(spark, rows))
    told, sums = codes.collect(), collections.Counter()
    for r in told:
        sums[r.label] += r.error
    assert len(told) == 3000 and all(r.label_error == sums[r.label] for r in told)


@pytest.mark.parametrize("width", [1, 2, 8])
def test_equal_average_search_finds_the_nearest(width):
    rng = np.random.default_rng(width)
    for most in (2, 50, 1 << 27):
        parts, book = rng.integers(-most, most, (2000, width)), rng.integers(-most, most, (16, width))
        book[5] = book[3]
        distances = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        entry, best = vector_codes.nearest(parts, book)
        assert (entry == distances.argmin(axis=1)).all() and (best == distances.min(axis=1)).all()
