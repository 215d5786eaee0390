"""Search against straightforward single-process computations."""
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.functions.udfs import pairs_of
from quillgraph.operators import dense, lexical, search


def passages(spark, rows):
    return spark.createDataFrame(
        [(1, i, f"c{i // 2}", f"s{i // 6}", i // 6, f"title {i // 6}", i * 100, 1, 1, t) for i, t in enumerate(rows)],
        "corpus_id bigint, passage_id bigint, parent_chunk_id string, section_id string, section_order bigint, section_title string, start_char bigint, start_line bigint, end_line bigint, text string")


def queries(spark, *texts, k=5):
    return spark.createDataFrame([(i, 1, t, k, None, None, None, None) for i, t in enumerate(texts)],
                                 "query_id bigint, corpus_id bigint, query string, k bigint, scope_from bigint, scope_to bigint, scope_error string, vector array<double>")


def plain_tokens(text):
    norm = " ".join(text.split()).casefold()
    out, run = [], ""
    words = "".join(c if c.isalnum() else " " for c in norm).split()
    out += [w for w in words if len(w) >= 2]
    for c in norm + " ":
        if ("a" <= c <= "z") or ("0" <= c <= "9") or "㐀" <= c <= "鿿":
            run += c
        else:
            out += [run[i:i + 2] for i in range(len(run) - 1)]
            run = ""
    return out or ([norm] if norm else [])


def test_bm25_equals_the_formula_even_for_common_tokens(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["river", "stone", "lantern", "旧城", "渡口", "the"]) for _ in range(rng.randint(3, 12))) + " the" for _ in range(30)]
    p, q = passages(spark, texts), queries(spark, "the river", "旧城 lantern")
    docs = [plain_tokens(t + f" title {i // 6}") for i, t in enumerate(texts)]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log(n - c + .5) - math.log(c + .5) for t, c in df.items()}
    low = .25 * sum(idf.values()) / len(idf)
    idf = {t: low if v < 0 else v for t, v in idf.items()}
    want = {}
    for qi, text in enumerate(["the river", "旧城 lantern"]):
        for di, d in enumerate(docs):
            tf, toks = Counter(d), dict.fromkeys(plain_tokens(text))
            if any(t in tf for t in toks):
                want[qi, di] = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (.25 + .75 * len(d) / mean)) for t in toks if t in tf)
    for index in (lexical.build_index(p), lexical.build_index(p, wanted=lexical.query_tokens(q))):
        got = {(r.query_id, r.passage_id): r.score for r in lexical.bm25(q, index).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_single_term_counts_once_more_and_titles_twice(spark):
    got = lexical.boosts(queries(spark, "title"), passages(spark, ["title title"])).first().score
    assert got == 3 * 5 + 3 + 2


def test_term_without_any_token_still_finds_its_passage(spark):
    p = passages(spark, ["alpha é beta", "gamma"])
    rows = lexical.lexical_scores(queries(spark, "é"), p).collect()
    assert [r.passage_id for r in rows] == [0]


def test_dense_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    m, v = rng.normal(size=(200, 8)), rng.normal(size=(3, 8))
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    vec = spark.createDataFrame([(1, i, i % 5, i, [float(x) for x in r]) for i, r in enumerate(m)], "corpus_id bigint, passage_id bigint, section_order bigint, start_char bigint, embedding array<double>")
    q = spark.createDataFrame([(i, 1, [float(x) for x in r], 1 if i else None, 3 if i else None) for i, r in enumerate(unit(v))] + [(9, 1, [1.0, 0.0], None, None)],
                              "query_id bigint, corpus_id bigint, vector array<double>, scope_from bigint, scope_to bigint")
    got = {}
    for r in dense.dense_ranking(q, dense.normalize_vectors(vec), k=7, block_rows=16).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.passage_id
    scores = unit(v) @ unit(m).T
    for i in range(3):
        ok = [j for j in range(200) if i == 0 or 1 <= j % 5 <= 3]
        assert [got[i][n] for n in range(1, 8)] == sorted(ok, key=lambda j: -scores[i][j])[:7]
    assert 9 not in got  # another dimension finds nothing


def test_many_queries_on_equal_vectors(spark):
    """Ties cross the cut of a block and of the query batches; the first places win, as when all scores are sorted."""
    rng = np.random.default_rng(6)
    kinds = rng.normal(size=(5, 4))
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    own = rng.integers(0, 5, 90)
    vec = spark.createDataFrame([(1, int(100 - i), int(i % 3), int(i // 4), unit(kinds[own[i]]).tolist()) for i in range(90)],
                                "corpus_id bigint, passage_id bigint, section_order bigint, start_char bigint, embedding array<double>")
    asked = unit(rng.normal(size=(600, 4)))
    scope = [(None, None), (1, None), (None, 1), (1, 1), (7, None)]
    q = spark.createDataFrame([(i, 1, v.tolist(), *scope[i % 5]) for i, v in enumerate(asked)] + [(900, 1, None, None, None)],
                              "query_id bigint, corpus_id bigint, vector array<double>, scope_from bigint, scope_to bigint")
    got = {}
    for r in dense.dense_ranking(q.filter("vector is not null"), vec, k=11, block_rows=40).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.passage_id
    for i, v in enumerate(asked):
        low, high = scope[i % 5]
        ok = [j for j in range(90) if (low is None or j % 3 >= low) and (high is None or j % 3 <= high)]
        right = sorted(ok, key=lambda j: (-round(float(unit(kinds[own[j]]) @ v), 9), j // 4, 100 - j))[:11]
        assert [got.get(i, {}).get(n) for n in range(1, len(right) + 1)] == [100 - j for j in right] and len(got.get(i, {})) == len(right)


def test_top_columns():
    scores = np.array([[1.0, 3.0, 3.0, 2.0, 3.0], [-np.inf, 0.0, -np.inf, -np.inf, 0.0], [5.0, 5.0, 5.0, 5.0, 5.0]])
    row, column = dense.top_columns(scores, 2)
    assert list(zip(row, column)) == [(0, 1), (0, 2), (1, 1), (1, 4), (2, 0), (2, 1)]
    assert len(dense.top_columns(scores, 9)[0]) == 12 and len(dense.top_columns(scores[:0], 2)[0]) == 0


def test_diversity_takes_two_per_section_before_the_rest(spark):
    p = passages(spark, ["lantern " * (12 - i) for i in range(12)])
    q = queries(spark, "lantern", k=5)
    hits, events = search.hybrid_search(q, p)
    rows = hits.orderBy("position").collect()
    assert len(rows) == 5 and len({r.chunk_id for r in rows}) == 5
    assert sorted(r.section_id for r in rows[:4]) == ["s0", "s0", "s1", "s1"]
    assert [e.code for e in events.collect()] == ["bm25_fallback"]


def test_failing_provider_leaves_the_corpus_lexical(spark):
    p = passages(spark, ["a", "bb", "ccc"])

    def fn(texts):
        if "bb" in texts:
            raise TimeoutError
        return [[1.0, 2.0] for _ in texts]
    out = dense.embed_passages(p.coalesce(1), fn).collect()
    assert all(r.embedding is None and r.attempts == 3 for r in out)


def test_errors_of_the_callers_code_are_not_hidden(spark):
    with pytest.raises(Exception, match="ZeroDivisionError"):
        dense.embed_passages(passages(spark, ["a"]), lambda texts: [[1 / 0] for _ in texts]).collect()


def test_context_is_clamped_at_the_ends(spark):
    chunks = spark.createDataFrame([(1, i, f"k{i}", f"s{i // 2}", i % 2, f"t{i}") for i in range(4)],
                                   "corpus_id bigint, chunk_order bigint, chunk_id string, section_id string, chunk_in_section bigint, text string")
    rq = spark.createDataFrame([(0, 1, "k0", 3, 1), (1, 1, "k9", 0, 0), (2, 1, "k2", -4, 99)], "request_id bigint, corpus_id bigint, chunk_id string, before bigint, after bigint")
    rows = search.read_context(rq, chunks).collect()
    assert sorted(r.chunk_id for r in rows if r.request_id == 0) == ["k0", "k1"]
    assert [r.error for r in rows if r.request_id == 1] == ["unknown_chunk"]
    assert sorted(r.chunk_id for r in rows if r.request_id == 2) == ["k2", "k3"]


def test_boosts_by_scan_and_through_runs_follow_the_literal_rule(spark):
    """Terms inside words, across the seam of text and title, of one character, with marks, repeated, nowhere; CJK; phrases; long runs."""
    rng = random.Random(6)
    words = ["aa", "aaa", "b", "ab", "Straße", "strasse", "王五", "王五到了", "c,d", "𠮷a", "x" * 3000, "É"]
    passages = []
    for n in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\u3000", ""]) for _ in range(rng.choice([0, 1, 3, 12])))
        passages.append((f"k{n % 3}", f"p{n}", n, n, rng.choice([None, "", "b aa", "王五 b", " c"]), text))
    passages += [("k0", "seam", 500, 500, "qq r", "o zz"), ("k0", "apart", 501, 501, " qq r", "o zz")]
    asked = [(100, "k0", "zq")] + [(q, f"k{q % 4}", t) for q, t in enumerate(["aa", "aaa b", "王五", "王五 b aa", "五到", "b  b", " ", "c,d strasse", "aab", "é 𠮷a", "nowhere", "x" * 5, "aa aa", "b c", "ab aaa", "straße 王五 b"])]
    q = spark.createDataFrame(asked, "query_id bigint, corpus_id string, query string")
    p = spark.createDataFrame(passages, "corpus_id string, passage_id string, section_order bigint, start_char bigint, section_title string, text string")
    want = {}
    for qid, corpus_id, query in asked:
        whole = " ".join(query.split()).casefold()
        terms = list(dict.fromkeys([whole, *whole.split(" ")])) if whole else []
        for own, pid, _, _, title, text in passages:
            body, head = text.casefold(), (title or "").casefold()
            if own == corpus_id and any(t in body + head for t in terms):
                both = {t: body.count(t) + head.count(t) for t in terms}
                want[qid, pid] = 5.0 * both[terms[0]] + sum(both[t] for t in terms[1:] or terms) + 2.0 * sum(head.count(t) for t in terms)
    assert len(want) > 150 and 0.0 in want.values()
    for scanned in (1000, 0, 2):
        assert {(r.query_id, r.passage_id): r.score for r in lexical.boosts(q, p, scanned).collect()} == want


def test_pairs_of_texts_are_found_on_their_bytes():
    rng = random.Random(1)
    for _ in range(300):
        texts = [rng.choice([None, *["".join(rng.choice("aZ09 .é旧城㐀鿿ꀀ㏿𠮷ß\n") for _ in range(rng.choice([0, 1, 2, 30])))] * 9]) for _ in range(rng.randint(0, 6))]
        fits = lambda c: c.isascii() and c.isalnum() or "㐀" <= c <= "鿿"
        want = [None if t is None else [a + b for a, b in zip(t, t[1:]) if fits(a) and fits(b)] for t in texts]
        own = pa.array(texts, pa.string())
        assert pairs_of(own).to_pylist() == want and pairs_of(own[1:]).to_pylist() == want[1:]


def test_terms_are_looked_for_once_for_all_who_ask(spark):
    """The looks at a text follow the distinct terms of a corpus, not its queries; the vocabulary counts the tokens once."""
    class Text(str):
        looks = 0

        def count(self, term):
            Text.looks += 1
            return super().count(term)
    terms = {"b": [(q, 1.0, 3.0) for q in range(50)], "zz": [(0, 1.0, 3.0)], "a b": [(0, 5.0, 7.0)]}
    sums = lexical._scan(terms, [Text("a b b"), Text("c"), Text("")], ["", "b", ""])
    assert sums == [{q: 2.0 + 5.0 * (q == 0) for q in range(50)}, {q: 3.0 for q in range(50)}, {}] and Text.looks == 3
    index = lexical.build_index(passages(spark, ["lantern river", "river"]))
    assert "Generate" not in index.vocabulary._jdf.queryExecution().toString()


def test_runs_are_written_once_a_step_not_for_each_piece_or_term(spark, monkeypatch):
    """What ``indexed_boosts`` writes that spells a run out has a row per run, or per place of a run, whatever its pieces, terms and queries."""
    rows = [("k", f"p{n}", n, n, "title", f"abcdefghijklmnop{n % 7} qrstuvwxyz{n % 5} ") for n in range(40)]
    p = spark.createDataFrame(rows, "corpus_id string, passage_id string, section_order bigint, start_char bigint, section_title string, text string")
    asked = spark.createDataFrame([(q, "k", ["ab", "abcd", "cdef", "mnop", "qrst", "wxyz"][q % 6] + " nowhere") for q in range(30)], "query_id bigint, corpus_id string, query string")
    written, stage = [], lexical.stage
    monkeypatch.setattr(lexical, "stage", lambda df, label: written.append((label, stage(df, label))) or written[-1][1])
    assert lexical.boosts(asked, p, scanned=0).count() == 30 * 40
    counted = {label: df.count() for label, df in written if "run" in df.columns}
    assert counted == {"runs": 40 * 3, "distinct-runs": 7 + 5 + 1, "matched": 7 + 5, "weights": 7 + 5}
