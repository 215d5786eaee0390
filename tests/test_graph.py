"""Graph build and graph queries on small fixtures and against brute force."""
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.runtime import placed
from quillgraph.operators import extraction as X
from quillgraph.operators import graph_query as Q
from quillgraph.operators import resolution as R
from quillgraph.operators.components import components
from quillgraph.sources import graph_store as G
from quillgraph.sources.candidates import ingest_candidates



def windows(spark, text):
    chunks = spark.createDataFrame([(1, 0, "k0", 0, 0, len(text), text)], "corpus_id bigint, chunk_order bigint, chunk_id string, section_order bigint, start_char bigint, end_char bigint, text string")
    corpus = spark.createDataFrame([(1, text)], "corpus_id bigint, text string")
    w = X.with_context(X.cores(chunks), chunks)
    return chunks, corpus, w, X.window_spans(w, corpus)


def test_nth_occurrence_and_missing_quotes(spark):
    chunks, _, _, spans = windows(spark, "aaaa b aaa")
    rows = [(1, "extract:0:0", "entity", i, 0, s, q, n) for i, (s, q, n) in enumerate([("core", "aa", 1), ("core", "aa", 3), ("core", "aa", 6), ("core", "zz", 1), ("nowhere", "aa", 1)])]
    anchors = spark.createDataFrame(rows, "corpus_id bigint, unit_id string, kind string, pos bigint, part int, span_id string, quote string, occurrence bigint")
    got = {r.pos: r.start_char for r in X.locate(anchors, spans).collect()}
    assert got == {0: 0, 1: 2, 2: None, 3: None, 4: None}


def test_segments_are_text_slices_without_overlap_of_chunks(spark):
    text = "长句子" * 100 + "。短句！" + "x" * 400
    _, corpus, w, _ = windows(spark, text)
    chunks = spark.createDataFrame([(1, 0, 0, 500), (1, 1, 450, len(text))], "corpus_id bigint, chunk_order bigint, start_char bigint, end_char bigint")
    w = X.with_context(X.cores(chunks), chunks)
    segs = X.segments(w, chunks, corpus).collect()
    assert all(text[s.start_char:s.end_char] == s.text and len(s.text) <= 180 for s in segs)
    for unit, rows in itertools.groupby(sorted(segs, key=lambda s: s.unit_id), key=lambda s: s.unit_id):
        assert sorted(int(r.span_id[1:]) for r in list(rows)) == list(range(sum(s.unit_id == unit for s in segs)))


def test_windows_split_after_a_sentence_end(spark):
    text = "字" * 640 + "。" + "字" * 660
    chunks, corpus, w, _ = windows(spark, text)
    parts = X.split_windows(w.withColumn("saturated", F.lit(True)), chunks, corpus).orderBy("core_start").collect()
    assert [(p.core_start, p.core_end) for p in parts] == [(0, 641), (641, len(text))]
    small = X.split_windows(w.withColumn("saturated", F.lit(True)).withColumn("core_end", F.lit(900).cast("bigint")), chunks, corpus).collect()
    assert len(small) == 1


def test_windows_split_until_none_is_saturated(spark):
    text = "字" * 640 + "。" + "字" * 1859
    chunks, corpus, w, _ = windows(spark, text)
    crowded = lambda df: df.withColumn("saturated", (F.col("core_end") - F.col("core_start") > 700) | F.col("unit_id").endswith(":a"))
    parts = X.split_until_settled(w, chunks, corpus, crowded).orderBy("core_start").collect()
    assert [p.core_start for p in parts[1:]] == [p.core_end for p in parts[:-1]] and (parts[0].core_start, parts[-1].core_end) == (0, len(text))
    assert len(parts) == 4 and all(500 <= p.core_end - p.core_start < 1000 for p in parts) and any(p.unit_id.count(":a") + p.unit_id.count(":b") == 2 for p in parts)
    assert all(p.left_start <= p.core_start and p.right_end >= p.core_end for p in parts)
    calm = X.split_until_settled(w, chunks, corpus, lambda df: df.withColumn("saturated", F.lit(None).cast("boolean"))).collect()
    assert [(p.core_start, p.core_end, p.saturated) for p in calm] == [(r.core_start, r.core_end, False) for r in w.collect()]


def test_ingest_refuses_what_the_schema_forbids(spark):
    anchor = {"span_id": "core", "quote": "沈舟"}
    good = {"entities": [{"local_id": "e1", "type": "person", "name": "沈舟", "mentions": [anchor]}], "relations": [{"source": "e1", "target": "e2", "type": "knows", "evidence": [anchor]}], "identity_links": []}
    bad = {"extra": {**good, "other": 1}, "enum": {"entities": [{**good["entities"][0], "type": "ship"}]}, "many": {"relations": [{**good["relations"][0], "evidence": [anchor] * 4}]},
           "inner": {"entities": [{**good["entities"][0], "mentions": [{**anchor, "page": 3}]}]}, "long": {"entities": [{**good["entities"][0], "name": "x" * 101}]}}
    rows = [(1, "ok", json.dumps(good))] + [(1, k, json.dumps(v)) for k, v in bad.items()] + [(1, "text", "not json")]
    e, r, l, rejects = ingest_candidates(spark.createDataFrame(rows, "corpus_id bigint, unit_id string, payload string"))
    assert [(x.unit_id, x.name, x.mentions[0].occurrence) for x in e.collect()] == [("ok", "沈舟", 1)]
    assert [(x.polarity, x.statement_mode) for x in r.collect()] == [("affirmed", "narration")] and l.count() == 0
    assert {x.unit_id: x.reason for x in rejects.collect()} == {"extra": "unknown_field", "inner": "unknown_field", "enum": "invalid_value", "many": "invalid_value", "long": "invalid_value", "text": "not_json"}


def entities(spark, rows):
    return spark.createDataFrame([(1, k, "person", n, n, p, [(p, p + len(n), 0, "k0", n)]) for k, n, p in rows],
                                 "corpus_id bigint, entity_key string, type string, name string, folded string, position bigint, spans array<struct<start_char:bigint,end_char:bigint,section_order:bigint,chunk_id:string,quote:string>>")


def test_homonyms_kept_apart_and_doubt_reused(spark):
    e = entities(spark, [("a", "王五", 0), ("b", "王五", 50), ("c", "王五", 90), ("d", "王五", 120), ("s", "王五", 0), ("g", "先生", 10), ("h", "先生", 60)])
    schema = "corpus_id bigint, entity_key string, decision string, candidate_key string, supporting array<string>, allowed array<string>"
    decisions = spark.createDataFrame([(1, "b", "ambiguous", None, [], ["r"]), (1, "c", "new", None, ["r"], ["r"]), (1, "d", "merge", "nobody", ["r"], ["r"])], schema)
    got = {r.entity_key: (r.outcome, r.joins) for r in R.resolve(e, decisions).collect()}
    assert got["s"] == ("shared_span", "a") and got["b"] == ("same_name_reused", "a")
    assert got["c"] == ("kept_apart", None) and got["d"] == ("ambiguous", None)
    assert got["g"] == ("new", None) and got["h"] == ("new", None)  # generic names never match by name


def test_components_with_one_huge_key_and_a_long_chain(spark):
    n = 3000
    members = [(i, "hub") for i in range(0, n, 3)] + [(i, f"c{i}") for i in range(1, 200)] + [(i + 1, f"c{i}") for i in range(1, 200)]
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    first = {}
    for i, k in members:
        a, b = root(i), root(first.setdefault(k, i))
        parent[max(a, b)] = min(a, b)
    for hot_rows in (100_000, 50):
        got = {r.id: r.component for r in components(spark.range(n), spark.createDataFrame(members, "id bigint, key string"), hot_rows).collect()}
        assert got == {i: root(i) for i in range(n)}


def test_components_of_random_memberships(spark):
    """Sparse to dense, ids in no order, a node with a third of all memberships; nothing shared; nothing at all."""
    rng = random.Random(4)
    for n, links in ((40, 30), (60, 90), (300, 420), (5, 0)):
        members = [(rng.randrange(n), rng.randrange(n)) for _ in range(links)] + [(7, k) for k in range(links // 2) if n > 7]
        groups = [{i} for i in range(n)]
        for key in {k for _, k in members}:
            own = {i for i, k in members if k == key}
            hit = [g for g in groups if g & own]
            groups = [g for g in groups if not g & own] + [set().union(own, *hit)]
        want = {i: min(g) for g in groups for i in g}
        table = spark.createDataFrame(members, "id bigint, key bigint")
        for hot_rows in (100_000, 3):
            assert {r.id: r.component for r in components(spark.range(n), table, hot_rows).collect()} == want


def test_dependency_groups_follow_names_and_shared_spans(spark):
    schema = "corpus_id bigint, entity_key string, type string, name string, folded string, position bigint, spans array<struct<start_char:bigint,end_char:bigint>>"
    rows = [(1, "c", "person", "王五", "王五", 0, [(0, 2)]), (1, "b", "person", "王五", "王五", 9, [(9, 11)]), (1, "a", "place", "王五", "王五", 9, [(9, 11)]), (2, "c", "person", "王五", "王五", 0, [(0, 2)]),
            (1, "g1", "person", "先生", "先生", 20, [(20, 22)]), (1, "g2", "person", "先生", "先生", 20, [(20, 22), (40, 42)]), (1, "g3", "person", "先生", "先生", 40, [(40, 42)]), (1, "g0", "person", "先生", "先生", 60, [(60, 62)])]
    group = lambda extra: {(r.corpus_id, r.entity_key): r.group_key for r in R.dependency_groups(spark.createDataFrame(rows + extra, schema)).collect()}
    alone = {(1, "c"): "b", (1, "b"): "b", (1, "a"): "a", (2, "c"): "c", (1, "g1"): "g1", (1, "g2"): "g1", (1, "g3"): "g1", (1, "g0"): "g0"}
    assert group([]) == alone
    bridged = group([(1, "x", "person", "李四", "李四", 0, [(0, 2), (60, 62)])])  # one span under two names joins them
    assert bridged == alone | {(1, "x"): "b", (1, "g0"): "b"}


def graph(spark, edges, kinds=None, groups=None):
    kinds = kinds or {}
    names = sorted({x for e in edges for x in e[1:3]} | {"50%_off"})
    make = spark.createDataFrame
    ents = make([(n, kinds.get(n, "person"), n, n.lower(), 0) for n in names], "entity_id string, type string, name string, normalized_name string, first_section_order bigint")
    return {"entities": ents, "aliases": ents.select("entity_id", F.col("name").alias("alias"), F.col("normalized_name").alias("normalized_alias")),
            "mentions": ents.select("entity_id", F.concat(F.lit("m"), "entity_id").alias("mention_id"), F.lit(0).cast("bigint").alias("section_order"), F.lit(5).cast("bigint").alias("start_char")),
            "relations": make([(r, a, b, "knows", p, "narration") for r, a, b, p in edges], "relation_id string, source_id string, target_id string, type string, polarity string, statement_mode string"),
            "evidence_groups": make(groups or [(f"g{r}", r, 0, 0) for r, *_ in edges], "group_id string, relation_id string, first_section bigint, last_section bigint"),
            "evidence_spans": make([(f"g{r}", 0, 0) for r, *_ in edges], "group_id string, span_index int, section_order bigint")}


# Two ways from p to t, a tail to u, and a denied way back.
EDGES = [("k1", "p", "q", "affirmed"), ("k2", "p", "r", "affirmed"), ("k3", "q", "t", "affirmed"), ("k4", "r", "t", "affirmed"), ("k5", "t", "u", "affirmed"), ("k6", "u", "p", "denied")]
REQ = "scope_from bigint, scope_to bigint, entity_types array<string>, relation_types array<string>"


def test_paths_skip_denied_edges_and_report_more(spark):
    rows = [("two", "p", "t", 3, 5, None, None, None, None), ("cut", "p", "t", 3, 1, None, None, None, None), ("self", "p", "p", 1, 5, None, None, None, None),
            ("far", "p", "u", 1, 5, None, None, None, None), ("typed", "p", "t", 3, 5, None, None, ["item"], None), ("tail", "p", "u", 3, 5, None, None, None, None)]
    g = graph(spark, EDGES, {"q": "item"})
    paths, meta = Q.shortest_paths(spark.createDataFrame(rows, "request_id string, from_id string, to_id string, max_hops int, limit int, " + REQ), g)
    got = {}
    for p in paths.orderBy("path_index").collect():
        got.setdefault(p.request_id, []).append("".join(p.node_ids))
    assert got == {"two": ["pqt", "prt"], "cut": ["pqt"], "self": ["p"], "typed": ["pqt"], "tail": ["pqtu", "prtu"]}
    assert {m.request_id for m in meta.collect() if m.truncated} == {"cut"}


def test_neighbours_take_denied_edges_and_joint_scope(spark):
    g = graph(spark, EDGES, groups=[(f"g{r}", r, 0, 1 if r == "k1" else 0) for r, *_ in EDGES])
    rows = [("one", "p", 1, None, None, None, None), ("scope", "p", 1, 0, 0, None, None), ("deep", "q", 3, None, None, None, None)]
    nodes, edges, meta = Q.neighbors(spark.createDataFrame(rows, "request_id string, entity_id string, depth int, " + REQ), g)
    found = lambda df, rid, c: sorted(r[c] for r in df.collect() if r.request_id == rid)
    assert found(edges, "one", "relation_id") == ["k1", "k2", "k6"] and found(edges, "scope", "relation_id") == ["k2", "k6"]
    assert found(nodes, "deep", "node") == list("pqrtu") and found(edges, "deep", "relation_id") == [e[0] for e in EDGES]
    assert not any(m.truncated for m in meta.collect())


def test_hub_is_cut_at_the_first_row_past_a_limit(spark):
    edges = [(f"r{i:03d}", "hub", f"n{i:03d}", "affirmed") for i in range(300)]
    rq = spark.createDataFrame([("h", "hub", 2, None, None, None, None)], "request_id string, entity_id string, depth int, " + REQ)
    nodes, kept, meta = Q.neighbors(rq, graph(spark, edges))
    assert nodes.count() == 100 and sorted(r.relation_id for r in kept.collect()) == [f"r{i:03d}" for i in range(99)]
    assert meta.first().reason == "node_limit"


def test_long_lists_are_read_by_blocks(spark):
    """Blocks of thirty edges against whole lists: same nodes, edges and reasons, with filters that leave few edges of a hub."""
    rnd = random.Random(8)
    names = [f"n{i:03}" for i in range(60)]
    types = ["knows", "located_in", "friend_of"]
    edges = [(f"r{i:04}", "n000" if i % 2 else rnd.choice(names[:4]), rnd.choice(names[1:]), types[0] if i % 40 else types[1], "affirmed", rnd.randrange(9))
             for i in range(900)]
    rows = [(e[0], e[1], e[2], e[3], e[4], "narration") for e in edges if e[1] != e[2]]
    places = {e[0]: e[5] for e in edges}
    g = {"entities": spark.createDataFrame([(n, "character" if n[-1] != "7" else "location") for n in names], "entity_id string, type string"),
         "relations": spark.createDataFrame(rows, "relation_id string, source_id string, target_id string, type string, polarity string, statement_mode string"),
         "evidence_groups": spark.createDataFrame([(f"g{r[0]}", r[0], places[r[0]], places[r[0]] + 1) for r in rows], "group_id string, relation_id string, first_section int, last_section int")}
    asked = [(f"q{i}", rnd.choice(names[:8]), 1 + i % 3, rnd.choice([None, 2]), rnd.choice([None, 6]), rnd.choice([None, ["location"]]), rnd.choice([None, ["located_in"], ["knows"]])) for i in range(20)]
    rq = spark.createDataFrame(asked, "request_id string, entity_id string, depth int, scope_from int, scope_to int, entity_types array<string>, relation_types array<string>")
    found = [[sorted(map(str, frame.collect())) for frame in Q.neighbors(rq, g, 30, 20, block_edges=size)] for size in (30, 10_000)]
    assert found[0] == found[1] and any("True" in row for row in found[0][2])
    adj, hubs = Q.blocked(Q.adjacency(g), 30)
    assert adj.groupBy("node", "block").agg(F.count_distinct("relation_id").alias("n")).agg(F.max("n")).first()[0] <= 30
    start = spark.createDataFrame([("q", "n000", 0, "n000", None, None, None, None)], "request_id string, node string, pos int, entity_id string, " + REQ)
    assert 5 <= Q._first_edges(start, adj, hubs, 5).count() <= 35  # of a list of more than four hundred


def test_search_is_literal(spark):
    g = graph(spark, EDGES)
    rows = [(q, q, None, 0, 10, None, None) for q in ("%", "_", "50%_off", "p", "zz")]
    got = {r.request_id: (r.entity_id, r.match_kind) for r in Q.entity_search(spark.createDataFrame(rows, "request_id string, query string, entity_type string, offset bigint, limit bigint, scope_from bigint, scope_to bigint"), g).collect()}
    assert got == {"%": ("50%_off", "contains"), "_": ("50%_off", "contains"), "50%_off": ("50%_off", "name_exact"), "p": ("p", "name_exact")}


def test_search_meets_long_queries_on_long_pieces(spark):
    names = [f"customer {i}" for i in range(0, 3000, 7)] + ["aaaaaaaaaa", "an old customer 14 of ours " + "and theirs " * 20]
    g = {"entities": spark.createDataFrame([(n, "person", n, n, 0) for n in names], "entity_id string, type string, name string, normalized_name string, first_section_order bigint"),
         "aliases": spark.createDataFrame([(n, n) for n in names], "entity_id string, normalized_alias string"),
         "mentions": spark.createDataFrame([(n, 0, 0) for n in names], "entity_id string, section_order bigint, start_char bigint")}
    asked = ["c", "er", "mer", "customer 14", "stomer 2", "aaaa", "aaaaaaaaaaa", " 14 of ours and", "ours " + "and theirs " * 17, "customer 70", "x", "", "a" * 201]
    rq = spark.createDataFrame([(q, q, None, 0, 1000, None, None) for q in asked], "request_id string, query string, entity_type string, offset bigint, limit bigint, scope_from bigint, scope_to bigint")
    want = {(q, n) for q in asked if 1 <= len(q) <= 200 for n in names if q in n}
    index = Q.alias_index(g["aliases"])
    assert {(r.request_id, r.entity_id) for r in Q.entity_search(rq, g).collect()} == want
    assert {(r.request_id, r.entity_id) for r in Q.entity_search(rq, g, index).collect()} == want
    # "mer 14" and its neighbours are on far fewer aliases than any three characters of "customer 14"
    met = index.filter(F.length("gram") == 8).filter("gram = 'tomer 14'").count()
    assert 0 < met < 20 < index.filter("gram = 'r 1'").count()


def largest_fit(nodes, edges, paths, budget):
    """By definition: the most paths that fit with what they refer to; without paths the most edges with their nodes."""
    def keep(n_paths, n_edges, loose):
        p, e, n = paths[:n_paths], edges[:n_edges], nodes if loose else []
        if n_paths < len(paths):
            e = [x for x in e if any(x["id"] in y["refs"] for y in p)]
        if n_paths < len(paths) or n_edges < len(edges):
            n = [x for x in n if any(x["id"] in y["refs"] for y in e)]
        return p + e + n
    ways = [(k, len(edges), True) for k in range(len(paths), -1, -1)] + [(0, k, True) for k in range(len(edges) - 1, -1, -1)] + [(0, 0, False)]
    fits = (kept for kept in itertools.starmap(keep, ways) if sum(len(x["json"]) + 1 for x in kept) <= budget)
    return {x["id"] for x in next(fits)}


def test_budget_keeps_the_largest_fit(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for rid in range(25):
        nodes = [{"id": f"n{i}", "json": "x" * rng.randint(5, 30), "refs": []} for i in range(12)]
        edges = [{"id": f"e{i}", "json": "x" * rng.randint(5, 30), "refs": [f"n{rng.randrange(12)}", f"n{rng.randrange(12)}"]} for i in range(10)]
        paths = [{"id": f"p{i}", "json": "x" * 10, "refs": [f"e{rng.randrange(10)}" for _ in range(2)]} for i in range(5)] if rid % 2 else []
        want[rid] = largest_fit(nodes, edges, paths, 300)
        for kind, items in (("nodes", nodes), ("edges", edges), ("paths", paths)):
            rows += [(rid, kind, i + 1, x["id"], x["json"], x["refs"]) for i, x in enumerate(items)]
    df = spark.createDataFrame(rows, "request_id bigint, kind string, position int, item_id string, payload string, refs array<string>")
    kept, _ = Q.fit_budget(df, budget=300)
    got = {rid: set() for rid in want}
    for r in kept.collect():
        got[r.request_id].add(r.item_id)
    assert got == want


def test_versions_are_replaced_alone(spark, tmp_path):
    a, at = spark.createDataFrame([(1,)], "x bigint"), str(tmp_path)
    G.materialize_graph({n: a for n in G.TABLES}, at, "v1")
    G.materialize_graph({n: a for n in G.TABLES}, at, "v2")
    G.materialize_graph({n: a.union(a) for n in G.TABLES}, at, "v2")
    assert [G.read_graph(spark, at, v, verify=True)["relations"].count() for v in ("v1", "v2")] == [1, 2]
    assert {(r.version, r.table): r.rows for r in G.version_counts(spark, at).collect()} == {(v, n): k for v, k in (("v1", 1), ("v2", 2)) for n in G.TABLES}
    assert G.drop_superseded(spark, at) == 1 and G.drop_superseded(spark, at) == 0
    assert [G.read_graph(spark, at, v, verify=True)["relations"].count() for v in ("v1", "v2")] == [1, 2]


def test_half_written_versions_are_never_read(spark, tmp_path):
    at, rows = str(tmp_path), lambda *x: spark.createDataFrame([(v,) for v in x], "x bigint")
    with pytest.raises(LookupError):
        G.read_graph(spark, at, "v1")
    G.write_build({n: rows(1) for n in G.TABLES}, at)  # all tables, no manifest
    with pytest.raises(LookupError):
        G.read_graph(spark, at, "v1")
    G.materialize_graph({n: rows(1, 2) for n in G.TABLES}, at, "v1")
    broken = {n: rows(7) for n in G.TABLES} | {G.TABLES[-1]: rows(7).select(F.raise_error(F.lit("lost")).alias("x"))}
    with pytest.raises(Exception, match="lost"):
        G.materialize_graph(broken, at, "v1")
    got = G.read_graph(spark, at, "v1", verify=True)
    assert all(sorted(r.x for r in df.collect()) == [1, 2] for df in got.values())
    with pytest.raises(LookupError):
        G.read_graph(spark, at, "v2")
    build = G.version_counts(spark, at).first().build
    rows(9).write.mode("append").parquet(f"{at}/builds/{build}/mentions")  # a stray file in a committed build
    with pytest.raises(ValueError, match="mentions"):
        G.read_graph(spark, at, "v1", verify=True)


def test_paths_follow_the_limit_of_their_request(spark):
    """Nine equal paths of two hops: a request gets as many as it asks for, and is told when there are more."""
    g = graph(spark, [(f"{a}{b}", a, b, "affirmed") for i in range(9) for a, b in (("s", f"m{i}"), (f"m{i}", "t"))])
    rows = [(f"r{n}", "s", "t", 3, n, None, None, None, None) for n in (1, 5, 8, 9)]
    paths, meta = Q.shortest_paths(spark.createDataFrame(rows, "request_id string, from_id string, to_id string, max_hops int, limit int, " + REQ), g)
    assert {r["request_id"]: r["count"] for r in paths.groupBy("request_id").count().collect()} == {"r1": 1, "r5": 5, "r8": 8, "r9": 9}
    assert {r.request_id: r.truncated for r in meta.collect()} == {"r1": True, "r5": True, "r8": True, "r9": False}


def test_a_mention_bridges_the_identities_whose_spans_it_repeats(spark):
    schema = "corpus_id bigint, entity_key string, type string, name string, folded string, position bigint, spans array<struct<start_char:bigint,end_char:bigint,section_order:bigint,chunk_id:string,quote:string>>"
    rows = [(1, k, "person", "王五", "王五", min(at), [(p, p + 2, 0, "k0", "王五") for p in at]) for k, at in (("a", (0, 90)), ("b", (5, 50)), ("z", (50, 90)), ("y", (300,)))]
    e = spark.createDataFrame(rows, schema)
    apart = spark.createDataFrame([(1, "b", "new", None, ["r"], ["r"]), (1, "y", "new", None, ["r"], ["r"])],
                                  "corpus_id bigint, entity_key string, decision string, candidate_key string, supporting array<string>, allowed array<string>")
    assert {r.entity_key: r.cluster for r in R.clusters(R.resolve(e, apart)).collect()} == {"a": "a", "b": "a", "z": "a", "y": "y"}


def judged_rule(rows, decisions):
    """Each entity against the components of all entities before it: edges are shared spans and the joins decided so far."""
    edges, out = [], {}
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    for n, (key, name, position, spans) in enumerate(order):
        before, group = order[:n], {}
        parent = {r[0]: r[0] for r in before}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in edges:
            parent[root(a)] = root(b)
        for r in before:
            group.setdefault(root(r[0]), []).append(r)
        found = []
        for members in group.values():
            shared = any(set(r[3]) & set(spans) for r in members)
            if shared or (name not in ("先生",) and members[0][1] == name):
                found.append((not shared, min(abs(a - position) for r in members for a, _ in r[3]), members[0][2], members[0][0], shared))
        found.sort()
        offered = found[:5]
        decision, wanted, cited = decisions.get(key, (None, None, False))
        if any(f[4] for f in found):
            joins = min((f[2], f[3]) for f in found if f[4])[1]
            outcome, targets = "shared_span", [f[3] for f in found if f[4]]
        else:
            names, joins = [f[3] for f in offered], None
            outcome = ("new" if not found else "merged" if decision == "merge" and cited and wanted in names else "kept_apart" if decision == "new" and cited
                       else "same_name_reused" if len(found) == 1 else "ambiguous")
            joins = wanted if outcome == "merged" else names[0] if outcome == "same_name_reused" else None
            targets = [joins] if joins else []
        edges += [(key, t) for t in targets]
        out[key] = (outcome, joins, len(found), [(f[3], f[4], f[1]) for f in offered])
    parent = {r[0]: r[0] for r in order}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    place = {r[0]: i for i, r in enumerate(order)}
    for a, b in edges:
        x, y = sorted((top(a), top(b)), key=place.get)
        parent[y] = x
    return out, {k: top(k) for k in parent}


def test_resolution_follows_the_rule_one_entity_at_a_time(spark):
    """Homonyms by the dozen, entities of several mentions that reach ahead, shared spans, bridges, generic names, all decisions."""
    rng = random.Random(17)
    schema = "corpus_id bigint, entity_key string, type string, name string, folded string, position bigint, spans array<struct<start_char:bigint,end_char:bigint,section_order:bigint,chunk_id:string,quote:string>>"
    books, rows, said = {}, [], []
    for book in range(12):
        own, decisions, names = [], {}, ["王五", "李四", "先生"]
        for n in range(90):
            name = rng.choice(names[:1] * 6 + names)
            at = rng.randrange(200) * 3 + names.index(name)  # a span spells one name
            old = [s for r in own if r[1] == name for s in r[3] if s[0] >= at]
            spans = {(at, at + 2)} | {(at + d, at + d + 2) for d in rng.sample(range(3, 90, 3), rng.choice([0, 0, 1, 2]))} | set(rng.sample(old, min(len(old), rng.choice([0, 0, 0, 1, 2]))))
            own.append((f"{rng.randrange(10**6):06}-{n}", name, at, sorted(spans)))
            if rng.random() < 0.8:
                decisions[own[-1][0]] = (rng.choice(["merge", "merge", "new", "new", "new", "ambiguous"]), None, rng.random() < 0.8)
        for key, (d, _, c) in decisions.items():
            decisions[key] = (d, rng.choice([r[0] for r in own]), c)
        undecided = judged_rule(own, decisions)[0]
        for key in decisions:  # half of the merges name something that was on offer at first
            if undecided[key][3] and rng.random() < 0.5:
                decisions[key] = (decisions[key][0], rng.choice(undecided[key][3])[0], decisions[key][2])
        books[book] = judged_rule(own, decisions)
        rows += [(book, k, "person", n, n, p, [(a, b, 0, "k0", n) for a, b in s]) for k, n, p, s in own]
        said += [(book, k, d, w, ["r"] if c else ["other"], ["r"]) for k, (d, w, c) in decisions.items()]
    e = spark.createDataFrame(rows, schema).repartition(5)
    resolved = R.resolve(e, spark.createDataFrame(said, "corpus_id bigint, entity_key string, decision string, candidate_key string, supporting array<string>, allowed array<string>")).cache()
    got = resolved.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.outcome, r.joins, r.n_candidates, [tuple(o) for o in r.offered]) == books[r.corpus_id][0][r.entity_key]
    assert {(r.corpus_id, r.entity_key): r.cluster for r in R.clusters(resolved).collect()} == {(b, k): c for b, (_, own) in books.items() for k, c in own.items()}
    assert sum(r.n_candidates > 5 for r in got) > 100 and sum(bool(r.absorbed) for r in got) > 20 and {r.outcome for r in got} == {"new", "shared_span", "merged", "kept_apart", "same_name_reused", "ambiguous"}
    offered = R.offers(resolved)
    assert offered.filter("truncated").select("corpus_id", "entity_key").distinct().count() == sum(r.n_candidates > 5 for r in got) and offered.filter("rank > 5").count() == 0


def test_many_mentions_of_one_identity_hide_no_homonym(spark):
    """Six mentions of one homonym lie between an entity and another homonym; it is still offered and can be merged into."""
    e = entities(spark, [("far", "王五", 0), ("near", "王五", 10)] + [(f"n{i}", "王五", 20 + i * 10) for i in range(8)] + [("last", "王五", 500)])
    merge = [(1, f"n{i}", "merge", "near", ["r"], ["r"]) for i in range(8)]
    decisions = spark.createDataFrame([(1, "near", "new", None, ["r"], ["r"]), (1, "last", "merge", "far", ["r"], ["r"])] + merge,
                                      "corpus_id bigint, entity_key string, decision string, candidate_key string, supporting array<string>, allowed array<string>")
    last = R.resolve(e, decisions).filter("entity_key = 'last'").first()
    assert (last.outcome, last.joins, last.n_candidates) == ("merged", "far", 2) and [tuple(o) for o in last.offered] == [("near", False, 410), ("far", False, 500)]


def test_a_link_decision_must_name_its_target(spark):
    e = entities(spark, [("a", "王五", 0), ("b", "老王", 50), ("c", "张三", 80)])
    own = e.select("corpus_id", "entity_key", F.col("entity_key").alias("cluster"))
    links = spark.createDataFrame([(1, "l1", "a", "b", ["r"], []), (1, "l2", "a", "c", ["r"], [])], "corpus_id bigint, link_key string, source_key string, target_key string, evidence_refs array<string>, context_refs array<string>")
    said = spark.createDataFrame([(1, "l1", "merge", "b", ["r"]), (1, "l2", "merge", "b", ["r"])], "corpus_id bigint, link_key string, decision string, candidate_key string, supporting array<string>")
    ids, outcome = R.merge_identities(e, own, links, said)
    assert {r.link_key: r.outcome for r in outcome.collect()} == {"l1": "merged", "l2": "ambiguous"}
    assert {r.entity_key: r.identity for r in ids.collect()} == {"a": "a", "b": "a", "c": "c"}


def test_extraction_rounds_end_with_windows_that_can_be_taken(spark):
    from quillgraph.operators import build
    from quillgraph.plans.build_queries import candidate_tables
    names = ["".join(x).capitalize() for x in itertools.islice(itertools.product("abcdefgh", repeat=4), 0, 4000, 25)]
    text = (" ".join(names) + "\n" + "plain words here and there\n" * 80)[:2400]
    chunks, corpus, _, _ = windows(spark, text)
    found = build.extract_until_settled(chunks, corpus, candidate_tables, "compact")
    parts = found.windows.orderBy("core_start").collect()
    assert [p.core_start for p in parts[1:]] == [p.core_end for p in parts[:-1]] and (parts[0].core_start, parts[-1].core_end) == (0, len(text))
    assert any(p.unit_id.count(":a") + p.unit_id.count(":b") >= 2 for p in parts)
    assert all(p.core_end - p.core_start < 400 for p in parts if p.saturated_at_minimum) and not parts[-1].saturated_at_minimum
    # a single pass over the windows that are left finds the same candidates, and no window that could be cut is crowded
    alone = build.extract_round(found.windows, chunks, corpus, candidate_tables)
    listed = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert [listed(t) for t in found[1:]] == [listed(t) for t in alone[1:]]
    dense = X.density(*alone[1:], found.windows, "compact").filter("saturated").select("unit_id").collect()
    assert {r.unit_id for r in dense} == {p.unit_id for p in parts if p.saturated_at_minimum}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_attribution_locates_once_and_keeps_repeated_anchors(spark):
    """What located the spans stands once in the plan; repeated rows stay, and share the earliest chunk of their key."""
    rows = [(1, "u", "entity", 0, 0, "q", 5, 8), (1, "u", "entity", 0, 0, "q", 5, 8), (1, "u", "entity", 1, 0, "q", 12, 15),
            (1, "u", "entity", 2, 0, "q", None, None), (1, "v", "entity", 0, 0, "q", 8, 13), (None, "u", "entity", 0, 0, "q", 5, 8)]
    given = spark.createDataFrame(rows, "corpus_id long, unit_id string, kind string, pos long, part int, quote string, start_char long, end_char long")
    located = given.mapInArrow(lambda batches: batches, given.schema)
    chunks = spark.createDataFrame([(1, 0, "a", 0, 0, 10), (1, 1, "b", 1, 4, 20), (1, 2, "c", 2, 10, 11)],
                                   "corpus_id long, chunk_order long, chunk_id string, section_order long, start_char long, end_char long")
    placed = X.attribute(located, chunks)
    got = sorted((str(r.corpus_id), r.unit_id, r.pos, str(r.chunk_id)) for r in placed.collect())
    assert got == [("1", "u", 0, "a"), ("1", "u", 0, "a"), ("1", "u", 1, "b"), ("1", "u", 2, "None"), ("1", "v", 0, "b"), ("None", "u", 0, "None")]
    assert _plan(placed).count("MapInArrow") == 1


def test_candidates_ends_and_windows_meet_placed_by_unit(spark):
    """Both ends, the anchors and the window of a relation are joined on the unit alone; an end named twice gives two rows, as a join does."""
    span = "array<struct<start_char:long,end_char:long,section_order:long,chunk_id:string,quote:string>>"
    here = lambda a: [(a, a + 2, 0, "c", "Aa")]
    valid = spark.createDataFrame([(1, "u", "x", "person", "Aa", here(3)), (1, "u", "y", "person", "Bb", here(9)), (1, "u", "y", "person", "Cc", here(12))],
                                  f"corpus_id long, unit_id string, local_id string, type string, name string, spans {span}")
    relations = spark.createDataFrame([(1, "u", 0, "x", "y", "knows"), (1, "u", 1, "x", "z", "knows"), (1, "w", 0, "x", "y", "knows")],
                                      "corpus_id long, unit_id string, pos long, source string, target string, type string")
    placed = spark.createDataFrame([(1, "u", "relation", 0, 0, 3, 5, 0, "c", "Aa"), (1, "u", "relation", 0, 1, 9, 11, 0, "c", "Bb"), (1, "u", "relation", 1, 0, 3, 5, 0, "c", "Aa")],
                                   "corpus_id long, unit_id string, kind string, pos long, part int, start_char long, end_char long, section_order long, chunk_id string, quote string")
    windows = spark.createDataFrame([(1, "u", 0, 20), (1, "w", 20, 40)], "corpus_id long, unit_id string, core_start long, core_end long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = X.validate_relations(relations, valid, placed, windows)
        assert _plan(out).count("Exchange hashpartitioning") == 4  # each input once
        got = sorted((r.unit_id, r.pos, str(r.target_name), r.status) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == [("u", 0, "Bb", "kept"), ("u", 0, "Cc", "kept"), ("u", 1, "None", "rejected"), ("w", 0, "None", "rejected")]


def test_names_are_folded_where_they_stand(spark):
    from quillgraph.functions.udfs import with_folded
    given = spark.createDataFrame([(1, " ＡＢ "), (2, None), (3, "Straße"), (3, "Straße")], "k int, name string")
    out = with_folded(given, "name", "folded")
    assert "Exchange" not in _plan(out)
    assert sorted((r.k, str(r.folded)) for r in out.collect()) == [(1, "ab"), (2, "None"), (3, "strasse"), (3, "strasse")]


def test_chunk_bounds_are_those_of_the_lines_and_shuffle_no_text(spark, tmp_path):
    from quillgraph.plans.adapters import chunk_bounds, line_chunks
    spark.createDataFrame([(1, "one\ntwo\n\nfour", "s", "en"), (2, "", "s", "en"), (3, None, "s", "en"), (4, "é\n漢字", "s", None)],
                          "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    bounds = chunk_bounds(spark, str(tmp_path))
    rows = lambda df: sorted(map(tuple, df.select(bounds.columns).collect()))
    assert rows(bounds) == rows(line_chunks(spark, str(tmp_path)))
    below = _plan(bounds).split("Exchange")[1]
    assert "Generate" in below  # lengths are taken below the exchange, so no text passes it


def test_lists_behind_the_deciding_edges_are_not_fetched(spark):
    """Only lists that begin before the ``most``-th allowed edge are read; what filters drop does not count, and a repeated request
    or an edge seen in two ranges counts once."""
    rows = [("a", f"r{i}", f"x{i}", m) for i in range(4) for m in (1, 2)] + [("b", f"s{i}", f"y{i}", 1) for i in range(3)] + [("c", "t0", "z0", 1), ("d", "u0", "w0", 1)]
    adj = spark.createDataFrame([(n, r, o, "knows", "person", m, m, 0) for n, r, o, m in rows],
                                "node string, relation_id string, other string, relation_type string, other_type string, first_section long, last_section long, block long")
    asked = [("q", n, p, "e", None) for p, n in enumerate("abcd")] * 2 + [("s", n, p, "e", 2) for p, n in enumerate("bacd")]
    start = spark.createDataFrame([(q, n, p, e, f, None, None, None) for q, n, p, e, f in asked],
                                  "request_id string, node string, pos int, entity_id string, scope_from long, scope_to long, entity_types array<string>, relation_types array<string>")
    got = {(r.request_id, r.pos, r.relation_id) for r in Q._first_edges(start, adj, None, 6).collect()}
    assert got == {("q", 0, f"r{i}") for i in range(4)} | {("q", 1, f"s{i}") for i in range(3)} | {("s", 1, f"r{i}") for i in range(4)}


def test_hub_lists_are_looked_up_from_beside(spark):
    """Paths through hubs and to hubs, their lists never read: same paths and reasons as from whole lists, with scopes and type filters."""
    rnd = random.Random(5)
    names = [f"n{i:02}" for i in range(40)]
    pairs = [(names[rnd.randrange(3)] if i % 3 else rnd.choice(names), rnd.choice(names)) for i in range(160)]
    edges = [(f"r{i:03}", a, b, "knows" if i % 4 else "located_in") for i, (a, b) in enumerate(pairs) if a != b]
    g = {"entities": spark.createDataFrame([(n, "character" if n[-1] != "7" else "location") for n in names[:39]], "entity_id string, type string"),
         "relations": spark.createDataFrame([(r, a, b, t, "affirmed", "narration") for r, a, b, t in edges], "relation_id string, source_id string, target_id string, type string, polarity string, statement_mode string"),
         "evidence_groups": spark.createDataFrame([(f"g{r}", r, rnd.randrange(9), rnd.randrange(9)) for r, *_ in edges], "group_id string, relation_id string, first_section int, last_section int")}
    asked = [(i, rnd.choice(names), rnd.choice(names[:3] if i % 2 else names), 1 + i % 3, 1 + i % 4, rnd.choice([None, None, 2]), rnd.choice([None, None, 7]), rnd.choice([None, None, ["location"]]), rnd.choice([None, None, ["knows"]]))
             for i in range(150)]
    rq = spark.createDataFrame(asked, "request_id int, from_id string, to_id string, max_hops int, limit int, scope_from int, scope_to int, entity_types array<string>, relation_types array<string>")
    found = [[sorted(map(str, frame.collect())) for frame in Q.shortest_paths(rq, g, block_edges=size)] for size in (4, 10_000)]
    assert found[0] == found[1] and sum("path_index=1," in row for row in found[0][0]) > 60
    lengths = {row.count("'n") + row.count("'r") for row in found[0][0]}
    assert {3, 5, 7} <= lengths


def test_placed_rows_are_not_shuffled_again(spark):
    """Of a join with placed rows the other side alone is shuffled, and groups by their keys are counted where they lie."""
    rows = placed(spark.range(1000).selectExpr("id % 50 as node", "id % 2 as block", "id"), "rows", "node", "block")
    ask = spark.range(50).selectExpr("id as node", "id % 2 as block").hint("shuffle_hash")
    met = ask.join(rows, ["node", "block"]).groupBy("node", "block").agg(F.count("*").alias("n"))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and met.agg(F.sum("n")).first()[0] == 1000
