"""A cross-section of the registered queries against their SQL at the smallest scale.

tools/check_oracles.py runs every one of them at any scale.
"""
import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["s02_content_dedup", "s07_candidate_ingest", "s10_publish_gate", "c08_heading_scores", "c11_structure_report", "c12_sections", "c17_char_to_line",
         "r06_lexical_topk", "r09_dense_topk", "r12_hits", "r14_read_context", "k02_split_windows", "k08_relation_validation", "k11_core_density",
         "k13_blocking_candidates", "k17_identities", "k20_evidence_groups", "g01_entity_search", "g04_neighbors_edges", "g05_shortest_paths",
         "a01_accept_evidence", "a05_repeated_calls", "t02_usage_by_node", "t03_turn_state", "w03_live_turns", "e01_recall_at_k"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{round(float(v), 6) + 0.0:.6f}"
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want and got


def test_every_oracle_has_a_query_and_the_flagship_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
