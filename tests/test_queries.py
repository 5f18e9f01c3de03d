"""Registered queries against DuckDB on the smallest tables: one of each kind of job."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from workload.check import canon
from workload.views import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CHOSEN = [
    "blast_radius", "links", "search", "search_requests", "shortest_paths", "dependency_rank", "classify_paths", "ignore_filter", "ignore_repo_rules", "layers",
    "resolve_tsjs", "test_pairs", "cap_nodes", "repair_nodes", "repair_edges", "document_edges", "update_kind", "signature_changes",
    "freshness", "wiki_links", "wiki_citations", "nearest", "close_pairs", "debounce", "extract_calls", "batches", "parse_responses",
    "domain_edges", "ask_context", "content_digest", "call_edges",
]


def test_registry_is_consistent():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and set(CHOSEN) <= set(queries)


def test_entry(spark):
    assert entry.entry(spark).columns == ["repo_id", "hop", "n"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == canon(cur.fetchall(), cols)
