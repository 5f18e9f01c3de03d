"""Graph documents and responses: read once, and back from lines like from one document."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lodemap.operators import enrich, repair
from lodemap.sources import documents
from workload import language_queries as L
from workload.check import canon
from workload.views import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_lines_come_back_like_documents(spark, monkeypatch):
    """Graphs over the limit are written as lines; their nodes, edges and members pass the same reader."""
    monkeypatch.setattr(documents, "MAX_DOCUMENT_NODES", 10)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = L.q_round_trip(spark, SF)
    cur = con.execute(L.S_ROUND_TRIP)
    want = canon(cur.fetchall(), [d[0] for d in cur.description])
    assert canon([tuple(r) for r in df.collect()], df.columns) == want


def test_lines_are_repaired(spark):
    docs = frame(spark, "repo_id long, document string", (1, '{"project": {"name": "a"}, "nodes": [{"id": "x", "type": "file"}]}'))
    parts = frame(
        spark, "repo_id long, kind string, json string",
        (2, "project", '{"project": "{\\"name\\": \\"b\\"}"}'), (2, "node", '{"id": "m", "type": "fn"}'), (2, "node", '{"id": "m", "type": "file"}'),
        (2, "edge", '{"source": "m", "target": "gone", "type": "calls"}'), (2, "layer", '{"id": "layer:l", "name": "L", "order": 0}'),
        (2, "member", '{"layer": "layer:l", "node": "m", "order": 0}'), (2, "member", '{"layer": "layer:l", "node": "gone", "order": 1}'),
        (2, "step", '{"title": "T", "nodeIds": ["m", "gone"], "order": 1}'), (3, "node", '{"id": "lost", "type": "file"}'))
    out = repair.validate(docs, parts)
    assert sorted((r.repo_id, r.id) for r in out["nodes"].collect()) == [(1, "x"), (2, "m")]
    assert [(r.repo_id, r.layer_id, r.node_id) for r in out["layer_members"].collect()] == [(2, "layer:l", "m")]
    assert [(r.repo_id, r.node_ids) for r in out["tour_steps"].collect()] == [(2, ["m"])]
    said = sorted(r.category for r in out["issues"].collect() if r.category != "alias")
    assert said == ["invalid-node", "invalid-reference"] and out["edges"].isEmpty()


def test_documents_are_made_once(spark):
    made = frame(spark, "repo_id long, document string", (1, '{"project": {"name": "a"}, "nodes": [{"id": "x", "type": "file"}]}'))
    out = repair.validate(made.withColumn("document", F.translate("document", "~", "-")))
    assert not any("translate(" in plan(out[t]) for t in ("nodes", "edges", "layers", "layer_members", "tour_steps", "issues", "projects"))


def test_responses_are_read_once(spark):
    text = 'Sure: {"domains": [{"name": "A", "flows": [{"name": "F", "steps": [{"name": "S"}]}]}]}'
    nodes, edges = enrich.domain_graph(frame(spark, "repo_id long, text string", (1, text)), frame(spark, "repo_id long, id string", (1, "n")))
    assert not any("parse_json" in plan(df) for df in (nodes, edges))
    assert nodes.count() == 3 and edges.count() == 2


@pytest.mark.parametrize("text,found", [
    ('{"a": 1}', '{"a":1}'), (' {"a": 1} ', '{"a":1}'), ('x {"a": {"b": "}"}} y', '{"a":{"b":"}"}}'), ('{"a": 1} and {"b": 2}', '{"a":1}'), ('[{"a": 1}, {"b": 2}]', '{"a":1}'),
    ('so {"a": "{"} done }', '{"a":"{"}'), ("no object", None), ('{"a": 1', None), ("} {", None), ('"{" {"a": 1}', None), ("", None), (None, None),
])
def test_first_object(spark, text, found):
    df = frame(spark, "t string", (text,)).select(F.to_json(enrich.json_object("t")).alias("o"))
    assert df.first().o == found
