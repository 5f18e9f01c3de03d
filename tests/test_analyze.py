"""A small project end to end: nodes, edges, layers, tour and the JSON round trip."""

import json

import pytest
from pyspark.sql import functions as F

from lodemap.operators import repair
from lodemap.plans.analyze import analyze
from lodemap.sources import corpus, documents
from lodemap.sources.documents import export_compact, graph_documents, read_graph_documents, write_graph_documents

DEMO = {
    "package.json": '{"name": "demo", "description": "", "dependencies": {"express": "1"}, "x": "\\"express\\":"}',
    "README.md": "# Demo\nSee [main](src/main.ts)\n",
    "src/types.ts": "export interface User {\n  id: string;\n  name: string;\n}\n",
    "src/main.ts": "import { User } from './types';\nimport { missing } from './gone';\nexport function start(u: User) {\n  helper(u);\n}\nexport function helper(u) {\n  return u;\n}\n",
    "src/main.test.ts": "import { start } from './main';\nfunction check() {\n  start();\n}\n",
    "Dockerfile": "FROM node:18 AS app\nEXPOSE 3000\n",
    "node_modules/x/index.js": "export const no = 1;",
    "empty.ts": "",
    "bad.json": "\x00\x00",
    "braces.js": "{" * 500,
    "open.js": 'const s = "never closed\nexport function ok() {}\n',
}
WIKI = {
    "index.md": "# Index\n## Basics\n- [[Alpha]]\n- [[Beta]]\n",
    "Alpha.md": "# Alpha\nAbout [[Beta]] and [[Nowhere]]. See paper.\n",
    "Beta.md": "Links to [[alpha]].\n",
    "raw/paper.txt": "data",
}


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(1, p, c) for p, c in DEMO.items()] + [(2, p, c) for p, c in WIKI.items()] + [(3, p, c) for p, c in reversed(DEMO.items())]
    src = spark.createDataFrame(rows, "repo_id long, path string, content string").repartition(3)
    return analyze(src)


def test_nodes_and_edges(graph, rows):
    ids = {r[0] for r in rows(graph["nodes"].filter("repo_id = 1"), "id")}
    assert {"file:src/main.ts", "config:package.json", "document:README.md", "service:Dockerfile", "service:Dockerfile:app",
            "class:src/types.ts:User", "function:src/main.ts:start", "function:src/main.ts:helper", "file:braces.js"} <= ids
    assert not any("node_modules" in i for i in ids)
    edges = set(rows(graph["edges"].filter("repo_id = 1"), "source", "target", "type"))
    assert {("file:src/main.ts", "file:src/types.ts", "imports"), ("document:README.md", "file:src/main.ts", "documents"),
            ("function:src/main.ts:start", "function:src/main.ts:helper", "calls"), ("file:src/main.ts", "file:src/main.test.ts", "tested_by"),
            ("file:src/main.ts", "function:src/main.ts:start", "contains"), ("file:src/main.ts", "function:src/main.ts:start", "exports")} <= edges
    assert all(s in ids and t in ids for s, t, _ in edges)
    assert len(edges) == graph["edges"].filter("repo_id = 1").count()
    tags = dict(rows(graph["nodes"].filter("repo_id = 1"), "id", "tags"))
    assert "tested" in tags["file:src/main.ts"] and "test" in tags["file:src/main.test.ts"]


def test_project_layers_issues(graph, rows):
    assert rows(graph["projects"].filter("repo_id = 1"), "name", "description", "complexity", "languages") == [
        ("demo", "A demo project.", "small", ("typescript", "javascript"))]
    assert rows(graph["issues"].filter("repo_id = 1"), "category") == [("unresolved-import",)]
    members = graph["layer_members"].filter("repo_id = 1")
    assert members.count() == members.select("node_id").distinct().count() == graph["nodes"].filter(
        "repo_id = 1 and type in ('file','config','document','service') and node_ord.kind = 0 or repo_id = 1 and type = 'service'").count()
    first = graph["tour_steps"].filter("repo_id = 1 and step_order = 1").first()
    assert first.title == "Start here" and "document:README.md" in first.node_ids


def test_wiki_branch(graph, rows):
    edges = set(rows(graph["edges"].filter("repo_id = 2"), "source", "target", "type"))
    assert edges == {("article:Alpha.md", "article:Beta.md", "related"), ("article:Beta.md", "article:Alpha.md", "related"),
                     ("article:Alpha.md", "topic:basics", "categorized_under"), ("article:Beta.md", "topic:basics", "categorized_under"),
                     ("article:Alpha.md", "source:raw/paper.txt", "cites")}
    assert graph["issues"].filter("repo_id = 2").count() == 2


def test_round_trip_without_repairs(spark, graph, rows, tmp_path):
    docs, parts = graph_documents(graph)
    assert parts.count() == 0
    parsed = json.loads(docs.filter("repo_id = 1").first().document)
    assert list(parsed) == sorted(parsed) and parsed["project"]["name"] == "demo"
    write_graph_documents(graph, str(tmp_path / "out"))
    again = repair.validate(read_graph_documents(spark, str(tmp_path / "out" / "documents")))
    assert again["issues"].count() == 0
    assert rows(again["nodes"], "repo_id", "id", "type", "tags") == rows(graph["nodes"], "repo_id", "id", "type", "tags")
    assert rows(again["edges"], "source", "target", "type") == rows(graph["edges"], "source", "target", "type")


def test_same_result_in_any_order(graph, rows):
    for table, cols in {"nodes": ("id", "tags", "complexity"), "edges": ("source", "target", "type"), "tour_steps": ("step_order", "node_ids")}.items():
        assert rows(graph[table].filter("repo_id = 3"), *cols) == rows(graph[table].filter("repo_id = 1"), *cols)


def test_compact_export(graph, rows):
    nodes, pairs = export_compact(graph["nodes"], graph["edges"], labelled=3)
    n = nodes.filter("repo_id = 1")
    assert [r[0] for r in sorted(rows(n, "i"))] == list(range(n.count()))
    assert n.filter("label").count() == 3
    assert n.agg(F.sum("d")).first()[0] == 2 * pairs.filter("repo_id = 1").count()


def test_scan_reads_folders(spark, tmp_path, rows):
    for rel, text in {"r1/src/a.py": "x\ny\n", "r1/node_modules/m/i.js": "z", "r1/.ua/graph.json": "{}", "r2/b.md": "\n"}.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(text)
    scanned = corpus.scan_corpus(spark, str(tmp_path))
    assert rows(scanned, "repo", "path", "n_bytes") == [("r1", "src/a.py", 4), ("r2", "b.md", 1)]
    assert rows(corpus.probe_files(scanned), "path", "language", "size_lines") == [("b.md", "markdown", 1), ("src/a.py", "python", 2)]
    tracked = spark.createDataFrame([("r2", "b.md")], "repo string, path string")
    assert rows(corpus.scan_corpus(spark, str(tmp_path), tracked), "path") == [("b.md",)]


def test_large_graphs_are_written_in_all_their_parts(spark, graph, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "MAX_DOCUMENT_NODES", 0)
    write_graph_documents(graph, str(tmp_path / "out"))
    got = {r.kind: r.n for r in documents.read_graph_parts(spark, str(tmp_path / "out" / "parts")).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    tables = {"project": "projects", "node": "nodes", "edge": "edges", "layer": "layers", "member": "layer_members", "step": "tour_steps"}
    assert got == {kind: graph[name].count() for kind, name in tables.items()} and set(got) == set(documents.PART_KINDS)


def test_large_file(spark, rows):
    src = spark.createDataFrame([(1, "big.txt", "abc\n" * (3 << 20)), (1, "unread.txt", None)], "repo_id long, path string, content string")
    assert rows(corpus.probe_files(src), "path", "size_lines", "n_bytes") == [("big.txt", 3 << 20, 12 << 20), ("unread.txt", 0, None)]
