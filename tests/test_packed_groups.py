import random

from pyspark.sql import functions as F

from lodemap.operators import changes as C
from lodemap.operators import graph as G
from lodemap.plans import bounded

EDGE = "repo_id long, source string, target string, type string, edge_ord long"


def counted(monkeypatch, module):
    calls = []
    monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: calls.append(1) or cut(df))
    return calls


def test_small_parts_of_a_large_repository_take_few_rounds(spark, rows, monkeypatch):
    r = random.Random(3)
    made = [(1, "top", f"c{c}", "contains", 0) for c in range(6)] + [(1, f"c{c}", f"c{c}n{i}", "contains", i) for c in range(6) for i in range(0, 40, 2)]
    made += [(1, f"c{c}n{i}", f"c{c}n{i + 1}", "calls", i) for c in range(6) for i in range(39)]
    made += [(1, f"c{c}n{r.randrange(40)}", f"c{c}n{r.randrange(40)}", "imports", i) for c in (1, 2) for i in range(9)]
    edges = spark.createDataFrame(made, EDGE)
    ids = sorted({e[1] for e in made} | {e[2] for e in made})
    nodes = spark.createDataFrame([(1, i, (n * 7) % 11) for n, i in enumerate(ids)], "repo_id long, id string, node_ord long")
    whole = rows(G.dependency_rank(nodes, edges), "id", "rank", "settled")
    monkeypatch.setattr(G, "TASK_ROWS", 150)
    calls = counted(monkeypatch, G)
    assert rows(G.dependency_rank(nodes, edges), "id", "rank", "settled") == whole and len(whole) == 247
    assert len(calls) < 20  # 40 nodes in a row took 80


def test_rank_where_the_order_is_a_struct(spark, rows):
    nodes = spark.sql("select 1L as repo_id, id, named_struct('path', if(id = 'b', null, 'p'), 'seq', seq) as node_ord from values ('a', 1), ('b', 2), ('c', 0) as t(id, seq)")
    edges = spark.createDataFrame([(1, "a", "b", "imports", 0), (1, "b", "c", "imports", 1), (1, "c", "a", "imports", 2)], EDGE)
    assert rows(G.dependency_rank(nodes, edges), "id", "rank") == [("a", 2), ("b", 3), ("c", 1)]


def test_small_groups_share_calls(spark, rows, monkeypatch):
    commits = spark.range(400).select(F.expr("id div 2 as repo_id"), F.expr("id % 2 as commit_id"), F.expr("if(id % 2 = 1, 0L, null) as parent_id"))
    starts = spark.range(200).select(F.col("id").alias("repo_id"), F.lit("a").alias("label"), F.lit(1).cast("long").alias("commit_id"))
    seen = []
    real = bounded.split_groups

    def split(*args):
        here, others, more = real(*args)
        seen.append(here.select("_pack").distinct().count())
        return here, others, more

    monkeypatch.setattr(C, "split_groups", split)
    assert rows(C.ancestors(commits, starts), "repo_id", "commit_id") == sorted(((i, c) for i in range(200) for c in (0, 1)), key=str)
    assert seen and seen[0] <= spark.sparkContext.defaultParallelism


def test_components(spark, rows):
    r = random.Random(8)
    links = [(r.randrange(90), r.randrange(90)) for _ in range(60)] + [(200 + (i * 37) % 61, 200 + (i * 37 + 37) % 61) for i in range(60)]
    root = {x: x for link in links for x in link}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = bounded.components(spark.createDataFrame(links, "a long, b long"))
    assert rows(got, "a", "b") == sorted(((a, b) for a, b in root.items() if a != b), key=str)
