"""Small hand-made cases for what SQL over the driver's tables cannot show."""

import random

from pyspark.sql import functions as F

from lodemap.functions import text as T
from lodemap.operators import build as B
from lodemap.operators import changes as C
from lodemap.operators import graph as G
from lodemap.operators import paths as P
from lodemap.operators import repair as R
from lodemap.operators import resolve as Z
from lodemap.operators import spatial as S
from lodemap.plans.cut import cap_rows, number_rows

NONE = "array<string>"


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_resolve_paths(spark):
    cases = [("a/b", "../c", "a/c"), ("", "./x", "x"), ("a", "../../x", ""), ("a/./b", "c", "a/b/c"), ("a", "b/../../c", "c")]
    got = frame(spark, "d string, r string, want string", *cases).select(T.resolve("d", "r").alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_slug_and_safety(spark):
    row = frame(spark, "a string", (" Ünï Code!! ",)).select(T.slug("a"), T.slug(F.lit("??")), T.is_safe_relative(F.lit("a/../b")),
                                                          T.is_safe_relative(F.lit("C:/x")), T.is_safe_relative(F.lit("a..b/c"))).first()
    assert tuple(row) == ("ünï-code", "domain", False, False, True)


def test_ignore_rules(spark, rows):
    cases = {"node_modules/a.js": True, "x/dist/y.js": True, "dist": False, "a/b.log": True, "keep.log": False, "build/x": True, "docs/a/b.tmp": True,
             "docs/x.tmp": True, "other/x.tmp": False, "src/[x].ts": True, "Contest.swift": True, "a b ": True}
    df = frame(spark, "repo_id long, path string", *[(1, p) for p in cases])
    rules = ["*.log", "/build", "docs/**/*.tmp", "!keep.log", r"src/\[x\].ts", "**/*Test.swift", r"a\ b\ ", "# no", ""]
    assert dict(rows(P.apply_ignore(df, excludes=rules), "path", "ignored")) == cases
    per_repo = frame(spark, "repo_id long, layer_no int, content string", (1, 2, "\n".join(rules)))
    assert dict(rows(P.apply_ignore(df, P.layered_rules(per_repo)), "path", "ignored")) == cases


def test_resolvers(spark, rows):
    files = frame(spark, "repo_id long, path string", *[(1, p) for p in [
        "pkg/__init__.py", "pkg/a.py", "pkg/sub/b.py", "src/top.py", "svc/go.mod", "svc/util/u.go", "svc/util/u_test.go", "lib/com/x/Thing.java", "other/Thing.kt",
        "src/Service/Mailer.php", "src/main.rs", "src/net.rs", "src/net/mod.rs", "src/deep/er.rs", "web/foo.ts", "web/bar.js.ts", "h/x.hpp", "docs/g.md"]])

    def ask(path, source, language, specs=()):
        return (1, path, 0, source, list(specs), language)

    cases = [
        (ask("pkg/sub/b.py", "..", "python", ["a", "*"]), ["pkg/a.py"]), (ask("pkg/a.py", "pkg", "python", ["a"]), ["pkg/__init__.py", "pkg/a.py"]),
        (ask("pkg/a.py", "top", "python", ["f"]), ["src/top.py"]), (ask("pkg/a.py", "....x", "python", []), []),
        (ask("svc/m.go", "ex.org/svc/util", "go"), ["svc/util/u.go"]), (ask("m.go", "ex.org/svc/util", "go"), []),
        (ask("A.java", "com.x.Thing", "java"), ["lib/com/x/Thing.java"]), (ask("A.java", "zzz.Thing", "java"), ["lib/com/x/Thing.java", "other/Thing.kt"]),
        (ask("a.php", "App\\Service\\Mailer", "php"), ["src/Service/Mailer.php"]), (ask("src/main.rs", "net", "rust"), ["src/net.rs", "src/net/mod.rs"]),
        (ask("src/main.rs", "crate::deep::er::Thing", "rust"), ["src/deep/er.rs"]), (ask("web/a.ts", "./foo.js", "typescript"), ["web/foo.ts"]),
        (ask("web/a.ts", "./bar.js", "typescript"), []), (ask("h/a.cpp", "x", "cpp"), ["h/x.hpp"]), (ask("docs/a.md", "./g.md#top", "markdown"), ["docs/g.md"]),
        (ask("docs/a.md", "/docs/g.md?x", "markdown"), ["docs/g.md"]), (ask("go.go", "package:main", "go"), []),
    ]
    numbered = [(r[0], r[1], i, *r[3:]) for i, (r, _) in enumerate(cases)]
    imports = frame(spark, "repo_id long, path string, decl_seq int, source string, specifiers array<string>, language string", *numbered)
    configs = frame(spark, "repo_id long, path string, content string", (1, "svc/go.mod", "// x\nmodule ex.org/svc // y\n"),
                    (1, "composer.json", '{"autoload": {"psr-4": {"App\\\\": "./src/"}}}'))
    got = {i: [] for i in range(len(cases))}
    for i, target in rows(Z.resolve_all(imports, files, configs), "decl_seq", "target"):
        got[i].append(target)
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(w) for i, (_, w) in enumerate(cases)}


def test_production_candidates(spark):
    cases = {"src/test/java/a/FooTest.java": "src/main/java/a/Foo.java", "Tests/AppTests/FooTests.swift": "Sources/App/Foo.swift", "tests/unit/test_x.py": "src/unit/x.py",
             "Foo.Tests/A/BTests.cs": "Foo/A/B.cs", "pkg/a_test.go": "pkg/a.go", "src/__tests__/x.test.tsx": "src/x.ts", "spec/m/x_spec.rb": "app/m/x.rb"}
    for r in frame(spark, "p string", *[(p,) for p in cases]).select("p", B.production_candidates("p").alias("c")).collect():
        assert cases[r.p] in r.c, (r.p, r.c)


def test_rank_of_a_cycle(spark, rows):
    nodes = frame(spark, "repo_id long, id string, node_ord long", *[(1, n, i) for i, n in enumerate("abcd")])
    edges = frame(spark, "repo_id long, source string, target string, type string, edge_ord long",
                  (1, "a", "b", "imports", 0), (1, "b", "c", "imports", 1), (1, "c", "a", "imports", 2), (1, "c", "d", "calls", 3), (1, "d", "a", "related", 4))
    assert rows(G.dependency_rank(nodes, edges), "id", "rank") == [("a", 3), ("b", 1), ("c", 2), ("d", 3)]


def test_shortest_path_prefers_early_edges(spark, rows):
    edges = frame(spark, "repo_id long, source string, target string, type string, edge_ord long",
                  (1, "s", "b", "calls", 0), (1, "s", "a", "calls", 1), (1, "a", "t", "calls", 2), (1, "t", "b", "calls", 3))
    pairs = frame(spark, "repo_id long, start string, end string", (1, "s", "t"), (1, "s", "s"), (1, "s", "zz"))
    assert rows(G.shortest_paths(edges, pairs), "end", "path") == [("s", ("s",)), ("t", ("s", "b", "t"))]


def test_paths_and_ranks_are_the_same_in_tasks_and_by_rounds(spark, rows, monkeypatch):
    """Random cyclic graphs with ties in edge order, once in one task each, once by rounds."""
    r = random.Random(11)
    made = [(repo, f"n{a}", f"n{b}", "imports", r.randrange(6)) for repo in (1, 2) for a, b in [(r.randrange(14), r.randrange(14)) for _ in range(26)]]
    edges = frame(spark, "repo_id long, source string, target string, type string, edge_ord long", *made)
    nodes = frame(spark, "repo_id long, id string, node_ord long", *[(repo, f"n{i}", (i * 5) % 14) for repo in (1, 2, 3) for i in range(14)])
    pairs = frame(spark, "repo_id long, start string, end string", *[(repo, f"n{a}", f"n{b}") for repo in (1, 2) for a in range(3) for b in range(14)])
    small = rows(G.shortest_paths(edges, pairs), "repo_id", "start", "end", "path", "hops"), rows(G.dependency_rank(nodes, edges), "repo_id", "id", "rank", "settled")
    monkeypatch.setattr(G, "TASK_ROWS", 0)
    large = rows(G.shortest_paths(edges, pairs), "repo_id", "start", "end", "path", "hops"), rows(G.dependency_rank(nodes, edges), "repo_id", "id", "rank", "settled")
    assert small == large and len(small[0]) > 40 and len(small[1]) == 42


def test_ranks_of_long_chains_and_cycles(spark):
    n = 1000
    chain = [(1, f"n{i:04}", f"n{i + 1:04}", "imports", i) for i in range(n - 1)]
    ring = [(2, f"n{i:04}", f"n{(i + 1) % n:04}", "imports", i) for i in range(n)]
    edges = frame(spark, "repo_id long, source string, target string, type string, edge_ord long", *chain, *ring)
    nodes = frame(spark, "repo_id long, id string", *[(repo, f"n{i:04}") for repo in (1, 2) for i in range(n)])
    got = {(x.repo_id, x.id): x.rank for x in G.dependency_rank(nodes, edges).collect()}
    assert all(got[1, f"n{i:04}"] == i for i in range(n))
    # The ring is opened at its first node, which keeps the rank that its last one gives it.
    assert all(got[2, f"n{i:04}"] == (i or n) for i in range(n))


def test_long_shortest_path(spark, rows):
    chain = [(1, f"n{i}", f"n{i + 1}", "imports", 1.0, i) for i in range(70)]
    edges = frame(spark, "repo_id long, source string, target string, type string, weight double, edge_ord long", *chain)
    pairs = frame(spark, "repo_id long, start string, end string", (1, "n0", "n70"), (1, "n0", "elsewhere"))
    assert rows(G.shortest_paths(edges, pairs), "end", "hops") == [("n70", 70)]


def test_ancestors_through_many_merges(spark):
    nested = [(1, f"m{i}", p, k) for i in range(200) for k, p in enumerate((f"a{i}", f"m{i + 1}"))]
    zigzag = [(2, f"z{i}", p, k) for i in range(12) for k, p in enumerate((f"z{i + 1}", f"y{i}") if i % 2 else (f"y{i}", f"z{i + 1}"))]
    commits = frame(spark, "repo_id long, commit_id string, parent_id string, parent_no int", *nested, *zigzag)
    starts = frame(spark, "repo_id long, label string, commit_id string", (1, "head", "m0"), (2, "head", "z0"), (3, "head", "alone"))
    got = {r.repo_id: r.n for r in C.ancestors(commits, starts).groupBy("repo_id").agg(F.countDistinct("commit_id").alias("n")).collect()}
    assert got == {1: 401, 2: 25, 3: 1}


def test_ancestors_are_the_same_in_tasks_and_by_jumps(spark, rows, monkeypatch):
    r = random.Random(5)
    made = {(repo, i, p) for repo in (1, 2) for i in range(1, 30) for p in r.sample(range(i), min(i, r.randrange(1, 3)))}
    numbered = [(repo, c, p, [x for _, d, x in sorted(made) if (d, _) == (c, repo)].index(p)) for repo, c, p in sorted(made)]
    commits = frame(spark, "repo_id long, commit_id long, parent_id long, parent_no int", *numbered, (1, 0, None, 0), (2, 0, None, 0))
    starts = frame(spark, "repo_id long, label string, commit_id long", (1, "a", 29), (1, "b", 12), (2, "a", 20), (3, "a", 7))
    small = rows(C.ancestors(commits, starts), "repo_id", "label", "commit_id")
    monkeypatch.setattr(C, "TASK_ROWS", 0)
    assert small == rows(C.ancestors(commits, starts), "repo_id", "label", "commit_id") and len(small) > 15


def test_freshness_by_trees_sees_net_changes(spark, rows):
    """A change and its revert leave the graph fresh; a moved folder, a file that becomes a folder and own folders are told apart."""
    files = {
        1: {"c0": {"src/a.ts": "1", "src/deep/b.ts": "1", "x": "1"}, "c1": {"src/a.ts": "2", "src/deep/b.ts": "1", "x": "1"}, "c2": {"src/a.ts": "1", "src/deep/b.ts": "1", "x": "1"}},
        2: {"c0": {"src/a.ts": "1", "lib/z": "9", ".ua/g.json": "1"}, "c1": {"src/a.ts/in": "1", "lib/z": "9", ".ua/g.json": "2"}, "c2": {"src/a.ts/in": "1", "old/z": "9", ".ua/g.json": "3"}},
    }
    snapshots = frame(spark, "repo_id long, commit_id string, path string, content_hash string", *[(r, c, p, h) for r, cs in files.items() for c, fs in cs.items() for p, h in fs.items()])
    commits = frame(spark, "repo_id long, commit_id string, parent_id string", *[(r, f"c{i}", f"c{i - 1}" if i else None) for r in (1, 2) for i in range(3)])
    touched = frame(spark, "repo_id long, commit_id string, path string", (1, "c1", "src/a.ts"), (1, "c2", "src/a.ts"), (2, "c1", "src/a.ts/in"), (2, "c2", "old/z"))
    builds = frame(spark, "repo_id long, commit string", (1, "c0"), (2, "c0"))
    heads = frame(spark, "repo_id long, commit string", (1, "c2"), (2, "c2"))
    nothing = frame(spark, "repo_id long, path string").limit(0)
    trees = C.folder_trees(snapshots, "commit_id")
    got = C.freshness(builds, heads, commits, touched, nothing, trees=trees)
    assert rows(got, "repo_id", "status", "n_changed_files") == [(1, "fresh", 0), (2, "stale", 4)]
    assert [r.status for r in C.freshness(builds, heads, commits, touched, nothing).orderBy("repo_id").collect()] == ["stale", "stale"]
    pairs = trees[1].groupBy("repo_id").agg(F.max(F.when(F.col("commit_id") == "c0", F.col("tree"))).alias("old"), F.max(F.when(F.col("commit_id") == "c2", F.col("tree"))).alias("new"))
    assert rows(C.tree_changes(trees[0], pairs).filter("path NOT LIKE '.ua%'"), "repo_id", "path", "state") == [
        (2, "lib/z", "deleted"), (2, "old/z", "added"), (2, "src/a.ts", "deleted"), (2, "src/a.ts/in", "added")]
    none = C.folder_trees(snapshots.limit(0), "commit_id")
    assert none[0].count() == none[1].count() == 0


def test_search_scores(spark, rows):
    nodes = frame(spark, "repo_id long, id string, name string, summary string, tags array<string>, type string",
                  (1, "1", "graph-builder", "", [], "file"), (1, "2", "other", "A graph of things", [], "file"), (1, "3", "x", "Not yet analyzed.", ["graph"], "class"))
    hits = {(q, i): s for q, i, s in rows(G.search(nodes, {"g": "graph", "sub": "grphbldr", "no": "analyzed"}), "query_id", "id", "score")}
    assert hits[("g", "3")] == 0 and hits[("g", "1")] == 0.05 and ("sub", "1") in hits and not any(q == "no" for q, _ in hits)


def test_positions_and_caps_of_a_hot_group(spark, rows):
    data = [(0 if i % 3 else 1, random.Random(i).random(), i) for i in range(900)]
    df = frame(spark, "repo_id long, v double, i long", *data).repartition(5)
    got = rows(number_rows(df, ["repo_id"], ["v", "i"], "pos"), "repo_id", "pos", "i")
    want = []
    for k in (0, 1):
        for p, (_, _, i) in enumerate(sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[2])), 1):
            want.append((k, p, i))
    assert sorted(got) == sorted(want)
    kept, over = cap_rows(df, ["repo_id"], ["v", "i"], 400)
    assert rows(over, "repo_id", "total") == [(0, 600)] and kept.count() == 700


def test_close_pairs_of_equal_points(spark, rows):
    random.seed(3)
    pts = [(1, i, float(random.randrange(0, 90, 5)), float(random.randrange(0, 90, 5)), float(random.choice([2, 9]))) for i in range(120)] + [(1, 500 + i, 7.0, 7.0, 3.0) for i in range(50)]
    want = sum(1 for a in range(len(pts)) for b in range(a) if (pts[a][2] // 60, pts[a][3] // 60) == (pts[b][2] // 60, pts[b][3] // 60)
               and ((pts[a][2] - pts[b][2]) ** 2 + (pts[a][3] - pts[b][3]) ** 2) ** 0.5 < (pts[a][4] + pts[b][4]) * 1.4)
    assert rows(S.close_pairs(frame(spark, "repo_id long, node_id long, x double, y double, r double", *pts), 60.0), "pairs") == [(want,)]


def test_wide_rectangles(spark):
    pts = frame(spark, "repo_id long, node_id long, x double, y double", *[(1, i, i * 37.0, -i * 11.0) for i in range(200)], (1, 999, float("nan"), 0.0))
    rects = frame(spark, "repo_id long, rect_id long, x0 double, y0 double, x1 double, y1 double", (1, 1, -1e7, -1e7, 1e7, 1e7), (1, 2, 0.0, -11.0, 37.0, 0.0))
    assert {r.rect_id: r.n for r in S.rect_query(pts, rects, 10.0).groupBy("rect_id").agg(F.count("*").alias("n")).collect()} == {1: 200, 2: 2}


def test_freshness_states(spark, rows):
    commits = frame(spark, "repo_id long, commit_id string, parent_id string, parent_no int",
                    *[(r, c, p, n) for r in (1, 2, 3, 4) for c, p, n in [("a", None, 0), ("b", "a", 0), ("c", "b", 0), ("x", "b", 0), ("m", "c", 0), ("m", "x", 1)]])
    files = frame(spark, "repo_id long, commit_id string, path string", *[(r, c, c + ".ts") for r in (1, 2, 3, 4) for c in "abcxm"])
    builds = frame(spark, "repo_id long, commit string", (1, "b"), (2, "m"), (3, "x"), (4, "c"), (5, "a"), (6, ""))
    heads = frame(spark, "repo_id long, commit string", (1, "m"), (2, "a"), (3, "c"), (4, "c"))
    working = frame(spark, "repo_id long, path string", (4, "w.ts"), (4, ".ua/meta.json"))
    got = {r.repo_id: (r.status, r.relation, r.behind, r.ahead, r.n_changed_files, r.reason) for r in C.freshness(builds, heads, commits, files, working).collect()}
    assert got == {1: ("stale", "behind", 3, 0, 3, None), 2: ("stale", "ahead", 0, 4, 4, None), 3: ("stale", "diverged", 1, 1, 2, None),
                   4: ("dirty", None, None, None, 1, None), 5: ("unknown", None, None, None, 0, "not-a-git-repository"), 6: ("unknown", None, None, None, 0, "missing-graph-commit")}


def test_change_class(spark, rows):
    def prints(*rows_):
        return frame(spark, f"repo_id long, path string, content_hash string, functions {C.FUNCTION}, classes {C.CLASS}, imports {NONE}, exports {NONE}, has_structure boolean", *rows_)

    def fn(name="f", params=("a",), lines=10):
        return (name, list(params), None, True, lines)
    old = prints(*[(1, p, "h1", [fn()], [], ["a:"], [], p != "plain") for p in ["same", "body", "sig", "size", "imp", "new_fn", "plain"]])
    new = prints((1, "same", "h1", [fn()], [], ["a:"], [], True), (1, "body", "h2", [fn(lines=11)], [], ["a:"], [], True), (1, "sig", "h2", [fn(params="b")], [], ["a:"], [], True),
                 (1, "size", "h2", [fn(lines=16)], [], ["a:"], [], True), (1, "imp", "h2", [fn()], [], ["b:"], [], True), (1, "new_fn", "h2", [fn(), fn("g")], [], ["a:"], [], True),
                 (1, "plain", "h2", [fn()], [], ["a:"], [], True))
    assert dict(rows(C.change_class(old, new), "path", "change")) == {
        "same": "none", "body": "cosmetic", "sig": "structural", "size": "structural", "imp": "structural", "new_fn": "structural", "plain": "structural"}


def test_foreign_document(spark, rows):
    doc = """{"project": {"name": "p"}, "kind": "design", "nodes": [{"id": "a", "type": "Frame", "complexity": 9, "figmaMeta": {"fileKey": "k", "dimensions": {"width": 1, "height": 2}}},
     {"id": "b", "type": "component_set", "knowledgeMeta": {"category": 5}, "lineRange": [1, "x"]}, {"type": "file"}, {"id": "a", "type": "file"}, {"id": "c", "type": "page"}],
     "edges": [{"source": "a", "target": "b", "type": "variant", "weight": 5, "direction": "BOTH"}, {"source": "a", "target": "a"}, {"source": "a", "target": "zz"}, {"source": "", "target": "b"}],
     "layers": [{"id": "L", "name": "My Layer", "nodeIds": ["a", "gone"]}], "tour": [{"title": "one", "nodeIds": ["a"]}]}"""
    out = R.validate(frame(spark, "repo_id long, document string", (1, doc), (2, "[1]"), (3, "not json")))
    assert rows(out["nodes"], "id", "type", "complexity") == [("a", "screen", "complex"), ("b", "componentSet", "moderate"), ("c", "page", "moderate")]
    meta = {r.id: (r.figma_meta, r.knowledge_meta, r.line_start) for r in out["nodes"].collect()}
    assert meta["a"][0].dimensions.width == 1.0 and meta["b"][1:] == (None, None)
    assert rows(out["edges"], "source", "target", "type", "weight", "direction") == [("a", "b", "variant_of", 1.0, "bidirectional")]
    assert rows(out["layer_members"], "layer_id", "node_id") == [("layer:my-layer", "a")]
    assert rows(out["issues"].filter("repo_id > 1"), "repo_id", "level") == [(2, "fatal"), (3, "fatal")]
    assert sorted(r[0] for r in rows(out["issues"].filter("repo_id = 1"), "category")) == sorted(
        ["alias", "type-coercion", "alias", "invalid-node", "invalid-node", "alias", "out-of-range", "invalid-reference", "invalid-edge"])
