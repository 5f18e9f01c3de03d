"""Search by a table of requests: against the search with literals, and on hot texts and odd rows."""

import random

from pyspark.sql import functions as F

from lodemap.operators import graph as G
from lodemap.operators import search as S

SCHEMA = "repo_id long, id string, node_ord long, name string, summary string, tags array<string>, language_notes string, type string"


def some_nodes(spark):
    rng = random.Random(5)
    parts = ["graph", "builder", "Über", "node", "x", "parse-r", "日本", "a.b", "io", "Graph", "2nd", "aa"]

    def words(most):
        return " ".join(rng.choice(parts) for _ in range(rng.randint(0, most)))

    rows = [(i % 3, f"n{i}", i, words(3), rng.choice(["Not yet analyzed.", words(2), words(9), None]), [words(1) for _ in range(rng.randint(0, 3))],
             rng.choice([None, words(4)]), rng.choice(["file", "class"])) for i in range(240)]
    rows += [(0, f"h{i}", 1000 + i, "index", None, None, None, "file") for i in range(120)] + [(None, "z", 1, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


ASKED = {"whole": "graph", "loose": "grbldr", "two": "node  Über\tzzz", "one": "a", "wide": "日本", "dots": "a.b (", "same": "aa", "twice": "aaaa",
         "hot": "index", "hotloose": "idx", "note": "node graph", "none": "qqqq", "long": "graph" * 30}


def test_same_as_with_literals(spark, rows):
    nodes = some_nodes(spark)
    asked = spark.createDataFrame(list(ASKED.items()), "query_id string, text string")
    cols = ("repo_id", "query_id", "id", "score", "hit_rank")
    for limit, types in ((50, None), (3, ["class"])):
        got = rows(S.search_requests(nodes, asked, limit, types), *cols)
        assert got == rows(G.search(nodes, ASKED, limit, types), *cols) and len(got) > 50


def test_odd_requests_and_empty_tables(spark, rows):
    nodes = some_nodes(spark)
    odd = spark.createDataFrame([("n", None), ("e", ""), ("s", " \t "), (None, "index"), ("t", "index"), ("t", "INDEX zz")], "query_id string, text string")
    got = S.search_requests(nodes, odd, 2)
    assert rows(got.filter("repo_id = 0"), "query_id", "id", "score", "hit_rank") == sorted([(q, f"h{i}", 0.0, i + 1) for q in (None, "t") for i in (0, 1)], key=str)
    assert S.search_requests(nodes, odd.limit(0)).count() == 0 == S.search_requests(nodes.limit(0), odd).count()
    assert S.search_requests(nodes.select("repo_id", "id", "name"), odd, 1).filter("repo_id = 0").count() == 2


def test_a_word_meets_only_texts_under_its_rarest_key(spark):
    texts = spark.range(3000).select(F.lit("name").alias("field"), F.concat(F.lit("common"), F.col("id") % 7, F.when(F.col("id") % 1000 == 0, "-wyvern").otherwise("")).alias("value")).distinct()
    tokens = spark.createDataFrame([("wvrn",), ("commn",), ("nommoc",)], "token string")
    found = {(r.value, r.token) for r in S.match_texts(texts, tokens).collect()}
    want = {(r.value, "commn") for r in texts.collect()} | {(r.value, "wvrn") for r in texts.collect() if "wyvern" in r.value}
    assert found == want


def test_nodes_meet_only_texts_that_can_be_listed(spark, rows, monkeypatch):
    """Forty texts match; for a list of two, nodes are joined to the first eight of them. A null repository has its list too."""
    nodes = spark.createDataFrame([(k, f"n{i:02}{j}", f"match{i:02}") for k in (0, None) for i in range(40) for j in range(3)], "repo_id long, id string, name string")
    asked = spark.createDataFrame([("q", "match")], "query_id string, text string")
    sizes, first = [], S.first_rows

    def seen(df, keys, order, n=1):
        sizes.append(first(df, keys, order, n).count() if "asked" in keys else 0)
        return first(df, keys, order, n)

    monkeypatch.setattr(S, "first_rows", seen)
    got = S.search_requests(nodes, asked, 2)
    assert rows(got, "repo_id", "id", "hit_rank") == [(0, "n000", 1), (0, "n001", 2), (None, "n000", 1), (None, "n001", 2)]
    assert sizes == [0, 2 * 8, 2 * 2]


def test_lists_are_one_row_until_told(spark, rows, monkeypatch):
    """Who asks one text takes its list as it is, dealt into parts where many ask; only the rows of the others are ranked anew."""
    monkeypatch.setattr(S, "ASKERS", 2)
    long = "abcdefghijklmnopqrstuvwxyz"
    nodes = spark.createDataFrame([(k, f"n{i}", f"{'match' if i else long}{i}") for k in (0, None) for i in range(4)], "repo_id long, id string, name string")
    asked = {**{f"q{i}": "match" for i in range(7)}, "loose": "acegikmoqsuwyz0", "far": "acegikmoqsuwyz1", "back": "zyxwvutsrqponmlk"}
    one = spark.createDataFrame(list(asked.items()), "query_id string, text string")
    got = S.search_requests(nodes, one, 2)
    cols = ("repo_id", "query_id", "id", "score", "hit_rank")
    assert rows(got, *cols) == rows(G.search(nodes, asked, 2), *cols) and got.count() == 2 * (7 * 2 + 1)
    told = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in told and "row_number() windowspecdefinition(repo_id" not in told.split("posexplode")[0]
    both = one.union(spark.createDataFrame([("q0", long), (None, long), (None, "match3")], one.schema))
    mixed = rows(S.search_requests(nodes, both, 2), *cols)
    assert [r[2:] for r in mixed if r[:2] == (0, "q0")] == [("n0", 0.05, 1), ("n1", 0.05, 2)] and len(mixed) == 2 * (7 * 2 + 1 + 2)
    assert [r[2:] for r in mixed if r[:2] == (None, None)] == [("n0", 0.05, 2), ("n3", 0.0, 1)]
