import random
from itertools import permutations

import numpy as np

from lodemap.llm.filter_audit import audit, grouped_popcounts, positional_popcount


def own(text):
    text = text or ""
    words = text.encode().split()
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
        out.add("C")
    if any(c in "#$%&*|" for c in text):
        out.add("D")
    return out


def brute(docs, labels):
    judged = []
    for i, text, part in docs:
        failed = own(text)
        if i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs):
            failed.add("E")
        good = i is not None and any(j == i and q == 1 for j, q, _ in labels)
        toxic = i is not None and any(j == i and t == 1 for j, _, t in labels)
        judged.append((part or "", failed, good, toxic))
    out = {}
    for part in {p for p, *_ in judged}:
        shapley = dict.fromkeys("ABCDE", 0)
        rows = {}
        for order in permutations("ABCDE"):
            left = [x for x in judged if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                fails = sum(x[0] == part and f in x[1] for x in judged)
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                unique = sum(x[0] == part and x[1] == {f} for x in judged)
                rows["".join(order), step] = [len(left), len(gone), fails - len(gone), unique, sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (order, step), values in rows.items():
            out[part, order, step] = (*values, shapley[order[step - 1]])
    return out


def test_popcounts():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 7, 100, 1001):
        words = r.integers(0, 1 << 32, n, dtype=np.uint32)
        assert positional_popcount(words).tolist() == [int(((words >> i) & 1).sum()) for i in range(32)]
    words, groups = r.integers(0, 1 << 32, 5000, dtype=np.uint32), r.choice([3, 5, 9, 11], 5000, p=[0.9, 0.09, 0.005, 0.005])
    found, counts = grouped_popcounts(groups, words)
    for g, c in zip(found, counts, strict=True):
        assert c.tolist() == [int(((words[groups == g] >> i) & 1).sum()) for i in range(32)]


def test_against_brute_force(spark, prose):
    r = random.Random(4)
    kinds = [lambda s: prose(s, 260, 4000), lambda s: prose(s, 260, 20), lambda s: prose(s, 30), lambda s: prose(s, 260, 4000) + " A# " + "BIG " * 60, lambda s: None, lambda s: "", lambda s: " \n\x1c\t"]
    docs = [(r.choice([None, *range(25)]) if k % 9 == 0 else k, kinds[k % 7](r.randrange(6)), r.choice(["x", "y", "", None])) for k in range(90)]
    docs += [docs[5], docs[5], (500, "one", "z"), (501, "w " * 30_000, "z")]
    labels = [(k, r.randrange(2), r.randrange(2)) for k in range(0, 90, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (7777, 1, 1)]
    table = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id long, text string, source string, part string, failed int").repartition(5)
    got = audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = got.collect()
    assert {(x[0], x[1], x[2]): tuple(x[3:]) for x in rows} == brute(docs, labels)
    assert len(rows) == 4 * 600


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr("lodemap.llm.filter_audit._HELD", 7)
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('t', id % 50) AS text", "concat('p', id % 40) AS source")
    rows = audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).filter("filter_order = 'EABCD'").collect()
    assert len(rows) == 200 and sum(x.removed for x in rows if x.step == 1) == 250 and sum(x.removed for x in rows if x.step == 2) == 50


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
