import random

import numpy as np
from pyspark.sql import functions as F

from lodemap.llm import toxicity as toxicity_module
from lodemap.llm.toxicity import best_threshold, calibrate, drop_toxic, fit, toxicity, trainable, words_of


def _rows(prose, n):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, 60).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["vileword", "nastything"]) + r.choice(["", "s", "ly", "est", "."]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out(spark, make, prose, odd_rows):
    rows, labels = _rows(prose, 500)
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (10**6, 1), (7, 1)], "doc_id long, toxic int")
    docs = make(rows)
    model = fit(docs, table, trainable())
    held = {r.doc_id for r in docs.filter(~trainable()).select("doc_id").collect()}
    got = {r.doc_id: r for r in toxicity(docs, model).collect() if r.doc_id in held}
    hits = [got[i].score >= 0.3 for i in held if i % 4 == 0]
    false = [got[i].score >= 0.3 for i in held if i % 4]
    assert len(held) > 50 and np.mean(hits) > 0.9 and np.mean(false) < 0.05
    # Scores depend on texts alone.
    other = {r.doc_id: r.score for r in toxicity(make(rows, lang="xx"), model).collect()}
    assert all(abs(other[i] - got[i].score) < 1e-9 for i in held)
    odd = toxicity(make(odd_rows), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id in (4, 5, 6)}) == 1 and toxicity(make([]), model).count() == 0
    kept = drop_toxic(docs, model)
    bad = {r.doc_id for r in toxicity(docs, model).filter("toxic").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - bad


def test_word_in_a_very_long_text(spark, make, prose):
    rows, labels = _rows(prose, 300)
    model = fit(make(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    long = prose(1, 60) + " " + " ".join(prose(s, 5000) for s in range(40))
    a, b = (r.score for r in toxicity(make([(1, long), (2, long + " vileword nastything vilewords")]), model).orderBy("doc_id").collect())
    assert b > 0.3 and b > a


def test_one_class_or_none(spark, make, prose):
    for labels in ([], [(1, 0)], [(1, None)]):
        model = fit(make([(1, prose(1))]), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
        assert toxicity(make([(1, prose(1))]), model).first().score < 0.01
    model = fit(make([(1, prose(1))]), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), F.lit(True))
    assert toxicity(make([(1, prose(1))]), model).first().score > 0.99


def test_calibration_and_threshold():
    rng = np.random.default_rng(0)
    p = rng.random(20000)
    y = (rng.random(20000) < p).astype(float)
    a, b = calibrate(3 * np.log(p / (1 - p)) + 1, y, np.ones(20000))
    assert abs(a - 1 / 3) < 0.02 and abs(b + 1 / 3) < 0.05
    assert best_threshold(np.array([0.1, 0.2, 0.7, 0.9]), np.array([0, 0, 1, 1]), np.ones(4)) in (0.45, 0.5)


def test_sampled_texts_are_whole(spark, make, monkeypatch):
    got = {}
    monkeypatch.setattr(toxicity_module, "train", lambda texts, labels, weights, langs: got.update(zip(labels.tolist(), texts, strict=True)))
    long = "word " * 40_000 + "vileword"
    fit(make([(1, long), (2, "plain text")]), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), F.lit(True))
    last = words_of([b"vileword"])[0][:, 0]
    assert got[1.0].shape[1] == 40_001 and (got[1.0][:, -1] == last).all() and got[0.0].shape[1] == 2


def test_tables_without_languages(spark, make, prose):
    rows, labels = _rows(prose, 200)
    model = fit(make(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    model.thresholds = {}
    docs = make([*rows, (None, None), (999, "")])
    assert sorted(map(str, drop_toxic(docs.select("doc_id", "text"), model).collect())) == sorted(map(str, drop_toxic(docs, model).select("doc_id", "text").collect()))


def test_every_labelled_row_counts(spark, make, prose):
    """The class of most rows has a kind of toxic text that the rows of the start (by hash of the id) don't have."""
    rows, labels = _rows(prose, 400)
    starts = {r.doc_id for r in spark.range(400).toDF("doc_id").filter("doc_id % 4 = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(40).collect()}
    bad = [i for i in range(0, 400, 4) if i not in starts]
    rows = [(i, prose(i, 60) + " rarevenom" if i in set(bad) else t) for i, t in rows]
    docs = make([*rows, (9001, prose(9001, 60) + " rarevenom"), (9002, prose(9001, 60))])
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True), per_class=40)
    got = {r.doc_id: r.score for r in toxicity(docs, model).collect()}
    assert got[9001] >= 0.3 > got[9002]
    assert np.mean([got[i] >= 0.3 for i in bad]) > 0.9 and np.mean([got[i] >= 0.3 for i in starts]) > 0.9
    assert np.mean([got[i] >= 0.3 for i in range(400) if i % 4]) < 0.05


def test_labelled_texts_are_shuffled_once(spark, make, prose, monkeypatch):
    rows, labels = _rows(prose, 60)
    plans = []

    def exchanges(node):
        below = node.children()
        own = node.nodeName() == "Exchange" and "text" in list(node.schema().fieldNames())
        return own + sum(exchanges(below.apply(i)) for i in range(below.size()))

    real = toxicity_module.cut

    def cut(df):
        plans.append(exchanges(df._jdf.queryExecution().executedPlan()))
        return real(df.repartition(7))

    monkeypatch.setattr(toxicity_module, "cut", cut)
    monkeypatch.setattr(toxicity_module, "TASK_ROWS", 20)
    picked = make([*rows, (999, "no label")]).select("doc_id", "lang", "text")
    marked = spark.createDataFrame(labels, "doc_id long, y int").groupBy("doc_id").agg(F.max("y").alias("y"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = toxicity_module._labelled(picked, marked, 60)
        assert plans == [1]
        # Seven partitions were dealt out: a round still has a task for every 20 rows.
        assert got.select(F.spark_partition_id()).distinct().count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert sorted((r.doc_id, r.y, r.text) for r in got.collect()) == sorted((i, y, dict(rows)[i]) for i, y in labels)
