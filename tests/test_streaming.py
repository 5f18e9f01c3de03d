"""Streams give what the same jobs give in batch."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemap.plans.cut import islands
from lodemap.streaming import watch as W
from lodemap.streaming.keyed import KeyedStore


def test_interesting_paths(spark, rows):
    cases = {"src/a.ts": True, ".ua/x.json": False, "a/node_modules/b.js": False, "a/.hidden": False, "a/b.swp": False, "a/b.tmp": False, "x~": False, "build/x": False, "b/x.lock": False, "": False}
    df = spark.createDataFrame([(p,) for p in cases], "path string").withColumn("ok", W.is_interesting("path"))
    assert dict(rows(df, "path", "ok")) == cases


def _events(spark, folder):
    base = [(r, "src/a.ts", t) for r, ts in {1: [0, 1, 2, 10], 2: [0, 5], 3: [500]}.items() for t in ts]
    df = spark.createDataFrame(base, "repo_id long, path string, s long").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).drop("s")
    df.coalesce(1).write.parquet(folder)
    return df


def test_debounce_in_stream_and_batch(spark, rows, tmp_path):
    events = _events(spark, str(tmp_path / "in"))
    batch = W.debounce(W.interesting(events))
    stream = W.debounce(W.interesting(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))), watermark="5 seconds")
    q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    done = rows(spark.read.parquet(str(tmp_path / "out")), "repo_id", "n_events")
    # The newest burst waits for the watermark.
    assert done == rows(batch.filter("repo_id < 3"), "repo_id", "n_events") == [(1, 1), (1, 3), (2, 1), (2, 1)]


def test_gate_sink_is_idempotent(spark, rows, tmp_path):
    store = str(tmp_path / "store")
    state = {"v": "h1"}

    def current(s):
        return s.createDataFrame([(1, "src/a.ts", state["v"]), (2, "b.ts", "same")], "repo_id long, path string, content_hash string")

    run = W.gate_sink(current, store)
    both = spark.createDataFrame([(1,), (2,)], "repo_id long")
    run(both, 0)
    run(both, 0)
    state["v"] = "h2"
    run(both, 1)
    decisions = spark.read.parquet(f"{store}/decisions")
    assert rows(decisions, "batch", "repo_id", "rebuild") == [(0, 1, True), (0, 2, True), (1, 1, True), (1, 2, False)]
    assert rows(W.latest_fingerprints(spark, store), "repo_id", "content_hash") == [(1, "h2"), (2, "same")]


def test_emptied_repository_settles(spark, rows, tmp_path):
    store = str(tmp_path / "store")
    files = {"now": [(1, "a.ts", "h"), (2, "b.ts", "h")]}
    run = W.gate_sink(lambda s: s.createDataFrame(files["now"], "repo_id long, path string, content_hash string"), store)
    both = spark.createDataFrame([(1,), (2,)], "repo_id long")
    run(both, 0)
    files["now"] = [(2, "b.ts", "h")]
    run(both, 1)
    run(both, 2)
    files["now"] = [(1, "a.ts", "h"), (2, "b.ts", "h")]
    run(both, 3)
    run(both, 3)
    decisions = spark.read.parquet(f"{store}/decisions").filter("repo_id = 1")
    assert rows(decisions, "batch", "rebuild") == [(0, True), (1, True), (2, False), (3, True)]


def test_journal_keeps_latest(spark, rows, tmp_path):
    sink = W.journal_sink(str(tmp_path / "j"))
    sink(spark.createDataFrame([(1, "a", "old"), (1, "b", "b")], "repo_id long, node_id string, summary string"), 0)
    sink(spark.createDataFrame([(1, "a", "new")], "repo_id long, node_id string, summary string"), 1)
    assert rows(W.read_journal(spark, str(tmp_path / "j")), "node_id", "summary") == [("a", "new"), ("b", "b")]


def test_issue_totals_update(spark, rows, tmp_path):
    spark.createDataFrame([(1, "alias"), (1, "alias"), (2, "x")], "repo_id long, category string").write.parquet(str(tmp_path / "in"))
    stream = W.issue_totals(spark.readStream.schema("repo_id long, category string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("totals").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("totals"), "repo_id", "category", "n") == [(1, "alias", 2), (2, "x", 1)]


def _bursts(df, rows):
    return rows(df, "repo_id", "quiet_from", "quiet_at", "n_events")


@pytest.mark.parametrize("every", [2])
def test_bursts_of_batches_are_those_of_one_batch(spark, rows, tmp_path, monkeypatch, every):
    """Late events bridge, extend and start bursts; a batch that runs twice counts once; touching bursts are one."""
    store = str(tmp_path / "s")
    monkeypatch.setattr(W, "burst_store", lambda s: W.KeyedStore(f"{s}/bursts", ["repo_id", "quiet_from"], every=every))
    batches = [[(1, 0), (1, 10), (2, 5), (None, 3)], [(1, 4), (1, 7), (3, 1)], [], [(1, 100), (2, 0), (None, 4), (1, None)], [(1, 13), (2, 2), (2, 2)], [(1, -50)]]
    assert W.read_bursts(spark, store) is None
    run = W.burst_sink(store, "3 seconds")
    seen = []
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "repo_id long, s long").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).drop("s")
        run(df, i)
        if i % 2:
            run(df, i)
        seen.append(df)
        whole = W.debounce(reduce(DataFrame.union, seen).filter("ts is not null"), "3 seconds")
        assert _bursts(W.read_bursts(spark, store), rows) == _bursts(whole, rows)
    over = W.read_bursts(spark, store, F.timestamp_seconds(F.lit(1_700_000_050)))
    assert 100 not in [r[1].timestamp() - 1_700_000_000 for r in _bursts(over, rows)] and over.count() == W.read_bursts(spark, store).count() - 1


def test_bursts_of_one_busy_repository(spark, rows, tmp_path):
    """One repository's bursts lie in many pieces; islands that cross several pieces hold together."""
    df = spark.range(4000).select(F.lit(1).cast("long").alias("repo_id"), F.col("id").alias("a"),
                                  F.when(F.col("id") == 500, 2500).when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.col("id") + 1).alias("b"))
    got = islands(df.repartition(8), ["repo_id"], "a", "b", "head").select("a", "b", "head").collect()
    want, head, far = {}, None, None
    for a, b in sorted((r.a, r.b) for r in got):
        if far is None or far < a:
            head, far = a, b
        far = max(far, b)
        want[a] = head
    assert {r.a: r.head for r in got} == want and len(got) == 4000


@pytest.mark.parametrize("every", [1, 3])
def test_store_keeps_one_row_per_key(spark, rows, tmp_path, every):
    schema = "k string, v long, _gone boolean"
    store = KeyedStore(str(tmp_path / "t"), ["k"], every=every)
    assert store.read(spark) is None
    batches = [[("a", 1, False), ("b", 1, False), (None, 1, False)], [("a", 2, False), ("b", None, True)], [], [("b", 3, False), ("b", 2, False)], [("a", None, True)]]
    want = [[("None", 1), ("a", 1), ("b", 1)], [("None", 1), ("a", 2)], [("None", 1), ("a", 2)], [("None", 1), ("a", 2), ("b", 3)], [("None", 1), ("b", 3)]]
    for i, batch in enumerate(batches):
        for _ in range(2):
            store.put(spark.createDataFrame(batch, schema), i)
            assert sorted((str(r.k), r.v) for r in store.read(spark).collect()) == want[i]
    assert sorted((str(r.k), r.v) for r in store.read(spark, 2).collect()) == want[1]


def test_batch_without_log_never_happened(spark, rows, tmp_path):
    store = KeyedStore(str(tmp_path / "t"), ["k"])
    store.put(spark.createDataFrame([("a", 1)], "k string, v long"), 0)
    spark.createDataFrame([("a", 9, False)], "k string, v long, _gone boolean").write.parquet(str(tmp_path / "t/changes/batch=1"))
    assert rows(store.read(spark), "k", "v") == [("a", 1)]
    store.put(spark.createDataFrame([("b", 2)], "k string, v long"), 1)
    assert rows(store.read(spark), "k", "v") == [("a", 1), ("b", 2)]


def test_gate_writes_only_what_changed(spark, rows, tmp_path):
    store = str(tmp_path / "s")
    files = {"now": [(1, f"f{i}", "h") for i in range(50)]}
    run = W.gate_sink(lambda s: s.createDataFrame(files["now"], "repo_id long, path string, content_hash string"), store)
    one = spark.createDataFrame([(1,), (None,)], "repo_id long")
    run(one, 0)
    files["now"] = files["now"][1:-1] + [(1, "f49", "other"), (1, "new", "h")]
    run(one, 1)
    run(one, 2)
    changes = spark.read.parquet(f"{store}/fingerprints/changes").filter("batch > 0")
    assert rows(changes, "batch", "path", "_gone") == [(1, "f0", True), (1, "f49", False), (1, "new", False)]
    assert rows(spark.read.parquet(f"{store}/decisions"), "batch", "rebuild") == [(0, True), (1, True), (2, False)]
    assert rows(W.latest_fingerprints(spark, store), "path", "content_hash") == sorted((p, h) for _, p, h in files["now"])


def test_late_journal_entries(spark, rows, tmp_path):
    entry = "repo_id long, node_id string, ts long, summary string"
    for newest, want in ((True, "old"), (False, "new")):
        path = str(tmp_path / f"j{newest}")
        sink = W.journal_sink(path, newest_batch=newest)
        sink(spark.createDataFrame([(1, "a", 5, "new")], entry), 0)
        sink(spark.createDataFrame([(1, "a", 2, "old"), (1, "a", 1, "older")], entry), 1)
        assert rows(W.read_journal(spark, path, newest_batch=newest), "summary") == [(want,)]
