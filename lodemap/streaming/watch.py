"""File events as streams: filter, wait for quiet, rebuild only what moved, keep totals and journals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.functions import dims
from lodemap.functions.text import basename, col, file_extension
from lodemap.operators.changes import snapshot_diff
from lodemap.plans.cut import cut, first_rows, islands
from lodemap.streaming.keyed import GONE, KeyedStore

K = "repo_id"
NO_REPO = -(2**63)  # stands for events without a repository where bursts are stored

# --- fixed values: folders and files whose changes mean nothing, the quiet period ------------
IGNORED_COMPONENTS = [
    *dims.OUTPUT_DIRECTORIES, ".git", ".svn", ".hg", "node_modules", ".next", "dist", "build", "target", "__pycache__",
    ".build", ".swiftpm", "DerivedData", ".venv", "venv",
]
SCRATCH_EXTENSIONS = [".swp", ".tmp", ".lock"]
QUIET = "1500 milliseconds"


def is_interesting(path: Column | str) -> Column:
    p = F.regexp_replace(col(path), "/+$", "")
    base = basename(p)
    return (
        (base != "") & ~F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(c) for c in IGNORED_COMPONENTS]))
        & ~base.startswith(".") & ~base.endswith("~") & ~F.coalesce(file_extension(p), F.lit("")).isin(SCRATCH_EXTENSIONS)
    )


def interesting(events: DataFrame) -> DataFrame:
    """Stateless filter, for batch and stream alike."""
    return events.filter(is_interesting("path"))


def debounce(events: DataFrame, gap: str = QUIET, watermark: str = "10 minutes") -> DataFrame:
    """One row per burst of a repository's events once it has been quiet for ``gap``.

    ``ts`` must be TIMESTAMP. In a stream (append mode) a burst comes out when the watermark passes its end; events
    later than the watermark are dropped. State is one open session per active repository.
    """
    e = events.withWatermark("ts", watermark) if events.isStreaming else events
    return (
        e.groupBy(F.session_window("ts", gap).alias("s"), K).agg(F.count("*").alias("n_events"))
        .select(K, F.col("s.start").alias("quiet_from"), F.col("s.end").alias("quiet_at"), "n_events")
    )


def rebuild_gate(batch: DataFrame, baseline: DataFrame, current: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Repositories of ``batch`` that need a rebuild: (repo_id, rebuild).

    ``baseline`` and ``current`` hold (repo_id, path, content_hash); a row without a path tells of a repository that has no
    files. Without a baseline a rebuild is due; else only structural, added or deleted files count.
    """
    repos = batch.select(K).distinct()
    old, new = baseline.join(repos, K, "left_semi"), current.join(repos, K, "left_semi").filter("path IS NOT NULL")
    diff = snapshot_diff(old.filter("path IS NOT NULL"), new, classes)
    moved = diff.filter(F.col("state").isin("structural", "added", "deleted")).select(K).distinct()
    return (
        repos.join(old.select(K).distinct().withColumn("_base", F.lit(True)), K, "left")
        .join(moved.withColumn("_moved", F.lit(True)), K, "left")
        .select(K, (F.col("_base").isNull() | F.coalesce("_moved", F.lit(False))).alias("rebuild"))
    )


def burst_store(store: str) -> KeyedStore:
    return KeyedStore(f"{store}/bursts", [K, "quiet_from"])


def burst_sink(store: str, gap: str = QUIET) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: :func:`debounce` kept up by batches of events, with no watermark and no event too late.

    A batch becomes bursts; stored bursts of its repositories that don't end before its first one join them, and what
    overlaps or touches is one burst. So the stored bursts are those of one batch run over all events so far, in whatever
    sequence they came. A burst is over when a reader's clock has passed ``quiet_at``. Rows without a time are no events;
    rows without a repository share one.
    """
    kept = burst_store(store)

    def run(batch: DataFrame, batch_id: int) -> None:
        new = debounce(batch.filter("ts IS NOT NULL").select(F.coalesce(F.col(K), F.lit(NO_REPO)).alias(K), "ts"), gap)
        old = kept.read(batch.sparkSession, batch_id)
        if old is None:
            kept.put(new, batch_id)
            return
        new = cut(new)
        since = new.groupBy(K).agg(F.min("quiet_from").alias("_since"))
        near = cut(old.join(since, K).filter(F.col("quiet_at") >= F.col("_since")).drop("_since"))
        merged = (
            islands(near.unionByName(new), [K], "quiet_from", "quiet_at", "_island").groupBy(K, "_island")
            .agg(F.max("quiet_at").alias("quiet_at"), F.sum("n_events").alias("n_events"))
            .select(K, F.col("_island").alias("quiet_from"), "quiet_at", "n_events", F.lit(False).alias(GONE))
        )
        swallowed = near.join(merged.select(K, "quiet_from"), [K, "quiet_from"], "left_anti").withColumn(GONE, F.lit(True))
        kept.put(merged.unionByName(swallowed), batch_id)

    return run


def read_bursts(spark: SparkSession, store: str, now: Column | None = None) -> DataFrame | None:
    """Stored bursts; with ``now`` only those that were over by then. None before the first batch."""
    bursts = burst_store(store).read(spark)
    if bursts is None:
        return None
    bursts = bursts.withColumn(K, F.when(F.col(K) != NO_REPO, F.col(K)))
    return bursts if now is None else bursts.filter(F.col("quiet_at") <= now)


def fingerprint_store(store: str) -> KeyedStore:
    return KeyedStore(f"{store}/fingerprints", [K, "path"])


def gate_sink(current: Callable[[SparkSession], DataFrame], store: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: decide per repository and record the decision with what changed in its fingerprints.

    Only files that are new, changed or gone are written, those gone as tombstones; a repository without files keeps one row
    without a path, so that it is known as empty. The decision is read from the written changes, so both always agree, and
    a batch that runs twice leaves one result.
    """
    kept = fingerprint_store(store)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        repos = batch.select(K).filter(F.col(K).isNotNull()).distinct()
        now = repos.join(current(spark).select(K, "path", "content_hash"), K, "left")
        old = kept.read(spark, batch_id)
        old = now.limit(0) if old is None else old.join(repos, K, "left_semi")
        sides = old.withColumn("_new", F.lit(False)).unionByName(now.withColumn("_new", F.lit(True)))
        was, is_now = F.max(F.when(~F.col("_new"), F.col("content_hash"))), F.max(F.when(F.col("_new"), F.col("content_hash")))
        moved = (
            sides.groupBy(K, "path").agg(was.alias("_was"), is_now.alias("content_hash"), (~F.bool_or("_new")).alias(GONE), F.bool_and("_new").alias("_added"))
            .filter(F.col(GONE) | F.col("_added") | ~F.col("_was").eqNullSafe(F.col("content_hash"))).select(K, "path", "content_hash", GONE)
        )
        moved = kept.put(moved, batch_id).select(K).distinct().withColumn("rebuild", F.lit(True))
        decisions = repos.join(moved, K, "left").select(K, F.coalesce("rebuild", F.lit(False)).alias("rebuild"))
        decisions.write.mode("overwrite").parquet(f"{store}/decisions/batch={batch_id}")

    return run


def latest_fingerprints(spark: SparkSession, store: str, before: int | None = None) -> DataFrame | None:
    """Fingerprints of each repository as last seen, optionally before one batch; without a path where it had no files. None
    if there is no store yet."""
    return fingerprint_store(store).read(spark, before)


def issue_totals(issues: DataFrame) -> DataFrame:
    """Running totals per category; use output mode ``update`` on a stream."""
    return issues.groupBy(K, "category").agg(F.count("*").alias("n"))


def totals_sink(store: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for :func:`issue_totals` in output mode ``update``: the totals that moved replace the old ones."""
    def run(batch: DataFrame, batch_id: int) -> None:
        KeyedStore(f"{store}/totals", [K, "category"]).put(batch, batch_id)

    return run


def read_totals(spark: SparkSession, store: str) -> DataFrame | None:
    return KeyedStore(f"{store}/totals", [K, "category"]).read(spark)


def journal_sink(path: str, order: str = "ts", newest_batch: bool = True) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that appends descriptions; :func:`read_journal` keeps the latest per node.

    A batch writes its own rows; every 16 batches the latest rows so far are written together, so that readers don't go
    through the whole past. ``order`` and ``newest_batch`` are those of the reader.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        KeyedStore(path, [K, "node_id"], [order], newest_batch).put(batch, batch_id)

    return run


def read_journal(spark: SparkSession, path: str, order: str = "ts", newest_batch: bool = True) -> DataFrame | None:
    """Latest entry per (repo_id, node_id) by batch, then by ``order`` within it if there is such a column; without
    ``newest_batch`` the order goes first, for entries that come late. None before the first batch."""
    return KeyedStore(path, [K, "node_id"], [order], newest_batch).read(spark)


def journal_latest(entries: DataFrame) -> DataFrame:
    """Batch form of the upsert: the newest entry per node of a table with ``ts``."""
    return first_rows(entries, [K, "node_id"], [F.desc("ts"), F.desc("fingerprint")])
