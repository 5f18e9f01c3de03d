"""Streams over the driver's tables: each runs to its end in several micro-batches and must agree with one batch over all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.plans.cut import run_folder
from lodemap.streaming import watch as W
from workload.change_queries import DIFF
from workload.views import duck, query, view
from workload.wiki_queries import S_DEBOUNCE, S_JOURNAL, S_TOTALS


def run_stream(rows: DataFrame, folder: str, sink: Callable[[DataFrame, int], None], shape=lambda s: s, mode: str = "append", batches: int = 4) -> None:
    """Write ``rows`` as the files of a stream and run it until they are read, in about ``batches`` micro-batches."""
    spark = rows.sparkSession
    n = max(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(n, "ts").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-n // batches)).parquet(f"{folder}/in")
    run = (shape(stream).writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
           .trigger(availableNow=True).start())
    run.awaitTermination()


def q_bursts(spark: SparkSession, sf: str) -> DataFrame:
    folder = run_folder(spark)
    events = view(spark, sf, "v_fs_events").withColumn("ts", F.col("ts").cast("timestamp"))
    run_stream(events, folder, W.burst_sink(f"{folder}/store", "6 hours"), W.interesting)
    return W.read_bursts(spark, f"{folder}/store").select("repo_id", F.date_format("quiet_from", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("quiet_from"), "n_events")


def q_totals(spark: SparkSession, sf: str) -> DataFrame:
    folder = run_folder(spark)
    events = query(spark, sf, "select user_id % 20 as repo_id, event_type as category, ts from events")
    run_stream(events, folder, W.totals_sink(f"{folder}/store"), W.issue_totals, "update")
    return W.read_totals(spark, f"{folder}/store")


def q_journal(spark: SparkSession, sf: str) -> DataFrame:
    folder = run_folder(spark)
    entries = query(spark, sf, "select user_id % 20 as repo_id, 'n' || cast(user_id as string) as node_id, ts, lpad(cast(event_id as string), 9, '0') as fingerprint, event_type as summary from events")
    run_stream(entries, folder, W.journal_sink(f"{folder}/store", newest_batch=False))
    return W.read_journal(spark, f"{folder}/store", newest_batch=False).select("repo_id", "node_id", "fingerprint", "summary")


# Four looks at the repositories: first as they were, then as they are with repository 0 emptied, again, and with it refilled.
LOOKS = ["select * from v_snap_old", "select * from v_snap_new where repo_id <> 0", "select * from v_snap_new where repo_id <> 0", "select * from v_snap_new"]


def q_gate(spark: SparkSession, sf: str) -> DataFrame:
    folder = run_folder(spark)
    repos = query(spark, sf, "select repo_id from v_snap_old union select repo_id from v_snap_new")

    def current(i: int) -> Callable[[SparkSession], DataFrame]:
        return lambda s: query(s, sf, LOOKS[i]).withColumn("content_hash", F.sha2("content", 256))

    for i in range(len(LOOKS)):
        repos.write.mode("append").parquet(f"{folder}/touched")
        stream = spark.readStream.schema("repo_id long").parquet(f"{folder}/touched")
        run = (stream.writeStream.foreachBatch(W.gate_sink(current(i), f"{folder}/store")).option("checkpointLocation", f"{folder}/checkpoint")
               .trigger(availableNow=True).start())
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/store/decisions").select("repo_id", F.col("batch").cast("int").alias("look"), "rebuild")


S_GATE = duck(f"""with {DIFF}, c as (select repo_id, bool_or(state <> 'unchanged') as moved from d group by 1), l(look) as (values (0), (1), (2), (3)),
 back as (select distinct repo_id from v_snap_new)
 select c.repo_id, l.look, case look when 0 then true when 1 then moved or c.repo_id = 0 when 2 then false
  else c.repo_id = 0 and exists (select 1 from back where back.repo_id = 0) end as rebuild from c cross join l""")

QUERIES = {
    "stream_bursts": (q_bursts, S_DEBOUNCE),
    "stream_totals": (q_totals, S_TOTALS),
    "stream_journal": (q_journal, S_JOURNAL),
    "stream_gate": (q_gate, S_GATE),
}
