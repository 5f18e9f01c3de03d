"""Cutting lineage and ranking without one huge group."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session names a folder that all executors share in ``spark.checkpoint.dir``. Local sessions may leave it unset:
    theirs is below the warehouse."""
    if spark.sparkContext.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    spark.sparkContext.setCheckpointDir(shared)


def run_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, for tables of one run."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    frozen = df.checkpoint(eager=True)
    # Fresh columns: a later join with what ``df`` was made from must not mistake them for its own.
    return frozen.select(*[F.col(f"`{c}`").alias(c) for c in frozen.columns])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as a shuffle has. For rows that cost time and not bytes: a small file of many
    rows is one task, and AQE would put small shuffles together again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def number_rows(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """1-based position of each row inside its ``keys`` group, for groups of any size.

    A plain ``row_number`` sorts a whole group in one task. Here rows are range-partitioned by (keys, order) and
    frozen, each (group, partition) piece is numbered on its own, and pieces are shifted by the sizes of the pieces
    before them. ``order`` must be total inside a group.
    """
    exprs = [F.col(o) if isinstance(o, str) else o for o in order]
    laid = cut(df.repartitionByRange(*[F.col(k) for k in keys], *exprs).withColumn("_piece", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        laid.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
        .select(*keys, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    inside = Window.partitionBy(*keys, "_piece").orderBy(*exprs)
    # One size row per (group, partition): a bounded side, left to AQE to broadcast.
    return (
        laid.withColumn("_rn", F.row_number().over(inside))
        .join(sizes, [*keys, "_piece"])
        .withColumn(name, (F.col("_rn") + F.col("_shift")).cast("long"))
        .drop("_rn", "_shift", "_piece")
    )


def first_rows(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows per group; Spark keeps only ``n`` per group and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def islands(df: DataFrame, keys: list[str], start: str, end: str, name: str) -> DataFrame:
    """``df`` with the first ``start`` of its island: intervals of a group that overlap or touch, directly or by others.

    As in :func:`number_rows` a group of any size is cut into pieces by range, each piece is swept on its own and takes
    over what the pieces before it left: the furthest end and the last island's start.
    """
    laid = cut(df.repartitionByRange(*[F.col(k) for k in keys], F.col(start), F.col(end)).withColumn("_piece", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_piece").orderBy(start, end)
    ends = laid.groupBy(*keys, "_piece").agg(F.max(end).alias("_m")).select(*keys, "_piece", F.max("_m").over(before).alias("_far"))
    reach = F.greatest(F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)), "_far")
    heads = (
        laid.join(ends, [*keys, "_piece"]).withColumn("_reach", reach)
        .withColumn("_head", F.when(F.col("_reach").isNull() | (F.col("_reach") < F.col(start)), F.col(start)))
    )
    starts = heads.groupBy(*keys, "_piece").agg(F.max("_head").alias("_h")).select(*keys, "_piece", F.max("_h").over(before).alias("_open"))
    return (
        heads.join(starts, [*keys, "_piece"])
        .withColumn(name, F.coalesce(F.max("_head").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_open"))
        .drop("_piece", "_far", "_reach", "_head", "_open")
    )


def cap_rows(df: DataFrame, keys: list[str], order: list, n: int) -> tuple[DataFrame, DataFrame]:
    """(rows kept, groups cut): the first ``n`` rows of every group; only groups over ``n`` are ranked at all."""
    over = df.groupBy(*keys).agg(F.count("*").alias("total")).filter(F.col("total") > n)
    big = df.join(over.select(*keys), keys, "left_semi")
    kept = number_rows(big, keys, order, "_pos").filter(F.col("_pos") <= n).drop("_pos")
    return df.join(over.select(*keys), keys, "left_anti").unionByName(kept), over
