"""A keyed table that a stream keeps: batches append their changes, a base is written now and then, a retried batch changes nothing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GONE = "_gone"


class KeyedStore:
    """The current row of each key, below ``path`` (a folder that all executors share).

    ``changes/batch=n`` holds what batch n set or, with ``_gone``, took away; ``bases/batch=n`` the whole table after it;
    ``log/batch=n`` the base from which a reader starts, written last: a batch without it never happened. A batch costs
    its own rows and, every ``every`` batches, one merge of the base with the changes since. Of several rows of one key the
    later batch wins, within a batch the largest ``order``, then the largest row; with ``newest_batch`` False the order goes
    first, so that rows may arrive in any sequence. Order columns that the rows lack are left out. Null keys are keys like
    others; maps can't be stored, as they have no order.
    """

    def __init__(self, path: str, keys: list[str], order: list[str] | None = None, newest_batch: bool = True, every: int = 16) -> None:
        self.path, self.keys, self.every = path, keys, every
        self.rank = ["batch", *(order or [])] if newest_batch else [*(order or []), "batch"]

    def _stand(self, spark: SparkSession, before: int | None) -> tuple[int, int] | None:
        """(last batch, its base) of the log; a base of -1 means none yet."""
        try:
            log = spark.read.schema("base long, batch long").parquet(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        if before is not None:
            log = log.filter(F.col("batch") < before)
        last = log.agg(F.max(F.struct("batch", "base")).alias("last")).first()["last"]
        return (last["batch"], last["base"]) if last else None

    def _merged(self, spark: SparkSession, last: int, base: int) -> DataFrame:
        rows = spark.read.parquet(f"{self.path}/changes").withColumn("batch", F.col("batch").cast("long")).filter(F.col("batch").between(base + 1, last))
        if base >= 0:
            kept = spark.read.parquet(f"{self.path}/bases/batch={base}")
            rows = rows.unionByName(kept.withColumn(GONE, F.lit(False)).withColumn("batch", F.lit(base).cast("long")))
        rank = [c for c in self.rank if c in rows.columns]
        values = [c for c in rows.columns if c not in (*self.keys, *rank)]
        top = rows.groupBy(*self.keys).agg(F.max(F.struct(*rank, *values)).alias("_top"))
        cols = [c for c in rows.columns if c not in (GONE, "batch")]
        return top.filter(~F.col("_top")[GONE]).select(*[F.col(c) if c in self.keys else F.col("_top")[c].alias(c) for c in cols])

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The table, or as it was before a batch; None if there was no batch."""
        stand = self._stand(spark, before)
        return self._merged(spark, *stand) if stand else None

    def put(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Set rows (or with ``_gone`` true take them away) as batch ``batch_id``; returns them as written."""
        spark = rows.sparkSession
        stand = self._stand(spark, batch_id)
        base = stand[1] if stand else -1
        if GONE not in rows.columns:
            rows = rows.withColumn(GONE, F.lit(False))
        rows.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch_id}")
        if batch_id - base >= self.every:
            self._merged(spark, batch_id, base).write.mode("overwrite").parquet(f"{self.path}/bases/batch={batch_id}")
            base = batch_id
        spark.range(1).select(F.lit(base).cast("long").alias("base")).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch_id}")
        return spark.read.parquet(f"{self.path}/changes/batch={batch_id}")
