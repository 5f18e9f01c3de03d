"""Groups of bounded size in one task each, all others by joins and rounds over the whole cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemap.plans.cut import cut

#: Rows of one group that a task may hold, some 50 MB.
TASK_ROWS = 300_000
#: Starts times edges that one task may walk.
TASK_STEPS = 50_000_000
#: Rows of small groups that go through one call of a task's function; a call costs more than the work on a small group.
PACK_ROWS = 100_000


def split_groups(sizes: DataFrame, key: str, fits: Column, rows: Column) -> tuple[DataFrame, DataFrame, bool]:
    """(keys whose group fits into a task, all other keys, whether there are others) of ``sizes`` (key and counts).

    ``_pack`` of the first ones deals the groups, of ``rows`` rows each, over calls: small ones many to a call, larger ones alone.
    """
    judged = cut(sizes.select(key, F.coalesce(fits, F.lit(False)).alias("_fits"), rows.alias("_rows")))
    total = judged.filter("_fits").agg(F.sum("_rows").alias("n")).first()["n"] or 0
    calls = max(sizes.sparkSession.sparkContext.defaultParallelism, -(-total // PACK_ROWS))
    at = F.xxhash64(key)
    pack = F.when(F.col("_rows") * 2 > PACK_ROWS, at).otherwise(F.pmod(at, F.lit(calls)))
    others = judged.filter("NOT _fits").select(key)
    return judged.filter("_fits").select(key, pack.alias("_pack")), others, not others.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs to (a, b): each end but the smallest of its component, and that smallest one.

    Large and small stars in turn: every end is linked with the smallest of its larger, then of its smaller neighbours, until
    nothing moves. A chain takes some log n rounds.
    """
    def digest(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    stars = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = digest(stars)
    while True:
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = digest(stars)
        if now == before:
            return stars
        before = now
