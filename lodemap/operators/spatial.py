"""Questions about points in the plane, all through a grid: a cell is an equality key, so no join compares all pairs.

``points(repo_id, node_id, x, y, r)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = "repo_id"
LEVEL_STEP = 3
LEVELS = 8


def _finite(df: DataFrame) -> DataFrame:
    def ok(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return df.filter(ok("x") & ok("y"))


def _cell(c: Column, size: Column | float) -> Column:
    return F.floor(c / size).cast("long")


def bounds(points: DataFrame, padding: float = 120.0) -> DataFrame:
    """Padded bounding box of the finite points of each repository."""
    box = _finite(points).groupBy(K).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    return box.select(
        K, (F.col("a") - padding).alias("min_x"), (F.col("c") - padding).alias("min_y"),
        (F.col("b") - F.col("a") + padding * 2).alias("width"), (F.col("d") - F.col("c") + padding * 2).alias("height"))


def _used_levels(requests: DataFrame) -> list[int]:
    """Grid levels some request needs: at most ``LEVELS`` small integers, so reading them on the driver is bounded."""
    return sorted(r[0] for r in requests.select("level").distinct().collect())


def _with_level(df: DataFrame, extent: Column, cell: float) -> DataFrame:
    """Coarse enough a grid that a request spans few cells, however large it is."""
    need = F.ceil(F.log2(F.greatest(extent / (cell * 8), F.lit(1.0))) / LEVEL_STEP).cast("int")
    return df.withColumn("level", F.least(F.lit(LEVELS - 1), need))


def _size(level: Column, cell: float) -> Column:
    return F.lit(float(cell)) * F.pow(F.lit(2.0), level * LEVEL_STEP)


def _on_levels(points: DataFrame, levels: list[int], cell: float) -> DataFrame:
    at = points.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]))) if levels else points.withColumn("level", F.lit(0))
    size = _size(F.col("level"), cell)
    return at.withColumn("cx", _cell(F.col("x"), size)).withColumn("cy", _cell(F.col("y"), size))


def rect_query(points: DataFrame, rects: DataFrame, cell: float = 120.0, exact: bool = True) -> DataFrame:
    """Points in each rectangle: (repo_id, rect_id, node_id). ``rects(repo_id, rect_id, x0, y0, x1, y1)``.

    ``exact=False`` returns every point of the cells a rectangle meets, a superset.
    """
    r = _with_level(rects, F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), cell)
    size = _size(F.col("level"), cell)
    cells = (
        r.withColumn("cx", F.explode(F.sequence(_cell(F.col("x0"), size), _cell(F.col("x1"), size))))
        .withColumn("cy", F.explode(F.sequence(_cell(F.col("y0"), size), _cell(F.col("y1"), size))))
    )
    hit = _on_levels(_finite(points), _used_levels(r), cell).join(cells, [K, "level", "cx", "cy"])
    if exact:
        hit = hit.filter("x >= x0 and x <= x1 and y >= y0 and y <= y1")
    return hit.select(K, "rect_id", "node_id")


def nearest(points: DataFrame, probes: DataFrame, radius: float) -> DataFrame:
    """Closest point within ``radius`` of each probe; of equally close ones the last in grid order, then by id.

    ``probes(repo_id, probe_id, px, py)`` -> (repo_id, probe_id, node_id, distance). One cell is one radius wide, so a
    probe meets nine cells.
    """
    near = F.sequence(F.lit(-1), F.lit(1))
    p = probes.withColumn("cx", _cell(F.col("px"), radius)).withColumn("cy", _cell(F.col("py"), radius))
    asked = (
        p.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
        .select(K, "probe_id", "px", "py", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    )
    held = _finite(points).select(K, "node_id", "x", "y", _cell(F.col("x"), radius).alias("cx"), _cell(F.col("y"), radius).alias("cy"))
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    best = F.max(F.struct((-d2).alias("d"), F.col("cy"), F.col("cx"), F.col("node_id")))
    return (
        asked.join(held, [K, "cx", "cy"]).filter(d2 <= radius * radius)
        .groupBy(K, "probe_id").agg(best.alias("b"))
        .select(K, "probe_id", F.col("b.node_id").alias("node_id"), F.sqrt(-F.col("b.d")).alias("distance"))
    )


def close_pairs(points: DataFrame, cell: float = 120.0, factor: float = 1.4) -> DataFrame:
    """Number of pairs in one cell that are closer than ``factor`` times the sum of their radii: (repo_id, pairs).

    Points on the same spot are counted by arithmetic, not paired up. Distinct spots meet only within the reach of the
    largest radius, on a finer grid inside the cell, so a crowded cell is not compared all against all.
    """
    spots = (
        _finite(points).groupBy(K, "x", "y", "r").agg(F.count("*").alias("m"))
        .withColumn("cx", _cell(F.col("x"), cell)).withColumn("cy", _cell(F.col("y"), cell))
    )
    # One number: the largest radius fixes the width of the fine grid.
    largest = spots.agg(F.max("r")).first()[0] or 0.0
    fine = min(float(cell), max(2 * factor * largest, 1e-9))
    same = spots.filter(2 * factor * F.col("r") > 0).groupBy(K).agg(
        F.sum((F.col("m") * (F.col("m") - 1) / 2).cast("long")).alias("pairs"))
    s = spots.withColumn("fx", _cell(F.col("x"), fine)).withColumn("fy", _cell(F.col("y"), fine))
    order = F.struct("x", "y", "r")
    # Each unordered pair is met once: from the spot of the lower (x, y, r).
    a = s.select(K, "cx", "cy", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("r").alias("ar"), F.col("m").alias("am"),
                 F.explode(F.array(*[F.struct((F.col("fx") + i).alias("fx"), (F.col("fy") + j).alias("fy")) for i in (0, 1) for j in (-1, 0, 1)])).alias("f"))
    a = a.select(K, "cx", "cy", "ax", "ay", "ar", "am", "f.fx", "f.fy")
    dist = F.sqrt((F.col("x") - F.col("ax")) ** 2 + (F.col("y") - F.col("ay")) ** 2)
    apart = (
        a.join(s, [K, "cx", "cy", "fx", "fy"]).filter(order > F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("ar").alias("r")))
        .filter(dist < (F.col("r") + F.col("ar")) * factor)
        .groupBy(K).agg(F.sum(F.col("m") * F.col("am")).alias("pairs"))
    )
    return same.unionByName(apart).groupBy(K).agg(F.sum("pairs").alias("pairs"))
