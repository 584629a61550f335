"""Distance and containment joins on plane coordinates (columns x_m, y_m), as equi-joins on grid cells.

The plan never pairs all rows: features are put in the nine cells around their own (or the cells that their extent
touches), so that each pair within the cell size meets in one cell, and the exact test follows. Crowded cells are plain
join keys, which adaptive execution splits.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnpath.operators.graph import forget, settled
from cairnpath.operators.nearest import lines_of, nearest_dots, nearest_line, nearest_ways, projection  # noqa: F401

#: Segments that are expected near a point in its first ring, and the distance that ranks by rounded distance don't tell apart.
FEW, TIE_M = 6, 2e-6


def cell(c: str | Column, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(float(size))).cast("long")


def around(lo: Column, hi: Column, size: float) -> Column:
    """The cells from one coordinate to another."""
    return F.explode(F.sequence(F.floor(lo / F.lit(float(size))).cast("long"), F.floor(hi / F.lit(float(size))).cast("long")))


def within(points: DataFrame, features: DataFrame, metres: float) -> DataFrame:
    """Radius join, inclusive: the columns of both (features' coordinates as fx, fy) and distance_m."""
    spread = features.withColumnsRenamed({"x_m": "fx", "y_m": "fy"})
    spread = spread.withColumn("cell_x", around(F.col("fx") - metres, F.col("fx") + metres, metres)).withColumn("cell_y", around(F.col("fy") - metres, F.col("fy") + metres, metres))
    placed = points.withColumn("cell_x", cell("x_m", metres)).withColumn("cell_y", cell("y_m", metres))
    dx, dy = F.col("x_m") - F.col("fx"), F.col("y_m") - F.col("fy")
    met = placed.join(spread, ["cell_x", "cell_y"]).withColumn("distance_m", F.sqrt(dx * dx + dy * dy))
    return met.filter(F.col("distance_m") <= metres).drop("cell_x", "cell_y")


def nearest_k(points: DataFrame, features: DataFrame, key: str, feature_key: str, k: int, metres: float | None = None, by: list[str] | None = None) -> DataFrame:
    """The k nearest features of each point, up to a distance if one is given, for each value of by; ties by feature_key. rank is from 1."""
    kinds = features.select(*by).distinct().collect() if by else []  # a few kinds
    one = lambda kind: reduce(lambda df, b: df.filter(F.col(b).eqNullSafe(F.lit(kind[b]))), by, features)
    return reduce(DataFrame.unionByName, [nearest_dots(points, f, key, feature_key, k, metres) for f in ([one(kind) for kind in kinds] or [features])])


def near_segments(points: DataFrame, segments: DataFrame, metres: float, size: float | None = None) -> DataFrame:
    """Points with the segments (ax, ay, bx, by) within a distance: t along the segment and distance_m.

    Cells are twice the distance wide, or of a size. A segment is put in the columns of cells that it comes near, and in each
    of these in the cells of the heights that it has there: about two for each cell of its length, whichever way it runs.
    """
    size = size or 2.0 * metres
    placed = points.withColumn("cell_x", cell("x_m", size)).withColumn("cell_y", cell("y_m", size))
    t, d = projection(*(F.col(k) for k in ("x_m", "y_m", "ax", "ay", "bx", "by")))
    met = placed.join(segment_cells(segments, metres, size), ["cell_x", "cell_y"])
    return met.withColumn("t", t).withColumn("distance_m", d).filter(F.col("distance_m") <= metres).drop("cell_x", "cell_y")


def segment_cells(segments: DataFrame, metres: float, size: float | None = None) -> DataFrame:
    """segments in each cell (cell_x, cell_y; twice metres wide, or of a size) that has places within metres of them."""
    size, c = size or 2.0 * metres, F.col
    left, right = F.least("ax", "bx"), F.greatest("ax", "bx")
    columns = segments.withColumn("cell_x", around(left - metres, right + metres, size))
    slope = (c("by") - c("ay")) / F.when(c("bx") == c("ax"), F.lit(1.0)).otherwise(c("bx") - c("ax"))
    # The nearest place on the segment is at most metres to the left or right of a point in the column.
    height = lambda x: c("ay") + (F.least(F.greatest(x, left), right) - c("ax")) * slope
    one, other = height(c("cell_x") * size - metres), height((c("cell_x") + 1) * size + metres)
    upright = c("ax") == c("bx")
    low = F.when(upright, F.least("ay", "by")).otherwise(F.least(one, other)) - metres - 1e-6
    high = F.when(upright, F.greatest("ay", "by")).otherwise(F.greatest(one, other)) + metres + 1e-6
    return columns.withColumn("cell_y", around(low, high, size))


def _segment_radius(n: int, length: float, area: float, metres: float) -> float:
    """The distance within which FEW of n segments of a length together, spread over an area, are expected."""
    if not n:
        return metres
    circles, strips = math.pi * n, 2.0 * length
    r = (math.sqrt(strips * strips + 4 * circles * FEW * area) - strips) / (2 * circles)
    return min(metres, max(r, TIE_M * 10))


def nearest_segment(points: DataFrame, segments: DataFrame, key: list[str], metres: float, *found: Column, apart: Column | tuple[str, str] | None = None) -> DataFrame:
    """For each point with a segment within metres, the aggregates found over its segments that are near enough to hold the nearest.

    found may ask for what the nearest segments decide alone: least distances, and the first by distance. segments may be
    lines (xs, ys). apart, if given, says which pairs count: a column of key and one of segments that must differ, or any condition.

    They are sought by tiles, but with a condition of any kind in rings. These begin where a few segments are expected and grow eightfold; only points without one go on. So few pairs are made
    however densely ways lie. Cells hold about a hundred points, which balances the pairs met with the cells of a segment.
    """
    if not isinstance(apart, Column):
        return nearest_line(points, segments, key, metres, *found, apart=apart)
    kept, step = settled(segments), F.col("length_m") if "length_m" in segments.columns else F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    ends = {f"{n}_{c}": f(g(f"a{c}", f"b{c}")) for c in "xy" for n, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest))}
    s = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(step).alias("length"), *(e.alias(n) for n, e in ends.items())).first()
    n, length = s["n"], s["length"] or 0.0
    across = max(s["hi_x"] - s["lo_x"], s["hi_y"] - s["lo_y"], 1.0) if n else 1.0
    area = max(1.0, (s["hi_x"] - s["lo_x"]) * (s["hi_y"] - s["lo_y"])) if n else 1.0
    radius = _segment_radius(n, length, area, metres)
    left, done = settled(points), []
    while True:
        count = max(1, left.count())
        size = max(2.0 * radius, min(10.0 * math.sqrt(area / count), across / 64), length / max(1, n) / 8)
        near = near_segments(left, kept, radius, size)
        best = settled(near.filter(apart).groupBy(*key).agg(F.min("distance_m").alias("least_m"), *found))
        if radius >= metres:
            done.append(best)
            break
        # A segment beyond the ring may be as far as one in it but for the digits that ranks go by.
        sure = best.filter(F.col("least_m") <= radius - TIE_M)
        done.append(sure)
        old, left = left, settled(left.join(sure.select(*key), key, "left_anti"))
        forget(old)
        if left.isEmpty():
            break
        radius = min(metres, 8 * radius)
    forget(left)
    forget(kept)
    return reduce(DataFrame.unionByName, done)


def dots(features: DataFrame) -> DataFrame:
    """Features at points as segments without a length."""
    return features.withColumns({"ax": F.col("x_m"), "ay": F.col("y_m"), "bx": F.col("x_m"), "by": F.col("y_m")}).drop("x_m", "y_m")


def segment_distance(points: DataFrame, segments: DataFrame, key: str, metres: float) -> DataFrame:
    """key and nearest_m: how far each point's nearest segment is, if it is within metres."""
    return nearest_segment(points, segments, [key], metres).select(key, F.col("least_m").alias("nearest_m"))


def in_boxes(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Points with the boxes (min_x, max_x, min_y, max_y) that they are in, edges included, by cells of a size."""
    spread = boxes.withColumn("cell_x", around(F.col("min_x"), F.col("max_x"), size)).withColumn("cell_y", around(F.col("min_y"), F.col("max_y"), size))
    placed = points.withColumn("cell_x", cell("x_m", size)).withColumn("cell_y", cell("y_m", size))
    return placed.join(spread, ["cell_x", "cell_y"]).filter("x_m >= min_x AND x_m <= max_x AND y_m >= min_y AND y_m <= max_y").drop("cell_x", "cell_y")


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd containment in a closed ring, an array of structs with x and y; points on the edge count as inside."""
    sides = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))

    def on(s: Column) -> Column:
        a, b = s["a"], s["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    def hit(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], F.lit(1.0)).otherwise(b["y"] - a["y"]) + a["x"])

    return F.exists(sides, on) | (F.size(F.filter(sides, hit)) % 2 == 1)


def segments(vertices: DataFrame) -> DataFrame:
    """Ways as rows of vertices (way_id, pos) -> their segments with the length before each and of the whole way."""
    order = Window.partitionBy("way_id").orderBy("pos")
    step = F.sqrt((F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by") - F.col("ay")) * (F.col("by") - F.col("ay")))
    out = vertices.select("way_id", "pos", F.col("x_m").alias("ax"), F.col("y_m").alias("ay"), F.lead("x_m").over(order).alias("bx"), F.lead("y_m").over(order).alias("by")).filter("bx IS NOT NULL")
    out = out.withColumn("length_m", step)
    out = out.withColumn("before_m", F.coalesce(F.sum("length_m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return out.withColumn("way_m", F.sum("length_m").over(Window.partitionBy("way_id")))


def clip_to_box(ax: Column, ay: Column, bx: Column, by: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> tuple[Column, Column]:
    """The part of a segment in a box, as two places on it (0 to 1); it is empty if the first isn't under the second."""
    lo, hi = [F.lit(0.0)], [F.lit(1.0)]
    for a, b, low, high in ((ax, bx, x0, x1), (ay, by, y0, y1)):
        d = b - a
        inside = (a >= low) & (a <= high)
        safe = F.when(d == 0, F.lit(1.0)).otherwise(d)
        lo.append(F.when(d == 0, F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least((low - a) / safe, (high - a) / safe)))
        hi.append(F.when(d == 0, F.lit(1.0)).otherwise(F.greatest((low - a) / safe, (high - a) / safe)))
    return F.greatest(*lo), F.least(*hi)
