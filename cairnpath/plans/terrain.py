"""Queries over an elevation grid of rows (ix, iy, z): neighbours are equi-joins on cells."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnpath.functions.curves import sector
from cairnpath.operators import graph
from cairnpath.plans.registry import query
from cairnpath.sources.fixtures import load, sql

RES = 30.0
#: The level of cells that no way out is known for yet.
DRY = 1e18


def neighbours(grid: DataFrame, reach: int) -> DataFrame:
    """Each cell with those up to so many cells away, as offsets dx, dy and their z (as nz)."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    spread = grid.filter("z IS NOT NULL").select("ix", "iy", F.col("z").alias("nz")).withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    moved = spread.select((F.col("ix") - F.col("dx")).alias("ix"), (F.col("iy") - F.col("dy")).alias("iy"), "dx", "dy", "nz")
    return grid.join(moved, ["ix", "iy"])


HORN = "SELECT ix, iy, count(*) AS n, " + ", ".join(f"max(CASE WHEN dx = {x} AND dy = {y} THEN nz END) AS {n}" for n, x, y in (("a", -1, 1), ("b", 0, 1), ("c", 1, 1), ("d", -1, 0), ("f", 1, 0), ("g", -1, -1), ("h", 0, -1), ("i", 1, -1))) + " FROM nb GROUP BY ix, iy"
NB = lambda reach: f"nb AS (SELECT g.ix, g.iy, g.z, o.ix - g.ix AS dx, o.iy - g.iy AS dy, o.z AS nz FROM grid g JOIN grid o ON abs(o.ix - g.ix) <= {reach} AND abs(o.iy - g.iy) <= {reach} AND o.z IS NOT NULL)"


@query("horn_slope", sql(f"{NB(1)}, hh AS ({HORN}), s AS (SELECT ix, iy, ((c + 2 * f + i) - (a + 2 * d + g)) / 240e0 AS sx, ((a + 2 * b + c) - (g + 2 * h + i)) / 240e0 AS sy FROM hh WHERE a + b + c + d + f + g + h + i IS NOT NULL) SELECT ix, iy, round(degrees(atan(sqrt(sx * sx + sy * sy))), 4) AS slope_deg, round(100 * sqrt(sx * sx + sy * sy), 4) AS slope_pct FROM s", "grid"))
def horn_slope(spark: SparkSession, d: str) -> DataFrame:
    """Slope from the eight cells around; cells that lack one have none."""
    around = neighbours(load(spark, d, "grid"), 1)
    at = lambda x, y: F.max(F.when((F.col("dx") == x) & (F.col("dy") == y), F.col("nz")))
    east, west = at(1, 1) + 2 * at(1, 0) + at(1, -1), at(-1, 1) + 2 * at(-1, 0) + at(-1, -1)
    north, south = at(-1, 1) + 2 * at(0, 1) + at(1, 1), at(-1, -1) + 2 * at(0, -1) + at(1, -1)
    s = around.groupBy("ix", "iy").agg(((east - west) / (8 * RES)).alias("sx"), ((north - south) / (8 * RES)).alias("sy")).filter("sx IS NOT NULL AND sy IS NOT NULL")
    rise = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))
    return s.select("ix", "iy", F.round(F.degrees(F.atan(rise)), 4).alias("slope_deg"), F.round(100 * rise, 4).alias("slope_pct"))


#: How far the ground around a cell counts, in cells each way: a window of 33 cells, which is one kilometre.
WINDOW = 16


def _stands(at: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    """Each cell of a tile against all those in its window, which the tile came with."""
    x, y = (cells[c].to_numpy() - cells[c].min() + WINDOW for c in ("ix", "iy"))
    ground = np.full((x.max() + WINDOW + 1, y.max() + WINDOW + 1), np.nan)
    ground[x, y] = cells["z"]
    own = ((cells["ix"] // TILE == at[0]) & (cells["iy"] // TILE == at[1])).to_numpy()
    x, y = x[own], y[own]
    steps = [(dx, dy) for dx in range(-WINDOW, WINDOW + 1) for dy in range(-WINDOW, WINDOW + 1)]
    n, lower, rise, square = (np.zeros(len(x)) for _ in range(4))
    for dx, dy in steps:
        up = ground[x + dx, y + dy] - ground[x, y]
        n += ~np.isnan(up)
        lower += up < 0
        rise += np.nan_to_num(up)
    mean = rise / n
    for dx, dy in steps:
        off = np.nan_to_num(ground[x + dx, y + dy] - ground[x, y] - mean)
        square += off * off
    spread = np.sqrt(square / n)
    dev = np.where(spread > 0, (0.0 - mean) / np.where(spread > 0, spread, 1.0), np.nan)
    return cells.loc[own, ["ix", "iy"]].assign(dev=dev, percentile=100.0 * lower / n)


@query("deviation", sql(f"{NB(WINDOW)} SELECT ix, iy, round(CASE WHEN stddev_pop(nz) > 0 THEN (max(z) - avg(nz)) / stddev_pop(nz) END, 4) AS dev, round(100e0 * sum(CASE WHEN nz < z THEN 1 ELSE 0 END) / count(*), 4) AS percentile FROM nb WHERE z IS NOT NULL GROUP BY ix, iy", "grid"))
def deviation(spark: SparkSession, d: str) -> DataFrame:
    """How high a cell stands over the mean of the kilometre around it, in standard deviations, and the share of lower cells; by tiles that come with what is around them."""
    tiles = lambda k: F.explode(F.sequence(F.floor((F.col(k) - WINDOW) / TILE), F.floor((F.col(k) + WINDOW) / TILE)))
    put = load(spark, d, "grid").filter("z IS NOT NULL").select("ix", "iy", "z").withColumn("tx", tiles("ix")).withColumn("ty", tiles("iy"))
    stands = put.groupBy("tx", "ty").applyInPandas(_stands, "ix long, iy long, dev double, percentile double")
    return stands.select("ix", "iy", F.round("dev", 4).alias("dev"), F.round("percentile", 4).alias("percentile"))


@query("sampled_cells", sql(f"{NB(1)} SELECT ix, iy, median(nz) AS median_z, max(nz) AS max_z, min(nz) AS min_z, round((degrees(atan2(sum(sin(radians(nz))), sum(cos(radians(nz))))) + 360) % 360, 3) AS mean_deg FROM nb WHERE ix % 3 = 0 AND iy % 3 = 0 GROUP BY ix, iy", "grid"))
def sampled_cells(spark: SparkSession, d: str) -> DataFrame:
    around = neighbours(load(spark, d, "grid"), 1).filter("ix % 3 = 0 AND iy % 3 = 0")
    mean = F.degrees(F.atan2(F.sum(F.sin(F.radians("nz"))), F.sum(F.cos(F.radians("nz")))))
    return around.groupBy("ix", "iy").agg(F.median("nz").alias("median_z"), F.max("nz").alias("max_z"), F.min("nz").alias("min_z"), F.round((mean + 360) % 360, 3).alias("mean_deg"))


ZONE = "CASE WHEN z < 20 THEN 'low' WHEN z < 60 THEN 'medium' WHEN z < 1e9 THEN 'high' END"


@query("zone_cells", sql(f"SELECT {ZONE} AS zone_class, CAST(floor(ix / 10e0) AS BIGINT) AS tile_x, CAST(floor(iy / 10e0) AS BIGINT) AS tile_y, count(*) AS cells, round(count(*) * 900e0, 1) AS area_m2 FROM grid WHERE z IS NOT NULL GROUP BY ALL", "grid"))
def zone_cells(spark: SparkSession, d: str) -> DataFrame:
    """Reclassed cells counted by the tile whose half-open core they are in."""
    grid = load(spark, d, "grid").filter("z IS NOT NULL")
    return grid.groupBy(F.when(F.col("z") < 20, "low").when(F.col("z") < 60, "medium").otherwise("high").alias("zone_class"), F.floor(F.col("ix") / 10).alias("tile_x"), F.floor(F.col("iy") / 10).alias("tile_y")).agg(F.count(F.lit(1)).alias("cells"), F.round(F.count(F.lit(1)) * 900.0, 1).alias("area_m2"))


@query("zone_parts", sql("c AS (SELECT iy * 1000000000 + ix AS id, ix, iy FROM grid WHERE z >= 60), e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON abs(a.ix - b.ix) + abs(a.iy - b.iy) <= 1), r AS (SELECT a AS node, a AS part FROM e UNION SELECT e.b, r.part FROM r JOIN e ON e.a = r.node), l AS (SELECT node, min(part) AS part FROM r GROUP BY node) SELECT part, count(*) AS cells FROM l GROUP BY part HAVING count(*) >= 3", "grid").replace("WITH ", "WITH RECURSIVE ", 1))
def zone_parts(spark: SparkSession, d: str) -> DataFrame:
    """Connected parts of a zone with three cells or more."""
    cells = load(spark, d, "grid").filter("z >= 60").select("ix", "iy", (F.col("iy") * 1000000000 + F.col("ix")).alias("u"))
    to = lambda x, y: cells.select((F.col("ix") - x).alias("ix"), (F.col("iy") - y).alias("iy"), F.col("u").alias("v"))
    pairs = cells.join(to(1, 0), ["ix", "iy"]).select("u", "v").union(cells.join(to(0, 1), ["ix", "iy"]).select("u", "v"))
    return graph.pieces(pairs).groupBy("piece").agg(F.count(F.lit(1)).alias("cells")).filter("cells >= 3").withColumnRenamed("piece", "part")


#: Cells that a view is worked out from, every 25th each way; how many cells away it ends.
EYES, FAR = "ix % 25 = 12 AND iy % 25 = 2", 12
SEEN = f"""g AS (SELECT * FROM grid WHERE z IS NOT NULL), eyes AS (SELECT ix AS ex, iy AS ey, z + 1.7e0 AS eye FROM g WHERE {EYES}),
    t AS (SELECT ex, ey, eye, ix, iy, greatest(abs(ix - ex), abs(iy - ey)) AS n FROM eyes JOIN g ON abs(ix - ex) <= {FAR} AND abs(iy - ey) <= {FAR} WHERE ix <> ex OR iy <> ey),
    ray AS (SELECT t.*, k, CAST(ex + round((ix - ex) * k / CAST(n AS DOUBLE)) AS BIGINT) AS cx, CAST(ey + round((iy - ey) * k / CAST(n AS DOUBLE)) AS BIGINT) AS cy FROM t, LATERAL (SELECT unnest(range(1, n + 1)) AS k)),
    sl AS (SELECT ex, ey, ray.ix, ray.iy, n, k, (g.z - eye) / k AS slope FROM ray JOIN g ON g.ix = cx AND g.iy = cy),
    seen AS (SELECT ex, ey, ix, iy, max(CASE WHEN k = n THEN slope END) >= coalesce(max(CASE WHEN k < n THEN slope END), -1e9) AS visible FROM sl GROUP BY ex, ey, ix, iy)"""


def visible_cells(grid: DataFrame) -> DataFrame:
    """ex, ey, ix, iy, visible: whether no cell on the way from an eye rises over the line of sight; a target meets the cells on its line."""
    c, cells = F.col, grid.filter("z IS NOT NULL")
    eyes = cells.filter(EYES).select(c("ix").alias("ex"), c("iy").alias("ey"), (c("z") + 1.7).alias("eye"))
    steps = F.sequence(F.lit(-FAR), F.lit(FAR))
    targets = eyes.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).filter("dx <> 0 OR dy <> 0").withColumn("ix", c("ex") + c("dx")).withColumn("iy", c("ey") + c("dy"))
    targets = targets.join(cells.select("ix", "iy"), ["ix", "iy"]).withColumn("n", F.greatest(F.abs("dx"), F.abs("dy")))
    ray = targets.withColumn("k", F.explode(F.sequence(F.lit(1), c("n"))))
    at = lambda o, e: (c(e) + F.round(c(o) * c("k") / c("n").cast("double"))).cast("long")
    ray = ray.select("ex", "ey", "eye", "ix", "iy", "n", "k", at("dx", "ex").alias("cx"), at("dy", "ey").alias("cy")).join(cells.select(c("ix").alias("cx"), c("iy").alias("cy"), "z"), ["cx", "cy"])
    slope = (c("z") - c("eye")) / c("k")
    return ray.groupBy("ex", "ey", "ix", "iy").agg((F.max(F.when(c("k") == c("n"), slope)) >= F.coalesce(F.max(F.when(c("k") < c("n"), slope)), F.lit(-1e9))).alias("visible"))


@query("viewshed", sql(f"{SEEN} SELECT * FROM seen", "grid"))
def viewshed(spark: SparkSession, d: str) -> DataFrame:
    return visible_cells(load(spark, d, "grid"))


@query("view_sectors", sql(f"{SEEN}, v AS (SELECT ex, ey, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor(((degrees(atan2(ix - ex, iy - ey)) + 360) % 360 + 22.5) / 45) AS INT) % 8 + 1] AS sector FROM seen WHERE visible AND sqrt(pow((ix - ex) * 30e0, 2) + pow((iy - ey) * 30e0, 2)) > 200), n AS (SELECT ex, ey, sector, count(*) AS cells FROM v GROUP BY ex, ey, sector) SELECT ex, ey, sector, cells, round(cells * 900 / 1e6, 4) AS area_km2, cells = max(cells) OVER w AND cells >= 0.3 * sum(cells) OVER w AS dominant FROM n WINDOW w AS (PARTITION BY ex, ey)", "grid"))
def view_sectors(spark: SparkSession, d: str) -> DataFrame:
    """Visible area by direction, cells within 200 m left out; a direction dominates with three tenths of it."""
    c = F.col
    seen = visible_cells(load(spark, d, "grid")).filter("visible").filter(F.sqrt(F.pow((c("ix") - c("ex")) * RES, 2) + F.pow((c("iy") - c("ey")) * RES, 2)) > 200)
    n = seen.groupBy("ex", "ey", sector(F.degrees(F.atan2((c("ix") - c("ex")).cast("double"), (c("iy") - c("ey")).cast("double"))) + 360).alias("sector")).agg(F.count(F.lit(1)).alias("cells"))
    eye = Window.partitionBy("ex", "ey")
    return n.select("ex", "ey", "sector", "cells", F.round(c("cells") * 900 / 1e6, 4).alias("area_km2"), ((c("cells") == F.max("cells").over(eye)) & (c("cells") >= 0.3 * F.sum("cells").over(eye))).alias("dominant"))


@query("tiles_left", sql("t AS (SELECT DISTINCT CAST(floor(ix / 10e0) AS BIGINT) AS tile_x, CAST(floor(iy / 10e0) AS BIGINT) AS tile_y FROM grid) SELECT tile_x, tile_y, greatest(0, tile_x * 10 - 3) AS from_x, least(49, tile_x * 10 + 12) AS to_x FROM t WHERE (tile_x + tile_y) % 3 <> 0", "grid"))
def tiles_left(spark: SparkSession, d: str) -> DataFrame:
    """Tiles that a ledger of finished ones lacks, with the cells that they overlap."""
    tiles = load(spark, d, "grid").select(F.floor(F.col("ix") / 10).alias("tile_x"), F.floor(F.col("iy") / 10).alias("tile_y")).distinct()
    done = tiles.filter("(tile_x + tile_y) % 3 = 0")
    return tiles.join(done, ["tile_x", "tile_y"], "left_anti").select("tile_x", "tile_y", F.greatest(F.lit(0), F.col("tile_x") * 10 - 3).alias("from_x"), F.least(F.lit(49), F.col("tile_x") * 10 + 12).alias("to_x"))


@query("bilinear_samples", sql("s AS (SELECT site_id, x_m / 2100 AS gx, y_m / 2100 AS gy FROM sites), c AS (SELECT site_id, gx, gy, floor(gx) + dx AS cx, floor(gy) + dy AS cy FROM s, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy)), w AS (SELECT site_id, z, (1 - abs(gx - cx)) * (1 - abs(gy - cy)) AS w FROM c JOIN grid ON ix = cx AND iy = cy WHERE z IS NOT NULL) SELECT site_id, round(sum(w * z) / sum(w), 4) AS z FROM w GROUP BY site_id HAVING sum(w) > 0", "sites", "grid"))
def bilinear_samples(spark: SparkSession, d: str) -> DataFrame:
    """Elevation from the four cells around a point; cells without data drop out of the weights."""
    corner = lambda c: F.explode(F.array(F.floor(c), F.floor(c) + 1))
    s = load(spark, d, "sites").select("site_id", (F.col("x_m") / 2100).alias("gx"), (F.col("y_m") / 2100).alias("gy")).withColumn("ix", corner(F.col("gx"))).withColumn("iy", corner(F.col("gy")))
    w = (1 - F.abs(F.col("gx") - F.col("ix"))) * (1 - F.abs(F.col("gy") - F.col("iy")))
    return s.join(load(spark, d, "grid").filter("z IS NOT NULL"), ["ix", "iy"]).withColumn("w", w).groupBy("site_id").agg(F.round(F.sum(F.col("w") * F.col("z")) / F.sum("w"), 4).alias("z"), F.sum("w").alias("sw")).filter("sw > 0").drop("sw")


#: The eight neighbours of a cell, Horn's names.
EIGHT = {"a": (-1, 1), "b": (0, 1), "c": (1, 1), "d": (-1, 0), "f": (1, 0), "g": (-1, -1), "h": (0, -1), "i": (1, -1)}


@query("aspect", sql(f"{NB(1)}, hh AS ({HORN}), s AS (SELECT ix, iy, ((c + 2 * f + i) - (a + 2 * d + g)) / 240e0 AS sx, ((a + 2 * b + c) - (g + 2 * h + i)) / 240e0 AS sy FROM hh WHERE a + b + c + d + f + g + h + i IS NOT NULL) SELECT ix, iy, round((degrees(atan2(-sx, -sy)) + 360) % 360, 3) AS aspect_deg FROM s WHERE sx <> 0 OR sy <> 0", "grid"))
def aspect(spark: SparkSession, d: str) -> DataFrame:
    """The direction that a slope faces, clockwise from north; level cells face nowhere."""
    around = neighbours(load(spark, d, "grid"), 1)
    z = {n: F.max(F.when((F.col("dx") == x) & (F.col("dy") == y), F.col("nz"))) for n, (x, y) in EIGHT.items()}
    sx, sy = ((z["c"] + 2 * z["f"] + z["i"]) - (z["a"] + 2 * z["d"] + z["g"])) / (8 * RES), ((z["a"] + 2 * z["b"] + z["c"]) - (z["g"] + 2 * z["h"] + z["i"])) / (8 * RES)
    s = around.groupBy("ix", "iy").agg(sx.alias("sx"), sy.alias("sy")).filter("sx IS NOT NULL AND sy IS NOT NULL AND (sx <> 0 OR sy <> 0)")
    return s.select("ix", "iy", F.round((F.degrees(F.atan2(-F.col("sx"), -F.col("sy"))) + 360) % 360, 3).alias("aspect_deg"))


#: Cells along a side of the tiles that rounds work on.
TILE = 64


def tiled(df: DataFrame) -> DataFrame:
    return df.withColumns({"tx": F.floor(F.col("ix") / TILE), "ty": F.floor(F.col("iy") / TILE)})


def _sunk(cells: pd.DataFrame) -> pd.DataFrame:
    """A tile with the cells around it: lets every cell of its own drain over its best neighbour until nothing changes."""
    x, y = ((cells[c] - cells[c].min() + 1).to_numpy() for c in ("ix", "iy"))
    level = np.full((x.max() + 2, y.max() + 2), DRY)
    ground = level.copy()
    level[x, y] = cells["level"]
    own = cells["own"].to_numpy()
    ground[x[own], y[own]] = cells["z"].to_numpy()[own]  # cells around stay as they are: their ground is never under their level
    while True:
        out = np.minimum.reduce([level[1 + dx : level.shape[0] - 1 + dx, 1 + dy : level.shape[1] - 1 + dy] for dx, dy in EIGHT.values()])
        new = np.minimum(level[1:-1, 1:-1], np.maximum(ground[1:-1, 1:-1], out))
        if (new == level[1:-1, 1:-1]).all():
            break
        level[1:-1, 1:-1] = new
    found = cells[["ix", "iy", "z"]].assign(level=level[x, y])
    found["better"] = found["level"] < cells["level"]
    return found[own]


def filled_grid(grid: DataFrame) -> DataFrame:
    """ix, iy, z and level, to which water stands before it runs off: the least over all ways out of the highest cell on the way.

    Cells at the edge of the data, or beside a gap in it, drain at their own height. Each round settles every tile with the
    levels of the cells around it; rounds end when nothing changes, and their number is that of the tiles on the way out
    that crosses most.
    """
    c, cells = F.col, grid.filter("z IS NOT NULL")
    steps = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in EIGHT.values()))
    beside = cells.select("ix", "iy", F.inline(steps)).select((c("ix") - c("dx")).alias("ix"), (c("iy") - c("dy")).alias("iy"))
    inner = beside.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n")).filter("n = 8").withColumn("inner", F.lit(True)).drop("n")
    level = graph.settled(cells.join(inner, ["ix", "iy"], "left").select("ix", "iy", "z", F.when(c("inner"), F.lit(DRY)).otherwise(c("z")).alias("level"), F.lit(True).alias("better")))
    at = lambda k, d: F.floor((c(k) + c(d)) / TILE)
    while not level.filter("better").isEmpty():
        # A cell at the side of a tile is also put in the tiles beside it.
        beyond = level.select("ix", "iy", "z", "level", F.inline(steps)).select("ix", "iy", "z", "level", at("ix", "dx").alias("tx"), at("iy", "dy").alias("ty")).filter((c("tx") != F.floor(c("ix") / TILE)) | (c("ty") != F.floor(c("iy") / TILE))).distinct()
        put = tiled(level.select("ix", "iy", "z", "level")).withColumn("own", F.lit(True)).union(beyond.withColumn("own", F.lit(False)))
        old, level = level, graph.settled(put.groupBy("tx", "ty").applyInPandas(_sunk, "ix long, iy long, z double, level double, better boolean"))
        graph.forget(old)
    return level.drop("better")


@query("sink_depths", None)
def sink_depths(spark: SparkSession, d: str) -> DataFrame:
    """How deep water stands in each cell before it runs off."""
    return filled_grid(load(spark, d, "grid")).select("ix", "iy", (F.col("level") - F.col("z")).alias("depth_m"))


def _run_down(came: pd.DataFrame, down: pd.DataFrame) -> pd.DataFrame:
    """What runs through each cell of a tile, highest first, and (leaves) what goes into cells of other tiles."""
    down = down.sort_values(["z", "ix", "iy"], ascending=False)
    moving, left = dict(zip(zip(came["ix"], came["iy"], strict=True), came["came"], strict=True)), {}
    for x, y, nx, ny, inside in zip(*(down[k].tolist() for k in ("ix", "iy", "nx", "ny", "inside")), strict=True):
        if n := moving.get((x, y)):
            to = moving if inside else left
            to[nx, ny] = to.get((nx, ny), 0) + n
    rows = [(*cell, n, leaves) for cells, leaves in ((moving, False), (left, True)) for cell, n in cells.items()]
    return pd.DataFrame(rows, columns=["ix", "iy", "cells", "leaves"])


@query("wetness", None)
def wetness(spark: SparkSession, d: str) -> DataFrame:
    """Wetness index ln(area / tan slope) from the cells that drain through each, on the ground with its hollows filled.

    A cell drains to the neighbour with the steepest fall (ties by place; on level ground none), its area in rounds: what
    came into a tile in the last round runs down to where it leaves the tile. The published tool divides flow between two neighbours; this is
    the single-direction form. Slopes count as a hundredth of a degree at least.
    """
    c, cells = F.col, filled_grid(load(spark, d, "grid")).select("ix", "iy", F.col("level").alias("z"))
    steps = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in EIGHT.values()))
    other = cells.select(c("ix").alias("nx"), c("iy").alias("ny"), c("z").alias("nz"))
    falls = cells.select("ix", "iy", "z", F.inline(steps)).withColumn("nx", c("ix") + c("dx")).withColumn("ny", c("iy") + c("dy")).join(other, ["nx", "ny"])
    fall = (c("z") - c("nz")) / (RES * F.sqrt((c("dx") * c("dx") + c("dy") * c("dy")).cast("double")))
    to = graph.settled(falls.groupBy("ix", "iy").agg(F.max(F.struct(fall.alias("fall"), "nx", "ny")).alias("b")).select("ix", "iy", "b.*"))
    down = graph.settled(tiled(to.filter("fall > 0").select("ix", "iy", "nx", "ny").join(cells, ["ix", "iy"])).withColumn("inside", (F.floor(c("nx") / TILE) == c("tx")) & (F.floor(c("ny") / TILE) == c("ty"))))
    # What runs into a cell in a round: at first one from each, then what left other tiles.
    came, parts = graph.settled(cells.select("ix", "iy", F.lit(1).cast("long").alias("came"))), []
    while not came.isEmpty():
        put = tiled(came)
        met = down.join(put.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi")
        moved = graph.settled(put.groupBy("tx", "ty").cogroup(met.groupBy("tx", "ty")).applyInPandas(_run_down, "ix long, iy long, cells long, leaves boolean"))
        parts.append(moved.filter("NOT leaves").drop("leaves"))
        old, came = came, graph.settled(moved.filter("leaves").groupBy("ix", "iy").agg(F.sum("cells").alias("came")))
        graph.forget(old)
    area = reduce(DataFrame.union, parts).groupBy("ix", "iy").agg(F.sum("cells").alias("cells"))
    slope = F.greatest(F.coalesce("fall", F.lit(0.0)), F.lit(0.000174532925))
    index = area.join(to, ["ix", "iy"], "left").withColumn("twi", F.round(F.log(c("cells") * RES / slope), 4))
    return index.select("ix", "iy", "cells", "twi", F.when(c("twi") >= 12.5, "high").when(c("twi") >= 10, "medium").otherwise("low").alias("band"))


#: Cells upwind that are looked at, from the west; the ground must rise against the wind by so much a metre.
UPWIND, RISE = 40, 0.05


@query("upwind_fetch", sql(f"k AS (SELECT unnest(range(1, {UPWIND + 1})) AS k), m AS (SELECT g.ix, g.iy, min(CASE WHEN o.z >= g.z + k * 30e0 * {RISE} THEN k END) AS rise, max(CASE WHEN o.ix IS NOT NULL THEN k END) AS far FROM grid g, k LEFT JOIN grid o ON o.ix = g.ix - k AND o.iy = g.iy AND o.z IS NOT NULL WHERE g.z IS NOT NULL GROUP BY g.ix, g.iy) SELECT ix, iy, coalesce(rise * 30e0, -coalesce(far, 0) * 30e0) AS fetch_m FROM m", "grid"))
def upwind_fetch(spark: SparkSession, d: str) -> DataFrame:
    """How far to windward the ground first rises; negative if it doesn't as far as there is data."""
    c, grid = F.col, load(spark, d, "grid").filter("z IS NOT NULL")
    ahead = grid.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(UPWIND)))).withColumn("ox", c("ix") - c("k"))
    met = ahead.join(grid.select(c("ix").alias("ox"), "iy", c("z").alias("oz")), ["ox", "iy"])
    found = met.groupBy("ix", "iy").agg(F.min(F.when(c("oz") >= c("z") + c("k") * RES * RISE, c("k"))).alias("rise"), F.max("k").alias("far"))
    return grid.select("ix", "iy").join(found, ["ix", "iy"], "left").select("ix", "iy", F.coalesce(c("rise") * RES, -F.coalesce("far", F.lit(0)) * RES).alias("fetch_m"))


#: Suns of a midsummer day at 44 degrees north, an hour apart: step to the cell under the sun and tangent of its height.
HORIZON = 10


def suns() -> list[tuple[int, int, int, float]]:
    from math import acos, asin, cos, degrees, radians, sin, tan

    lat, dec, out = radians(44.0), radians(23.0), []
    for hour in range(5, 20):
        angle = radians(15.0 * (hour - 12))
        high = asin(sin(lat) * sin(dec) + cos(lat) * cos(dec) * cos(angle))
        if high <= 0:
            continue
        az = degrees(acos(max(-1.0, min(1.0, (sin(dec) - sin(high) * sin(lat)) / (cos(high) * cos(lat))))))
        az = az if hour < 12 else 360 - az
        dx, dy = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)][round(az / 45) % 8]
        out.append((hour, dx, dy, round(tan(high), 9)))
    return out


_SUNS = "(VALUES " + ", ".join(f"({hr}, {x}, {y}, {t!r}e0)" for hr, x, y, t in suns()) + ") s(hour, dx, dy, rise)"


@query("daylight_share", sql(f"k AS (SELECT unnest(range(1, {HORIZON + 1})) AS k), m AS (SELECT g.ix, g.iy, hour, coalesce(bool_or((o.z - g.z) / (k * 30e0 * sqrt(dx * dx + dy * dy)) > rise), FALSE) AS shaded FROM grid g, {_SUNS}, k LEFT JOIN grid o ON o.ix = g.ix + k * dx AND o.iy = g.iy + k * dy AND o.z IS NOT NULL WHERE g.z IS NOT NULL GROUP BY g.ix, g.iy, hour) SELECT ix, iy, round(1 - avg(shaded::INT), 4) AS share, round(1 - avg(shaded::INT) FILTER (hour <= 10), 4) AS morning_share FROM m GROUP BY ix, iy", "grid"))
def daylight_share(spark: SparkSession, d: str) -> DataFrame:
    """The share of a midsummer day, and of its morning, in which no ground within 300 m hides the sun."""
    c, grid = F.col, load(spark, d, "grid").filter("z IS NOT NULL")
    sun = F.array(*(F.struct(F.lit(hr).alias("hour"), F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(t).alias("rise")) for hr, x, y, t in suns()))
    towards = {(x, y) for _, x, y, _ in suns()}
    steps = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in sorted(towards)))
    rays = grid.select("ix", "iy", "z", F.inline(steps)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(HORIZON)))).withColumn("ox", c("ix") + c("k") * c("dx")).withColumn("oy", c("iy") + c("k") * c("dy"))
    met = rays.join(grid.select(c("ix").alias("ox"), c("iy").alias("oy"), c("z").alias("oz")), ["ox", "oy"])
    rise = (c("oz") - c("z")) / (c("k") * RES * F.sqrt((c("dx") * c("dx") + c("dy") * c("dy")).cast("double")))
    horizon = met.groupBy("ix", "iy", "dx", "dy").agg(F.max(rise).alias("horizon"))
    hours = grid.select("ix", "iy", F.inline(sun)).join(horizon, ["ix", "iy", "dx", "dy"], "left").withColumn("lit", F.when(c("horizon") > c("rise"), 0.0).otherwise(1.0))
    return hours.groupBy("ix", "iy").agg(F.round(F.avg("lit"), 4).alias("share"), F.round(F.avg(F.when(c("hour") <= 10, c("lit"))), 4).alias("morning_share"))


@query("damp_zones", sql("SELECT CAST(floor(site_id / 100e0) AS BIGINT) AS area, count(*) AS sites FROM terrain WHERE twi >= 10 AND twi < 12.5 GROUP BY 1", "terrain"))
def damp_zones(spark: SparkSession, d: str) -> DataFrame:
    """The band of damp ground, from 10 on and under 12.5: sites in it by area."""
    return load(spark, d, "terrain").filter("twi >= 10 AND twi < 12.5").groupBy(F.floor(F.col("site_id") / 100).alias("area")).agg(F.count(F.lit(1)).alias("sites"))


LAKE = "(ix * 7 + iy * 3) % 11 < 2"


@query("lakes_in_view", sql(f"{SEEN} SELECT ex, ey, count(*) * 900 AS water_m2, count(*) * 900 >= 2000 AS water_view FROM seen WHERE visible AND {LAKE} AND sqrt(pow((ix - ex) * 30e0, 2) + pow((iy - ey) * 30e0, 2)) <= 2000 GROUP BY ex, ey", "grid"))
def lakes_in_view(spark: SparkSession, d: str) -> DataFrame:
    """The area of lakes that can be seen within 2 km of an eye."""
    c = F.col
    seen = visible_cells(load(spark, d, "grid")).filter(f"visible AND {LAKE}").filter(F.sqrt(F.pow((c("ix") - c("ex")) * RES, 2) + F.pow((c("iy") - c("ey")) * RES, 2)) <= 2000)
    return seen.groupBy("ex", "ey").agg((F.count(F.lit(1)) * 900).alias("water_m2"), (F.count(F.lit(1)) * 900 >= 2000).alias("water_view"))
