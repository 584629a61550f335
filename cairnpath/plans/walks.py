"""Ways over open ground: the grid as a graph cut in cells, with what it costs to cross each worked out once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnpath.operators import overlay
from cairnpath.plans.registry import query
from cairnpath.sources.fixtures import load, sql

#: Metres between places, places along a cell's side, and columns of the grid.
STEP_M, SIDE, COLUMNS = 30.0, 16, 50
#: Bits of a cell's column and row.
BITS = 28
#: Metres an hour on the flat and uphill.
PACE_M, CLIMB_M = 5000.0, 600.0
#: What rough ground, a seventh of all, makes of a distance.
ROUGH = 1.5
KINDS = ("naismith", "distance")


def costs(kind: str, length: Column, rise: Column, rough: Column) -> Column:
    """A step's cost, a whole number: milliseconds by distance and climb, or centimetres times the ground's factor."""
    if kind == "naismith":
        out = length / PACE_M * 3_600_000 + F.greatest(rise, F.lit(0.0)) / CLIMB_M * 3_600_000
    else:
        out = length * 100 * F.when(rough, ROUGH).otherwise(1.0)
    return F.round(out).cast("long")


def ground(spark: SparkSession, d: str) -> DataFrame:
    """Places with a height: node, ix, iy, z and cell."""
    side = lambda c: F.floor(F.col(c) / SIDE).cast("long")
    # Cells are numbered along a Z curve: the bits of a column and a row by turns.
    spread = lambda v, low: reduce(Column.__add__, (F.shiftleft(F.shiftright(v, k).bitwiseAND(F.lit(1)), 2 * k + low) for k in range(BITS)))
    return load(spark, d, "grid").filter("z IS NOT NULL").select((F.col("iy") * COLUMNS + F.col("ix")).cast("long").alias("node"), "ix", "iy", "z", (spread(side("ix"), 0) + spread(side("iy"), 1)).alias("cell"))


def steps(places: DataFrame, kind: str) -> DataFrame:
    """Steps between places next to each other, across corners too."""
    around = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y))
    out = places.select(F.col("node").alias("src"), F.col("z").alias("z0"), ((F.col("ix") + F.col("iy")) % 7 == 0).alias("rough"), "ix", "iy", F.inline(around))
    out = out.select("src", "z0", "rough", (F.col("ix") + F.col("dx")).alias("ix"), (F.col("iy") + F.col("dy")).alias("iy"), (F.sqrt((F.abs("dx") + F.abs("dy")).cast("double")) * STEP_M).alias("length"))
    met = out.join(places.select("ix", "iy", F.col("node").alias("dst"), "z"), ["ix", "iy"])
    return met.select("src", "dst", costs(kind, F.col("length"), F.col("z") - F.col("z0"), F.col("rough")).alias("cost"))


def legs(places: DataFrame) -> DataFrame:
    """From the first place to the last, from there to the one a third on, and to the one two thirds on."""
    span = places.agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    third = lambda k: F.min(F.when(F.col("node") * 3 >= F.col("lo") * (3 - k) + F.col("hi") * k, F.col("node")))
    stops = places.crossJoin(F.broadcast(span)).groupBy("lo", "hi").agg(third(1).alias("one"), third(2).alias("two"))  # span is one row
    leg = lambda k, a, b: F.struct(F.lit(k).alias("leg"), F.col(a).alias("start"), F.col(b).alias("goal"))
    return stops.select(F.inline(F.array(leg(0, "lo", "hi"), leg(1, "hi", "one"), leg(2, "one", "two"))))


def walked(spark: SparkSession, d: str, kind: str) -> tuple[overlay.Overlay, DataFrame, DataFrame]:
    places = ground(spark, d)
    made = overlay.build(steps(places, kind), places.select("node", "cell"))
    asked = legs(places)
    return made, asked, overlay.routes(made, asked)


LEAST = f"""places AS (SELECT iy * {COLUMNS} + ix AS node, ix, iy, z FROM grid WHERE z IS NOT NULL),
    pairs AS (SELECT a.node AS src, b.node AS dst, sqrt(abs(a.ix - b.ix) + abs(a.iy - b.iy)) * {STEP_M} AS length, b.z - a.z AS rise, (a.ix + a.iy) % 7 = 0 AS rough
      FROM places a JOIN places b ON b.ix BETWEEN a.ix - 1 AND a.ix + 1 AND b.iy BETWEEN a.iy - 1 AND a.iy + 1 AND a.node <> b.node),
    steps AS (SELECT 'naismith' AS kind, src, dst, round(length / 5000 * 3600000 + greatest(rise, 0) / 600 * 3600000)::BIGINT AS cost FROM pairs
      UNION ALL SELECT 'distance', src, dst, round(length * 100 * CASE WHEN rough THEN 1.5 ELSE 1.0 END)::BIGINT FROM pairs),
    stops AS (SELECT lo, hi, (SELECT min(node) FROM places WHERE node * 3 >= lo * 2 + hi) AS one, (SELECT min(node) FROM places WHERE node * 3 >= lo + hi * 2) AS two
      FROM (SELECT min(node) AS lo, max(node) AS hi FROM places)),
    asked AS (SELECT kind, l[1] AS leg, l[2] AS start_node, l[3] AS goal_node FROM (SELECT k.kind, unnest([(0, lo, hi), (1, hi, one), (2, one, two)]) AS l FROM stops, (VALUES ('naismith'), ('distance')) k(kind))),
    best(kind, leg, node, cost) USING KEY (kind, leg, node) AS (
      SELECT kind, leg, start_node, 0::BIGINT FROM asked
      UNION
      SELECT b.kind, b.leg, s.dst, min(b.cost + s.cost) FROM best b JOIN steps s ON s.kind = b.kind AND s.src = b.node
      LEFT JOIN recurring.best r ON r.kind = b.kind AND r.leg = b.leg AND r.node = s.dst
      WHERE r.cost IS NULL OR b.cost + s.cost < r.cost GROUP BY b.kind, b.leg, s.dst)
    SELECT a.kind, a.leg, a.start_node, a.goal_node, b.cost FROM asked a JOIN best b ON b.kind = a.kind AND b.leg = a.leg AND b.node = a.goal_node"""



@query("ground_routes", sql(LEAST, "grid").replace("WITH ", "WITH RECURSIVE ", 1))
def ground_routes(spark: SparkSession, d: str) -> DataFrame:
    """The least cost of each leg over open ground, by time and by distance: rounds go with the levels of cells, not with the way's length."""
    out = []
    for kind in KINDS:
        _, asked, found = walked(spark, d, kind)
        out.append(found.select("leg", "cost").join(asked, "leg").select(F.lit(kind).alias("kind"), "leg", F.col("start").alias("start_node"), F.col("goal").alias("goal_node"), "cost"))
    return out[0].union(out[1])


@query("ground_route_lines")
def ground_route_lines(spark: SparkSession, d: str) -> DataFrame:
    """The places on each leg's quickest way, in order, with where they are and how high."""
    made, _, found = walked(spark, d, "naismith")
    return overlay.nodes_of(made, found).join(ground(spark, d), "node").select("leg", "k", "node", (F.col("ix") * STEP_M).alias("x_m"), (F.col("iy") * STEP_M).alias("y_m"), F.col("z").alias("z_m"))
