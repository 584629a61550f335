"""The candidate search: one case for each check, thinning, and the cells of segments."""

import math
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from cairnpath.operators import spatial
from cairnpath.plans import planning


def test_each_check(spark, monkeypatch):
    """One site a check that fails it alone, in a north with its limits, and some that pass."""
    base = dict(x_m=50_000.0, y_m=70_000.0, site_type="backcountry", source="osm", name="s", elevation_m=500.0)
    changes = [{}, {"x_m": 10_000.0}, {"x_m": 20_000.0}, {"x_m": 1000.0}, {"x_m": 30_000.0}, {"x_m": 40_000.0}, {}, {"elevation_m": None}, {"elevation_m": 1210.0}, {}, {"x_m": 60_000.0, "elevation_m": 1060.0}, {"y_m": 5_000.0, "elevation_m": 1990.0}, {"elevation_m": 1203.0}]
    sites = spark.createDataFrame([Row(site_id=i, **(base | c)) for i, c in enumerate(changes)], "site_id long, x_m double, y_m double, site_type string, source string, name string, elevation_m double")
    box = lambda i, x, name, access: (i, name, x - 500.0, x + 500.0, 0.0, 90_000.0, access, "1")
    land = [box(1, 50_000.0, "A", "open"), box(2, 10_000.0, "A", "closed"), box(3, 20_000.0, "A", "restricted"), box(4, 30_000.0, "A", "open"), box(5, 40_000.0, "A", "open"), box(6, 60_000.0, "NATION_2", "open")]
    terrain = [(i, 8.0 if i == 9 else 1.0, 12.5 if i == 6 else 4.0, 0.35 if i == 6 else 0.0, 0.0, None, False, 0.0, 50.0, 0.0) for i in range(len(changes))]
    tables = {
        "sites": sites,
        "land": spark.createDataFrame(land, "land_id int, name string, min_x double, max_x double, min_y double, max_y double, access string, gap string"),
        "terrain": spark.createDataFrame(terrain, "site_id long, slope_deg double, twi double, sink_m double, dev double, view_km2 double, water_view boolean, aspect_deg double, percentile double, fetch_m double"),
        "vertices": spark.createDataFrame([(1, 1, 1, 29_980.0, 60_000.0), (1, 2, 2, 29_980.0, 80_000.0)], "way_id long, pos int, node_id long, x_m double, y_m double"),
        "water": spark.createDataFrame([(1, 40_030.0, 70_000.0)], "water_id long, x_m double, y_m double"),
    }
    monkeypatch.setattr(planning, "load", lambda spark, d, name: tables[name])
    monkeypatch.setattr("cairnpath.plans.spatial.load", lambda spark, d, name: tables[name])
    got = {r.site_id: r.failed for r in planning.candidates(spark, "").collect()}
    assert got == {
        0: "passed", 1: "land", 2: "land", 3: "land", 4: "trail", 5: "water", 6: "pooling", 7: "terrain", 8: "elevation", 9: "slope", 10: "elevation", 11: "passed",  # no limits so far south
        12: "passed",
    }


def test_thinning(spark):
    rows = [(t, s, float((s * 7 + k) % 5), float(k), t * 10_000 + s * 10 + k) for t, n in ((1, 60), (2, 61), (3, 200)) for s in range(n) for k in range(3)]
    got = {}
    for r in planning.thinned(spark.createDataFrame(rows, "trail_id long, station long, bonus double, slope_deg double, site_id long")).collect():
        got.setdefault(r.trail_id, []).append((r.station, r.site_id))
    for t, n in ((1, 60), (2, 61), (3, 200)):
        best = [min((-b, sl, i) for tt, s, b, sl, i in rows if tt == t and s == station)[2] for station in range(n)]
        keep = range(n) if n <= 60 else [int(k * (n / 60)) for k in range(60)]
        assert sorted(got[t]) == [(k, best[k]) for k in keep]


def test_segment_cells(spark):
    """Every place near a segment is in one of its cells, and their number goes with its length."""
    draw, metres = random.Random(4), 15.0
    rows = []
    for i in range(120):
        a = draw.uniform(0, 2 * math.pi) if i % 4 else (i % 8) * math.pi / 8
        length, x, y = draw.choice([0.0, 3.0, 80.0, 900.0, 4000.0]), draw.uniform(-500, 500), draw.uniform(-500, 500)
        rows.append((i, x, y, x + length * math.cos(a), y + length * math.sin(a)))
    cells = {}
    for r in spatial.segment_cells(spark.createDataFrame(rows, "id int, ax double, ay double, bx double, by double"), metres).select("id", "cell_x", "cell_y").collect():
        cells.setdefault(r.id, []).append((r.cell_x, r.cell_y))
    for i, ax, ay, bx, by in rows:
        length = math.hypot(bx - ax, by - ay)
        assert len(cells[i]) == len(set(cells[i])) <= 4 * (length / (2 * metres) + 2)
        for _ in range(40):
            t, off, turn = draw.random(), metres * draw.random() * 0.999, draw.uniform(0, 2 * math.pi)
            x, y = ax + t * (bx - ax) + off * math.cos(turn), ay + t * (by - ay) + off * math.sin(turn)
            assert (math.floor(x / (2 * metres)), math.floor(y / (2 * metres))) in set(cells[i])


def test_ranks_are_score_and_bonus(spark, data):
    kept = planning.spread_candidates(spark, data)
    spots = planning.trail_spots(spark, data).select("site_id", "bonus")
    scores = planning.scored(planning.factor_table(spark, data)).select("site_id", "score")
    off = kept.join(spots, "site_id").join(scores, "site_id").filter(F.col("rank") != F.round(F.col("score") + F.col("bonus"), 1))
    assert off.count() == 0
