"""Column functions and joins on small inputs with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cairnpath.functions import curves, text
from cairnpath.operators import graph, spatial
from cairnpath.plans.facts import clip_rings, ring_areas
from cairnpath.plans.geometry import stitched
from cairnpath.plans.hikes import moving
from cairnpath.plans.planning import best_stops, spread
from cairnpath.plans.scoring import REGIONS, decide, region_at, weighted
from cairnpath.plans.series import accepted, threshold_climb, thinned


def values(spark, data, *columns, schema):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


def test_peak_curve(spark):
    got = values(spark, [(0.0,), (30.0,), (60.0,), (460.0,), (860.0,)], curves.peak_curve(F.col("d"), 60.0, 35.0, 400.0), schema="d double")
    assert [round(g[0], 6) for g in got] == [35, 67.5, 100, 50, 25]


def test_piecewise_is_level_beyond_its_points_and_null_on_null(spark):
    got = values(spark, [(-1.0,), (3.0,), (5.5,), (40.0,), (None,)], curves.piecewise(F.col("x"), curves.SLOPE), schema="x double")
    assert [g[0] for g in got] == [100, 100, 75, 0, None]


def test_weighted_mean_leaves_out_what_is_unknown(spark):
    got = values(spark, [(100.0, None), (100.0, 0.0), (None, None)], weighted(["a", "b"], {"a": 3.0, "b": 1.0}), schema="a double, b double")
    assert [g[0] for g in got] == [100, 75, None]


def test_haversine_and_albers(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    x0, y0 = curves.albers(*lit(-73.85, 44.18))
    x1, y1 = curves.albers(*lit(-73.85, 44.18 + 1 / 111.12))
    r = spark.range(1).select(curves.haversine(*lit(0, 0, 1, 0)), x0, y0, F.sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)).first()
    assert math.isclose(r[0], 111195.08, abs_tol=0.1)
    assert (round(r[1]), round(r[2])) == (1749507, 2559202) and round(r[3]) == 1003


def test_threshold_climb_ignores_noise(spark):
    got = values(spark, [([0.0, 1.0, 4.0, 2.0, 9.0],), ([5.0, 6.0, 5.0, 6.0, 5.0],), ([3.0],), ([9.0, 2.0],)], threshold_climb(F.col("v"), 3.0), schema="v array<double>")
    assert [(g[0].gain, g[0].loss) for g in got] == [(9, 0), (0, 0), (0, 0), (0, 7)]


def test_thinned_measures_from_the_last_kept(spark):
    got = values(spark, [([0.0, 30.0, 60.0, 90.0, 120.0],)], thinned(F.col("v"), 50.0), schema="v array<double>")
    assert [(g[0].n, g[0].last) for g in got] == [(3, 120.0)]


def test_accepted_fixes(spark):
    fixes = [(0, 1, 0.0, 0.0, 10.0), (1, 2, 1.0, 0.0, 10.0), (2, 3, 9.0, 0.0, 99.0), (3, 4, 6.0, 0.0, 5.0), (20, 5, 6.0, 0.0, 5.0)]
    got = values(spark, [(fixes,)], F.transform(accepted(F.col("t")), lambda x: x["t_s"]), schema="t array<struct<t_s:bigint,event_id:bigint,x_m:double,y_m:double,accuracy_m:double>>")
    assert got == [([0, 3, 20],)]


@pytest.mark.parametrize(("value", "metres"), [("1,629 m", None), ("5344 ft", 1628.9), ("12", 12), ("1629.25 Metres", 1629.3), (" 7 meter ", 7), ("1 2 m", None), ("12 metre", 12), ("high", None), ("99999", None), (None, None), ("", None)])
def test_elevation_text(spark, value, metres):
    assert values(spark, [(value,)], text.elevation_m(F.col("t")), schema="t string") == [(metres,)]


def test_request(spark):
    asked = text.request(F.col("t"))
    phrases = ["Easy loop under 5 miles near a lake", "3 days, 8 mi", "", None, "two nights, lakeside, moderate climb", "Adirondacks or Vermont, a loop", "quiet 5-8 mile traverse in Maine with lean-tos, over 2,000 ft", "a couple nights"]
    got = [dict(zip(asked, r, strict=True)) for r in values(spark, [(p,) for p in phrases], *(c.alias(n) for n, c in asked.items()), schema="t string")]
    said = [{k: v for k, v in g.items() if v is not None and v is not False} for g in got]
    assert said == [
        {"max_mi": 5.0, "difficulty": "easy", "route_type": "loop", "near_water": True}, {"min_mi": 6.4, "max_mi": 9.6, "nights": 2}, {}, {}, {"nights": 2, "difficulty": "moderate", "near_water": True}, {"route_type": "loop"},
        {"min_mi": 5.0, "max_mi": 8.0, "min_climb_ft": 2000.0, "route_type": "point_to_point", "region": "maine", "shelter": True, "unsupported": "crowds"}, {"nights": 2},
    ]


def test_ring_counts_its_edge_as_inside(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]))
    got = values(spark, [(2.0, 2.0), (0.0, 1.0), (4.0, 4.0), (5.0, 2.0), (2.0, -1.0)], spatial.in_ring(F.col("x"), F.col("y"), ring), schema="x double, y double")
    assert [g[0] for g in got] == [True, True, True, False, False]


def test_within_is_inclusive_and_crosses_cells(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 99.0, 0.0)], "id long, x_m double, y_m double")
    features = spark.createDataFrame([(7, 0.0, 100.0), (8, 100.5, 0.0), (9, -0.5, -0.5)], "fid long, x_m double, y_m double")
    got = {(r.id, r.fid) for r in spatial.within(points, features, 100.0).collect()}
    assert got == {(1, 7), (1, 9), (2, 8), (2, 9)}


def test_nearest_k_goes_on_to_the_whole_radius(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x_m double, y_m double")
    features = spark.createDataFrame([(7, 700.0, 0.0), (8, 10.0, 0.0), (9, 10.0, 0.0), (6, 900.0, 0.0)], "fid long, x_m double, y_m double")
    got = [(r.fid, r.rank) for r in spatial.nearest_k(points, features, "id", "fid", 3, 800.0).orderBy("rank").collect()]
    assert got == [(8, 1), (9, 2), (7, 3)]
    assert spatial.nearest_k(points, features.limit(0), "id", "fid", 3, 800.0).count() == 0


def test_pieces_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.piece for r in graph.pieces(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_reach_prefers_the_first_name_on_a_tie(spark):
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (3, 4, 5.0)], "u long, v long, m double")
    heads = spark.createDataFrame([(1, "b"), (3, "a")], "node long, source string")
    got = {r.node: (r.cost, r.source) for r in graph.reach(graph.both_ways(edges, F.col("m"), F.col("m")), heads).collect()}
    assert got == {1: (0, "b"), 2: (5, "a"), 3: (0, "a"), 4: (5, "a")}


def test_ways_are_cut_where_they_meet(spark):
    rows = [(1, 1, 10, 0.0, 0.0), (1, 2, 11, 3.0, 4.0), (1, 3, 12, 6.0, 8.0), (2, 1, 11, 3.0, 4.0), (2, 2, 13, 3.0, 5.0)]
    vertices = spark.createDataFrame(rows, "way_id long, pos int, node_id long, x_m double, y_m double")
    got = {(r.way_id, r.u, r.v, r.length_m) for r in graph.cut_ways(vertices).collect()}
    assert got == {(1, 10, 11, 5.0), (1, 11, 12, 5.0), (2, 11, 13, 1.0)}


def test_stops_are_the_best_of_all_choices(spark):
    climb = lambda m: m * m / 60000.0 / 20
    options = [(1, i, float(4000 + 1700 * i), climb(4000 + 1700 * i), None if i % 7 == 0 else float(i * 37 % 100), i % 5 != 0) for i in range(30)]
    # The second plan has no permitted option for its first night.
    options += [(2, i, float(30000 + 900 * i), climb(30000 + 900 * i), 60.0, True) for i in range(20)]
    table = spark.createDataFrame(options, "plan_id long, option_id long, along_m double, climb_m double, score double, permitted boolean")
    got = {r.plan_id: r for r in best_stops(table, 60000.0, 3000.0, 2).collect()}

    def day(a, b, nights):
        high = climb(b) - climb(a)
        return ((b - a - nights * 20000) / (nights * 20000)) ** 2 + 0.5 * ((high - nights * 1000) / max(nights * 1000, nights * 100)) ** 2

    short = lambda o: 0.3 * (100 - (50 if o[4] is None else o[4])) / 100
    inside = lambda plan, k: [o for o in options if o[0] == plan and o[5] and abs(o[2] - k * 20000) <= 6000]
    best = min(day(0, a[2], 1) + day(a[2], b[2], 1) + day(b[2], 60000, 1) + short(a) + short(b) for a in inside(1, 1) for b in inside(1, 2))
    assert abs(got[1].cost - best) < 1e-6 and got[1].nights == 2
    best = min(day(0, b[2], 2) + day(b[2], 60000, 1) + short(b) for b in inside(2, 2))
    assert not inside(2, 1) and abs(got[2].cost - best) < 1e-6 and got[2].nights == 1


def test_spread_keeps_the_best_apart(spark):
    ordered = [(-9.0, 1, 100.0), (-8.0, 2, 500.0), (-7.0, 3, 950.0), (-6.0, 4, 2000.0)]
    got = values(spark, [(ordered,)], spread(F.col("c"), 805.0, 2), schema="c array<struct<b:double,site_id:bigint,along_m:double>>")
    assert [k.site_id for k in got[0][0]] == [1, 3]


def test_a_part_is_attached_in_the_order_of_length():
    parts = [(1, 0.0, 0.0, 100.0, 0.0, 100.0), (2, 130.0, 0.0, 190.0, 0.0, 60.0), (3, 105.0, 0.0, 125.0, 0.0, 20.0), (4, -5.0, 0.0, -45.0, 0.0, 40.0), (5, 900.0, 0.0, 930.0, 0.0, 30.0)]
    # The second longest is within 50 m of the end, although a shorter one is nearer; the last is too far from all.
    assert stitched(parts) == [(4, True), (1, False), (2, False)]


def test_routes_go_through_the_cheapest_nodes(spark):
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (1, 3, 20.0), (3, 4, 1.0), (8, 9, 1.0)], "u long, v long, m double")
    legs = spark.createDataFrame([(0, 1, 4), (1, 4, 4), (2, 1, 9)], "leg int, start long, goal long")
    got = {r.leg: (r.cost, r.path) for r in graph.routes(graph.both_ways(edges, F.col("m"), F.col("m")), legs).collect()}
    assert got == {0: (11.0, [1, 2, 3, 4]), 1: (0.0, [4])}


def test_nearest_goes_as_far_as_it_must(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 50000.0, 0.0)], "id long, x_m double, y_m double")
    features = spark.createDataFrame([(k, float(k), 1.0) for k in range(40)] + [(99, 90000.0, 0.0)], "fid long, x_m double, y_m double")
    got = sorted((r.id, r.fid, r.rank) for r in spatial.nearest_k(points, features, "id", "fid", 2).collect())
    assert got == [(1, 0, 1), (1, 1, 2), (2, 39, 2), (2, 99, 1)]


def test_segments_are_found_in_every_cell_they_cross(spark):
    rng = random.Random(4)
    points = [(k, rng.uniform(0, 4000), rng.uniform(0, 4000)) for k in range(60)]
    lines = [(k, *(rng.uniform(0, 4000) for _ in range(4))) for k in range(60)] + [(99, 100.0, 100.0, 100.0, 100.0)]
    got = {(r.id, r.way) for r in spatial.near_segments(spark.createDataFrame(points, "id long, x_m double, y_m double"), spark.createDataFrame(lines, "way long, ax double, ay double, bx double, by double"), 150.0).collect()}

    def off(x, y, ax, ay, bx, by):
        square = (bx - ax) ** 2 + (by - ay) ** 2
        t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / square)) if square else 0
        return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    assert got == {(i, w) for i, x, y in points for w, *line in lines if off(x, y, *line) <= 150}


def test_rules_of_the_first_region_decide(spark):
    rows = [
        # x, y, type, gate, land, feet, basis, trail, water
        (50.0, 70000.0, "backcountry", "unknown", "NATION_2", 4060, None, None, None), (50.0, 70000.0, "backcountry", "unknown", "NATION_2", 4060, "listed", None, None),
        (50.0, 70000.0, "lean_to", "unknown", "NATION_2", 3600, "a lean-to", None, None), (50.0, 70000.0, "backcountry", "unknown", "NATION_2", 3600, None, None, None),
        (50.0, 70000.0, "backcountry", "unknown", "NATION_7", None, "listed", None, None), (50000.0, 20000.0, "backcountry", "unknown", "NATION_3", 100, None, 5.0, None),
        (50000.0, 20000.0, "backcountry", "unknown", "NATION_1", 100, None, 40.0, None), (50000.0, 20000.0, "backcountry", "unknown", "NATION_1", 100, None, 70.0, 10.0),
        (50000.0, 20000.0, "backcountry", "unknown", "NATION_9", 100, None, 5.0, 80.0), (50000.0, 20000.0, "backcountry", "not_permitted", "NATION_9", 100, "listed", None, None), (5.0, 5.0, "lean_to", "unknown", "", 100, "a lean-to", None, None),
    ]
    sites = spark.createDataFrame(rows, "x_m double, y_m double, site_type string, gate string, land_names string, elevation_ft long, basis string, trail_m double, water_m double").withColumn("region", region_at())
    said = F.struct(F.lit("unknown").alias("verdict"), F.lit("no_rules").alias("reason"))
    for region in REGIONS:
        said = F.when(F.col("region") == region["id"], decide(region)).otherwise(said)
    got = [tuple(r) for r in sites.select(said.alias("s")).select("s.*").collect()]
    assert got == [
        ("not_permitted", "all_4000"), ("unknown", "all_4000"), ("permitted", "designated"), ("not_permitted", "peaks_3500"), ("unknown", "no_elevation"), ("not_permitted", "scenic"),
        ("unknown", "trail_200"), ("unknown", "trail_200_margin"), ("unknown", "undesignated"), ("unknown", "closed"), ("unknown", "no_rules"),
    ]


def test_standing_for_a_minute_is_a_stop(spark):
    walk = [(t, 0.0 if t <= 100 else float(t - 100) * 2, 0.0) for t in range(0, 181, 10)]
    got = values(spark, [(walk,)], moving(F.col("t")), schema="t array<struct<t_s:bigint,x_m:double,y_m:double>>")
    assert (got[0][0].moving_s, got[0][0].stops) == (80, 1)


def test_rings_are_cut_to_a_box(spark):
    hexagon = [(0, 2, 0.0), (1, 4, 0.0), (2, 5, 2.0), (3, 4, 4.0), (4, 2, 4.0), (5, 1, 2.0)]
    corners = spark.createDataFrame([(7, i, float(x), y) for i, x, y in hexagon], "key int, i int, x double, y double")
    areas = {r.key: r.area for r in ring_areas(clip_rings(corners, "key", (2.0, 1.0), (9.0, 3.0)), "key").collect()}
    # Between x = 2 and the two sloping sides, whose middle is at x = 5.
    assert math.isclose(areas[7], 2 * 2 + 2 * 0.75, rel_tol=1e-9)
    assert not clip_rings(corners, "key", (6.0, 0.0), (9.0, 3.0)).collect()


def test_rounded_is_sqls_round(spark, duck):
    data = [(x,) for x in (125.64999999999999, 125.65, 0.05, -2.25, 103.94999999999999, 0.0, 7.0)]
    got = [v for (v,) in values(spark, data, curves.rounded(F.col("x"), 1), schema="x double")]
    assert got == [duck.sql(f"SELECT round({x!r}::DOUBLE, 1)").fetchall()[0][0] for (x,) in data]
    assert got[0] == 125.7


def test_nearest_segment_by_rings(spark):
    """As brute force has it, ties by number and own ways left out, while the first ring of dense ways holds few of them."""
    rnd = random.Random(5)
    points = [(k, k % 7, rnd.uniform(0, 1000), rnd.uniform(0, 1000)) for k in range(60)] + [(60, 0, 5000.0, 5000.0), (61, 1, 500.0, 5000.0)]
    lines = [(k, k % 7, *(rnd.uniform(0, 1000) for _ in range(4))) for k in range(300)]
    lines += [(400 + k, own, *rest) for k, (_, own, *rest) in enumerate(lines[:40])]

    def off(p, s):
        (x, y), (ax, ay, bx, by) = p, s
        t = min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    want = {}
    for k, own, *p in points:
        best = min((round(off(p, s), 6), way) for way, theirs, *s in lines if theirs != own)
        if best[0] <= 4500:
            want[k] = best[1]
    a, b = spark.createDataFrame(points, "id long, own long, x_m double, y_m double"), spark.createDataFrame(lines, "way long, theirs long, ax double, ay double, bx double, by double")
    first = F.min_by("way", F.struct(F.round("distance_m", 6), "way")).alias("way")
    got = {r.id: r.way for r in spatial.nearest_segment(a, b, ["id"], 4500.0, first, apart=F.col("own") != F.col("theirs")).collect()}
    assert got == want and 61 in got
    assert spatial.nearest_segment(a, b.limit(0), ["id"], 4500.0, first).count() == 0
    length = sum(math.dist(s[2:4], s[4:6]) for s in lines)
    assert spatial._segment_radius(len(lines), length, 1e6, 1000.0) < 20


def test_dots_are_points(spark):
    features = spark.createDataFrame([(1, 30.0, 40.0), (2, 0.0, 60.0)], "fid long, x_m double, y_m double")
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x_m double, y_m double")
    assert [tuple(r) for r in spatial.segment_distance(points, spatial.dots(features), "id", 50.0).collect()] == [(1, 50.0)]
