"""What the reviews of round 4 found."""

import random
from math import sqrt

import pytest
from pyspark.sql import functions as F

from cairnpath.llm import components, exact_dedup, mixing, simhash
from cairnpath.operators import nearest, pairs
from cairnpath.plans import registry, terrain, trips


def test_deviation_looks_at_the_whole_kilometre(spark, monkeypatch):
    """deviation (F33): windows of 33 cells, over tiles, holes and ends of the data; equal ground has none."""
    draw = random.Random(2)
    z = {(x, y): draw.choice([0.1, 3.0, 7.5, float(x)]) for x in range(-20, 60) for y in range(-5, 45) if draw.random() > 0.1}
    z |= {(500 + x, y): 0.1 for x in range(3) for y in range(3)}
    rows = [(*k, h) for k, h in z.items()] + [(200, 200, None)]
    monkeypatch.setattr(terrain, "load", lambda *_: spark.createDataFrame(rows, "ix long, iy long, z double"))
    got = {(r.ix, r.iy): (r.dev, r.percentile) for r in terrain.deviation(spark, "").collect()}
    assert got.keys() == z.keys() and got[501, 1] == (None, 0.0)
    for x, y in draw.sample(sorted(z), 150):
        near = [h for (a, b), h in z.items() if abs(a - x) <= 16 and abs(b - y) <= 16]
        mean = sum(near) / len(near)
        spread = sqrt(sum((h - mean) ** 2 for h in near) / len(near))
        if spread > 1e-9:
            assert got[x, y] == (pytest.approx((z[x, y] - mean) / spread, abs=1e-4), pytest.approx(100 * sum(h < z[x, y] for h in near) / len(near), abs=1e-4))


def test_bridges_are_sought_from_all_ends(spark, data):
    """near_miss_bridges (F34): ends with an even node were left out."""
    ends = registry.queries()["near_miss_bridges"](spark, data).select(F.col("end_way").alias("way_id"), F.col("end_pos").alias("pos"))
    nodes = ends.join(trips.load(spark, data, "vertices").withColumn("pos", F.col("pos").cast("long")), ["way_id", "pos"]).select((F.col("node_id") % 2).alias("odd")).distinct()
    assert {r.odd for r in nodes.collect()} == {0, 1}


def test_fingerprints_of_a_small_file_are_not_sent_to_all_executors(spark, tmp_path, monkeypatch):
    """pipeline (F1), op5 (F2): keys that an explode made were sized by the file of fingerprints, and sent by way of the driver."""
    seen, real = [], simhash.durable
    monkeypatch.setattr(simhash, "durable", lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    monkeypatch.setattr(components, "durable", simhash.durable)
    docs = spark.createDataFrame([(k, " ".join(str((k % 20) * 7 + j % 30) for j in range(60)) + ("" if k % 3 else " more")) for k in range(60)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for df in (simhash.near_groups(docs), simhash.drop_near_copies(docs), mixing.in_mixed_order(docs.withColumn("source", F.lit("a"))), exact_dedup.drop_copies(docs)):
        assert df.count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        seen.append("" if "ranks" in plan else plan)
    assert len(seen) > 8 and not [p for p in seen if "BroadcastHashJoin" in p.replace("BroadcastHashJoin [name", "")]


def off(x, y, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    t = min(1.0, max(0.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2)


@pytest.mark.parametrize("part, metres, apart", [(1 << 19, 9000.0, False), (20, 400.0, False), (1 << 19, 700.0, True)])
def test_nearest_lines_equal_loops(spark, monkeypatch, part, metres, apart):
    """trail_factor (F8), nearest_segment (F28) and others: lines that cross tiles without a vertex there, points far from all, crowded tiles."""
    monkeypatch.setattr(nearest, "PART", part)
    draw, rows = random.Random(6), []
    for way in range(60):
        x, y = draw.uniform(-3000, 9000), draw.uniform(0, 12000)
        for pos in range(1, draw.randrange(2, 9)):
            rows.append((way, pos, x, y))
            x, y = x + draw.choice([0, draw.uniform(-6000, 6000)]), y + draw.uniform(-4000, 4000)
    spots = [(k, k % 60, draw.uniform(-9000, 17000), draw.uniform(-9000, 17000)) for k in range(400)] + [(500, 0, None, 1.0)]
    points, ways = spark.createDataFrame(spots, "id long, own long, x_m double, y_m double"), spark.createDataFrame(rows, "way_id long, pos int, x_m double, y_m double")
    segs = [(a[0], a[1], *a[2:], *b[2:]) for a, b in zip(rows, rows[1:]) if a[0] == b[0]]
    want = {}
    for k, own, x, y in spots[:-1]:
        best = min((off(x, y, *s), way, pos) for way, pos, *s in segs if not apart or way != own)
        if best[0] <= metres:
            want[k] = best
    first = F.min(F.struct(F.round("distance_m", 6), "way_id", "pos", "before_m", "way_m", "length_m", "t")).alias("b")
    got = {r.id: r for r in nearest.nearest_line(points, nearest.lines_of(ways), ["id", "own"], metres, first, apart=("own", "way_id") if apart else None).collect()}
    assert {k: r.b[1:3] for k, r in got.items()} == {k: w[1:] for k, w in want.items()} and len(got) > 50
    along = {(r.way_id, r.pos): r for r in trips.spatial.segments(ways).collect()}
    for k, r in got.items():
        s = along[r.b.way_id, r.b.pos]
        assert r.least_m == pytest.approx(want[k][0]) and (r.b.before_m, r.b.way_m, r.b.length_m) == pytest.approx((s.before_m, s.way_m, s.length_m))


def test_nearest_dots_equal_loops(spark):
    """nearest_k_perennial (F14), nearest_water (F15), site_water_score (F18): dense along a line, points far from it, ties by number."""
    draw = random.Random(7)
    dots = [(k, 7000.0 + draw.randrange(300), draw.randrange(900) / 3) for k in range(3000)] + [(9000 + k, 90000.0, 5.0 * k) for k in range(2)]
    spots = [(k, draw.uniform(0, 99000), draw.uniform(-30000, 30000)) for k in range(120)]
    points, features = spark.createDataFrame(spots, "id long, x_m double, y_m double"), spark.createDataFrame(dots, "fid long, x_m double, y_m double")
    for k, metres in ((3, None), (1, 20000.0)):
        want = {i: [f for d, f in sorted((off(x, y, fx, fy, fx, fy), f) for f, fx, fy in dots)[:k] if metres is None or d <= metres] for i, x, y in spots}
        got = {i: [] for i, *_ in spots}
        for r in sorted(trips.spatial.nearest_k(points, features, "id", "fid", k, metres).collect(), key=lambda r: r["rank"]):
            got[r.id].append(r.fid)
        assert got == want


def test_pairs_of_points_and_lines_are_not_shuffled(spark, data):
    plan = registry.queries()["nearest_segment"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "cell_x" not in plan


@pytest.mark.parametrize("part", [7, 1 << 17])
def test_counts_and_nearest_ways_equal_loops(spark, monkeypatch, part):
    """sites_within_2km (F7), snap_candidates (F20), user_points_near (F21)."""
    monkeypatch.setattr(pairs, "PART", part)
    draw, rows = random.Random(8), []
    for way in range(50):
        x, y = draw.uniform(-6000, 14000), draw.uniform(-6000, 14000)
        for pos in range(1, draw.randrange(2, 8)):
            rows.append((way, pos, x, y))
            x, y = x + draw.uniform(-3000, 3000), y + draw.uniform(-3000, 3000)
    spots = [(k, draw.uniform(-9000, 17000), draw.uniform(-9000, 17000)) for k in range(200)]
    points, ways = spark.createDataFrame(spots, "site_id long, x_m double, y_m double"), spark.createDataFrame(rows, "way_id long, pos int, x_m double, y_m double")
    far = {}
    for a, b in zip(rows, rows[1:]):
        if a[0] == b[0]:
            for k, x, y in spots:
                d = off(x, y, *a[2:], *b[2:])
                if d <= 2000:
                    far[k, a[0]] = min(d, far.get((k, a[0]), d))
    want = {}
    for (k, way), d in far.items():
        n, least, first = want.get(way, (0, d, k))
        want[way] = (n + 1, min(least, d), min(first, k))
    got = {r.way_id: (r.points, r.least_m, r.first_id) for r in pairs.near_counts(points, trips.spatial.segments(ways), ways, "site_id", 2000.0).collect()}
    assert got == {w: (n, pytest.approx(d), k) for w, (n, d, k) in want.items()} and len(got) > 20
    near = {}
    for r in nearest.nearest_ways(points, nearest.lines_of(ways), "site_id", "way_id", 3, 2000.0).collect():
        near.setdefault(r.site_id, []).append((r.d, r.way_id))
    best = {}
    for (k, way), d in far.items():
        best.setdefault(k, []).append((d, way))
    assert {k: [w for _, w in sorted(v)[:3]] for k, v in near.items()} == {k: [w for _, w in sorted(v)[:3]] for k, v in best.items()}


def test_no_pairs_of_sites_and_ways_are_shuffled(spark, data):
    for name in ("sites_within_2km", "user_points_near", "snap_candidates"):
        plan = registry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "cell_x" not in plan and "MapInArrow" in plan, name
