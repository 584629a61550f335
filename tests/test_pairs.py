"""All pairs of what meets: the same as by loops, whatever the parts, and no shuffle of pairs."""

import random
from math import floor, sqrt

import pytest

from cairnpath.operators import pairs, spatial
from cairnpath.plans import registry


@pytest.fixture
def ways(spark):
    """Ways over several tiles, also to the left of and under zero: long ones, upright ones, some with a place twice or without coordinates."""
    draw, rows = random.Random(3), []
    for way in range(40):
        x, y = draw.uniform(-6000, 14000), draw.uniform(-6000, 14000)
        for pos in range(1, draw.randrange(2, 9)):
            rows.append((way, pos, x, y) if draw.random() > 0.05 else (way, pos, None, None))
            step = draw.choice([0, 300, 3000, 15000])
            x, y = x + draw.choice([0, draw.uniform(-step, step)]), y + draw.uniform(-step, step)
    return spark.createDataFrame(rows, "way_id long, pos int, x_m double, y_m double")


def by_way(ways):
    found = {}
    for r in sorted(spatial.segments(ways).collect(), key=lambda r: (r.way_id, r.pos)):
        if None not in (r.ax, r.ay, r.bx, r.by):
            found.setdefault(r.way_id, []).append(r)
    return found


@pytest.mark.parametrize("part", [7, 1 << 17])
def test_near_ways_equals_loops(spark, ways, monkeypatch, part):
    """sites_along_ways (F7)."""
    monkeypatch.setattr(pairs, "PART", part)
    draw = random.Random(4)
    spots = [(k, draw.uniform(-9000, 17000), draw.uniform(-9000, 17000)) for k in range(300)] + [(400, None, 1.0), (401, 10000.0, 10000.0), (401, 10000.0, 10000.0)]
    points = spark.createDataFrame(spots, "site_id long, x_m double, y_m double")
    want, lines = {}, by_way(ways)
    for k, px, py in set(spots):
        for way, segs in lines.items() if px is not None else ():
            near = []
            for s in segs:
                dx, dy = s.bx - s.ax, s.by - s.ay
                t = min(1.0, max(0.0, ((px - s.ax) * dx + (py - s.ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
                ox, oy = px - (s.ax + t * dx), py - (s.ay + t * dy)
                near.append((floor(sqrt(ox * ox + oy * oy) * 1e6 + 0.5), s.pos, sqrt(ox * ox + oy * oy), s.before_m + t * s.length_m, s.way_m))
            off = min(n[2] for n in near)
            if off <= 800.0:
                best = min(n for n in near if n[2] <= 800.0)
                want[k, way] = (off, *best[3:])
    rows = pairs.near_ways(points, spatial.segments(ways), ways, "site_id", 800.0).collect()
    got = {(r.site_id, r.way_id): (r.off_m, r.along_m, r.way_m) for r in rows}
    assert len(rows) == len(got) == len(want) > 50
    assert {k: pytest.approx(v) for k, v in want.items()} == got


@pytest.mark.parametrize("part", [7, 1 << 17])
def test_crossings_equal_loops(spark, ways, monkeypatch, part):
    """way_crossings (F21)."""
    monkeypatch.setattr(pairs, "PART", part)
    segs, want = [s for v in by_way(ways).values() for s in v], {}
    for a in segs:
        for b in segs:
            ux, uy, vx, vy, wx, wy = a.bx - a.ax, a.by - a.ay, b.bx - b.ax, b.by - b.ay, b.ax - a.ax, b.ay - a.ay
            cross = ux * vy - uy * vx
            if a.way_id < b.way_id and cross:
                t, r = (wx * vy - wy * vx) / cross, (wx * uy - wy * ux) / cross
                if 1e-6 < t < 1 - 1e-6 and 1e-6 < r < 1 - 1e-6:
                    want[a.way_id, a.pos, b.way_id, b.pos] = (a.ax + t * ux, a.ay + t * uy)
    rows = pairs.crossings(spatial.segments(ways), ways).collect()
    got = {tuple(r)[:4]: tuple(r)[4:] for r in rows}
    assert len(rows) == len(got) == len(want) > 30
    assert got == want


def plan_of(spark, data, name):
    return registry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_pairs_of_sites_and_ways_are_not_shuffled(spark, data):
    """sites_along_ways (F7): pairs were dealt out and grouped, which went with the square of the tables."""
    plan = plan_of(spark, data, "sites_along_ways")
    assert "MapInArrow" in plan.split("Exchange")[0] and "SortMergeJoin" not in plan
    assert plan.count("hashpartitioning(l_orderkey") == 1 and "hashpartitioning(way_id" not in plan


def test_segments_are_dealt_out_once_for_crossings(spark, data):
    """way_crossings (F21): each segment was dealt out twice, in all cells of its box."""
    plan = plan_of(spark, data, "way_crossings")
    assert "MapInArrow" in plan.split("Exchange")[0] and "SortMergeJoin" not in plan
    assert plan.count("hashpartitioning(l_orderkey") == 1 and "hashpartitioning(way_id" not in plan
