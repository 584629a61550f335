"""Every registered query with SQL gives DuckDB's rows; those without run and give rows."""

import heapq
import math
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from compare import rows
from cairnpath.plans import registry

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, data, name):
    got = registry.queries()[name](spark, data).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) > 0
        return
    assert rows(got) == rows(duck.sql(sql).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(registry.oracle_sql()) <= set(__spark_entry__.oracle_sql())


def test_near_joins_are_equi_joins(spark, data):
    for name in ("site_water_score", "nearest_segment", "way_stretches", "land_at_site"):
        plan = registry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan.replace("BroadcastNestedLoopJoin BuildRight, Cross", ""), name


def cells(spark, sf):
    from cairnpath.sources.fixtures import load

    return {(r.ix, r.iy): r.z for r in load(spark, sf, "grid").filter("z IS NOT NULL").collect()}


def ring(x, y):
    return [(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]


def flooded(z):
    """Levels by a queue from the edge inwards, the lowest way out first."""
    level, queue = {}, [(h, c) for c, h in z.items() if any(n not in z for n in ring(*c))]
    level.update((c, h) for h, c in queue)
    heapq.heapify(queue)
    while queue:
        h, c = heapq.heappop(queue)
        for n in ring(*c):
            if n in z and n not in level:
                level[n] = max(z[n], h)
                heapq.heappush(queue, (level[n], n))
    return level


def test_sinks_and_wetness(spark):
    sf = "/root/testdata/sf0.01"
    z = cells(spark, sf)
    level = flooded(z)
    assert {(r.ix, r.iy): r.depth_m for r in registry.queries()["sink_depths"](spark, sf).collect()} == {c: level[c] - z[c] for c in z}
    to, fall = {}, {}
    for c, h in level.items():
        steps = [((h - level[n]) / (30 * math.hypot(n[0] - c[0], n[1] - c[1])), n) for n in ring(*c) if n in level]
        fall[c], to[c] = max(steps)
    area = dict.fromkeys(level, 1)
    for c in sorted(level, key=lambda c: -level[c]):
        if fall[c] > 0:
            area[to[c]] += area[c]
    got = {(r.ix, r.iy): (r.cells, r.twi) for r in registry.queries()["wetness"](spark, sf).collect()}
    assert {c: g[0] for c, g in got.items()} == area
    assert all(abs(g[1] - math.log(area[c] * 30 / max(fall[c], 0.000174532925))) < 1e-3 for c, g in got.items())


def ways(spark, data):
    from cairnpath.sources.fixtures import load

    out = {}
    for r in load(spark, data, "vertices").orderBy("way_id", "pos").collect():
        out.setdefault(r.way_id, []).append((r.x_m, r.y_m, r.pos))
    return out


def off_line(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = min(1, max(0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def test_simplified_ways_keep_to_the_tolerance(spark, data):
    def thin(line):
        if len(line) < 3:
            return line
        far = [off_line(p, line[0], line[-1]) for p in line[1:-1]]
        if max(far) <= 500:
            return [line[0], line[-1]]
        k = far.index(max(far)) + 1
        return thin(line[: k + 1]) + thin(line[k:])[1:]

    want = {(way, p[2]) for way, line in ways(spark, data).items() for p in (thin(line) if len(line) > 1 else line)}
    assert {(r.way_id, r.pos) for r in registry.queries()["simplified_ways"](spark, data).collect()} == want


def test_stitched_routes_are_walked_end_to_end(spark, data):
    lines, chains = ways(spark, data), {}
    for r in registry.queries()["stitched_routes"](spark, data).collect():
        chains.setdefault(r.route_id, []).append(r)
    for way, rows in chains.items():
        members = {p[2]: (p, q) for p, q in zip(lines[way], lines[way][1:], strict=False)}
        used = sorted((r.turn, r.member, r.reversed) for r in rows if r.turn is not None)
        assert [u[0] for u in used] == list(range(len(used))) and {r.member for r in rows} == set(members)
        placed = [members[m][::-1] if turned else members[m] for _, m, turned in used]
        assert all(math.hypot(a[1][0] - b[0][0], a[1][1] - b[0][1]) <= 50 for a, b in zip(placed, placed[1:], strict=False))
        # What is left out comes near neither end of the chain.
        ends = (placed[0][0], placed[-1][1])
        left = [members[r.member] for r in rows if r.turn is None]
        assert all(math.hypot(p[0] - e[0], p[1] - e[1]) > 50 for part in left for p in part for e in ends)


def test_walked_distance_is_what_a_loop_gives(spark, data):
    from cairnpath.sources.fixtures import load

    tracks = {}
    for r in load(spark, data, "fixes").orderBy("track_id", "t_s").collect():
        tracks.setdefault(r.track_id, []).append(r)
    want = {}
    for track, fixes in tracks.items():
        kept = []
        for f in fixes:
            if f.accuracy_m <= 35 and (not kept or ((f.x_m - kept[-1].x_m) ** 2 + (f.y_m - kept[-1].y_m) ** 2) ** 0.5 >= 5 or f.t_s - kept[-1].t_s >= 15):
                kept.append(f)
        if kept:
            anchor, metres = kept[0], 0.0
            for f in kept[1:]:
                far = ((f.x_m - anchor.x_m) ** 2 + (f.y_m - anchor.y_m) ** 2) ** 0.5
                if far >= 10:
                    metres += far if far / max(0.001, f.t_s - anchor.t_s) <= 7 else 0
                    anchor = f
            want[track] = round(metres, 3)
    assert {r.track_id: r.metres for r in registry.queries()["walked_distance"](spark, data).collect()} == want


def test_the_rest_works_without_the_training_text_part(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "cairnpath", tmp_path / "cairnpath", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; names = e.queries(); assert len(names) > 120 and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in names); assert set(e.oracle_sql()) <= set(names)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_growing_tables_are_not_sent_by_way_of_the_driver(spark, data):
    for name in ("nearest_water", "aspect", "deviation", "piece_sizes"):
        plan = registry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan, name
