"""What the later findings of round 3 asked for: rounds that don't make their input again, with the same rows."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from cairnpath.operators import graph
from cairnpath.plans import registry, terrain
from test_queries import flooded, test_sinks_and_wetness as holds_for_sinks_and_wetness


@pytest.fixture
def counted(spark):
    """Directed edges of a graph with many ties, and how many rows of them were made."""
    draw, made = random.Random(5), spark.sparkContext.accumulator(0)
    edges = sorted({(draw.randrange(40), draw.randrange(40), float(draw.randrange(1, 4))) for _ in range(160)})
    count = F.udf(lambda x: (made.add(1), x)[1], "double").asNondeterministic()
    df = spark.createDataFrame(edges, "src long, dst long, cost double").withColumn("cost", count("cost"))
    return df, edges, made


def best_paths(edges, start):
    near, done, queue = {}, {}, [(0.0, [start])]
    for a, b, cost in edges:
        near.setdefault(a, []).append((b, cost))
    while queue:
        cost, path = heapq.heappop(queue)
        if path[-1] not in done:
            done[path[-1]] = (cost, path)
            for b, step in near.get(path[-1], ()):
                heapq.heappush(queue, (cost + step, [*path, b]))
    return done


def test_reach_makes_its_edges_once(spark, counted):
    """shortest_times (F38), reach_from_trailheads (F35), graph_comparison (F28)."""
    df, edges, made = counted
    got = {r.node: (r.cost, r.source) for r in graph.reach(df, spark.createDataFrame([(0, "b"), (7, "a")], "node long, source string")).collect()}
    one, other = best_paths(edges, 0), best_paths(edges, 7)
    assert got == {n: min((p[n][0], s) for p, s in ((one, "b"), (other, "a")) if n in p) for n in {*one, *other}}
    assert made.value == len(edges)


def test_routes_make_their_edges_once_and_carry_paths_on_the_way_alone(spark, counted):
    """multi_leg_route (F31), route_totals (F30)."""
    df, edges, made = counted
    legs = [(k, start, goal) for k, (start, goal) in enumerate([(0, 33), (7, 21), (12, 12), (39, 3), (5, 999)])]
    got = {r.leg: (r.cost, r.path) for r in graph.routes(df, spark.createDataFrame(legs, "leg int, start long, goal long")).collect()}
    assert got == {k: best_paths(edges, a)[b] for k, a, b in legs if b in best_paths(edges, a)}
    assert made.value == len(edges)


def test_requests_are_dealt_out_and_read_by_few_expressions(spark, data):
    """request_parse (F33): a small file isn't one task, and phrases are sought by one pattern a list, not one by one for each word."""
    plan = registry.queries()["request_parse"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(p_partkey" in plan
    assert "exists(" not in plan


def test_sinks_and_wetness_over_small_tiles(spark, monkeypatch):
    """sink_depths (F39), wetness (F36): the same whatever the tiles are."""
    monkeypatch.setattr(terrain, "TILE", 7)
    holds_for_sinks_and_wetness(spark)


def test_rounds_go_with_tiles_and_not_with_cells(spark, monkeypatch):
    """A valley of 60 cells between walls, which runs off at its end: few tables, where each cell took two."""
    rows = [(x, y, float(x) if y == 2 and x else 1000.0 + x) for x in range(61) for y in range(5)]
    rows[2] = (0, 2, 0.5)
    grid = spark.createDataFrame(rows, "ix long, iy long, z double").hint("merge")
    wrote, real = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: wrote.append(1) or real(df))
    monkeypatch.setattr(terrain, "load", lambda *_: grid)
    z = {(x, y): h for x, y, h in rows}
    level = flooded(z)
    assert {(r.ix, r.iy): r.level for r in terrain.filled_grid(grid).collect()} == level
    assert len(wrote) <= 4
    got = {(r.ix, r.iy): r.cells for r in terrain.wetness(spark, "").collect()}
    assert got[0, 2] >= 60  # the whole valley and its walls
    assert len(wrote) <= 16
