"""Routes over cells against a search of the whole graph."""

import heapq
import random

from cairnpath.operators import overlay
from cairnpath.plans import registry
from cairnpath.sources.fixtures import load


def least(edges, start):
    near, done, queue = {}, {}, [(0, start)]
    for a, b, c in edges:
        near.setdefault(a, []).append((b, c))
    while queue:
        cost, node = heapq.heappop(queue)
        if node not in done:
            done[node] = cost
            for other, step in near.get(node, ()):
                heapq.heappush(queue, (cost + step, other))
    return done


def test_routes_on_a_graph_of_one_way_steps(spark):
    """A torn lattice in cells of 4 x 4, steps that cost more one way than the other, legs within a cell, through others and without a way."""
    draw, n = random.Random(9), 13
    edges = [(y * n + x, (y + dy) * n + x + dx, draw.randrange(1, 30)) for y in range(n) for x in range(n) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1)) if 0 <= x + dx < n and 0 <= y + dy < n and draw.random() < 0.8]
    edges += [(500, 501, 3)]
    cells = [(y * n + x, y // 4 * 10 + x // 4) for y in range(n) for x in range(n)] + [(500, 99), (501, 99)]
    pairs = [(0, n * n - 1), (5, 5), (1, 2), (n * n - 1, 0), (3, 160), (0, 500), (500, 501), (501, 500), (14, 31), (2, 7)]
    made = overlay.build(spark.createDataFrame(edges, "src long, dst long, cost long"), spark.createDataFrame(cells, "node long, cell long"))
    found = overlay.routes(made, spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "leg int, start long, goal long"))
    got = {r.leg: r.cost for r in found.collect()}
    want = {k: cost for k, (a, b) in enumerate(pairs) if (cost := least(edges, a).get(b)) is not None}
    assert got == want
    lines = {}
    for r in overlay.nodes_of(made, found).collect():
        lines.setdefault(r.leg, []).append((r.k, r.node))
    price = {(a, b): c for a, b, c in edges}
    for leg, line in lines.items():
        nodes = [node for _, node in sorted(line)]
        assert [k for k, _ in sorted(line)] == list(range(len(nodes)))
        assert (nodes[0], nodes[-1]) == pairs[leg]
        assert sum(price[s] for s in zip(nodes, nodes[1:], strict=False)) == want[leg]
    assert set(lines) == set(want)


def test_route_lines_cost_what_routes_do(spark, data):
    z = {r.iy * 50 + r.ix: r.z for r in load(spark, data, "grid").filter("z IS NOT NULL").collect()}
    lines = {}
    for r in registry.queries()["ground_route_lines"](spark, data).collect():
        lines.setdefault(r.leg, []).append((r.k, r.node))
    costs = {r.leg: r.cost for r in registry.queries()["ground_routes"](spark, data).filter("kind = 'naismith'").collect()}
    assert set(lines) == set(costs) and costs
    for leg, line in lines.items():
        nodes, total = [node for _, node in sorted(line)], 0
        for a, b in zip(nodes, nodes[1:], strict=False):
            dx, dy = abs(a % 50 - b % 50), abs(a // 50 - b // 50)
            assert max(dx, dy) == 1
            total += round((dx + dy) ** 0.5 * 30 / 5000 * 3_600_000 + max(z[b] - z[a], 0) / 600 * 3_600_000)
        assert total == costs[leg]


def test_rounds_go_with_levels_not_with_the_length_of_a_strip(spark):
    draw, rows = random.Random(4), 192
    edges = [(y * 2 + x, (y + dy) * 2 + x + dx, draw.randrange(1, 30)) for y in range(rows) for x in range(2) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= x + dx < 2 and 0 <= y + dy < rows]
    made = overlay.build(spark.createDataFrame(edges, "src long, dst long, cost long"), spark.createDataFrame([(k, k // 8) for k in range(2 * rows)], "node long, cell long"))
    assert len(made.graphs) <= 4
    found = overlay.routes(made, spark.createDataFrame([(0, 0, 2 * rows - 1)], "leg int, start long, goal long"))
    assert found.first().cost == least(edges, 0)[2 * rows - 1]
    assert overlay.nodes_of(made, found).count() >= rows
