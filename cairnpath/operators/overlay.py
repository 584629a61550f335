"""Shortest ways on a graph cut in cells, and cells of cells: what it costs to cross each is worked out once, as tables.

Cells are numbered so that four of them, cell >> 2, make the next larger one (as along a Z curve), up to one cell that all
edges are in. Nodes with an edge to another cell of a level are its borders. For each cell of each level a task works out
what it costs to get from border to border inside it, by the crossings of its four parts. A leg is sought from both ends at
once, in ever larger cells; its nodes are found by taking crossings apart again, level by level. So rounds go with the
levels, not with the way's length. Costs are whole numbers, so sums don't depend on their order. Between ways of the same
cost, in each cell the one whose last nodes come first by number is taken.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnpath.operators.graph import settled

SPAN = "cell long, src long, dst long, cost long, level long, src_rank long, dst_rank long"
FAR = np.iinfo(np.int64).max // 4


@dataclass
class Overlay:
    """cells (node, cell), ranks (node, rank: under which levels it is a border), graphs: by level, the edges and crossings (cell, src, dst, cost, level: of a crossing, -1 of an edge)."""

    cells: DataFrame
    ranks: DataFrame
    graphs: list[DataFrame]


def _near(edges: pd.DataFrame) -> tuple[dict, dict]:
    """Steps from each node and to each node: (other, level, cost)."""
    out: dict[int, list] = {}
    back: dict[int, list] = {}
    for a, b, cost, level in zip(*(edges[c].tolist() for c in ("src", "dst", "cost", "level")), strict=True):
        out.setdefault(a, []).append((b, level, cost))
        back.setdefault(b, []).append((a, level, cost))
    return out, back


def _costs(near: dict[int, list], seeds: dict[int, int]) -> dict[int, int]:
    """The least cost from nodes that have one to each that can be reached."""
    done: dict[int, int] = {}
    queue = [(cost, node) for node, cost in seeds.items()]
    heapq.heapify(queue)
    while queue:
        cost, node = heapq.heappop(queue)
        if node not in done:
            done[node] = cost
            for other, _, step in near.get(node, ()):
                if other not in done:
                    heapq.heappush(queue, (cost + step, other))
    return done


def _line(near: dict[int, list], done: dict[int, int], seeds: dict[int, int], node: int) -> tuple[int, list[tuple[int, int, int]]]:
    """The seed that a node is reached from, and the steps (node nearer to the seed, node, level), from the seed on; near leads towards it."""
    steps = []
    while seeds.get(node) != done[node]:
        other, level = min((other, level) for other, level, step in near[node] if other in done and done[other] + step == done[node])
        steps.append((other, node, level))
        node = other
    return node, steps[::-1]


def _crossings(level: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
        """What it costs to get from each border of a cell to each other one inside it, all pairs at once."""
        ranks = dict(zip(edges["src"], edges["src_rank"], strict=True)) | dict(zip(edges["dst"], edges["dst_rank"], strict=True))
        nodes = np.array(sorted(ranks), dtype=np.int64)
        rank = np.array([ranks[n] for n in nodes.tolist()], dtype=np.int64)
        cost = np.full((len(nodes), len(nodes)), FAR)
        np.minimum.at(cost, (np.searchsorted(nodes, edges["src"].to_numpy()), np.searchsorted(nodes, edges["dst"].to_numpy())), edges["cost"].to_numpy())
        for k in range(len(nodes)):
            np.minimum(cost, cost[:, k, None] + cost[k], out=cost)
        ends = np.flatnonzero(rank > level)
        a, b = np.nonzero((cost[np.ix_(ends, ends)] < FAR) & ~np.eye(len(ends), dtype=bool))
        a, b = ends[a], ends[b]
        return pd.DataFrame({"cell": key[0], "src": nodes[a], "dst": nodes[b], "cost": cost[a, b], "level": level, "src_rank": rank[a], "dst_rank": rank[b]})

    return run


def _ends(level: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, edges: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        """From each start in a cell to its borders, from these to each goal in it, and ways from one to the other where both are in it.

        hops holds (cost up to it, or left at it; node, next node, level) of each step, one after the other.
        """
        rows, (out, back) = [], _near(edges)
        ranks = dict(zip(edges["src"], edges["src_rank"], strict=True)) | dict(zip(edges["dst"], edges["dst_rank"], strict=True)) | dict(zip(seeds["node"], seeds["rank"], strict=True))
        for leg, own in seeds.groupby("leg"):
            sides = {}
            for last, side in own.groupby("last"):
                cost, hops = dict(zip(side["node"], side["cost"], strict=True)), dict(zip(side["node"], map(list, side["hops"]), strict=True))
                done = _costs(back if last else out, cost)

                def way(node: int, last: bool = last, cost: dict = cost, hops: dict = hops, done: dict = done) -> list[int]:
                    seed, steps = _line(out if last else back, done, cost, node)
                    new = [(done[b], b, a, lv) if last else (done[a], a, b, lv) for a, b, lv in steps]
                    new = [x for hop in (new[::-1] if last else new) for x in hop]
                    return new + hops[seed] if last else hops[seed] + new

                sides[bool(last)] = (cost, hops, done, way)
                rows += [(key[0], leg, bool(last), n, ranks[n], c, way(n)) for n, c in done.items() if ranks[n] > level]
            if len(sides) == 2:
                (_, _, done, way), (left, rest, _, _) = sides[False], sides[True]
                met = [(done[n] + left[n], n) for n in left if n in done]
                if met:
                    total, node = min(met)
                    tail = [total - x if k % 4 == 0 else x for k, x in enumerate(rest[node])]
                    rows.append((key[0], leg, None, node, -1, total, way(node) + tail))
        return pd.DataFrame(rows, columns=["cell", "leg", "last", "node", "rank", "cost", "hops"])

    return run


def _apart(key: tuple, edges: pd.DataFrame, hops: pd.DataFrame) -> pd.DataFrame:
    """Crossings of a cell as the steps of its parts."""
    rows, (out, back), found = [], _near(edges), {}
    for leg, at, a, b in zip(*(hops[c].tolist() for c in ("leg", "at", "src", "dst")), strict=True):
        if a not in found:
            found[a] = _costs(out, {a: 0})
        rows += [(leg, at + found[a][u], u, v, level) for u, v, level in _line(back, found[a], {a: 0}, b)[1]]
    return pd.DataFrame(rows, columns=["leg", "at", "src", "dst", "level"])


def _up(cell: str, level: int) -> Column:
    return F.shiftright(F.col(cell), 2 * level)


def build(directed: DataFrame, cells: DataFrame) -> Overlay:
    """directed (src, dst, cost: longs over 0) and cells (node, cell from 0 on), which must be small enough for a task -> the overlay."""
    at = lambda end: cells.select(F.col("node").alias(end), F.col("cell").alias(f"{end}_cell"))
    apart = F.expr("src_cell ^ dst_cell")
    # The first level whose cells hold both ends.
    meet = F.when(apart == 0, 0).otherwise(F.floor((F.length(F.bin(apart)) + 1) / 2)).cast("long")
    tagged = settled(directed.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", "cost", "src_cell", meet.alias("meet")))
    ranks = settled(tagged.select(F.col("src").alias("node"), "meet").union(tagged.select("dst", "meet")).groupBy("node").agg(F.max("meet").alias("rank")))
    end = lambda e: ranks.withColumnsRenamed({"node": e, "rank": f"{e}_rank"})
    ranked = settled(tagged.join(end("src"), "src").join(end("dst"), "dst"))
    most = ranked.agg(F.max("meet")).first()[0] or 0
    names, graphs, crossed = [c.split()[0] for c in SPAN.split(", ")], [], None
    for level in range(most + 1):
        edges = ranked.filter(F.col("meet") == level).withColumns({"cell": _up("src_cell", level), "level": F.lit(-1).cast("long")}).select(*names)
        graphs.append(edges if crossed is None else edges.union(crossed.withColumn("cell", _up("cell", 1))))
        if level < most:
            crossed = settled(graphs[-1].groupBy("cell").applyInPandas(_crossings(level), SPAN))
    return Overlay(cells, ranks, graphs)


def routes(overlay: Overlay, legs: DataFrame) -> DataFrame:
    """Legs (leg, start, goal) -> leg, cost, end (the goal) and hops, crossings and edges on the way. Legs without a way have no row."""
    ends = legs.select("leg", F.inline(F.array(F.struct(F.col("start").alias("node"), F.lit(False).alias("last")), F.struct(F.col("goal").alias("node"), F.lit(True).alias("last")))))
    seeds = ends.join(overlay.cells, "node").join(overlay.ranks, "node", "left")
    seeds = seeds.select("cell", F.col("leg").cast("long").alias("leg"), "last", "node", F.coalesce("rank", F.lit(0)).alias("rank"), F.lit(0).cast("long").alias("cost"), F.array().cast("array<long>").alias("hops"))
    whole = None
    for level, graph in enumerate(overlay.graphs):
        keyed = seeds.withColumn("cell", _up("cell", 1)) if level else seeds
        near = graph.join(keyed.select("cell").distinct(), "cell", "left_semi")
        out = settled(near.groupBy("cell").cogroup(keyed.groupBy("cell")).applyInPandas(_ends(level), "cell long, leg long, last boolean, node long, rank long, cost long, hops array<long>"))
        seeds, found = out.filter("last IS NOT NULL"), out.filter("last IS NULL").select("leg", "cost", "hops")
        whole = found if whole is None else whole.union(found)
    best = whole.groupBy("leg").agg(F.min(F.struct("cost", "hops")).alias("b"))
    return best.join(legs.select(F.col("leg"), F.col("goal").alias("end")), "leg").select("leg", "b.cost", "end", "b.hops")


def nodes_of(overlay: Overlay, found: DataFrame) -> DataFrame:
    """The nodes on routes: leg, k (from 0) and node; each crossing is taken apart by itself, and steps follow each other by the cost up to them."""
    c = F.col
    part = lambda i: F.transform(F.filter("hops", lambda _, k: k % 4 == i), lambda x: x)
    steps = F.arrays_zip(*(part(i).alias(n) for i, n in enumerate(("at", "src", "dst", "level"))))
    hops = settled(found.select(c("leg").cast("long").alias("leg"), F.inline(steps)))
    done = [hops.filter("level < 0")]
    for level in range(len(overlay.graphs) - 2, -1, -1):
        asked = hops.filter(c("level") == level).join(overlay.cells.withColumnRenamed("node", "src"), "src").withColumn("cell", _up("cell", level))
        graph = overlay.graphs[level].join(asked.select("cell").distinct(), "cell", "left_semi")
        new = graph.groupBy("cell").cogroup(asked.select("cell", "leg", "at", "src", "dst").groupBy("cell")).applyInPandas(_apart, "leg long, at long, src long, dst long, level long")
        hops = settled(new.unionByName(hops.filter((c("level") >= 0) & (c("level") < level))))
        done.append(hops.filter("level < 0"))
    rows = found.select(c("leg").cast("long").alias("leg"), c("cost").alias("at"), c("end").alias("node"))
    for steps in done:
        rows = rows.union(steps.select("leg", "at", c("src").alias("node")))
    order = Window.partitionBy("leg").orderBy("at")
    return rows.select("leg", (F.row_number().over(order) - 1).cast("long").alias("k"), "node")
