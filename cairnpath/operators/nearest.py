"""The nearest lines or points of each point, by tiles.

A raster of the cells that lines run through tells how far a point's nearest can be at most, and so which tiles it is
sought in: the points are dealt out to these, few as they are, and each line to the tiles that it runs through. A task holds
the points of a tile, and lines pass by them; a point gets what is nearest in its tile, and its tiles are put together in the end.
So no pairs are shuffled, and a point far from all lines meets those at their edge alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnpath.operators.graph import settled
from cairnpath.operators.pairs import chunks, runs, spread

#: Cells of the raster across all lines, across a field that shares its candidates, and across a tile.
FINE, FIELD, TILE = 256, 4, 16
#: Metres to spare for rounding; the distance that ranks by rounded distance don't tell apart.
SPARE, TIE_M = 1e-6, 2e-6
#: Points of a tile that a task holds; segments that pass by at first and later on.
PART, FIRST, LATER = 1 << 19, 1 << 10, 1 << 15
FOUND = "x_m double, y_m double, seg_no long, seg_before_m double, seg_way_m double, ax double, ay double, bx double, by double"


def projection(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Where on a segment (0 to 1) a point is nearest, and how far off it is."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / square)))
    ox, oy = px - (ax + t * dx), py - (ay + t * dy)
    return t, F.sqrt(ox * ox + oy * oy)


def lines_of(vertices: DataFrame, *more) -> DataFrame:
    """Ways as rows of vertices, numbered from 1 by pos -> a row for each with two at least: way_id, xs and ys, and more aggregates."""
    line = F.sort_array(F.collect_list(F.struct("pos", "x_m", "y_m"))).alias("line")
    return vertices.groupBy("way_id").agg(line, *more).filter(F.size("line") > 1).withColumns({"xs": F.col("line.x_m"), "ys": F.col("line.y_m")}).drop("line")


def dots_of(features: DataFrame) -> DataFrame:
    """Features at points as lines of one vertex."""
    return features.filter("x_m IS NOT NULL AND y_m IS NOT NULL").withColumns({"xs": F.array("x_m"), "ys": F.array("y_m")}).drop("x_m", "y_m")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the segments of lines (one of no length for a single vertex): which line, and the numbers of both ends among all vertices in a row; these, and where lines begin there."""
    xs, ys = batch.column("xs"), batch.column("ys")
    n, x, y = xs.value_lengths().to_numpy(), xs.flatten().to_numpy(zero_copy_only=False), ys.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(n) - n
    line, a = spread(start, np.where(n > 1, n - 1, n))
    return line, a, np.where(n[line] > 1, a + 1, a), x, y, start


def _added(line: np.ndarray, step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Steps added up along each line, from first on, one after another: what is before each."""
    turn = np.flatnonzero(np.diff(line, prepend=-1))
    size, before = np.diff([*turn, len(line)]), np.zeros(len(line))
    before[turn] = first[line[turn]]
    for k in range(1, int(size.max(initial=1))):
        here = turn[size > k] + k
        before[here] = before[here - 1] + step[here - 1]
    return before


def _occupied(x0: float, y0: float, size: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, a, b, x, y, _ = _flat(batch)
        fine = ~np.isnan(x[a] + y[a] + x[b] + y[b])
        a, b = a[fine], b[fine]
        dot, long = a[a == b], a != b
        cells = [np.floor((x[dot] - x0) / size).astype(np.int64) * FINE + np.floor((y[dot] - y0) / size).astype(np.int64)]
        a, b = a[long], b[long]
        for k in range(0, len(a), LATER):
            cells.append(np.unique(_cells(*(v[e[k : k + LATER]] for e in (a, b) for v in (x, y)), size, x0, y0, FINE)[1]))
        cells, count = np.unique(np.concatenate(cells), return_counts=True)
        cells = np.divmod(cells, FINE)
        yield pa.RecordBatch.from_arrays([pa.array(cells[0]), pa.array(cells[1]), pa.array(count)], ["cx", "cy", "n"])


class Raster:
    """Which cells lines run through, and for each field of cells those that may hold the k nearest of a point in it.

    It has FINE cells across at most, however many lines there are.
    """

    def __init__(self, cx: np.ndarray, cy: np.ndarray, n: np.ndarray, k: int, x0: float, y0: float, size: float, wide: int, high: int):
        self.cx, self.cy, self.n, self.k, self.x0, self.y0, self.size = cx, cy, n, k, x0, y0, size
        self.high = -(-high // FIELD)
        fx, fy = np.divmod(np.arange(-(-wide // FIELD) * self.high), self.high)
        mid = lambda f: (f + 0.5) * FIELD - 0.5
        slack, starts, found = (FIELD + 1) * 2**-0.5, [0], []
        k = min(k, len(cx))
        for x, y in zip(mid(fx), mid(fy), strict=True):
            far = np.hypot(cx - x, cy - y)
            reach = np.partition(far, k - 1)[k - 1] + 2 * slack + 1e-9
            found.append(np.flatnonzero(far <= reach).astype(np.int32))
            starts.append(starts[-1] + len(found[-1]))
        self.starts, self.found = np.array(starts), np.concatenate(found)

    def reach(self, x: np.ndarray, y: np.ndarray, metres: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For points: how far the k nearest are at most, and (point, tile_x, tile_y) for all tiles with a line as near as that."""
        field = (np.floor((x - self.x0) / self.size) // FIELD * self.high + np.floor((y - self.y0) / self.size) // FIELD).astype(np.int64)
        most, where = np.full(len(x), metres), []
        order = np.argsort(field, kind="stable")
        for turn in np.split(order, np.flatnonzero(np.diff(field[order])) + 1) if len(x) else ():
            cells = self.found[self.starts[field[turn[0]]] : self.starts[field[turn[0]] + 1]]
            for a in range(0, len(turn), max(1, (1 << 20) // len(cells))):
                p = turn[a : a + max(1, (1 << 20) // len(cells))]
                dx, dy = (np.abs(v[p, None] - (o + (c[cells] + 0.5) * self.size)) for v, o, c in ((x, self.x0, self.cx), (y, self.y0, self.cy)))
                least = np.hypot(np.maximum(dx - self.size / 2, 0), np.maximum(dy - self.size / 2, 0))
                farthest = np.hypot(dx + self.size / 2, dy + self.size / 2)
                if self.k == 1:
                    bound = farthest.min(axis=1)
                else:
                    by = np.argsort(farthest, axis=1)
                    enough = np.cumsum(self.n[cells][by], axis=1) >= self.k
                    bound = np.where(enough.any(axis=1), np.take_along_axis(farthest, np.take_along_axis(by, enough.argmax(axis=1)[:, None], 1), 1)[:, 0], np.inf)
                most[p] = np.minimum(metres, bound + 4 * SPARE)
                q, c = np.nonzero(least <= most[p, None] + SPARE)
                where.append(np.unique((p[q] * FINE + self.cx[cells[c]] // TILE) * FINE + self.cy[cells[c]] // TILE))
        code = np.concatenate(where) if where else np.zeros(0, np.int64)
        return most, code // FINE // FINE, code // FINE % FINE, code % FINE


def _dealt(place: list[str], batch: pa.RecordBatch, side: str, row: np.ndarray, tile: tuple[np.ndarray, np.ndarray], numbers: np.ndarray, ends: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    payload = pa.StructArray.from_arrays([batch.column(c) for c in place], place).take(pa.array(row))
    other = pa.nulls(len(row), schema.field("line" if side == "spot" else "spot").type)
    both = (payload, other) if side == "spot" else (other, payload)
    columns = [pa.array(tile[0]), pa.array(tile[1]), *both, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers))]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to some ten thousand rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 1 << 16:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _put_points(keys: list[str], schema: pa.Schema, raster: Raster | None, x0: float, y0: float, wide: float, metres: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _together(batches):
        x, y = (batch.column(c).to_numpy() for c in ("x_m", "y_m"))
        if raster:
            most, p, tx, ty = raster.reach(x, y, metres)
        else:
            most, far = np.full(len(x), metres), metres + SPARE
            low, high = ([np.floor((v + s - o) / wide).astype(np.int64) for v, o in ((x, x0), (y, y0))] for s in (-far, far))
            c, tx = spread(low[0], high[0] - low[0] + 1)
            q, ty = spread(low[1][c], (high[1] - low[1] + 1)[c])
            p, tx = c[q], tx[q]
        yield _dealt(keys, batch, "spot", p, (tx, ty), np.stack([x[p], y[p], most[p]], axis=1).ravel(), np.arange(len(p) + 1) * 3, schema)


def _put_lines(names: list[str], schema: pa.Schema, tiles: np.ndarray, x0: float, y0: float, wide: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each line the stretch from its first to its last segment in each of the tiles (that have points): number of its first segment, metres before it and of the line, and its vertices."""
    for batch in batches:
        line, v, w, x, y, start = _flat(batch)
        step = np.sqrt((x[w] - x[v]) * (x[w] - x[v]) + (y[w] - y[v]) * (y[w] - y[v]))
        fine = ~np.isnan(step)
        at = lambda f, k, o: np.floor((f(k[v], k[w])[fine] - o) / wide).astype(np.int64)
        low_x, high_x, low_y, high_y = at(np.minimum, x, x0), at(np.maximum, x, x0), at(np.minimum, y, y0), at(np.maximum, y, y0)
        c, tx = spread(low_x, high_x - low_x + 1)
        q, ty = spread(low_y[c], (high_y - low_y + 1)[c])
        s, tx = np.flatnonzero(fine)[c[q]], tx[q]
        kept = np.isin(tx * (1 << 32) + ty, tiles)
        s, tx, ty = s[kept], tx[kept], ty[kept]
        if not len(s):
            continue
        order = np.lexsort([s, ty, tx, line[s]])
        s, tx, ty = s[order], tx[order], ty[order]
        turn = np.concatenate([[0], np.flatnonzero((np.diff(line[s]) != 0) | (np.diff(tx) != 0) | (np.diff(ty) != 0)) + 1])
        first, last = s[turn], s[np.concatenate([turn[1:], [len(s)]]) - 1]
        before = _added(line, step, np.zeros(len(start)))
        whole = np.bincount(line, np.where(np.append(np.diff(line), 1) != 0, before + step, 0.0), len(start))
        size = w[last] - v[first] + 1
        _, k = spread(v[first], size)
        ends = np.concatenate([[0], np.cumsum(2 * size + 3)])
        numbers = np.empty(ends[-1])
        numbers[ends[:-1]], numbers[ends[:-1] + 1], numbers[ends[:-1] + 2] = v[first] - start[line[first]], before[first], whole[line[first]]
        _, put = spread(ends[:-1] + 3, 2 * size)
        numbers[put] = np.stack([x[k], y[k]], axis=1).ravel()
        yield _dealt(names, batch, "line", line[first], (tx[turn], ty[turn]), numbers, ends, schema)


def _cells(ax, ay, bx, by, size: float, x0: float, y0: float, across: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments and the cells of a tile that they run through: columns, and in each the heights that a segment has there."""
    left, right, dx = np.minimum(ax, bx), np.maximum(ax, bx), bx - ax
    clip = lambda v, o: np.clip(np.floor((v - o) / size), -1, across).astype(np.int64)
    first, last = np.maximum(clip(left - SPARE, x0), 0), np.minimum(clip(right + SPARE, x0), across - 1)
    seg, column = spread(first, np.maximum(last - first + 1, 0))
    slope = np.where(dx == 0, 0.0, (by - ay) / np.where(dx == 0, 1.0, dx))[seg]
    at = lambda v: ay[seg] + (np.clip(v, left[seg], right[seg]) - ax[seg]) * slope
    one, other, upright = at(x0 + column * size - SPARE), at(x0 + (column + 1) * size + SPARE), (dx == 0)[seg]
    bottom = np.where(upright, np.minimum(ay, by)[seg], np.minimum(one, other)) - SPARE
    top = np.where(upright, np.maximum(ay, by)[seg], np.maximum(one, other)) + SPARE
    low, high = np.maximum(clip(bottom, y0), 0), np.minimum(clip(top, y0), across - 1)
    c, row = spread(low, np.maximum(high - low + 1, 0))
    return seg[c], column[c] * across + row


class Spots:
    """The points of a tile with the nearest of what has passed by."""

    def __init__(self, held: list[pa.RecordBatch], corner: tuple[float, float], wide: float, k: int, apart: tuple[str, str] | None, tie: str | None, each: bool):
        table = pa.Table.from_batches(held).combine_chunks()
        self.keys = table.column("spot").combine_chunks()
        self.x, self.y, self.most = table.column("numbers").combine_chunks().flatten().to_numpy().reshape(-1, 3).T.copy()
        self.corner, self.wide, self.k, self.apart, self.tie, self.each = corner, wide, k, apart, tie, each
        self.own = self.keys.field(apart[0]).to_numpy() if apart else None
        self.size = wide / min(max(int(len(self.x) ** 0.5), 8), 1024)
        self.p, self.d, self.rest, self.lines = np.zeros(0, np.int64), np.zeros(0), np.zeros((7, 0)), None

    def _near_cells(self, p: np.ndarray, size: float, across: int) -> tuple[np.ndarray, np.ndarray]:
        """Points by the cells that come as near to them as their nearest so far: where each cell's begin, and the points."""
        x, y, most = self.x[p] - self.corner[0], self.y[p] - self.corner[1], self.most[p] + 2 * SPARE
        low = lambda v: np.clip(np.floor((v - most) / size), 0, across).astype(np.int64)
        high = lambda v: np.clip(np.floor((v + most) / size), -1, across - 1).astype(np.int64)
        a, column = spread(low(x), np.maximum(high(x) - low(x) + 1, 0))
        b, row = spread(low(y)[a], np.maximum(high(y) - low(y) + 1, 0)[a])
        a, column = a[b], column[b]
        off = lambda v, c: np.maximum(np.maximum(c * size - v[a], v[a] - (c + 1) * size), 0.0)
        near = np.flatnonzero(np.hypot(off(x, column), off(y, row)) <= most[a])
        a, cell = a[near], (column * across + row)[near]
        order = np.argsort(cell, kind="stable")
        return np.searchsorted(cell[order], np.arange(across * across + 1)), p[a[order]]

    def pass_by(self, batch: pa.RecordBatch) -> None:
        numbers = batch.column("numbers")
        n, flat = numbers.value_lengths().to_numpy(), numbers.flatten().to_numpy()
        start = np.cumsum(n) - n
        line, s = spread(np.zeros(len(n), np.int64), np.maximum((n - 3) // 2 - 1, 1))
        a = start[line] + 3 + 2 * s
        b = np.where(n[line] > 5, a + 2, a)
        ax, ay, bx, by = flat[a], flat[a + 1], flat[b], flat[b + 1]
        before = _added(line, np.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)), flat[start + 1])
        more = np.stack([flat[start[line]] + s, before, flat[start[line] + 2], ax, ay, bx, by])
        fine = ~np.isnan(ax + ay + bx + by)
        line, more = line[fine], more[:, fine]
        if not len(line):
            return
        ax, ay, bx, by = more[3:]
        dx, dy = bx - ax, by - ay
        square = dx * dx + dy * dy
        safe = np.where(square == 0, np.inf, square)
        other = batch.column("line").field(self.apart[1]).to_numpy() if self.apart else None
        level = np.ceil(np.log(np.maximum(self.most / (16 * self.size), 1.0)) / np.log(4.0)).astype(np.int64)
        new = []
        for j in np.unique(level):
            size = min(self.size * 4.0**j, self.wide)
            across = int(np.ceil(self.wide / size - 1e-9))
            bound, points = self._near_cells(np.flatnonzero(level == j), size, across)
            seg, cell = _cells(ax, ay, bx, by, size, *self.corner, across)
            count = bound[cell + 1] - bound[cell]
            some = np.flatnonzero(count)
            seg, first, count = seg[some], bound[cell[some]], count[some]
            for lo, hi in chunks(count):
                which, at = spread(first[lo:hi], count[lo:hi])
                q, p = seg[lo:hi][which], points[at]
                px, py, ux, uy = self.x[p] - ax[q], self.y[p] - ay[q], dx[q], dy[q]
                t = np.minimum(1.0, np.maximum(0.0, (px * ux + py * uy) / safe[q]))
                ox, oy = self.x[p] - (ax[q] + t * ux), self.y[p] - (ay[q] + t * uy)
                d = np.sqrt(ox * ox + oy * oy)
                hit = d <= self.most[p] + TIE_M
                if self.apart:
                    hit &= self.own[p] != other[line[q]]
                hit = np.flatnonzero(hit)
                if len(hit):
                    p, d = p[hit], d[hit]
                    if not self.tie:
                        np.minimum.at(self.most, p, d)
                    new.append((p, d, q[hit]))
        if new:
            p, d, q = (np.concatenate(v) for v in zip(*new, strict=True))
            if not self.tie:  # a segment may have met a point in several cells
                kept = np.flatnonzero(d <= self.most[p] + TIE_M)
                kept = kept[np.unique(p[kept] * len(line) + q[kept], return_index=True)[1]]
                p, d, q = p[kept], d[kept], q[kept]
            self._add(p, d, more[:, q], batch.column("line").take(pa.array(line[q])))

    def _add(self, p: np.ndarray, d: np.ndarray, rest: np.ndarray, lines: pa.Array) -> None:
        self.p, self.d, self.rest = np.concatenate([self.p, p]), np.concatenate([self.d, d]), np.concatenate([self.rest, rest], axis=1)
        self.lines = lines if self.lines is None else pa.concat_arrays([self.lines, lines])
        if not self.tie:
            kept = np.flatnonzero(self.d <= self.most[self.p] + TIE_M)
        elif self.each:
            # Of each line the nearest segment alone, and the lines as near as the k-th but for TIE_M.
            line = self.lines.field(self.tie).to_numpy()
            order = np.lexsort([self.d, line, self.p])
            one = order[np.concatenate([[True], (np.diff(self.p[order]) != 0) | (np.diff(line[order]) != 0)])]
            one = one[np.lexsort([self.d[one], self.p[one]])]
            last = one[np.arange(len(one)) - np.searchsorted(self.p[one], self.p[one]) == self.k - 1]
            self.most[self.p[last]] = np.minimum(self.most[self.p[last]], self.d[last])
            kept = one[self.d[one] <= self.most[self.p[one]] + TIE_M]
        else:
            order = np.lexsort([self.lines.field(self.tie).to_numpy(), self.d, self.p])
            p = self.p[order]
            rank = np.arange(len(p)) - np.searchsorted(p, p)
            kept = order[rank < self.k]
            last = order[rank == self.k - 1]
            self.most[self.p[last]] = np.minimum(self.most[self.p[last]], self.d[last])
        self.p, self.d, self.rest, self.lines = self.p[kept], self.d[kept], self.rest[:, kept], self.lines.take(pa.array(kept))

    def found(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.p), 1 << 16):
            b = min(a + (1 << 16), len(self.p))
            i, *rest = self.rest[:, a:b]
            yield pa.RecordBatch.from_arrays([self.keys.take(pa.array(self.p[a:b])), self.lines.slice(a, b - a), pa.array(self.x[self.p[a:b]]), pa.array(self.y[self.p[a:b]]), pa.array(i.astype(np.int64)), *(pa.array(v) for v in rest)], ["spot", "line", "x_m", "y_m", "seg_no", "seg_before_m", "seg_way_m", "ax", "ay", "bx", "by"])


def _search(x0: float, y0: float, wide: float, k: int, apart: tuple[str, str] | None, tie: str | None, each: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, held, spots, waiting, size, want = None, [], None, [], 0, FIRST

    def let_pass():
        nonlocal waiting, size, want
        if waiting:
            spots.pass_by(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
        waiting, size, want = [], 0, min(want * 4, LATER)

    for (*place, is_line), run in runs(batches, ["tile_x", "tile_y", "part", "is_line"]):
        if place != here:
            if spots:
                let_pass()
                yield from spots.found()
            here, held, spots, want = place, [], None, FIRST
        if not is_line:
            held.append(run)
            continue
        if not held and not spots:
            continue
        if not spots:
            spots, held = Spots(held, (x0 + place[0] * wide, y0 + place[1] * wide), wide, k, apart, tie, each), []
        while run.num_rows:
            n = np.cumsum(run.column("numbers").value_lengths().to_numpy() // 2)
            rows = max(1, int(np.searchsorted(n, want - size, "right")))
            waiting.append(run.slice(0, rows))
            size += int(n[min(rows, len(n)) - 1])
            run = run.slice(rows)
            if size >= want or run.num_rows:
                let_pass()
    if spots:
        let_pass()
        yield from spots.found()


def nearest(points: DataFrame, lines: DataFrame, key: list[str], metres: float | None, k: int = 1, apart: tuple[str, str] | None = None, tie: str | None = None, each: bool = False) -> DataFrame:
    """key and columns of lines but xs and ys, with seg_no (a segment's number on its line, from 0), seg_before_m (metres of the line before it), seg_way_m (of all of it), ax, ay, bx and by.

    For each point (key, x_m, y_m) and each tile that it is sought in: with k = 1 the nearest segment and those as near but for TIE_M, otherwise the k nearest
    lines of one vertex, ties by the column tie. What is beyond metres may be among them. each: the k nearest lines of any form, told apart by the number tie, by
    their nearest segments. apart: a column of key and one of lines that must differ.
    """
    spark, c = points.sparkSession, F.col
    kept = lines if hasattr(lines, "_cairn_path") else settled(lines)
    points = points.select(*key, "x_m", "y_m").filter("x_m IS NOT NULL AND y_m IS NOT NULL")
    names = [n for n in kept.columns if n not in ("xs", "ys")]
    s = kept.agg(*(f(g(v)).alias(n + v) for v in ("xs", "ys") for n, f, g in (("lo", F.min, F.array_min), ("hi", F.max, F.array_max)))).first()
    low, high = [s["loxs"] or 0.0, s["loys"] or 0.0], [s["hixs"] or 0.0, s["hiys"] or 0.0]
    across = max(high[0] - low[0], high[1] - low[1], 1.0)
    raster, size = None, across / FINE
    if s["loxs"] is not None and not apart and not each and (metres is None or metres > size):
        b = points.agg(*(f(v).alias(n + v) for v in ("x_m", "y_m") for n, f in (("lo", F.min), ("hi", F.max)))).first()
        if b["lox_m"] is not None:
            low, high = [min(low[0], b["lox_m"]), min(low[1], b["loy_m"])], [max(high[0], b["hix_m"]), max(high[1], b["hiy_m"])]
            size = max(high[0] - low[0], high[1] - low[1], 1.0) / (FINE - 1)
            cells = kept.select("xs", "ys").mapInArrow(partial(_occupied, *low, size), "cx long, cy long, n long").groupBy("cx", "cy").agg(F.sum("n").alias("n")).toArrow()
            raster = Raster(*(cells.column(n).to_numpy() for n in ("cx", "cy", "n")), k, *low, size, *(int((h - l) // size) + 1 for h, l in zip(high, low, strict=True)))
    metres = metres if metres is not None else float("inf") if raster else 0.0
    wide = size * TILE if raster else max(size * TILE, 2 * metres)
    # Both sides as rows of one form.
    form = kept.select(F.struct(*names).alias("line")).schema["line"].dataType.simpleString()
    spot = points.select(F.struct(*key).alias("spot")).schema["spot"].dataType.simpleString()
    shape = f"tile_x long, tile_y long, spot {spot}, line {form}, numbers array<double>"
    schema = spark.createDataFrame([], shape).toArrow().schema
    put = points.mapInArrow(partial(_put_points, key, schema, raster, *low, wide, metres), shape)
    counts = [(r.tile_x, r.tile_y, 1 + r.n // PART) for r in put.groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n")).collect()]  # a row for each tile
    tiles = np.array([x * (1 << 32) + y for x, y, _ in counts], dtype=np.int64)
    crowded = F.broadcast(spark.createDataFrame([r for r in counts if r[2] > 1], "tile_x long, tile_y long, parts long"))
    n = F.coalesce("parts", F.lit(1))
    put = put.join(crowded, ["tile_x", "tile_y"], "left").withColumn("part", F.pmod(F.xxhash64(*(c("spot")[k] for k in key)), n)).withColumn("is_line", F.lit(0))
    run = kept.mapInArrow(partial(_put_lines, names, schema, tiles, *low, wide), shape).join(crowded, ["tile_x", "tile_y"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("is_line", F.lit(1))
    place = ["tile_x", "tile_y", "part"]
    both = put.select(*place, "is_line", "spot", "line", "numbers").union(run.select(*place, "is_line", "spot", "line", "numbers"))
    both = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *place).sortWithinPartitions(*place, "is_line")
    found = both.mapInArrow(partial(_search, *low, wide, k, apart, tie, each), f"spot {spot}, line {form}, {FOUND}")
    return found.select(*(c("spot")[n].alias(n) for n in key), *(c("line")[n].alias(n) for n in names), *(f.split()[0] for f in FOUND.split(", ")))


def nearest_line(points: DataFrame, lines: DataFrame, key: list[str], metres: float, *found: Column, apart: tuple[str, str] | None = None) -> DataFrame:
    """For each point with a line within metres: least_m, and the aggregates found over its segments that may be the nearest.

    These have the columns of lines, pos (from 1), before_m, way_m, length_m, ax, ay, bx, by, t and distance_m. Lines may also be
    single segments (ax, ay, bx, by), which come with what else they have. Found may ask for what the nearest segments decide alone.
    """
    single = "xs" not in lines.columns
    if single:
        lines = lines.withColumns({"xs": F.array("ax", "bx"), "ys": F.array("ay", "by")}).drop("ax", "ay", "bx", "by")
    c = F.col
    near = nearest(points, lines, key, metres, apart=apart)
    step = lambda k: (c(f"b{k}") - c(f"a{k}")) * (c(f"b{k}") - c(f"a{k}"))
    if not single:
        near = near.withColumns({"pos": (c("seg_no") + 1).cast("int"), "before_m": c("seg_before_m"), "way_m": c("seg_way_m"), "length_m": F.sqrt(step("x") + step("y"))})
    t, d = projection(*(c(k) for k in ("x_m", "y_m", "ax", "ay", "bx", "by")))
    near = near.withColumns({"t": t, "distance_m": d}).filter(c("distance_m") <= metres)
    return near.groupBy(*key).agg(F.min("distance_m").alias("least_m"), *found)


def nearest_dots(points: DataFrame, features: DataFrame, key: str, tie: str, k: int, metres: float | None) -> DataFrame:
    """key, columns of features, distance_m and rank (from 1) of the k nearest features of each point; ties by a column."""
    near = nearest(points, dots_of(features), [key], metres, k, tie=tie)
    dx, dy = F.col("x_m") - F.col("ax"), F.col("y_m") - F.col("ay")
    near = near.withColumn("distance_m", F.sqrt(dx * dx + dy * dy)).drop("x_m", "y_m", "seg_no", "seg_before_m", "seg_way_m", "ax", "ay", "bx", "by")
    near = near if metres is None else near.filter(F.col("distance_m") <= metres)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("distance_m", tie))).filter(F.col("rank") <= k)


def nearest_ways(points: DataFrame, lines: DataFrame, key: str, line_key: str, k: int, metres: float) -> DataFrame:
    """key, line_key and d for at least the k nearest lines within metres of each point."""
    _, d = projection(*(F.col(v) for v in ("x_m", "y_m", "ax", "ay", "bx", "by")))
    near = nearest(points, lines, [key], metres, k, tie=line_key, each=True).withColumn("d", d).filter(F.col("d") <= metres)
    return near.groupBy(key, line_key).agg(F.min("d").alias("d"))
