"""Joins whose rows are all pairs that meet, in number the square of what lies together: points and ways, ways and ways.

Only what meets is dealt out, by tiles, and crowded tiles by parts; pairs are made where they meet, chunk by chunk, and go
straight to the result. So shuffles and memory go with the input, and the time with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres of a cell, cells across a tile, and strips across a cell, in which what meets is sought, with metres to spare for rounding.
CELL, ACROSS, STRIPS, SPARE = 1000.0, 10, 4, 1e-3
WIDE = CELL / STRIPS
#: Points or vertices of a part of a tile, and pairs that are worked out at a time.
PART, CHUNK = 1 << 17, 1 << 16
PLACE = ["tile_x", "tile_y", "part", "other_part"]


def tile(x: Column) -> Column:
    return F.floor(F.floor(x / F.lit(CELL)) / ACROSS).cast("long")


def parts(df: DataFrame, name: str) -> DataFrame:
    """For each tile with points or vertices, into how many parts they are dealt."""
    counts = df.filter("x_m IS NOT NULL AND y_m IS NOT NULL").groupBy(tile(F.col("x_m")).alias("tile_x"), tile(F.col("y_m")).alias("tile_y")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(counts.select("tile_x", "tile_y", (1 + F.floor(F.col("n") / PART)).alias(name)))


def rounded(c: Column, digits: int) -> Column:
    """To the nearest, as round() does by way of decimals, which takes longer than all else where rows are many."""
    return F.floor(c * 10.0**digits + 0.5) / F.lit(10.0**digits)


def tiled_ways(segments: DataFrame, margin: float, *more: str) -> DataFrame:
    """way_id in each tile within margin of it, with the numbers of its segments there: pos, ax, ay, bx, by and more."""
    whole = segments.filter("way_id IS NOT NULL AND ax IS NOT NULL AND ay IS NOT NULL AND by IS NOT NULL")
    for v in "xy":
        low, high = F.least(f"a{v}", f"b{v}") - margin, F.greatest(f"a{v}", f"b{v}") + margin
        whole = whole.withColumn(f"tile_{v}", F.explode(F.sequence(tile(low), tile(high))))
    numbers = F.array(F.col("pos").cast("double"), "ax", "ay", "bx", "by", *more)
    return whole.groupBy("way_id", "tile_x", "tile_y").agg(F.flatten(F.sort_array(F.collect_list(numbers))).alias("numbers"))


def own(key: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(key), n)


def each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows in the tasks of their places, one place after another. Bytes don't tell how many pairs they make, so tasks aren't put together by them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *PLACE).sortWithinPartitions(*PLACE, *order)


def runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The stretches of rows that are equal in columns, as they come."""
    for batch in batches:
        if batch.num_rows:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(np.int64)
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                yield tuple(marks[:, a].tolist()), batch.slice(a, b - a)


def unpacked(run: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a run, each for as many times as it has segments or points, and their numbers by column."""
    numbers = run.column("numbers")
    ids = np.repeat(run.column("id").to_numpy(), numbers.value_lengths().to_numpy() // width)
    return ids, np.ascontiguousarray(numbers.flatten().to_numpy().reshape(-1, width).T)


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of numbers: which range, and the number, for all of them in a row."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def chunks(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about CHUNK pairs, or of one item with more."""
    ends = np.cumsum(counts)
    a = 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
        yield a, b
        a = b


def batch_of(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in schema.split(", ")])


COUNTED = "way_id long, points long, least_m double, first_id long"
NEAR = "point_id long, way_id long, off_m double, along_m double, way_m double"


def near_ways(points: DataFrame, segments: DataFrame, vertices: DataFrame, key: str, metres: float) -> DataFrame:
    """Each point with each way within metres: off_m from its nearest segment, along_m to the place there and the way's length way_m.

    vertices are counted alone, so that crowded tiles are known. A point has one place. Of segments as near to a micrometre, the first counts. A task holds the points of a part of a
    tile, and the ways of a part pass by them.
    """
    return _met(points, segments, vertices, key, metres, "before_m", "way_m").mapInArrow(partial(_near, metres, 7), NEAR).withColumnRenamed("point_id", key)


def near_counts(points: DataFrame, segments: DataFrame, vertices: DataFrame, key: str, metres: float) -> DataFrame:
    """Of each way with points within metres: points, how many, least_m, how near the nearest is, and first_id, the smallest key. They are counted where they meet."""
    parts_of = _met(points, segments, vertices, key, metres).mapInArrow(partial(_near, metres, 5), COUNTED)
    return parts_of.groupBy("way_id").agg(F.sum("points").alias("points"), F.min("least_m").alias("least_m"), F.min("first_id").alias("first_id"))


def _met(points: DataFrame, segments: DataFrame, vertices: DataFrame, key: str, metres: float, *more: str) -> DataFrame:
    """Points and ways in the tasks of their places, the points of a place first; ways come with pos, ax, ay, bx, by and more."""
    c = F.col
    points = points.filter(f"{key} IS NOT NULL AND x_m IS NOT NULL AND y_m IS NOT NULL")
    few, many = parts(points, "point_parts"), parts(vertices, "way_parts")
    point_parts, way_parts = F.coalesce("point_parts", F.lit(1)), F.coalesce("way_parts", F.lit(1))
    put = lambda df: df.join(few, ["tile_x", "tile_y"]).join(many, ["tile_x", "tile_y"], "left")
    spots = points.groupBy(c(key).alias("id")).agg(F.first("x_m").alias("x"), F.first("y_m").alias("y"))
    spots = put(spots.withColumn("tile_x", tile(c("x"))).withColumn("tile_y", tile(c("y")))).withColumn("part", own("id", point_parts)).withColumn("other_part", each(way_parts))
    ways = put(tiled_ways(segments, metres + SPARE, *more).withColumnRenamed("way_id", "id")).withColumn("other_part", own("id", way_parts)).withColumn("part", each(point_parts))
    both = spots.select(*PLACE, F.lit(0).alias("is_way"), "id", F.array("x", "y").alias("numbers")).union(ways.select(*PLACE, F.lit(1), "id", "numbers"))
    return placed(both, "is_way")


def _near(metres: float, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, held, found = None, [], None
    for (*place, is_way), run in runs(batches, [*PLACE, "is_way"]):
        if place != here:
            here, held, found = place, [], None
        if not is_way:
            held.append(unpacked(run, 2))
        elif held:
            found = found or _strips(place, held)
            yield from _near_run(metres, found, *unpacked(run, width))


def _strips(place: list[int], held: list) -> tuple:
    """The points of a tile by strips from left to right and upwards in each, and one number that tells where that is."""
    ids, (x, y) = np.concatenate([i for i, _ in held]), np.concatenate([n for _, n in held], axis=1)
    left, low = place[0] * ACROSS * STRIPS, place[1] * ACROSS * CELL
    height = _height(np.floor(x / WIDE) - left, y - low)
    order = np.argsort(height)
    return ids[order], x[order], y[order], height[order], left, low


def _height(strip: np.ndarray, y: np.ndarray) -> np.ndarray:
    return strip * (2 * ACROSS * CELL) + np.clip(y, -1.0, ACROSS * CELL + 1.0)


def _reached(reach: float, left: int, low: float, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, ...]:
    """The strips of a tile that segments come within reach of, one after another: which segment, the strip, and between which heights over the tile's foot."""
    x0, x1, dx = np.minimum(ax, bx), np.maximum(ax, bx), bx - ax
    first = np.maximum(np.floor((x0 - reach) / WIDE) - left, -1).astype(np.int64)
    last = np.minimum(np.floor((x1 + reach) / WIDE) - left, ACROSS * STRIPS).astype(np.int64)
    seg, strip = spread(first, np.maximum(last - first + 1, 0))
    slope = np.where(dx == 0, 0.0, (by - ay) / np.where(dx == 0, 1.0, dx))[seg]
    at = lambda v: ay[seg] + (np.clip(v, x0[seg], x1[seg]) - ax[seg]) * slope
    one, other, upright = at((strip + left) * WIDE - reach), at((strip + left + 1) * WIDE + reach), (dx == 0)[seg]
    bottom = np.where(upright, np.minimum(ay, by)[seg], np.minimum(one, other)) - reach - low
    top = np.where(upright, np.maximum(ay, by)[seg], np.maximum(one, other)) + reach - low
    return seg, strip, bottom, top


def _near_run(metres: float, found: tuple, way: np.ndarray, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    ids, x, y, heights, left, low = found
    pos, ax, ay, bx, by, *more = numbers
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    length, safe = np.sqrt(square), np.where(square == 0, np.inf, square)
    seg, strip, bottom, top = _reached(metres + SPARE, left, low, ax, ay, bx, by)
    start = np.searchsorted(heights, _height(strip, bottom))
    count = np.maximum(np.searchsorted(heights, _height(strip, top), "right") - start, 0)
    # Chunks of whole ways.
    turn = np.concatenate([[0], np.flatnonzero(way[1:] != way[:-1]) + 1])
    number = np.repeat(np.arange(len(turn)), np.diff([*turn, len(way)]))
    per_way = np.bincount(number[seg], count, len(turn)).astype(np.int64)
    bound = np.searchsorted(number[seg], np.arange(len(turn) + 1))
    for a, b in chunks(per_way):
        a, b = bound[a], bound[b]
        which, p = spread(start[a:b], count[a:b])
        if not len(which):
            continue
        s = seg[a:b][which]
        sx, sy, sdx, sdy, px, py = ax[s], ay[s], dx[s], dy[s], x[p], y[p]
        t = np.minimum(1.0, np.maximum(0.0, ((px - sx) * sdx + (py - sy) * sdy) / safe[s]))
        ox, oy = px - (sx + t * sdx), py - (sy + t * sdy)
        off = np.sqrt(ox * ox + oy * oy)
        hit = np.flatnonzero(off <= metres)
        if not len(hit):
            continue
        s, p, t, off = s[hit], p[hit], t[hit], off[hit]
        pair = number[s] * len(x) + p
        order = np.argsort(pair)
        pair, s, t, off = pair[order], s[order], t[order], off[order]
        heads = np.concatenate([[0], np.flatnonzero(pair[1:] != pair[:-1]) + 1])
        if not more:
            met = pair[heads] // len(x)
            each_way = np.concatenate([[0], np.flatnonzero(met[1:] != met[:-1]) + 1])
            k = np.minimum.reduceat(off, heads)
            yield batch_of(COUNTED, way[turn[met[each_way]]], np.diff([*each_way, len(met)]), np.minimum.reduceat(k, each_way), np.minimum.reduceat(ids[pair[heads] % len(x)], each_way))
            continue
        before, way_m = more
        size = np.diff([*heads, len(pair)]) if len(heads) < len(pair) else None
        pick = np.arange(len(pair))
        if size is not None:
            rank = np.floor(off * 1e6 + 0.5)
            place = np.where(rank == np.repeat(np.minimum.reduceat(rank, heads), size), pos[s], np.inf)
            pick = np.flatnonzero(place == np.repeat(np.minimum.reduceat(place, heads), size))
        k = s[pick]
        yield batch_of(NEAR, ids[pair[heads] % len(x)], way[k], np.minimum.reduceat(off, heads), before[k] + t[pick] * length[k], way_m[k])


CROSSED = "a_way long, a_pos long, b_way long, b_pos long, x_m double, y_m double"


def crossings(segments: DataFrame, vertices: DataFrame) -> DataFrame:
    """Where segments of different ways cross inside both, the way of the lower id first.

    A task holds one part of the ways of a tile or two; pairs meet where they have the same heights in a strip of the tile.
    """
    c, n = F.col, F.coalesce("way_parts", F.lit(1))
    ways = tiled_ways(segments, SPARE).withColumnRenamed("way_id", "id").join(parts(vertices, "way_parts"), ["tile_x", "tile_y"], "left")
    ways = ways.withColumn("own", own("id", n)).withColumn("with", each(n))
    both = ways.select("tile_x", "tile_y", F.least("own", "with").alias("part"), F.greatest("own", "with").alias("other_part"), "own", "id", "numbers")
    return placed(both).mapInArrow(_crossings, CROSSED)


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, held = None, {}
    for (*place, part), run in runs(batches, [*PLACE, "own"]):
        if place != here:
            yield from _crossed(here, held)
            here, held = place, {}
        held.setdefault(part, []).append(unpacked(run, 5))
    yield from _crossed(here, held)


def _sloped(place: list[int], held: list) -> dict[str, np.ndarray]:
    """The segments of a part in the strips of the tile, from left to right and upwards by where they begin in each."""
    way, (pos, ax, ay, bx, by) = np.concatenate([i for i, _ in held]), np.concatenate([n for _, n in held], axis=1)
    seg, strip, bottom, top = _reached(SPARE, place[0] * ACROSS * STRIPS, place[1] * ACROSS * CELL, ax, ay, bx, by)
    here = np.flatnonzero((top >= -1.0) & (bottom <= ACROSS * CELL + 1.0))
    seg, strip, low, high = seg[here], strip[here], _height(strip[here], bottom[here]), _height(strip[here], top[here])
    order = np.argsort(low)
    columns = {"way": way, "pos": pos, "x": ax, "y": ay, "dx": bx - ax, "dy": by - ay}
    return {"strip": strip[order], "low": low[order], "high": high[order]} | {k: v[seg[order]] for k, v in columns.items()}


def _crossed(place: list[int] | None, held: dict) -> Iterator[pa.RecordBatch]:
    if not held or not (place[2] in held and place[3] in held):
        return
    a = _sloped(place, held[place[2]])
    if place[2] == place[3]:
        yield from _crossed_after(place, a, a, np.arange(len(a["low"])) + 1)
    else:
        b = _sloped(place, held[place[3]])
        yield from _crossed_after(place, a, b, np.searchsorted(b["low"], a["low"]))
        yield from _crossed_after(place, b, a, np.searchsorted(a["low"], b["low"], "right"))


def _crossed_after(place: list[int], a: dict, b: dict, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Crossings of each of a with those of b that begin, from start on, where it still is. They count in the strip and tile where they are."""
    count = np.maximum(np.searchsorted(b["low"], a["high"], "right") - start, 0)
    for lo, hi in chunks(count):
        i, j = spread(start[lo:hi], count[lo:hi])
        i += lo
        ux, uy, vx, vy = a["dx"][i], a["dy"][i], b["dx"][j], b["dy"][j]
        wx, wy = b["x"][j] - a["x"][i], b["y"][j] - a["y"][i]
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = ux * vy - uy * vx
            t, r = (wx * vy - wy * vx) / cross, (wx * uy - wy * ux) / cross
        hit = np.flatnonzero((np.abs(t - 0.5) < 0.5) & (np.abs(r - 0.5) < 0.5))
        i, j, t, r = i[hit], j[hit], t[hit], r[hit]
        # Turned round, a pair has the same t and r, but for their names.
        one, other = a["way"][i], b["way"][j]
        turned = one > other
        pick = lambda p, q: np.where(turned, q, p)
        x, y = (pick(a[v][i] + t * a[f"d{v}"][i], b[v][j] + r * b[f"d{v}"][j]) for v in "xy")
        inside = (t > 1e-6) & (t < 1 - 1e-6) & (r > 1e-6) & (r < 1 - 1e-6)
        strip = a["strip"][i]
        own = (strip >= 0) & (strip < ACROSS * STRIPS) & (np.floor(x / WIDE) == strip + place[0] * ACROSS * STRIPS) & (np.floor(y / CELL) // ACROSS == place[1])
        keep = np.flatnonzero(inside & own & (one != other))
        if len(keep):
            p, q = a["pos"][i].astype(np.int64), b["pos"][j].astype(np.int64)
            yield batch_of(CROSSED, *(v[keep] for v in (pick(one, other), pick(p, q), pick(other, one), pick(q, p), x, y)))
