"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a fixed pseudo-random order, are cut into blocks. With weight w, its block j (from 0) is released
at slot floor(j / w) and due at ceil((j + 1) / w); each slot takes the released block that is due first. At every slot the
blocks that a source has had differ from slot times weight by less than one. Weights are whole numbers over their sum,
without rounding, so this holds for any number of slots.

Slots are worked out in spans, each by itself. Which blocks come before a span follows from the weights alone: those due
before it, and of those whose time reaches across its start the first due, as far as the slots before it that are free
from their release on suffice. A choice that serves both sides exists, since giving each of them the part of a block that
its weight has earned by then is one in fractions; and the choice by deadlines has the most blocks of every deadline. A
span is longer than any block's time, so no block reaches across two starts.

When a source has no blocks left a new phase begins, in which the others keep their shares of what remains: each document
is used once and none is left out.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnpath.llm.common import durable, parts, sorted_in, unused

#: Slots a span, at least; sources up to which what numbers the rows is broadcast.
BLOCK_DOCS, EXPONENT, SPAN, FEW = 16, 0.7, 1024, 1000
LAST = (1 << 63) - 1


def whole_weights(weights: dict[str, float | Fraction]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


def blocks_before(weights: list[int], at: int, span: int) -> list[int]:
    """The blocks that each source has had before slot at, where a span of slots begins and another ends."""
    total = sum(weights)
    had = [w * at // total for w in weights]
    free = at - sum(had)
    if not free:
        return had
    low = at - span
    # For each slot of the span before: how many slots from it on no block that is due by then must have.
    taken = np.zeros(span, np.int64)
    for w, n in zip(weights, had, strict=True):
        for j in range(-(-w * low // total), n):
            taken[j * total // w - low] += 1
    room = np.arange(span, 0, -1) - np.cumsum(taken[::-1])[::-1]
    across = sorted((-(-(n + 1) * total // w), i, n * total // w - low) for i, (w, n) in enumerate(zip(weights, had, strict=True)) if w * at % total)
    for _, i, release in across:
        if release < 0 or room[: release + 1].min() > 0:
            room[: release + 1] -= 1
            had[i] += 1
            free -= 1
            if not free:
                return had
    raise AssertionError("no room for the blocks of a span")


def span_slots(weights: list[int], start: int, span: int | None) -> Iterator[tuple[int, int, int, int, int]]:
    """Slot, source, block, release and deadline from start on, for one span of slots or without an end."""
    total = sum(weights)
    end = None if span is None else start + span
    had = blocks_before(weights, start, span) if start else [0] * len(weights)
    upto = None if end is None else blocks_before(weights, end, span)
    waiting = [(j * total // w, i, j) for i, (w, j) in enumerate(zip(weights, had, strict=True)) if upto is None or j < upto[i]]
    heapq.heapify(waiting)
    due: list[tuple[int, int, int, int]] = []
    slot = start
    while slot != end:
        while waiting and waiting[0][0] <= slot:
            release, i, j = heapq.heappop(waiting)
            deadline = -(-(j + 1) * total // weights[i])
            heapq.heappush(due, (deadline if end is None else min(deadline, end), i, j, release))
            if upto is None or j + 1 < upto[i]:
                heapq.heappush(waiting, ((j + 1) * total // weights[i], i, j + 1))
        _, i, j, release = heapq.heappop(due)
        yield slot, i, j, release, -(-(j + 1) * total // weights[i])
        slot += 1


def cycle_slots(share: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """For each source its blocks in one cycle of as many slots as all shares: release, deadline and slot."""
    names = list(share)
    out: dict[str, list[tuple[int, int, int]]] = {s: [] for s in names}
    for slot, i, _, release, deadline in span_slots(list(share.values()), 0, sum(share.values())):
        out[names[i]].append((release, deadline, slot))
    return out


def phases(weights: dict[str, int], blocks: dict[str, int], start: int = 0, least: int = SPAN) -> list[dict]:
    """The schedule, phase by phase: first slot, slots, slots a span (none: one without an end), and each source's weight and first block.

    A phase ends with the first last block of a source; only the spans in which that can be are looked through.
    """
    left, first, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), []
    while left:
        names, now = list(left), [weights[s] for s in left]
        total = sum(now)
        span: int | None = max(least, total // min(now) + 3)
        if span >= sum(left.values()):
            span = None
        at = 0 if span is None else min((n - 1) * total // w for n, w in zip(left.values(), now, strict=True)) // span * span
        last = [n - 1 for n in left.values()]
        end = None
        while end is None:
            end = next((slot for slot, i, j, *_ in span_slots(now, at, span) if j == last[i]), None)
            at += span or 0
        from_span = 0 if span is None else end // span * span
        used = blocks_before(now, from_span, span) if from_span else [0] * len(now)
        for slot, i, *_ in span_slots(now, from_span, span):
            if slot > end:
                break
            used[i] += 1
            if slot == end:
                break
        out.append({"start": start, "slots": end + 1, "span": span, "names": names, "weights": now, "first": [first[s] for s in names]})
        for s, n in zip(names, used, strict=True):
            first[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        start += end + 1
    return out


def schedule(docs: DataFrame, plan: list[dict]) -> DataFrame:
    """A row for each block: source, phase, block, release, deadline, slot; each span is worked out in one task."""
    spark = docs.sparkSession
    first_span = [0, *accumulate(-(-p["slots"] // (p["span"] or p["slots"])) for p in plan)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source", pa.string()), ("phase", pa.int32()), ("block", pa.int64()), ("release", pa.int64()), ("deadline", pa.int64()), ("slot", pa.int64())])
        put = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                phase = bisect_right(first_span, k) - 1
                p, rows = plan[phase], []
                for slot, i, j, release, deadline in span_slots(p["weights"], (k - first_span[phase]) * (p["span"] or 0), p["span"]):
                    if slot == p["slots"]:
                        break
                    rows.append((p["names"][i], phase, p["first"][i] + j, p["start"] + release, min(p["start"] + deadline, LAST), p["start"] + slot))
                    if len(rows) == 1 << 14:
                        yield put(rows)
                        rows = []
                if rows:
                    yield put(rows)

    spans = spark.range(0, first_span[-1], 1, max(1, min(first_span[-1], parts(spark))))
    return durable(spans.mapInArrow(work, "source string, phase int, block long, release long, deadline long, slot long"), "schedule")


def _name(docs: DataFrame) -> Column:
    return F.coalesce(docs["source"].cast("string"), F.lit("")).alias("source")


def _ranked(docs: DataFrame, few: bool) -> DataFrame:
    """doc_id, source and rank, a source's rows numbered from 0 without ever meeting in one task."""
    keyed = docs.select(F.col("doc_id").cast("long"), _name(docs), F.xxhash64(F.col("doc_id").cast("long")).alias("dealt"))
    ordered = keyed.repartitionByRange(parts(docs.sparkSession), "source", "dealt", "doc_id").sortWithinPartitions("source", "dealt", "doc_id")
    rows = durable(ordered.select("doc_id", "source", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("row")), "ranks")
    runs = rows.groupBy("source", "task").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("from"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each task and each boundary between sources.
    starts = runs.select("source", "task", (before - F.col("from")).alias("shift"))
    return rows.join(F.broadcast(starts) if few else starts, ["source", "task"]).select("doc_id", "source", (F.col("row") + F.col("shift")).alias("rank"))


def mix(docs: DataFrame, weights: dict[str, float | Fraction] | None = None, block_docs: int = BLOCK_DOCS, exponent: float = EXPONENT, span: int = SPAN) -> DataFrame:
    """One row per row of docs: doc_id, source, phase, block, release, deadline, slot, position.

    Without weights a source's weight is its number of rows to the power exponent. position orders the mix: slot times
    block_docs plus the place in the block. A null source is the source with the empty name; sources without a weight
    get none of the slots and come in a last round of their own, in proportion to their sizes. Repeated rows each have a
    place; an empty table gives no rows; further columns are ignored. Any number of sources will do; there are as many
    phases as sources at most, so the driver's work grows with the square of that number.
    """
    sizes = dict(docs.groupBy(_name(docs)).agg(F.count(F.lit(1)).alias("n")).collect())
    ranked = _ranked(docs, len(sizes) <= FEW)
    blocks = {s: -(-n // block_docs) for s, n in sorted(sizes.items())}
    wanted = {s: float(sizes[s]) ** exponent for s in blocks} if weights is None else {s: weights[s] for s in blocks if weights.get(s, 0) > 0}
    others = {s: sizes[s] for s in blocks if s not in wanted}
    plan, start = [], 0
    for group in (wanted, others):
        if group:
            plan += phases(whole_weights(group), {s: blocks[s] for s in group}, start, span)
            start += sum(blocks[s] for s in group)
    placed = ranked.withColumn("block", F.floor(F.col("rank") / block_docs)).join(schedule(docs, plan), ["source", "block"])
    return placed.select("doc_id", "source", "phase", "block", "release", "deadline", "slot", (F.col("slot") * block_docs + F.col("rank") % block_docs).alias("position"))


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """All rows of docs, all columns as they are, dealt out and sorted in the order of the mix.

    Rows that repeat a doc_id, or have none, go where the first of them goes; a null source is one with the empty name. An
    empty table gives no rows; columns may have any names.
    """
    place, key = unused(docs, "mix_position"), unused(docs, "mix_id")
    order = mix(docs, weights).groupBy("doc_id").agg(F.min("position").alias(place)).withColumnRenamed("doc_id", key)
    placed = docs.join(sorted_in(order), F.col("doc_id").eqNullSafe(F.col(key))).drop(key)
    return placed.repartitionByRange(parts(docs.sparkSession), place).sortWithinPartitions(place).drop(place)
