"""N-gram Jaccard join by partitioning the universe of shingles, exact.

Two sets of sizes a and b that are alike differ in at most h = 15 (a + b) / 185 shingles. Shingles are hashed into segments,
as many for a band of sizes as that h asks for: by the pigeonhole, segments enough are the same in both sets, or differ by
one shingle. A set is indexed in its own band and, if it may be like sets of the band below, in that one too.

What a segment is given is a matter of cost. In small sets, where a segment must not be empty, it gets its one-deletion
neighbourhood: its own key and one for each shingle left out; such a segment does for a difference of two. In large sets it
gets its key alone. Segments that would be empty get nothing, and so do crowded ones, whose key more than CROWD sets share
(a passage that many documents repeat): there are spare segments for either. A set with too many empty segments is hashed
anew with the next seed, besides. A set with more crowded segments than there are spares lies in a crowd; such sets are
compared with one central set of those that share a key, and those that are not of the component of the most of these then,
with the sets of other components. Of all pairs only those are looked up whose sketches differ in no
more bits than the sets may in shingles.

Sets are told by 128-bit hashes, shingles by 64-bit ones; the pairs found are verified on all shingles, counted exactly.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnpath.llm.common import durable, forget, parts, scratch, spread, whole
from cairnpath.llm.components import components

WORDS = 4
#: Likeness asked for: ALIKE * union <= 100 * intersection.
ALIKE = 85
#: Sets that share a key are paired up to this number; beyond it the key is crowded.
CROWD = 8
#: Bands of sizes begin at powers of it.
RATIO = 1.5
#: Bands that begin below it get one-deletion neighbourhoods.
SMALL = 24
#: Of the segments, how many are spare for crowded keys.
SPARE = 0.3
#: Keys that a task holds before it hands them on.
HELD = 1 << 18
#: Bits of a set's sketch, each the parity of the shingles that fall on it.
SKETCH = 1024
#: Pieces of the index for each partition.
PIECES = 2
#: Sets that a task remembers, so as to index copies once.
REMEMBERED = 1 << 20
#: Bytes of text hashed at a time.
PIECE = 1 << 22
#: Sets whose texts are looked up by a broadcast of their ids; more are looked up by a shuffled join.
FEW = 1 << 20

_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    with np.errstate(over="ignore"):
        x = x + _ODD[0]
        x = (x ^ (x >> _U(30))) * _ODD[1]
        x = (x ^ (x >> _U(27))) * _ODD[2]
    return x ^ (x >> _U(31))


#: Which bytes are white space.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Powers of an odd base modulo 2**64, and of its inverse.
_BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        made = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(made, x, np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


def _word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word: the polynomial of its bytes, from differences of the text's running sum."""
    b = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(np.diff(np.concatenate((np.zeros(1, np.int8), (~_SPACE[b]).view(np.int8), np.zeros(1, np.int8)))))
    start, end = at[::2], at[1::2]
    forth, back = _powers(len(b))
    with np.errstate(over="ignore"):
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + _U(1)) * forth[: len(b)], dtype=np.uint64)))
        return mix((upto[end] - upto[start]) * back[start] + (end - start).astype(np.uint64) * _ODD[0])


def shingles(text: str) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; long texts are hashed by pieces that end at white space."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    pieces, at = [], 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        pieces.append(_word_hashes(raw[at:end]))
        at = end
    own = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
    if not len(own):
        return own
    if len(own) < WORDS:
        made = _U(len(own)) + np.zeros(1, np.uint64)
        for w in own:
            made = mix(made ^ w)
        return made
    made = own[: 1 - WORDS]
    with np.errstate(over="ignore"):
        for k in range(1, WORDS):
            made = made * _ODD[2] + own[k : len(own) - WORDS + 1 + k]
    made = np.sort(mix(made))
    return made[np.concatenate(([True], made[1:] != made[:-1]))]


def starts() -> list[int]:
    """Where bands begin, for sets of up to 2**40 shingles."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return out


STARTS = starts()


@cache
def scheme(band: int) -> tuple[int, int, int, bool]:
    """Segments, spares for empty and for crowded ones, and whether segments get one-deletion neighbourhoods; no segments where only equal sets are alike."""
    low, high = STARTS[band], STARTS[band + 1] - 1
    h = (100 - ALIKE) * (high + high * 100 // ALIKE) // (100 + ALIKE)
    if not h:
        return 0, 0, 0, False
    if low < SMALL:  # fewer than 32 segments, by which a unit tells them apart
        spare = 1 if h > 4 else 0
        return h // 2 + 1 + 2 * spare, spare, spare, True
    crowded = ceil(SPARE * (h + 1))
    m = empty = 0
    for _ in range(8):  # settles at once, as the share of empty ones is small
        m = h + 1 + crowded + empty
        mean = m * exp(-low / m)
        empty = ceil(mean + 2 * sqrt(mean))
    return h + 1 + crowded + empty, empty, crowded, False


def bands(n: int) -> list[int]:
    """The bands in which a set of n shingles is indexed."""
    own = bisect_right(STARTS, n) - 1
    return [own, own - 1] if own and 100 * (STARTS[own] - 1) >= ALIKE * n else [own]


def keys(tokens: np.ndarray, band: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Units and keys of a set in a band, by seed; more than one seed where too many segments are empty.

    A unit is band and seed, and the segment where a segment has more than one key.
    """
    m, empty, _, near = scheme(band)
    if not m:
        return
    seed = 0
    while True:
        salt = mix(np.array([(band << 32) | seed], np.uint64))[0]
        with np.errstate(over="ignore"):
            at = (((tokens ^ salt) * _ODD[1] >> _U(32)) * _U(m) >> _U(32)).astype(np.uint16 if m < 1 << 16 else np.uint32)
        order = np.argsort(at, kind="stable")
        at, value = at[order], tokens[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        sizes = np.diff(np.append(first, len(at)))
        sums, named = np.add.reduceat(value, first), mix(at[first].astype(np.uint64) ^ salt)
        unit = np.uint16(band << 9 | min(seed, 15) << 5)
        if near:
            left = (np.repeat(sums, sizes) - value) ^ np.repeat(named, sizes)
            long = np.repeat(sizes, sizes) > 1
            out = mix(np.concatenate((sums ^ named, left[long])))
            units = unit + np.concatenate((at[first], at[long])).astype(np.uint16)
            missing = m - int((sizes > 1).sum())
        else:
            out, missing = mix(sums ^ named), m - len(first)
            units = np.full(len(out), unit)
        yield units, out
        if missing <= empty:
            return
        seed += 1


def _identity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sid, rest, sketch = [], [], [], []
        for text in batch.column(1):
            tokens = shingles(text.as_py())
            sketch.append(np.packbits(np.bincount((tokens & _U(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).view(np.int64))
            digest = xxhash.xxh3_128_digest(tokens.tobytes())
            n.append(len(tokens))
            sid.append(int.from_bytes(digest[:8], "little", signed=True))
            rest.append(int.from_bytes(digest[8:], "little", signed=True))
        columns = [batch.column(0), batch.column(2), *(pa.array(x, pa.int64()) for x in (n, sid, rest)), pa.array(sketch, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "sid", "rest", "sketch"])


PACKED = pa.schema([("piece", pa.int32()), ("crowded", pa.bool_()), ("keys", pa.binary()), ("sids", pa.binary()), ("units", pa.binary())])


def _handed_on(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], pieces: int) -> Iterator[pa.RecordBatch]:
    """Keys of many sets, each set once a key, dealt out to pieces; of a crowded key only as many as show that it is, the rest beside."""
    key, sid, unit = (np.concatenate(x) for x in zip(*held, strict=True))
    key, sid, unit, nth = _sorted(key, sid, unit)
    most = nth > CROWD
    for crowded, rows in ((False, np.flatnonzero(~most)), (True, np.flatnonzero(most))):
        # The rest of a crowded key may go anywhere: it is dealt out by set.
        piece = ((sid if crowded else key)[rows] % _U(pieces)).astype(np.int32)
        order = np.lexsort((sid[rows], piece))  # a set's keys of a piece stand together, which packs well
        rows, piece = rows[order], piece[order]
        first = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1]))) if len(piece) else piece
        ends = [*first[1:], len(piece)]
        cut = lambda column, kind: [column[rows[s:e]].astype(kind).tobytes() for s, e in zip(first, ends, strict=False)]  # noqa: B023, E731
        columns = [piece[first].tolist(), [crowded] * len(first), cut(key, "<u8"), cut(sid, "<u8"), cut(unit, "<u2")]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PACKED, strict=True)], schema=PACKED)


def _sorted(key: np.ndarray, sid: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows by key and set, each once, and each row's number among those of its key."""
    order = np.lexsort((sid, key))
    key, sid, unit = key[order], sid[order], unit[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
    key, sid, unit = key[fresh], sid[fresh], unit[fresh]
    first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return key, sid, unit, np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))


def _indexed(pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for batch in batches:
            for text in batch.column(0):
                tokens = shingles(text.as_py())
                if not len(tokens):
                    continue
                sid = int.from_bytes(xxhash.xxh3_128_digest(tokens.tobytes())[:8], "little")
                if sid in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(sid)
                for band in bands(len(tokens)):
                    for units, made in keys(tokens, band):
                        held.append((made, np.full(len(made), sid, np.uint64), units))
                        size += len(made)
                if size >= HELD:
                    yield from _handed_on(held, pieces)
                    held, size = [], 0
        if held:
            yield from _handed_on(held, pieces)

    return run


MET = "crowded boolean, key long, unit int, a long, b long"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed keys in order of their pieces -> pairs of sets that share a key, and the members of crowded keys."""
    held, piece = [], None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for p, crowded, *packed in zip(*columns, strict=True):
            row = tuple(np.frombuffer(x, kind) for x, kind in zip(packed, ("<u8", "<u8", "<u2"), strict=True))
            if crowded:
                yield _rows(crowd=row)
                continue
            if p != piece and held:
                yield _of_piece(held)
                held = []
            piece = p
            held.append(row)
    if held:
        yield _of_piece(held)


def _rows(crowd: tuple | None = None, pairs: tuple | None = None) -> pa.RecordBatch:
    key, sid, unit = (np.zeros(0, np.int64) for _ in range(3)) if crowd is None else crowd
    a, b = (np.zeros(0, np.int64) for _ in range(2)) if pairs is None else pairs
    n, m, signed = len(key), len(a), lambda x: np.ascontiguousarray(x).view(np.int64) if x.dtype.itemsize == 8 else x
    columns = [
        pa.array([True] * n + [False] * m, pa.bool_()), pa.array(np.concatenate((signed(key), np.zeros(m, np.int64)))), pa.array(np.concatenate((unit.astype(np.int32), np.zeros(m, np.int32)))),
        pa.array(np.concatenate((signed(sid), signed(a)))), pa.array(np.concatenate((signed(sid), signed(b)))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["crowded", "key", "unit", "a", "b"])


def _of_piece(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    key, sid, unit, nth = _sorted(*(np.concatenate(x) for x in zip(*held, strict=True)))
    at = np.flatnonzero(nth == 0)
    size = np.repeat(np.diff(np.append(at, len(key))), np.diff(np.append(at, len(key))))
    low, high = [], []
    for step in range(1, CROWD):
        rows = np.flatnonzero((nth >= step) & (size <= CROWD))
        low.append(sid[rows - step])
        high.append(sid[rows])
    a, b = np.concatenate(low).view(np.int64), np.concatenate(high).view(np.int64)
    a, b = np.minimum(a, b), np.maximum(a, b)
    pairs = np.unique(np.stack((a, b), axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    crowd = size > CROWD
    return _rows((key[crowd], sid[crowd], unit[crowd]), (pairs[:, 0], pairs[:, 1]))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["set_no", "tokens"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (batch.column(k).to_pylist() for k in (2, 3))
        both = [len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(left, right, strict=True)]
        sizes = [pa.array([len(t) // 8 for t in x], pa.int64()) for x in (left, right)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), *sizes], names=["a", "b", "both", "n_a", "n_b"])


def _candidates(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b of sid -> those of set_no that may be alike; a sid that two sets share stands for both."""
    own = sets.select("sid", "set_no", "n", "sketch")
    side = lambda c: own.withColumnsRenamed({"sid": c, "set_no": f"no_{c}", "n": f"n_{c}", "sketch": f"sketch_{c}"})
    met = pairs.join(side("a"), "a").join(side("b"), "b").filter(_may("n_a", "n_b", "sketch_a", "sketch_b"))
    return met.select(F.least("no_a", "no_b").alias("a"), F.greatest("no_a", "no_b").alias("b"))


def _linked(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs a, b of set_no that are alike, by their whole sets."""
    wanted = durable(pairs, "candidates")
    asked = durable(wanted.select(F.explode(F.array("a", "b")).alias("set_no")).distinct().join(sets, "set_no").select("set_no", F.col("low.doc_id").alias("low_id"), F.col("low.text_hash").alias("low_hash")), "wanted")
    asked = F.broadcast(asked) if asked.count() <= FEW else asked
    own = docs.join(asked, (F.xxhash64("text") == F.col("low_hash")) & F.col("doc_id").eqNullSafe(F.col("low_id"))).select("set_no", "text")
    # Dealt out by set once, for both joins, which is why it is no table of its own.
    tokens = own.mapInArrow(_tokens, "set_no long, tokens binary").dropDuplicates(["set_no"])
    left, right = tokens.withColumnsRenamed({"set_no": "a", "tokens": "left"}), tokens.withColumnsRenamed({"set_no": "b", "tokens": "right"})
    met = wanted.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_shared, "a long, b long, both long, n_a long, n_b long")
    return durable(met.filter(F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * ALIKE).select("a", "b"), "links")


def _may(n_a: str, n_b: str, sketch_a: str, sketch_b: str) -> Column:
    """Whether two sets may be alike, by their sizes and by the bits of their sketches that differ, each for a shingle that differs at least."""
    bits = sum((F.bit_count(F.col(sketch_a)[k].bitwiseXOR(F.col(sketch_b)[k])) for k in range(SKETCH // 64)), F.lit(0))
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * ALIKE
    return sizes & (bits * (100 + ALIKE) <= (F.col(n_a) + F.col(n_b)) * (100 - ALIKE))


def _unsettled(crowd: DataFrame) -> DataFrame:
    """Rows (key, unit, sid) of crowded keys, thinned to those that two sets without a key of their own must share one of; of: how many crowded keys a set has."""
    bands = range(len(STARTS) - 1)
    band = F.shiftright("part", 4)
    allowed = F.element_at(F.create_map(*(F.lit(x) for k in bands for x in (k, scheme(k)[2]))), band)
    near = F.element_at(F.create_map(*(F.lit(x) for k in bands for x in (k, scheme(k)[3]))), band)
    own = Window.partitionBy("sid", "part")
    crowd = crowd.select("key", "sid", F.shiftright("unit", 5).alias("part"), F.col("unit").bitwiseAND(F.lit(31)).alias("segment"))
    segments = F.when(near, F.bit_count(F.bit_or(F.expr("shiftleft(1, segment)")).over(own))).otherwise(F.count(F.lit(1)).over(own))
    crowd = crowd.withColumn("segments", segments).filter(F.col("segments") > allowed)
    often = spread(crowd.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"))  # what only settled sets share is of no use any more
    placed = crowd.join(often, "key").withColumn("place", F.row_number().over(own.orderBy("often", "key"))).withColumn("of", F.count(F.lit(1)).over(own))
    return placed.filter(F.col("place") <= F.col("of") - allowed).select("key", "sid", "of")


def _roots(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """sets with root, the name of each one's component."""
    pieces = PIECES * parts(docs.sparkSession)
    packed = docs.select("text").mapInArrow(_indexed(pieces), "piece int, crowded boolean, keys binary, sids binary, units binary")
    dealt = packed.repartition(parts(docs.sparkSession), "piece").sortWithinPartitions("crowded", "piece")
    met = durable(dealt.mapInArrow(_met, MET), "met")
    crowd = durable(_unsettled(met.filter("crowded").select("key", "unit", F.col("a").alias("sid")).distinct()), "crowded")
    central = spread(crowd.groupBy("key").agg(F.max(F.struct("of", "sid")).alias("centre")).select("key", F.col("centre.sid").alias("centre")))
    stars = crowd.join(central, "key").filter("sid <> centre").select(F.least("sid", "centre").alias("a"), F.greatest("sid", "centre").alias("b"))
    pairs = met.filter("NOT crowded").select("a", "b").union(stars).distinct()
    links = _linked(_candidates(pairs, sets), sets, docs)
    roots = components(links, "alike").withColumnRenamed("node", "set_no")
    rooted = durable(sets.join(roots, "set_no", "left").withColumn("root", F.coalesce("root", "set_no")), "rooted")
    members = durable(crowd.select("key", "sid").join(rooted.select("sid", "set_no", "root", "n", "sketch"), "sid").drop("sid"), "members")
    hearts = spread(members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("heart")))
    outside = durable(members.join(hearts, "key").filter("root <> heart").select("key", *(F.col(c).alias(f"{c}_a") for c in ("set_no", "root", "n", "sketch"))), "outside")
    if outside.isEmpty():
        return rooted
    apart = outside.join(members, "key").filter((F.col("root_a") != F.col("root")) & _may("n_a", "n", "sketch_a", "sketch"))
    more = _linked(apart.select(F.least("set_no_a", "set_no").alias("a"), F.greatest("set_no_a", "set_no").alias("b")).distinct(), sets, docs)
    if more.isEmpty():
        return rooted
    name = rooted.select("set_no", "root")
    joined = more.join(name.withColumnsRenamed({"set_no": "a", "root": "root_a"}), "a").join(name.withColumnsRenamed({"set_no": "b", "root": "root_b"}), "b")
    tops = components(joined.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), "crowds").select(F.col("node").alias("root"), F.col("root").alias("top"))
    return rooted.join(tops, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Null and wordless texts have no shingles and are a component of their own, as is each row of such; a text of fewer
    words than a shingle has one. component_id is the smallest doc_id that links lead to; it is null only where none of
    them has an id. Repeated rows are repeated in the result. An empty table gives no rows; further columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long"), whole("text").alias("text"))
    named = plain.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_identity, "doc_id long, text_hash long, n long, sid long, rest long, sketch array<long>")
    rows = durable(named, "sets-of-rows")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("low")
    sets = durable(rows.filter("n > 0").groupBy("sid", "rest", "n").agg(low, F.first("sketch").alias("sketch")).withColumn("set_no", F.monotonically_increasing_id()), "sets")
    with scratch() as made:
        rooted = durable(_roots(plain, sets).select("sid", "rest", "low", "root"), "classes")
    for table in made[:-1]:
        forget(table)
    lowest = spread(rooted.groupBy("root").agg(F.min("low.doc_id").alias("component_id")))
    classes = rooted.join(lowest, "root").select("sid", "rest", "component_id")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.filter("n > 0").join(classes, ["sid", "rest"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)
