"""Document fingerprints from spot signatures.

Wherever a common word stands, the content words that follow it form a chain; the set of a text's chains is its
fingerprint. Common words are what a text's own wording hangs on, so navigation and other lists give few chains. Sets
are compared by Jaccard likeness: where a limit is asked for, in similar(), sets are partitioned by length, those whose
sizes alone rule it out are never compared, and a comparison ends once the elements left can't lift it over the limit.
Where the likeness itself is asked for, in fingerprints(), there is no limit to prune by.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnpath.llm.common import durable, parts, spread, whole

#: Content words of a chain, and of a run without common words after which each word starts a chain (lists, other languages).
CHAIN, BARE = 2, 6
#: Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "a an and are as at be by for from has have he in is it of on or that the this to was were with not you "
    "der die das den dem des ein eine einer und ist im mit von zu auf für als auch nicht sich aus bei "
    "le la les un une des du de et en est que qui dans par pour sur pas avec au aux plus ce "
    "el los las una del y es con por para se su lo al más como pero sus".split()
)
_WORD = re.compile(r"[^\W_]+")


def spots(text: str) -> list[int]:
    """The sorted distinct hashes (32 bits) of a text's chains; of a text without chains its words as one, if it has words."""
    words = _WORD.findall(text.lower())
    content, follows, anchored = [], [], 0
    for w in words:
        if w in ANCHORS:
            anchored = len(content)
            follows.append((w, anchored))
        else:
            if len(content) - anchored >= BARE:
                follows.append(("", len(content)))
            content.append(w)
    whole_chains = len(content) - CHAIN
    chains = {f"{w} {' '.join(content[k : k + CHAIN])}" for w, k in follows if k <= whole_chains}
    if not chains:
        chains = {"\n" + (" ".join(words) or text.strip())} if words or text.strip() else set()
    return sorted({xxhash.xxh32_intdigest(c.encode("utf-8", "surrogatepass")) for c in chains})


def likeness(a: list[int], b: list[int], least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; 0 as soon as it is sure to be under least. Two empty sets are alike."""
    if not a and not b:
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    if least <= 0:
        both = len(set(a).intersection(b))
        return both / (len(a) + len(b) - both)
    i = j = both = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j, both = i + 1, j + 1, both + 1
        else:
            i, j = (i + 1, j) if a[i] < b[j] else (i, j + 1)
        most = both + min(len(a) - i, len(b) - j)
        if most < least * (len(a) + len(b) - most):
            return 0.0
    return both / (len(a) + len(b) - both)


def as_text(found: list[int]) -> str:
    return "".join(f"{h:08x}" for h in found)


def _bounds(docs: DataFrame, pieces: int) -> list[int]:
    """The first doc_id of each of about so many even ranges, ascending; only the ids are read for it."""
    cut = F.percentile_approx(F.col("doc_id").cast("long"), [k / pieces for k in range(pieces)], F.lit(20 * pieces))
    low = docs.agg(F.min(F.col("doc_id").cast("long")).alias("least"), cut.alias("cuts")).first()
    return sorted({low["least"], *low["cuts"]}) if low["least"] is not None else []


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and in it by place; of each range the last row is only there to be the next one of the row before."""
    columns: list[list] = [[] for _ in range(7)]

    def out() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        for c in columns:
            c.clear()
        return made

    before, size, guest = None, 0, None
    for batch in batches:
        for part, extra, doc_id, text in zip(*(batch.column(n) for n in ("part", "extra", "doc_id", "text")), strict=True):
            part, extra, text = part.as_py(), extra.as_py(), text.as_py()
            if extra and guest == part:
                continue  # one next row is enough
            guest = part if extra else guest
            found = spots(text)
            if before and before[0] == part:
                _, own_id, own, own_found = before
                n = len(own)
                edited = own[: n - n // 3] + text[: n // 3]
                edited_found = spots(edited)
                row = (own_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own_found), as_text(edited_found), likeness(own_found, edited_found), likeness(own_found, found))
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
                size += n
                if size > 1 << 22:
                    yield out()
                    size = 0
            before = None if extra else (part, doc_id.as_py(), text, found)
    yield out()


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by the beginning of the next document's. Documents follow each other by
    descending doc_id, rows that repeat an id by text, those without an id last; after the last comes the first, which is
    itself the next one in a table of one row. Null counts as the empty text, whose fingerprint is empty; two empty
    fingerprints are alike. An empty table gives no rows; further columns are ignored.

    Ids are cut into ranges; each row goes to its range, and the first row of each range also to the one before it in
    the order, so texts are shuffled once and a task holds two of them at a time.
    """
    pieces = parts(docs.sparkSession)
    low = _bounds(docs, pieces)
    array = F.array(*(F.lit(x).cast("long") for x in low)) if low else F.array().cast("array<long>")
    rows = docs.select(F.col("doc_id").cast("long"), whole("text").alias("text"))
    # Ranges in the order of descending ids: 0 has the largest, the last one those without an id.
    at = F.when(F.col("doc_id").isNull(), F.lit(len(low))).otherwise(F.lit(len(low)) - F.size(F.filter(array, lambda b: b <= F.col("doc_id"))))
    own = rows.select(at.cast("int").alias("part"), F.lit(False).alias("extra"), "doc_id", "text")
    heads = own.groupBy("part").agg(F.max("doc_id").alias("head"))
    order = sorted((r["part"], r["head"]) for r in heads.collect())  # a row for each range
    if not order:
        return own.sparkSession.createDataFrame([], _ROW)
    spark = docs.sparkSession
    links = [(order[k - 1][0], part, head) for k, (part, head) in enumerate(order)]
    links = F.broadcast(spark.createDataFrame(links, "to_part int, part int, head long"))
    guests = own.join(links, "part").filter(F.col("doc_id").eqNullSafe(F.col("head"))).select(F.col("to_part").alias("part"), F.lit(True).alias("extra"), "doc_id", "text")
    dealt = own.union(guests).repartition(max(pieces, len(order)), "part").sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), "text")
    return dealt.mapInArrow(_compared, _ROW)


def similar(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs a < b of fingerprint classes with a likeness of least or more: a, b (fingerprints), likeness.

    Classes are distinct fingerprints; null and empty texts have none. Sets are partitioned by length, each partition
    reaching from a length to that over least, so sets alike enough are in the same partition or in neighbours. A pair must
    also share one of each set's rarest elements, as many as likeness allows to be missing and one: sets meet by partition
    and element in an equi-join, and a comparison ends once it can't reach the limit any more. An element that many sets
    have is rare in none of them, and of two sets both must list it, so common elements stay out of the index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [as_text(spots(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["fingerprint"])

    sets = durable(docs.select(whole("text").alias("text")).mapInArrow(run, "fingerprint string").filter("fingerprint <> ''").distinct(), "spots")
    split = F.expr("transform(sequence(1, length(fingerprint), 8), i -> substring(fingerprint, i, 8))")
    items = sets.select("fingerprint", F.explode(split).alias("item"))
    counts = spread(items.groupBy("item").agg(F.count(F.lit(1)).alias("n")))
    ranked = items.join(counts, "item").groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("rare"))  # of one text
    prefix = F.size("rare") - F.ceil(F.lit(least) * F.size("rare")) + 1
    size = F.size("rare")
    # The partition of a length; the least whole number keeps lengths at a partition's edge from falling short of it.
    part = F.floor(F.log(size.cast("double")) / math.log(1 / least) + 1e-9).cast("int")
    index = ranked.select("fingerprint", size.alias("size"), part.alias("part"), F.explode(F.slice("rare", 1, prefix)).alias("r")).select("fingerprint", "size", "part", "r.item")
    a = index.select(F.col("fingerprint").alias("one"), F.col("size").alias("n_one"), "part", "item")
    b = index.select(F.col("fingerprint").alias("two"), F.col("size").alias("n_two"), F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), "item")
    smaller = (F.col("n_one") < F.col("n_two")) | (F.col("n_one") == F.col("n_two")) & (F.col("one") < F.col("two"))
    met = a.join(b, ["part", "item"]).filter(smaller & (F.col("n_one") >= least * F.col("n_two"))).select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = lambda t: [int(t[i : i + 8], 16) for i in range(0, len(t), 8)]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([likeness(ints(x.as_py()), ints(y.as_py()), least) for x, y in zip(batch.column(0), batch.column(1), strict=True)], pa.float64())], names=["a", "b", "likeness"])

    return met.mapInArrow(verify, "a string, b string, likeness double").filter(F.col("likeness") >= least)

