"""SimHash near-dedup with deletion-variant signatures.

Fingerprints within two differing bits: cut in two segments of 32 bits, one of them differs by at most one bit. Each
distinct fingerprint is indexed under the 64 variants in which one bit of one segment is a wildcard; equal keys meet in
an equi-join and are verified. A crowded key (over CROWD fingerprints) would give a square of pairs; its fingerprints are
linked instead by the values one bit away from them: two fingerprints have such a value (or themselves) in common exactly
if they differ by at most two bits, and at most 65 fingerprints have one in common. So no link is lost and no key gives
more than a fixed number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnpath.llm.common import durable, forget, parts, scratch, sorted_in, unused, whole
from cairnpath.llm.components import components

SHINGLE_WORDS, SEED, CROWD = 3, 42, 32
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str) -> int:
    """The fingerprint of one text, unsigned; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: 1 - SHINGLE_WORDS].tolist()
    ends = ends[SHINGLE_WORDS - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])


def _keyed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], names=["doc_id", "row_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), whole("text").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Distinct fingerprints fp -> pairs a, b whose components are those of all pairs within two bits."""
    # Fingerprints are a small table that Spark reads in few tasks; each makes 64 rows, so they are dealt out first.
    slots = fps.select("fp").repartition(parts(fps.sparkSession)).select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("slot"))
    segment = F.when(F.col("slot") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    wild = F.expr("shiftleft(1L, slot & 31)")
    keyed = slots.select("fp", F.expr("shiftleft(cast(slot as long), 32)").bitwiseOR(segment.bitwiseAND(F.bitwise_not(wild))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = durable(keyed.join(sorted_in(shared), "key"), "variants")
    a, b = met.filter(F.col("n") <= crowd).select("key", F.col("fp").alias("a")), met.filter(F.col("n") <= crowd).select("key", F.col("fp").alias("b"))
    low = F.expr("(a ^ b) & 4294967295L")
    # A pair may share many keys; it counts at the first of them alone.
    first = F.when(low == 0, F.lit(0)).when(F.bit_count(low) == 1, F.bit_count(low - 1)).otherwise(F.lit(32))
    at = F.shiftrightunsigned("key", 32)
    pairs = a.join(sorted_in(b), "key").filter((F.col("a") < F.col("b")) & (F.bit_count(F.expr("a ^ b")) <= 2) & (at == first)).select("a", "b")
    crowded = met.filter(F.col("n") > crowd).select("fp").distinct()
    near = crowded.select("fp", F.explode(F.expr("transform(sequence(0, 64), i -> if(i = 64, fp, fp ^ shiftleft(1L, i)))")).alias("near"))
    hubs = near.groupBy("near").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)  # 65 at most
    stars = hubs.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b").distinct()
    return pairs.union(stars)


def _roots(fps: DataFrame) -> DataFrame:
    """fp and root, the smallest fingerprint that links lead to, of those with links; only its last table is left."""
    with scratch() as made:
        roots = components(links(fps), "near").withColumnRenamed("node", "fp")
    for table in made[:-1]:
        forget(table)
    return roots


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Null and wordless texts have fingerprint 0 and link like any other. component_id is the smallest doc_id that links
    lead to; a null doc_id is never one unless its whole component has no id. Repeated rows are repeated in the result.
    An empty table gives no rows; further columns of docs are ignored.
    """
    rows = durable(fingerprints(docs), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = _roots(fps.select("fp"))
    rooted = durable(fps.join(sorted_in(roots), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(sorted_in(lowest), "root").select("fp", "component_id")
    return rows.join(sorted_in(named), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one of each component, that of its smallest doc_id.

    Rows are told apart by doc_id and text together: where ids are null or repeated, each component still keeps a row of
    its own. A row without an id stays only if its whole component has none, then that of the smallest hash of id and text.
    """
    # Ids are digits, so the first bar ends them.
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit("|"), whole("text")), 256))
    keyed = docs.select(F.col("doc_id").cast("long"), whole("text").alias("text"), key.alias("row_key"))
    rows = durable(keyed.mapInArrow(_keyed_fingerprints, "doc_id long, row_key binary, fp long"), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("low"))
    roots = _roots(fps.select("fp"))
    lows = fps.join(sorted_in(roots), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("low").alias("low"))
    name = unused(docs, "near_row_key")
    stay = lows.select(F.col("low.row_key").alias(name))
    return docs.withColumn(name, key).join(sorted_in(stay), name, "left_semi").dropDuplicates([name]).select(*(F.col(f"`{c}`") for c in docs.columns))
