"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. All blocks of all texts are sorted and each distinct one gets an
integer name; then adjacent names are paired and the pairs sorted and named again, until one name is left of each text.
Two texts have the same last name of the same level only if all their bytes are the same: equality never rests on a hash.
(The hash of a block only decides where it is sorted to; blocks are told apart by their bytes. Rows are found again by
doc_id and SHA-256, so rows that repeat an id are told apart by the latter.)

Sorting deals rows out by (hash, salt), so that a block which a third of all texts share is spread over many tasks. A
block that lies on both sides of a boundary between tasks gets its first task's name; the list of such blocks has at
most two groups a task. The text itself is shuffled once, for the first level.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnpath.llm.common import SPACE, durable, parts, sorted_in, unused, whole

BLOCK_BYTES = 4096
#: Names are task << TASK_SHIFT | rank in the task.
TASK_SHIFT = 40


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (spot, key) in, the rows with names out, and a row for each key of the first and the last spot."""
    base, rank = TaskContext.get().partitionId() << TASK_SHIFT, -1
    before: tuple | None = None
    first: list[tuple] = []
    first_spot, last, open_first = None, [], True
    schema = None
    for batch in batches:
        if not batch.num_rows:
            continue
        spot, key = batch.column("spot").to_numpy(zero_copy_only=False), batch.column("key")
        fresh = np.ones(len(spot), dtype=bool)
        fresh[1:] = (spot[1:] != spot[:-1]) | pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
        fresh[0] = before is None or before != (spot[0], key[0].as_py())
        ranks = rank + np.cumsum(fresh)
        rank = int(ranks[-1])
        names = base + ranks
        seen = lambda rows: [(int(spot[i]), key[i].as_py(), int(names[i])) for i in rows]
        if first_spot is None:
            first_spot = spot[0]
        if open_first:
            until = len(spot) if spot[-1] == first_spot else int(np.argmax(spot != first_spot))
            first += seen(np.flatnonzero(fresh[:until]))
            open_first = until == len(spot)
        start = int(np.searchsorted(spot, spot[-1]))
        last = (last if last and last[0][0] == spot[-1] and start == 0 else []) + seen(start + np.flatnonzero(fresh[start:]))
        before = (spot[-1], key[-1].as_py())
        keep = [n for n in batch.schema.names if n not in ("spot", "key")]
        columns = [batch.column(n) for n in keep]
        nothing = len(spot)
        schema = pa.schema([*(batch.schema.field(n) for n in keep), ("name", pa.int64()), ("edge_spot", pa.int64()), ("edge_key", pa.binary())])
        yield pa.RecordBatch.from_arrays([*columns, pa.array(names), pa.nulls(nothing, pa.int64()), pa.nulls(nothing, pa.binary())], schema=schema)
    if schema is not None:
        edges = first if last and first and last[0][0] == first[0][0] else first + last
        columns = [pa.nulls(len(edges), schema.field(i).type) for i in range(len(schema) - 3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([e[2] for e in edges], pa.int64()), pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.binary())], schema=schema)


def name_keys(df: DataFrame, label: str) -> DataFrame:
    """df with a binary column key -> its other columns and name, a long that two rows share exactly if their keys are equal.

    The result is a durable table. Nulls in key aren't allowed; other columns may hold anything.
    """
    others = [c for c in df.columns if c != "key"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "key")
    dealt = df.withColumn("spot", F.xxhash64("key")).withColumn("salt", F.xxhash64(*others))
    ordered = dealt.repartitionByRange(parts(df.sparkSession), "spot", "salt").sortWithinPartitions("spot", "key").drop("salt")
    named = durable(ordered.mapInArrow(_named, f"{kinds}, name long, edge_spot long, edge_key binary"), label)
    edges = named.filter(F.col("edge_spot").isNotNull())
    same = edges.groupBy("edge_spot", "edge_key").agg(F.min("name").alias("first_name"), F.collect_set("name").alias("names")).filter(F.size("names") > 1)
    alias = same.select("first_name", F.explode("names").alias("name"))
    # At most two groups a task are in it, whatever the input holds.
    rows = named.filter(F.col("edge_spot").isNull()).drop("edge_spot", "edge_key").join(F.broadcast(alias), "name", "left")
    return rows.select(*others, F.coalesce("first_name", "name").alias("name"))


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space is replaced by one space; null is the empty text.
    Of equal texts the smallest doc_id stays (null ids come after all others and name no group that has an id). Rows that
    repeat a doc_id and its text each count in group_size and have the same decision. An empty table gives no rows;
    further columns of docs, whatever their names, are ignored.
    """
    norm = docs.select("doc_id", F.encode(F.regexp_replace(whole("text"), SPACE, " "), "UTF-8").alias("bytes"))
    ids = norm.select("doc_id", "bytes", F.unhex(F.sha2("bytes", 256)).alias("sha"), F.greatest(F.lit(1), F.ceil(F.length("bytes") / block_bytes)).cast("int").alias("n_blocks"))
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: F.substring("bytes", i * block_bytes + 1, F.lit(block_bytes))))
    level = name_keys(ids.select("doc_id", "sha", "n_blocks", cut.alias("pos", "key")), "blocks")
    rows = level.filter("pos = 0").select("doc_id", "sha", "n_blocks", "name")
    done = []
    deepest = level.agg(F.max("n_blocks")).first()[0] or 1
    open_ = level.filter("n_blocks > 1").select("doc_id", "sha", "n_blocks", "pos", "name")
    depth, width = 0, 1
    while width < deepest:
        depth, width = depth + 1, width * 2
        half = lambda side: F.coalesce(F.max(F.when(F.col("pos") % 2 == side, F.col("name"))), F.lit(-1))
        pairs = open_.groupBy("doc_id", "sha", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("pair")).agg(half(0).alias("left"), half(1).alias("right"))
        keyed = pairs.select("doc_id", "sha", "n_blocks", F.col("pair").alias("pos"), F.encode(F.concat_ws(",", "left", "right"), "UTF-8").alias("key"))
        level = name_keys(keyed, f"pairs{depth}")
        done.append(level.filter(F.col("n_blocks") <= width).select("doc_id", "sha", F.lit(depth).alias("depth"), F.col("name").alias("last_name")))
        open_ = level.filter(F.col("n_blocks") > width)
    short = rows.filter("n_blocks = 1").select("doc_id", "sha", F.lit(0).alias("depth"), F.col("name").alias("last_name"))
    named = short
    if done:
        ends = reduce(DataFrame.union, done).withColumnsRenamed({"doc_id": "end_id", "sha": "end_sha"})
        long = rows.filter("n_blocks > 1")
        named = short.union(long.join(sorted_in(ends), F.col("doc_id").eqNullSafe(F.col("end_id")) & (F.col("sha") == F.col("end_sha"))).select("doc_id", "sha", "depth", "last_name"))
    # As a table of its own, so that the join deals out both sides and a group with very many rows can be split.
    groups = durable(named.groupBy("depth", "last_name").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    out = named.join(sorted_in(groups), ["depth", "last_name"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs whose texts exact_groups() keeps, one of each group, all columns as they are.

    Null is the empty text. Of equal texts the one with the smallest id stays, one without an id only if none has any; of
    rows that repeat an id and its text any one stays. An empty table gives no rows; columns may have any names.
    """
    sha, kept_id, kept_sha = unused(docs, "text_sha"), unused(docs, "kept_id"), unused(docs, "kept_sha")
    groups = exact_groups(docs).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha)).distinct()
    keyed = docs.withColumn(sha, F.sha2(F.encode(F.regexp_replace(whole("text"), SPACE, " "), "UTF-8"), 256))
    kept = keyed.join(sorted_in(groups), F.col(sha).eqNullSafe(F.col(kept_sha)) & F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")
    return kept.dropDuplicates([sha, "doc_id"]).drop(sha)
