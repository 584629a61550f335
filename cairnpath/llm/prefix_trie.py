"""Prefix trie of conversations.

Turns are numbered by one range sort; conversations are rebuilt by a join; equal ones become one sequence with a weight.
A prefix is named by the exclusive or of 128-bit hashes of its turns, each hashed with its place, which adds up over parts
of a conversation and so needs no walk along a long one.

Sequences are dealt out by the digest of their first turn, several first turns to a bucket, and each bucket's tries are
dictionaries of nodes, built and then summed in postorder by one loop each. A first-turn subtrie that holds more than its
share of the turns is dealt out anew by the prefix with its next turn, and so on: that recursion is one aggregate of the
turns below each prefix, and the shallowest prefixes below the share are the subtries' tops. The prefixes above them, and
the root, are summed from the tops by aggregates over the sequences that carry them: what is below a prefix is carried by
one sequence each (that of the smallest conversation), whose sums of the rest of its way count at every prefix of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnpath.llm.common import durable, parts

#: Turns of a conversation summed in one window; longer ones are summed by parts.
STRETCH = 4096
#: Turns of a bucket at most, whatever the number of partitions; a subtrie's share is a fourth of a bucket.
BUCKET = 100_000
#: Ids in one packed piece of a node's list of ends.
PACK = 1024
#: A conversation takes up to CYCLE - 1 turns from the first one of its FAMILY.
CYCLE, FAMILY = 9, 5
NODES = (
    "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_rep long, "
    "above_conv long, q1 long, q2 long"
)


def _numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place i from 1, and conv_id with its number of turns."""
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = turns.repartitionByRange(parts(turns.sparkSession), *by).sortWithinPartitions(*by)
    laid = durable(dealt.select("conv_id", "digest", "bytes", F.monotonically_increasing_id().alias("at")), "turns").withColumn("part", F.shiftright("at", 33))
    runs = laid.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))  # one for each partition at most
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = laid.join(runs.withColumn("before", before), ["conv_id", "part"])
    return placed.select("conv_id", "digest", "bytes", (F.col("at") - F.col("first") + F.col("before") + 1).alias("i")), runs.groupBy("conv_id").agg(F.sum("n").alias("n_turns"))


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of rebuilt conversations (conv_id, pos, bytes, e1, e2), and every conversation with its len."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8")
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), F.unhex(F.sha2(said, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    numbered, sizes = _numbered(turns)
    asked = sizes.withColumn("h", F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % CYCLE).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    lenders = sizes.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns"))
    lead = F.least("h", F.coalesce("base_turns", F.lit(0)))
    first = F.col("conv_id") == F.col("base")
    plan = durable(asked.join(lenders, "base", "left").select("conv_id", "base", "h", lead.alias("lead"), (lead + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("len"), first.alias("first")), "rebuilding")
    own = numbered.join(plan, "conv_id").filter(F.col("first") | (F.col("i") > F.col("h"))).select("conv_id", F.when(F.col("first"), F.col("i")).otherwise(F.col("lead") + F.col("i") - F.col("h")).alias("pos"), "digest", "bytes")
    taken = numbered.filter(F.col("i") < CYCLE).withColumnRenamed("conv_id", "base").join(plan.filter("NOT first AND lead > 0").select("conv_id", "base", "lead"), "base")
    lent = taken.filter(F.col("i") <= F.col("lead")).select("conv_id", F.col("i").alias("pos"), "digest", "bytes")
    lanes = [F.xxhash64(F.lit(k), "pos", "digest").alias(f"e{k}") for k in (1, 2)]
    return durable(own.unionByName(lent).select("conv_id", "pos", "bytes", *lanes), "rebuilt"), plan.select("conv_id", "len")


def _running(rows: DataFrame, made: dict[str, Column], back: bool = False) -> DataFrame:
    """rows of sequences (rep, pos) and running totals (made: name -> aggregate) from the front, or from the back, own row included."""
    rows = rows.withColumn("stretch", F.floor(F.col("pos") / STRETCH))
    order = lambda c: F.col(c).desc() if back else F.col(c)
    whole = rows.groupBy("rep", "stretch").agg(*(a.alias(c) for c, a in made.items()))
    others = whole.select("rep", "stretch", *(F.col(c).alias(f"{c}_rest") for c in made))
    earlier = Window.partitionBy("rep").orderBy(order("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    totals = {c: F.expr(("bit_xor" if c[0] == "p" else "sum") + f"({c}_rest)").over(earlier) for c in made}
    rests = others.select("rep", "stretch", *(F.coalesce(t, F.lit(0)).alias(f"{c}_rest") for c, t in totals.items()))
    within = Window.partitionBy("rep", "stretch").orderBy(order("pos")).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.select("*", *(a.over(within).alias(c) for c, a in made.items()))
    both = {c: (F.col(c).bitwiseXOR(F.col(f"{c}_rest")) if c[0] == "p" else F.col(c) + F.col(f"{c}_rest")) for c in made}
    return inner.join(rests, ["rep", "stretch"]).select(*rows.columns[:-1], *(b.alias(c) for c, b in both.items()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed ids in order of (rep, piece) -> a hash of each rep's; holds one piece at a time."""
    rep, state, done = None, None, []
    for batch in batches:
        for r, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if r != rep:
                if state:
                    done.append((rep, state.hexdigest()))
                rep, state = r, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["rep", "ends_sha256"])
            done = []
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()])], names=["rep", "ends_sha256"])


def _ends(members: DataFrame, sequences: DataFrame) -> DataFrame:
    """rep and the hash of the ids of all that are equal to it. Hashing is serial: one task reads a list, in packed pieces."""
    alone = sequences.filter("n = 1").select("rep", F.sha2(F.encode(F.col("rep").cast("string"), "UTF-8"), 256).alias("ends_sha256"))
    many = members.join(sequences.filter("n > 1").select("rep", "len", "s1", "s2"), ["len", "s1", "s2"])
    packs = many.groupBy("rep", F.floor(F.col("conv_id") / PACK).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    ordered = packs.repartition(parts(packs.sparkSession), "rep").sortWithinPartitions("rep", "piece").select("rep", "ids")
    return alone.union(ordered.mapInArrow(_digests, "rep long, ends_sha256 string"))


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    """The tries of one bucket: dictionaries of nodes, filled along each sequence, then summed from the last node to the first."""
    rows = rows.sort_values(["rep", "pos"])
    kids: list[dict] = [{}]  # the first stands above all tops
    up, reps, depth, size, convs, ends, q1s, q2s = [0], [0], [0], [0], [0], [None], [0], [0]
    last, at = None, 0
    columns = ("rep", "n", "len", "pos", "bytes", "e1", "e2", "p1", "p2")
    for rep, n, length, pos, said, e1, e2, p1, p2 in zip(*(rows[c].tolist() for c in columns), strict=True):
        if rep != last:
            last, at, key = rep, 0, (p1, p2)
        else:
            key = (e1, e2)
        node = kids[at].get(key)
        if node is None:
            node = kids[at][key] = len(kids)
            kids.append({})
            for column, value in ((up, at), (reps, rep), (depth, pos), (size, said), (convs, 0), (ends, None), (q1s, p1 ^ e1), (q2s, p2 ^ e2)):
                column.append(value)
        convs[node] += n
        if pos == length:
            ends[node] = rep
        at = node
    leaves, saved = [0 if k else 1 for k in kids], [(c - 1) * s for c, s in zip(convs, size, strict=True)]
    for node in range(len(kids) - 1, 0, -1):  # a node comes after its parent
        leaves[up[node]] += leaves[node]
        saved[up[node]] += saved[node]
    cut = slice(1, None)
    above = [reps[u] if u else None for u in up[cut]]
    out = {
        "conv_id": reps[cut], "depth": depth[cut], "n_convs": convs[cut], "n_children": [len(k) for k in kids[cut]], "n_leaves": leaves[cut],
        "saved_tokens": saved[cut], "end_rep": pd.array(ends[cut], "Int64"), "above_conv": pd.array(above, "Int64"), "q1": q1s[cut], "q2": q2s[cut],
    }
    return pd.DataFrame(out)


def prefix_nodes(conversations: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id belong to no conversation. A null turn comes first; turns of one number follow each other by
    role and by the SHA-256 of role and text, repeated rows all count. Null and empty role or text are the same. A
    conversation without turns is a member of the root alone. An empty table gives no rows, not even the root's; further
    columns are ignored.
    """
    spark = conversations.sparkSession
    turns, lengths = _rebuilt(conversations)
    whole = turns.groupBy("conv_id").agg(F.bit_xor("e1").alias("s1"), F.bit_xor("e2").alias("s2"))
    members = durable(lengths.join(whole, "conv_id", "left").select("conv_id", "len", F.coalesce("s1", F.lit(0)).alias("s1"), F.coalesce("s2", F.lit(0)).alias("s2")), "members")
    sequences = durable(members.groupBy("len", "s1", "s2").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n")), "sequences")
    ways = turns.withColumnRenamed("conv_id", "rep").join(sequences.select("rep", "n", "len"), "rep")
    paths = durable(_running(ways, {"p1": F.bit_xor("e1"), "p2": F.bit_xor("e2")}), "paths")
    total = paths.count()
    buckets = max(parts(spark), -(-total // bucket))
    share = max(1, total // (4 * buckets))

    name = ["pos", "p1", "p2"]
    firsts = paths.filter("pos = 1")
    large = firsts.groupBy("p1", "p2").agg(F.sum("len").alias("below")).filter(F.col("below") > share)
    deep = paths.join(firsts.join(large, ["p1", "p2"]).select("rep"), "rep")
    own = F.struct("rep", "bytes", F.col("p1").bitwiseXOR(F.col("e1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("e2")).alias("q2"))
    below = deep.groupBy(*name).agg(
        F.sum(F.col("len") - F.col("pos") + 1).alias("below"), F.sum("n").alias("n_convs"), F.min(own).alias("own"), F.max(F.when(F.col("pos") == F.col("len"), F.col("rep"))).alias("end_rep")
    )
    heavy = durable(below.filter(F.col("below") > share).select(*name, "n_convs", F.col("own.rep").alias("conv_id"), "own.bytes", "own.q1", "own.q2", "end_rep"), "heavy")
    weight = F.when(F.col("rep") == F.col("conv_id"), (F.col("n_convs") - 1) * F.col("h.bytes")).otherwise(F.lit(0))
    upper = durable(deep.alias("d").join(heavy.alias("h"), name).select("rep", *name, weight.alias("weight")), "upper")

    cuts = upper.groupBy("rep").agg((F.max("pos") + 1).alias("cut"))
    cut = F.coalesce("cut", F.lit(1))
    tops = paths.join(cuts, "rep", "left").filter(F.col("pos") == cut).select("rep", cut.alias("cut"), F.pmod(F.xxhash64("p1", "p2"), F.lit(buckets)).alias("bucket"))
    light = paths.join(tops, "rep").filter("pos >= cut").drop("cut")
    small = durable(light.groupBy("bucket").applyInPandas(_tries, NODES), "tries")

    roots = small.filter("above_conv IS NULL")
    rest = upper.join(roots.select(F.col("conv_id").alias("rep"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")), "rep", "left")
    carried = _running(rest, {"way": F.sum("weight")}, back=True)
    sums = carried.groupBy(*name).agg(F.sum(F.coalesce("leaves", F.lit(0))).alias("n_leaves"), F.sum(F.col("way") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"))
    inner = heavy.join(sums, name).select(F.col("pos").alias("depth"), "p1", "p2", "conv_id", "n_convs", "n_leaves", "saved_tokens", "end_rep", "q1", "q2")
    top_sums = roots.agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    weights = heavy.agg(F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("weights"))
    first = sequences.agg(F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), F.max(F.when(F.col("len") == 0, F.col("rep"))).alias("end_rep")).filter("conv_id IS NOT NULL")
    nil = F.lit(None).cast("long")
    root = first.crossJoin(top_sums).crossJoin(weights).select(  # one row each
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), "conv_id", "n_convs", F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + F.coalesce("weights", F.lit(0))).alias("saved_tokens"), "end_rep", nil.alias("q1"), nil.alias("q2"),
    )
    crown = durable(inner.unionByName(root), "crown")
    children = roots.select("depth", "q1", "q2").union(crown.select("depth", "q1", "q2")).groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    above = crown.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    crowned = crown.join(children, ["depth", "p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_rep"]
    joined = crowned.select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_rep", "q1", "q2").unionByName(roots.drop("above_conv")).join(above, ["depth", "q1", "q2"], "left").select(columns)
    nodes = joined.union(small.filter("above_conv IS NOT NULL").withColumnRenamed("above_conv", "parent_conv_id").select(columns))
    ends = _ends(members, sequences).withColumnRenamed("rep", "end_rep")
    return nodes.join(ends, "end_rep", "left").select(*columns[:-1], F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
