"""Merkle manifest of a table of documents: a radix-ranked trie of leaf hashes.

A row's place among its source's rows follows from digit histograms: rows are counted by (source, doc_id), the counts are
rolled up over ever shorter prefixes of the id's 10-bit digits, and a row's rank is the sum, over its digits, of what
smaller digits under the same prefix hold. No partition holds more than 1,025 counters and nothing is sorted as a whole.
Rows that share an id follow each other by leaf hash, ranked by a digit of the hash likewise; rows that are equal in
all are one counter, so that no number of copies makes a hot key.

The digits of a rank in the base of the fanout name the trie's nodes: a node at level k is all but the last k digits.
Nodes with the same prefix but for LEVELS digits are one group (3**5 rows at most), reduced by LEVELS levels in one
shuffle; the groups' hashes are the next round's nodes. Proofs come down the same way: each group hands its members the
siblings from it to the root, so that no proof is shuffled for each row. All of it is SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnpath.llm.common import durable, forget, parts, scratch

FANOUT = 3
#: Levels of the trie that are reduced in one shuffle.
LEVELS = 5
DIGIT_BITS = 10
#: The digits of a 64-bit id, the highest first; null ids come before all others.
DIGITS = [f"d{k}" for k in range(1, -(-64 // DIGIT_BITS) + 1)]
NO_PATH = "cast(array() as array<struct<l:string,r:string>>)"


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(text: Column) -> Column:
    return F.sha2(F.encode(F.concat(*(_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _field(text)), "UTF-8"), 256)


def _digits(column: Column) -> dict[str, Column]:
    last = len(DIGITS) - 1
    lower = lambda k: F.shiftrightunsigned(column, DIGIT_BITS * (last - k)).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
    highest = F.shiftright(column, DIGIT_BITS * last)  # signed, so negative ids come first
    return {d: F.coalesce(lower(k) if k else highest, F.lit(-(1 << DIGIT_BITS))) for k, d in enumerate(DIGITS)}


def _before(keys: list[str], by: str, count: str) -> Column:
    over = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(over), F.lit(0))


def _ranked(rows: DataFrame) -> DataFrame:
    """source, doc_id, leaf, other -> the same with rank (from 0 in each source) and n_leaves (of the source), once for each row."""
    same = durable(rows.groupBy("source", "doc_id", "leaf", "other").agg(F.count(F.lit(1)).alias("copies")), "leaves")
    # Equal ids: ranked among each other by a digit of the hash, and by the whole hash under it.
    tied = same.withColumn("h1", F.conv(F.substring("leaf", 1, 4), 16, 10).cast("int"))
    hashes = tied.groupBy("source", "doc_id", "h1").agg(F.sum("copies").alias("n"))
    ids = hashes.groupBy("source", "doc_id").agg(F.sum("n").alias("n")).withColumns(_digits(F.col("doc_id").cast("long")))
    levels = [ids]
    for k in reversed(range(len(DIGITS))):
        levels.append(levels[-1].groupBy("source", *DIGITS[:k]).agg(F.sum("n").alias("n")))
    *_, sizes = levels
    down = sizes.select("source", F.col("n").alias("n_leaves"), F.lit(0).cast("long").alias("start"))
    for k in range(1, len(DIGITS) + 1):
        keys, level = DIGITS[: k - 1], levels[len(DIGITS) - k]
        placed = level.withColumn("inner", _before(["source", *keys], DIGITS[k - 1], "n"))
        left, right = placed.alias("a"), down.alias("b")
        on = F.col("a.source").eqNullSafe(F.col("b.source"))
        for key in keys:
            on &= F.col(f"a.{key}") == F.col(f"b.{key}")
        more = ["doc_id"] if k == len(DIGITS) else []
        down = left.join(right, on).select("a.source", *(f"a.{d}" for d in DIGITS[:k]), *(f"a.{c}" for c in more), "b.n_leaves", (F.col("b.start") + F.col("inner")).alias("start"))
    at_id = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    by_hash = hashes.withColumn("inner", _before(["source", "doc_id"], "h1", "n")).alias("h")
    starts = by_hash.join(down.alias("i"), at_id("h", "i")).select("h.source", "h.doc_id", "h.h1", "i.n_leaves", (F.col("i.start") + F.col("h.inner")).alias("start"))
    own = tied.withColumn("inner", _before(["source", "doc_id", "h1"], "leaf", "copies")).alias("t")
    met = own.join(starts.alias("s"), at_id("t", "s") & (F.col("t.h1") == F.col("s.h1")))
    first = F.col("s.start") + F.col("t.inner")
    return met.select("t.source", "t.doc_id", "t.leaf", "t.other", "s.n_leaves", F.explode(F.sequence(first, first + F.col("t.copies") - 1)).alias("rank"))


def _up(nodes: Column) -> Column:
    """The hashes of every FANOUT consecutive nodes."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int")), lambda i: F.sha2(F.concat_ws("", F.slice(nodes, i * FANOUT + 1, FANOUT)), 256))


def _levels(nodes: Column, n: Column) -> Column:
    """nodes and, above them, n levels of their hashes."""
    start = F.array(nodes)
    return F.when(n == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, lambda made, _: F.concat(made, F.array(_up(F.element_at(made, -1))))))


def _path(levels: Column, place: Column) -> Column:
    """For the node at a place (from 0) of the lowest level: what stands left and right of it and of each node above, the last one left out."""
    def around(k: Column) -> Column:
        level, own = F.element_at(levels, k + 1), F.floor(place / F.pow(F.lit(float(FANOUT)), k)).cast("int")
        inside = own % FANOUT
        left = F.concat_ws("", F.slice(level, own - inside + 1, inside))
        right = F.concat_ws("", F.slice(level, own + 2, F.lit(FANOUT - 1) - inside))
        return F.struct(left.alias("l"), right.alias("r"))

    return F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(0), F.greatest(F.size(levels) - 2, F.lit(0))), around)).otherwise(F.expr(NO_PATH))


def _depth(n: Column) -> Column:
    """Levels until n nodes are one."""
    return sum((F.when(n > F.lit(FANOUT**k), 1).otherwise(0) for k in range(1, 40)), F.when(n > 1, 1).otherwise(0))


@dataclass
class Trie:
    """rounds: of each, the groups of nodes (tree, group, depth_left, members, levels), the lowest first; tops: tree and its last hash."""

    rounds: list[DataFrame]
    tops: DataFrame


def _trie(nodes: DataFrame, label: str, payload: list[str]) -> Trie:
    """tree (any key, null too), rank, n (of the tree's nodes), node, and payload columns of the lowest level."""
    width, rounds, tops = FANOUT**LEVELS, [], []
    level, extra = nodes.withColumn("left", _depth(F.col("n"))), payload
    while True:
        member = F.struct((F.col("rank") % width).cast("int").alias("place"), "node", *extra)
        grouped = level.groupBy("tree", "left", F.floor(F.col("rank") / width).cast("long").alias("group")).agg(F.array_sort(F.collect_list(member)).alias("members"))
        levels = _levels(F.expr("transform(members, m -> m.node)"), F.least(F.col("left"), F.lit(LEVELS)))
        made = durable(grouped.withColumn("levels", levels), f"{label}{len(rounds)}")
        rounds.append(made)
        top = F.element_at(F.element_at("levels", -1), 1)
        tops.append(made.filter(F.col("left") <= LEVELS).select("tree", top.alias("node")))
        if made.filter(F.col("left") > LEVELS).isEmpty():
            break
        level, extra = made.filter(F.col("left") > LEVELS).select("tree", (F.col("left") - LEVELS).alias("left"), F.col("group").alias("rank"), top.alias("node")), []
    out = tops[0]
    for more in tops[1:]:
        out = out.union(more)
    return Trie(rounds, out)


def _proofs(trie: Trie, above: DataFrame) -> DataFrame:
    """tree, node, payload and path, from the node to the root, of each lowest node; above: tree and its own path to the root."""
    upper = None
    for made in reversed(trie.rounds):
        ends = made.filter(F.col("left") <= LEVELS).alias("m").join(above.alias("b"), F.col("m.tree").eqNullSafe(F.col("b.tree"))).select("m.*", "b.path")
        if upper is not None:
            on = F.col("m.tree").eqNullSafe(F.col("b.tree")) & (F.col("m.group") == F.col("b.rank"))
            ends = ends.unionByName(made.filter(F.col("left") > LEVELS).alias("m").join(upper.alias("b"), on).select("m.*", "b.path"))
        rows = ends.select("tree", "group", "levels", F.col("path").alias("rest"), F.explode("members").alias("m"))
        upper = rows.select("tree", (F.col("group") * FANOUT**LEVELS + F.col("m.place")).alias("rank"), "m", F.concat(_path(F.col("levels"), F.col("m.place")), F.col("rest")).alias("path"))
    return upper


def _in_order(sources: DataFrame) -> DataFrame:
    """tree (the source), node -> also rank and n: places by source, null first, bytewise."""
    ordered = sources.repartitionByRange(parts(sources.sparkSession), F.col("tree").asc_nulls_first()).sortWithinPartitions(F.col("tree").asc_nulls_first())
    placed = durable(ordered.withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    starts = counts.select("part", F.sum("n").over(Window.orderBy("part")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"), "n")
    met = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return met.select("tree", "node", (F.col("upto") - F.col("n") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"), F.col("total").alias("n"))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source.

    Null fields are `-` in a leaf, empty ones `0:`. In a source rows ascend by doc_id, null first; rows of one id by leaf
    hash; equal rows follow each other, each with a place and a proof of its own. A null source is one of its own, the
    first. The tampered text lacks its newlines, where the id is drawn for it (a null id counts as the empty text, whose
    crc32 is 0, so it is drawn). An empty table gives no rows; further columns, whatever their names, are ignored.
    """
    cut = F.translate("text", "\n", "")
    drawn = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), "UTF-8")) % 2 == 0
    plain = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), F.col("text").cast("string"))
    hashed = plain.select("source", "doc_id", _leaf(F.col("text")).alias("leaf"), F.when(drawn & F.contains("text", F.lit("\n")), _leaf(cut)).alias("other"))
    with scratch() as made:
        ranked = _ranked(hashed)
        leaves = ranked.select(F.col("source").alias("tree"), "rank", F.col("n_leaves").alias("n"), F.col("leaf").alias("node"), "doc_id", "other")
        lower = _trie(leaves, "leaf-groups", ["doc_id", "other"])
        forget(made[0])
        subroots = durable(_in_order(lower.tops), "subroots")
        one = subroots.select(F.lit("all").alias("tree"), "rank", "n", "node", F.col("tree").alias("source"))
        upper = _trie(one, "root-groups", ["source"])
    nothing = upper.tops.select("tree", F.col("node").alias("root"), F.expr(NO_PATH).alias("path"))
    tops = _proofs(upper, nothing.select("tree", "path")).join(nothing.select("tree", "root"), "tree")
    paths = durable(tops.select(F.col("m.source").alias("tree"), F.col("m.node").alias("subroot"), "root", "path"), "paths")
    rows = _proofs(lower, paths.select("tree", "path")).alias("p").join(paths.select("tree", "subroot", "root").alias("t"), F.col("p.tree").eqNullSafe(F.col("t.tree")))
    siblings = F.concat_ws("", F.transform("p.path", lambda x: F.concat(x["l"], x["r"])))
    folded = F.aggregate("p.path", F.coalesce("p.m.other", "p.m.node"), lambda node, x: F.sha2(F.concat(x["l"], node, x["r"]), 256))
    out = rows.select(
        F.col("p.m.doc_id").alias("doc_id"), F.col("p.m.node").alias("leaf"), F.col("t.subroot").alias("subroot"), F.col("t.root").alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"), F.col("p.tree").alias("source"),
    )
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "source")
