"""Trail graphs: cutting ways into edges, connected pieces and shortest distances, as joins in rounds.

Each round is one join and one aggregate over rows of nodes, written to the shared folder so that its lineage stays
short; rounds end when nothing changes, and their number is at most that of the edges on the longest path asked for.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that all executors share; one of its own where spark.checkpoint.dir is unset, in one process only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cairnpath-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def dealt(df: DataFrame) -> DataFrame:
    """df, to be joined by sorting both sides and not by way of the driver.

    Files are estimated by their packed size, and rows that explode makes of them aren't counted, so a table that looks
    small enough to be sent to every executor may fill the driver.
    """
    return df.hint("merge")


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    path = f"{shared(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = dealt(df.sparkSession.read.schema(df.schema).parquet(path))
    out._cairn_path = path
    return out


def unhinted(df: DataFrame) -> DataFrame:
    """What settled() wrote, to be joined in the way that its size asks for: few rows are sent to all executors, others are sorted."""
    return df.sparkSession.read.schema(df.schema).parquet(df._cairn_path)


def forget(df: DataFrame) -> None:
    """Removes what settled() wrote, once nothing reads it any more."""
    jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
    path = jvm.org.apache.hadoop.fs.Path(df._cairn_path)
    path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def both_ways(edges: DataFrame, cost: Column, back: Column) -> DataFrame:
    """Undirected edges (u, v) as directed ones (src, dst, cost)."""
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), cost.alias("cost")).union(edges.select(F.col("v").alias("src"), F.col("u").alias("dst"), back.alias("cost")))


def pieces(edges: DataFrame) -> DataFrame:
    """node and piece, the smallest node that it is connected with.

    Each round every node goes to its neighbour of the smallest hash, if that is under its own, and on from there; then links
    lead between what nodes went to. So chains are short whatever the numbers are, and links get fewer round by round.
    """
    c = F.col
    order = lambda n: F.struct(F.xxhash64(n).alias("h"), c(n).alias("to"))
    lower = lambda df, a, b: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()
    links, rounds = settled(lower(edges, "u", "v")), []
    while not links.isEmpty():
        both = links.select(c("a").alias("node"), c("b").alias("other")).union(links.select("b", "a"))
        up = settled(both.groupBy("node").agg(F.min(order("other")).alias("m")).select("node", F.least("m", order("node"))["to"].alias("to")))
        # Whoever is gone to has a link too, and so a row.
        old, up = up, settled(up.join(up.select(c("node").alias("to"), c("to").alias("on")), "to").select("node", c("on").alias("to")))
        forget(old)
        went = lambda e: up.select(c("node").alias(e), c("to").alias(f"{e}_to"))  # noqa: E731,B023
        old, links = links, settled(lower(links.join(went("a"), "a").join(went("b"), "b"), "a_to", "b_to"))
        forget(old)
        rounds.append(up)
    nodes = edges.select(c("u").alias("node")).union(edges.select("v")).distinct()
    if not rounds:
        return settled(nodes.withColumn("piece", c("node")))
    root = rounds.pop()
    while rounds:
        up = rounds.pop()
        whole = settled(up.join(root.select(c("node").alias("to"), c("to").alias("root")), "to", "left").select("node", F.coalesce("root", "to").alias("to")))
        forget(up)
        forget(root)
        root = whole
    name = root.groupBy("to").agg(F.min("node").alias("piece"))
    named = settled(nodes.join(root.join(name, "to").select("node", "piece"), "node", "left").select("node", F.coalesce("piece", "node").alias("piece")))
    forget(root)
    return named


#: Rows that a task holds of a table that rounds join again and again.
EACH = 500_000


def kept_by(df: DataFrame, *keys: str) -> DataFrame:
    """df written once and held by the executors, dealt out and sorted by keys: rounds that join it by them neither make, shuffle nor sort it again. let_go() ends it."""
    table = settled(df)
    parts = max(df.sparkSession.sparkContext.defaultParallelism, table.count() // EACH)
    held = table.repartition(parts, *keys).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)
    held._cairn_path = table._cairn_path
    return held


def let_go(held: DataFrame) -> None:
    held.unpersist()
    forget(held)


def improved(best: DataFrame, found: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """The least value of each key, of those so far and those found, as a table; better says whether it is new."""
    packed = F.struct(*value)
    known = best.select(*key, packed.alias("new"), packed.alias("old"))
    least = known.unionByName(found.select(*key, packed.alias("new")), allowMissingColumns=True).groupBy(*key).agg(F.min("new").alias("b"), F.min("old").alias("old"))
    return settled(least.select(*key, "b.*", (F.col("old").isNull() | (F.col("b") < F.col("old"))).alias("better")))


def reach(directed: DataFrame, sources: DataFrame, most: float | None = None) -> DataFrame:
    """Sources (node, source) -> for each node reached its least cost, and the source; the first source by name on a tie.

    Bellman-Ford over rows: only nodes that got better in the last round are joined with the edges, which are made and dealt
    out once.
    """
    edges = kept_by(directed.select("src", "dst", F.col("cost").alias("step")), "src")
    best = settled(sources.groupBy("node").agg(F.min("source").alias("source")).select("node", F.lit(0.0).alias("cost"), "source", F.lit(True).alias("better")))
    while not (fresh := best.filter("better")).isEmpty():
        steps = fresh.select(F.col("node").alias("src"), "cost", "source").join(edges, "src").select(F.col("dst").alias("node"), F.round(F.col("cost") + F.col("step"), 6).alias("cost"), "source")
        if most is not None:
            steps = steps.filter(F.col("cost") <= most)
        old, best = best, improved(best, steps, ["node"], ["cost", "source"])
        forget(old)
    let_go(edges)
    return best.drop("better")


def routes(directed: DataFrame, legs: DataFrame) -> DataFrame:
    """Legs (leg, start, goal) -> leg, cost and path, the nodes on the way; the first path by its nodes on a tie. Legs without a way have no row. Costs are over 0.

    Relaxation over rows of (leg, node), costs alone: what costs no less than the best way to the goal so far is given up. Then
    the steps that least costs are made of are followed back from the goals; only nodes on these ways carry paths.
    """
    c, key = F.col, ["leg", "node"]
    edges = kept_by(directed.select("src", "dst", c("cost").alias("step")), "src")
    goals = legs.select("leg", c("goal").alias("node"), F.lit(True).alias("last"))
    best = settled(legs.select("leg", c("start").alias("node"), F.lit(0.0).alias("cost"), F.lit(True).alias("better")))
    stepped = lambda df: df.select("leg", c("node").alias("src"), "cost").join(edges, "src").select("leg", "src", c("dst").alias("node"), c("cost").alias("so_far"), F.round(c("cost") + c("step"), 6).alias("cost"))
    while True:
        # A row for each leg: few enough to be sent to all, unless there are very many.
        limit = settled(best.join(goals, key, "left_semi").select("leg", c("cost").alias("least")))
        within = lambda df: df.join(unhinted(limit), "leg", "left").filter("least IS NULL OR cost <= least").drop("least")  # noqa: E731,B023
        if best.filter("better").isEmpty():
            break
        old, best = best, improved(best, within(stepped(best.filter("better"))), key, ["cost"])
        forget(old)
        forget(limit)
    least = best.select(*key, "cost")
    tight = kept_by(within(stepped(least)).filter("cost > so_far").join(least, [*key, "cost"]).select("leg", "src", c("node").alias("dst")).distinct(), "leg", "dst")
    let_go(edges)
    back = settled(least.join(goals, key, "left_semi").select(*key, F.array("node").alias("path"), F.lit(True).alias("better")))
    while not (fresh := back.filter("better")).isEmpty():
        steps = fresh.select("leg", c("node").alias("dst"), "path").join(tight, ["leg", "dst"]).select("leg", c("src").alias("node"), F.concat(F.array("src"), "path").alias("path"))
        old, back = back, improved(back, steps, key, ["path"])
        forget(old)
    let_go(tight)
    found = back.join(legs.select("leg", c("start").alias("node")), key, "left_semi").select("leg", "path")
    return found.join(limit.withColumnRenamed("least", "cost"), "leg").select("leg", "cost", "path")


def cut_ways(vertices: DataFrame) -> DataFrame:
    """Ways (way_id, pos, node_id, x_m, y_m) -> edges between nodes that ways share, a way's ends included, with how far along it they begin."""
    shared = vertices.groupBy("node_id").agg((F.count(F.lit(1)) > 1).alias("shared"))
    w = Window.partitionBy("way_id").orderBy("pos")
    dx, dy = F.col("x_m") - F.lag("x_m").over(w), F.col("y_m") - F.lag("y_m").over(w)
    placed = vertices.join(shared, "node_id").withColumn("step", F.sqrt(dx * dx + dy * dy)).withColumn("along", F.coalesce(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    ends = placed.withColumn("last", F.lead("pos").over(w).isNull()).filter(F.col("shared") | (F.col("pos") == 1) | F.col("last"))
    nxt = lambda c: F.lead(c).over(w)
    return ends.select("way_id", F.col("pos").alias("from_pos"), F.col("node_id").alias("u"), nxt("node_id").alias("v"), (nxt("along") - F.col("along")).alias("length_m"), F.col("along").alias("from_m")).filter("v IS NOT NULL")
