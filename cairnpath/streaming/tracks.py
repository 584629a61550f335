"""Recorded hikes as streams: fixes are accepted, and walked metres added up, as they come in."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairnpath.operators.graph import shared

#: Metres of accuracy, metres and seconds from the last fix kept.
ACCURATE, FAR, LATE = 35.0, 5.0, 15
OUT = "track_id long, t_s long, x_m double, y_m double, kept long"
STATE = "t_s long, x_m double, y_m double, kept long"


def _accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A fix is kept if it is accurate, isn't older than the last one kept, and is far enough from it in space or time."""
    last = list(state.get) if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["t_s", "event_id"])  # of one track and one batch of files
    out = []
    for t, x, y, accuracy in rows[["t_s", "x_m", "y_m", "accuracy_m"]].itertuples(index=False):
        if accuracy > ACCURATE or last and t < last[0]:
            continue
        if not last or ((x - last[1]) ** 2 + (y - last[2]) ** 2) ** 0.5 >= FAR or t - last[0] >= LATE:
            last = [int(t), float(x), float(y), (last[3] if last else 0) + 1]
            out.append((key[0], *last))
    if last:
        state.update(tuple(last))
    yield pd.DataFrame(out, columns=["track_id", "t_s", "x_m", "y_m", "kept"])


def accepted(fixes: DataFrame) -> DataFrame:
    """A stream of fixes (track_id, event_id, t_s, x_m, y_m, accuracy_m) -> those kept; the state of a track is one fix."""
    return fixes.groupBy("track_id").applyInPandasWithState(_accept, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def hourly(events: DataFrame) -> DataFrame:
    """Counts and sums of an event stream by hour and type; events over ten minutes late are left out."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    return marked.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a finite stream gives once all its input is read, as a table in spark.checkpoint.dir; "complete" is for small aggregates."""
    spark = stream.sparkSession
    root, name = shared(spark), f"drained-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/{name}-state")
    if mode == "complete":
        # The last batch holds the whole result.
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/{name}"))
        writer.start().awaitTermination()
    else:
        writer.format("parquet").option("path", f"{root}/{name}").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/{name}")


def files(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's file or files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
