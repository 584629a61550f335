"""Queries that run a table through Structured Streaming and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnpath.plans.registry import query
from cairnpath.sources.fixtures import h
from cairnpath.streaming import tracks


@query("stream_event_counts", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    events = tracks.files(spark, d, "events")
    return tracks.drained(events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")), "complete")


@query("stream_hourly", "WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL) SELECT * FROM h WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hours that the watermark has closed."""
    return tracks.drained(tracks.hourly(tracks.files(spark, d, "events"))).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


FIXES = [
    "user_id AS track_id", "event_id", "CAST(event_id * 10 AS BIGINT) AS t_s", f"CAST({h('event_id')} % 1000 AS DOUBLE) / 10e0 AS x_m",
    f"CAST({h('event_id * 3 + 1')} % 1000 AS DOUBLE) / 10e0 AS y_m", f"CAST({h('event_id * 7 + 2')} % 50 AS DOUBLE) AS accuracy_m",
]


@query("stream_accepted_fixes", f"WITH RECURSIVE fx AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t_s) AS pos FROM (SELECT {', '.join(FIXES)} FROM events) WHERE accuracy_m <= 35), r AS (SELECT track_id, pos, t_s AS kt, x_m AS kx, y_m AS ky, 1 AS n FROM fx WHERE pos = 1 UNION ALL SELECT f.track_id, f.pos, CASE WHEN ok THEN t_s ELSE kt END, CASE WHEN ok THEN x_m ELSE kx END, CASE WHEN ok THEN y_m ELSE ky END, CASE WHEN ok THEN n + 1 ELSE n END FROM (SELECT r.kt, r.kx, r.ky, r.n, fx.*, sqrt((x_m - kx) * (x_m - kx) + (y_m - ky) * (y_m - ky)) >= 5 OR t_s - kt >= 15 AS ok FROM r JOIN fx ON fx.track_id = r.track_id AND fx.pos = r.pos + 1) f) SELECT track_id, CAST(max(n) AS BIGINT) AS kept, max(kt) AS last_s FROM r GROUP BY track_id")
def stream_accepted_fixes(spark: SparkSession, d: str) -> DataFrame:
    fixes = tracks.files(spark, d, "events").selectExpr(*FIXES)
    return tracks.drained(tracks.accepted(fixes)).groupBy("track_id").agg(F.max("kept").alias("kept"), F.max("t_s").alias("last_s"))
