"""Queries of the stream over the events table; windows and sessions are additions of this engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import access


def i5_access_totals(spark, d):
    """Access deltas of all events, through micro-batches that count once."""
    t = access.drain(spark, f"{d}/events.parquet")
    return t.select("user_id", "n", F.unix_micros(F.col("last_at").cast("timestamp")).alias("last_us"))


def i5_windows(spark, d):
    """Counts per hour and type, through the stream."""
    w = access.drain_windows(spark, f"{d}/events.parquet")
    return w.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


def i5_sessions(spark, d):
    """Sessions with gaps of half an hour, through the stream."""
    s = access.drain_sessions(spark, f"{d}/events.parquet")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (i5_access_totals, i5_windows, i5_sessions)}
ORACLES = {
    "i5_access_totals": "SELECT user_id, count(*) AS n, max(epoch_us(ts)) AS last_us FROM events GROUP BY user_id",
    "i5_windows": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL",
    "i5_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events),
n AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM n GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
}
