"""Streaming queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.plans.catalog import query
from codestrata.streaming import jobs as J


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_counts(s, d):
    out = J.run_updates(J.tumbling_counts(J.event_stream(s, d)), ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events),
    h AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY user_id, k"""
)
def stream_sessions(s, d):
    out = J.run_to_table(J.sessions(J.event_stream(s, d)), mode="complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_type, CAST(count(DISTINCT event_id) AS BIGINT) AS n FROM events GROUP BY event_type")
def stream_first_seen(s, d):
    e = J.event_stream(s, d).select("event_id", "ts", "event_type")
    return J.run_to_table(J.first_seen(e.unionByName(e))).groupBy("event_type").agg(F.count("*").alias("n"))
