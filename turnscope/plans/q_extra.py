"""Queries beyond the batch analysis: windows and sessions of events, as the streaming operators compute them."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscope.streaming import rates

from .views import table

Q, S = {}, {}


def daily_event_rates(spark, d):
    got = rates.windowed_rate(table(spark, d, "events"), "ts", F.col("value") > 50, ["event_type"])
    return got.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "rate")


def event_sessions(spark, d):
    got = rates.sessions(table(spark, d, "events"), "ts", "user_id")
    return got.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


Q["daily_event_rates"] = daily_event_rates
S["daily_event_rates"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, avg((value > 50)::INT) AS rate FROM events GROUP BY ALL"
Q["event_sessions"] = event_sessions
S["event_sessions"] = """WITH g AS (SELECT user_id, coalesce((ts - lag(ts) OVER w >= INTERVAL 30 MINUTE)::INT, 1) AS new, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id"""
