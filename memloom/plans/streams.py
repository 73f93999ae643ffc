"""Streaming queries, driven over the whole event table; their oracles are the batch answers."""

from __future__ import annotations

from memloom.plans.base import Registry
from memloom.sources.shared import shared_root
from memloom.streaming import events as ev
from pyspark.sql import functions as F

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _shared(spark):
    """The folder all executors share; only a local master may go without the setting."""
    return shared_root(spark)


@R.add("str01_hourly", "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def str01_hourly(spark, sf_dir):
    out = ev.run(ev.hourly(ev.read_events(spark, f"{sf_dir}/events.parquet")), "complete", _shared(spark))
    return out.select(F.col("hour").cast("timestamp_ntz").cast("string").alias("hour"), "event_type", "n", F.round("mean", 6).alias("mean"))


@R.add("str02_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS n FROM s GROUP BY user_id")
def str02_sessions(spark, sf_dir):
    out = ev.run(ev.sessions(ev.read_events(spark, f"{sf_dir}/events.parquet")), "complete", _shared(spark))
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@R.add("str03_negative_counts", "SELECT user_id, CAST(count(*) AS DOUBLE) AS ema FROM events WHERE event_type = 'error' GROUP BY user_id")
def str03_negative_counts(spark, sf_dir):
    start = spark.createDataFrame([], "user_id long, ema double")
    return ev.keep_state(ev.read_events(spark, f"{sf_dir}/events.parquet"), start, ev.decayed_counts, _shared(spark))
