"""Event KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.plans.base import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add(
    "agg01_event_kpis",
    """
SELECT event_type, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM events), 6) AS share,
round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS largest, arg_max(event_id, (value, -event_id)) AS largest_id
FROM events GROUP BY event_type
""",
)
def agg01_event_kpis(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    total = e.agg(F.count("*")).scalar()
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.round(F.count("*") / total, 6).alias("share"),
        F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"),
        F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"),
        F.max("value").alias("largest"),
        F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id"))).alias("largest_id"),
    )
