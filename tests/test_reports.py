"""Reports against plain Python."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.operators import reports

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(90)
    data = [(rng.choice("abc"), rng.randrange(5), rng.choice([None, 0.0, float(rng.randrange(100))]), START + timedelta(minutes=rng.randrange(5000)), i) for i in range(300)]
    return data, spark.createDataFrame(data, "g string, k long, v double, at timestamp, i long").cache()


def test_percentiles_and_router(rows):
    data, df = rows
    got = {r.g: r for r in reports.router(df, "g", "v").collect()}
    for g in "abc":
        own = [v for a, _, v, _, _ in data if a == g and v is not None]
        assert [got[g].p50, got[g].p95, got[g].p99] == pytest.approx(np.percentile(own, [50, 95, 99]).tolist())
        n = sum(r[0] == g for r in data)
        assert got[g].n == n and got[g].empty_pct == pytest.approx(100 * own.count(0.0) / n)
    use = {r.g: r for r in reports.token_usage(df, "g", "v").collect()}
    total = sum(v or 0 for _, _, v, _, _ in data)
    assert sum(r.share for r in use.values()) == pytest.approx(1) and use["a"].share == pytest.approx(sum(v or 0 for a, _, v, _, _ in data if a == "a") / total)
    assert reports.router(df.limit(0), "g", "v").count() == reports.token_usage(df.limit(0), "g", "v").count() == 0


def test_groups(rows):
    data, df = rows
    top = [(r.k, r.n, r.rnk) for r in reports.top_modules(df, "k", 3).orderBy("rnk").collect()]
    counts = sorted(((-sum(r[1] == k for r in data), k) for k in range(5)))[:3]
    assert top == [(k, -n, i) for i, (n, k) in enumerate(counts, 1)]
    trend = {r.k: (r.n, r.high) for r in reports.recent_trend(df, "k", "at", "i", F.col("v") > 50, 7).collect()}
    for k in range(5):
        last = sorted((r for r in data if r[1] == k), key=lambda r: (r[3], r[4]))[-7:]
        assert trend[k] == (len(last), sum((r[2] or 0) > 50 for r in last))
    out = {r.k: (r.latest, r.outlier) for r in reports.duration_outliers(df.where("v IS NOT NULL"), "k", "v", "at", "i").collect()}
    for k in range(5):
        own = sorted(((r[3], r[4]), r[2]) for r in data if r[1] == k and r[2] is not None)
        v = [x for _, x in own]
        away = abs(v[-1] - np.mean(v))
        assert out[k] == (v[-1], bool(away > 2 * np.std(v, ddof=1) and away > 0.5 * np.mean(v)))
    means = {r.g: r.mean_of_means for r in reports.mean_of_means(df, "g", "k", "v").collect()}
    for g in "abc":
        parts = [[r[2] for r in data if r[0] == g and r[1] == k and r[2] is not None] for k in range(5)]
        assert means[g] == pytest.approx(np.mean([np.mean(p) for p in parts if p]))


def test_shapes(rows):
    data, df = rows
    got = {r.bucket: r.n for r in reports.histogram(df, "v", (0, 20, 50)).collect()}
    assert got == {"0-20": sum(r[2] is not None and r[2] < 20 for r in data), "20-50": sum(r[2] is not None and 20 <= r[2] < 50 for r in data), "50+": sum(r[2] is None or r[2] >= 50 for r in data)}
    warned = {r.g: r.warnings for r in reports.warnings(df, "g", {"small": F.count("*") < 5, "high": F.max("v") > 50}).collect()}
    assert all(w == ["high"] for w in warned.values())
    report = {r.category: r.n for r in reports.category_report(df, "g", F.avg("v"), F.min("v"), F.max("v")).collect()}
    assert report["all"] == 300 and sum(n for c, n in report.items() if c != "all") == 300
    steps = df.limit(1).select(*[reports.confidence_step(F.lit(k), F.lit(0.98), F.lit(2.0)).alias(k) for k in ("click", "recall", "negated", "none")]).first()
    assert tuple(steps) == pytest.approx((1.0, 0.98 * 0.99**2, 0.49, 0.98 * 0.997**2))
    one = reports.judge_estimate(df, "g", F.lit(0.5), F.lit(1)).first()
    assert (one.est_avg, one.est_rate) == (pytest.approx(0.54), pytest.approx(0.54 * 1.15))
