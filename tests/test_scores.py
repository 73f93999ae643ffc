"""Scores and choices against plain Python."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from memloom.operators import scores

NOW = datetime(2024, 3, 1, tzinfo=timezone.utc)


def test_filter_and_span(spark):
    rng = random.Random(80)
    rows = [(q, i, round(rng.random() * 1.2, 3), rng.choice([None, NOW - timedelta(days=rng.randrange(50))])) for q in range(8) for i in range(rng.randrange(1, 12))]
    df = spark.createDataFrame([*rows, rows[0]], "query long, id long, score double, at timestamp")
    got = {(r.query, r.id): (r.final_score, r.rank) for r in scores.filtered(df, F.lit(NOW), 0.3).collect()}
    fused = {(q, i): s * (0.3 + 0.7 * (math.exp(-(NOW - at).days / 30) if at else 0.5)) for q, i, s, at in rows if s >= 0.3}
    assert got.keys() == fused.keys() and all(got[k][0] == pytest.approx(v) for k, v in fused.items())
    for q in range(8):
        own = sorted((k for k in fused if k[0] == q), key=lambda k: (-fused[k], k[1]))
        assert [got[k][1] for k in own] == list(range(1, len(own) + 1))
    kept = {(r.query, r.id) for r in scores.span_cut(df.distinct(), 10).collect()}
    for q in range(8):
        own = sorted(((s, i) for a, i, s, _ in rows if a == q), key=lambda x: (-x[0], x[1]))
        pos = [s for s, _ in own if s > 0]
        n = len(own)
        if n > 3 and len(pos) >= 2:
            span = max(pos) - min(pos)
            n = 3 if span > 0.9 else max(3, min(5, n)) if span > 0.7 else n
        assert {i for a, i in kept if a == q} == {i for _, i in own[:n]}


def test_columns(spark):
    rows = [(NOW, NOW - timedelta(days=3), None, 2.0, 4.0, 80.0, 0.3), (NOW, None, 1.5, None, 9.0, None, 0.9)]
    df = spark.createDataFrame(rows, "at timestamp, last timestamp, a double, b double, c double, kw double, emb double")
    one, two = df.select(scores.best_known("a", "b").alias("known"), scores.access_weight("at", "last").alias("w"), scores.decayed(F.col("emb"), F.lit(0.5)).alias("d"), scores.sort_key(F.col("kw"), F.col("emb")).alias("k"), scores.most_results(F.col("c").cast("int") * 4).alias("m")).collect()
    assert (one.known, two.known) == (2.0, 1.5) and one.w == pytest.approx(0.9**3) and two.w == 1.0
    assert (one.d.low_priority, two.d.low_priority) == (True, False) and (one.k, two.k) == (pytest.approx(0.8), pytest.approx(0.18)) and (one.m, two.m) == (5, 1)


def test_dates(spark):
    cases = [("2024", "2024-05", 0), ("2024-01", "2023-12-31", 1), ("2024-01-02", "2024-01-10", -1), (None, "2024", 0), ("2024-02-01 10:00:00", "2024-02", 0), ("0999-01", "2024", -1)]
    df = spark.createDataFrame(cases, "a string, b string, want int")
    assert all(r.got == r.want for r in df.withColumn("got", scores.date_order(F.col("a"), F.col("b"))).collect())


def test_groups(spark):
    old, new = spark.createDataFrame([("a", 4.0), ("b", 0.6), ("c", 1.0)], "k string, ema double"), spark.createDataFrame([("b", 1), ("d", 2), ("b", 1)], "k string, n long")
    assert {r.k: r.ema for r in scores.negatives(old, new, 14).collect()} == {"a": 2.0, "b": 2.3, "c": 0.5, "d": 2.0}
    skills = spark.createDataFrame([(2, "p", "abc", 1), (1, "p", "abd", 5), (3, "p", "longer", 9), (4, "q", None, 2)], "id long, path string, name string, usage long")
    assert {tuple(r) for r in scores.variants(skills).collect()} == {("p", "abd", 9), ("q", None, 2)}
    rows = spark.createDataFrame([("x", 60.0), ("x", 40.0), ("x", None), ("y", None)], "g string, s double")
    assert {tuple(r) for r in scores.rollouts(rows, "g", "s").collect()} == {("x", 60.0, 40.0, 20.0, 0.5), ("y", None, None, None, None)}
    items = spark.createDataFrame([(i, "k" if i % 2 else "l", float(i // 4)) for i in range(12)], "id long, kind string, s double")
    assert sorted(r.id for r in scores.best_of_kind(items, "kind", "s", "id", 2, spark.createDataFrame([(9,)], "id long")).collect()) == [8, 10, 11]
