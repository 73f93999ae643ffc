"""Joins over time against plain loops."""

import hashlib
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from memloom.operators import temporal

START = datetime(2024, 1, 1)


def test_versions_and_as_of(spark):
    rng = random.Random(70)
    rows = [(rng.randrange(5), START + timedelta(days=rng.randrange(60)), i) for i in range(60)]
    held = temporal.versions(spark.createDataFrame(rows, "k long, valid_from timestamp, v long"), "k", "valid_from", "v")
    asked = [(rng.randrange(7), START + timedelta(days=rng.randrange(-5, 80)), i) for i in range(50)] + [(1, None, 99)]
    got = {r.i: r.version.v if r.version else None for r in temporal.as_of(held, spark.createDataFrame(asked, "k long, at timestamp, i long"), "k", "at").collect()}
    for k, at, i in asked:
        own = sorted((f, v) for a, f, v in rows if a == k)
        valid = [v for (f, v), nxt in zip(own, own[1:] + [(None, None)]) if at and f <= at and (nxt[0] is None or nxt[0] > at)]
        assert got[i] == (valid[-1] if valid else None)


def test_followed(spark):
    rng = random.Random(71)
    rows = [(rng.randrange(3), START + timedelta(seconds=rng.randrange(400)), i) for i in range(120)]
    events = [(rng.randrange(3), START + timedelta(seconds=rng.randrange(400))) for _ in range(25)]
    got = {r.i: r.near for r in temporal.followed(spark.createDataFrame(rows, "k long, at timestamp, i long"), spark.createDataFrame(events, "k long, at timestamp"), "k", "at", 5, "near").collect()}
    assert got == {i: any(e == k and timedelta(0) <= at - b <= timedelta(seconds=5) for e, b in events) for k, at, i in rows} and any(got.values()) and not all(got.values())


def test_stale_and_unlinked(spark):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "e")], "id long, text string")
    hashes = spark.createDataFrame([(1, md5("a")), (2, "old"), (3, None), (4, "x")], "id long, hash string")
    assert sorted(r.id for r in temporal.stale(texts, hashes).collect()) == [2, 3]
    links = spark.createDataFrame([(1, 2), (None, 4)], "a long, b long")
    assert sorted(r.id for r in temporal.unlinked(texts.select("id"), "id", links, "a", "b").collect()) == [3, 5]


def test_cooccurrence_and_judges(spark):
    uses = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (2, 3), (3, 3), (None, 1)], "session long, subject long")
    assert sorted(map(tuple, temporal.cooccurrence(uses).collect())) == [(1, 2, 2, 1.0), (1, 3, 1, 0.5), (2, 3, 1, 0.5)]
    rows = [("a" if i % 3 else "b", START + timedelta(hours=i), float(i % 100), i) for i in range(400)]
    got = {r.g: (r.relevant_rate, r.mean) for r in temporal.rolling_judge(spark.createDataFrame(rows, "g string, at timestamp, v double, i long"), "g", "at", "v", "i", days=3, last=50, least=20).collect()}
    new = sorted((r for r in rows if r[1] >= rows[-1][1] - timedelta(days=3)), key=lambda r: r[1])[-50:]
    for g in "ab":
        own = [v for a, _, v, _ in new if a == g]
        assert got[g] == (sum(v >= 50 for v in own) / len(own) if len(own) >= 20 else None, sum(own) / len(own))


def test_tenses(spark):
    rows = [("现在的配置", 1, 0.8, None, "2023"), ("现在的配置", 2, 0.8, None, "2024-05-02"), ("以前的配置", 3, 0.8, "2025-01", None), ("以前的配置", 4, 0.8, "2024", None), ("2023-06-01 的配置", 5, 0.8, "2024", "2022-01-01"),
            ("2023-06-01 的配置", 6, 0.8, "2023-06", "2023"), ("配置", 7, 0.87654321, "2030", "1999"), ("以后的配置", 8, 0.87654321, "2030", "1999"), (None, 9, 0.5, "2030", None)]
    df = spark.createDataFrame(rows, "query string, id long, score double, valid_from string, valid_until string")
    got = {r.id: (r.score, r.demoted) for r in temporal.by_tense(df, "query", F.lit("2024-05-01")).collect()}
    assert got == {1: (0.4, True), 2: (0.8, False), 3: (0.4, True), 4: (0.8, False), 5: (0.2, True), 6: (0.8, False), 7: (0.87654321, False), 8: (0.8765, False), 9: (0.5, False)}
