"""Greedy, iterative and vector operators against plain Python; sources, sinks and streams."""

import json
import random

import numpy as np
import pytest

from memloom.operators import cluster, dedup, parse, rank, vectors
from memloom.sources import files, sinks
from memloom.streaming import events as ev
from pyspark.sql import functions as F


def jaccard(a, b):
    return len(a & b) / len(a | b)


def sets_of(rng, n):
    base = [frozenset(rng.sample("abcdefghijklmnop", 8)) for _ in range(5)]
    return {i: set(rng.choice(base)) ^ set(rng.sample("abcdefghijklmnop", rng.randint(0, 2))) for i in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_dedup_is_the_sequential_result(spark, seed):
    data = sets_of(random.Random(seed), 60)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in data.items()], "id long, items array<string>")
    pairs = dedup.similar_pairs(df, 0.7)
    want = {(a, b) for a in data for b in data if a < b and jaccard(data[a], data[b]) >= 0.7}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    kept = []
    for i in sorted(data):
        if not any((k, i) in want for k in kept):
            kept.append(i)
    out = dedup.survivors(df.select("id", F.col("id").alias("ord")), pairs)
    assert sorted(r.id for r in out.where("kept").collect()) == kept


def test_minhash_finds_what_exact_finds(spark):
    data = sets_of(random.Random(3), 40)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in data.items()], "id long, items array<string>")
    got = {(r.a, r.b) for r in dedup.minhash_pairs(df, 0.85).collect()}
    assert got == {(a, b) for a in data for b in data if a < b and jaccard(data[a], data[b]) > 0.85}


def test_components(spark):
    edges = [(1, 2), (3, 2), (5, 6), (9, 8), (8, 7), (7, 6)]
    got = {r.id: r.label for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(50, 5))
    m[7] = m[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "id long, vec array<double>")
    got = vectors.nearest(df, df.where("id % 10 = 0").select(F.col("id").alias("qid"), "vec"), 4, block=9).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = {(q, r + 1): i for q in range(0, 50, 10) for r, i in enumerate(sorted(range(50), key=lambda j: (-s[q, j], j))[:4])}
    assert {(r.qid, r.rank): r.id for r in got} == want


def test_matches_over_many_blocks(spark):
    """Orders, groups and earlier rows against brute force, with tiles of a few rows, copies, a null vector and a null group."""
    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(60, 4)), 1)
    m[20:30] = m[5]
    grp = [None if i == 59 else 0 if i % 3 else i % 4 for i in range(60)]
    df = spark.createDataFrame([(i, m[i].tolist(), grp[i]) for i in range(60)] + [(99, None, 0)], "id long, vec array<double>, grp int")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    new = df.withColumnRenamed("id", "qid")
    for order, key in (("best", lambda q: lambda j: (-s[q, j], j)), ("first", lambda q: lambda j: j), ("last", lambda q: lambda j: -j)):
        for within in (None, "grp"):
            got = vectors.nearest(df, new, 2, 0.2, block=7, order=order, among="earlier", within=within).collect()
            fits = lambda q, j: j < q and s[q, j] >= 0.2 and (within is None or (grp[q] is not None and grp[q] == grp[j]))
            want = {(q, r + 1): j for q in range(60) for r, j in enumerate(sorted((j for j in range(60) if fits(q, j)), key=key(q))[:2])}
            assert {(r.qid, r.rank): r.id for r in got} == want
    counts = {r.bucket: r.n for r in vectors.similarity_counts(df, [0.0, 0.5], block=7).collect()}
    pairs = s[np.triu_indices(60, 1)]
    assert counts == {0: (pairs < 0).sum(), 1: ((pairs >= 0) & (pairs < 0.5)).sum(), 2: (pairs >= 0.5).sum()}
    assert vectors.nearest(df.limit(0), new, 2).count() == vectors.similarity_counts(df.limit(0), [0.0]).count() == 0


def test_attention_over_many_blocks(spark):
    rng = np.random.default_rng(5)
    m = np.round(rng.normal(size=(40, 4)), 1)
    m[10:20] = m[3]
    df = spark.createDataFrame([(i, m[i].tolist(), i % 2) for i in range(40)], "id long, vec array<double>, grp int")
    want = {}
    for q in range(40):
        ids = [j for j in range(40) if j % 2 == q % 2 and j != q]
        raw = np.round(m[ids] @ m[q] / 2, 6)
        soft = np.exp(raw - raw.max()) / np.exp(raw - raw.max()).sum()
        kept = sorted((-round(x, 9), j) for x, y, j in zip(soft, raw, ids) if x >= 0.1 / len(ids) and y > 0)[:3]
        want |= {(q, j): pytest.approx(-x, abs=1e-8) for x, j in kept}
    got = {(r.query, r.id): r.soft for r in vectors.attend(df, "grp", keep=3, block=7).collect()}
    assert got == want


def test_centroid_and_ema(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 2, [3.0, 4.0]), ("a", 3, None), ("b", 1, [float("nan"), 1.0])], "k string, o int, v array<double>")
    assert [(r.k, r.centroid, r.n) for r in vectors.centroid(df, "k", "v").collect()] == [("a", [2.0, 3.0], 2)]
    out = vectors.ema_fold(df.where("k = 'a' AND v IS NOT NULL"), "k", "o", "v").first()
    assert out.vec == pytest.approx([1.2, 2.2])


def test_density_clusters():
    rng = np.random.default_rng(1)
    centres = np.eye(3) * 10
    x = np.concatenate([centres[k] + rng.normal(0, 0.05, (15, 3)) for k in range(3)])
    labels = cluster.tree_clusters(x, 5, 2)
    assert [len(set(labels[15 * k : 15 * k + 15]) - {-1}) for k in range(3)] == [1, 1, 1] and len(set(labels) - {-1}) == 3
    assert cluster.tree_clusters(x[:1], 2, 2).tolist() == [-1]


def test_mmr_prefers_fresh_texts(spark):
    rows = [("q", 1, "aaa bbb", 1.0), ("q", 2, "aaa bbb", 0.99), ("q", 3, "xyz", 0.9), ("r", 4, "", 0.5)]
    got = rank.mmr(spark.createDataFrame(rows, "query string, id long, text string, score double"), 2).collect()
    assert {(r.query, r.rank): r.id for r in got} == {("q", 1): 1, ("q", 2): 2, ("r", 1): 4} or {(r.query, r.rank): r.id for r in got} == {("q", 1): 1, ("q", 2): 3, ("r", 1): 4}


def test_diverse_is_the_greedy_walk(spark):
    rng = random.Random(5)
    rows = [(0, i, f"s{rng.randrange(6)}", f"k{rng.randrange(4)}", rng.randrange(50)) for i in range(40)]
    sources, kinds, want = set(), set(), set()
    for _, i, s, k, _ in sorted(rows, key=lambda r: (-r[4], r[1])):
        if s not in sources or k not in kinds:
            want.add(i)
            sources.add(s)
            kinds.add(k)
    got = rank.diverse(spark.createDataFrame(rows, "grp int, id long, source string, kind string, score int"))
    assert {r.id for r in got.collect()} == want


def test_confidence_fold(spark):
    rows = [("k", i, i, False, False, False) for i in range(3)] + [("k", 9, 9, False, True, False)]
    r = rank.confidence_fold(spark.createDataFrame(rows, "k string, ts int, tie int, recalled boolean, clicked boolean, negated boolean")).first()
    assert r.confidence == pytest.approx(0.5 * 0.997**3 * 0.95 + 0.05, abs=1e-6) and r.misses == 0


def test_bootstrap_interval_covers_the_mean(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(x)) for x in rng.normal(10, 2, 400)]
    r = rank.bootstrap_ci(spark.createDataFrame(rows, "grp string, value double").repartition(4)).first()
    assert r.low < np.mean([v for _, v in rows]) < r.high and r.high - r.low < 1


def test_chunks_hold_every_character(spark):
    text = "\n".join("x" * n for n in (10, 2500, 400, 3, 700))
    got = rank.chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), 1000).orderBy("chunk").collect()
    assert all(len(r.text) <= 1000 for r in got) and sum(r.text.count("x") for r in got) == text.count("x") and {r.id for r in got} == {1}


def test_parse(spark):
    rows = [('ok {"h": true, "confidence": 0.8} x',), ('[1, {"kt": 1, "confidence": 2}]',), ("none",), (None,), ('{"h": true, "confidence": 0.1}',)]
    df = spark.createDataFrame(rows, "s string")
    got = [tuple(r.m) for r in df.select(parse.parse_mask("s").alias("m")).collect()]
    assert got == [(True, False, False, False, 0.8), (False, True, False, False, 1.0), (True,) * 4 + (0.0,), (True,) * 4 + (0.0,), (True,) * 4 + (0.1,)]
    assert [r.j for r in df.select(parse.parse_json("s").alias("j")).collect()][2:4] == [None, None]


def test_files(spark, tmp_path):
    log = tmp_path / "trace.jsonl"
    log.write_text('{"timestamp": "2024-01-01T1", "event": "mask", "k": 1}\n{bad\n\n{"timestamp": "2024-01-02T1", "event": "mask", "k": 2}\n')
    schema = "timestamp string, event string, k int"
    assert files.json_lines(spark, str(log), schema).count() == 2
    assert files.event_log(spark, str(log), schema, "2024-01-02", ["mask"])["mask"].first().k == 2
    with pytest.raises(Exception):
        files.strict_json(spark, str(log), schema, lines=True).collect()
    states = tmp_path / "states"
    states.mkdir()
    (states / "a.json").write_text(json.dumps({"status": "ok"}))
    (states / "b.json").write_text(json.dumps({"job_name": "c", "status": "error"}))
    assert {(r.name, r.status) for r in files.state_files(spark, str(states), "job_name string, status string", ["a", "c"]).collect()} == {("a", "ok"), ("c", "error")}
    (tmp_path / "app.log").write_text("2024-01-01 10:00:00 ERROR mod.x: boom\nnoise\n")
    assert files.log_lines(spark, str(tmp_path / "app.log")).first().module == "mod.x"
    texts = tmp_path / "texts" / "sub"
    texts.mkdir(parents=True)
    (texts / "a.md").write_text("# Title here\n" + "body " * 20)
    (texts / "b.md").write_text("tiny")
    (texts / "c.bin").write_bytes(b"x" * 80)
    got = {r.path.rsplit("/", 1)[1]: (r.reason, r.title) for r in files.text_folder(spark, str(tmp_path / "texts")).collect()}
    assert got == {"a.md": ("", "Title here"), "b.md": ("size", None), "c.bin": ("extension", None)}
    (tmp_path / "mem.txt").write_text("one x§two§one  x§§three")
    assert [r.entry for r in files.delimited_entries(spark, str(tmp_path / "mem.txt")).orderBy("pos").collect()] == ["one x", "two", "three"]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, 5, "a"), (2, 7, "b")], "k long, w long, name string")
    delta = spark.createDataFrame([(2, 3, "c"), (3, 1, "d"), (3, 4, None)], "k long, w long, name string")
    got = {(r.k, r.w, r.name) for r in sinks.upsert(old, delta, ["k"], {"w": "greatest", "name": "new"}).collect()}
    assert got == {(1, 5, "a"), (2, 7, "c"), (3, 4, "d")}
    assert sinks.insert_ignore(old, delta, ["k"]).count() == 3
    days = spark.createDataFrame([(f"2024-01-{i:02d}", i) for i in range(1, 32)], "date string, n long")
    out = sinks.daily(days, spark.createDataFrame([("2024-01-31", 99)], "date string, n long")).collect()
    assert len(out) == 30 and out[0].n == 99
    sinks.ledger(old, str(tmp_path / "ledger"), "patched", "2024-01-01T00:00:00Z")
    assert spark.read.json(str(tmp_path / "ledger")).where("event = 'patched'").count() == 2
    texts = spark.createDataFrame([(1, "x" * 600), (2, "y")], "id long, text string")
    kept, rest = sinks.archive(texts, 500)
    assert kept.first().n == 600 and {len(r.text) < 600 for r in rest.collect()} == {True}


def test_first_events_within_watermark(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (2, "2024-01-01 00:01:00")]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(path)
    out = ev.run(ev.first_events(ev.read_events(spark, path), ["user_id"]), "append", str(tmp_path))
    assert sorted(r.user_id for r in out.collect()) == [1, 2]


def test_large_groups_get_the_labels_of_the_whole_group(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    x = np.concatenate([c + 0.08 * rng.normal(size=(25, 8)) for c in centres] + [rng.normal(size=(20, 8))])
    df = spark.createDataFrame([(k % 2, k, [float(z) for z in v]) for k, v in enumerate(x)], "grp long, id long, vec array<double>")
    parts = lambda: {frozenset(r.id for r in rows) for rows in _by_cluster(cluster.density_clusters(df, "grp", 5, 2).collect())}
    whole = parts()
    assert len(whole) > 6
    monkeypatch.setattr(cluster, "BLOCK", 20)
    assert parts() == whole


def _by_cluster(rows):
    found = {}
    for r in rows:
        found.setdefault((r.grp, r.cluster), []).append(r)
    return found.values()
