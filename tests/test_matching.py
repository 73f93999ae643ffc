"""The skill cascade, silhouettes and components against plain versions."""

import random
from pathlib import Path

import numpy as np
import pytest

from memloom.operators import cluster, dedup, skills


def skill_rows(n=60):
    rng = random.Random(11)
    nouns = ["router", "cache", "vector", "graph", "token", "index"]
    return [(i, f"{rng.choice(nouns)}-{i}", f"{rng.choice(nouns)} {rng.choice(nouns)} tool", rng.choice(["ops", "data", None, ".archive"]), [rng.gauss(0, 1) for _ in range(6)]) for i in range(n)]


SKILLS = "id long, name string, description string, category string, vec array<double>"
QUERIES = "qid long, text string, vec array<double>"


def test_stages_see_only_open_queries(spark, tmp_path):
    rows = skill_rows()
    rng = random.Random(12)
    queries = [(i, f"{rng.choice(['router', 'cache', 'graph'])} for {rng.choice(['vector', 'index'])} data", [rng.gauss(0, 1) for _ in range(6)] if i % 3 else None) for i in range(30)]
    queries += [(100, "", [1.0] * 6), (101, None, [1.0] * 6), (102, "!!", None), (103, "router-0 unknown", [0.0] * 6), (104, "nothing shared", None)]
    seen = tmp_path / "seen"
    seen.mkdir()

    def factory():
        (seen / f"made-{random.random()}").touch()

        def judge(batch):
            for q in batch["qid"]:
                (seen / f"q{q}").touch()
            return [{c["id"]: 0.5 + c["id"] / 1000 for c in cs if c["id"] % 2 == 0} | {999: 1.0} if q % 4 else {} for q, cs in zip(batch["qid"], batch["candidates"])]

        return judge

    sf, qf = spark.createDataFrame(rows, SKILLS), spark.createDataFrame(queries, QUERIES)
    got = skills.match(qf, sf, factory, threshold=0.7).collect()
    stage = {r.qid: r.stage for r in got}
    asked = {int(p.name[1:]) for p in Path(seen).glob("q*")}
    assert asked and asked == {q for q in {r[0] for r in queries} if stage.get(q) in ("judge", "fallback")}
    assert {100, 101, 104}.isdisjoint(stage) and set(stage.values()) == {"early", "judge", "fallback"}
    for r in got:
        assert (r.score >= 0.5) == (r.stage == "judge") and r.rank <= 3 and r.id != 999
    # by hand: cosines, then words
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for qid, text, vec in queries[:30]:
        if vec is not None:
            sims = sorted(((-round(float(unit(vec) @ unit(s[4])), 6), s[0]) for s in rows if round(float(unit(vec) @ unit(s[4])), 6) >= 0.7))
            if sims and len(sims) <= 3:
                assert [(r.id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.qid == qid] == [(i, pytest.approx(min(0.49, 0.3 + 0.2 * -s), abs=1e-6)) for s, i in sims]


def test_keyword_candidates(spark):
    rows = [(1, "Router", "cache router", "ops", None), (2, "cache", "router", "router", None), (3, "old", "router cache", ".archive", None), (4, "b", None, None, None)]
    df = spark.createDataFrame(rows, SKILLS)
    got = skills.keyword_candidates(spark.createDataFrame([(1, "router", None), (2, "router cache", None), (3, "!", None), (4, "zzz", None)], QUERIES), df, keep=2).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 16), (1, 2, 4), (2, 1, 7), (2, 2, 9), (3, 1, 0), (3, 4, 0)]
    assert skills.match(spark.createDataFrame([], QUERIES), df).count() == 0 and skills.match(spark.createDataFrame([(1, "router", None)], QUERIES), df.limit(0)).count() == 0


def plain_silhouette(rows):
    out = {}
    for grp in {r[0] for r in rows}:
        own = [(i, c, np.array(v, float) / np.linalg.norm(v)) for g, i, c, v in rows if g == grp and c is not None and c >= 0 and v is not None and np.isfinite(v).all() and np.linalg.norm(v) > 0]
        for i, c, u in own:
            by = {}
            for j, d, w in own:
                if j != i:
                    by.setdefault(d, []).append(1 - float(u @ w))
            a, others = by.get(c), [np.mean(x) for d, x in by.items() if d != c]
            out[grp, i] = (min(others) - np.mean(a)) / max(min(others), np.mean(a)) if a and others else 0.0
    return out


def test_silhouette_equals_pairs(spark):
    rng = np.random.default_rng(13)
    rows = [(g, 100 * g + i, int(rng.integers(-1, 5)) if g else 0, (rng.normal(size=4) + i % 5).tolist()) for g in range(3) for i in range(40)]
    rows += [(1, 900, 77, [1.0, 0.0, 0.0, 0.0]), (1, 901, 1, [0.0] * 4), (1, 902, 1, None), (1, 903, None, [1.0] * 4)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "grp long, id long, cluster int, vec array<double>, n int")
    got, want = {(r.grp, r.id): r.silhouette for r in cluster.silhouette(df, block=3).collect()}, plain_silhouette(rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert cluster.silhouette(df.limit(0)).count() == 0


def test_groups_without_clusters_are_tried_again(spark):
    rng = np.random.default_rng(14)
    pair = [(1, i, (np.eye(8)[i // 2] + 0.01 * rng.normal(size=8)).tolist()) for i in range(6)]  # pairs only
    three = [(2, 10 + i, (np.eye(8)[i // 3] + 0.01 * rng.normal(size=8)).tolist()) for i in range(9)]
    df = spark.createDataFrame(pair + three, "grp long, id long, vec array<double>")
    once = {r.id: r.cluster for r in cluster.density_clusters(df, "grp", 3, 1).collect()}
    got = {r.id: r.cluster for r in cluster.clustered(df, "grp", (3, 2), 1).collect()}
    assert {once[i] for i in range(6)} == {-1} and len({got[i] for i in range(6)}) == 3 and all(got[i] == once[i] for i in range(10, 19))


def test_components_of_a_long_chain(spark, monkeypatch):
    rng = random.Random(15)
    names = list(range(5000))
    rng.shuffle(names)
    rows = list(zip(names, names[1:])) + [(6000, 6001), (7000, 7000)]
    rounds = []
    cut = dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df: rounds.append(1) or cut(df))
    got = {r.id: r.label for r in dedup.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert {got[i] for i in range(5000)} == {0} and got[6001] == 6000 and got[7000] == 7000
    assert (len(rounds) - 2) / 2 < 15
