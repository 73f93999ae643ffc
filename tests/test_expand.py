"""Routes of expansion and cluster plans against plain loops."""

import random
from collections import Counter

import numpy as np
import pytest

from memloom.operators import expand, knowledge


def best(found, seeds, limit, score):
    return [(i, score(s)) for i, s in sorted(((i, s) for i, s in found.items() if i not in seeds), key=lambda x: (-x[1], x[0]))[:limit]]


def test_routes(spark):
    rng = random.Random(40)
    points = [(i, rng.choice([None, 0, 0, 0, 1, 2, 3]), None if i % 9 == 0 else [rng.gauss(0, 1) for _ in range(3)]) for i in range(80)]
    links = [(rng.randrange(80), f"e{rng.randrange(12)}") for _ in range(150)] + [(1, None)]
    edges = [(rng.randrange(40), rng.randrange(40), rng.randrange(1, 3)) for _ in range(60)]
    seeds = [(q, rng.randrange(80)) for q in range(15) for _ in range(rng.randrange(1, 4))] + [(20, 70), (20, 75), (21, 9999), (None, 1)]
    pf, lf = spark.createDataFrame(points, "id long, parent long, vec array<double>"), spark.createDataFrame(links, "id long, entity string")
    ef, sf = spark.createDataFrame(edges, "a long, b long, n long"), spark.createDataFrame(seeds, "query long, id long")
    parent, vec, unit = {i: p for i, p, _ in points}, {i: v for i, _, v in points}, lambda v: np.array(v) / np.linalg.norm(v)
    rows = lambda df: {(r.query, r.id): (pytest.approx(r.score), r.rank) for r in df.collect()}
    want = {"subject": {}, "entity": {}, "edge": {}}
    for q in sorted({q for q, _ in seeds if q is not None}):
        own = {i for a, i in seeds if a == q}
        up = {parent.get(i) for i in own} - {None}
        routes = {"subject": best({i: 0.5 for i, p, _ in points if p in up}, own, 4, float)}
        said = {e for i, e in links if i in own and e}
        routes["entity"] = best(Counter(i for i, e in set(links) if e in said), own, 4, lambda n: min(1, n / 5))
        met = Counter()
        for a, b, n in edges:
            for x, y in ((a, b), (b, a)):
                if x in own:
                    met[y] += n
        routes["edge"] = best(met, own, 4, lambda n: min(1, n / 3))
        if not routes["edge"]:
            one = next((vec[i] for i in sorted(own) if vec.get(i)), None)
            sims = {i: round(float(unit(v) @ unit(one)), 6) for i, _, v in points if v and one} if one else {}
            routes["edge"] = best({i: s for i, s in sims.items() if s > 0.8}, own, 4, float)
        for name, found in routes.items():
            want[name] |= {(q, i): (s, k) for k, (i, s) in enumerate(found, 1)}
    assert rows(expand.by_subject(pf, sf, 4)) == want["subject"] and rows(expand.by_entity(lf, sf, 4)) == want["entity"] and rows(expand.by_edge(ef, sf, 4, pf)) == want["edge"]
    got = {(r.query, r.id): (r.strategy, r.score) for r in expand.expand(pf, lf, ef, sf, 10).collect()}
    for q in {q for q, _ in want["subject"] | want["entity"] | want["edge"]}:
        merged = {}
        for name in ("subject", "entity", "edge"):
            for (a, i), (s, _) in want[name].items():
                if a == q:
                    merged.setdefault(i, (name, s))
        top = sorted(merged, key=lambda i: (-merged[i][1], ("subject", "entity", "edge").index(merged[i][0]), i))[:10]
        assert {i for a, i in got if a == q} == set(top) and all(got[q, i] == (merged[i][0], pytest.approx(merged[i][1])) for i in top)
    assert expand.expand(pf, lf, ef, sf.limit(0), 10).count() == 0


def test_cluster_plan(spark):
    text = "因为路由器故障，所以服务中断"
    rows = [(1, 0, text), (2, 0, "服务中断的记录"), (3, 1, None), (4, 1, "other"), (5, -1, "noise"), (6, None, "noise")] + [(100 + i, 7, text) for i in range(21)] + [(None, 0, "no id")]
    entities, bridge, links = knowledge.cluster_plan(spark.createDataFrame(rows, "id long, cluster int, text string"), prefix="day")
    assert sorted(map(tuple, entities.collect())) == [("group_day_0", text[:10] + "... [group_day_0]", 2), ("group_day_1", "... [group_day_1]", 2)]
    assert sorted(map(tuple, bridge.collect())) == [(1, "group_day_0"), (2, "group_day_0"), (3, "group_day_1"), (4, "group_day_1")]
    assert all((r.from_id, r.to_id) == (1, 2) for r in links.collect())


def test_synonyms_meet_as_words(spark):
    """Words that 200000 rows repeat, where rows joined with rows are 10^10."""
    from memloom.operators import expand

    rows = spark.range(200_000).selectExpr("id % 2 AS grp", "concat('w', id % 4) AS word").unionByName(spark.createDataFrame([(0, None), (None, "w1"), (2, "w1"), (2, "x")], "grp long, word string"))
    asked = spark.createDataFrame([(1, "w0"), (1, "w0"), (2, "w1"), (3, None), (4, "none")], "id long, word string")
    got = expand.synonyms(asked, rows)
    assert {(r.id, r.word) for r in got.collect()} == {(1, "w0"), (1, "w2"), (1, None), (2, "w1"), (2, "w3"), (2, "x")} and got.count() == 6
