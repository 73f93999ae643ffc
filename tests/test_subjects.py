"""Offsets of subjects, local queries and moves between parents against numpy."""

import random

import numpy as np
import pytest

from memloom.operators import vectors


def test_offsets_and_local_queries(spark):
    rng = random.Random(30)
    rows = [(i % 2, 10 * (i % 2) + i % 3, [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)] + [(7, 70, [1.0, 2.0, 3.0, 4.0]), (0, 0, None), (None, 1, [1.0] * 4)]
    df = spark.createDataFrame(rows, "parent long, subject long, vec array<double>")
    got = {(r.parent, r.subject): (np.array(r.offset), r.n) for r in vectors.subject_offsets(df).collect()}
    for (p, s), (offset, n) in got.items():
        own = np.array([v for a, b, v in rows if (a, b) == (p, s) and v])
        rest = np.array([v for a, b, v in rows if a == p and b != s and v])
        assert n == len(own) and offset == pytest.approx(own.mean(0) - (rest.mean(0) if len(rest) else 0))
    assert len(got) == 7
    asked = spark.createDataFrame([(1, 0, [1.0, 1.0, 1.0, 1.0]), (2, 70, [1.0, 1.0, 1.0, 1.0]), (3, 999, [1.0, 0.0, 0.0, 0.0])], "qid long, subject long, vec array<double>")
    moved = {r.qid: r.vec for r in vectors.local_queries(asked, vectors.subject_offsets(df)).collect()}
    assert moved[1] == pytest.approx(1 + 0.3 * got[0, 0][0]) and moved[2] == [1.0] * 4 and moved[3] == [1.0, 0.0, 0.0, 0.0]


def test_moves_in_order(spark):
    rng = random.Random(31)
    parents = [(i, [rng.gauss(0, 1) for _ in range(3)] if i != 4 else None, [5, 1, 2, 0, 0, None][i]) for i in range(6)]
    moves = [(k, [rng.gauss(0, 1) for _ in range(3)] if k % 7 else None, rng.choice([0, 1, 2, 3, None]), rng.choice([0, 1, 2, 3, 4])) for k in range(40)] + [(41, [1.0], 0, 1)]
    pf = spark.createDataFrame(parents, "id long, vec array<double>, n long")
    mf = spark.createDataFrame(moves, "ord long, vec array<double>, source long, target long")
    state = {i: (None if v is None else np.array(v), n or 0) for i, v, n in parents}
    for _, v, a, b in moves:
        if v is None:
            continue
        for i, leaves in ((b, False), (a, True)) if a == b else ((a, True), (b, False)):
            if i is None:
                continue
            vec, n = state[i]
            if vec is not None and len(vec) != len(v):
                continue
            if leaves and n > 1 and vec is not None:
                state[i] = ((vec * n - v) / (n - 1), n - 1)
            elif not leaves:
                w = min(1 / (n + 1), 0.1)
                state[i] = ((1 - w) * (np.zeros(3) if vec is None else vec) + w * np.array(v), n + 1)
    got = {r.id: (r.vec, r.n) for r in vectors.after_moves(pf, mf).collect()}
    assert got.keys() == state.keys()
    for i, (v, n) in state.items():
        assert got[i][1] == n and (got[i][0] is None if v is None else got[i][0] == pytest.approx(v))


def test_versions_and_steps(spark):
    from memloom.operators import lineage

    new = "node string, ord long, article string, text string, method string"
    first = lineage.append(spark.createDataFrame([], lineage.SCHEMA), spark.createDataFrame([("a", 2, "late", "x", None), ("a", 1, "early", "y", "rule"), ("b", 1, None, "z", None), (None, 1, "no node", "", None)], new), full=True)
    again = lineage.append(first, spark.createDataFrame([("a", 0, "third", "w", None)], new))
    got = {(r.node, r.version): (r.article, r.text, r.method) for r in again.collect()}
    assert got == {("a", 1): ("early", "y", "rule"), ("a", 2): ("late", "x", "llm_extract"), ("a", 3): ("third", "", "llm_extract"), ("b", 1): ("", "z", "llm_extract")}
    steps = lineage.add_steps(again, spark.createDataFrame([("a", 2, "two", "d"), ("a", 1, "one", None), ("zz", 1, "lost", "")], "node string, ord long, step string, detail string"))
    assert {(r.node, r.version): [s.step for s in r.steps] for r in steps.collect()} == {("a", 1): [], ("a", 2): [], ("a", 3): ["one", "two"], ("b", 1): []}
    assert {(r.node, r.version) for r in lineage.latest(steps).collect()} == {("a", 3), ("b", 1)}


def test_density_and_diversity(spark):
    import math

    from memloom.operators import knowledge, rank

    texts = [(1, "a b a"), (2, "b c"), (3, None), (4, "a a a"), (5, "")]
    counts, total = {"a": 5, "b": 2, "c": 1}, 4
    own = {i: [math.log(total / (1 + counts[w])) for w in t.split()] for i, t in texts if t}
    mean = {i: sum(v) / len(v) for i, v in own.items()}
    low, high = min(mean.values()), max(mean.values())
    got = {r.id: r.density for r in knowledge.info_density(spark.createDataFrame(texts, "id long, text string")).collect()}
    assert got == {i: pytest.approx((v - low) / (high - low)) for i, v in mean.items()}
    rng = random.Random(50)
    items = [(rng.randrange(2), i, f"s{rng.randrange(4)}", f"k{rng.randrange(3)}", rng.randrange(9)) for i in range(60)]
    want = set()
    for grp in (0, 1):
        sources, kinds = set(), set()
        for g, i, s, k, _ in sorted((x for x in items if x[0] == grp), key=lambda x: (-x[4], x[1])):
            if s not in sources or k not in kinds:
                want.add((g, i))
            sources.add(s)
            kinds.add(k)
    found = rank.diverse(spark.createDataFrame(items, "grp long, id long, source string, kind string, score long")).collect()
    assert {(r.grp, r.id) for r in found} == want and len(found) == len(want)
