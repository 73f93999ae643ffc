"""Interval labels of trees against plain walks: shallow, deep, wide, cyclic and odd tables."""

import random
from collections import defaultdict

import pytest

from memloom.operators import tree


def walked(rows):
    parent = {}
    for i, p in rows:
        if i is not None:
            parent[i] = min((x for x in (parent.get(i, p), p) if x is not None), default=None)
    children = defaultdict(list)
    for i, p in parent.items():
        children[p if p in parent else None].append(i)
    out, order = {}, 0
    stack = [(i, i, 0, False) for i in sorted(children[None], reverse=True)]
    while stack:
        i, top, depth, done = stack.pop()
        if done:
            out[i] = (*out[i], order - 1)
            continue
        out[i] = (top, depth, order)
        order += 1
        stack.append((i, top, depth, True))
        stack += [(c, top, depth + 1, False) for c in sorted(children[i], reverse=True)]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, parent long, low long, place string") if rows and len(rows[0]) == 4 else spark.createDataFrame(rows, "id long, parent long")


def labels(df):
    return {r.id: (r.top, r.depth, r.low, r.high) for r in tree.label(df).collect()}


def test_random_forest_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(i) if i > 3 and rng.random() < 0.97 else None, 7, "x") for i in range(300)]
    rows += [(1000, 5000, 1, "gone parent"), (None, 3, 1, "no id"), (1001, 2, 1, "twice"), (1001, 9, 1, "twice"), (1001, None, 1, "twice")]
    rows += [(2000, 2001, 0, "loop"), (2001, 2000, 0, "loop"), (2002, 2001, 0, "below a loop"), (2003, 2003, 0, "itself")]
    df = frame(spark, rows)
    assert labels(df) == walked([r[:2] for r in rows])
    assert {r.id for r in tree.cycles(df).collect()} == {2000, 2001, 2002, 2003}
    assert tree.label(df.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["chain", "comb"])
def test_deep_trees(spark, shape):
    rows = [(i, i - 1 if i else None) for i in range(700)] if shape == "chain" else [(i, None if i == 0 else (i - 2 if i % 2 == 0 else i - 1)) for i in range(600)]
    rng = random.Random(2)
    names = list(range(len(rows)))
    rng.shuffle(names)
    rows = [(names[i], None if p is None else names[p]) for i, p in rows]
    df = frame(spark, rows)
    found, shallow = tree.ancestors(df)
    assert not shallow and found.count() == len(rows)
    assert labels(df) == walked(rows)


def test_descendants_of_nested_roots(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(max(0, i - 40), i) if i else None) for i in range(500)]
    lab = tree.label(frame(spark, rows))
    roots = spark.createDataFrame([(0,), (5,), (5,), (17,), (499,), (12345,)], "root long")
    want, known = set(), walked(rows)
    for root in (0, 5, 17, 499):
        _, d, low, high = known[root]
        want |= {(root, i, e - d) for i, (_, e, at, _) in known.items() if low <= at <= high}
    got = [tuple(r) for r in tree.descendants(lab, roots).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r.id for r in tree.removed(lab, roots.where("root IN (5, 17)")).collect()} == {i for r, i, _ in want if r in (5, 17)}
    assert tree.descendants(lab, roots.limit(0)).count() == 0
    paths = {r.id: r.path for r in tree.lineages(lab, 4).collect()}
    parent = dict(rows)
    for i, path in paths.items():
        assert path[-1] == i and path[0] == 0 and all(parent[b] == a for a, b in zip(path, path[1:]))
    assert set(paths) == {i for i, (_, d, _, _) in known.items() if d <= 4}


def test_blocks_of_every_width(spark, monkeypatch):
    monkeypatch.setattr(tree, "BLOCK_BITS", 2)
    rows = [(i, (i - 1) // 3 if i else None) for i in range(200)]
    lab = tree.label(frame(spark, rows))
    assert tree.descendants(lab, lab.selectExpr("id AS root")).count() == sum(d + 1 for _, d, _, _ in walked(rows).values())
