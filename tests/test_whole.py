"""Registered queries take every row: rows that a filter or a cap once left out, against brute force."""

import random

import pytest

from memloom.operators import dedup, vectors
from memloom.plans import registry


def documents(spark, tmp_path):
    rng = random.Random(4)
    long = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(900)) for _ in range(3)]
    texts = [long[0], long[1], long[0][:450] + "#" + long[0][451:], "short text", long[2], None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    grams = {i: {t[k : k + 2] for k in range(len(t) - 1)} for i, t in enumerate(texts) if t}
    return {(a, b): len(x & y) / len(x | y) for a, x in grams.items() for b, y in grams.items() if a < b}


@pytest.mark.parametrize("name", ["ded01_greedy_jaccard", "ded02_minhash", "ded08_minhash_pairs"])
def test_long_documents_are_compared(spark, tmp_path, name):
    sims = documents(spark, tmp_path)
    assert [p for p, s in sims.items() if s > 0.8] == [(0, 2)] and sims[0, 2] > 0.85
    got = registry.QUERIES[name](spark, str(tmp_path)).collect()
    if name == "ded08_minhash_pairs":
        assert [(r.a, r.b, r.sim) for r in got] == [(0, 2, round(sims[0, 2], 6))]
    else:
        assert {r.id: r.kept for r in got} == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_copies_do_not_hide_links(spark, tmp_path):
    """Two groups of 30 copies, 0.5 similar: each fills the lists of its members with copies."""
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(30)] + [(i, [0.5, 3**0.5 / 2, 0.0]) for i in range(30, 60)] + [(60, [0.0, 0.0, 1.0]), (61, [0.0, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.id: r.label for r in registry.QUERIES["clu04_components"](spark, str(tmp_path)).collect()}
    assert got == {i: 0 for i in range(60)}


def test_spanning_links_over_blocks(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in rows}
    top = {i: i for i, _ in rows}
    near = [(i, j) for i in top for j in top if i < j and round(sum(x * y for x, y in zip(unit[i], unit[j])), 6) >= 0.87]
    while any(top[i] != top[j] for i, j in near):
        for i, j in near:
            top[i] = top[j] = min(top[i], top[j])
    links = vectors.spanning_links(df, 0.87, block=40)
    got = {r.id: r.label for r in dedup.components(links).collect()}
    sizes = list(top.values())
    assert len(set(top.values())) > 5 and got == {i: t for i, t in top.items() if sizes.count(t) > 1}
