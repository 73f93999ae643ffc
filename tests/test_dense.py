"""Pairs of sets of frequent items, in blocks, against brute force and Spark's own hashes."""

import random

import pytest
from pyspark.sql import functions as F

from memloom.operators import dedup


def sets(spark, n=240):
    rng = random.Random(31)
    rows = [(i, rng.sample(range(60), rng.randint(0, 50))) for i in range(n // 2)]
    rows += [(n // 2 + i, list(dict.fromkeys(x + [rng.randrange(60)]))[rng.randrange(3) :]) for i, x in rows]
    return {i: {str(z) for z in x} for i, x in rows}, spark.createDataFrame([(i, [str(z) for z in x]) for i, x in rows], "id long, items array<string>").repartition(7)


@pytest.mark.parametrize("strict", [False, True])
def test_pairs_of_blocks(spark, monkeypatch, strict):
    plain, df = sets(spark)
    monkeypatch.setattr(dedup, "ITEMS", 500)
    monkeypatch.setattr(dedup, "STEP", 16)
    monkeypatch.setattr(dedup, "WIDE", 25)
    want = {(a, b): len(x & y) / len(x | y) for a, x in plain.items() for b, y in plain.items() if a < b and x and y}
    want = {p: s for p, s in want.items() if (s > 0.8 if strict else s >= 0.8)}
    got = dedup.dense_pairs(df, 0.8, strict).collect()
    assert len(want) > 50 and len(got) == len(want) and {(r.a, r.b): r.sim for r in got} == want
    assert dedup.dense_pairs(df.limit(0), 0.8).count() == 0


def test_bands_are_those_of_signatures(spark):
    _, df = sets(spark)
    sigs = {r.id: r.sig for r in df.where(F.size("items") > 0).select("id", dedup.signature("items", 8).alias("sig")).collect()}
    keys = {r.id: r["keys"] for r in dedup.band_keys(df, 8, 2).collect()}
    assert keys.keys() == sigs.keys()
    assert all([x == y for x, y in zip(keys[a], keys[b])] == [sigs[a][k : k + 2] == sigs[b][k : k + 2] for k in range(0, 8, 2)] for a in sigs for b in sigs)


def banded(spark, threshold):
    """Pairs of sf0.001 above the threshold that share a band of Spark's own signatures."""
    from memloom.plans import ranking

    rows = ranking._bigrams(spark, "/root/testdata/sf0.001").select("id", "items", dedup.signature("items").alias("sig")).collect()
    rows = [(r.id, set(r["items"]), [tuple(r.sig[k : k + 4]) for k in range(0, 128, 4)]) for r in rows]
    near = [(a, b, len(x & y) / len(x | y), any(p == q for p, q in zip(s, t))) for a, x, s in rows for b, y, t in rows if a < b and len(x & y) > threshold * len(x | y)]
    return [r[0] for r in rows], {(a, b): round(sim, 6) for a, b, sim, hit in near if hit}


def test_minhash_survivors(spark):
    from memloom.plans import registry

    ids, pairs = banded(spark, 0.85)
    kept = {}
    for i in sorted(ids):
        kept[i] = not any(kept[j] for j in kept if (j, i) in pairs)
    assert pairs and {r.id: r.kept for r in registry.QUERIES["ded02_minhash"](spark, "/root/testdata/sf0.001").collect()} == kept


def test_minhash_pairs(spark):
    from memloom.plans import registry

    pairs = banded(spark, 0.8)[1]
    assert pairs and {(r.a, r.b): r.sim for r in registry.QUERIES["ded08_minhash_pairs"](spark, "/root/testdata/sf0.001").collect()} == pairs


def test_places_rule_out_candidates(spark, monkeypatch):
    """x is the third of four items in two sets, so at most two of the three that they need can be shared."""
    joined = []
    distinct = type(spark.range(1)).distinct
    monkeypatch.setattr(type(spark.range(1)), "distinct", lambda self: joined.append(distinct(self)) or joined[-1])
    df = spark.createDataFrame([(1, list("abxy")), (2, list("cdxz")), (3, list("yz")), (4, list("yz"))], "id long, items array<string>")
    assert [tuple(r) for r in dedup.similar_pairs(df, 0.5).collect()] == [(3, 4, 1.0)]
    assert [tuple(r) for r in joined[0].collect()] == [(3, 4)]


def test_pairs_by_places_are_all_pairs(spark):
    plain, df = sets(spark)
    want = {(a, b) for a, x in plain.items() for b, y in plain.items() if a < b and x and y and len(x & y) >= 0.5 * len(x | y)}
    assert {(r.a, r.b) for r in dedup.similar_pairs(df, 0.5).collect()} == want
