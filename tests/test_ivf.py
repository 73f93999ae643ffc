"""The inverted file of vectors against the exact search."""

import numpy as np
import pytest

from memloom.operators import ivf, vectors

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 16))
    rows = [(i, (centers[i % 40 if i % 3 else 0] + 0.35 * rng.normal(size=16)).tolist()) for i in range(3000)]  # a third in one place
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, rows[7][1])]
    return spark.createDataFrame(rows, "id long, vec array<double>").repartition(4).cache()


def test_recall_and_share(spark, clustered, tmp_path):
    index = ivf.build(clustered, f"file://{tmp_path}/index", cells=48)
    assert index.count == 3001
    queries = clustered.where("id % 20 = 0").withColumnRenamed("id", "qid")
    probes, _ = ivf.calibrated(index, queries, 5, 0.95, sample=50)
    found = ivf.search(index, queries, 5, probes)
    exact = vectors.nearest(clustered.where(vectors.norm("vec") > 0), queries.where(vectors.norm("vec") > 0), 5)
    assert ivf.recall(found, exact) >= 0.9 and ivf.read_share(index, queries, probes) < 0.5
    sims = {(r.qid, r.id): r.sim for r in exact.collect()}
    assert all(abs(sims[r.qid, r.id] - r.sim) <= 1e-6 for r in found.collect() if (r.qid, r.id) in sims)
    assert found.groupBy("qid").count().where("count <> 5").count() == 0


def test_all_cells_are_exact(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "BLOCK", 100)  # a hot cell in blocks
    index = ivf.build(clustered, f"file://{tmp_path}/index", cells=12)
    queries = clustered.where("id % 100 = 0").withColumnRenamed("id", "qid")
    found = ivf.search(index, queries, 4, probes=12, refine=None, threshold=0.5, other=True)
    exact = vectors.nearest(clustered.where(vectors.norm("vec") > 0), queries.where(vectors.norm("vec") > 0), 4, 0.5, among="other")
    assert sorted((r.qid, r.id, r.rank) for r in found.collect()) == sorted((r.qid, r.id, r.rank) for r in exact.collect())


def test_empty_index(spark, clustered, tmp_path):
    index = ivf.build(clustered.limit(0), f"file://{tmp_path}/index")
    assert ivf.search(index, clustered.withColumnRenamed("id", "qid"), 3).count() == 0 and index.count == 0


def test_registered_search_keeps_its_recall(spark):
    from memloom.plans import registry

    got, exact = registry.QUERIES["vec02_ivf_search"](spark, SF), registry.QUERIES["vec02_nearest"](spark, SF)
    assert ivf.recall(got, exact) >= 0.9
