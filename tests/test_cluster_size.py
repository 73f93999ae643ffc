"""Clusters of many vectors: no task holds a matrix of distances."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from memloom.operators import cluster
from memloom.plans import registry


def test_a_group_is_clustered_without_a_matrix():
    x = np.random.default_rng(3).normal(size=(3000, 16))
    tracemalloc.start()
    cluster.tree_clusters(x, 2, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3000 * 3000 * 8 / 2


def test_clusters_nested_deep():
    """Pairs on a circle with growing gaps: each joins the cluster of all before it."""
    at = np.repeat(np.cumsum(0.001 + 5e-7 * np.arange(1200)), 2) + np.tile([0.0, 1e-4], 1200)
    labels = cluster.tree_clusters(np.stack([np.cos(at), np.sin(at)], axis=1), 2, 1)
    assert len(labels) == 2400 and (labels >= 0).all() and (labels[::2] == labels[1::2]).all()


NAMES = ["clu08_sub_clusters", "clu11_split_subject"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_with_clusters_nested_deep(spark, tmp_path, name):
    """As above, by fives and in blocks."""
    at = np.repeat(np.cumsum(0.001 + 5e-7 * np.arange(1100)), 5) + np.tile(2e-5 * np.arange(5), 1100)
    rows = pd.DataFrame({"vec_id": np.arange(5500), "embedding": [[float(np.cos(x)), float(np.sin(x))] for x in at], "label": 0})
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert got["n"].sum() == 5500 and (len(got) > 1000 or got["parts"].item() == 1100)
