"""Queries against DuckDB with every shuffle partition a task of its own, as on larger tables: equal keys must reach one task from both sides."""

import math

import pytest
from compare import canonical, connect

from memloom.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = [
    "clu01_silhouette",
    "join30_same_subject",
    "join20_edge_weights",
    "vec16_semantic_cache",
    "vec17_recent_lookup",
    "vec07_attention",
    "fn26_sibling_conflicts",
    "vec01_cosine",
]


@pytest.fixture
def apart(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", NAMES)
def test_blocks_meet(apart, name):
    got = registry.QUERIES[name](apart, SF).toPandas()
    assert canonical(got) == canonical(connect(SF).sql(registry.ORACLES[name]).df())


def test_questions_are_read_once(spark):
    """Versions as of a time where the two sides of a join are coalesced differently: a question keeps its own answer."""
    sf, conf = "/root/testdata/sf0.1", {"spark.sql.shuffle.partitions": "12", "spark.sql.autoBroadcastJoinThreshold": "256k"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = registry.QUERIES["join15_as_of"](spark, sf).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert canonical(got) == canonical(connect(sf).sql(registry.ORACLES["join15_as_of"]).df())


def test_cosines_of_odd_vectors(spark, tmp_path):
    """Null vectors, and those without a direction, keep their pairs; the SQL's plain quotient fails on a zero norm in Spark."""
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [3.0, 4.0]), (2, 1, None), (3, 1, [0.0, 0.0]), (4, 1, None), (5, 2, [1.0, 1.0]), (6, None, [1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.a, r.b): r.sim for r in registry.QUERIES["vec01_cosine"](spark, str(tmp_path)).collect()}
    assert got.pop((0, 1)) == 0.6 and math.isnan(got.pop((0, 3))) and math.isnan(got.pop((1, 3)))
    assert got == {(a, b): None for a, b in ((0, 2), (0, 4), (1, 2), (1, 4), (2, 3), (2, 4), (3, 4))}
