"""What belongs to the results of a recall: siblings, sharers of entities, neighbours over edges, for many recalls at once.

All take seeds (query, id) and return (query, id, score, rank), the `limit` best of each query that are no seeds of it, ties by id.
"""

from __future__ import annotations

from memloom.operators import vectors
from memloom.sources.shared import cut
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Score of a sibling, entities and edges that make a full score, least cosine of the bridge.
SIBLING, ENTITIES, EDGES, BRIDGE = 0.5, 5.0, 3.0, 0.80


def _seeds(seeds: DataFrame) -> DataFrame:
    return seeds.where("query IS NOT NULL AND id IS NOT NULL").select("query", "id").distinct()


def _best(found: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    new = found.join(seeds.select("query", "id"), ["query", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return new.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "id", "score", "rank")


def synonyms(asked: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, word): the words of all groups that hold a word of asked (id, word); groups are rows (grp, word).

    Which words share a group is settled among distinct words before ids meet them, so rows that repeat a word cost nothing there.
    """
    held = groups.where("grp IS NOT NULL").select("grp", "word").distinct()
    near = held.where("word IS NOT NULL").withColumnRenamed("word", "said").join(held, "grp").select("said", "word").distinct()
    return asked.select("id", F.col("word").alias("said")).distinct().join(near, "said").select("id", "word").distinct()


def by_subject(points: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """Points (id, parent) under the parents of the seeds, each at 0.5.

    All siblings score alike, so of a parent only its first `limit` points by id, and as many more as a query has seeds there, can be
    returned; a parent with any number of points is cut to them before it meets a query.
    """
    own = _seeds(seeds)
    parents = own.join(points.where("parent IS NOT NULL").select("id", "parent").distinct(), "id").groupBy("query", "parent").agg(F.count("*").alias("n"))
    deepest = parents.groupBy("parent").agg((F.max("n") + limit).alias("deepest"))
    first = points.where("parent IS NOT NULL").select("id", "parent").distinct().join(deepest, "parent").withColumn("at", F.row_number().over(Window.partitionBy("parent").orderBy("id"))).where(F.col("at") <= F.col("deepest"))
    return _best(parents.join(first, "parent").select("query", "id", F.lit(SIBLING).alias("score")).distinct(), own, limit)


def by_entity(links: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """Points that share entities with the seeds, by links (id, entity): a fifth for each shared one, 1 at most, ordered by their number."""
    own, links = _seeds(seeds), links.where("id IS NOT NULL AND entity IS NOT NULL").select("id", "entity").distinct()
    asked = own.join(links, "id").select("query", "entity").distinct()
    shared = asked.join(links, "entity").groupBy("query", "id").agg(F.count("*").alias("n"))
    best = _best(shared.withColumn("score", F.col("n").cast("double")), own, limit)
    return best.withColumn("score", F.least(F.lit(1.0), F.col("score") / ENTITIES))


def by_edge(edges: DataFrame, seeds: DataFrame, limit: int, points: DataFrame | None = None, bridge: float = BRIDGE) -> DataFrame:
    """Neighbours over edges (a, b, n) of either direction: a third of the summed n, 1 at most, ordered by the sum.

    A query without any gets, where points (id, vec) are given, the points of a cosine above `bridge` to its least seed that has a vector.
    """
    own = _seeds(seeds)
    both = edges.select("a", "b", "n").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    met = own.select("query", F.col("id").alias("a")).join(both, "a").groupBy("query", F.col("b").alias("id")).agg(F.sum(F.col("n").cast("double")).alias("score"))
    found = cut(_best(met, own, limit))
    out = found.withColumn("score", F.least(F.lit(1.0), F.col("score") / EDGES))
    if points is None:
        return out
    placed = points.where(vectors.finite("vec")).where(vectors.norm("vec") > 0).select("id", "vec")
    lone = own.join(found.select("query").distinct(), "query", "left_anti")
    one = lone.join(placed, "id").groupBy("query").agg(F.min_by("vec", "id").alias("vec"))
    most = lone.groupBy("query").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    near = vectors.nearest(placed, one.withColumnRenamed("query", "qid"), limit + most, bridge).where(F.col("sim") > bridge)
    return out.unionByName(_best(near.select(F.col("qid").alias("query"), "id", F.col("sim").alias("score")), lone, limit))


def expand(points: DataFrame, links: DataFrame, edges: DataFrame, seeds: DataFrame, top_k: int = 10) -> DataFrame:
    """(query, id, score, strategy, rank): the three routes together, top_k // 3 + 1 of each (3 at least).

    An id that several routes found keeps the first one's score, in the order subject, entity, edge. points: (id, parent, vec).
    """
    limit = max(3, top_k // 3 + 1)
    routes = [("subject", by_subject(points, seeds, limit)), ("entity", by_entity(links, seeds, limit)), ("edge", by_edge(edges, seeds, limit, points))]
    every = None
    for at, (name, route) in enumerate(routes):
        one = route.select("query", "id", "score", F.lit(name).alias("strategy"), F.lit(at).alias("route"))
        every = one if every is None else every.unionByName(one)
    first = every.withColumn("n", F.row_number().over(Window.partitionBy("query", "id").orderBy("route"))).where("n = 1")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "route", "id"))
    return first.withColumn("rank", rank).where(F.col("rank") <= top_k).select("query", "id", "score", "strategy", "rank")
