"""Queries over vectors and sets that compare rows with many others, through the blocked operators; their SQL is written apart.

Decisions about rows (duplicates, caches, leaves, histograms) take every row. Searches take the stated
query set: the rows whose id is divisible by 50, against all other rows.
"""

from __future__ import annotations

from memloom.operators import dedup, vectors
from memloom.plans.base import Registry, table
from pyspark.sql import functions as F

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_V = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)"
_SIM = "round(list_inner_product(a.e, b.e) / (a.n * b.n), 6)"
_OLDER = f"{_V}, s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, {_SIM} AS sim FROM v a JOIN v b ON b.vec_id < a.vec_id)"
_SEARCH = f"{_V}, s AS (SELECT a.vec_id AS a, b.vec_id AS b, b.label AS lb, {_SIM} AS sim FROM v a JOIN v b ON b.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0)"
#: The next number above a bound for cosines of 6 places, where the bound itself must not count.
_STEP = 0.000001


def _known(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _asked(known):
    return known.withColumnRenamed("id", "qid")


def _searches(known):
    return _asked(known.where("id % 50 = 0"))


@R.add("ded17_two_zones", f"{_OLDER}, r AS (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM s) SELECT a, b, CASE WHEN sim > 0.45 THEN 'duplicate' WHEN sim >= 0.40 THEN 'judge' ELSE 'new' END AS zone FROM r WHERE rn = 1")
def ded17_two_zones(spark, sf_dir):
    known = _known(spark, sf_dir)
    best = vectors.nearest(known, _asked(known), 1, among="earlier")
    return best.select(F.col("qid").alias("a"), F.col("id").alias("b"), F.when(F.col("sim") > 0.45, "duplicate").when(F.col("sim") >= 0.40, "judge").otherwise("new").alias("zone"))


@R.add("ded19_first_leaf", f"{_OLDER} SELECT a, min(b) AS b FROM s WHERE sim > 0.35 GROUP BY a")
def ded19_first_leaf(spark, sf_dir):
    known = _known(spark, sf_dir)
    return vectors.nearest(known, _asked(known), 1, 0.35 + _STEP / 2, order="first", among="earlier").select(F.col("qid").alias("a"), F.col("id").alias("b"))


@R.add("ded20_best_leaf", f"{_OLDER}, r AS (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM s WHERE sim > 0.35) SELECT a, b, sim FROM r WHERE rn = 1")
def ded20_best_leaf(spark, sf_dir):
    known = _known(spark, sf_dir)
    return vectors.nearest(known, _asked(known), 1, 0.35 + _STEP / 2, among="earlier").select(F.col("qid").alias("a"), F.col("id").alias("b"), "sim")


@R.add("ded10_similarity_histogram", f"{_OLDER} SELECT CASE WHEN sim < 0 THEN '<0' WHEN sim < 0.2 THEN '0-0.2' WHEN sim < 0.4 THEN '0.2-0.4' ELSE '0.4+' END AS bucket, count(*) AS n FROM s GROUP BY 1")
def ded10_similarity_histogram(spark, sf_dir):
    counts = vectors.similarity_counts(_known(spark, sf_dir), [0.0, 0.2, 0.4])
    names = F.array(*[F.lit(x) for x in ("<0", "0-0.2", "0.2-0.4", "0.4+")])
    return counts.select(F.get(names, F.col("bucket")).alias("bucket"), "n")


@R.add("vec02_nearest", f"{_SEARCH}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS INTEGER) AS rank FROM s) SELECT a AS qid, b AS id, sim, rank FROM r WHERE rank <= 5")
def vec02_nearest(spark, sf_dir):
    known = _known(spark, sf_dir)
    return vectors.nearest(known, _searches(known), 5, among="other")


@R.add("vec03_similarity_sums", f"{_V} SELECT a.label AS x, b.label AS y, round(avg(list_inner_product(a.e, b.e) / (a.n * b.n)), 6) AS mean FROM v a CROSS JOIN v b GROUP BY 1, 2")
def vec03_similarity_sums(spark, sf_dir):
    """Mean cosine of the vectors of two labels: the product of their mean unit vectors, so no pair of vectors is formed."""
    unit = _known(spark, sf_dir).where(vectors.norm("vec") > 0).select("label", F.transform("vec", lambda x: x.cast("double") / vectors.norm("vec")).alias("unit"))
    means = vectors.centroid(unit, "label", "unit").select("label", "centroid")
    pairs = means.toDF("x", "u").crossJoin(means.toDF("y", "w"))  # one row for each pair of labels
    return pairs.select("x", "y", F.round(vectors.dot("u", "w"), 6).alias("mean"))


@R.add("vec07_attention", f"{_V}, s AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_inner_product(a.e, b.e) / sqrt(len(a.e)), 6) AS raw FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id), e AS (SELECT *, count(*) OVER (PARTITION BY query) AS n, exp(raw - max(raw) OVER (PARTITION BY query)) AS e FROM s), f AS (SELECT *, e / sum(e) OVER (PARTITION BY query) AS soft FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY soft DESC, id) AS rn FROM f WHERE soft >= 0.1 / n AND raw > 0) SELECT query, id, round(soft, 4) AS score FROM r WHERE rn <= 5")
def vec07_attention(spark, sf_dir):
    return vectors.attend(_known(spark, sf_dir), "label").select("query", "id", F.round("soft", 4).alias("score"))


@R.add("vec16_semantic_cache", f"{_OLDER} SELECT a, min(b) AS b FROM s WHERE la = lb AND sim >= 0.2 GROUP BY a")
def vec16_semantic_cache(spark, sf_dir):
    known = _known(spark, sf_dir)
    return vectors.nearest(known, _asked(known), 1, 0.2, order="first", among="earlier", within="label").select(F.col("qid").alias("a"), F.col("id").alias("b"))


@R.add("vec17_recent_lookup", f"{_OLDER} SELECT a, max(b) AS b FROM s WHERE la = lb AND sim >= 0.15 GROUP BY a")
def vec17_recent_lookup(spark, sf_dir):
    known = _known(spark, sf_dir)
    return vectors.nearest(known, _asked(known), 1, 0.15, order="last", among="earlier", within="label").select(F.col("qid").alias("a"), F.col("id").alias("b"))


@R.add("vec18_prescreen", f"{_SEARCH}, r AS (SELECT a, b, CAST(row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS BIGINT) AS rn FROM s) SELECT a, b, rn FROM r WHERE rn <= 30")
def vec18_prescreen(spark, sf_dir):
    known = _known(spark, sf_dir)
    return vectors.nearest(known, _searches(known), 30, among="other").select(F.col("qid").alias("a"), F.col("id").alias("b"), F.col("rank").cast("long").alias("rn"))


@R.add("rnk17_match_skills", f"{_SEARCH}, r AS (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM s) SELECT a, b, round(least(0.49, 0.3 + greatest(sim, 0)), 6) AS score FROM r WHERE rn <= 3")
def rnk17_match_skills(spark, sf_dir):
    known = _known(spark, sf_dir)
    found = vectors.nearest(known, _searches(known), 3, among="other")
    return found.select(F.col("qid").alias("a"), F.col("id").alias("b"), F.round(F.least(F.lit(0.49), 0.3 + F.greatest(F.col("sim"), F.lit(0.0))), 6).alias("score"))


@R.add("src17_recall", f"{_SEARCH}, r AS (SELECT a, b, sim, CAST(row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS BIGINT) AS pos FROM s) SELECT a AS query, b AS node_id, pos, sim AS rerank_score FROM r WHERE pos <= 10")
def src17_recall(spark, sf_dir):
    known = _known(spark, sf_dir)
    found = vectors.nearest(known, _searches(known), 10, among="other")
    return found.select(F.col("qid").alias("query"), F.col("id").alias("node_id"), F.col("rank").cast("long").alias("pos"), F.col("sim").alias("rerank_score"))


@R.add("src18_section_search", f"{_SEARCH}, r AS (SELECT a, b, CAST(row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS BIGINT) AS pos FROM s WHERE lb IN (1, 2, 3)) SELECT a, b, pos FROM r WHERE pos <= 5")
def src18_section_search(spark, sf_dir):
    known = _known(spark, sf_dir)
    found = vectors.nearest(known.where("label IN (1, 2, 3)"), _searches(known), 5, among="other")
    return found.select(F.col("qid").alias("a"), F.col("id").alias("b"), F.col("rank").cast("long").alias("pos"))


@R.add("clu06_assign", f"{_V}, c AS (SELECT label, list(m ORDER BY p) AS e FROM (SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS p FROM v) u GROUP BY label, p) g GROUP BY label), s AS (SELECT vec_id, c.label, round(list_inner_product(v.e, c.e) / (v.n * sqrt(list_inner_product(c.e, c.e))), 6) AS sim FROM v CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS rn FROM s WHERE sim >= 0.3) SELECT vec_id, label AS entity FROM r WHERE rn = 1")
def clu06_assign(spark, sf_dir):
    known = _known(spark, sf_dir)
    centres = vectors.centroid(known, "label", "vec").select(F.col("label").alias("cid"), "centroid")
    return vectors.assign(known, centres, 0.3, strict=False).where("cid IS NOT NULL").select(F.col("id").alias("vec_id"), F.col("cid").cast("int").alias("entity"))


@R.add("clu14_entity_jaccard", "WITH bridge AS (SELECT DISTINCT l_orderkey AS u, l_partkey AS e FROM lineitem), s AS (SELECT u, count(*) AS n FROM bridge GROUP BY u), p AS (SELECT x.u AS a, y.u AS b, count(*) AS n FROM bridge x JOIN bridge y ON x.e = y.e AND x.u < y.u GROUP BY 1, 2) SELECT a, b, round(p.n / CAST(sa.n + sb.n - p.n AS DOUBLE), 6) AS sim FROM p JOIN s sa ON sa.u = a JOIN s sb ON sb.u = b WHERE p.n / CAST(sa.n + sb.n - p.n AS DOUBLE) >= 0.5")
def clu14_entity_jaccard(spark, sf_dir):
    """Units that share at least half of their entities, by the prefix filter; links below that are no candidates for a merge."""
    bridge = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("items"))
    return dedup.similar_pairs(bridge, 0.5).withColumn("sim", F.round("sim", 6))


@R.add("join20_edge_weights", f"{_V}, s AS (SELECT a.vec_id AS a, b.vec_id AS b, {_SIM} AS sim FROM v a JOIN v b ON b.label = (a.label + 1) % 10) SELECT a, b, greatest(1, CAST(trunc(round(10 * sim, 5)) AS INTEGER)) AS weight FROM s WHERE sim > 0.25")
def join20_edge_weights(spark, sf_dir):
    known = _known(spark, sf_dir)
    fresh = _asked(known).withColumn("label", F.expr("(label + 1) % 10"))
    found = vectors.nearest(known, fresh, None, 0.25 + _STEP / 2, within="label")
    return found.select(F.col("qid").alias("a"), F.col("id").alias("b"), F.greatest(F.lit(1), F.round(10 * F.col("sim"), 5).cast("int")).alias("weight"))


@R.add("join30_same_subject", f"{_OLDER} SELECT b AS a, a AS b FROM s WHERE la = lb AND sim > 0.3")
def join30_same_subject(spark, sf_dir):
    known = _known(spark, sf_dir)
    found = vectors.nearest(known, _asked(known), None, 0.3 + _STEP / 2, among="earlier", within="label")
    return found.select(F.col("id").alias("a"), F.col("qid").alias("b"))
