"""What happens to a recall after it came back: the whole order of its stages as one plan over many recalls."""

from __future__ import annotations

from memloom.functions import gates
from memloom.functions import text as t
from memloom.functions.dialect import SPARK
from memloom.operators import causal, rank
from memloom.sources.shared import cut
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Boost a hit and its limits, least score, floor and days of the time score, causal boost, marks' factor,
#: spans that cut to three and to half, likeness of a repeated point and its factor.
HIT, MOST = 0.1, 2.0
LEAST, FLOOR, HALF_LIFE = 0.35, 0.3, 30.0
ALPHA, CAP, SOLVED = 0.05, 1.10, 0.3
SPAN_THREE, SPAN_HALF = 0.9, 0.7
ALIKE, REPEATED = 0.65, 0.5


def time_score(at: str, now: Column, half_life: float = HALF_LIFE) -> Column:
    """exp(-days / half_life) since `at`; 1 for the future, 0.5 without a time."""
    days = (F.unix_micros(now) - F.unix_micros(F.col(at).cast("timestamp"))) / 86_400_000_000
    return F.when(days > 0, F.exp(-days / half_life)).when(days.isNotNull(), 1.0).otherwise(0.5)


def hit_boost(score: Column, hits: Column) -> Column:
    """Raised by a tenth for each hit beyond the first, twice at most, up to MOST; a first hit leaves a score alone."""
    return F.when(hits > 1, F.least(score * F.least(1 + HIT * (hits - 1), F.lit(2.0)), F.lit(MOST))).otherwise(score)


def compressed(kept: DataFrame, most: int, three: float = SPAN_THREE, half: float = SPAN_HALF) -> DataFrame:
    """Rows (query, rank, ce) cut by the span of a query's raw scores ce of at least 0.5: to 3, to half of `most`, or not at all."""
    all_ = Window.partitionBy("query")
    sound = F.when(F.col("ce") >= 0.5, F.col("ce"))
    n, some, span = F.count("*").over(all_), F.count(sound).over(all_), F.max(sound).over(all_) - F.min(sound).over(all_)
    limit = F.when((n <= 3) | (some < 2), n).when(span > three, F.lit(3)).when(span > half, F.least(F.greatest(F.lit(3), F.least(F.lit(most // 2), n)), F.lit(most))).otherwise(n)
    return kept.withColumn("__limit", limit).where(F.col("rank") <= F.col("__limit")).drop("__limit")


def without_repeats(points: DataFrame, kept: DataFrame, alike: float = ALIKE, action: str = "demote", factor: float = REPEATED) -> DataFrame:
    """points (query, id, text, name, score) whose text resembles a kept one (query, text): score times factor, or removed.

    A query keeps a few texts, so its points meet them all; likeness is the Jaccard index of lower-case character trigrams.
    """
    own = points.withColumn("__text", F.coalesce(F.nullif(F.col("text"), F.lit("")), "name", F.lit("")))
    grams = lambda c: F.expr(t.grams(SPARK, f"lower(trim({c}))", 3))
    left = own.select("query", "id", grams("__text").alias("__a")).distinct()
    right = kept.where(F.coalesce(F.trim("text"), F.lit("")) != "").select("query", grams("text").alias("__b"))
    common = F.size(F.array_intersect("__a", "__b"))
    all_ = F.size("__a") + F.size("__b") - common
    found = left.join(right, "query").where((common > 0) & (common / F.nullif(all_, F.lit(0)) >= alike)).select("query", "id").distinct()
    marked = own.drop("__text").join(found.withColumn("__again", F.lit(True)), ["query", "id"], "left")
    if action == "remove":
        return marked.where(F.col("__again").isNull()).drop("__again")
    return marked.withColumn("score", F.when(F.col("__again"), F.col("score") * factor).otherwise(F.col("score"))).drop("__again")


def tree_score(score: Column) -> Column:
    """0.5 + 0.4 times the score cut to 0..1; 0.45 for none."""
    sound = score.cast("double")
    return F.when(sound.isNull() | F.isnan(sound), 0.45).otherwise(0.5 + 0.4 * F.least(F.greatest(sound, F.lit(0.0)), F.lit(1.0)))


def post_process(recalled: DataFrame, points: DataFrame, links: DataFrame, now: Column, most: int = 10, least: float = LEAST, action: str = "demote") -> DataFrame:
    """(query, origin, id, score, rank): recalled (query, id, text, score, ce, hits, at) and points of a tree (query, id, text, name, score).

    In this order: rows marked as wrong go; scores rise with hits, then over causal links (query, ord, src, dst, weight) in
    their order; rows marked as solved fall to 0.3 of that; below `least` they go; what is left is fused with its age, each id
    once; `most` diverse rows stay, fewer where the span of ce is wide; points that repeat them are demoted or removed and follow
    with normalised scores. origin: recall or tree; ranks count on from the one to the other.

    Defined results: null ids and queries are left out; a null score is 0, null hits are 1; an id that repeats in a query counts with its
    best fused score; a query without kept rows returns its points; ties go to the smaller id.
    """
    live = recalled.where("query IS NOT NULL AND id IS NOT NULL").withColumns({"query": F.col("query").cast("string"), "mark": F.expr(gates.mark_action(SPARK, "coalesce(text, '')"))}).where("mark <> 'exclude'")
    first = live.withColumn("score", hit_boost(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), F.coalesce("hits", F.lit(1))))
    chained = causal.boosted(first.select(F.col("query").alias("within"), "id", "score"), links.withColumn("query", F.col("query").cast("string")).withColumnRenamed("query", "within"), ALPHA, CAP)
    rows = first.drop("score").join(chained.withColumnRenamed("within", "query"), ["query", "id"])
    rows = rows.withColumn("score", F.when(F.col("mark") == "demote", F.col("score") * SOLVED).otherwise(F.col("score"))).where(F.col("score") >= least)
    rows = rows.withColumn("score", F.col("score") * (FLOOR + (1 - FLOOR) * time_score("at", now)))
    once = F.row_number().over(Window.partitionBy("query", "id").orderBy(F.desc("score"), F.desc_nulls_last("at"), "text"))
    rows = cut(rows.withColumn("__n", once).where("__n = 1").select("query", "id", F.coalesce("text", F.lit("")).alias("text"), "score", "ce"))
    diverse = rank.mmr(rows.select("query", "id", "text", "score"), most).select("query", "id", "rank")
    kept = cut(compressed(diverse.join(rows, ["query", "id"]), most))
    tree = points.where("query IS NOT NULL AND id IS NOT NULL").withColumn("query", F.col("query").cast("string"))
    tree = without_repeats(tree.withColumn("score", F.col("score").cast("double")), kept, action=action).select("query", "id", tree_score(F.col("score")).alias("score"))
    sizes = kept.groupBy("query").agg(F.max("rank").alias("before"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")) + F.coalesce("before", F.lit(0))
    tree = tree.join(sizes, "query", "left").select("query", F.lit("tree").alias("origin"), "id", "score", place.alias("rank"))
    return kept.select("query", F.lit("recall").alias("origin"), "id", "score", "rank").unionByName(tree)
