"""Scores of recalled rows and skills, and the choices made by them."""

from __future__ import annotations

from memloom.operators.recall import FLOOR, HALF_LIFE, time_score
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of a day without access, weight that makes a row unimportant, days in which negative counts halve, least count kept,
#: rounds after which one result is enough, passing score.
FADE, UNIMPORTANT, HALVES, KEPT, ROUNDS, PASSES = 0.9, 0.2, 14.0, 0.5, 20, 50.0


def filtered(rows: DataFrame, now: Column, least: float, floor: float = FLOOR, half_life: float = HALF_LIFE) -> DataFrame:
    """rows (query, id, score, at) of at least that score with base_score, final_score (fused with age) and rank by it; the best row of an id in a query, ties by id."""
    fused = F.col("score") * (floor + (1 - floor) * time_score("at", now, half_life))
    kept = rows.where(F.col("score") >= least).select("query", "id", F.col("score").alias("base_score"), fused.alias("final_score"))
    one = kept.groupBy("query", "id").agg(F.max(F.struct("final_score", "base_score")).alias("x")).select("query", "id", "x.base_score", "x.final_score")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("final_score"), "id")))


def span_cut(rows: DataFrame, most: int = 10, three: float = 0.9, half: float = 0.7) -> DataFrame:
    """rows (query, id, score), cut by the span of each query's positive scores: 3 left over `three`, half of `most` (3 at least) over `half`, all else; and the span."""
    all_ = Window.partitionBy("query")
    sound = F.when(F.col("score") > 0, F.col("score"))
    ranked = rows.withColumns({"rank": F.row_number().over(all_.orderBy(F.desc("score"), "id")), "n": F.count("*").over(all_), "some": F.count(sound).over(all_), "span": F.max("score").over(all_) - F.min(sound).over(all_)})
    limit = F.when((F.col("n") <= 3) | (F.col("some") < 2), F.col("n")).when(F.col("span") > three, 3).when(F.col("span") > half, F.greatest(F.lit(3), F.least(F.lit(most // 2), F.col("n")))).otherwise(F.col("n"))
    return ranked.where(F.col("rank") <= limit).select("query", "id", "score", "span", "rank")


def best_known(*scores: str) -> Column:
    """The first of several scores that is there, else 0."""
    return F.coalesce(*[F.col(c).cast("double") for c in scores], F.lit(0.0))


def access_weight(at: str, last: str) -> Column:
    """0.9 for each day since the last access, 1 for what was never seen."""
    days = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(last).cast("timestamp"))) / 86_400_000_000
    return F.coalesce(F.pow(F.lit(FADE), days), F.lit(1.0))


def decayed(score: Column, weight: Column) -> Column:
    """struct(score, low_priority): the score by its weight, and whether that is below 0.2."""
    return F.struct((score * weight).alias("score"), (score * weight < UNIMPORTANT).alias("low_priority"))


def sort_key(keywords: Column, embedding: Column) -> Column:
    """The higher of a hundredth of the keyword score and a fifth of the cosine."""
    return F.greatest(0.01 * F.coalesce(keywords.cast("double"), F.lit(0.0)), 0.2 * F.coalesce(embedding.cast("double"), F.lit(0.0)))


def negatives(old: DataFrame, new: DataFrame, days: float) -> DataFrame:
    """(k, ema): negative counts (k, ema) halved for every 14 of the days, with the new ones (k, n) added; below 0.5 they go."""
    both = old.groupBy("k").agg(F.sum("ema").alias("ema")).join(new.groupBy("k").agg(F.sum("n").alias("n")), "k", "full_outer")
    ema = F.coalesce("ema", F.lit(0)) * F.pow(F.lit(0.5), F.lit(days / HALVES)) + F.coalesce("n", F.lit(0))
    return both.select("k", ema.alias("ema")).where(F.col("ema") >= KEPT)


def variants(skills: DataFrame) -> DataFrame:
    """(path, representative, usage): of the skills (id, path, name, usage) of one path the shortest name (the least id of several) and the most use."""
    return skills.groupBy("path").agg(F.min_by("name", F.struct(F.length("name"), "id")).alias("representative"), F.max("usage").alias("usage"))


def date_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1: date texts by the parts that both have (year, month, day); 0 where either is null."""
    one = lambda x: F.transform(F.split(x, "[- :T]"), lambda p: p.try_cast("int"))
    n = F.least(F.size(F.split(a, "-")), F.size(F.split(b, "-")))
    x, y = F.slice(one(a), 1, n), F.slice(one(b), 1, n)
    return F.when(a.isNull() | b.isNull() | (x == y), 0).when(x < y, -1).otherwise(1)


def rollouts(rows: DataFrame, group: str, score: str, passes: float = PASSES) -> DataFrame:
    """group, best, worst, spread and pass_rate of its scores; null ones don't count."""
    good = F.avg(F.when(F.col(score).isNotNull(), F.when(F.col(score) >= passes, 1.0).otherwise(0.0)))
    return rows.groupBy(group).agg(F.max(score).alias("best"), F.min(score).alias("worst"), (F.max(score) - F.min(score)).alias("spread"), good.alias("pass_rate"))


def reward(accuracy: Column, tokens: Column, latency: Column, weights: tuple[float, float, float] = (0.6, 0.2, 0.2), scale: tuple[float, float] = (1000.0, 1000.0)) -> Column:
    """Weighted accuracy less weighted tokens and latency, each by its scale."""
    return weights[0] * accuracy - weights[1] * tokens / scale[0] - weights[2] * latency / scale[1]


def best_of_kind(items: DataFrame, kind: str, score: str, tie: str, keep: int, without: DataFrame | None = None) -> DataFrame:
    """The `keep` best items of each kind, ties by the least `tie`; then those that `without` (tie) names go."""
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(score), tie))
    best = items.withColumn("__n", rank).where(F.col("__n") <= keep).drop("__n")
    return best if without is None else best.join(without.select(tie).distinct(), tie, "left_anti")


def most_results(rounds: Column, usual: int = 5, after: int = ROUNDS) -> Column:
    """One result in rounds beyond `after`, the usual number before."""
    return F.when(rounds > after, 1).otherwise(usual)
