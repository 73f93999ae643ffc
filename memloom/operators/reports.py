"""Reports over events and scores: percentiles, shares, outliers, trends, histograms and steps of confidence."""

from __future__ import annotations

from memloom.sources.shared import cut
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of a judge's estimate, buckets of a histogram, what a step does to confidence.
LOW, HIGH, SPAN = 0.40, 0.65, 0.35
CLICK, RECALL, IDLE, NEGATED = 0.05, 0.99, 0.997, 0.5


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def percentiles(rows: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """group and its exact, interpolated percentiles of value. Values are counted first, so a group's distinct values are what meets in a task."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    return counts.groupBy(group).agg(*[F.percentile("__v", F.lit(p), F.col("__n")).alias(name) for name, p in points.items()])


def router(events: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, p50, p95, p99 and empty_pct, the percentage of zeros among all rows."""
    base = events.groupBy(group).agg(F.count("*").alias("n"), (100 * _share(F.col(value) == 0)).alias("empty_pct"))
    return base.join(percentiles(events, group, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}), group, "left")


def contribution(events: DataFrame, group: str, value: str) -> DataFrame:
    """group, mean, most, total and how many values are above 0."""
    return events.groupBy(group).agg(F.avg(value).alias("mean"), F.max(value).alias("most"), F.sum(value).alias("total"), F.count(F.when(F.col(value) > 0, 1)).alias("non_zero"))


def token_usage(rows: DataFrame, group: str, tokens: str) -> DataFrame:
    """group, mean, most, p90 and the group's share of all tokens; the total is one row."""
    own = cut(rows.where(F.col(tokens).isNotNull()).groupBy(group).agg(F.avg(tokens).alias("mean"), F.max(tokens).alias("most"), F.sum(tokens).alias("__own")))
    total = own.agg(F.sum("__own").alias("__all"))
    shared = own.crossJoin(F.broadcast(total)).withColumn("share", F.col("__own") / F.nullif(F.col("__all").cast("double"), F.lit(0.0)))
    return shared.drop("__own", "__all").join(percentiles(rows, group, tokens, {"p90": 0.9}), group, "left")


def top_modules(errors: DataFrame, module: str, keep: int = 10) -> DataFrame:
    """module, n, rnk: the `keep` modules with most errors, ties by module. Ranks are given to those rows alone."""
    best = errors.groupBy(module).agg(F.count("*").alias("n")).orderBy(F.desc("n"), module).limit(keep)
    return best.withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("n"), module)))


def duration_outliers(runs: DataFrame, job: str, value: str, at: str, tie: str) -> DataFrame:
    """job, latest and outlier of jobs with three runs at least: over two standard deviations and half the mean away from it."""
    own = runs.groupBy(job).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.max_by(value, F.struct(at, tie)).alias("latest")).where("n >= 3")
    away = F.abs(F.col("latest") - F.col("mean"))
    return own.select(job, "latest", ((away > 2 * F.col("sd")) & (away > 0.5 * F.col("mean"))).alias("outlier"))


def judge_estimate(rows: DataFrame, group: str, mean: Column, kept: Column) -> DataFrame:
    """group, est_avg, est_rate: what a judge would say, from the mean score and the share of rows kept."""
    both = rows.groupBy(group).agg(F.avg(mean).alias("m"), F.avg(kept.cast("double")).alias("r"))
    base = LOW + (F.least(F.greatest(F.col("m"), F.lit(LOW)), F.lit(HIGH)) - LOW) / (HIGH - LOW) * SPAN
    return both.select(group, base.alias("est_avg"), F.greatest(F.lit(0.1), F.least(F.lit(0.95), base * (0.85 + 0.3 * F.col("r")))).alias("est_rate"))


def mean_of_means(rows: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """outer, members and the mean over its inner keys of their means."""
    return rows.groupBy(outer, inner).agg(F.avg(value).alias("m")).groupBy(outer).agg(F.count("*").alias("members"), F.avg("m").alias("mean_of_means"))


def category_report(rows: DataFrame, category: str, faithful: Column, relevant: Column, covered: Column) -> DataFrame:
    """category ('all' for the grand total), overall = 0.4, 0.3 and 0.3 of three aggregates, and n."""
    overall = 0.4 * faithful + 0.3 * relevant + 0.3 * covered
    return rows.rollup(category).agg(overall.alias("overall"), F.count("*").alias("n"), F.grouping(category).alias("__all")).select(F.when(F.col("__all") == 1, "all").otherwise(F.col(category)).alias("category"), "overall", "n")


def score_stats(rows: DataFrame, group: str, value: str) -> DataFrame:
    return rows.groupBy(group).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.count("*").alias("n"))


def recent_trend(rows: DataFrame, key: str, at: str, tie: str, high: Column, last: int = 10) -> DataFrame:
    """key, n, high and ratio over the `last` rows of each key; a key's older rows go before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie)))
    own = rows.withColumn("__high", high).withColumn("__n", rank).where(F.col("__n") <= last)
    n = F.count(F.when(F.col("__high"), 1))
    return own.groupBy(key).agg(F.count("*").alias("n"), n.alias("high"), (n / F.count("*")).alias("ratio"))


def hourly(rows: DataFrame, at: str, hit: Column) -> DataFrame:
    """hour, n and hit_rate."""
    return rows.groupBy(F.date_trunc("hour", at).alias("hour")).agg(F.count("*").alias("n"), _share(hit).alias("hit_rate"))


def histogram(rows: DataFrame, value: str, edges: tuple[float, ...]) -> DataFrame:
    """bucket, n and mean by half-open buckets; the last, open one also takes null values."""
    name = F
    for a, b in zip(edges, edges[1:]):
        name = name.when(F.col(value) < b, f"{a:g}-{b:g}")
    return rows.groupBy(name.otherwise(f"{edges[-1]:g}+").alias("bucket")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def warnings(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and the array of the names of all rules (aggregates) that hold."""
    return rows.groupBy(key).agg(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])).alias("warnings"))


def confidence_step(kind: Column, confidence: Column, days: Column) -> Column:
    """click: a twentieth more, 1 at most; recall fades by 0.99 a day, no use by 0.997; a negation halves."""
    return F.when(kind == "click", F.least(F.lit(1.0), confidence + CLICK)).when(kind == "recall", confidence * F.pow(F.lit(RECALL), days)).when(kind == "negated", confidence * NEGATED).otherwise(confidence * F.pow(F.lit(IDLE), days))


def weights(rows: DataFrame, weight: Column, low: float = 0.2) -> DataFrame:
    """mean, low, high and the share of weights under `low`, in one row."""
    return rows.select(weight.alias("w")).agg(F.avg("w").alias("mean"), F.min("w").alias("low"), F.max("w").alias("high"), _share(F.col("w") < low).alias("low_share"))
