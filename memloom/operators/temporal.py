"""Joins over time and upkeep of tables: versions and their state at a time, events that follow events, stale and unlinked rows, shared sessions, windows of judgements."""

from __future__ import annotations

from memloom.functions import text as t
from memloom.functions.dialect import SPARK
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of past, present and future in a question.
PAST = ("过去", "以前", "之前", "旧版", "老版本", "历史上", "曾", "曾经")
PRESENT = ("现在", "当前", "目前", "最新", "现在的", "现行", "新版", "新版本")
FUTURE = ("将来", "未来", "以后", "之后", "即将", "下一步")


def versions(rows: DataFrame, key: str, start: str, *then: str) -> DataFrame:
    """rows with valid_to: the start of the key's next version, null for the open one; equal starts are ordered by `then`."""
    return rows.withColumn("valid_to", F.lead(start).over(Window.partitionBy(key).orderBy(start, *then)))


def as_of(held: DataFrame, asked: DataFrame, key: str, at: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """asked rows with the version of their key that holds at their time: start <= at, and at < end where end is not null; the latest start wins.

    Of versions with one start the greatest row wins; a question without a version keeps nulls in `version`. Questions are joined
    on the key, and only versions that began by then meet them.
    """
    row = F.struct(*[F.col(c) for c in held.columns if c != key])
    one = held.select(F.col(key), F.col(start).alias("__from"), F.col(end).alias("__to"), row.alias("__row"))
    # numbered and read once: numbers of a second reading would belong to other rows
    own = asked.select(key, F.col(at).alias("__at"), F.struct(*asked.columns).alias("__asked")).withColumn("__id", F.monotonically_increasing_id())
    holds = (F.col("__from") <= F.col("__at")) & (F.col("__to").isNull() | (F.col("__to") > F.col("__at")))
    met = own.withColumnRenamed(key, "__key").join(one, (F.col("__key") == F.col(key)) & holds, "left")
    best = met.groupBy("__id").agg(F.first("__asked").alias("__asked"), F.max(F.when(F.col("__from").isNotNull(), F.struct("__from", "__row"))).alias("__best"))
    return best.select("__asked.*", F.col("__best.__row").alias("version"))


def followed(rows: DataFrame, events: DataFrame, key: str, at: str, seconds: int, flag: str) -> DataFrame:
    """rows with a flag: whether an event of their key lies at most `seconds` before them.

    Times are cut into cells of that length, so a row meets the events of its own cell and the one before by equal keys; events of a
    cell are reduced to their least and greatest time first, which decide it, so a hot key sends two rows a cell.
    """
    cell = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * 1_000_000))
    ends = events.groupBy(key, cell.alias("__cell")).agg(F.min(at).alias("__low"), F.max(at).alias("__high"))
    spread = ends.select(key, "__low", "__high", F.explode(F.array(F.struct(F.col("__cell").alias("c"), F.lit(True).alias("same")), F.struct((F.col("__cell") + 1).alias("c"), F.lit(False).alias("same")))).alias("__e"))
    # in one cell the first event decides, from the cell before the last one
    marks = spread.groupBy(key, F.col("__e.c").alias("__cell")).agg(F.min(F.when(F.col("__e.same"), F.col("__low"))).alias("__own"), F.max(F.when(~F.col("__e.same"), F.col("__high"))).alias("__last"))
    met = rows.withColumn("__cell", cell).join(marks, [key, "__cell"], "left")
    late = F.col("__last") >= F.col(at) - F.make_dt_interval(secs=F.lit(seconds))
    return met.withColumn(flag, F.coalesce(F.col("__own") <= F.col(at), F.lit(False)) | F.coalesce(late, F.lit(False))).select(*rows.columns, flag)


def stale(texts: DataFrame, hashes: DataFrame) -> DataFrame:
    """(id) of texts (id, text) whose stored hash (id, hash) is null or another one; texts without a row of hashes are left out."""
    met = texts.join(hashes.select("id", F.col("hash").alias("__hash")), "id")
    return met.where(F.col("text").isNotNull() & ~F.col("__hash").eqNullSafe(F.md5("text")) | F.col("__hash").isNull()).select("id")


def unlinked(nodes: DataFrame, key: str, links: DataFrame, *ends: str) -> DataFrame:
    """nodes that no link names in any of its ends; ends are listed one below the other, so the anti join stays an equi-join."""
    named = links.select(F.explode(F.array(*[F.col(e) for e in ends])).alias(key)).where(F.col(key).isNotNull()).distinct()
    return nodes.join(named, key, "left_anti")


def cooccurrence(uses: DataFrame) -> DataFrame:
    """(a, b, n, rate): in how many sessions both subjects a < b of uses (session, subject) occur, and n by the greatest n.

    Pairs are those of one session's distinct subjects; the greatest n is one row.
    """
    own = uses.where("session IS NOT NULL AND subject IS NOT NULL").select("session", "subject").distinct()
    pairs = own.withColumnRenamed("subject", "a").join(own.withColumnRenamed("subject", "b"), "session").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    most = pairs.agg(F.max("n").alias("__most"))
    return pairs.crossJoin(F.broadcast(most)).select("a", "b", "n", (F.col("n") / F.col("__most")).alias("rate"))


def rolling_judge(scores: DataFrame, group: str, at: str, value: str, tie: str, days: int = 7, last: int = 200, least: int = 5, good: float = 50.0) -> DataFrame:
    """group, relevant_rate, mean of the newest `last` scores within `days` of the newest of all; a rate of fewer than `least` is null.

    The newest rows are taken by a top-k, partition by partition, not by a window over all.
    """
    newest = scores.agg(F.max(at).alias("__now"))
    recent = scores.crossJoin(F.broadcast(newest)).where(F.col(at) >= F.col("__now") - F.make_dt_interval(days=F.lit(days)))
    sample = recent.orderBy(F.desc(at), F.desc(tie)).limit(last)
    rate = F.avg(F.when(F.col(value) >= good, 1.0).otherwise(0.0))
    return sample.groupBy(group).agg(F.when(F.count("*") >= least, rate).alias("relevant_rate"), F.avg(value).alias("mean"))


def regressions(rows: DataFrame, key: str, current: Column, score: str, latency: str, least: int = 4) -> DataFrame:
    """key, score_drop (below 0.9 of before) and slower (over 1.5 times) of keys with `least` rows in both periods: one aggregate, no self-join."""
    one = lambda f, c, now: f(F.when(current == F.lit(now), F.col(c)))
    both = rows.groupBy(key).agg(*[f(now).alias(f"{n}{int(now)}") for now in (False, True) for n, f in (("n", lambda w: F.count(F.when(current == F.lit(w), 1))), ("s", lambda w: one(F.avg, score, w)), ("l", lambda w: one(F.max, latency, w)))])
    kept = both.where((F.col("n0") >= least) & (F.col("n1") >= least))
    return kept.select(key, (F.col("s1") < 0.9 * F.col("s0")).alias("score_drop"), (F.col("l1") > 1.5 * F.col("l0")).alias("slower"))


def _before(a: Column, b: Column) -> Column:
    """Whether date text a lies before b at the coarser of their grains."""
    n = F.least(F.length(a), F.length(b))
    return F.left(a, n) < F.left(b, n)


def by_tense(results: DataFrame, query: str, today: Column, factor: float = 0.5) -> DataFrame:
    """results (query, id, score, valid_from, valid_until) with the score cut by `factor` for each rule that their dates break, and demoted.

    A question about the present cuts what has ended, one about the past what has not begun yet, one with a date both what begins
    after it and what ended before it. Dates are ISO texts of any grain; null ones break nothing, and a question without a sign of time
    cuts nothing. Scores of questions about time have 4 places.
    """
    said = lambda words: F.coalesce(F.regexp_like(F.col(query), F.lit("|".join(words))), F.lit(False))
    date = F.nullif(F.expr(t.iso_date(SPARK, query)), F.lit(""))
    vf, vu = F.nullif(F.col("valid_from").cast("string"), F.lit("")), F.nullif(F.col("valid_until").cast("string"), F.lit(""))
    broken = [said(PRESENT) & _before(vu, today), said(PAST) & _before(today, vf), _before(date, vf), _before(vu, date)]
    times = sum((F.coalesce(x, F.lit(False)).cast("int") for x in broken), F.lit(0))
    timed = said(PAST) | said(PRESENT) | said(FUTURE) | date.isNotNull()
    return results.withColumns({"score": F.when(timed, F.round(F.col("score") * F.pow(F.lit(factor), times), 4)).otherwise(F.col("score")), "demoted": times > 0})
