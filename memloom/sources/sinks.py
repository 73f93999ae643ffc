"""Sinks as functions old table + delta -> new table, and appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, delta: DataFrame, keys: list[str], merge: dict[str, str]) -> DataFrame:
    """Full outer merge on keys; merge gives for each column greatest, sum, new or old. Delta rows of one key are merged first."""
    ways = {"greatest": F.max, "sum": F.sum, "new": F.last, "old": F.first}
    both = old.withColumn("_age", F.lit(0)).unionByName(delta.withColumn("_age", F.lit(1)), allowMissingColumns=True)

    def agg(c: str, how: str) -> Column:
        if how in ("greatest", "sum"):
            return ways[how](c).alias(c)
        pick = F.max_by if how == "new" else F.min_by
        return pick(c, F.when(F.col(c).isNotNull(), F.col("_age"))).alias(c)

    return both.groupBy(*keys).agg(*[agg(c, how) for c, how in merge.items()])


def edges(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Edge counts (from_id, to_id, kind, n) with those of a delta added."""
    return old.unionByName(delta).groupBy("from_id", "to_id", "kind").agg(F.sum("n").alias("n"))


def insert_ignore(old: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(delta.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def daily(old: DataFrame, day: DataFrame, keep: int = 30) -> DataFrame:
    """One row per date: a date's new row replaces the old, the last `keep` stay."""
    return old.join(day.select("date"), "date", "left_anti").unionByName(day, allowMissingColumns=True).orderBy(F.desc("date")).limit(keep)


def rotate(rows: DataFrame, key: str, order: str, keep: int) -> DataFrame:
    """The last `keep` rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def ledger(rows: DataFrame, path: str, event: str, ts: str) -> None:
    """Append rows as JSON lines with ts and event; columns of the same names in rows win."""
    out = rows
    for name, value in (("ts", ts), ("event", event)):
        if name not in rows.columns:
            out = out.withColumn(name, F.lit(value))
    out.write.mode("append").json(path)


def archive(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(archive, rows): texts over `limit` characters move to the archive with hash and length, their rows keep head and tail."""
    from memloom.functions.dialect import SPARK
    from memloom.functions.text import replacement

    long = F.length("text") > limit
    kept = rows.where(long).select("id", "text", F.sha2("text", 256).alias("digest"), F.length("text").alias("n"))
    return kept, rows.withColumn("text", F.when(long, F.expr(replacement(SPARK, "text"))).otherwise(F.col("text")))
