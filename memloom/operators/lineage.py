"""Versioned provenance of knowledge points: records are appended, never replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "node string, version long, article string, text string, method string, steps array<struct<ord: bigint, step: string, detail: string>>"


def append(records: DataFrame, new: DataFrame, full: bool = False) -> DataFrame:
    """records (SCHEMA) with new ones (node, ord, article, text, method): each is its node's next version, in order of ord, then article and text.

    The text is kept with `full` only; method defaults to llm_extract. Null nodes are left out.
    """
    last = records.groupBy("node").agg(F.max("version").alias("last"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("ord", "article", "text"))
    own = new.where("node IS NOT NULL").withColumn("node", F.col("node").cast("string")).withColumn("at", place).join(last, "node", "left")
    return records.unionByName(
        own.select(
            "node",
            (F.coalesce("last", F.lit(0)) + F.col("at")).alias("version"),
            F.coalesce("article", F.lit("")).alias("article"),
            (F.coalesce("text", F.lit("")) if full else F.lit("")).alias("text"),
            F.coalesce("method", F.lit("llm_extract")).alias("method"),
            F.expr("CAST(array() AS array<struct<ord: bigint, step: string, detail: string>>)").alias("steps"),
        )
    )


def latest(records: DataFrame) -> DataFrame:
    """The newest version of each node."""
    return records.groupBy("node").agg(F.max_by(F.struct(*[c for c in records.columns if c != "node"]), "version").alias("r")).select("node", "r.*")


def add_steps(records: DataFrame, steps: DataFrame) -> DataFrame:
    """records with steps (node, ord, step, detail) put behind those of each node's newest version, in order; steps of unknown nodes are left out."""
    more = steps.where("node IS NOT NULL").groupBy(F.col("node").cast("string").alias("node")).agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), "step", "detail"))).alias("more"))
    newest = records.groupBy("node").agg(F.max("version").alias("version")).join(more, "node")
    return records.join(newest, ["node", "version"], "left").select("node", "version", "article", "text", "method", F.when(F.col("more").isNotNull(), F.concat("steps", "more")).otherwise(F.col("steps")).alias("steps"))
