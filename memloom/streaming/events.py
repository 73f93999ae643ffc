"""Structured Streaming twins of the event operators: hourly counters, sessions, first events, running state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.sources.shared import cut


def read_events(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """An event stream with event time `at` and its watermark."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may name one file as well as a folder
    return spark.readStream.schema(schema).parquet(pattern).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)


def hourly(events: DataFrame) -> DataFrame:
    """Counts and mean value by hour and type."""
    w = F.window("at", "1 hour")
    return events.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("hour"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: events less than `gap` apart."""
    return events.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def first_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


def run(stream: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """Drive a stream over all that is there now; the last complete (or all appended) output."""
    spark, kept = stream.sparkSession, {}

    def take(batch: DataFrame, _: int) -> None:
        new = cut(batch)
        kept["out"] = new if mode == "complete" or "out" not in kept else kept["out"].unionByName(new)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/stream-{uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(take).start()
    query.awaitTermination()
    return kept.get("out", spark.createDataFrame([], stream.schema))


def keep_state(stream: DataFrame, start: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> DataFrame:
    """Fold a stream into a state table: state = merge(state, batch) after each micro-batch."""
    state = {"now": start}

    def fold(batch: DataFrame, _: int) -> None:
        state["now"] = cut(merge(state["now"], batch))

    query = stream.writeStream.option("checkpointLocation", f"{checkpoint}/state-{uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(fold).start()
    query.awaitTermination()
    return state["now"]


def decayed_counts(state: DataFrame, batch: DataFrame, days: float = 7, half_life: float = 14) -> DataFrame:
    """Negative counts (user_id, ema): the old ones halve every half_life days, new errors add one; under 0.5 they go."""
    fresh = batch.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").cast("double").alias("fresh"))
    both = state.join(fresh, "user_id", "full_outer")
    ema = F.coalesce("ema", F.lit(0.0)) * F.pow(F.lit(0.5), F.lit(days / half_life)) + F.coalesce("fresh", F.lit(0.0))
    return both.select("user_id", ema.alias("ema")).where("ema >= 0.5")
