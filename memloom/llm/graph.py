"""Connected components of an edge table, by minimum labels with hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any orderable type -> (id, label) with the least id of each component. No edges: no rows.

    In a round every edge hands the lesser label of its ends to both ends and to both labels, then labels follow
    their labels, so rounds grow with the logarithm of the longest path.
    """
    links = cut(edges.select("a", "b").distinct())
    ends = lambda *pairs: F.explode(F.array(*[F.struct(F.col(i).alias("id"), F.col(v).alias("v")) for i, v in pairs])).alias("e")
    low = links.withColumn("m", F.least("a", "b"))
    labels = cut(low.select(ends(("a", "m"), ("b", "m"))).groupBy("e.id").agg(F.min("e.v").alias("label")))
    while True:
        of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))  # noqa: E731,B023
        met = links.join(of("a"), "a").join(of("b"), "b").where("la <> lb").withColumn("m", F.least("la", "lb"))
        seen = met.select(ends(("a", "m"), ("b", "m"), ("la", "m"), ("lb", "m"))).groupBy("e.id").agg(F.min("e.v").alias("near"))
        step = cut(labels.join(seen, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = cut(step.join(jump, "label", "left").select("id", "old", F.coalesce(F.least("label", "far"), "label").alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels
