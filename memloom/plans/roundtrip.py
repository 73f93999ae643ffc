"""Sources and sinks that touch files: written to the shared folder and read again, against the table itself."""

from __future__ import annotations

import uuid

from memloom.functions import text as t
from memloom.functions.dialect import DUCK, SPARK
from memloom.operators import cluster
from memloom.plans.base import Registry, table
from memloom.plans.streams import _shared
from memloom.sources import files, sinks, use_log
from pyspark.sql import functions as F

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _folder(spark):
    return f"{_shared(spark)}/memloom-files-{uuid.uuid4().hex}"


@R.add("src11_state_files", "SELECT CAST(r_regionkey AS VARCHAR) AS name, r_name AS status FROM region WHERE r_regionkey IN (0, 2, 4)")
def src11_state_files(spark, sf_dir):
    path = _folder(spark)
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("job_name"), F.col("r_name").alias("status"))
    rows.repartition(5, "job_name").write.option("maxRecordsPerFile", 1).json(path)
    return files.state_files(spark, path, "job_name string, status string", ["0", "2", "4"]).select("name", "status")


@R.add("src19_scan_texts", "SELECT CASE WHEN length(n_name) * 10 < 50 THEN 'size' ELSE '' END AS reason, count(*) AS n FROM nation GROUP BY 1")
def src19_scan_texts(spark, sf_dir):
    path = _folder(spark)
    rows = table(spark, sf_dir, "nation").select(F.repeat("n_name", 10).alias("value"))
    rows.repartition(25, "value").write.option("maxRecordsPerFile", 1).option("lineSep", " ").text(path)
    out = files.text_folder(spark, path, extensions=("txt",), least=51)
    return out.where("path LIKE '%.txt'").groupBy("reason").agg(F.count("*").alias("n"))


@R.add("src22_strict_json", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def src22_strict_json(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "events").select("event_type", "value").write.json(path)
    return files.strict_json(spark, path, "event_type string, value double", lines=True).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@R.add("src23_eval_set", "SELECT item_id, CAST(length(text) AS BIGINT) AS n FROM benchmark")
def src23_eval_set(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "benchmark").select("item_id", "text").write.json(path)
    return files.strict_json(spark, path, "item_id long, text string", lines=True).select("item_id", F.length("text").cast("long").alias("n"))


@R.add("snk06_ledger", "SELECT 'patched' AS event, s_suppkey FROM supplier UNION ALL SELECT 'patched', s_suppkey FROM supplier WHERE s_suppkey % 2 = 0")
def snk06_ledger(spark, sf_dir):
    path, rows = _folder(spark), table(spark, sf_dir, "supplier").select("s_suppkey")
    sinks.ledger(rows, path, "patched", "2024-01-01T00:00:00Z")
    sinks.ledger(rows.where("s_suppkey % 2 = 0"), path, "patched", "2024-01-02T00:00:00Z")
    return files.json_lines(spark, path, "event string, s_suppkey long").select("event", "s_suppkey")


@R.add("snk08_use_log", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def snk08_use_log(spark, sf_dir):
    path, schema = _folder(spark), "user_id long, event_id long"
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]").select("user_id", "event_id")
    use_log.log_recall(stream, path, "recall", f"{path}-checkpoint", None).awaitTermination()
    use_log.record(use_log.read(spark, path, schema).where("batch = 0").select("user_id", "event_id"), 0, path, "replay")
    use_log.record(use_log.read(spark, path, schema).where("source = 'recall'").select("user_id", "event_id"), 0, path, "replay")  # a batch that comes again
    return use_log.read(spark, path, schema).where("source = 'replay'").groupBy("user_id").agg(F.count("*").alias("n"))


@R.add("clu08_sub_clusters")
def clu08_sub_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    tree = cluster.build_tree(e, max_depth=2)
    return tree.groupBy("path").agg(F.count("*").alias("n"), (F.size(F.split("path", "/")) - 1).alias("depth"))


@R.add("clu10_relaxed_retry")
def clu10_relaxed_retry(spark, sf_dir):
    """Up to three attempts; each that leaves more than half as noise asks for less of a cluster."""
    e = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return cluster.relaxed(e, "grp")


def _office(d, x):
    """Lower case without commas, scale words and punctuation but numeric characters and %."""
    return d.join(d.keep(d.words(d.sub(d.sub(f"lower({x})", ","), "[^a-z0-9.% ]", " ")), "w", "w NOT IN ('million', 'billion', 'thousand', 'a', 'an', 'the')"), " ")


_SQL = "SELECT id AS conv_id, {} AS score FROM (SELECT conv_id AS id, max(CASE WHEN turn = 0 THEN text END) AS a, max(CASE WHEN turn = 1 THEN text END) AS b FROM conversations GROUP BY conv_id) x WHERE a IS NOT NULL AND b IS NOT NULL"


def _f1(d):
    return t.token_f1(d, _office(d, "a"), _office(d, "b"))


@R.add("fn41_office_f1", _SQL.format(_f1(DUCK)))
def fn41_office_f1(spark, sf_dir):
    turn = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    pairs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turn(0).alias("a"), turn(1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return pairs.select("conv_id", F.expr(_f1(SPARK)).alias("score"))
