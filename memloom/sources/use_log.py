"""A use log written by a stream, each batch once however often it is run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def record(batch: DataFrame, batch_id: int, path: str, source: str) -> None:
    """Write a micro-batch to its own folder source=/batch=; a batch that comes again takes the place of what it wrote before.

    A write that was cut short leaves no _SUCCESS, so `read` passes it over until the batch has been run again.
    """
    if "/" in source or not source:
        raise ValueError("a source is the name of one folder")
    batch.write.mode("overwrite").json(f"{path}/source={source}/batch={batch_id}")


def log_recall(recalls: DataFrame, path: str, source: str, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
    """Append a stream of recalls to the log; every: the time between batches, None: all that is there now, then stop.

    The checkpoint numbers the batches and source names its stream: a stream that starts anew needs another source.
    """
    when = {"availableNow": True} if every is None else {"processingTime": every}
    return recalls.writeStream.option("checkpointLocation", checkpoint).trigger(**when).foreachBatch(lambda batch, n: record(batch, n, path, source)).start()


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all finished batches, with source and batch. schema: that of the recalls."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/source=*/batch=*/_SUCCESS")) or []
    done = [f.getPath().getParent().toString() for f in found]
    if not done:
        return spark.createDataFrame([], f"{schema}, source string, batch long")
    return spark.read.option("basePath", path).schema(f"{schema}, source string, batch long").json(done)
