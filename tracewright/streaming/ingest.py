"""Streaming counterparts: deduplicated arrival, supersession and delta maintenance, restartable from checkpoints."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.plans.storage import shared_dir


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet file or folder as a stream; its schema is read, not inferred from data."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Event times without a zone are read in the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def first_arrivals(stream: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """One row a key within the watermark; state for older keys is dropped."""
    return _timed(stream, time).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, delay: str = "10 minutes") -> DataFrame:
    return _timed(stream, time).withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> str:
    """Run all that is available and stop; returns the path written (or the checkpoint's, with ``each``)."""
    base = f"{shared_dir(stream.sparkSession)}/tracewright/stream-{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").outputMode(mode).trigger(availableNow=True)
    query: StreamingQuery = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", f"{base}/out").start()
    query.awaitTermination()
    return base if each else f"{base}/out"


def latest_totals(totals: DataFrame, name: str) -> DataFrame:
    """The last state of a streamed aggregate, windows that are still open included: every batch rewrites the whole result."""
    base = f"{shared_dir(totals.sparkSession)}/tracewright/totals-{name}-{uuid.uuid4().hex}"
    run_once(totals, name, lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/batch={number}"), mode="complete")
    rows = totals.sparkSession.read.parquet(base)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")


def deltas(stream: DataFrame, name: str, keys: list[str], signed: str = "delta") -> DataFrame:
    """Final counts of a changelog ``(key, ±1)``: each batch is summed by key and appended once, counts are sums.

    A batch writes under its own number, so one that is run again replaces what it wrote.
    """
    base = f"{shared_dir(stream.sparkSession)}/tracewright/deltas-{name}-{uuid.uuid4().hex}"

    def each(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.sum(signed).alias(signed)).write.mode("overwrite").parquet(f"{base}/batch={number}")

    run_once(stream, name, each)
    return stream.sparkSession.read.parquet(base).groupBy(*keys).agg(F.sum(signed).alias("support_count"))


def two_stages(stream: DataFrame, name: str, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chained stages: the second streams what the first wrote; either resumes from its own checkpoint."""
    spark = stream.sparkSession
    landed = run_once(first(stream), f"{name}-1")
    return spark.read.parquet(run_once(second(event_stream(spark, landed)), f"{name}-2"))


def supersede_stream(changes: DataFrame, name: str, keys: list[str], time_col: str = "ts") -> DataFrame:
    """Bitemporal versions ``(…, valid_from, valid_to)`` of a stream of changes: a newer row closes the one before, none is deleted.

    A batch merges its rows into the versions of the last and writes the outcome under its own number, so a
    batch that is run again replaces what it wrote. Late rows take their place by time: every key's versions
    are laid out anew from all its changes, and only keys that the batch has are touched.
    """
    base = f"{shared_dir(changes.sparkSession)}/tracewright/versions-{name}-{uuid.uuid4().hex}"
    rest = [c for c in changes.columns if c != time_col]

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*rest, F.col(time_col).alias("valid_from"))
        before = f"{base}/batch={number - 1}"
        if number and _exists(spark, before):
            held = spark.read.parquet(before).drop("valid_to")
            touched = rows.select(*keys).distinct()
            same = spark.read.parquet(before).join(touched, keys, "left_anti")
            rows = held.join(touched, keys, "left_semi").unionByName(rows).distinct()
        else:
            same = None
        w = Window.partitionBy(*keys).orderBy("valid_from", *[c for c in rest if c not in keys])
        laid = rows.withColumn("valid_to", F.lead("valid_from").over(w))
        (laid if same is None else laid.unionByName(same.select(*laid.columns))).write.mode("overwrite").parquet(f"{base}/batch={number}")

    run_once(changes, name, each)
    spark, last = changes.sparkSession, 0
    while _exists(spark, f"{base}/batch={last + 1}"):
        last += 1
    return spark.read.parquet(f"{base}/batch={last}")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def with_retries(job: Callable[[], object], attempts: int = 3, wait: float = 2.0, retryable: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError, OSError), sleep=time.sleep):
    """Run a job at least once: failures of the listed kinds are tried again, after ``wait``, ``wait`` squared and so on; others fail at once."""
    for attempt in range(1, attempts + 1):
        try:
            return job()
        except retryable:
            if attempt == attempts:
                raise
            sleep(wait**attempt)
    raise ValueError("attempts must be positive")


class JobStatus:
    """Documents as a folder of files and what became of each, from the landed table: pending or done."""

    def __init__(self, spark: SparkSession, inbox: str, landed: str):
        self.spark, self.inbox, self.landed = spark, inbox, landed

    def table(self) -> DataFrame:
        files = self.spark.read.format("binaryFile").load(self.inbox).select(F.element_at(F.split("path", "/"), -1).alias("name"))
        done = self.spark.read.parquet(self.landed).select(F.element_at(F.split("path", "/"), -1).alias("name")).distinct() if _exists(self.spark, self.landed) else None
        if done is None:
            return files.withColumn("status", F.lit("pending"))
        return files.join(done.withColumn("status", F.lit("done")), "name", "left").fillna("pending", ["status"])
