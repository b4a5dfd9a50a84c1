"""Streams: envelopes in, idempotent demand and issue groups out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardloom.sources.io import parsed


def envelopes(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON lines from files."""
    return spark.readStream.format("text").load(path)


def unique_requests(stream: DataFrame, delay: str = "720 hours") -> DataFrame:
    """Events of one type each once by request, within the delay; state older than it is dropped."""
    good, _ = parsed(stream)
    timed = good.withColumn("ts", F.to_timestamp("timestamp")).withWatermark("ts", delay)
    return timed.dropDuplicatesWithinWatermark(["request_key"])


def windowed_demand(rows: DataFrame, length: str = "30 days", delay: str = "720 hours") -> DataFrame:
    """Complaints of each ward and sector by window of event time; late rows within the delay count."""
    return rows.withWatermark("ts", delay).groupBy(F.window("ts", length), "ward_code", "sector").agg(F.count("*").alias("complaint_count"), F.avg("severity").alias("avg_severity"))


def merge_batches(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs merge(batch, number) once for each batch; a batch number seen before is the same batch again."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """JSON events to files, exactly once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_issue_counts(rows: DataFrame) -> DataFrame:
    """Running report count and worst severity of each category and sub-category; null severities count as reports and say nothing of the worst."""
    return rows.groupBy("category", "sub_category").agg(F.count("*").alias("report_count"), F.max("severity").cast("long").alias("severity_max"))
