"""Readers and writers of tables, envelopes, media and outboxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardloom.functions.ordered import running

ENVELOPE = T.StructType([T.StructField(n, T.StringType()) for n in ("event_id", "event", "event_type", "channel", "correlation_id", "request_id", "schema_version", "source_module", "timestamp")] + [T.StructField("payload", T.MapType(T.StringType(), T.StringType()))])
COLUMNS = ["event_id", "event", "event_type", "request_key", "correlation_id", "channel", "timestamp", "payload"]


def read_table(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """A table with the schema that is asked for; a table that isn't there is an empty one."""
    try:
        rows = spark.read.schema(schema).parquet(path)
        rows.schema  # noqa: B018  the path is looked up here
    except Exception as e:  # the reader names a missing path in the message alone
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], schema)
    return rows.select(*(columns or schema.fieldNames()))


def write_partition(rows: DataFrame, path: str, partition: str) -> None:
    """Replaces the partitions that rows has and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def read_media(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("png", "jpg", "jpeg", "wav", "mp3"), most: int = 10_000_000) -> DataFrame:
    """(path, kind, length, content, accepted): files of the kinds and size that are taken in."""
    rows = spark.read.format("binaryFile").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return rows.select("path", kind.alias("kind"), "length", "content", (kind.isin(*kinds) & (F.col("length") <= most)).alias("accepted"))


def parsed(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Envelopes with their key, and the lines that are none: not an object, or without any key."""
    e = F.from_json(value, ENVELOPE)
    rows = lines.withColumn("e", e)
    text = lambda c: F.when(F.trim(c) != "", F.trim(c))
    key = F.coalesce(text(F.col("e.correlation_id")), text(F.col("e.request_id")), text(F.col("e.payload")["request_id"]))
    rows = rows.withColumn("request_key", key)
    good = rows.where("request_key is not null").select("e.event_id", "e.event", "e.event_type", "request_key", "e.correlation_id", "e.channel", "e.timestamp", "e.payload")
    return good, rows.where("request_key is null").select(value)


def envelope(event: Column, event_id: Column, request_id: Column, at: Column, payload: Column) -> Column:
    """The JSON text of an event."""
    return F.to_json(F.struct(event_id.alias("event_id"), event.alias("event"), request_id.alias("request_id"), request_id.alias("correlation_id"), at.alias("timestamp"), payload.alias("payload")))


def surrogate(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 12)))


def request_ids(rows: DataFrame, order: str, year: int) -> DataFrame:
    """rows with sequential ids in the order, which no two rows share."""
    return running(rows, [order], __no=F.lit(1)).withColumn("request_no", F.format_string(f"REQ-{year}-%06d", "__no")).drop("__no")


def outbox(rows: DataFrame, sent: DataFrame) -> DataFrame:
    """rows(event_id, ...) with status: PUBLISHED where sent(event_id, ok) has a success, FAILED after tries without one, else PENDING."""
    tries = sent.groupBy("event_id").agg(F.max("ok").alias("ok"), F.count("*").alias("attempts"))
    status = F.when(F.col("ok"), "PUBLISHED").when(F.col("attempts") > 0, "FAILED").otherwise("PENDING")
    return rows.join(tries, "event_id", "left").withColumns({"status": status, "attempts": F.coalesce("attempts", F.lit(0)).cast("long")}).drop("ok")
