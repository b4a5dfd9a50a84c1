"""A stream of envelopes into a store, in which no line ends the query and none is lost: each is stored, known, left out or in the table of errors."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardloom.operators.contained import Stage, run
from wardloom.sources.io import parsed
from wardloom.sources.store import Store

COUNTERS = "batch long, lines long, processed long, duplicate long, skipped long, failed long, with_warnings long, last_error string"


def take_batch(lines: DataFrame, number: int, store: Store, stages: list[Stage], table: str = "records", writer: str = "intake", wanted: tuple[str, ...] | None = None) -> None:
    """Brings one batch of lines(value) into the store; the same batch again changes nothing.

    Envelopes go through the stages and into ``table`` by request_key, warnings included, the first by event_id of those that share one. Lines that are no envelope go to ``<table>_errors``
    (batch, value, reason), events of a type that is not wanted nowhere, and the counts of all to ``<table>_counters``. Every step is committed once for each batch, so a driver that
    is lost between two of them goes on with the second. lines = processed + duplicate + skipped + failed.
    """
    spark, lines = store.spark, lines.select("value").persist()
    try:
        good, bad = parsed(lines)
        asked = F.lit(True) if wanted is None else F.coalesce(F.col("event_type").isin(*wanted), F.lit(False))
        kept = run(good.where(asked), stages).withColumn("payload", F.to_json("payload"))
        store.merge(table, kept, ["request_key"], writer, number, "skip", ["event_id", "timestamp", "payload"])
        reason = F.when(F.trim("value") == "", "empty line").when(F.from_json("value", "map<string, string>").isNull(), "no object").otherwise("no key")
        store.commit(f"{writer}-errors", number, {f"{table}_errors": (bad.select(F.lit(number).cast("long").alias("batch"), "value", reason.alias("reason")), [])})
        done = store.outcomes(table, writer, number).agg(F.count_if(F.col("outcome") == "inserted").alias("processed"), (F.sum("repeats") + F.count_if(F.col("outcome") != "inserted")).alias("duplicate")).first()
        noted = store.snapshot().table(table).join(store.outcomes(table, writer, number).where("outcome = 'inserted'").select(F.get_json_object("key", "$.request_key").alias("request_key")), "request_key", "left_semi")
        warned = noted.where(F.size("warnings") > 0).count()
        failed = bad.select(F.count("*").alias("n"), F.max(reason).alias("last")).first()
        total = lines.count()
        processed, duplicate = done["processed"] or 0, done["duplicate"] or 0
        row = (number, total, processed, duplicate, total - processed - duplicate - failed["n"], failed["n"], warned, failed["last"])
        store.commit(f"{writer}-counters", number, {f"{table}_counters": (spark.createDataFrame([row], COUNTERS), [])})
    finally:
        lines.unpersist()


def ingest(stream: DataFrame, store: Store, stages: list[Stage], checkpoint: str, wanted: tuple[str, ...] | None = None) -> StreamingQuery:
    """A query that takes each batch of stream(value) by ``take_batch``."""
    take = lambda batch, number: take_batch(batch, number, store, stages, wanted=wanted)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_running(start: Callable[[], StreamingQuery], wait: float = 2.0, most: int = 5) -> int:
    """Starts a query and starts it again from its checkpoint when it fails, after a pause; gives how often. Raises the failure once it came more than ``most`` times without end."""
    for again in range(most + 1):
        try:
            start().awaitTermination()
            return again
        except StreamingQueryException:
            if again == most:
                raise
            time.sleep(wait)
    return most
