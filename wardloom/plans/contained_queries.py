"""Queries over stages that fail by row and over a stream in which lines fail."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.functions.columns import clamp, valid_point
from wardloom.functions.ordered import checkpoint_dir
from wardloom.functions.text import to_double
from wardloom.operators.contained import Stage, failure_counts, failures, run, unreadable
from wardloom.plans.registry import query
from wardloom.sources.store import Store
from wardloom.sources.testdata import Tables
from wardloom.streaming.contained import ingest


def stages() -> list[Stage]:
    severity, lat, lon = to_double("severity"), to_double("latitude"), to_double("longitude")
    outside = ~F.coalesce(valid_point(F.col("lat"), F.col("lon")), F.lit(False)) & (F.col("lat").isNotNull() | F.col("lon").isNotNull())
    return [
        Stage("severity", {"level": F.when(severity.isNotNull(), clamp(F.round(severity), 1, 5).cast("int"))}, unreadable("severity", severity, "no number"), {"level": 1}),
        Stage("latitude", {"lat": lat}, unreadable("latitude", lat, "no number")),
        Stage("longitude", {"lon": lon}, unreadable("longitude", lon, "no number")),
        Stage("point", {"cell": F.concat_ws(":", F.floor("lat"), F.floor("lon"))}, F.when(outside, "half a point or out of range"), {"cell": "nowhere"}, ("latitude", "longitude")),
    ]


_SAID = """
x as (select event_id, case event_id % 8 when 0 then 3 when 1 then 5 when 2 then 1 when 3 then 5 when 6 then 1 when 7 then 5 end as level,
  case event_id % 8 when 2 then 'no number: abc' end as severity, case event_id % 5 when 2 then 'no number: abc' end as latitude,
  case event_id % 5 when 0 then '12:77' when 2 then 'nowhere' when 1 then 'nowhere' when 3 then 'nowhere' when 4 then '' end as cell,
  case event_id % 5 when 2 then 'a stage before it failed' when 1 then 'half a point or out of range' when 3 then 'half a point or out of range' end as point from complaints),
w as (select event_id, 'severity' as stage, severity as message from x union all select event_id, 'latitude', latitude from x union all select event_id, 'point', point from x)"""


@query("n7_contained_stages", f"with {_SAID} select event_id, level, cell, (case when severity is null then 0 else 1 end + case when latitude is null then 0 else 1 end + case when point is null then 0 else 1 end)::int as n_warnings from x")
def _(t: Tables) -> DataFrame:
    return run(t.complaints.drop("lat", "lon"), stages()).select("event_id", "level", "cell", F.size("warnings").alias("n_warnings"))


@query("n7_failures", f"with {_SAID} select * from w where message is not null")
def _(t: Tables) -> DataFrame:
    return failures(run(t.complaints.drop("lat", "lon"), stages()), "event_id")


@query("n7_failure_counts", f"with {_SAID} select stage, count(*) as failed, min(message) as message from w where message is not null group by stage")
def _(t: Tables) -> DataFrame:
    return failure_counts(run(t.complaints.drop("lat", "lon"), stages()))


#: Every 11th line is cut, every 13th has no key, of the others every request may come again.
_KIND = "case when event_id % 11 = 0 then 'cut' when event_id % 13 = 0 then 'no key' when event_type = 'view' then 'other' else 'good' end"


def _number() -> Stage:
    said = F.col("payload")["value"]
    return Stage("number", {"number": said.try_cast("double")}, unreadable(said, said.try_cast("double"), "no number"), {"number": 0.0})


def _ingested(t: Tables) -> Store:
    """All events as lines in files, taken by a stream."""
    home = f"{checkpoint_dir(t.spark)}/contained-{uuid.uuid4().hex}"
    key = F.when(F.expr(_KIND) != "no key", F.col("request_id"))
    value = F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    text = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), "event_type", key.alias("request_id"), F.create_map(F.lit("value"), value).alias("payload")))
    lines = t.envelopes.select(F.when(F.expr(_KIND) == "cut", F.substring(text, 2, 20)).otherwise(text).alias("value"))
    lines.write.text(f"{home}/lines")
    store = Store(t.spark, f"{home}/store")
    ingest(t.spark.readStream.text(f"{home}/lines"), store, [_number()], f"{home}/stream", ("click", "error", "purchase", "signup")).awaitTermination()
    return store


_COUNTED = f"g as (select request_id, event_id, event_type, row_number() over (partition by request_id order by cast(event_id as varchar)) as n from envelopes where {_KIND} = 'good')"


@query(
    "n24_stream_counters",
    f"with {_COUNTED}, k as (select {_KIND} as kind, count(*) as n from envelopes group by 1) select (select sum(n) from k)::bigint as lines, (select count(*) from g where n = 1) as processed, (select count(*) from g where n > 1) as duplicate, (select sum(n) from k where kind = 'other')::bigint as skipped, (select sum(n) from k where kind in ('cut', 'no key'))::bigint as failed, (select count(*) from g where n = 1 and event_id % 3 = 0) as with_warnings",
)
def _(t: Tables) -> DataFrame:
    counted = _ingested(t).snapshot().table("records_counters")
    return counted.agg(*[F.sum(c).alias(c) for c in ("lines", "processed", "duplicate", "skipped", "failed", "with_warnings")])


@query("i11_error_lines", f"select case {_KIND} when 'cut' then 'no object' else 'no key' end as reason, count(*) as n from envelopes where {_KIND} in ('cut', 'no key') group by 1")
def _(t: Tables) -> DataFrame:
    return _ingested(t).snapshot().table("records_errors").groupBy("reason").agg(F.count("*").alias("n"))
