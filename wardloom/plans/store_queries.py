"""Queries over tables that are committed, merged and read at a version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.functions.ordered import checkpoint_dir
from wardloom.plans.registry import query
from wardloom.sources import outbox
from wardloom.sources.mesh import profiles, read_mesh
from wardloom.sources.store import Store
from wardloom.sources.testdata import Tables


def _store(t: Tables) -> Store:
    return Store(t.spark, f"{checkpoint_dir(t.spark)}/store-{uuid.uuid4().hex}")


def _arrivals(t: Tables) -> list[DataFrame]:
    """Envelopes in two batches, so that many a replay comes in the second."""
    rows = t.envelopes.select("request_id", "event_id", F.col("event_type").alias("payload"), "user_id")
    return [rows.where(f"event_id % 2 = {i}") for i in (0, 1)]


def _merged(t: Tables, policy: str) -> Store:
    """Both batches merged, each delivered twice."""
    s = _store(t)
    for n, rows in enumerate(_arrivals(t)):
        for _ in range(2):
            s.merge("records", rows, ["request_id"], "intake", n, policy, ["event_id"], ["event_id"])
    return s


_REPLAYS = """
r as (select request_id, event_id, event_type as payload, row_number() over (partition by request_id order by event_id % 2, event_id) as n, row_number() over (partition by request_id, event_id % 2 order by event_id) as m, event_id % 2 as batch from envelopes),
f as (select * from r where n = 1), l as (select request_id, max_by(event_id, batch) as event_id, max_by(payload, batch) as payload, min(batch) as batch, count(*) as batches from r where m = 1 group by 1)"""


@query("i3_skipped_replays", f"with {_REPLAYS} select request_id, event_id, payload from f")
def _(t: Tables) -> DataFrame:
    return _merged(t, "skip").snapshot().table("records").select("request_id", "event_id", "payload")


@query("i3_refreshed_replays", f"with {_REPLAYS} select f.request_id, l.event_id, f.payload from f join l on l.request_id = f.request_id")
def _(t: Tables) -> DataFrame:
    return _merged(t, "refresh").snapshot().table("records").select("request_id", "event_id", "payload")


@query("n3_overwritten_replays", f"with {_REPLAYS} select request_id, event_id, payload from l")
def _(t: Tables) -> DataFrame:
    return _merged(t, "overwrite").snapshot().table("records").select("request_id", "event_id", "payload")


@query("n24_batch_counters", f"with {_REPLAYS}, k as (select request_id, batch, count(*) - 1 as repeats from r group by 1, 2) select k.batch, count(*) filter (where k.batch = l.batch) as processed, count(*) filter (where k.batch <> l.batch) as known, cast(sum(repeats) as bigint) as repeats from k join l on l.request_id = k.request_id group by 1")
def _(t: Tables) -> DataFrame:
    return _merged(t, "skip").counters("records").select("batch", "processed", "known", "repeats")


@query("i12_outbox_replay", "select user_id % 10 as user_group, count(*) as published, cast(0 as bigint) as doubled, count(*) filter (where event_type = 'error') as failed from (select request_id, min_by(user_id, event_id) as user_id, min_by(event_type, event_id) as event_type from envelopes group by request_id) x group by 1")
def _(t: Tables) -> DataFrame:
    """Events are enqueued with their records; a run fails after sending and is finished by the next; errors fail at first and are retried."""
    s, sent = _store(t), f"{checkpoint_dir(t.spark)}/sent-{uuid.uuid4().hex}"
    events = lambda new: new.select("event_id", "request_id", "payload", "user_id", F.col("event_id").alias("created_at"))
    rows = t.envelopes.select("request_id", "event_id", F.col("event_type").alias("payload"), "user_id")
    s.merge("records", rows, ["request_id"], "intake", 0, "skip", ["event_id"], with_new={outbox.OUTBOX: (events, ["event_id"])})
    send = outbox.to_files(sent, "payload <> 'error'")

    def broken(df: DataFrame, claim: int) -> DataFrame:
        send(df, claim)
        raise InterruptedError

    try:
        outbox.dispatch(s, broken)
    except InterruptedError:
        outbox.dispatch(s, send)
    outbox.dispatch(s, outbox.to_files(sent))
    published = t.spark.read.json(sent).groupBy("event_id").agg(F.count("*").alias("n"))
    found = outbox.status(s).where("status = 'PUBLISHED'").join(published, "event_id")
    return found.groupBy((F.col("user_id") % 10).alias("user_group")).agg(F.count("*").alias("published"), F.count_if(F.col("n") > 1).alias("doubled"), F.count_if(F.col("attempts") > 1).alias("failed"))


def _mesh_store(t: Tables) -> Store:
    """A version with the wards, demand and projects, and a later one that moves all wards to another district; there are no gaps."""
    s = _store(t)
    s.commit("sync", 0, {"wards": (t.wards, ["ward_code"]), "citizen_demand": (t.citizen_demand, []), "projects": (t.projects, ["project_code"])})
    s.commit("sync", 1, {"wards": (t.wards.withColumn("district", F.lit("ELSEWHERE")), ["ward_code"])})
    return s


_PROFILE = "select w.ward_code, w.district, coalesce(d.complaints, 0) as complaints, cast(null as double) as worst_gap, coalesce(p.projects, 0) as projects, coalesce(p.stalled, 0) as stalled from wards w left join (select ward_code, cast(sum(complaint_count) as bigint) as complaints from citizen_demand group by 1) d on d.ward_code = w.ward_code left join (select ward_code, count(*) as projects, count(*) filter (where status in ('DELAYED', 'STALLED')) as stalled from projects group by 1) p on p.ward_code = w.ward_code"


@query("a13_pinned_profiles", f"{_PROFILE} where w.district in ('NATION_2', 'NATION_16', 'ATLANTIS')")
def _(t: Tables) -> DataFrame:
    return profiles(read_mesh(_mesh_store(t).snapshot(1), ["NATION_2", "NATION_16", "ATLANTIS"]))


@query("a11_newest_mesh", "select 'wards' as \"table\", count(*) as rows, 2 as version, 'demand_windows,gaps' as missing, 'trend,coverage' as degraded from wards union all select 'citizen_demand', count(*), 2, 'demand_windows,gaps', 'trend,coverage' from citizen_demand union all select 'projects', count(*), 2, 'demand_windows,gaps', 'trend,coverage' from projects p join wards w on w.ward_code = p.ward_code")
def _(t: Tables) -> DataFrame:
    mesh = read_mesh(_mesh_store(t).snapshot(), ["ELSEWHERE"])
    return mesh.counts().withColumns({"version": F.lit(mesh.version), "missing": F.lit(",".join(mesh.missing)), "degraded": F.lit(",".join(mesh.degraded))})
