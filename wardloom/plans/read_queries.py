"""Queries through reads with parameters, each under three settings of them, and over results that a refresh left."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.config import AS_OF
from wardloom.functions.ordered import checkpoint_dir, stored
from wardloom.operators import intel, reads, refresh
from wardloom.plans.intel_queries import RISKS, SERIES, SPOTS, risks_of, trends_of
from wardloom.plans.mesh_queries import GAPS, gaps_of
from wardloom.plans.priority_queries import RANKED, ranked_of
from wardloom.plans.registry import query
from wardloom.sources.store import Store
from wardloom.sources.testdata import Tables


def reading(name: str, read: Callable, rows: Callable[[Tables], DataFrame], columns: str, source: str, order: str, *settings: tuple[dict, str], before: str = "") -> None:
    """Registers one query: the read under each (parameters, the condition and limit in SQL), told apart by ``setting``."""
    parts = []
    for i, (_, tail) in enumerate(settings):
        condition, _, limit = tail.partition(" limit ")
        parts.append(f"select * from (select {i} as setting, {columns} from {source} where {condition} order by {order}{' limit ' + limit if limit else ''}) s{i}")

    @query(name, before + " union all ".join(parts))
    def _(t: Tables) -> DataFrame:
        table, out = rows(t), None
        for i, (given, _) in enumerate(settings):
            part = read(table, **given).select(F.lit(i).alias("setting"), *columns.split(", "))
            out = part if out is None else out.unionByName(part)
        return out


_UNDERSTOOD = "select cast(event_id as string) as request_id, event_type as category, case user_id % 3 when 0 then 'en' when 1 then 'ta' else 'hi' end as language, case when value < 1 then 'PARTIAL' else 'COMPLETE' end as status, cast(least(5, 1 + floor(value / 3)) as int) as severity, ts as created_at from {events}"
reading(
    "b1_understandings", reads.understandings, lambda t: t.spark.sql(_UNDERSTOOD, events=t.base("events")), "request_id, category, severity", f"({_UNDERSTOOD.format(events='events')}) u", "created_at desc, request_id",
    ({"category": "error", "language": "ta"}, "category = 'error' and language = 'ta'"),
    ({"min_severity": 3, "since": dt.datetime(2024, 1, 10), "limit": 40, "offset": 5}, "severity >= 3 and created_at >= timestamp '2024-01-10' limit 40 offset 5"),
    ({"category": "", "status": "PARTIAL", "limit": 500}, "status = 'PARTIAL' limit 500"),
)
reading("b2_wards", reads.wards, lambda t: t.wards, "ward_code, district, state", "wards", "ward_code", ({}, "true"), ({"state": "ASIA"}, "state = 'ASIA'"), ({"district": "NATION_7", "state": None, "limit": 2}, "district = 'NATION_7' limit 2"))
reading(
    "b3_assets", reads.assets, lambda t: t.assets, "asset_code, asset_type, status", "assets", "asset_code",
    ({"sector": "SANITATION", "status": "BROKEN"}, "asset_type in ('SEWAGE_LINE', 'DRAIN', 'WASTE_BIN', 'PUBLIC_TOILET') and status = 'BROKEN'"), ({"ward_code": "W00003"}, "ward_code = 'W00003'"), ({"sector": "HOUSING"}, "false"),
)
reading("b4_projects", reads.projects, lambda t: t.projects, "project_code, status", "projects", "project_code", ({"sector": "ROAD", "status": "DELAYED"}, "sector = 'ROAD' and status = 'DELAYED'"), ({"ward_code": "W00004", "sector": "WATER"}, "ward_code = 'W00004' and sector = 'WATER'"), ({"limit": 30}, "true limit 30"))
reading("b5_demand", reads.demand, lambda t: t.citizen_demand, "ward_code, sector, category, complaint_count", "citizen_demand", "ward_code", ({}, "true"), ({"ward_code": "W00003"}, "ward_code = 'W00003'"), ({"ward_code": "W00004", "sector": "WATER"}, "ward_code = 'W00004' and sector = 'WATER'"))
reading(
    "b6_gaps", reads.gaps, gaps_of, "ward_code, sector, gap_score, severity", "gaps", "gap_score desc, ward_code, sector",
    ({"sector": "WATER", "min_score": 50}, "sector = 'WATER' and gap_score >= 50"), ({"severity": "HIGH", "limit": 25}, "severity = 'HIGH' limit 25"), ({"ward_code": "W00003", "min_score": 0}, "ward_code = 'W00003' and gap_score >= 0"), before=f"with {GAPS} ",
)
reading(
    "b8_windows", reads.windows, lambda t: t.demand_windows.join(t.wards.select("ward_code", "district"), "ward_code"), "ward_code, sector, bucket, complaint_count", "(select d.*, w.district from demand_windows d join wards w on w.ward_code = d.ward_code) x", "bucket, ward_code, sector",
    ({"district": "NATION_7", "window_days": 30}, "district = 'NATION_7'"), ({"ward_code": "W00003", "sector": "ROAD"}, "ward_code = 'W00003' and sector = 'ROAD'"), ({"window_days": 90}, "window_days = 90"),
)
reading(
    "b8_trends", reads.trends, trends_of, "ward_code, sector, direction, pct_change", "tr", "pct_change desc, ward_code, sector, window_days",
    ({}, "true limit 50"), ({"direction": "WORSENING", "sector": "WATER", "limit": 20}, "direction = 'WORSENING' and sector = 'WATER' limit 20"), ({"ward_code": "W00003", "window_days": 30}, "ward_code = 'W00003' limit 50"), before=f"with {SERIES} ",
)
reading(
    "b8_hotspots", reads.hotspots, lambda t: intel.hotspots(t.wards, t.citizen_demand, lists=False), "cluster, tier, mean_intensity", "hs", "mean_intensity desc, cluster",
    ({}, "true limit 50"), ({"tier": "CRITICAL", "limit": 3}, "tier = 'CRITICAL' limit 3"), ({"district": "NATION_7"}, "district = 'NATION_7' limit 50"), before=f"with recursive {SPOTS} ",
)
reading(
    "b9_priorities", reads.priorities, ranked_of, "rank, cluster, band", "sc", "rank", ({}, "true"), ({"band": "low"}, "band = 'LOW'"), ({"district": "nation_7", "band": "MEDIUM"}, "district = 'NATION_7' and band = 'MEDIUM'"), before=f"with recursive {RANKED} ",
)
_RISK_ORDER = "case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 when 'LOW' then 3 else 4 end, confidence desc, risk_code"
reading(
    "b21_risks", reads.risks, lambda t: risks_of(t).withColumn("status", F.when(F.col("sector") == "ROAD", "RESOLVED").otherwise("OPEN")), "risk_code, severity, confidence", "(select *, case sector when 'ROAD' then 'RESOLVED' else 'OPEN' end as status from rk) x", _RISK_ORDER,
    ({"ward_code": "W00003", "status": "OPEN"}, "ward_code = 'W00003' and status = 'OPEN' limit 50"), ({"risk_type": "STALLED_ABSORPTION", "severity": "MEDIUM", "limit": 100}, "risk_type = 'STALLED_ABSORPTION' and severity = 'MEDIUM' limit 100"), ({"status": "RESOLVED"}, "status = 'RESOLVED' limit 50"), before=f"with {RISKS} ",
)


@query("k_trend_summary", f"with {SERIES} select 'sector' as part, sector as name, cast(count(*) filter (where direction = 'WORSENING') as double) as worsening, cast(count(*) filter (where direction = 'STABLE') as double) as stable from tr where window_days = 30 group by sector union all select * from (select 'emerging', ward_code || ':' || sector, pct_change, momentum from tr where direction = 'WORSENING' and window_days = 30 order by pct_change desc, ward_code, sector limit 10) x")
def _(t: Tables) -> DataFrame:
    s = reads.trend_summary(trends_of(t), window_days=30)
    sectors = s["sectors"].select(F.lit("sector").alias("part"), F.col("sector").alias("name"), F.col("worsening").cast("double"), F.col("stable").cast("double"))
    return sectors.unionByName(s["emerging"].select(F.lit("emerging").alias("part"), F.concat_ws(":", "ward_code", "sector").alias("name"), F.col("pct_change").alias("worsening"), F.col("momentum").alias("stable")))


@query("k_risk_summary", f"with {RISKS}, m as (select ward_code, sector from rk group by 1, 2 having count(distinct risk_type) > 1) select count(*) as total, count(*) filter (where sector <> 'ROAD') as open, count(*) filter (where risk_type = 'STALLED_ABSORPTION') as stalled_absorption, count(*) filter (where severity = 'CRITICAL') as critical, count(*) filter (where (ward_code, sector) in (select (ward_code, sector) from m)) as confirmatory from rk")
def _(t: Tables) -> DataFrame:
    status = F.when(F.col("sector") == "ROAD", "RESOLVED").otherwise("OPEN")
    return reads.risk_summary(risks_of(t).withColumn("status", status)).select("total", "open", "stalled_absorption", "critical", "confirmatory")


@query("d34_gap_run", f"with {GAPS} select 'total' as name, cast(count(*) as double) as value from gaps union all select 'high', count(*) filter (where severity = 'HIGH') from gaps union all select 'sectors', count(distinct sector) from gaps union all select * from (select ward_code || ':' || sector, gap_score from gaps order by gap_score desc, ward_code, sector limit 20) x")
def _(t: Tables) -> DataFrame:
    counts, top = reads.gap_run_summary(gaps_of(t))
    named = counts.select(F.explode(F.create_map(*[x for c in ("total", "high", "sectors") for x in (F.lit(c), F.col(c).cast("double"))])).alias("name", "value"))
    return named.unionByName(top.select(F.concat_ws(":", "ward_code", "sector").alias("name"), F.col("gap_score").alias("value")))


def _refreshed(t: Tables) -> Store:
    """A store that took in tables in which wards stood elsewhere or were absent and demand was higher, then the given tables, then these again."""
    s = Store(t.spark, f"{checkpoint_dir(t.spark)}/store-{uuid.uuid4().hex}")
    given = {"wards": t.wards, "citizen_demand": t.citizen_demand, "demand_windows": t.demand_windows, "gaps": gaps_of(t), "projects": t.projects}
    # a refresh reads its tables several times over; they are made from the test tables once, as those of a platform stand already
    now = {name: stored(rows) for name, rows in given.items()}
    wards = now["wards"].where("ward_code not like '%7'").withColumn("latitude", F.col("latitude") + F.when(F.col("ward_code").like("%3"), 0.2).otherwise(0.0))
    demand = now["citizen_demand"].withColumn("complaint_count", F.col("complaint_count") + F.when(F.col("ward_code").like("%5"), 1).otherwise(0))
    for tables in (now | {"wards": wards, "citizen_demand": demand}, now, now):
        refresh.refresh(s, tables, AS_OF)
    return s


@query("n18_refreshed_hotspots", f"with recursive {SPOTS} select cluster, district, cast(complaints as bigint) as complaints, wards, mean_intensity, z, tier from hs")
def _(t: Tables) -> DataFrame:
    return refresh.hotspots(_refreshed(t).snapshot()).select("cluster", "district", "complaints", "wards", "mean_intensity", "z", "tier")


@query("n18_refreshed_risks", f"with {RISKS} select risk_code, severity, confidence, 'OPEN' as status from rk")
def _(t: Tables) -> DataFrame:
    return refresh.risks(_refreshed(t).snapshot()).select("risk_code", "severity", "confidence", "status")


@query("n18_runs", "with u as (select ward_code from wards union select ward_code from citizen_demand union select ward_code from demand_windows union select ward_code from projects), c as (select count(*) as n from u where (ward_code in (select ward_code from wards) and (ward_code like '%7' or ward_code like '%3')) or (ward_code in (select ward_code from citizen_demand) and ward_code like '%5')), n as (select count(*) as n from u) select cast(0 as bigint) as run_id, 'OK' as status, n as wards, n as changed_wards from n union all select 1, 'OK', n.n, c.n from n, c union all select 2, 'OK', n, 0 from n")
def _(t: Tables) -> DataFrame:
    return _refreshed(t).snapshot().table("runs").select("run_id", "status", "wards", "changed_wards")
