"""Queries of trends, risks, hotspots and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardloom.config import AS_OF
from wardloom.functions.ordered import stored
from wardloom.operators import intel
from wardloom.plans.mesh_queries import ELAPSED, GAPS, gaps_of
from wardloom.plans.registry import query
from wardloom.sources.testdata import Tables
from wardloom.vocab import DIRECTIONS, RISK_TYPES, TIERS, one_column

SERIES = """o as (select *, row_number() over (partition by ward_code, sector, window_days order by bucket) - 1 as i, complaint_count - lag(complaint_count) over (partition by ward_code, sector, window_days order by bucket) as step from demand_windows),
t0 as (select ward_code, sector, window_days, arg_min(complaint_count, i) as first_count, arg_max(complaint_count, i) as last_count, count(*) as sample_count, round(coalesce(regr_slope(complaint_count, i), 0), 6) as slope,
  cast(coalesce(arg_max(step, i), 0) as double) as momentum, round(coalesce(stddev_pop(complaint_count), 0), 4) as volatility, string_agg(cast(complaint_count as varchar), ',' order by i) as series from o group by ward_code, sector, window_days),
t1 as (select *, case when sample_count < 2 then 0.0 when first_count = 0 then case when last_count > 0 then 100.0 else 0.0 end else round((last_count - first_count) / cast(first_count as double) * 100, 2) end as pct_change from t0),
tr as (select *, case when sample_count < 2 then 'UNKNOWN' when pct_change >= 10 and slope > 0 then 'WORSENING' when pct_change <= -10 and slope < 0 then 'IMPROVING' else 'STABLE' end as direction from t1)"""
PAIRS = "lt as (select ward_code, sector, window_days, max(case when n = 1 then complaint_count end) as recent, max(case when n = 2 then complaint_count end) as previous from (select *, row_number() over (partition by ward_code, sector, window_days order by bucket desc) as n from demand_windows) x where n <= 2 group by 1, 2, 3 having max(case when n = 2 then complaint_count end) is not null)"
MONEY = "am as (select ward_code, sector, count(*) as active, sum(budget_lakhs) as committed, sum(spent_lakhs) as spent from projects where status in ('PLANNED', 'IN_PROGRESS', 'DELAYED') group by 1, 2)"
RISKS = f"""{GAPS}, {PAIRS}, {MONEY}, pc as (select *, case when previous = 0 then case when recent > 0 then 100.0 else 0.0 end else round((recent - previous) / cast(previous as double) * 100, 2) end as change, recent / cast(previous as double) as ratio from lt),
rk as (select 'SPIKE' as risk_type, 'SPIKE:' || ward_code || ':' || sector as risk_code, ward_code, sector, case when ratio >= 6 then 'CRITICAL' when ratio >= 4 then 'HIGH' else 'MEDIUM' end as severity, round(least(0.95, 0.6 + 0.1 * least(ratio / 2 - 1, 1.0)), 4) as confidence from pc where recent >= 10 and previous > 0 and ratio >= 2
union all select 'NEW_CATEGORY', 'NEW_CATEGORY:' || ward_code || ':' || sector, ward_code, sector, 'MEDIUM', 0.5 from pc where previous <= 0 and recent >= 3
union all select 'DETERIORATING_WITH_SPEND', 'DETERIORATING_WITH_SPEND:' || p.ward_code || ':' || p.sector, p.ward_code, p.sector, case when spent / committed < 0.35 then 'CRITICAL' when change >= 30 then 'HIGH' else 'MEDIUM' end, 0.75 from pc p join am a on a.ward_code = p.ward_code and a.sector = p.sector where change >= 10 and recent > previous
union all select 'STALLED_ABSORPTION', 'STALLED_ABSORPTION:' || ward_code || ':' || sector || ':' || project_code, ward_code, sector, case when budget_lakhs - spent_lakhs > 500 then 'HIGH' else 'MEDIUM' end, 0.8 from projects where status in ('PLANNED', 'IN_PROGRESS', 'DELAYED') and {ELAPSED} >= 0.5 and budget_lakhs > 0 and spent_lakhs / budget_lakhs < 0.35
union all select 'CRITICAL_CONCENTRATION', 'CRITICAL_CONCENTRATION:' || p.ward_code || ':' || p.sector, p.ward_code, p.sector, 'CRITICAL', 0.7 from pc p join gaps g on g.ward_code = p.ward_code and g.sector = p.sector where g.severity = 'CRITICAL' and recent > previous)"""
HAV = "2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))"
SPOTS = f"""e as (select a.ward_code as a, b.ward_code as b from wards a join wards b on a.ward_code <> b.ward_code where {HAV} <= 12000),
r as (select ward_code as a, ward_code as b from wards union select r.a, e.b from r join e on r.b = e.a),
cl as (select a as ward_code, min(b) as cluster from r group by a),
ws as (select w.*, coalesce(d.complaints, 0) as complaints, coalesce(d.critical, 0) as critical, coalesce(d.peak, 0) as peak_severity, round(coalesce(d.complaints, 0) / (greatest(population, 1) / 1000.0), 4) as intensity from wards w left join (select ward_code, sum(complaint_count) as complaints, sum(critical_count) as critical, max(avg_severity) as peak from citizen_demand group by 1) d on d.ward_code = w.ward_code),
sp as (select avg(intensity) as mean, stddev_pop(intensity) as dev from ws),
h0 as (select cl.cluster, arg_min(district, ws.ward_code) as district, avg(latitude) as latitude, avg(longitude) as longitude, string_agg(ws.ward_code, ',' order by ws.ward_code) as ward_codes, sum(population) as population, sum(complaints) as complaints, sum(critical) as critical, max(intensity) as peak_intensity, round(max(peak_severity), 4) as peak_severity, count(*) as wards from ws join cl on cl.ward_code = ws.ward_code group by cl.cluster having sum(complaints) >= 1),
h1 as (select *, round(complaints / (greatest(population, 1) / 1000.0), 4) as mean_intensity, round((complaints / (greatest(population, 1) / 1000.0) - (select mean from sp)) / (select dev from sp), 4) as z from h0),
h2 as (select *, round(cume_dist() over (order by mean_intensity), 4) as rank_fraction from h1),
hs as (select *, case when rank_fraction >= 0.9 then 'CRITICAL' when rank_fraction >= 0.75 then 'HIGH' when rank_fraction >= 0.5 then 'MODERATE' else 'NORMAL' end as tier from h2)"""


def trends_of(t: Tables) -> DataFrame:
    return intel.trends(t.demand_windows)


def risks_of(t: Tables) -> DataFrame:
    return intel.risks(t.demand_windows, t.projects, gaps_of(t), AS_OF)


def hotspots_of(t: Tables, lists: bool = True) -> DataFrame:
    return intel.hotspots(t.wards, stored(t.citizen_demand), lists=lists)


@query("d24_trends", f"with {SERIES} select ward_code, sector, window_days, first_count, last_count, sample_count, slope, momentum, volatility, series, pct_change, direction from tr")
def _(t: Tables) -> DataFrame:
    return trends_of(t)


@query("d25_sector_direction_matrix", f"with {SERIES} select sector, count(*) filter (where direction = 'WORSENING') as worsening, count(*) filter (where direction = 'IMPROVING') as improving, count(*) filter (where direction = 'STABLE') as stable, count(*) filter (where direction = 'UNKNOWN') as unknown from tr group by sector")
def _(t: Tables) -> DataFrame:
    out = trends_of(t).groupBy("sector").pivot("direction", list(DIRECTIONS)).count()
    return out.select("sector", *[F.coalesce(d, F.lit(0)).alias(d.lower()) for d in DIRECTIONS])


@query("d26_average_slope", f"with {SERIES} select round(avg(slope), 6) as slope from tr")
def _(t: Tables) -> DataFrame:
    return trends_of(t).agg(F.round(F.avg("slope"), 6).alias("slope"))


@query("f3_trends_in_order", f"with {SERIES} select ward_code, sector, direction, pct_change from tr order by case direction when 'WORSENING' then 0 when 'IMPROVING' then 1 when 'STABLE' then 2 else 3 end, pct_change desc, ward_code, sector")
def _(t: Tables) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, DIRECTIONS)), F.col("direction"))
    return trends_of(t).orderBy(rank, F.desc("pct_change"), "ward_code", "sector").select("ward_code", "sector", "direction", "pct_change")


@query("f4_emerging_top", f"with {SERIES} select ward_code, sector, momentum, pct_change from tr where direction = 'WORSENING' order by momentum desc, pct_change desc, ward_code, sector limit 10")
def _(t: Tables) -> DataFrame:
    return trends_of(t).where("direction = 'WORSENING'").orderBy(F.desc("momentum"), F.desc("pct_change"), "ward_code", "sector").limit(10).select("ward_code", "sector", "momentum", "pct_change")


@query("e2_last_two_windows", f"with {PAIRS} select ward_code, sector, window_days, recent, previous from lt")
def _(t: Tables) -> DataFrame:
    return intel.last_two(t.demand_windows)


@query("h29_risks", f"with {RISKS} select * from rk")
def _(t: Tables) -> DataFrame:
    return risks_of(t)


@query("h29a_spikes", f"with {RISKS} select * from rk where risk_type = 'SPIKE'")
def _(t: Tables) -> DataFrame:
    return intel.spikes(intel.last_two(t.demand_windows))


@query("h29c_deteriorating", f"with {RISKS} select * from rk where risk_type = 'DETERIORATING_WITH_SPEND'")
def _(t: Tables) -> DataFrame:
    return intel.deteriorating(intel.last_two(t.demand_windows), t.projects)


@query("h29d_stalled_absorption", f"with {RISKS} select * from rk where risk_type = 'STALLED_ABSORPTION'")
def _(t: Tables) -> DataFrame:
    return intel.stalled_absorption(t.projects, AS_OF)


@query("d27_confirmatory", f"with {RISKS}, m as (select ward_code, sector from rk group by 1, 2 having count(distinct risk_type) > 1) select rk.* from rk join m on m.ward_code = rk.ward_code and m.sector = rk.sector")
def _(t: Tables) -> DataFrame:
    return intel.confirmatory(risks_of(t))


@query("d6_risks_by_type", f"with {RISKS}, e as (select unnest(['SPIKE', 'NEW_CATEGORY', 'DETERIORATING_WITH_SPEND', 'STALLED_ABSORPTION', 'CRITICAL_CONCENTRATION']) as risk_type) select e.risk_type, count(rk.risk_type) as n from e left join rk on rk.risk_type = e.risk_type group by 1")
def _(t: Tables) -> DataFrame:
    counts = risks_of(t).groupBy("risk_type").agg(F.count("*").alias("n"))
    return one_column(t.spark, "risk_type", RISK_TYPES).join(counts, "risk_type", "left").select("risk_type", F.coalesce("n", F.lit(0)).alias("n"))


@query("f5_risks_in_order", f"with {RISKS} select risk_code, severity, confidence from rk order by case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end, confidence desc, risk_code")
def _(t: Tables) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM", "LOW"))), F.col("severity"))
    return risks_of(t).orderBy(rank, F.desc("confidence"), "risk_code").select("risk_code", "severity", "confidence")


@query("d28_active_money", f"with {MONEY} select ward_code, sector, active, round(committed, 6) as committed, round(spent, 6) as spent from am")
def _(t: Tables) -> DataFrame:
    return intel.active_money(t.projects).withColumns({c: F.round(c, 6) for c in ("committed", "spent")})


@query("c5_near_wards", f"select a.ward_code as a, b.ward_code as b, round({HAV}, 2) as metres from wards a join wards b on a.ward_code < b.ward_code where {HAV} <= 12000")
def _(t: Tables) -> DataFrame:
    return intel.near_pairs(t.wards).withColumn("metres", F.round("metres", 2))


@query("c6_ward_clusters", f"with recursive {SPOTS} select ward_code, cluster from cl")
def _(t: Tables) -> DataFrame:
    return intel.near_clusters(t.wards)


@query("d17_ward_signals", f"with recursive {SPOTS} select ward_code, cast(complaints as bigint) as complaints, cast(critical as bigint) as critical, round(peak_severity, 6) as peak_severity, intensity from ws")
def _(t: Tables) -> DataFrame:
    return intel.ward_signals(t.wards, t.citizen_demand).select("ward_code", "complaints", "critical", F.round("peak_severity", 6).alias("peak_severity"), "intensity")


@query("d18_hotspots", f"with recursive {SPOTS} select cluster, district, round(latitude, 6) as latitude, round(longitude, 6) as longitude, ward_codes, cast(population as bigint) as population, cast(complaints as bigint) as complaints, cast(critical as bigint) as critical, peak_intensity, peak_severity, wards, mean_intensity, z, tier from hs")
def _(t: Tables) -> DataFrame:
    out = hotspots_of(t)
    return out.select("cluster", "district", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "ward_codes", "population", "complaints", "critical", "peak_intensity", "peak_severity", "wards", "mean_intensity", "z", "tier")


@query("e5_rank_fraction", f"with recursive {SPOTS} select cluster, rank_fraction from hs")
def _(t: Tables) -> DataFrame:
    return hotspots_of(t, lists=False).select("cluster", "rank_fraction")


@query("d6_tier_counts", f"with recursive {SPOTS}, tt as (select unnest(['CRITICAL', 'HIGH', 'MODERATE', 'NORMAL']) as tier) select tt.tier, count(hs.tier) as n from tt left join hs on hs.tier = tt.tier group by 1")
def _(t: Tables) -> DataFrame:
    counts = hotspots_of(t, lists=False).groupBy("tier").agg(F.count("*").alias("n"))
    return one_column(t.spark, "tier", TIERS).join(counts, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


@query("d19_district_rollup", f"with recursive {SPOTS} select district, count(*) as hotspots, cast(sum(complaints) as bigint) as complaints, round(sum(complaints) / sum(sum(complaints)) over (), 6) as share, max(mean_intensity) as worst from hs group by district")
def _(t: Tables) -> DataFrame:
    out = hotspots_of(t, lists=False).groupBy("district").agg(F.count("*").alias("hotspots"), F.sum("complaints").alias("complaints"), F.max("mean_intensity").alias("worst"))
    return out.withColumn("share", F.round(F.col("complaints") / F.sum("complaints").over(Window.partitionBy()), 6))


@query("d20_coverage_note", f"with recursive {SPOTS} select round(sum(case when complaints > 0 then population else 0 end) / cast(sum(population) as double), 6) as covered, round(median(intensity), 6) as median_intensity from ws")
def _(t: Tables) -> DataFrame:
    rows = intel.ward_signals(t.wards, t.citizen_demand)
    return rows.agg(F.round(F.sum(F.when(F.col("complaints") > 0, F.col("population")).otherwise(0)) / F.sum("population"), 6).alias("covered"), F.round(F.median("intensity"), 6).alias("median_intensity"))


@query("d21_percentiles", "select sector, round(median(budget_lakhs), 6) as p50, round(quantile_cont(budget_lakhs, 0.9), 6) as p90 from projects group by sector")
def _(t: Tables) -> DataFrame:
    return t.projects.groupBy("sector").agg(F.round(F.median("budget_lakhs"), 6).alias("p50"), F.round(F.percentile("budget_lakhs", 0.9), 6).alias("p90"))


@query("d22_variance", "select sector, round(var_pop(delay_days), 6) as variance, round(stddev_pop(delay_days), 6) as deviation from projects group by sector")
def _(t: Tables) -> DataFrame:
    return t.projects.groupBy("sector").agg(F.round(F.var_pop("delay_days"), 6).alias("variance"), F.round(F.stddev_pop("delay_days"), 6).alias("deviation"))


POINTS = "pt as (select c_custkey as point_id, 9.9 + cast((c_custkey * 31337) % 10007 as double) / 10007 * 1.4 as lat, 77.9 + cast((c_custkey * 7741) % 10007 as double) / 10007 * 1.4 as lon from customer)"
NEAREST = "2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(w.latitude - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(w.latitude)) * pow(sin(radians(w.longitude - p.lon) / 2), 2))))"


@query("c3_c4_assign_to_ward", f"with {POINTS}, bx as (select p.point_id, min(w.ward_code) as in_box from pt p join wards w on abs(p.lat - w.latitude) <= 0.025 and abs(p.lon - w.longitude) <= 0.025 group by 1), nr as (select p.point_id, w.ward_code, row_number() over (partition by p.point_id order by {NEAREST}, w.ward_code) as n from pt p join wards w on {NEAREST} <= 25000) select p.point_id, coalesce(in_box, nr.ward_code) as ward_code, case when in_box is not null then 'BOX' when nr.ward_code is not null then 'NEAREST' else 'NONE' end as method from pt p left join bx on bx.point_id = p.point_id left join nr on nr.point_id = p.point_id and nr.n = 1")
def _(t: Tables) -> DataFrame:
    place = lambda k, start: F.lit(start) + (F.col("c_custkey") * k % 10007).cast("double") / 10007 * 1.4
    points = t.base("customer").select(F.col("c_custkey").alias("point_id"), place(31337, 9.9).alias("lat"), place(7741, 77.9).alias("lon"))
    return intel.assign_to_ward(points, t.wards)


# ---- snapshots -------------------------------------------------------------
@query("c14_latest_demand_with_ties", "select ward_code, sector, bucket, complaint_count from (select *, rank() over (partition by ward_code, sector, window_days order by bucket desc) as r from demand_windows) x where r = 1")
def _(t: Tables) -> DataFrame:
    return intel.latest(t.demand_windows, ["ward_code", "sector", "window_days"], "bucket", ties=True).select("ward_code", "sector", "bucket", "complaint_count")


@query("c16_latest_by_correlated_maximum", "select d.ward_code, d.sector, d.complaint_count from demand_windows d where d.bucket = (select max(bucket) from demand_windows x where x.ward_code = d.ward_code and x.sector = d.sector)")
def _(t: Tables) -> DataFrame:
    return t.spark.sql("select d.ward_code, d.sector, d.complaint_count from {d} d where d.bucket = (select max(bucket) from {d} x where x.ward_code = d.ward_code and x.sector = d.sector)", d=t.demand_windows)


@query("c17_latest_project", "select ward_code, project_code from (select *, row_number() over (partition by ward_code, sector order by sanctioned_on desc, project_code) as r from projects) x where r = 1")
def _(t: Tables) -> DataFrame:
    return intel.latest(t.projects.select("ward_code", "sector", "sanctioned_on", "project_code"), ["ward_code", "sector"], "sanctioned_on", ties=False).select("ward_code", "project_code")


@query("a16_insert_if_absent", "select ward_code, sector, bucket, complaint_count from demand_windows where bucket < 20 union all select ward_code, sector, bucket, complaint_count from demand_windows d where bucket >= 10 and not exists (select 1 from demand_windows o where o.bucket < 20 and o.ward_code = d.ward_code and o.sector = d.sector and o.bucket = d.bucket)")
def _(t: Tables) -> DataFrame:
    rows = t.demand_windows.select("ward_code", "sector", "bucket", "complaint_count")
    return intel.insert_if_absent(rows.where("bucket < 20"), rows.where("bucket >= 10"), ["ward_code", "sector", "bucket"])


@query("a17_insert_if_changed", "select project_code, case when delay_days % 3 = 0 then 'DELAYED' else status end as status, round(budget_lakhs, 6) as budget_lakhs from projects where delay_days % 3 = 0 and status <> 'DELAYED'")
def _(t: Tables) -> DataFrame:
    old = t.projects.select("project_code", "status", F.round("budget_lakhs", 6).alias("budget_lakhs"), F.lit(1).alias("at"), "delay_days")
    new = old.withColumn("status", F.when(F.col("delay_days") % 3 == 0, "DELAYED").otherwise(F.col("status"))).withColumn("at", F.lit(2))
    return intel.insert_if_changed(old, new, ["project_code"], ["status", "budget_lakhs"], "at").select("project_code", "status", "budget_lakhs")


@query("a15_upsert_keeping_status", "select p_partkey as k, case when p_partkey % 2 = 0 then 'new' else 'old' end as v, case when p_partkey % 3 = 0 or p_partkey % 2 <> 0 then 'reviewed' else 'open' end as status from part where p_partkey % 2 = 0 or p_partkey % 3 = 0")
def _(t: Tables) -> DataFrame:
    part = t.base("part").select(F.col("p_partkey").alias("k"))
    old = part.where("k % 3 = 0").select("k", F.lit("old").alias("v"), F.lit("reviewed").alias("status"))
    new = part.where("k % 2 = 0").select("k", F.lit("new").alias("v"), F.lit("open").alias("status"))
    return intel.upsert(old, new, ["k"], ["status"])


@query("c21_district_scoping", "select p.project_code from projects p where p.ward_code in (select ward_code from wards where district = 'NATION_3')")
def _(t: Tables) -> DataFrame:
    return t.projects.join(t.wards.where("district = 'NATION_3'"), "ward_code", "left_semi").select("project_code")


@query("c20_anti_join", "select ward_code from wards w where not exists (select 1 from projects p where p.ward_code = w.ward_code and p.status = 'DELAYED' and p.budget_lakhs > 390)")
def _(t: Tables) -> DataFrame:
    return t.wards.join(t.projects.where("status = 'DELAYED' and budget_lakhs > 390"), "ward_code", "left_anti").select("ward_code")


@query("c22_project_districts", "select p.project_code, w.district from projects p left join wards w on w.ward_code = p.ward_code")
def _(t: Tables) -> DataFrame:
    return t.projects.join(t.wards.select("ward_code", "district"), "ward_code", "left").select("project_code", "district")
