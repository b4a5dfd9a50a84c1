"""Queries over wards, demand, assets and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.config import AS_OF
from wardloom.functions.columns import clamp, haversine_m, normalise_0_100, percent_change, safe_div
from wardloom.operators import mesh
from wardloom.plans.registry import query
from wardloom.sources.testdata import Tables
from wardloom.vocab import CADENCE, PROJECT_STATUSES, SECTORS, one_column, sector_assets

YEAR = 2000
ASSET_SECTOR = "case when asset_type in ('WATER_SUPPLY', 'BOREWELL') then 'WATER' when asset_type in ('TRANSFORMER', 'ELECTRICITY_POLE') then 'ELECTRICITY' when asset_type = 'ROAD' then 'ROAD' when asset_type in ('SEWAGE_LINE', 'DRAIN', 'WASTE_BIN', 'PUBLIC_TOILET') then 'SANITATION' when asset_type = 'HEALTH_CLINIC' then 'HEALTHCARE' when asset_type = 'SCHOOL' then 'EDUCATION' when asset_type = 'BUS_STOP' then 'TRANSPORT' when asset_type = 'WIFI_HOTSPOT' then 'DIGITAL_CONNECTIVITY' end"
PER_UNIT = "case asset_type when 'WATER_SUPPLY' then 1500 when 'BOREWELL' then 800 when 'ELECTRICITY_POLE' then 250 when 'TRANSFORMER' then 1200 when 'STREET_LIGHT' then 400 when 'ROAD' then 0 when 'DRAIN' then 900 when 'SEWAGE_LINE' then 2500 when 'WASTE_BIN' then 300 when 'HEALTH_CLINIC' then 5000 when 'SCHOOL' then 1200 when 'BUS_STOP' then 800 when 'PUBLIC_TOILET' then 600 when 'WIFI_HOTSPOT' then 700 end"
FACTOR = "case status when 'FUNCTIONAL' then 1.0 when 'PARTIAL' then 0.5 when 'UNDER_REPAIR' then 0.25 else 0.0 end"
GRADE = "case grade when 'GOOD' then 0 when 'FAIR' then 1 when 'POOR' then 2 else 3 end"

PROVISION = f"""prov as (select ward_code, sector, count(*) as asset_count, count(*) filter (where status = 'FUNCTIONAL') as functional_count,
  count(*) filter (where grade in ('POOR', 'CRITICAL') or status <> 'FUNCTIONAL' or greatest(0, {YEAR} - installed_year) >= 12) as degraded_count,
  sum(per_unit * greatest(1, capacity_units) * factor) as served_population,
  0.5 * (1 - avg(g / 3.0)) + 0.3 * (1 - least(1, greatest(0, max(greatest(0, {YEAR} - installed_year)) / 24.0))) + 0.2 * (1 - avg(case when status = 'BROKEN' then 1.0 else 0.0 end)) as quality_index,
  avg(greatest(0, {YEAR} - installed_year)) as mean_age_years,
  coalesce(string_agg(case when status = 'BROKEN' then asset_code end, ',' order by asset_code), '') as broken_assets
  from (select *, {ASSET_SECTOR} as sector, {PER_UNIT} as per_unit, cast({FACTOR} as double) as factor, cast({GRADE} as double) as g from assets) a where sector is not null group by ward_code, sector)"""
DEMAND = "dem as (select ward_code, sector, sum(complaint_count) as complaints, coalesce(avg(case when complaint_count > 0 then avg_severity end), 0) as avg_severity, sum(critical_count) as critical from citizen_demand group by ward_code, sector), ref as (select sector, max(complaints) as reference from dem group by sector)"
TOTALS = "tot as (select ward_code, sector, sum(budget_lakhs) as committed, sum(spent_lakhs) as spent, count(*) filter (where status in ('PLANNED', 'IN_PROGRESS', 'DELAYED')) as active_projects from projects where status <> 'CANCELLED' group by ward_code, sector)"
GAPS = f"""{PROVISION}, {DEMAND}, {TOTALS},
sec as (select unnest(['WATER', 'ELECTRICITY', 'ROAD', 'SANITATION', 'HEALTHCARE', 'EDUCATION', 'TRANSPORT', 'DIGITAL_CONNECTIVITY']) as sector),
g0 as (select w.ward_code, w.district, w.population, s.sector, coalesce(d.complaints, 0) as complaints, coalesce(d.avg_severity, 0) as avg_severity, coalesce(d.critical, 0) as critical, coalesce(p.asset_count, 0) as asset_count, coalesce(p.functional_count, 0) as functional_count,
  coalesce(p.served_population, 0) / w.population as coverage_ratio, coalesce(p.quality_index, 1) as quality_index, coalesce(t.active_projects, 0) as active_projects, coalesce(t.committed, 0) as committed, r.reference
  from wards w cross join sec s left join dem d on d.ward_code = w.ward_code and d.sector = s.sector left join prov p on p.ward_code = w.ward_code and p.sector = s.sector left join tot t on t.ward_code = w.ward_code and t.sector = s.sector left join ref r on r.sector = s.sector),
g1 as (select *, case when complaints <= 0 then 0 else least(1, 0.6 * least(1, complaints / cast(reference as double)) + 0.4 * least(1, greatest(0, (avg_severity - 1) / 4))) end as demand_score,
  case when sector = 'ROAD' or coverage_ratio >= 1 then 0 else 1 - coverage_ratio end as absence_score from g0),
g2 as (select *, round(least(100, greatest(0, 100 * (0.4 * demand_score + 0.35 * absence_score + 0.25 * (1 - quality_index)))), 6) as gap_score from g1),
gaps as (select *, case when gap_score >= 75 then 'CRITICAL' when gap_score >= 55 then 'HIGH' when gap_score >= 35 then 'MODERATE' else 'LOW' end as severity,
  case when asset_count = 0 then 'BUILD_INFRASTRUCTURE' when critical > 0 and functional_count < asset_count then 'URGENT_REPAIR' when coverage_ratio < 1 then 'EXPAND_CAPACITY' when gap_score >= 55 then 'ACCELERATE_PROJECTS' when gap_score >= 35 then 'IMPROVE_QUALITY' else 'MONITOR' end as recommended_action from g2)"""
LATE = "(status not in ('COMPLETED', 'CANCELLED') and date '2000-01-01' > sanctioned_on + planned_days)"
ELAPSED = "least(1.0, greatest(0.0, date_diff('day', sanctioned_on, date '2000-01-01') / cast(planned_days as double)))"
STALLED = f"(status not in ('COMPLETED', 'CANCELLED') and budget_lakhs > 0 and spent_lakhs / budget_lakhs < 0.35 and {ELAPSED} >= 0.5)"


def gaps_of(t: Tables, demand: DataFrame | None = None) -> DataFrame:
    return mesh.gap_analysis(t.wards, t.citizen_demand if demand is None else demand, t.assets, t.projects, YEAR)


@query("gap_analysis", f"with {GAPS} select ward_code, sector, complaints, critical, asset_count, functional_count, active_projects, gap_score, round(demand_score, 6) as demand_score, round(absence_score, 6) as absence_score, severity, recommended_action from gaps")
def _(t: Tables) -> DataFrame:
    return gaps_of(t).select("ward_code", "sector", "complaints", "critical", "asset_count", "functional_count", "active_projects", "gap_score", F.round("demand_score", 6).alias("demand_score"), F.round("absence_score", 6).alias("absence_score"), "severity", "recommended_action")


@query("h26_gap_rationale", f"""with {GAPS}, n as (select *, case sector when 'WATER' then 'Water' when 'ELECTRICITY' then 'Electricity' when 'ROAD' then 'Road' when 'SANITATION' then 'Sanitation' when 'HEALTHCARE' then 'Healthcare' when 'EDUCATION' then 'Education' when 'TRANSPORT' then 'Transport' else 'Digital Connectivity' end as label from gaps)
select ward_code, sector, case recommended_action when 'BUILD_INFRASTRUCTURE' then label || ': no assets exist in this ward yet (coverage ' || cast(cast(round(coverage_ratio * 100) as bigint) as varchar) || '% of population).'
  when 'URGENT_REPAIR' then label || ': ' || critical || ' critical complaint' || (case when critical = 1 then '' else 's' end) || ' and ' || (asset_count - functional_count) || ' of ' || asset_count || ' assets not functional.'
  when 'EXPAND_CAPACITY' then label || ': assets serve only ' || cast(cast(round(coverage_ratio * 100) as bigint) as varchar) || '% of the ward population.'
  when 'ACCELERATE_PROJECTS' then label || ': coverage looks adequate but ' || complaints || ' complaint' || (case when complaints = 1 then '' else 's' end) || ' indicate quality problems.'
  when 'IMPROVE_QUALITY' then label || ': maintenance and condition improvement needed (' || complaints || ' complaints).'
  else case when active_projects > 0 then label || ': ' || active_projects || ' project(s) already under way.' else label || ': no significant gap detected.' end end as rationale from n""")
def _(t: Tables) -> DataFrame:
    return gaps_of(t).select("ward_code", "sector", "rationale")


@query("d9_provision", f"with {PROVISION} select ward_code, sector, asset_count, functional_count, degraded_count, round(served_population, 6) as served_population, round(quality_index, 6) as quality_index, round(mean_age_years, 6) as mean_age_years, broken_assets from prov")
def _(t: Tables) -> DataFrame:
    return mesh.provision(t.assets, YEAR).select("ward_code", "sector", "asset_count", "functional_count", "degraded_count", *[F.round(c, 6).alias(c) for c in ("served_population", "quality_index", "mean_age_years")], "broken_assets")


@query("d11_project_totals", f"with {TOTALS} select ward_code, sector, round(committed, 6) as committed, round(spent, 6) as spent, active_projects from tot")
def _(t: Tables) -> DataFrame:
    return mesh.project_totals(t.projects).select("ward_code", "sector", F.round("committed", 6).alias("committed"), F.round("spent", 6).alias("spent"), "active_projects")


@query("d12_demand_by_ward", f"with {DEMAND} select ward_code, sector, cast(complaints as bigint) as complaints, round(avg_severity, 6) as avg_severity, cast(critical as bigint) as critical from dem")
def _(t: Tables) -> DataFrame:
    return mesh.demand_by_ward(t.citizen_demand).withColumn("avg_severity", F.round("avg_severity", 6))


@query("d13_sector_demand_reference", f"with {DEMAND} select sector, cast(reference as bigint) as reference from ref")
def _(t: Tables) -> DataFrame:
    return mesh.sector_reference(t.citizen_demand)


@query("d34_gap_run_summary", f"with {GAPS} select severity, count(*) as n, count(distinct sector) as sectors, round(max(gap_score), 6) as worst from gaps group by severity")
def _(t: Tables) -> DataFrame:
    return gaps_of(t).groupBy("severity").agg(F.count("*").alias("n"), F.count_distinct("sector").alias("sectors"), F.round(F.max("gap_score"), 6).alias("worst"))


@query("f1_gaps_worst_first", f"with {GAPS} select ward_code, sector, gap_score from gaps order by gap_score desc, ward_code, sector")
def _(t: Tables) -> DataFrame:
    return gaps_of(t).select("ward_code", "sector", "gap_score").orderBy(F.desc("gap_score"), "ward_code", "sector")


@query("b6_gaps_filtered", f"with {GAPS} select ward_code, sector, gap_score, severity from gaps where sector = 'WATER' and severity in ('HIGH', 'CRITICAL') and gap_score >= 50")
def _(t: Tables) -> DataFrame:
    return gaps_of(t).where("sector = 'WATER' and severity in ('HIGH', 'CRITICAL') and gap_score >= 50").select("ward_code", "sector", "gap_score", "severity")


@query("d14_investment_summary", f"select sector, count(*) as project_count, round(sum(budget_lakhs), 4) as sanctioned, round(sum(spent_lakhs), 4) as spent, count(*) filter (where status = 'COMPLETED') as completed, count(*) filter (where {LATE}) as delayed, count(*) filter (where status = 'CANCELLED') as cancelled, count(*) filter (where status in ('PLANNED', 'IN_PROGRESS', 'DELAYED')) as active, round(coalesce(avg(case when {LATE} then delay_days end), 0), 6) as mean_delay_days, count(*) filter (where {STALLED}) as stalled, round(sum(spent_lakhs) / sum(budget_lakhs), 6) as absorption from projects group by sector")
def _(t: Tables) -> DataFrame:
    out = mesh.investment_summary(t.projects, AS_OF, "sector").drop("delivery")
    return out.withColumns({"sanctioned": F.round("sanctioned", 4), "spent": F.round("spent", 4), "mean_delay_days": F.round("mean_delay_days", 6), "absorption": F.round("absorption", 6)})


@query("d15_delivery_score", f"with s as (select ward_code, count(*) as n, count(*) filter (where status = 'COMPLETED') as done, sum(spent_lakhs) / sum(budget_lakhs) as a, coalesce(avg(case when {LATE} then delay_days end), 0) as d from projects group by ward_code) select ward_code, round(least(1, 0.4 * done / n + 0.4 * least(1, a) + 0.2 * (1 - least(1, d / 180))), 4) as delivery from s")
def _(t: Tables) -> DataFrame:
    return mesh.investment_summary(t.projects, AS_OF, "ward_code").select("ward_code", "delivery")


@query("f6_stalled_by_budget", f"select project_code, ward_code, round(budget_lakhs, 2) as budget_lakhs, round(spent_lakhs / budget_lakhs, 4) as spend_ratio from projects where {STALLED}")
def _(t: Tables) -> DataFrame:
    rows = t.projects.where(mesh.stalled(AS_OF))
    return rows.orderBy(F.desc("budget_lakhs"), "project_code").select("project_code", "ward_code", F.round("budget_lakhs", 2).alias("budget_lakhs"), F.round(safe_div("spent_lakhs", "budget_lakhs"), 4).alias("spend_ratio"))


@query("b14_delayed_projects", f"select project_code from projects where {LATE}")
def _(t: Tables) -> DataFrame:
    return t.projects.where(mesh.delayed(AS_OF)).select("project_code")


@query("h11_elapsed_fraction", f"select project_code, round({ELAPSED}, 6) as elapsed from projects")
def _(t: Tables) -> DataFrame:
    return t.projects.select("project_code", F.round(mesh.elapsed(AS_OF), 6).alias("elapsed"))


@query("b13_degraded_assets", f"select asset_code from assets where grade in ('POOR', 'CRITICAL') or status <> 'FUNCTIONAL' or greatest(0, {YEAR} - installed_year) >= 12")
def _(t: Tables) -> DataFrame:
    return t.assets.where(mesh.degraded(YEAR)).select("asset_code")


@query("h13_served_population", f"select asset_code, {PER_UNIT} * greatest(1, capacity_units) * cast({FACTOR} as double) as served from assets where {ASSET_SECTOR} is not null")
def _(t: Tables) -> DataFrame:
    return t.assets.join(F.broadcast(sector_assets(t.spark)), "asset_type").select("asset_code", mesh.served(F.col("per_unit")).alias("served"))


@query("c2_asset_sectors", f"select {ASSET_SECTOR} as sector, count(*) as n from assets where {ASSET_SECTOR} is not null group by 1")
def _(t: Tables) -> DataFrame:
    return t.assets.join(F.broadcast(sector_assets(t.spark)), "asset_type").groupBy("sector").agg(F.count("*").alias("n"))


_KNOWN = "(select ward_code as known from wards)"


@query("d16_domain_quality", f"""with q as (
select 'GIS' as domain, count(*) as record_count, avg(case when name <> '' and district <> '' then 1.0 else 0.0 end) as completeness, avg(case when population > 0 then 1.0 else 0.0 end) as validity from wards
union all select 'INFRASTRUCTURE', count(*), 1.0, avg(case when known is not null and installed_year between 1900 and 2100 and capacity_units >= 0 then 1.0 else 0.0 end) from assets left join {_KNOWN} k on k.known = ward_code
union all select 'INVESTMENT', count(*), 1.0, avg(case when known is not null and budget_lakhs >= 0 and spent_lakhs >= 0 and spent_lakhs <= budget_lakhs * 1.05 then 1.0 else 0.0 end) from projects left join {_KNOWN} k on k.known = ward_code
union all select 'CITIZEN', count(*), 1.0, avg(case when known is not null and complaint_count > 0 and avg_severity between 1 and 5 and max_severity between 1 and 5 then 1.0 else 0.0 end) from citizen_demand left join {_KNOWN} k on k.known = ward_code),
f as (select *, case domain when 'GIS' then round(1 - 10 / 180.0, 4) when 'INFRASTRUCTURE' then round(1 - 10 / 60.0, 4) when 'INVESTMENT' then round(1 - 10 / 120.0, 4) else round(1 - 10 / 14.0, 4) end as timeliness from q),
s as (select *, round(0.4 * completeness + 0.4 * validity + 0.2 * timeliness, 4) as quality_score from f)
select domain, record_count, round(completeness, 4) as completeness, round(validity, 4) as validity, timeliness, quality_score, case when record_count = 0 then 'UNAVAILABLE' when timeliness <= 0 then 'STALE' when quality_score >= 0.85 then 'HEALTHY' when quality_score >= 0.6 then 'INCOMPLETE' else 'STALE' end as status from s""")
def _(t: Tables) -> DataFrame:
    out = mesh.domain_quality(t.wards, t.citizen_demand, t.assets, t.projects, 10.0)
    return out.select("domain", "record_count", F.round("completeness", 4).alias("completeness"), F.round("validity", 4).alias("validity"), "timeliness", "quality_score", "status")


# ---- rollups and filters ---------------------------------------------------
@query("d1_districts", "select district, state, count(*) as wards, cast(sum(population) as bigint) as population from wards group by district, state")
def _(t: Tables) -> DataFrame:
    return t.wards.groupBy("district", "state").agg(F.count("*").alias("wards"), F.sum("population").alias("population"))


@query("d2_asset_breakdown", "select asset_type, status, count(*) as n from assets group by asset_type, status")
def _(t: Tables) -> DataFrame:
    return t.assets.groupBy("asset_type", "status").agg(F.count("*").alias("n"))


@query("d3_demand_totals", "select sector, cast(sum(complaint_count) as bigint) as complaints, round(avg(avg_severity), 3) as avg_severity from citizen_demand group by sector")
def _(t: Tables) -> DataFrame:
    return t.citizen_demand.groupBy("sector").agg(F.sum("complaint_count").alias("complaints"), F.round(F.avg("avg_severity"), 3).alias("avg_severity")).orderBy(F.desc("complaints"))


@query("d4_category_breakdown", "select category, count(*) as n, round(avg(avg_severity), 2) as avg_severity from citizen_demand group by category")
def _(t: Tables) -> DataFrame:
    return t.citizen_demand.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("avg_severity"), 2).alias("avg_severity"))


@query("d5_language_breakdown", "select lang, count(*) as n from documents group by lang")
def _(t: Tables) -> DataFrame:
    return t.base("documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("d6_status_counts_zero_filled", "with e as (select unnest(['PLANNED', 'IN_PROGRESS', 'COMPLETED', 'DELAYED', 'CANCELLED']) as status) select e.status, coalesce(n, 0) as n from e left join (select status, count(*) as n from projects group by status) p on p.status = e.status")
def _(t: Tables) -> DataFrame:
    counts = t.projects.groupBy("status").agg(F.count("*").alias("n"))
    return one_column(t.spark, "status", PROJECT_STATUSES).join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("d8_table_counts", "select 'wards' as name, count(*) as n from wards union all select 'assets', count(*) from assets union all select 'projects', count(*) from projects union all select 'citizen_demand', count(*) from citizen_demand")
def _(t: Tables) -> DataFrame:
    frames = [getattr(t, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("wards", "assets", "projects", "citizen_demand")]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("d41_distinct_districts", "select distinct district from wards")
def _(t: Tables) -> DataFrame:
    return t.wards.select("district").distinct()


@query("d40_bounding_box", "select district, round(min(latitude) - 0.15, 6) as south, round(max(latitude) + 0.15, 6) as north, round(min(longitude) - 0.15, 6) as west, round(max(longitude) + 0.15, 6) as east from wards group by district")
def _(t: Tables) -> DataFrame:
    return t.wards.groupBy("district").agg(F.round(F.min("latitude") - 0.15, 6).alias("south"), F.round(F.max("latitude") + 0.15, 6).alias("north"), F.round(F.min("longitude") - 0.15, 6).alias("west"), F.round(F.max("longitude") + 0.15, 6).alias("east"))


@query("b2_wards_by_state", "select ward_code, district from wards where state = 'ASIA' order by ward_code")
def _(t: Tables) -> DataFrame:
    return t.wards.where("state = 'ASIA'").select("ward_code", "district").orderBy("ward_code")


@query("b3_assets_by_sector", "select asset_code, asset_type from assets where asset_type in ('SEWAGE_LINE', 'DRAIN', 'WASTE_BIN', 'PUBLIC_TOILET') and status = 'FUNCTIONAL'")
def _(t: Tables) -> DataFrame:
    from wardloom.vocab import SECTOR_ASSETS

    return t.assets.where(F.col("asset_type").isin(*SECTOR_ASSETS["SANITATION"]) & (F.col("status") == "FUNCTIONAL")).select("asset_code", "asset_type")


@query("b4_projects_filtered", "select project_code from projects where sector = 'ROAD' and status = 'DELAYED'")
def _(t: Tables) -> DataFrame:
    return t.projects.where("sector = 'ROAD' and status = 'DELAYED'").select("project_code")


@query("b5_demand_filtered", "select ward_code, category, complaint_count from citizen_demand where ward_code = 'W00003' and sector = 'WATER'")
def _(t: Tables) -> DataFrame:
    return t.citizen_demand.where("ward_code = 'W00003' and sector = 'WATER'").select("ward_code", "category", "complaint_count")


@query("b9_case_insensitive_district", "select ward_code from wards where lower(district) = lower('Nation_7')")
def _(t: Tables) -> DataFrame:
    return t.wards.where(F.lower("district") == F.lower(F.lit("Nation_7"))).select("ward_code")


@query("b19_unknown_sectors", "with s as (select distinct sector from projects union all select 'GARDENS') select sector, sector in ('WATER', 'ELECTRICITY', 'ROAD', 'SANITATION', 'HEALTHCARE', 'EDUCATION', 'TRANSPORT', 'DIGITAL_CONNECTIVITY', 'HOUSING', 'PUBLIC_SAFETY') as known from s")
def _(t: Tables) -> DataFrame:
    return t.projects.select("sector").distinct().unionByName(one_column(t.spark, "sector", ("GARDENS",))).select("sector", F.col("sector").isin(*SECTORS).alias("known"))


@query("c13_ward_by_name", "select c.c_custkey, w.ward_code from customer c left join wards w on w.name = concat('Ward ', cast(c.c_custkey % 150 as varchar))")
def _(t: Tables) -> DataFrame:
    c = t.base("customer").select("c_custkey", F.concat(F.lit("Ward "), (F.col("c_custkey") % 150).cast("string")).alias("name"))
    return c.join(t.wards.select("name", "ward_code"), "name", "left").select("c_custkey", "ward_code")


@query("c25_aggregate_lineage_audit", "select d.ward_code, d.sector, d.category, d.complaint_count, count(*) as lineage from citizen_demand d join (select concat('W', lpad(cast(l_suppkey as varchar), 5, '0')) as ward_code, l_partkey % 8 as s, concat('C', cast(l_partkey % 3 as varchar)) as category from lineitem where year(l_shipdate) >= 1999) l on l.ward_code = d.ward_code and l.category = d.category and case l.s when 0 then 'WATER' when 1 then 'ELECTRICITY' when 2 then 'ROAD' when 3 then 'SANITATION' when 4 then 'HEALTHCARE' when 5 then 'EDUCATION' when 6 then 'TRANSPORT' else 'DIGITAL_CONNECTIVITY' end = d.sector group by all")
def _(t: Tables) -> DataFrame:
    lines = t.base("lineitem").where(F.year("l_shipdate") >= 1999)
    sector = F.element_at(F.array(*map(F.lit, SECTORS[:8])), (F.col("l_partkey") % 8 + 1).cast("int"))
    lineage = lines.groupBy(F.concat(F.lit("W"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0")).alias("ward_code"), sector.alias("sector"), F.concat(F.lit("C"), (F.col("l_partkey") % 3).cast("string")).alias("category")).agg(F.count("*").alias("lineage"))
    return t.citizen_demand.select("ward_code", "sector", "category", "complaint_count").join(lineage, ["ward_code", "sector", "category"])


@query("c27_known_ward_check", "select count(*) filter (where w.ward_code is null) as unknown, count(*) as n from projects p left join wards w on w.ward_code = p.ward_code")
def _(t: Tables) -> DataFrame:
    known = t.wards.select("ward_code", F.lit(True).alias("known"))
    return t.projects.join(known, "ward_code", "left").agg(F.count_if(F.col("known").isNull()).alias("unknown"), F.count("*").alias("n"))


@query("n10_sector_metadata", "with a as (select distinct asset_type from assets), s as (select distinct asset_type, {0} as sector, {1} as per_unit from a) select sector, count(*) as types, max(per_unit) > 0 as measurable from s where sector is not null group by sector".format(ASSET_SECTOR, PER_UNIT))
def _(t: Tables) -> DataFrame:
    return t.assets.select("asset_type").distinct().join(F.broadcast(sector_assets(t.spark)), "asset_type").groupBy("sector").agg(F.count("*").alias("types"), (F.max("per_unit") > 0).alias("measurable"))


@query("n11_catalogue", "select * from (values ('CITIZEN', 7, 14), ('GIS', 90, 180), ('INFRASTRUCTURE', 30, 60), ('INVESTMENT', 60, 120), ('DEMOGRAPHICS', 365, 730)) v(domain, refresh_days, stale_after_days)")
def _(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(d, i, 2 * i) for d, i in CADENCE.items()], "domain string, refresh_days int, stale_after_days int")


# ---- scalar functions over real columns ------------------------------------
@query("h1_h6_scalars", "select o_orderkey, least(1.0, greatest(0.0, o_totalprice / 200000)) as clamped, case when o_custkey % 5 = 0 then 0 else round(o_totalprice / (o_custkey % 5), 4) end as divided, round(least(100, greatest(0, o_totalprice / 3000)), 2) as share from orders")
def _(t: Tables) -> DataFrame:
    return t.base("orders").select("o_orderkey", clamp(F.col("o_totalprice") / 200000).alias("clamped"), F.round(safe_div("o_totalprice", F.col("o_custkey") % 5), 4).alias("divided"), normalise_0_100(F.col("o_totalprice") / 3000).alias("share"))


@query("h5_percent_change", "select l_orderkey, l_linenumber, l_partkey, case when l_partkey % 4 = 0 then case when l_quantity > 0 then 100.0 else 0.0 end else round((l_quantity - l_partkey % 4) / (l_partkey % 4) * 100, 2) end as change from lineitem")
def _(t: Tables) -> DataFrame:
    return t.base("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", percent_change(F.col("l_partkey") % 4, "l_quantity").alias("change"))


@query("h7_haversine", "select ward_code, round(2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(latitude - 10.5) / 2), 2) + cos(radians(10.5)) * cos(radians(latitude)) * pow(sin(radians(longitude - 78.5) / 2), 2)))), 3) as metres from wards")
def _(t: Tables) -> DataFrame:
    return t.wards.select("ward_code", F.round(haversine_m(F.lit(10.5), F.lit(78.5), "latitude", "longitude"), 3).alias("metres"))


@query("h17_timeliness", "select project_code, round(greatest(0.0, 1 - delay_days / 120.0), 4) as timeliness from projects")
def _(t: Tables) -> DataFrame:
    return t.projects.select("project_code", mesh.timeliness(F.col("delay_days"), 60).alias("timeliness"))
