"""Queries of the priority ranking and the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.functions.ordered import running, stored
from wardloom.operators import intel, priority
from wardloom.plans.intel_queries import SERIES, SPOTS, trends_of
from wardloom.plans.mesh_queries import GAPS, gaps_of
from wardloom.plans.registry import query
from wardloom.sources.testdata import Tables
from wardloom.vocab import one_column

RANKED = f"""{SPOTS}, {SERIES}, {GAPS},
mb as (select c.cluster, c.ward_code from cl c join hs on hs.cluster = c.cluster),
s1 as (select mb.cluster, avg(avg_severity) as avg_severity from mb join citizen_demand d on d.ward_code = mb.ward_code group by 1),
s2 as (select cluster, pct_growth, trend_direction from (select mb.cluster, pct_change as pct_growth, direction as trend_direction, row_number() over (partition by mb.cluster order by pct_change desc, tr.ward_code desc, tr.sector desc) as n from mb join tr on tr.ward_code = mb.ward_code where direction <> 'UNKNOWN') x where n = 1),
s3 as (select cluster, avg(gap_score) as gap_score, max(case when n = 1 then sector end) as dominant_sector from (select mb.cluster, gap_score, sector, row_number() over (partition by mb.cluster order by gap_score desc, sector desc) as n from mb join gaps g on g.ward_code = mb.ward_code) x group by 1),
s4 as (select mb.cluster, sum(case when status in ('STALLED', 'DELAYED', 'FAILED', 'SUSPENDED') then budget_lakhs else 0 end) / sum(budget_lakhs) as stalled_share, least(1, greatest(0, 1 - sum(case when status in ('IN_PROGRESS', 'DELAYED') then spent_lakhs end) / sum(case when status in ('IN_PROGRESS', 'DELAYED') then budget_lakhs end))) as unspent_share, avg(delay_days) as delay_days from mb join projects p on p.ward_code = mb.ward_code group by 1),
sg as (select hs.cluster, hs.district, hs.population, hs.complaints, hs.critical, hs.wards, s1.avg_severity, s2.pct_growth, coalesce(s2.trend_direction, 'UNKNOWN') as trend_direction, s3.gap_score, s3.dominant_sector, s4.stalled_share, s4.unspent_share, s4.delay_days, hs.complaints / (hs.population / 1000.0) as rate
  from hs left join s1 on s1.cluster = hs.cluster left join s2 on s2.cluster = hs.cluster left join s3 on s3.cluster = hs.cluster left join s4 on s4.cluster = hs.cluster),
sc0 as (select *, least(1, rate / 5) as f1, least(1, avg_severity / 5) as f2, case trend_direction when 'UNKNOWN' then null when 'STABLE' then 0.25 when 'WORSENING' then least(1, greatest(0, pct_growth / 100)) else 0 end as f3, least(1, gap_score / 100) as f4,
  case when stalled_share is null then null else (least(1, stalled_share / 0.4) + coalesce(least(1, unspent_share / 0.5), 0) + least(1, delay_days / 180)) / (2 + case when unspent_share is null then 0 else 1 end) end as f5 from sg),
sc1 as (select *, round((coalesce(f1, 0) * 0.3 + coalesce(f2, 0) * 0.2 + coalesce(f3, 0) * 0.2 + coalesce(f4, 0) * 0.15 + coalesce(f5, 0) * 0.15) * ((case when f1 is null then 0 else 0.3 end) + (case when f2 is null then 0 else 0.2 end) + (case when f3 is null then 0 else 0.2 end) + (case when f4 is null then 0 else 0.15 end) + (case when f5 is null then 0 else 0.15 end)) * 100, 1) as score from sc0),
sc as (select *, case when score >= 70 then 'HIGH' when score >= 45 then 'MEDIUM' else 'LOW' end as band, row_number() over (order by score desc, cluster) as rank from sc1),
pl as (select *, round(50 + 5 * wards + 15 * least(2, coalesce(stalled_share, 0) * 4) + 10 * least(2, coalesce(unspent_share, 0) * 2) + case when critical > 0 then 10 else 0 end, 1) as cost_lakhs from sc)"""


def ranked_of(t: Tables) -> DataFrame:
    demand, grouped = stored(t.citizen_demand), intel.near_clusters(t.wards)
    spots = intel.hotspots(t.wards, demand, grouped=grouped, lists=False)
    members = grouped.join(spots.select("cluster"), "cluster", "left_semi")
    return priority.ranked(priority.scored(priority.signals(spots, members, demand, trends_of(t), gaps_of(t, demand), t.projects)))


@query("h19_priority_scores", f"with recursive {RANKED} select cluster, score, band, round(f1, 6) as f_demand, round(f2, 6) as f_severity, round(f3, 6) as f_trend, round(f4, 6) as f_coverage, round(f5, 6) as f_service_failure from sc")
def _(t: Tables) -> DataFrame:
    return ranked_of(t).select("cluster", "score", "band", *[F.round(f"f_{k}", 6).alias(f"f_{k}") for k in priority.FACTORS])


@query("e7_priority_rank", f"with recursive {RANKED} select rank, cluster, printf('HS-90-%04d', rank) as hotspot_code, score from sc")
def _(t: Tables) -> DataFrame:
    return ranked_of(t).select("rank", "cluster", "hotspot_code", "score")


@query("e9_action_plan", f"with recursive {RANKED} select rank, cluster, cost_lakhs, round(sum(cost_lakhs) over (order by rank), 1) as cumulative_lakhs, case when gap_score >= 40 then 'Expand ' || dominant_sector || ' service coverage across the hotspot''s wards.' when stalled_share >= 0.2 then 'Escalate stalled projects - the budget is committed but not delivering.' when unspent_share >= 0.3 then 'Expedite release of sanctioned but unspent budget.' when trend_direction = 'WORSENING' then 'Intervene now - complaints are rising by ' || printf('%.0f', abs(pct_growth)) || '%.' else 'Investigate - ' || printf('%.1f', rate) || ' complaints per 1,000 residents is high for this window.' end as recommendation from pl")
def _(t: Tables) -> DataFrame:
    return priority.action_plan(ranked_of(t)).select("rank", "cluster", "cost_lakhs", "cumulative_lakhs", "recommendation")


@query("f7_plan_top_n", f"with recursive {RANKED} select rank, cluster, cost_lakhs, (select count(*) from pl) > 5 as is_partial from pl where rank <= 5")
def _(t: Tables) -> DataFrame:
    rows = ranked_of(t).withColumn("cost_lakhs", priority.cost_lakhs())
    total = rows.agg((F.count("*") > 5).alias("is_partial"))
    return rows.where("rank <= 5").crossJoin(F.broadcast(total)).select("rank", "cluster", "cost_lakhs", "is_partial")


@query("e10_movement", f"with recursive {RANKED}, hi as (select cluster, row_number() over (order by complaints desc, cluster) as r from sc) select sc.cluster, sc.rank, hi.r - sc.rank as rank_change from sc join hi on hi.cluster = sc.cluster")
def _(t: Tables) -> DataFrame:
    now = ranked_of(t)
    history = running(now.select("cluster", "complaints", F.lit(1).alias("run_id"), "score"), [F.desc("complaints"), F.col("cluster")], rank=F.lit(1)).drop("complaints")
    return priority.movement(now, history).select("cluster", "rank", "rank_change")


@query("d33_portfolio_summary", f"with recursive {RANKED} select count(*) as hotspots, count(distinct district) as districts, round(avg(score), 4) as avg_score, cast(sum(complaints) as bigint) as complaints, count(*) filter (where f1 is null or f2 is null or f3 is null or f4 is null or f5 is null) as with_unmeasured from sc")
def _(t: Tables) -> DataFrame:
    return ranked_of(t).agg(F.count("*").alias("hotspots"), F.count_distinct("district").alias("districts"), F.round(F.avg("score"), 4).alias("avg_score"), F.sum("complaints").alias("complaints"), F.count_if(F.col("unmeasured") != "").alias("with_unmeasured"))


@query("d6_band_counts", f"with recursive {RANKED}, bb as (select unnest(['HIGH', 'MEDIUM', 'LOW']) as band) select bb.band, count(sc.band) as n from bb left join sc on sc.band = bb.band group by 1")
def _(t: Tables) -> DataFrame:
    counts = ranked_of(t).groupBy("band").agg(F.count("*").alias("n"))
    return one_column(t.spark, "band", ("HIGH", "MEDIUM", "LOW")).join(counts, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


@query("d39_dominant_factor", f"with recursive {RANKED} select cluster, case greatest(coalesce(f1 * 0.3, -1), coalesce(f2 * 0.2, -1), coalesce(f3 * 0.2, -1), coalesce(f4 * 0.15, -1), coalesce(f5 * 0.15, -1)) when f1 * 0.3 then 'demand' when f3 * 0.2 then 'trend' when f2 * 0.2 then 'severity' when f5 * 0.15 then 'service_failure' else 'coverage' end as factor from sc")
def _(t: Tables) -> DataFrame:
    return ranked_of(t).select("cluster", priority.dominant_factor().alias("factor"))


@query("d38_district_averages", f"with recursive {RANKED} select district, round(avg(score), 4) as score, count(*) as n, cast(sum(complaints) as bigint) as complaints from sc group by district")
def _(t: Tables) -> DataFrame:
    return ranked_of(t).groupBy("district").agg(F.round(F.avg("score"), 4).alias("score"), F.count("*").alias("n"), F.sum("complaints").alias("complaints"))


@query("d42_visible_plan_cost", f"with recursive {RANKED} select band, round(sum(cost_lakhs), 1) as cost from pl group by band")
def _(t: Tables) -> DataFrame:
    return ranked_of(t).withColumn("cost_lakhs", priority.cost_lakhs()).groupBy("band").agg(F.round(F.sum("cost_lakhs"), 1).alias("cost"))


@query("d31_stalled_share", f"with recursive {RANKED} select cluster, round(stalled_share, 6) as stalled_share, round(unspent_share, 6) as unspent_share, round(delay_days, 6) as delay_days from sg")
def _(t: Tables) -> DataFrame:
    return ranked_of(t).select("cluster", *[F.round(c, 6).alias(c) for c in ("stalled_share", "unspent_share", "delay_days")])
