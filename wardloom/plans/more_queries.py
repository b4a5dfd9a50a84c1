"""Queries of the smaller operators: filters, lookups, places, scalars and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardloom.config import AS_OF
from wardloom.functions import text as tx
from wardloom.functions.columns import inside, lookup, printed, valid_point
from wardloom.functions.ordered import running
from wardloom.operators import geocode, intel, mesh, priority
from wardloom.plans.intel_queries import MONEY, PAIRS, SERIES, trends_of
from wardloom.plans.mesh_queries import GAPS, STALLED, YEAR, gaps_of
from wardloom.plans.registry import query
from wardloom.sources.testdata import Tables
from wardloom.vocab import SECTORS


@query("b1_conjunctive_filters", "select event_id from events where event_type = 'error' and value >= 5 and ts >= timestamp '2024-01-10' order by ts desc, event_id limit 50")
def _(t: Tables) -> DataFrame:
    given = {"event_type": "error", "least": 5, "since": "2024-01-10", "user": None}
    rows = t.base("events")
    for name, rule in (("event_type", F.col("event_type") == given["event_type"]), ("least", F.col("value") >= given["least"]), ("since", F.col("ts") >= F.lit(given["since"]).cast("timestamp")), ("user", F.lit(True))):
        rows = rows.where(rule) if given[name] is not None else rows
    return rows.orderBy(F.desc("ts"), "event_id").limit(50).select("event_id")


@query("b7_lineage_newest_first", "select request_id, ts from envelopes where event_type = 'click' order by ts desc, event_id limit 30")
def _(t: Tables) -> DataFrame:
    return t.envelopes.where("event_type = 'click'").orderBy(F.desc("ts"), "event_id").limit(30).select("request_id", "ts")


@query("b8_latest_runs", "select ward_code, sector, bucket from demand_windows where complaint_count >= 5 order by bucket desc, ward_code, sector limit 40")
def _(t: Tables) -> DataFrame:
    return t.demand_windows.where("complaint_count >= 5").orderBy(F.desc("bucket"), "ward_code", "sector").limit(40).select("ward_code", "sector", "bucket")


@query("b11_valid_points", "select c_custkey, coalesce(c_acctbal / 50 between -90 and 90, false) as valid from customer")
def _(t: Tables) -> DataFrame:
    return t.base("customer").select("c_custkey", valid_point(F.col("c_acctbal") / 50, F.lit(78.0)).alias("valid"))


@query("b12_open_bounds", "select c_custkey, coalesce(c_acctbal >= case when c_custkey % 3 = 0 then null else 1000 end, true) and coalesce(c_acctbal <= case when c_custkey % 5 = 0 then null else 5000 end, true) as within from customer")
def _(t: Tables) -> DataFrame:
    low, high = F.when(F.col("c_custkey") % 3 != 0, 1000), F.when(F.col("c_custkey") % 5 != 0, 5000)
    return t.base("customer").select("c_custkey", inside("c_acctbal", low, high).alias("within"))


@query("b15_absorption_stalled", f"select ward_code, count(*) as n, round(sum(budget_lakhs - spent_lakhs), 6) as unspent from projects where {STALLED} group by ward_code")
def _(t: Tables) -> DataFrame:
    return t.projects.where(mesh.stalled(AS_OF)).groupBy("ward_code").agg(F.count("*").alias("n"), F.round(F.sum(F.col("budget_lakhs") - F.col("spent_lakhs")), 6).alias("unspent"))


@query("b20_intake_rejects", "select event_id, case when event_type = 'view' and value < 5 then 'no text or location' when value > 10 then 'out of range' end as reason from events where (event_type = 'view' and value < 5) or value > 10")
def _(t: Tables) -> DataFrame:
    reason = F.when((F.col("event_type") == "view") & (F.col("value") < 5), "no text or location").when(F.col("value") > 10, "out of range")
    return t.base("events").select("event_id", reason.alias("reason")).where("reason is not null")


@query("c9_place_in_text", "with a as (select n_name as alias, n_regionkey as place from nation), x as (select c_custkey, lower(concat('water leak near nation_', cast(c_nationkey as varchar), ' bridge')) as text from customer), h as (select c_custkey, place, row_number() over (partition by c_custkey order by length(alias) desc, alias) as n from x join a on contains(text, lower(alias))) select x.c_custkey, h.place from x left join h on h.c_custkey = x.c_custkey and n = 1")
def _(t: Tables) -> DataFrame:
    places = t.base("nation").select(F.col("n_name").alias("alias"), F.col("n_regionkey").alias("place"))
    rows = t.base("customer").select("c_custkey", F.concat(F.lit("Water leak near Nation_"), "c_nationkey", F.lit(" bridge")).alias("text"))
    return geocode.by_text(rows, places, "c_custkey", "text")


_CUSTOMERS = "cp as (select c_custkey, 10 + cast((c_custkey * 7919) % 997 as double) / 997 as lat, 78 + cast((c_custkey * 104729) % 997 as double) / 997 as lon from customer)"


def customers_of(t: Tables) -> DataFrame:
    place = lambda k, start: F.lit(start) + (F.col("c_custkey") * k % 997).cast("double") / 997
    return t.base("customer").select("c_custkey", place(7919, 10).alias("lat"), place(104729, 78).alias("lon"))


@query("c10_smallest_box", f"with {_CUSTOMERS}, bx as (select n_name as place, 10 + n_nationkey * 0.03 as south, 10.2 + n_nationkey * 0.04 as north, 78.0 as west, 78.3 + n_nationkey * 0.02 as east from nation), h as (select c_custkey, place, row_number() over (partition by c_custkey order by (north - south) * (east - west), place) as n from cp join bx on lat between south and north and lon between west and east) select cp.c_custkey, h.place from cp left join h on h.c_custkey = cp.c_custkey and n = 1")
def _(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    boxes = t.base("nation").select(F.col("n_name").alias("place"), (10 + k * 0.03).alias("south"), (10.2 + k * 0.04).alias("north"), F.lit(78.0).alias("west"), (78.3 + k * 0.02).alias("east"))
    return geocode.by_box(customers_of(t), boxes, "c_custkey")


@query("c11_nearest_place", f"with {_CUSTOMERS}, g as (select n_name as place, 10 + n_nationkey * 0.04 as p_lat, 78 + ((n_nationkey * 7) % 25) * 0.04 as p_lon from nation), d as (select c_custkey, place, 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(p_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(p_lat)) * pow(sin(radians(p_lon - lon) / 2), 2)))) as metres from cp cross join g), b as (select *, row_number() over (partition by c_custkey order by metres, place) as n from d where metres <= 60000) select cp.c_custkey, b.place, round(b.metres, 2) as metres from cp left join b on b.c_custkey = cp.c_custkey and n = 1")
def _(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    places = t.base("nation").select(F.col("n_name").alias("place"), (10 + k * 0.04).alias("p_lat"), (78 + (k * 7 % 25) * 0.04).alias("p_lon"))
    return geocode.nearest(customers_of(t), places, "c_custkey").withColumn("metres", F.round("metres", 2))


@query("c12_country_box", f"with {_CUSTOMERS} select c_custkey, case when lat < 10.3 then 'SOUTH' when lat < 10.8 and lon < 78.5 then 'WEST' else 'REST' end as country from cp")
def _(t: Tables) -> DataFrame:
    country = F.when(F.col("lat") < 10.3, "SOUTH").when((F.col("lat") < 10.8) & (F.col("lon") < 78.5), "WEST").otherwise("REST")
    return customers_of(t).select("c_custkey", country.alias("country"))


@query("c15_latest_gap", f"with {GAPS} select ward_code, sector, gap_score from (select *, row_number() over (partition by ward_code order by gap_score desc, sector) as n from gaps) x where n = 1")
def _(t: Tables) -> DataFrame:
    return intel.latest(gaps_of(t).select("ward_code", "gap_score", "sector"), ["ward_code"], "gap_score", ties=False)


@query("c23_pairs_with_money", f"with {PAIRS}, {MONEY} select p.ward_code, p.sector, p.recent, p.previous, a.active from lt p join am a on a.ward_code = p.ward_code and a.sector = p.sector")
def _(t: Tables) -> DataFrame:
    return intel.last_two(t.demand_windows).join(intel.active_money(t.projects), ["ward_code", "sector"]).select("ward_code", "sector", "recent", "previous", "active")


@query("c26_requests_of_a_user", "select request_id, event_id from envelopes where user_id = 8")
def _(t: Tables) -> DataFrame:
    return t.envelopes.where("user_id = 8").select("request_id", "event_id")


@query("d30_worst_sector", f"with {GAPS} select ward_code, round(avg(gap_score), 3) as gap, arg_max(sector, (gap_score, sector)) as worst from gaps group by ward_code")
def _(t: Tables) -> DataFrame:
    return gaps_of(t).groupBy("ward_code").agg(F.round(F.avg("gap_score"), 3).alias("gap"), F.max(F.struct("gap_score", "sector"))["sector"].alias("worst"))


@query("d36_issue_group_totals", "select event_type, user_id % 10 as part, count(*) as report_count, round(avg(value), 6) as severity_avg, max(value) as severity_max, min(ts) as first_at, max(ts) as last_at from events group by 1, 2")
def _(t: Tables) -> DataFrame:
    return t.base("events").groupBy("event_type", (F.col("user_id") % 10).alias("part")).agg(F.count("*").alias("report_count"), F.round(F.avg("value"), 6).alias("severity_avg"), F.max("value").alias("severity_max"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("d37_longest_duration", "select event_id, greatest(event_id % 5, (event_id % 3) * 7, (event_id % 2) * 30) as days from events")
def _(t: Tables) -> DataFrame:
    k = F.col("event_id")
    found = F.array(F.struct((k % 5).alias("n"), F.lit("day").alias("unit")), F.struct((k % 3).alias("n"), F.lit("week").alias("unit")), F.struct((k % 2).alias("n"), F.lit("month").alias("unit")))
    days = F.array_max(F.transform(found, lambda d: d["n"] * lookup(d["unit"], {"day": 1, "week": 7, "month": 30, "year": 365}, 0)))
    return t.base("events").select("event_id", days.alias("days"))


@query("e3_momentum", f"with {SERIES} select ward_code, sector, momentum from tr where momentum > 3")
def _(t: Tables) -> DataFrame:
    return trends_of(t).where("momentum > 3").select("ward_code", "sector", "momentum")


@query("e11_share_of_total", "select sector, round(sum(complaint_count) / sum(sum(complaint_count)) over (), 8) as share from citizen_demand group by sector")
def _(t: Tables) -> DataFrame:
    return t.citizen_demand.groupBy("sector").agg(F.sum("complaint_count").alias("n")).select("sector", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 8).alias("share"))


@query("f10_newest_of_each", "select report_id, category from (select event_id as report_id, event_type as category, row_number() over (partition by event_type order by ts desc, event_id) as n from events) x where n <= 200")
def _(t: Tables) -> DataFrame:
    order = Window.partitionBy("event_type").orderBy(F.desc("ts"), "event_id")
    return t.base("events").withColumn("n", F.row_number().over(order)).where("n <= 200").select(F.col("event_id").alias("report_id"), F.col("event_type").alias("category"))


@query("g3_ordered_distinct", "select user_id, string_agg(event_type, ',' order by first) as kinds from (select user_id, event_type, min(event_id) as first from events group by 1, 2) x group by 1")
def _(t: Tables) -> DataFrame:
    rows = t.base("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return rows.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


@query("h8_bounding_boxes", "select ward_code, round(latitude - 1000 / 111320.0, 8) as south, round(longitude - 1000 / (111320.0 * greatest(0.01, cos(radians(latitude)))), 8) as west from wards")
def _(t: Tables) -> DataFrame:
    return t.wards.select("ward_code", F.round(F.col("latitude") - 1000 / F.lit(111320.0), 8).alias("south"), F.round(F.col("longitude") - 1000 / (111320.0 * F.greatest(F.lit(0.01), F.cos(F.radians("latitude")))), 8).alias("west"))


@query("h10_intensity", "select ward_code, round(cast(sum(complaint_count) as double) / (greatest(max(population), 1) / 1000.0), 4) as intensity from wards join citizen_demand using (ward_code) group by ward_code")
def _(t: Tables) -> DataFrame:
    rows = t.wards.join(t.citizen_demand, "ward_code").groupBy("ward_code").agg(F.sum("complaint_count").alias("n"), F.max("population").alias("p"))
    return rows.select("ward_code", F.round(F.col("n") / (F.greatest("p", F.lit(1)) / 1000), 4).alias("intensity"))


@query("h12_effective_age", f"select asset_code, greatest(0, {YEAR} - installed_year) as age from assets")
def _(t: Tables) -> DataFrame:
    return t.assets.select("asset_code", mesh.age(YEAR).alias("age"))


@query("h14_demand_score", "with d as (select ward_code, sector, sum(complaint_count) as c, avg(avg_severity) as s from citizen_demand group by 1, 2), r as (select sector, max(c) as m from d group by 1) select d.ward_code, d.sector, round(least(1, 0.6 * least(1, c / cast(m as double)) + 0.4 * least(1, greatest(0, (s - 1) / 4))), 6) as score from d join r on r.sector = d.sector")
def _(t: Tables) -> DataFrame:
    rows = mesh.demand_by_ward(t.citizen_demand).join(F.broadcast(mesh.sector_reference(t.citizen_demand)), "sector")
    return rows.select("ward_code", "sector", F.round(mesh.demand_score(F.col("complaints"), F.col("avg_severity"), F.col("reference")), 6).alias("score"))


@query("h18_weighted_growth", f"with {SERIES} select ward_code, sector, round(case direction when 'STABLE' then 0.25 when 'WORSENING' then least(1, greatest(0, pct_change / 100)) else 0 end, 6) as growth from tr")
def _(t: Tables) -> DataFrame:
    return trends_of(t).select("ward_code", "sector", F.round(priority.growth(F.col("direction"), F.col("pct_change"), 100.0), 6).alias("growth"))


@query("h22_severity_from_text", "select event_id, case when event_id % 4 = 0 then 1 else greatest(1, least(5, cast(event_id % 9 as int))) end as severity from events")
def _(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 4 == 0, F.lit("bad")).otherwise(F.format_string("%d.2", F.col("event_id") % 9))
    number = F.bround(raw.try_cast("double"), 0)
    return t.base("events").select("event_id", F.when(number.isNull(), 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), number.cast("int")))).alias("severity"))


@query("h31_severity_bands", "select distinct l_linenumber, case when s >= 5 then 'CRITICAL' when s >= 4 then 'HIGH' when s >= 3 then 'MEDIUM' else 'LOW' end as band from (select l_linenumber, 1 + (l_linenumber - 1) % 5 as s from lineitem) x")
def _(t: Tables) -> DataFrame:
    from wardloom.functions.columns import band

    return t.base("lineitem").select("l_linenumber").distinct().select("l_linenumber", band(1 + (F.col("l_linenumber") - 1) % 5, {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3}, "LOW").alias("band"))


@query("h33_location_status", "select c_custkey, case when c_custkey % 2 = 0 and c_custkey % 3 = 0 then 'RESOLVED' when c_custkey % 2 = 0 or c_custkey % 3 = 0 then 'PARTIAL' else 'UNRESOLVED' end as status from customer")
def _(t: Tables) -> DataFrame:
    return t.base("customer").select("c_custkey", geocode.location_status(F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3 == 0).alias("status"))


@query("h37_sector_for_category", "select c_custkey, case c_mktsegment when 'HOUSEHOLD' then 'UNKNOWN' else case c_custkey % 2 when 0 then 'WATER' else 'UNKNOWN' end end as sector from customer")
def _(t: Tables) -> DataFrame:
    category = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.col("c_mktsegment")).otherwise(F.when(F.col("c_custkey") % 2 == 0, "water").otherwise("noise"))
    return t.base("customer").select("c_custkey", F.when(F.upper(category).isin(*SECTORS), F.upper(category)).otherwise("UNKNOWN").alias("sector"))


@query("h44_keys", r"select p_partkey, trim(regexp_replace(lower(trim(p_name || ' / ' || p_type)), '[^\p{L}\p{N}\p{M}]+', '_', 'g'), '_') as key from part")
def _(t: Tables) -> DataFrame:
    return t.base("part").select("p_partkey", tx.normalize_key(F.concat("p_name", F.lit(" / "), "p_type")).alias("key"))


@query("h51_location_keys", "select ward_code, sha256(printf('%.5f:%.5f', latitude, longitude)) as key from wards")
def _(t: Tables) -> DataFrame:
    return t.wards.select("ward_code", F.sha2(F.format_string("%.5f:%.5f", "latitude", "longitude"), 256).alias("key"))


@query("h52_wkt", "select ward_code, printf('POINT(%.6f %.6f)', longitude, latitude) as wkt from wards")
def _(t: Tables) -> DataFrame:
    return t.wards.select("ward_code", F.format_string("POINT(%.6f %.6f)", "longitude", "latitude").alias("wkt"))


@query("h53_risk_codes", "select distinct 'SPIKE:' || case when length(sector) % 2 = 0 then 'CITY' else ward_code end || ':' || sector as code from citizen_demand")
def _(t: Tables) -> DataFrame:
    rows = t.citizen_demand.select(F.when(F.length("sector") % 2 == 1, F.col("ward_code")).alias("ward_code"), "sector").distinct()
    return rows.select(intel.risk_code("SPIKE").alias("code")).distinct()


@query("h56_file_names", r"select page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') as name from pages")
def _(t: Tables) -> DataFrame:
    return t.base("pages").select("page_id", F.regexp_replace("url", r"[^A-Za-z0-9._-]+", "_").alias("name"))


@query("h57_pincodes", r"select o_orderkey, regexp_matches(cast(o_custkey * 271 as varchar), '^\d{6}$') as valid from orders")
def _(t: Tables) -> DataFrame:
    return t.base("orders").select("o_orderkey", (F.col("o_custkey") * 271).cast("string").rlike(r"^\d{6}$").alias("valid"))


@query("h61_language_codes", "select doc_id, case when doc_id % 4 = 0 then 'en' when doc_id % 4 = 1 then 'ta' when doc_id % 4 = 2 then 'hi' end as code from documents")
def _(t: Tables) -> DataFrame:
    raw = F.element_at(F.array(F.lit("English"), F.lit("ta-IN"), F.lit(" HI "), F.lit("klingon")), (F.col("doc_id") % 4 + 1).cast("int"))
    clean = F.substring_index(F.lower(F.trim(raw)), "-", 1)
    return t.base("documents").select("doc_id", lookup(clean, {"english": "en", "en": "en", "ta": "ta", "tamil": "ta", "hi": "hi", "hindi": "hi"}).alias("code"))


@query("h68_lakh_labels", "select project_code, case when budget_lakhs >= 100 then printf('%.1f cr', budget_lakhs / 100) else printf('%.0f L', budget_lakhs) end as label from projects")
def _(t: Tables) -> DataFrame:
    label = F.when(F.col("budget_lakhs") >= 100, F.concat(printed(F.col("budget_lakhs") / 100, 1), F.lit(" cr"))).otherwise(F.concat(printed("budget_lakhs", 0), F.lit(" L")))
    return t.projects.select("project_code", label.alias("label"))


@query("h71_window_bounds", "select project_code, sanctioned_on + planned_days as window_end, sanctioned_on + planned_days - 30 as window_start from projects")
def _(t: Tables) -> DataFrame:
    return t.projects.select("project_code", mesh.expected_on().cast("date").alias("window_end"), F.date_sub(mesh.expected_on(), 30).alias("window_start"))


@query("h76_nested_with_fallback", """select event_id, cast(case when event_id % 2 = 0 then json_extract(props, '$.k') else '5' end as bigint) as k from events""")
def _(t: Tables) -> DataFrame:
    nested = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"location":'), "props", F.lit("}"))).otherwise(F.lit('{"k":5}'))
    rows = t.base("events").select("event_id", nested.alias("j"))
    return rows.select("event_id", F.coalesce(F.get_json_object("j", "$.location.k"), F.get_json_object("j", "$.k")).cast("long").alias("k"))


@query("n1_point_lookup", "select ward_code, name, population from wards where ward_code = 'W00007'")
def _(t: Tables) -> DataFrame:
    return t.wards.where("ward_code = 'W00007'").select("ward_code", "name", "population")


@query("n6_admin_lines", "select ward_code, concat_ws(', ', case when population > 15000 then name end, district, state) as line from wards")
def _(t: Tables) -> DataFrame:
    return t.wards.select("ward_code", F.concat_ws(", ", F.when(F.col("population") > 15000, F.col("name")), "district", "state").alias("line"))


@query("n8_issue_ids", "select event_type, printf('ISSUE-%05d', row_number() over (order by event_type)) as issue from (select distinct event_type from events) x")
def _(t: Tables) -> DataFrame:
    groups = running(t.base("events").select("event_type").distinct(), ["event_type"], no=F.lit(1))
    return groups.select("event_type", F.format_string("ISSUE-%05d", "no").alias("issue"))


@query("n12_census_by_ward", "select ward_code, year, n from (select ward_code, installed_year as year, count(*) as n, row_number() over (partition by ward_code order by installed_year desc) as r from assets group by 1, 2) x where r = 1")
def _(t: Tables) -> DataFrame:
    rows = t.assets.groupBy("ward_code", F.col("installed_year").alias("year")).agg(F.count("*").alias("n"))
    return intel.latest(rows, ["ward_code"], "year", ties=False)


@query("n14_mean_of_nothing", "select c_mktsegment, avg(case when c_acctbal < -900 then c_acctbal end) as unmeasured, coalesce(avg(case when c_acctbal < -99999 then c_acctbal end), 0) as zero from customer group by 1")
def _(t: Tables) -> DataFrame:
    return t.base("customer").groupBy("c_mktsegment").agg(F.avg(F.when(F.col("c_acctbal") < -900, F.col("c_acctbal"))).alias("unmeasured"), F.coalesce(F.avg(F.when(F.col("c_acctbal") < -99999, F.col("c_acctbal"))), F.lit(0.0)).alias("zero"))


@query("n22_confidence_from_log", "select event_id, round(least(1, exp(-value / 10)), 6) as confidence from events")
def _(t: Tables) -> DataFrame:
    return t.base("events").select("event_id", F.round(F.least(F.lit(1.0), F.exp(-F.col("value") / 10)), 6).alias("confidence"))


@query("j3_distinct_then_join", f"with {_CUSTOMERS}, g as (select distinct round(lat, 2) as lat, round(lon, 2) as lon from cp) select count(*) as lookups from g")
def _(t: Tables) -> DataFrame:
    return customers_of(t).select(F.round("lat", 2).alias("lat"), F.round("lon", 2).alias("lon")).distinct().agg(F.count("*").alias("lookups"))


@query("d1_rollup_state_district", "select state, district, cast(sum(population) as bigint) as population from wards group by rollup (state, district)")
def _(t: Tables) -> DataFrame:
    return t.wards.rollup("state", "district").agg(F.sum("population").alias("population"))


@query("h24a_geo_scores", "select a.ward_code as a, b.ward_code as b, round(1 - m / 12000, 6) as score from (select a.ward_code, a.latitude, a.longitude from wards a) a join wards b on a.ward_code < b.ward_code cross join lateral (select 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))) as m) x where m <= 12000")
def _(t: Tables) -> DataFrame:
    return intel.near_pairs(t.wards).select("a", "b", F.round(1 - F.col("metres") / 12000, 6).alias("score"))
