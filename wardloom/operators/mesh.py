"""Provision, gaps, investment and domain quality of wards."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.config import GapConfig
from wardloom.functions.columns import band, clamp, inside, lookup, percent, plural, safe_div, title
from wardloom.vocab import ACTIVE_STATUSES, CADENCE, CONDITION, SECTOR_ASSETS, STATUS_FACTOR, one_column, sector_assets

# Limits of the gap bands.
GAP_BANDS = {"CRITICAL": 75, "HIGH": 55, "MODERATE": 35}
GAP = GapConfig()


# ---- provision -------------------------------------------------------------
def age(year: int) -> Column:
    return F.greatest(F.lit(0), F.lit(year) - F.col("installed_year"))


def degraded(year: int, config: GapConfig = GAP) -> Column:
    return F.col("grade").isin("POOR", "CRITICAL") | (F.col("status") != "FUNCTIONAL") | (age(year) >= config.degraded_age)


def served(per_unit: Column) -> Column:
    return per_unit * F.greatest(F.lit(1), F.col("capacity_units")) * lookup("status", STATUS_FACTOR, 0.0)


def provision(assets: DataFrame, year: int) -> DataFrame:
    """One row for each ward and sector with assets: counts, served people, quality index and mean age.

    The sector map has a row for each asset type, so it is joined by broadcast; one grouping does the rest.
    """
    rows = assets.join(F.broadcast(sector_assets(assets.sparkSession)), "asset_type")
    broken = F.col("status") == "BROKEN"
    worn = F.avg(lookup("grade", CONDITION, 1) / F.lit(3.0))
    quality = 0.5 * (1 - worn) + 0.3 * (1 - clamp(F.max(age(year)) / F.lit(24.0))) + 0.2 * (1 - F.avg(broken.cast("double")))
    return rows.groupBy("ward_code", "sector").agg(
        F.count("*").alias("asset_count"),
        F.count_if(F.col("status") == "FUNCTIONAL").alias("functional_count"),
        F.count_if(degraded(year)).alias("degraded_count"),
        F.sum(served(F.col("per_unit"))).alias("served_population"),
        quality.alias("quality_index"),
        F.avg(age(year)).alias("mean_age_years"),
        F.array_join(F.sort_array(F.collect_list(F.when(broken, F.col("asset_code")))), ",").alias("broken_assets"),
    )


# ---- gap analysis ----------------------------------------------------------
def demand_by_ward(demand: DataFrame) -> DataFrame:
    """Complaints, unweighted mean severity of the rows with any, and critical ones, by ward and sector."""
    return demand.groupBy("ward_code", "sector").agg(
        F.sum("complaint_count").alias("complaints"),
        F.coalesce(F.avg(F.when(F.col("complaint_count") > 0, F.col("avg_severity"))), F.lit(0.0)).alias("avg_severity"),
        F.sum("critical_count").alias("critical"),
    )


def sector_reference(demand: DataFrame) -> DataFrame:
    """The largest demand of any ward, by sector."""
    return demand_by_ward(demand).groupBy("sector").agg(F.max("complaints").alias("reference"))


def demand_score(complaints: Column, severity: Column, reference: Column) -> Column:
    reference = F.when(reference > 0, reference).otherwise(complaints)
    score = clamp(0.6 * clamp(safe_div(complaints, reference)) + 0.4 * clamp((severity - 1) / 4))
    return F.when(F.coalesce(complaints, F.lit(0)) <= 0, F.lit(0.0)).otherwise(score)


def absence_score(coverage: Column, measurable: Column, config: GapConfig = GAP) -> Column:
    return F.when(~measurable | (coverage >= config.target), F.lit(0.0)).otherwise(clamp(1 - coverage / config.target))


def project_totals(projects: DataFrame) -> DataFrame:
    """Committed and spent money and active projects by ward and sector; cancelled ones are left out."""
    return projects.where(F.col("status") != "CANCELLED").groupBy("ward_code", "sector").agg(F.sum("budget_lakhs").alias("committed"), F.sum("spent_lakhs").alias("spent"), F.count_if(F.col("status").isin(*ACTIVE_STATUSES)).alias("active_projects"))


def action() -> Column:
    """What to do, by what is wrong first."""
    return (
        F.when(F.col("asset_count") == 0, "BUILD_INFRASTRUCTURE")
        .when((F.col("critical") > 0) & (F.col("functional_count") < F.col("asset_count")), "URGENT_REPAIR")
        .when(F.col("coverage_ratio") < GAP.target, "EXPAND_CAPACITY")
        .when(F.col("gap_score") >= GAP_BANDS["HIGH"], "ACCELERATE_PROJECTS")
        .when(F.col("gap_score") >= GAP_BANDS["MODERATE"], "IMPROVE_QUALITY")
        .otherwise("MONITOR")
    )


def rationale() -> Column:
    name, n = title("sector"), F.col("complaints")
    broken = F.col("asset_count") - F.col("functional_count")
    # The sentences that results are compared by.
    texts = {
        "BUILD_INFRASTRUCTURE": F.concat(name, F.lit(": no assets exist in this ward yet (coverage "), percent("coverage_ratio"), F.lit(" of population).")),
        "URGENT_REPAIR": F.concat(name, F.lit(": "), F.col("critical"), F.lit(" critical complaint"), plural("critical"), F.lit(" and "), broken, F.lit(" of "), F.col("asset_count"), F.lit(" assets not functional.")),
        "EXPAND_CAPACITY": F.concat(name, F.lit(": assets serve only "), percent("coverage_ratio"), F.lit(" of the ward population.")),
        "ACCELERATE_PROJECTS": F.concat(name, F.lit(": coverage looks adequate but "), n, F.lit(" complaint"), plural("complaints"), F.lit(" indicate quality problems.")),
        "IMPROVE_QUALITY": F.concat(name, F.lit(": maintenance and condition improvement needed ("), n, F.lit(" complaints).")),
    }
    calm = F.when(F.col("active_projects") > 0, F.concat(name, F.lit(": "), F.col("active_projects"), F.lit(" project(s) already under way."))).otherwise(F.concat(name, F.lit(": no significant gap detected.")))
    out = None
    for key, text in texts.items():
        out = F.when(F.col("recommended_action") == key, text) if out is None else out.when(F.col("recommended_action") == key, text)
    return out.otherwise(calm)


def gap_analysis(wards: DataFrame, demand: DataFrame, assets: DataFrame, projects: DataFrame, year: int, sectors: tuple[str, ...] = tuple(SECTOR_ASSETS), config: GapConfig = GAP) -> DataFrame:
    """Every ward with every sector, its demand, provision and projects, scored and explained.

    Each side is aggregated to ward and sector before it is joined; the sector list and the sector
    references have one row for each sector and are broadcast.
    """
    spark = wards.sparkSession
    keys = ["ward_code", "sector"]
    grid = wards.select("ward_code", "district", "population").crossJoin(F.broadcast(one_column(spark, "sector", sectors)))
    rows = grid.join(demand_by_ward(demand), keys, "left").join(provision(assets, year), keys, "left").join(project_totals(projects), keys, "left").join(F.broadcast(sector_reference(demand)), "sector", "left")
    zero = ["complaints", "critical", "asset_count", "functional_count", "degraded_count", "active_projects"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in zero} | {c: F.coalesce(c, F.lit(0.0)).cast("double") for c in ("avg_severity", "served_population", "committed", "spent")} | {"quality_index": F.coalesce("quality_index", F.lit(1.0))})
    rows = rows.withColumn("coverage_ratio", safe_div("served_population", "population"))
    measurable = F.col("sector").isin(*[s for s in sectors if s != "ROAD"])
    rows = rows.withColumns({"demand_score": demand_score(F.col("complaints"), F.col("avg_severity"), F.col("reference")), "absence_score": absence_score(F.col("coverage_ratio"), measurable, config), "badness": 1 - F.col("quality_index")})
    raw = 100 * (config.demand * F.col("demand_score") + config.absence * F.col("absence_score") + config.quality * F.col("badness"))
    rows = rows.withColumn("gap_score", F.round(clamp(raw, 0.0, 100.0), 6))
    rows = rows.withColumn("severity", band("gap_score", GAP_BANDS, "LOW")).withColumn("recommended_action", action())
    return rows.withColumn("rationale", rationale())


# ---- investment ------------------------------------------------------------
def expected_on() -> Column:
    return F.date_add("sanctioned_on", F.col("planned_days"))


def delayed(as_of: dt.date) -> Column:
    late = F.when(expected_on().isNull(), F.coalesce("delay_days", F.lit(0)) > 0).otherwise(F.lit(as_of) > expected_on())
    return F.when(F.col("status").isin("COMPLETED", "CANCELLED"), F.lit(False)).otherwise(late)


def elapsed(as_of: dt.date, missing: float = 1.0) -> Column:
    """Share of the project's period that has passed; ``missing`` where a date is."""
    period = F.datediff(expected_on(), "sanctioned_on")
    share = F.when(period <= 0, F.lit(1.0)).otherwise(clamp(F.datediff(F.lit(as_of), "sanctioned_on") / period))
    return F.when(period.isNull(), F.lit(missing)).otherwise(share)


def stalled(as_of: dt.date, spend: float = 0.35, past: float = 0.5) -> Column:
    return ~F.col("status").isin("COMPLETED", "CANCELLED") & (F.col("budget_lakhs") > 0) & (safe_div("spent_lakhs", "budget_lakhs") < spend) & (elapsed(as_of) >= past)


def investment_summary(projects: DataFrame, as_of: dt.date, *by: str) -> DataFrame:
    late = delayed(as_of)
    out = projects.groupBy(*by).agg(
        F.count("*").alias("project_count"),
        F.sum("budget_lakhs").alias("sanctioned"),
        F.sum("spent_lakhs").alias("spent"),
        F.count_if(F.col("status") == "COMPLETED").alias("completed"),
        F.count_if(late).alias("delayed"),
        F.count_if(F.col("status") == "CANCELLED").alias("cancelled"),
        F.count_if(F.col("status").isin(*ACTIVE_STATUSES)).alias("active"),
        F.coalesce(F.avg(F.when(late, F.col("delay_days"))), F.lit(0.0)).alias("mean_delay_days"),
        F.count_if(stalled(as_of)).alias("stalled"),
    )
    return out.withColumn("absorption", safe_div("spent", "sanctioned")).withColumn("delivery", delivery())


def delivery() -> Column:
    score = 0.4 * safe_div("completed", "project_count") + 0.4 * clamp("absorption") + 0.2 * (1 - clamp(F.col("mean_delay_days") / 180))
    return F.when(F.col("project_count") == 0, F.lit(1.0)).otherwise(F.round(clamp(score), 4))


# ---- domain quality --------------------------------------------------------
def timeliness(age_days: Column, interval: int) -> Column:
    return F.when(age_days <= 0, F.lit(1.0)).otherwise(F.round(clamp(1 - age_days / (2.0 * interval)), 4))


def domain_quality(wards: DataFrame, demand: DataFrame, assets: DataFrame, projects: DataFrame, age_days: float = 0.0) -> DataFrame:
    """Completeness, validity, timeliness and status of each domain; a row refers to a known ward if it joins one."""
    known = wards.select(F.col("ward_code").alias("known")).distinct()
    has = lambda *names: F.lit(True) if not names else F.coalesce(F.concat(*[F.col(n).cast("string") for n in names]) != "", F.lit(False))
    point = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    parts = {
        "GIS": (wards, has("name") & has("district") & point, (F.col("population") > 0) & point & inside("latitude", F.col("latitude") - 0.025, F.col("latitude") + 0.025)),
        "INFRASTRUCTURE": (assets, has("asset_code") & has("ward_code") & has("asset_type") & has("status"), F.col("known").isNotNull() & F.col("installed_year").between(1900, 2100) & (F.col("capacity_units") >= 0)),
        "INVESTMENT": (projects, has("project_code") & has("ward_code") & has("title") & has("sector"), F.col("known").isNotNull() & (F.col("budget_lakhs") >= 0) & (F.col("spent_lakhs") >= 0) & (F.col("spent_lakhs") <= F.col("budget_lakhs") * 1.05)),
        "CITIZEN": (demand, has("ward_code") & has("sector") & (F.col("window_days") > 0), F.col("known").isNotNull() & (F.col("complaint_count") > 0) & F.col("avg_severity").between(1, 5) & F.col("max_severity").between(1, 5)),
    }
    out = None
    for domain, (rows, complete, valid) in parts.items():
        rows = rows.join(known, rows["ward_code"] == known["known"], "left")
        row = rows.agg(F.lit(domain).alias("domain"), F.count("*").alias("record_count"), F.avg(F.coalesce(complete, F.lit(False)).cast("double")).alias("completeness"), F.avg(F.coalesce(valid, F.lit(False)).cast("double")).alias("validity"), F.lit(CADENCE[domain]).alias("interval"))
        out = row if out is None else out.unionByName(row)
    out = out.withColumns({"completeness": F.coalesce("completeness", F.lit(0.0)), "validity": F.coalesce("validity", F.lit(0.0))})
    fresh = None
    for domain, interval in CADENCE.items():
        value = timeliness(F.lit(age_days), interval)
        fresh = F.when(F.col("domain") == domain, value) if fresh is None else fresh.when(F.col("domain") == domain, value)
    out = out.withColumn("timeliness", fresh).withColumn("quality_score", F.round(0.4 * F.col("completeness") + 0.4 * F.col("validity") + 0.2 * F.col("timeliness"), 4))
    status = F.when(F.col("record_count") == 0, "UNAVAILABLE").when(F.col("timeliness") <= 0, "STALE").when(F.col("quality_score") >= 0.85, "HEALTHY").when(F.col("quality_score") >= 0.6, "INCOMPLETE").otherwise("STALE")
    return out.withColumn("status", status)
