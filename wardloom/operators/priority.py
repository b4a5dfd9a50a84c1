"""Priority scores of hotspots, their recommendations and the funding plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.config import PriorityConfig
from wardloom.functions.columns import band, clamp, printed, safe_div
from wardloom.functions.ordered import running

CONFIG = PriorityConfig()
FACTORS = ("demand", "severity", "trend", "coverage", "service_failure")


def signals(spots: DataFrame, members: DataFrame, demand: DataFrame, trends: DataFrame, gaps: DataFrame, projects: DataFrame) -> DataFrame:
    """What is measured of each hotspot(cluster, district, population, complaints, critical, wards): null is unmeasured, not zero.

    members(cluster, ward_code) stands for the exploded ward lists; each source is joined to it on the
    ward and aggregated to the hotspot.
    """
    severity = members.join(demand, "ward_code").groupBy("cluster").agg(F.avg("avg_severity").alias("avg_severity"))
    worst = F.max(F.struct("pct_change", F.col("ward_code").alias("w"), F.col("sector").alias("s"), "direction"))
    trend = members.join(trends.where("direction <> 'UNKNOWN'"), "ward_code").groupBy("cluster").agg(worst.alias("t")).select("cluster", F.col("t.pct_change").alias("pct_growth"), F.col("t.direction").alias("trend_direction"))
    gap = members.join(gaps.select("ward_code", "sector", "gap_score"), "ward_code").groupBy("cluster").agg(F.avg("gap_score").alias("gap_score"), F.max(F.struct("gap_score", "sector"))["sector"].alias("dominant_sector"))
    open_ = F.col("status").isin("IN_PROGRESS", "ONGOING", "DELAYED", "STALLED")
    stuck = F.col("status").isin("STALLED", "DELAYED", "FAILED", "SUSPENDED")
    money = members.join(projects, "ward_code").groupBy("cluster").agg(
        safe_div(F.sum(F.when(stuck, F.col("budget_lakhs")).otherwise(0.0)), F.sum("budget_lakhs")).alias("stalled_share"),
        F.when(F.sum(F.when(open_, F.col("budget_lakhs"))) > 0, clamp(1 - F.sum(F.when(open_, F.col("spent_lakhs"))) / F.sum(F.when(open_, F.col("budget_lakhs"))))).alias("unspent_share"),
        F.avg("delay_days").alias("delay_days"),
    )
    out = spots.select("cluster", "district", "population", "complaints", "critical", "wards")
    for part in (severity, trend, gap, money):
        out = out.join(part, "cluster", "left")
    rate = F.when(F.col("population") > 0, F.col("complaints") / (F.col("population") / 1000))
    return out.withColumn("rate", rate).withColumn("trend_direction", F.coalesce("trend_direction", F.lit("UNKNOWN")))


def growth(direction: Column, pct: Column, full: float) -> Column:
    return F.when(direction == "STABLE", 0.25).when(direction == "WORSENING", F.when(pct.isNull(), 0.5).otherwise(clamp(pct / full))).otherwise(0.0)


def components(config: PriorityConfig = CONFIG) -> dict[str, Column]:
    """Each factor, null where unmeasured."""
    share = lambda c, full: F.when(F.col(c).isNotNull(), clamp(F.col(c) / full))
    parts = F.filter(F.array(share("stalled_share", config.stalled), share("unspent_share", config.unspent), share("delay_days", config.delay)), lambda x: x.isNotNull())
    return {
        "demand": share("rate", config.per_1000),
        "severity": share("avg_severity", config.severity),
        "trend": F.when(F.col("trend_direction") != "UNKNOWN", growth(F.col("trend_direction"), F.col("pct_growth"), config.growth)),
        "coverage": share("gap_score", config.gap),
        "service_failure": F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)),
    }


def scored(rows: DataFrame, config: PriorityConfig = CONFIG) -> DataFrame:
    """rows with every factor, the unmeasured ones, the score and its band: the weighted sum times the measured weight."""
    rows = rows.withColumns({f"f_{k}": v for k, v in components(config).items()})
    total, measured = F.lit(0.0), F.lit(0.0)
    for k in FACTORS:
        total = total + F.coalesce(F.col(f"f_{k}"), F.lit(0.0)) * config.weights[k]
        measured = measured + F.when(F.col(f"f_{k}").isNotNull(), config.weights[k]).otherwise(0.0)
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(f"f_{k}").isNull(), k) for k in FACTORS]), lambda x: x.isNotNull()), ", ")
    rows = rows.withColumns({"unmeasured": missing, "score": F.round(total * clamp(measured) * 100, 1)})
    return rows.withColumn("band", band("score", {"HIGH": config.high, "MEDIUM": config.medium}, "LOW"))


def ranked(rows: DataFrame) -> DataFrame:
    """rank 1..n by falling score, then code."""
    return running(rows, [F.desc("score"), F.col("cluster")], rank=F.lit(1)).withColumn("rank", F.col("rank").cast("int")).withColumn("hotspot_code", F.format_string("HS-%d-%04d", F.lit(90), "rank"))


def recommendation() -> Column:
    share = lambda c: F.coalesce(c, F.lit(0.0))
    # The sentences that results are compared by.
    text = (
        F.when(F.col("gap_score") >= 40, F.concat(F.lit("Expand "), F.coalesce("dominant_sector", F.lit("priority")), F.lit(" service coverage across the hotspot's wards")))
        .when(share("stalled_share") >= 0.2, "Escalate stalled projects - the budget is committed but not delivering")
        .when(share("unspent_share") >= 0.3, "Expedite release of sanctioned but unspent budget")
        .when(F.col("trend_direction") == "WORSENING", F.concat(F.lit("Intervene now - complaints are rising"), F.coalesce(F.concat(F.lit(" by "), printed(F.abs("pct_growth"), 0), F.lit("%")), F.lit(""))))
        .when(F.col("rate").isNotNull(), F.concat(F.lit("Investigate - "), printed("rate", 1), F.lit(" complaints per 1,000 residents is high for this window")))
        .otherwise("Investigate - available data is not sufficient to act")
    )
    return F.concat(text, F.lit("."), F.when(F.col("unmeasured") != "", F.concat(F.lit(" (note: "), F.col("unmeasured"), F.lit(" not measured for this hotspot)"))).otherwise(""))


def cost_lakhs() -> Column:
    extra = lambda c, k: F.least(F.lit(2.0), F.coalesce(c, F.lit(0.0)) * k)
    return F.round(50 + 5 * F.col("wards") + 15 * extra("stalled_share", 4) + 10 * extra("unspent_share", 2) + F.when(F.col("critical") > 0, 10).otherwise(0), 1)


def action_plan(rows: DataFrame) -> DataFrame:
    """The ranking with costs, running cost in rank order, and the recommendation."""
    rows = rows.withColumns({"cost_lakhs": cost_lakhs(), "recommendation": recommendation()})
    return running(rows, ["rank"], cumulative_lakhs=F.col("cost_lakhs")).withColumn("cumulative_lakhs", F.round("cumulative_lakhs", 1))


def movement(now: DataFrame, history: DataFrame) -> DataFrame:
    """now with the change of rank and score since each hotspot's newest row of history(cluster, run_id, rank, score)."""
    last = history.groupBy("cluster").agg(F.max_by(F.struct("rank", "score"), "run_id").alias("h"))
    return now.join(last, "cluster", "left").withColumns({"rank_change": F.col("h.rank") - F.col("rank"), "score_change": F.round(F.col("score") - F.col("h.score"), 1)}).drop("h")


def dominant_factor(config: PriorityConfig = CONFIG) -> Column:
    """The measured factor that gives most to the score."""
    items = F.array(*[F.when(F.col(f"f_{k}").isNotNull(), F.struct((F.col(f"f_{k}") * config.weights[k]).alias("v"), F.lit(k).alias("k"))) for k in FACTORS])
    return F.array_max(F.filter(items, lambda x: x.isNotNull()))["k"]
