"""Gap analysis, provision, investment and domain quality against values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardloom.config import GapConfig, PriorityConfig
from wardloom.functions.columns import band, clamp, inside, percent_change, safe_div
from wardloom.operators import mesh

WARD = "ward_code string, name string, district string, state string, latitude double, longitude double, population long"
DEMAND = "ward_code string, sector string, category string, window_days int, complaint_count long, avg_severity double, max_severity int, critical_count long"
ASSET = "asset_code string, ward_code string, asset_type string, status string, grade string, capacity_units int, installed_year int"
PROJECT = "project_code string, ward_code string, sector string, title string, status string, budget_lakhs double, spent_lakhs double, sanctioned_on date, planned_days int, delay_days int"


def gap(spark, demand, assets, population=10_000):
    wards = spark.createDataFrame([("W1", "One", "D", "S", 10.0, 78.0, population)], WARD)
    d = spark.createDataFrame([("W1", "WATER", "C", 90, n, s, 5, c) for n, s, c in demand], DEMAND)
    a = spark.createDataFrame(assets, ASSET)
    p = spark.createDataFrame([], PROJECT)
    return mesh.gap_analysis(wards, d, a, p, 2026).where("sector = 'WATER'").first()


@pytest.mark.parametrize(("severity", "score", "name"), [(5.0, 75.0, "CRITICAL"), (4.5, 70.0 + 0.0, "HIGH")])
def test_no_assets(spark, severity, score, name):
    row = gap(spark, [(100, severity, 0)], [])
    assert row["severity"] == name and row["recommended_action"] == "BUILD_INFRASTRUCTURE"
    assert row["gap_score"] == pytest.approx(100 * (0.4 * (0.6 + 0.4 * (severity - 1) / 4) + 0.35))


def test_silent_ward(spark):
    row = gap(spark, [], [])
    assert (row["demand_score"], row["absence_score"], row["gap_score"], row["severity"]) == (0.0, 1.0, 35.0, "MODERATE")


def test_worn_network(spark):
    assets = [("A1", "W1", "BOREWELL", "FUNCTIONAL", "GOOD", 1, 2020), ("A2", "W1", "BOREWELL", "BROKEN", "CRITICAL", 1, 2004)]
    row = gap(spark, [(140, 4.2, 12)], assets, 16_000)
    assert row["functional_count"] == 1 and row["recommended_action"] == "URGENT_REPAIR"
    assert row["quality_index"] == pytest.approx(0.5 * 0.5 + 0.3 * (1 - 22 / 24) + 0.2 * 0.5)
    assert row["coverage_ratio"] == pytest.approx(800 / 16_000)


def test_empty_tables(spark):
    empty = [spark.createDataFrame([], s) for s in (WARD, DEMAND, ASSET, PROJECT)]
    assert mesh.gap_analysis(*empty, 2026).count() == 0
    rows = mesh.domain_quality(empty[0], empty[1], empty[2], empty[3]).collect()
    assert {r["status"] for r in rows} == {"UNAVAILABLE"} and len(rows) == 4


def test_investment(spark):
    day = dt.date(1999, 1, 1)
    rows = [("P1", "W1", "WATER", "T", "PLANNED", 100.0, 10.0, day, 100, 5), ("P2", "W1", "WATER", "T", "COMPLETED", 50.0, 50.0, day, 10, 0), ("P3", "W1", "WATER", "T", "CANCELLED", 50.0, 0.0, None, None, 9)]
    p = spark.createDataFrame(rows, PROJECT)
    s = mesh.investment_summary(p, dt.date(2000, 1, 1), "sector").first()
    assert (s["project_count"], s["completed"], s["delayed"], s["active"], s["stalled"], s["mean_delay_days"]) == (3, 1, 1, 1, 1, 5.0)
    assert s["absorption"] == pytest.approx(60 / 200)


def test_columns(spark):
    row = spark.range(1).select(clamp(F.lit(float("nan"))).alias("a"), safe_div(F.lit(1), F.lit(0)).alias("b"), percent_change(F.lit(0), F.lit(40)).alias("c"), percent_change(F.lit(100), F.lit(150)).alias("d"), percent_change(F.lit(0), F.lit(0)).alias("e"), inside(F.lit(1), F.lit(None).cast("int"), F.lit(2)).alias("f"), band(F.lit(69.9), {"HIGH": 70, "MEDIUM": 45}, "LOW").alias("g")).first()
    assert tuple(row) == (0.0, 0.0, 100.0, 50.0, 0.0, True, "MEDIUM")


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError, match="sum"):
        GapConfig(demand=0.5)
    with pytest.raises(ValueError, match="sum"):
        PriorityConfig(weights={"demand": 0.5})
