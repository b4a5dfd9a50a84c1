"""Parameters that are given filter, absent ones do not, wrong ones are refused."""

import datetime as dt

import pytest

from wardloom.operators import reads

GAP = "ward_code string, sector string, gap_score double, severity string"


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame([("W1", "WATER", 80.0, "CRITICAL"), ("W1", "ROAD", 60.0, "HIGH"), ("W2", "WATER", 80.0, "CRITICAL"), ("W2", "ROAD", 0.0, "LOW"), (None, None, None, None)], GAP)


def test_absent_parameters_do_not_filter(gaps):
    found = lambda **k: [(r["ward_code"], r["sector"]) for r in reads.gaps(gaps, **k).collect()]
    assert found() == found(ward_code=None, sector="", severity=None, min_score=None) == [("W1", "WATER"), ("W2", "WATER"), ("W1", "ROAD"), ("W2", "ROAD"), (None, None)]
    assert found(sector="ROAD", min_score=0) == [("W1", "ROAD"), ("W2", "ROAD")]
    assert found(ward_code="W2", severity="CRITICAL", min_score=50.5) == [("W2", "WATER")]
    assert found(limit=1, offset=1) == [("W2", "WATER")] and found(ward_code="W9") == []


def test_wrong_parameters_are_refused(gaps):
    for wrong, error in (({"sector": "GARDENS"}, ValueError), ({"sector": 3}, TypeError), ({"min_score": "80"}, TypeError), ({"min_score": True}, TypeError), ({"colour": "red"}, TypeError), ({"limit": 0}, ValueError), ({"limit": 501}, ValueError), ({"offset": -1}, ValueError)):
        with pytest.raises(error):
            reads.gaps(gaps, **wrong)


def test_filters_reach_the_scan(spark, gaps, tmp_path, capsys):
    gaps.write.parquet(f"{tmp_path}/gaps")
    reads.gaps(spark.read.parquet(f"{tmp_path}/gaps"), sector="WATER", min_score=10, limit=5).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(sector,WATER)" in plan and "GreaterThanOrEqual(gap_score,10.0)" in plan and "TakeOrderedAndProject" in plan


def test_quotes_are_values(gaps):
    assert reads.gaps(gaps, ward_code="W1' or '1'='1").isEmpty()


def test_orders_and_latest(spark):
    risks = spark.createDataFrame([("A", "SPIKE", "LOW", 0.9), ("B", "SPIKE", "CRITICAL", 0.1), ("C", "SPIKE", "CRITICAL", 0.8), ("D", "SPIKE", "ODD", 1.0)], "risk_code string, risk_type string, severity string, confidence double")
    assert [r["risk_code"] for r in reads.risks(risks).collect()] == ["C", "B", "A", "D"]
    day = [dt.datetime(2024, 1, n) for n in (1, 2)]
    moved = spark.createDataFrame([("P", "W1", "ROAD", "D", day[0]), ("P", "W2", "ROAD", "D", day[1])], "project_code string, ward_code string, sector string, district string, snapshot_at timestamp")
    assert reads.latest_projects(moved, ward_code="W1").isEmpty() and reads.latest_projects(moved, ward_code="W2", sector="ROAD").count() == 1
    events = spark.createDataFrame([(2, "FAILED", day[0]), (1, "PENDING", day[0]), (3, "PUBLISHED", day[0]), (0, "PENDING", day[1])], "event_id int, status string, created_at timestamp")
    assert [r["event_id"] for r in reads.pending_events(events).collect()] == [1, 2, 0]
    ranks = spark.createDataFrame([(1, "Salem", "HIGH"), (2, "SALEM", "LOW"), (3, "Erode", "HIGH")], "rank int, district string, band string")
    assert [r["rank"] for r in reads.priorities(ranks, district="salem", band="high").collect()] == [1]
    with pytest.raises(ValueError, match="unknown band"):
        reads.priorities(ranks, band="TOP")


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "ward_code string, sector string, risk_code string, risk_type string, severity string, confidence double, status string")
    assert set(reads.risk_summary(none).first()) == {0}
    assert reads.risk_summary(spark.createDataFrame([("W", "ROAD", "a", "SPIKE", "LOW", 0.5, "OPEN"), ("W", "ROAD", "b", "NEW_CATEGORY", "LOW", 0.5, "RESOLVED"), ("W", "WATER", "c", "SPIKE", "HIGH", 0.5, "OPEN")], none.schema)).first().asDict() == {"total": 3, "open": 2, "spike": 2, "new_category": 1, "deteriorating_with_spend": 0, "stalled_absorption": 0, "critical_concentration": 0, "low": 2, "medium": 0, "high": 1, "critical": 0, "confirmatory": 2}


def test_refreshes_read_tables_that_are_made_once(spark, monkeypatch):
    from wardloom.plans import read_queries
    from wardloom.sources.testdata import Tables

    given = []
    monkeypatch.setattr(read_queries.refresh, "refresh", lambda store, tables, as_of: given.append(tables))
    sf_dir = "/root/testdata/sf0.001"
    read_queries._refreshed(Tables(spark, sf_dir))
    assert len(given) == 3 and all(sf_dir not in f for tables in given for df in tables.values() for f in df.inputFiles())
    assert given[1]["demand_windows"].inputFiles() == given[2]["demand_windows"].inputFiles() != []
