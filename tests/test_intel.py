"""Trends, risks, places, snapshots, priorities, records and streams on small inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from wardloom.operators import intel, issues, priority, records
from wardloom.sources import io
from wardloom.streaming import ingest

WINDOW = "ward_code string, sector string, window_days int, bucket int, complaint_count long, critical_count long, avg_severity double"


def windows(spark, *counts, start=0):
    return spark.createDataFrame([("W1", "WATER", 30, start + i, n, 0, 3.0) for i, n in enumerate(counts)], WINDOW)


@pytest.mark.parametrize(("counts", "direction"), [((10, 15, 20), "WORSENING"), ((20, 10), "IMPROVING"), ((10,), "UNKNOWN"), ((10, 10), "STABLE"), ((100, 10, 10, 200), "WORSENING")])
def test_trend_direction(spark, counts, direction):
    row = intel.trends(windows(spark, *counts)).first()
    assert row["direction"] == direction and row["series"] == ",".join(map(str, counts))


def test_spike_and_new_category(spark):
    pairs = spark.createDataFrame([("W1", "WATER", 30, 60, 10), ("W2", "WATER", 30, 20, 10), ("W3", "WATER", 30, 3, 1), ("W4", "WATER", 30, 4, 0)], "ward_code string, sector string, window_days int, recent long, previous long")
    found = {r["ward_code"]: (r["severity"], r["confidence"]) for r in intel.spikes(pairs).collect()}
    assert found == {"W1": ("CRITICAL", 0.7), "W2": ("MEDIUM", 0.6)}
    assert [r["ward_code"] for r in intel.new_categories(pairs).collect()] == ["W4"]


def test_clusters_of_a_chain(spark):
    points = spark.createDataFrame([(f"W{i:02d}", 10.0, 78.0 + 0.1 * i) for i in range(12)] + [("Z", 12.0, 70.0)], "ward_code string, latitude double, longitude double")
    pairs = intel.near_pairs(points)
    assert pairs.count() == 11
    assert {r["cluster"] for r in intel.clusters(points, pairs).collect()} == {"W00", "Z"}


def test_box_before_nearest(spark):
    wards = spark.createDataFrame([("A", 10.0, 78.0), ("B", 10.01, 78.0), ("C", 10.2, 78.0)], "ward_code string, latitude double, longitude double")
    points = spark.createDataFrame([(1, 10.005, 78.0), (2, 10.12, 78.0), (3, 50.0, 0.0)], "point_id long, lat double, lon double")
    assert {r["point_id"]: (r["ward_code"], r["method"]) for r in intel.assign_to_ward(points, wards).collect()} == {1: ("A", "BOX"), 2: ("C", "NEAREST"), 3: (None, "NONE")}


def test_snapshots(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, at int")
    new = spark.createDataFrame([("a", 1, 2), ("b", 2, 2), ("c", 3, 2)], "k string, v int, at int")
    assert {r["k"] for r in intel.insert_if_changed(old, new, ["k"], ["v"], "at").collect()} == {"b", "c"}
    assert intel.insert_if_absent(old, new, ["k"]).count() == 3
    assert {(r["k"], r["v"], r["at"]) for r in intel.upsert(old, new, ["k"], ["at"]).collect()} == {("a", 1, 1), ("b", 2, 1), ("c", 3, 2)}
    assert intel.latest(old.unionByName(new), ["k"], "at", ties=True).count() == 3


def test_priority_golden(spark):
    row = ("H1", "D", 20_000, 240, 1, 2, 3.75, 55.0, "WORSENING", 47.5, "WATER", 4 / 7, 0.6571, 70.0, 12.0)
    cols = "cluster string, district string, population long, complaints long, critical long, wards long, avg_severity double, pct_growth double, trend_direction string, gap_score double, dominant_sector string, stalled_share double, unspent_share double, delay_days double, rate double"
    got = priority.action_plan(priority.ranked(priority.scored(spark.createDataFrame([row], cols)))).first()
    assert (got["score"], got["band"], got["cost_lakhs"], got["rank"]) == (75.1, "HIGH", 113.1, 1)
    unmeasured = priority.scored(spark.createDataFrame([(*row[:6], None, None, "UNKNOWN", None, None, None, None, None, None)], cols)).first()
    assert unmeasured["score"] == 0.0 and unmeasured["unmeasured"] == "demand, severity, trend, coverage, service_failure"


def test_classification_and_severity(spark):
    rows = spark.createDataFrame([(1, "There is a pothole on the broken road"), (2, "No water, no drinking water for 9 days"), (3, "hello"), (4, None)], "id long, text string")
    got = {r["id"]: r["category"] for r in records.classify(rows, "id", "text").collect()}
    assert got == {1: "ROAD", 2: "WATER", 3: "UNKNOWN", 4: "UNKNOWN"}
    assert [r[0] for r in rows.orderBy("id").select(records.severity("text", F.lit(0))).collect()] == [4, 2, 2, 2]
    found = {(r["type"], r["value"]) for r in records.entities(spark.createDataFrame([(1, "call 9876543210 at 600042 since 3 days, 12.9249, 80.1000")], "id long, text string"), "id", "text").collect()}
    assert found == {("PHONE", "9876543210"), ("PINCODE", "600042"), ("DURATION", "since 3 days"), ("DURATION", "since"), ("COORDINATE", "12.9249, 80.1000")}


def test_issue_groups_follow_time(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("R1", "ROAD", "S", 12.9249, 80.1, t0, "big pothole near school"), ("R2", "ROAD", "S", 12.9250, 80.1001, t0 + dt.timedelta(hours=2), "pothole near school"), ("R3", "ROAD", "S", 12.95, 80.2, t0, "pothole near school"), ("R4", "ROAD", "S", 12.9249, 80.1, t0 + dt.timedelta(days=60), "big pothole near school")]
    df = spark.createDataFrame(rows, "report_id string, category string, sub_category string, lat double, lon double, at timestamp, text string")
    assert {r["report_id"]: r["group_id"] for r in issues.group_issues(df).collect()} == {"R1": "R1", "R2": "R1", "R3": "R3", "R4": "R4"}


def test_envelopes(spark):
    lines = [json.dumps({"correlation_id": "R1", "payload": {}}), json.dumps({"payload": {"request_id": "R2"}}), json.dumps({"correlation_id": "", "request_id": "", "payload": {}}), '{"payload":"not-a-dict"}', "not-an-object"]
    good, bad = io.parsed(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {r["request_key"] for r in good.collect()} == {"R1", "R2"} and bad.count() == 3


def test_sequential_ids_without_one_task(spark):
    rows = io.request_ids(spark.range(1000).repartition(7), "id", 2026).collect()
    assert sorted(r["request_no"] for r in rows) == [f"REQ-2026-{i:06d}" for i in range(1, 1001)]
    assert all(r["request_no"] == f"REQ-2026-{r['id'] + 1:06d}" for r in rows)


def test_missing_table_is_empty(spark, tmp_path):
    schema = spark.range(1).schema
    assert io.read_table(spark, str(tmp_path / "none"), schema).count() == 0


def test_stream_drops_replays(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"request_id": r, "timestamp": "2024-01-01 00:00:00", "payload": {}}) for r in ("A", "B", "A")]
    (tmp_path / "in" / "1.txt").write_text("\n".join([*lines, "broken"]))
    seen = []
    q = ingest.merge_batches(ingest.unique_requests(ingest.envelopes(spark, str(tmp_path / "in"))), lambda batch, n: seen.extend(r["request_key"] for r in batch.collect()), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert sorted(seen) == ["A", "B"]


def test_stream_state(spark, tmp_path):
    spark.createDataFrame([("ROAD", "S", 3), ("ROAD", "S", 5), ("ROAD", "S", None), ("WATER", None, None)], "category string, sub_category string, severity int").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("category string, sub_category string, severity int").parquet(str(tmp_path / "in"))
    seen = []
    q = ingest.stream_issue_counts(rows).writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["category"], r["report_count"], r["severity_max"]) for r in seen} == {("ROAD", 3, 5), ("WATER", 1, None)}


def test_nearest_ward_at_high_latitude(spark):
    # 0.47 degrees of longitude at 60 degrees north are 26 km, 0.44 are 24.5 km; both lie two cells of 0.25 degrees away
    wards = spark.createDataFrame([("E", 60.1, 10.68), ("F", 60.1, 40.71)], "ward_code string, latitude double, longitude double")
    points = spark.createDataFrame([(1, 60.1, 10.24), (2, 60.1, 40.24)], "point_id long, lat double, lon double")
    got = intel.assign_to_ward(points, wards)
    assert {r["point_id"]: (r["ward_code"], r["method"]) for r in got.collect()} == {1: ("E", "NEAREST"), 2: (None, "NONE")}


def test_group_queries_take_all_categories(spark):
    from wardloom.plans import all_queries

    sf_dir = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.format_string("R%08d", "event_id").alias("report_id"), "event_type")
    assert all_queries()["i6_issue_groups"](spark, sf_dir).count() == events.count()
    matched = all_queries()["c8_best_match"](spark, sf_dir).join(events, "report_id")
    assert {r[0] for r in matched.select("event_type").distinct().collect()} == {r[0] for r in events.select("event_type").distinct().collect()}


@pytest.mark.parametrize(("direct", "few", "gap", "n"), [(10**6, 1024, 1.0005, 3), (0, 16, 0.9995, 2)])
def test_clusters_without_all_pairs(spark, monkeypatch, direct, few, gap, n):
    """Two dense groups a hair more or less than the radius apart, over 180 degrees, and a place with many wards; no pairs are listed."""
    monkeypatch.setattr(intel, "DIRECT_PAIRS", direct)
    monkeypatch.setattr(intel, "FEW_PAIRS", few)
    schema, step = "ward_code string, latitude double, longitude double", 12_000 / 111_195.08
    rows = [(f"W{i:03d}", 10.0 - i % 7 * 1e-4 if i % 2 else 10.0 + step * gap + i % 7 * 1e-4, (180.0 if i % 3 else -180.0) if i % 5 else 179.99) for i in range(120)] + [("N", None, 1.0)]
    points = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, intel.near_clusters(points).collect()))
    assert got == sorted(map(tuple, intel.clusters(points, intel.near_pairs(points)).collect())) and len({c for _, c in got}) == n


@pytest.mark.parametrize("direct", [10**6, 0])
def test_a_ward_code_at_several_places_is_one_row(spark, monkeypatch, direct):
    """A code that several wards have links their places, as clusters of pairs of codes do."""
    monkeypatch.setattr(intel, "DIRECT_PAIRS", direct)
    rows = [("W1", 10.0, 78.0), ("W2", 10.01, 78.0), ("W2", 20.0, 78.0), ("W3", 20.01, 78.0), ("W1", 30.0, 78.0), ("W4", 30.05, 78.0), ("W4", None, 78.0), ("W5", 40.0, 78.0), ("W6", None, 78.0)]
    points = spark.createDataFrame(rows, "ward_code string, latitude double, longitude double")
    assert sorted(map(tuple, intel.near_clusters(points).collect())) == [("W1", "W1"), ("W2", "W1"), ("W3", "W1"), ("W4", "W1"), ("W5", "W5"), ("W6", "W6")]


@pytest.mark.parametrize("name", ["h19_priority_scores", "e5_rank_fraction"])
def test_demand_is_made_once(spark, monkeypatch, name):
    """What reads the citizens' demand reads a stored table, not lineitem grouped again."""
    from wardloom.operators import mesh
    from wardloom.plans import all_queries

    read = []
    for module, of, at in ((intel, "ward_signals", 1), (mesh, "demand_by_ward", 0), (priority, "signals", 2)):
        own = getattr(module, of)
        monkeypatch.setattr(module, of, lambda *a, own=own, at=at: read.append(a[at].inputFiles()) or own(*a))
    assert all_queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert read and not [f for files in read for f in files if "lineitem" in f]


def test_hotspots_list_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(intel, "near_pairs", None)
    wards = spark.createDataFrame([(f"W{i}", "D", 10.0, 78.0, 1000) for i in range(50)], "ward_code string, district string, latitude double, longitude double, population long")
    demand = spark.createDataFrame([("W1", "WATER", 5, 1, 2.0)], "ward_code string, sector string, complaint_count long, critical_count long, avg_severity double")
    assert [(r["cluster"], r["wards"], r["sectors"]) for r in intel.hotspots(wards, demand).collect()] == [("W0", 50, "WATER")]


def test_nearest_ward_meets_places_once(spark, monkeypatch):
    """Points and wards at one place meet once, and a far ward is sought only where none is close."""
    met, within = [], intel.within
    monkeypatch.setattr(intel, "within", lambda *a: met.append(within(*a).count()) or within(*a))
    wards = spark.createDataFrame([(f"W{i:03d}", 10.0 + i % 2 * 0.1, 78.0) for i in range(100)], "ward_code string, latitude double, longitude double")
    points = spark.createDataFrame([(i, 10.03, 78.0) for i in range(50)] + [(50, None, 1.0)], "point_id long, lat double, lon double")
    got = {tuple(r)[1:] for r in intel.assign_to_ward(points, wards).collect()}
    assert got == {("W000", "NEAREST"), (None, "NONE")} and met == [0, 2]


def test_numbers_are_printed_as_by_c(spark):
    from wardloom.functions.columns import printed

    values = [0.05, 0.15, 0.25, 1.15, 1.25, 2.35, 3.45, 9.95, 44.5, 45.5, 0.5, 1.0, 99.95, 123456.75]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", printed("v", 0), printed("v", 1)).collect()
    assert [(r[1], r[2]) for r in got] == [("%.0f" % v, "%.1f" % v) for v in values]


def test_a_text_is_made_normal_once(spark):
    from wardloom.operators import intake

    rows = spark.createDataFrame([(" a  b ",), ("N/A",), ("",), (None,)], "x string").select(intake._usable(F.col("x")).alias("y"))
    assert [r["y"] for r in rows.collect()] == ["a b", None, None, None]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("\\p{Pd}") == 1
