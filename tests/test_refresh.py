"""Refreshing a part equals analysing everything; equal tables are not analysed again."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardloom.config import IntelConfig
from wardloom.operators import intel, refresh
from wardloom.sources.store import Store

DAY = dt.date(2024, 6, 1)


def tables(spark, wards, seed=0, factor=1):
    """Wards as code -> (lat, lon), with demand, windows, gaps and projects that follow from the code and the seed."""
    rng = {w: random.Random(f"{seed if w.endswith('1') else 0}{w}") for w in wards}
    rows = {n: [] for n in refresh.INPUTS}
    for w, (lat, lon) in wards.items():
        r = rng[w]
        rows["wards"].append((w, w, f"D{w[1]}", "S", lat, lon, r.randint(500, 9000)))
        for s in ("WATER", "ROAD"):
            rows["citizen_demand"].append((w, s, "C", 90, r.randint(0, 40) * factor, r.randint(0, 3), 1.0 + r.randint(0, 4)))
            rows["demand_windows"] += [(w, s, 30, b, r.randint(0, 60), 0, 2.0) for b in range(r.randint(0, 4))]
            rows["gaps"].append((w, s, float(r.randint(0, 100)), r.choice(["LOW", "CRITICAL"])))
            rows["projects"].append((f"P{w}{s}", w, s, r.choice(["PLANNED", "COMPLETED"]), "T", 900.0, float(r.randint(0, 900)), dt.date(2024, 1, 1), r.randint(100, 900), 0))
    return {n: spark.createDataFrame(v, refresh.INPUTS[n]) for n, v in rows.items()}


def rows(df, digits=6):
    cut = lambda v: round(v, digits) if isinstance(v, float) else tuple(sorted(v)) if isinstance(v, list) else v
    return sorted((tuple(cut(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


def whole(t):
    """All results, analysed at once."""
    spots = intel.hotspots(t["wards"], t["citizen_demand"], lists=False)
    risks = intel.risks(t["demand_windows"], t["projects"], t["gaps"], DAY)
    return rows(spots), rows(intel.trends(t["demand_windows"])), rows(risks), rows(intel.clusters(t["wards"], intel.near_pairs(t["wards"])))


def kept(store):
    at = store.snapshot()
    return rows(refresh.hotspots(at)), rows(refresh.standing(at, "trends")), rows(refresh.standing(at, "risks")), rows(refresh.members(at))


FIRST = {"W01": (10.0, 78.0), "W02": (10.05, 78.0), "W03": (10.10, 78.0), "W04": (10.15, 78.0), "W11": (12.0, 78.0), "W12": (12.0, 78.05), "W21": (14.0, 78.0), "W31": (None, None)}
# the chain breaks, a ward comes between others, one is gone, one moves beside another
SECOND = {"W01": (10.0, 78.0), "W02": (10.05, 78.0), "W04": (10.15, 78.0), "W05": (10.6, 78.0), "W11": (12.0, 78.0), "W12": (10.62, 78.02), "W21": (12.02, 78.0), "W31": (None, None)}


def test_refresh_equals_analysis_of_everything(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    refresh.refresh(store, tables(spark, FIRST), DAY)
    t = tables(spark, SECOND, seed=1)
    run = refresh.refresh(store, t, DAY).first()
    assert (run["run_id"], run["status"], run["wards"]) == (1, "OK", 8) and run["changed_wards"] < 9
    assert kept(store) == whole(t)

    # equal tables in another order: nothing is written but the run
    before = store.snapshot().tables
    run = refresh.refresh(store, {n: df.orderBy(F.rand(3)) for n, df in t.items()}, DAY).first()
    assert (run["changed_wards"], run["changed_clusters"], run["wards"]) == (0, 0, 8)
    after = store.snapshot().tables
    assert {n for n in after if after[n] != before[n]} == {"runs"}

    # one ward's demand: this ward and its cluster alone
    t["citizen_demand"] = t["citizen_demand"].withColumn("complaint_count", F.col("complaint_count") + F.when(F.col("ward_code") == "W21", 5).otherwise(0))
    run = refresh.refresh(store, t, DAY).first()
    assert (run["changed_wards"], run["changed_clusters"]) == (1, 1)
    assert kept(store) == whole(t)


def test_a_day_changes_wards_with_projects_that_are_late_by_it(spark):
    t = refresh.inputs(tables(spark, FIRST), spark)
    digest = lambda *a: {r["ward_code"]: r["digest"] for r in refresh.digests(t, *a).collect()}
    first, near, far = digest(DAY, IntelConfig()), digest(DAY + dt.timedelta(days=1), IntelConfig()), digest(DAY + dt.timedelta(days=900), IntelConfig())
    assert sum(first[w] != near[w] for w in first) < sum(first[w] != far[w] for w in first)
    assert not set(first.values()) & set(digest(DAY, IntelConfig(spike_min=1)).values())


def test_a_set_status_outlives_runs_failed_ones_and_killed_ones(spark, tmp_path):
    store, t = Store(spark, str(tmp_path)), tables(spark, {"W01": (10.0, 78.0), "W11": (12.0, 78.0)})
    refresh.refresh(store, t, DAY)
    code = refresh.risks(store.snapshot()).agg(F.min("risk_code")).first()[0]
    assert refresh.set_risk_status(store, code, "DISMISSED") and not refresh.set_risk_status(store, "SPIKE:NO:WATER", "OPEN")
    with pytest.raises(ValueError, match="unknown status"):
        refresh.set_risk_status(store, code, "GONE")
    good = kept(store)
    bad = t["gaps"].withColumn("gap_score", F.raise_error(F.lit("no gaps")).cast("double"))
    with pytest.raises(Exception, match="no gaps"):
        refresh.refresh(store, t | {"gaps": bad}, DAY)
    killed = spark.createDataFrame([(2, "RUNNING", "api", dt.datetime(2024, 1, 1), None, None, None, None, None)], refresh.RUN)
    store.commit(refresh.WRITER, 4, {"runs": (killed, ["run_id"])})
    assert refresh.refresh(store, t, DAY, IntelConfig(change_pct=9.5)).first()["run_id"] == 3
    assert kept(store) == good
    assert {r["run_id"]: r["status"] for r in store.snapshot().table("runs").collect()} == {0: "OK", 1: "FAILED", 2: "FAILED", 3: "OK"}
    assert {r["risk_code"] for r in refresh.risks(store.snapshot()).where("status = 'DISMISSED'").collect()} == {code}


def test_absent_empty_and_null(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert refresh.refresh(store, {}, DAY).first()["wards"] == 0
    t = tables(spark, FIRST)
    nulls = spark.createDataFrame([(None,) * 7, ("W99",) + (None,) * 6, ("W99",) + (None,) * 6], refresh.INPUTS["wards"])
    run = refresh.refresh(store, {"wards": t["wards"].unionByName(nulls).withColumn("extra", F.lit(1)), "citizen_demand": t["citizen_demand"]}, DAY).first()
    assert (run["status"], run["wards"]) == ("OK", 9)
    refresh.refresh(store, {}, DAY)
    assert kept(store) == ([], [], [], [])
