"""Merges by key, commits of several tables, pinned reads and the outbox, with jobs killed in between."""

import pytest
from pyspark.sql import functions as F

from wardloom.sources import outbox, store
from wardloom.sources.store import ConflictError, Store

SCHEMA = "request_id string, payload string, lineage string"


def rows(spark, *values):
    return spark.createDataFrame(values, SCHEMA)


def table(s, name="records"):
    return {tuple(r) for r in s.snapshot().table(name).collect()}


def outcomes(df):
    return {(r["key"].split('"')[3] if "{}" != r["key"] else None, r["outcome"], r["changed"], r["repeats"]) for r in df.collect()}


@pytest.mark.parametrize(
    "policy, said, left",
    [
        ("skip", ("skipped", False), {("a", "1", "x"), ("b", "2", "x"), ("c", "3", "y")}),
        ("stored", ("returned", False), {("a", "1", "x"), ("b", "2", "x"), ("c", "3", "y")}),
        ("refresh", ("refreshed", False), {("a", "1", "y"), ("b", "2", "y"), ("c", "3", "y")}),
        ("overwrite", ("overwritten", False), {("a", "9", "y"), ("b", None, "y"), ("c", "3", "y")}),
        ("update", ("updated", True), {("a", "1", "y"), ("b", "2", "y")}),
    ],
)
def test_policies(spark, tmp_path, policy, said, left):
    s = Store(spark, str(tmp_path))
    assert outcomes(s.merge("records", rows(spark, ("a", "1", "x"), ("b", "2", "x"), ("a", "5", "x")), ["request_id"], "w", 0)) == {("a", "inserted", False, 1), ("b", "inserted", False, 0)}
    again = rows(spark, ("a", "9", "y"), ("b", None, "y"), ("c", "3", "y"), (None, "4", "y"))
    for _ in range(3):  # the same batch again is one version and one outcome
        got = outcomes(s.merge("records", again, ["request_id"], "w", 1, policy, columns=["lineage"]))
        assert got == {("a", said[0], True, 0), ("b", said[0], True, 0), ("c", "unknown" if said[1] else "inserted", False, 0), (None, "rejected", False, 0)}
        assert table(s) == left and s.snapshot().version == 2
    counters = {r["batch"]: (r["processed"], r["known"], r["rejected"], r["repeats"]) for r in s.counters("records").collect()}
    assert counters == {0: (2, 0, 0, 1), 1: (0, 2, 2, 0) if said[1] else (1, 2, 1, 0)}
    assert {tuple(r) for r in s.snapshot(1).table("records").collect()} == {("a", "1", "x"), ("b", "2", "x")}


def test_insert_once(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.merge("records", rows(spark, ("a", "1", "x")), ["request_id"], "w", 0, "insert")
    with pytest.raises(ConflictError):
        s.merge("records", rows(spark, ("b", "1", "x"), ("a", "2", "x")), ["request_id"], "w", 1, "insert")
    assert table(s) == {("a", "1", "x")} and s.snapshot().version == 1
    with pytest.raises(ValueError):
        s.merge("records", rows(spark), ["request_id"], "w", 1, "replace")


def test_commits_of_two_writers(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    base = s.snapshot()
    s.commit("one", 0, {"t": (rows(spark, ("a", "1", "x")), ["request_id"])}, base)
    with pytest.raises(ConflictError):
        s.commit("two", 0, {"t": (rows(spark, ("b", "1", "x")), ["request_id"])}, base)
    s.commit("two", 0, {"t": (rows(spark, ("b", "1", "x")), ["request_id"])})
    assert table(s, "t") == {("a", "1", "x"), ("b", "1", "x")}


def test_compaction_and_empty_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "COMPACT", 2)
    s = Store(spark, str(tmp_path))
    for n in range(5):
        s.merge("records", rows(spark, *[(str(k), str(n), "x") for k in range(n)]), ["request_id"], "w", n, "overwrite")
    assert table(s) == {("0", "4", "x"), ("1", "4", "x"), ("2", "4", "x"), ("3", "4", "x")}
    assert len(s.snapshot().tables["records"]["folders"]) <= 2


def events(new):
    return new.select(F.concat(F.lit("EVT-"), "request_id").alias("event_id"), "payload", F.lit(1).alias("created_at"))


class Killed(RuntimeError):
    pass


def test_outbox_loses_and_doubles_nothing(spark, tmp_path):
    s, sent = Store(spark, str(tmp_path / "s")), str(tmp_path / "sent")
    take = lambda n, *v: s.merge("records", rows(spark, *v), ["request_id"], "w", n, with_new={outbox.OUTBOX: (events, ["event_id"])})
    take(0, ("a", "1", "x"), ("b", "bad", "x"))
    take(0, ("a", "1", "x"), ("b", "bad", "x"))
    take(1, ("a", "1", "x"), ("c", "1", "x"))
    status = lambda: {r["event_id"]: (r["status"], r["attempts"]) for r in outbox.status(s).collect()}
    assert status() == {"EVT-a": ("PENDING", 0), "EVT-b": ("PENDING", 0), "EVT-c": ("PENDING", 0)}
    send = outbox.to_files(sent, "payload <> 'bad'")

    def killed_after(df, claim):
        send(df, claim).collect()
        raise Killed

    with pytest.raises(Killed):
        outbox.dispatch(s, killed_after)
    take(2, ("d", "1", "x"))
    assert outbox.dispatch(s, send) == 0  # what was claimed is finished, with its own events
    assert status() == {"EVT-a": ("PUBLISHED", 1), "EVT-b": ("FAILED", 1), "EVT-c": ("PUBLISHED", 1), "EVT-d": ("PENDING", 0)}
    assert outbox.dispatch(s, send) == 1
    assert status()["EVT-d"] == ("PUBLISHED", 1) and status()["EVT-b"] == ("FAILED", 2)
    read = lambda: sorted(r["event_id"] for r in spark.read.json(sent).collect())
    assert read() == ["EVT-a", "EVT-c", "EVT-d"]
    for _ in range(4):
        outbox.dispatch(s, send)
    assert status()["EVT-b"] == ("FAILED", 5) and read() == ["EVT-a", "EVT-c", "EVT-d"]


def test_killed_before_the_claim(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    with pytest.raises(Killed):
        s.merge("records", rows(spark, ("a", "1", "x")), ["request_id"], "w", 0, with_new={"outbox": (lambda new: (_ for _ in ()).throw(Killed()), ["event_id"])})
    assert s.snapshot().version == 0
    assert outbox.dispatch(s, lambda df, n: df) == 0


def test_mesh_in_a_scope(spark, tmp_path):
    from wardloom.sources.mesh import profiles, read_mesh

    s = Store(spark, str(tmp_path))
    wanted = {"wards": ("ward_code", "district"), "projects": ("ward_code", "status"), "gaps": ("ward_code", "gap_score"), "citizen_demand": ("ward_code", "complaint_count")}
    assert read_mesh(s.snapshot(), None, wanted).missing == tuple(wanted)
    wards = spark.createDataFrame([("C1", "Chennai", 1), ("M1", "Madurai", 2), (None, "Madurai", 3), ("X1", None, 4)], "ward_code string, district string, more int")
    demand = spark.createDataFrame([("C1", 40), ("C1", 2), (None, 7), ("Z9", 9)], "ward_code string, complaint_count int")
    projects = spark.createDataFrame([("C1", "DELAYED", "more")], "ward_code string, status string, note string")
    s.commit("sync", 0, {"wards": (wards, []), "citizen_demand": (demand, []), "projects": (projects, [])})
    s.commit("sync", 1, {"citizen_demand": (demand, [])})
    counts = lambda *where, version=1: {r["table"]: r["rows"] for r in read_mesh(s.snapshot(version), *where, wanted).counts().collect()}
    assert counts(None) == counts([]) == {"wards": 4, "citizen_demand": 4, "projects": 1} and counts(None, version=2)["citizen_demand"] == 8
    assert counts(["Chennai"]) == {"wards": 1, "citizen_demand": 2, "projects": 1}
    assert counts(["Madurai"]) == {"wards": 2, "citizen_demand": 0, "projects": 0}
    assert counts(["Atlantis"]) == {"wards": 0, "citizen_demand": 0, "projects": 0}
    mesh = read_mesh(s.snapshot(), ["Chennai", "Madurai"], wanted)
    assert mesh.degraded == ("coverage",) and mesh.missing == ("gaps",)
    got = {r["ward_code"]: tuple(r)[2:] for r in profiles(mesh).collect()}
    assert got == {"C1": (84, None, 1, 1), "M1": (0, None, 0, 0), None: (0, None, 0, 0)}
    alone = read_mesh(s.snapshot(), ["Chennai"], {"projects": ("ward_code",)})
    assert alone.tables["projects"].count() == 0
