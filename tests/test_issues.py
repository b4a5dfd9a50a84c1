"""Issue groups against one pass in order of time, over edges, poles and 180 degrees, in batches and streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardloom.config import DedupConfig
from wardloom.functions.grid import tiles
from wardloom.operators import issues
from wardloom.operators.issues import Group, best_of, group_issues, issue_totals, match_issues, metres, regroup, states, text_similarity
from wardloom.sources.store import Store
from wardloom.streaming.issues import ASSIGNED, REPORTS, IssueStream

SCHEMA = "report_id string, category string, sub_category string, at timestamp, lat double, lon double, district string, state string, text string, severity double"
START = dt.datetime(2024, 1, 1)
TEXTS = ["pothole on the main road near the school", "large pothole main road by school", "street light broken", "no water since monday", "garbage not collected", None, "", "water"]


def report(i, hours, lat=None, lon=None, district=None, state=None, text=TEXTS[0], category="ROAD", sub="DAMAGED_ROAD", severity=3.0):
    return (i, category, sub, START + dt.timedelta(hours=hours) if hours is not None else None, lat, lon, district, state, text, severity)


def one_pass(rows, c=DedupConfig()):
    groups, out = {}, {}
    micros = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    for i, cat, sub, at, lat, lon, district, state, text, _ in sorted((r for r in rows if None not in r[:4]), key=lambda r: (r[3], r[0])):
        if lat is None or lon is None or not -90 <= lat <= 90 or not -180 <= lon <= 180:
            lat = lon = None
        known = groups.setdefault((cat, sub), {})
        g, _ = best_of(known.values(), micros(at), lat, lon, district, state, text, c)
        if g is None:
            g = known[i] = Group(i, micros(at), lat, lon, district, state, text)
        else:
            g.last, g.district, g.state = max(g.last, micros(at)), g.district or district, g.state or state
        out[i] = g.id
    return out | {r[0]: None for r in rows if None in r[:4]}


def got(df):
    return {r["report_id"]: r["group_id"] for r in df.collect()}


def scattered(seed, n=260):
    rng = random.Random(seed)
    corners = [(12.9, 77.6), (12.9, 77.6), (0.0, 180.0), (89.999, 10.0), (-45.0, -0.1)]
    out = []
    for i in range(n):
        lat, lon = rng.choice(corners)
        lat, lon = min(90.0, lat + rng.gauss(0, 0.006)), lon + rng.gauss(0, 0.006)
        lon = lon - 360 if lon > 180 else lon
        place = rng.choice([(lat, lon, None, None), (lat, lon, "D1", "S1"), (lat, lon, None, "S1"), (None, None, rng.choice(["D1", "D2"]), "S1"), (None, None, None, "S1"), (None, None, None, None), (91.0, lon, "D1", None)])
        out.append(report(f"R{i:04d}", rng.randrange(2400) / rng.choice([1, 3]), *place, rng.choice(TEXTS), rng.choice(["ROAD", "ROAD", "WATER"])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_one_pass(spark, seed):
    rows = scattered(seed)
    assert got(group_issues(spark.createDataFrame(rows, SCHEMA).repartition(3))) == one_pass(rows)


def test_chain_over_many_tiles(spark):
    """Reports 700 m apart along a parallel, in order of time: which ones open groups depends on all before them, over every edge."""
    rows = [report(f"R{i:03d}", i, 10.0, 20.0 + i * 0.0064) for i in range(60)]
    want = one_pass(rows)
    assert len(set(want.values())) > 20 and got(group_issues(spark.createDataFrame(rows, SCHEMA))) == want


def test_only_homes_decide_at_first(spark, monkeypatch):
    """Reports within one tile, near its edges: no tile without reports of its own is dealt any."""
    rows, dealt, decided = [report(f"R{i:02d}", i, 10.001, 78.015 + i * 0.0001) for i in range(20)], [], issues._decided
    monkeypatch.setattr(issues, "_decided", lambda rows, c: dealt.append(rows.count()) or decided(rows, c))
    assert got(group_issues(spark.createDataFrame(rows, SCHEMA))) == one_pass(rows) and dealt == [20]


def test_defined_cases(spark):
    rows = [
        report("a", 0, 12.99999, 77.0), report("b", 1, 13.00001, 77.0), report("c", 2, 60.0, 179.9999), report("d", 3, 60.0, -179.9999), report("e", 800, 12.99999, 77.0), report("f", 10, 12.99999, 77.0, text="street light broken"),
        report("g", None, 1.0, 1.0), report(None, 1, 1.0, 1.0), report("h", 1, 1.0, 1.0, category=None), report("i", 5, text=None), report("j", 6, text=None), report("k", 7, district="X"), report("l", 8, district="x"), report("a", 50, 12.99999, 77.0),
    ]
    found = got(group_issues(spark.createDataFrame(rows, SCHEMA)))
    assert found == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e", "f": "f", "g": None, None: None, "h": None, "i": "i", "j": "i", "k": "k", "l": "l"} | {"j": found["j"]}
    assert group_issues(spark.createDataFrame([], SCHEMA)).count() == 0


def test_batches_go_on_where_the_last_ended(spark):
    rows = scattered(3, 150)
    rows.sort(key=lambda r: (r[3], r[0]))
    first = group_issues(spark.createDataFrame(rows[:70], SCHEMA)).checkpoint()
    second = group_issues(spark.createDataFrame(rows[70:], SCHEMA), earlier=states(first))
    assert got(first) | got(second) == one_pass(rows)


def test_processed_again(spark):
    rows = [report("a", 0, 12.0, 77.0), report("b", 1, 12.0, 77.0), report("c", 2, 12.0, 77.0, text="street light broken", category="ELECTRICITY", sub="STREET_LIGHTING")]
    table = spark.createDataFrame(rows, SCHEMA)
    found = group_issues(table).checkpoint()
    counts = lambda a: {r["group_id"]: r["report_count"] for r in issue_totals(a, table).collect()}
    assert counts(found) == {"a": 2, "c": 1}
    same, groups = regroup(found.select("report_id", "group_id"), states(found), table)
    same, groups = regroup(same.checkpoint(), groups.checkpoint(), table)
    assert counts(same) == {"a": 2, "c": 1} and {r["group_id"] for r in groups.collect()} == {"a", "c"}
    moved, groups = regroup(found.select("report_id", "group_id"), states(found), spark.createDataFrame([report("c", 2, 12.0, 77.0), report("a", 0, 50.0, 50.0)], SCHEMA))
    assert got(moved) == {"a": "a~2", "b": "a", "c": "a"} and counts(moved) == {"a": 2, "a~2": 1} and {r["group_id"] for r in groups.collect()} == {"a", "a~2"}
    back, groups = regroup(moved.checkpoint(), groups.checkpoint(), spark.createDataFrame([report("a", 0, -50.0, 50.0)], SCHEMA))
    assert got(back)["a"] == "a~3" and {r["group_id"] for r in groups.collect()} == {"a", "a~3"}


def test_processed_again_after_later_groups_were_opened(spark):
    """A group without a text is joined for longer than the horizon, then one that fits better by text opens at its place."""
    rows = [report("a", 0, 12.0, 77.0, text=None), report("b", 700, 12.0, 77.0), report("c", 1400, 12.0, 77.0), report("d", 2400, 12.0, 77.0)]
    table = spark.createDataFrame(rows, SCHEMA)
    found = group_issues(table).checkpoint()
    assert got(found) == {"a": "a", "b": "a", "c": "a", "d": "d"}
    same, groups = regroup(found, states(found), table)
    assert got(same) == got(found) and {r["group_id"] for r in groups.collect()} == {"a", "d"}
    moved, _ = regroup(same.checkpoint(), groups, spark.createDataFrame([report("b", 700, 50.0, 50.0)], SCHEMA))
    assert got(moved) == got(found) | {"b": "b"}


def test_all_processed_again(spark):
    table = spark.createDataFrame(scattered(7), SCHEMA)
    found = group_issues(table).checkpoint()
    same, _ = regroup(found, states(found), table)
    assert got(same) == got(found)


def test_matches_with_groups_that_stand(spark):
    groups = spark.createDataFrame([("g1", *r[1:3], *r[4:9], r[3]) for r in (report("", 0, 0.0, 179.9999), )] + [("g2", *r[1:3], *r[4:9], r[3]) for r in (report("", 5, 85.0, 10.0), )] + [("g3", *r[1:3], *r[4:9], r[3]) for r in (report("", 5, district="D", text=None), )], "group_id string, category string, sub_category string, lat double, lon double, district string, state string, text string, last timestamp")
    rows = [report("a", 1, 0.0, -179.9999), report("b", 1, 85.0, 10.09), report("c", 1, district="D"), report("d", 1, district="E"), report("e", 1), report("f", 1, 12.0, 77.0), report("g", 1, 0.0, 179.9999, text="street light broken"), report("h", 900, 0.0, 179.9999)]
    found = match_issues(spark.createDataFrame(rows, SCHEMA), groups)
    assert got(found) == {"a": "g1", "b": "g2", "c": "g3"} and all(r["score"] >= 0.55 for r in found.collect())


def test_matches_of_crowded_places(spark, monkeypatch):
    """More groups at a place, in a district and without any place than count, and reports dealt to several tasks: the matches are those of a comparison with all groups."""
    monkeypatch.setattr(issues, "CROWD", 30)
    c = DedupConfig(candidates=5)
    given, rng = scattered(9, 240), random.Random(9)
    rows = [(*r[:4], *((12.9, 77.6) if r[4] and rng.random() < 0.5 else r[4:6]), *r[6:]) for r in given]
    micros = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    valid = lambda r: r[4] is not None and -90 <= r[4] <= 90
    stand = [(f"g{r[0]}", *r[1:3], *(r[4:6] if valid(r) else (None, None)), *r[6:9], r[3]) for r in rows[:160]]
    groups = spark.createDataFrame(stand, "group_id string, category string, sub_category string, lat double, lon double, district string, state string, text string, last timestamp")
    assert issues._newest(groups, c).where("lat = 12.9 and lon = 77.6").groupBy("category", "sub_category").count().agg(F.max("count")).first()[0] == 5
    found = {r["report_id"]: (r["group_id"], r["score"]) for r in match_issues(spark.createDataFrame(rows[100:], SCHEMA), groups, c).collect()}
    want = {}
    for r in rows[100:]:
        known = [Group(g[0], micros(g[8]), *g[3:8]) for g in stand if g[1:3] == r[1:3]]
        g, score = best_of(iter(known), micros(r[3]), *(r[4:6] if valid(r) else (None, None)), *r[6:9], c)
        if g:
            want[r[0]] = (g.id, score)
    assert len(want) > 60 and found == want


def test_standing_groups_in_small_steps(monkeypatch):
    monkeypatch.setattr(issues, "CHUNK", 7)
    monkeypatch.setattr(issues, "PLACES_KEPT", 3)
    rng, c = random.Random(10), DedupConfig(candidates=20)
    rows = [(f"g{i:03d}", rng.randrange(100) * 10**9, 12.9 + rng.gauss(0, 0.005), rng.choice([180.0, -180.0]) + rng.gauss(0, 0.001), " ".join(rng.choice("abcdefgh") * 3 for _ in range(6)) if i % 9 else None) for i in range(300)]
    standing = issues.Standing(rows, c, issues.Similarities())
    for _ in range(200):
        at, lat, lon, text = rng.randrange(200) * 10**9, 12.9 + rng.gauss(0, 0.005), 179.999, rng.choice([None, "aaa bbb ccc", rows[1][4]])
        g, score = best_of((Group(i, last, a, o, None, None, t) for i, last, a, o, t in rows), at, lat, lon, None, None, text, c)
        assert standing.best(at, lat, lon, None, None, text) == (g and g.id, score)


def test_tiles(spark):
    rng = random.Random(1)
    points = [(rng.choice([rng.uniform(-90, 90), 90.0, -90.0, 89.99, 0.0]), rng.choice([rng.uniform(-180, 180), 180.0, -180.0])) for _ in range(300)]
    near = []
    for lat, lon in points:
        for _ in range(4):
            b = min(90.0, max(-90.0, lat + rng.uniform(-0.02, 0.02)))
            near.append((lat, lon, b, (lon + rng.uniform(-0.05, 0.05) + 180) % 360 - 180 if abs(lat) < 89 else rng.uniform(-180, 180)))
    rows = spark.createDataFrame(near, "a double, b double, c double, d double")
    seen = rows.select("*", tiles(F.col("a"), F.col("b"), 0.1, 2000).alias("t"), tiles(F.col("c"), F.col("d"), 0.1)[0].alias("own")).collect()
    close = [r for r in seen if metres(r["a"], r["b"], r["c"], r["d"]) <= 2000]
    assert len(close) > 200 and all(r["own"] in r["t"] for r in close)
    assert max(len(r["t"]) for r in seen if abs(r["a"]) < 80) <= 4


def test_text_similarity():
    import difflib

    rng = random.Random(4)
    for _ in range(300):
        a, b = (" ".join(rng.choice(["road", "water", "pipe", "near", "x"]) for _ in range(rng.randrange(1, 6))) for _ in range(2))
        x, y = set(a.split()), set(b.split())
        want = 1.0 if a in b or b in a else (difflib.SequenceMatcher(None, a, b).ratio() + len(x & y) / len(x | y)) / 2
        assert text_similarity(a, b) == want and text_similarity(a, b, 0.6) in (want, 0.0) and (want < 0.6 or text_similarity(a, b, 0.6) == want)


def test_streams_in_any_order_of_arrival(spark, tmp_path):
    """Shuffled within a day, delivered in files, stopped and started anew, with replays: the groups are those of one pass."""
    rows = [r for r in scattered(5, 160) if r[0]]
    rng = random.Random(6)
    arrived = sorted(rows, key=lambda r: r[3] + dt.timedelta(hours=rng.uniform(0, 20)))
    schema = spark.createDataFrame([], SCHEMA).schema
    store = Store(spark, str(tmp_path / "store"))

    def run(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(IssueStream(store).merge).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    run(arrived[:60])
    run(arrived[40:110])
    early = store.snapshot().table(ASSIGNED).count()
    assert 0 < early < 110
    run(arrived[100:] + arrived[:5])
    flow = IssueStream(store)
    flow.merge(spark.createDataFrame(arrived[:50], SCHEMA), 2)
    flow.finish()
    assert got(store.snapshot().table(ASSIGNED)) == one_pass(rows)
    totals = issue_totals(store.snapshot().table(ASSIGNED), store.snapshot().table(REPORTS))
    assert sum(r["report_count"] for r in totals.collect()) == len(rows)
