"""Language, cleaning, entities, places and rankings on small made tables."""

import datetime as dt

from pyspark.sql import functions as F

from wardloom.functions import grid
from wardloom.functions import text as tx
from wardloom.operators import geocode, intel, records, runs, vocabulary


def test_normal_text_folds_dashes_quotes_and_format_characters(spark):
    rows = spark.createDataFrame([("a​b ‘c’ “d” –— ﬁ … e\x07f",), (None,), ("plain  text ",)], "x string")
    assert [r[0] for r in rows.select(tx.normalize_text("x")).collect()] == ["ab 'c' \"d\" -- fi ... e f", "", "plain text"]


def test_near_pairs_at_poles_and_at_180_degrees(spark):
    points = [("a", 81.0, 10.0), ("b", 81.001, 10.01), ("c", 10.0, 179.99), ("d", 10.0, -179.99), ("e", 89.99, 0.0), ("f", 89.99, 180.0), ("g", None, 3.0)]
    got = {(r["a"], r["b"]) for r in intel.near_pairs(spark.createDataFrame(points, "ward_code string, latitude double, longitude double")).collect()}
    assert got == {("a", "b"), ("c", "d"), ("e", "f")}


def test_points_find_wards_in_the_north(spark):
    wards = spark.createDataFrame([("W1", 30.0, 77.9999), ("W2", 60.0, 179.9), ("W3", 0.0, 0.0)], "ward_code string, latitude double, longitude double")
    points = spark.createDataFrame([(1, 30.0, 78.2501), (2, 60.0, -179.8), (3, 60.0, 100.0)], "point_id int, lat double, lon double")
    got = {r["point_id"]: (r["ward_code"], r["method"]) for r in intel.assign_to_ward(points, wards).collect()}
    assert got == {1: ("W1", "NEAREST"), 2: ("W2", "NEAREST"), 3: (None, "NONE")}


def test_within_meets_each_pair_once(spark):
    rows = spark.createDataFrame([(i, -89.999 if i % 3 else 0.0, float(i * 7 % 360 - 180)) for i in range(40)], "k int, lat double, lon double")
    right = rows.toDF("k2", "lat2", "lon2")
    got = grid.within(rows, right, ("lat", "lon"), ("lat2", "lon2"), 5000.0)
    assert got.count() == got.select("k", "k2").distinct().count() and got.where("k = k2").count() == 40


def test_places_in_large_gazetteers(spark):
    aliases = spark.range(12_000).selectExpr("concat('place ', id, ' road') as alias", "id as place").unionByName(spark.createDataFrame([("x", -1)], "alias string, place long"))
    rows = spark.createDataFrame([(1, "near PLACE 77 road"), (2, "x"), (3, None), (4, "nothing")], "k int, t string")
    assert {r["k"]: r["place"] for r in geocode.by_text(rows, aliases, "k", "t").collect()} == {1: 77, 2: -1, 3: None, 4: None}


def test_gazetteer_box_comes_before_the_nearest(spark):
    places = spark.createDataFrame([("box", "D", "S", 12.0, 77.0, 12.8, 13.1, 77.4, 77.8), ("near", "D2", None, 12.96, 77.59, None, None, None, None)], "place string, district string, state string, p_lat double, p_lon double, south double, north double, west double, east double")
    rows = spark.createDataFrame([(1, None, 12.95, 77.6), (2, None, 13.2, 77.59)], "k int, t string, lat double, lon double")
    none = spark.createDataFrame([], "alias string, place string")
    countries = spark.createDataFrame([], "country string, order int, south double, north double, west double, east double")
    got = {r["k"]: (r["place"], r["method"], r["status"]) for r in geocode.geocode(rows, places, none, countries, "k", "t").collect()}
    assert got == {1: ("box", "gazetteer_bbox", "RESOLVED"), 2: ("near", "nearest_place", "RESOLVED")}


def test_spans_of_matches(spark):
    row = spark.createDataFrame([("ab12cd345",), ("",), (None,)], "t string").select(records.matches("t", r"\d+").alias("m")).collect()
    assert [tuple(x) for x in row[0]["m"]] == [("12", 2, 4), ("345", 6, 9)] and row[1]["m"] == [] and row[2]["m"] is None


def test_longest_keyword_of_a_sub_category_counts(spark):
    rows = spark.createDataFrame([("no water, water supply is off", "en", None), ("paani nahi", "romanised", None), ("road and garbage", "en", "ROAD")], "t string, l string, c string")
    got = [r[0] and (r[0]["keyword"], r[0]["sub_category"]) for r in rows.select(vocabulary.best_keyword("t", "l", "c", True)).collect()]
    assert got == [("water supply", "WATER_SUPPLY_DISRUPTION"), ("paani nahi", "WATER_SUPPLY_DISRUPTION"), None]


def test_rankings_are_archived_and_replaced(spark, tmp_path):
    folder = str(tmp_path)
    assert runs.current_ranking(spark, folder) is None
    make = lambda score: spark.createDataFrame([("H1", 1, score, "HIGH"), ("H2", 2, 5.0, "LOW")], "hotspot_code string, rank int, score double, band string")
    for i in range(3):
        runs.replace_ranking(spark, folder, make(70.0 + i), f"R{i}", dt.datetime(2024, 1, 1 + i))
    assert {(r["hotspot_code"], r["run_id"], r["score"]) for r in runs.current_ranking(spark, folder).collect()} == {("H1", "R2", 72.0), ("H2", "R2", 5.0)}
    past = spark.read.parquet(f"{folder}/history")
    assert {(r["hotspot_code"], r["run_id"]) for r in runs.history(past).collect()} == {(h, r) for h in ("H1", "H2") for r in ("R0", "R1")}
    found = {r["hotspot_code"]: (r["previous_score"], r["score_change"]) for r in runs.ranking_payload(runs.current_ranking(spark, folder), past).collect()}
    assert found == {"H1": (71.0, 1.0), "H2": (5.0, 0.0)}


def test_trends_of_hotspots_in_their_sectors(spark):
    spots = spark.createDataFrame([("c", "W1,W2", "ROAD,WATER")], "cluster string, ward_codes string, sectors string")
    trends = spark.createDataFrame([("W1", "ROAD", 1), ("W1", "HEALTHCARE", 2), ("W3", "ROAD", 3)], "ward_code string, sector string, n int")
    assert [r["n"] for r in intel.trends_of_hotspots(spots, trends).collect()] == [1]
    assert intel.missing_tables(("a", "b", "c"), ("b",)) == ("a", "c")
    risks = spark.createDataFrame([("W1", "OPEN"), ("W1", "CLOSED"), ("W2", "OPEN")], "ward_code string, status string")
    assert intel.open_risks(risks, "W1").count() == 1 and intel.open_risks(risks).where(F.col("status") == "OPEN").count() == 2


def test_times_in_any_writing(spark):
    from wardloom.operators.records import parsed_time

    five = "2024-01-05 10:00:00"
    forms = {
        "2024-01-05T10:00:00Z": five, "2024-01-05T10:00:00": five, "2024-01-05T10:00:00.000Z": five, "2024-01-05T15:30:00+05:30": five, "2024-01-05T15:30:00+0530": five, "2024-01-05 10:00": five, "20240105T100000Z": five, "2024-01-05T10:00:00.123456789Z": "2024-01-05 10:00:00.123456",
        "2024-01-05T10:00:00,5": "2024-01-05 10:00:00.5", " 05/01/2024 10:00:00 ": five, "1704448800": five, "1704448800000": five, "1704448800.0": five, "20240105": "2024-01-05 00:00:00", "2024/01/05": "2024-01-05 00:00:00", "05/01/2024": "2024-01-05 00:00:00", "05-01-2024": "2024-01-05 00:00:00", "2024-01-05": "2024-01-05 00:00:00",
        "NaN": None, "Infinity": None, "-inf": None, "1e30": None, "9e18": None, "-1e300": None, "2024-13-45": None, "2024-02-30T10:00:00Z": None, "2024-01-05T25:00:00Z": None, "": None, "soon": None, None: None, "99999999": None, "12:30": None, "2024-01-05T10:00:00+99:99": None,
    }
    rows = spark.createDataFrame([(x,) for x in forms], "x string")
    got = {r["x"]: r["at"] for r in rows.select("x", parsed_time("x").cast("string").alias("at")).collect()}
    assert got == forms


def test_no_string_ends_the_cleaning(spark):
    import random

    from wardloom.operators.intake import clean
    from wardloom.plans import all_queries  # noqa: F401
    from wardloom.sources.testdata import COMPLAINT_FIELDS

    rng = random.Random(3)
    odd = ["NaN", "Infinity", "1e30", "-", "+", "0x1", "1e", "{", '{"latitude": "x"}', "\x00", "🙂", "null", "٣", "1,5", "9" * 400, " ", "2024-99-99", "T", "%s", "\\", "12.9716", None]
    names = list(COMPLAINT_FIELDS)
    rows = [(i, *[rng.choice(odd) if rng.random() < 0.7 else "".join(rng.choice("0123456789.+-eETZ:/ abc{}\"") for _ in range(rng.randrange(24))) for _ in names]) for i in range(1000)]
    table = spark.createDataFrame(rows, "event_id long, " + ", ".join(f"{n} string" for n in names))
    assert {r[0] for r in clean(table, F.lit("2024-06-01").cast("timestamp")).select("event_id").collect()} == set(range(1000))


def test_boxes_across_180_degrees(spark):
    from wardloom.operators.geocode import by_box, country_of

    points = spark.createDataFrame([(1, -18.0, 179.5), (2, -18.0, -179.5), (3, -18.0, 0.0), (4, None, 1.0)], "id long, lat double, lon double")
    boxes = spark.createDataFrame([("Fiji", -21.0, -12.0, 177.0, -178.0), ("World", -90.0, 90.0, -180.0, 180.0)], "place string, south double, north double, west double, east double")
    assert {r["id"]: r["place"] for r in by_box(points, boxes, "id").collect()} == {1: "Fiji", 2: "Fiji", 3: "World", 4: None}
    countries = boxes.withColumnRenamed("place", "country").selectExpr("country", "cast(south as int) as order", "south", "north", "west", "east")
    assert {r["id"]: r["country"] for r in country_of(points, countries, "id").collect()} == {1: "World", 2: "World", 3: "World", 4: None}


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_normal_text_is_that_of_the_whole_text(spark):
    import re
    import unicodedata

    def whole(s):
        s = unicodedata.normalize("NFKC", s or "")
        s = re.sub("[“-‟]", '"', re.sub("[‘-‛]", "'", s))
        s = "".join("-" if unicodedata.category(c) == "Pd" else "" if unicodedata.category(c) == "Cf" else c for c in s)
        return re.sub("[ \x00-\x1f\x7f]+", " ", s).strip(" ")

    parts = ["a", "é", "é", "́", " ", "­", "​", " ", "  ", "\t", "\x7f", "ﬁ", "…", "’", "“", "—", "֊", "ड़", "ड़", "சொ", "ா", "가", "ᆨ", "하", "Ａ", "\U0001d400", "_", "-", "7"]
    texts = [a + b + c for a in parts for b in parts for c in (" x", "́", " ா  ", "​ y")]
    rows = spark.createDataFrame([(t,) for t in [None, "", *texts, *(t * 50 for t in texts[:200])]], "x string")
    assert [r for r in rows.select("x", tx.normalize_text("x").alias("y")).collect() if r["y"] != whole(r["x"])] == []


def test_times_and_numbers_of_a_record_are_read_once(spark):
    from wardloom.operators import intake

    names = ["request_id", "language", "category", "sub_category", "severity", "created_at", "latitude", "longitude", "location", "place", "description"]
    rows = spark.createDataFrame([(1, *[None] * 4, "4,5", "31/12/2023", "12.9", "abc", None, None, "a … " * 3000), (2, *[None] * 4, "x", "never", "91", "10", None, None, "b " * 2500)], "event_id long, " + ", ".join(f"{n} string" for n in names))
    out = intake.clean(rows, F.lit(dt.datetime(2024, 1, 20))).select("event_id", "description", "latitude", "severity", "issues")
    got = {r["event_id"]: (len(r["description"]), r["latitude"], r["severity"], [i["code"] for i in r["issues"] if not i["code"].startswith(("MISSING", "LANG"))]) for r in out.collect()}
    assert got == {1: (5000, 12.9, 4.5, ["DESCRIPTION_TRUNCATED", "MALFORMED_COORDINATES", "INCOMPLETE_COORDINATES"]), 2: (4999, 91.0, None, ["MALFORMED_SEVERITY", "COORDINATES_OUT_OF_RANGE", "MALFORMED_TIMESTAMP"])}
    assert _plan(out.select("issues")).count("yyyy/MM/dd xxx") == 1


def test_a_language_is_told_from_a_text_that_is_read_once(spark):
    rows = spark.createDataFrame([("ha​i nahi …",), ("the road",), ("சாலை ab",), ("आहे आणि the water",), ("­ \x07",), ("Straße",), (None,)], "x string")
    out = rows.select(tx.detect_language("x").alias("l"))
    assert [(r["l"]["language"], r["l"]["confidence"]) for r in out.collect()] == [("romanised", 0.7), ("en", 0.85), ("ta", 0.9333), ("mr", 0.9), ("und", 0.0), ("und", 0.3), ("und", 0.0)]
    assert _plan(out).count("\\p{Cf}") == 1


def test_severity_reads_a_text_once(spark):
    rows = spark.createDataFrame([("My child, is (sick)", 0), ("Accident! a minor one", 7), ("small problem", 7), ("blocked", 9), ("endangered", 0), (None, 8), ("dirty​", 0)], "x string, d int")
    out = rows.select(records.severity("x", F.col("d")).alias("s"))
    assert [r["s"] for r in out.collect()] == [4, 5, 2, 5, 2, 3, 3]
    assert _plan(out).count("[^\\p{L}\\p{N}\\p{M}_]+") == 1
