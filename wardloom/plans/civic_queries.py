"""Queries of raw complaints: language, cleaning, normalisation, entities, places, findings, runs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.functions import columns, grid
from wardloom.functions import text as tx
from wardloom.operators import geocode, intake, records, runs, vocabulary
from wardloom.plans.registry import query
from wardloom.sources.testdata import Tables

AS_OF = dt.datetime(2024, 1, 20)


def _expected(column: str, values: tuple, names: str, key: str) -> str:
    """SQL that gives each complaint what is expected of its form: values are rows of SQL literals by number of the form."""
    rows = ", ".join(f"({i}, {v})" for i, v in enumerate(values))
    return f"select c.event_id, {', '.join('v.' + n for n in names.split(', '))} from complaints c join (values {rows}) v(i, {names}) on v.i = {key}"


@query("h60_civic_language", _expected("text", ("'en', 0.85, 'latin_english_markers'", "'en', 0.85, 'latin_english_markers'", "'romanised', 0.7, 'latin_romanised_markers'", "'hi', 0.9, 'unicode_script'", "'mr', 0.9, 'unicode_script+marathi_markers'", "'ta', 0.9281, 'unicode_script'", "'en', 0.85, 'latin_english_markers'", "'und', 0.3, 'insufficient_evidence'", "'und', 0.3, 'insufficient_evidence'", "'und', 0.0, 'empty_input'", "'und', 0.0, 'empty_input'", "'und', 0.3, 'insufficient_evidence'", "'en', 0.85, 'latin_english_markers'"), "language, confidence, method", "c.event_id % 13").replace("v.confidence", "cast(v.confidence as double) as confidence"))
def _(t: Tables) -> DataFrame:
    return t.complaints.select("event_id", tx.detect_language("description").alias("l")).select("event_id", "l.language", "l.confidence", "l.method")


@query("h61_canonical_languages", _expected("language", ("'en'", "'en'", "'ta'", "'mr'", "'und'", "'hi'", "'und'", "'und'", "'und'"), "code", "c.event_id % 9"))
def _(t: Tables) -> DataFrame:
    return t.complaints.select("event_id", tx.canonical_language("language").alias("code"))


@query("n22_stage_status", "select event_id, case event_id % 13 when 7 then 'FALLBACK' when 8 then 'FALLBACK' when 9 then 'FALLBACK' when 10 then 'FALLBACK' when 11 then 'FALLBACK' else 'OK' end as status, case event_id % 13 when 3 then 'hi' when 4 then 'hi' when 5 then 'ta' end as script from complaints")
def _(t: Tables) -> DataFrame:
    rows = t.complaints.withColumn("l", tx.detect_language("description"))
    return rows.select("event_id", tx.stage_status("l").alias("status"), tx.script_of(F.substring("description", 1, 1)).alias("script"))


@query("g5_marker_hits", "select event_id, case event_id % 13 when 0 then 6 when 1 then 3 when 6 then 2 when 12 then 1 else 0 end as english, case event_id % 13 when 0 then 1 when 2 then 6 else 0 end as romanised from complaints")
def _(t: Tables) -> DataFrame:
    rows = t.complaints.withColumn("w", tx.tokens("description"))
    return rows.select("event_id", tx.marker_hits("w", "en").alias("english"), tx.marker_hits("w", "romanised").alias("romanised"))


@query("h45_descriptions", "select event_id, case when event_id % 13 = 12 then 'dr. o''neil''s \"clinic\" - no medicine...' when event_id % 13 in (9, 10) then '' else lower(trim(description)) end as description from complaints")
def _(t: Tables) -> DataFrame:
    return t.complaints.select("event_id", tx.normalize_description("description").alias("description"))


@query("n23_group_texts", "select event_id, case when event_id % 2 = 0 then 'kept' when event_id % 13 = 12 then 'dr. o''neil''s \"clinic\" - no medicine...' when event_id % 13 in (9, 10) then '' else lower(trim(description)) end as group_text from complaints")
def _(t: Tables) -> DataFrame:
    rows = t.complaints.withColumn("kept", F.when(F.col("event_id") % 2 == 0, "kept"))
    return rows.select("event_id", F.coalesce("kept", tx.normalize_description("description")).alias("group_text"))


# ---- cleaning --------------------------------------------------------------
def cleaned(t: Tables) -> DataFrame:
    return intake.clean(t.complaints, F.lit(AS_OF))


def _issues(*codes: str):
    """The issues of a cleaned record among codes, comma-joined."""
    return F.array_join(F.filter(F.transform("issues", lambda i: i["code"]), lambda c: c.isin(*codes)), ",")


@query("h58a_request_ids", "select event_id, case event_id % 6 when 0 then 'REQ-' || event_id when 1 then 'a_b-7' else 'REQ-UNASSIGNED-' || upper(substr(sha256(cast(event_id as varchar)), 1, 12)) end as request_id, case event_id % 6 when 0 then '' when 1 then '' when 3 then 'MISSING_REQUEST_ID' else 'MALFORMED_REQUEST_ID' end as issue from complaints")
def _(t: Tables) -> DataFrame:
    return cleaned(t).select("event_id", "request_id", _issues("MISSING_REQUEST_ID", "MALFORMED_REQUEST_ID").alias("issue"))


@query("h58b_languages", _expected("language", ("'en', true, ''", "'en', true, ''", "'ta', true, ''", "'mr', false, 'LANGUAGE_NOT_SUPPORTED'", "'xx-unknown', false, 'UNKNOWN_LANGUAGE'", "'hi', true, ''", "null, false, 'MISSING_LANGUAGE'", "null, false, 'MISSING_LANGUAGE'", "'zh_hans', false, 'UNKNOWN_LANGUAGE'"), "language, supported, issue", "c.event_id % 9"))
def _(t: Tables) -> DataFrame:
    return cleaned(t).select("event_id", "language", F.col("language_supported").alias("supported"), _issues("MISSING_LANGUAGE", "UNKNOWN_LANGUAGE", "LANGUAGE_NOT_SUPPORTED").alias("issue"))


@query("h58c_descriptions", "select event_id, case when event_id % 13 = 12 then 'Dr. O''Neil''s \"clinic\" - no medicine...' when event_id % 13 in (8, 9, 10) then null else description end as description, length(description) * 200 > 5000 as cut from complaints where event_id % 13 not in (8, 9, 10)")
def _(t: Tables) -> DataFrame:
    long = intake.clean(t.complaints.withColumn("description", F.repeat("description", 200)), F.lit(AS_OF)).select("event_id", (F.size(F.filter("issues", lambda i: i["code"] == "DESCRIPTION_TRUNCATED")) > 0).alias("cut"))
    return cleaned(t).where("event_id % 13 not in (8, 9, 10)").select("event_id", "description").join(long, "event_id")


@query("h58d_optional_texts", "select event_id, case event_id % 10 when 5 then null when 6 then null when 9 then null else category end as category, event_id % 13 in (8, 9, 10) as no_description from complaints")
def _(t: Tables) -> DataFrame:
    return cleaned(t).select("event_id", "category", F.col("description").isNull().alias("no_description"))


@query("h58e_severities", _expected("severity", ("3.0, ''", "4.5, ''", "null, 'MALFORMED_SEVERITY'", "9.0, 'SEVERITY_OUT_OF_RANGE'", "null, ''", "null, ''", "0.0, 'SEVERITY_OUT_OF_RANGE'", "5.0, ''"), "severity, issue", "c.event_id % 8").replace("v.severity", "cast(v.severity as double) as severity"))
def _(t: Tables) -> DataFrame:
    return cleaned(t).select("event_id", "severity", _issues("MALFORMED_SEVERITY", "SEVERITY_OUT_OF_RANGE").alias("issue"))


@query("h58f_points", "select event_id, case when event_id % 11 = 0 then 13.08 when event_id % 5 = 0 then 12.9716 when event_id % 5 = 1 then 91 end::double as latitude, case when event_id % 11 = 0 then 80.27 when event_id % 5 = 0 then 77.5946 when event_id % 5 = 1 then 10 when event_id % 5 = 2 then 77 when event_id % 5 = 3 then 77.1 end::double as longitude, case when event_id % 11 = 0 or event_id % 5 in (0, 4) then '' when event_id % 5 = 1 then 'COORDINATES_OUT_OF_RANGE' when event_id % 5 = 2 then 'MALFORMED_COORDINATES,INCOMPLETE_COORDINATES' else 'INCOMPLETE_COORDINATES' end as issue from complaints")
def _(t: Tables) -> DataFrame:
    return cleaned(t).select("event_id", "latitude", "longitude", _issues("MALFORMED_COORDINATES", "COORDINATES_OUT_OF_RANGE", "INCOMPLETE_COORDINATES").alias("issue"))


@query("h58g_places", "select event_id, case when event_id % 11 = 0 then 'MG Road' when event_id % 4 = 0 then 'Near Gandhi Nagar' when event_id % 4 = 3 then 'Market street' end as location_text from complaints")
def _(t: Tables) -> DataFrame:
    return cleaned(t).select("event_id", "location_text")


_PLACED = "(event_id % 11 = 0 or event_id % 5 in (0, 1, 2, 3) or event_id % 4 in (0, 3))"
_MISSING = f"""list_filter([case when event_id % 6 > 1 then 'request_id' end, case when event_id % 10 in (5, 6, 9) and event_id % 13 in (8, 9, 10) then 'category' end, case when not {_PLACED} then 'location' end, case when event_id % 7 = 5 then 'created_at' end], lambda x: x is not null)"""


@query("h58h_missing", f"select event_id, array_to_string({_MISSING}, ',') as missing from complaints")
def _(t: Tables) -> DataFrame:
    return cleaned(t).select("event_id", F.array_join("missing", ",").alias("missing"))


@query("n5_derived_flags", f"select event_id, event_id % 11 = 0 or event_id % 5 < 2 as coordinates_present, event_id % 11 = 0 or event_id % 5 = 0 as coordinates_valid, {_PLACED} as location_present, event_id % 8 in (0, 1, 7) as severity_valid from complaints")
def _(t: Tables) -> DataFrame:
    return cleaned(t).select("event_id", "coordinates_present", "coordinates_valid", "location_present", "severity_valid")


@query("n13_written_times", _expected("created_at", ("timestamp '2024-01-05 10:00:00'", "timestamp '2024-01-06 11:00:00'", "timestamp '2024-01-06 00:00:00'", "timestamp '2024-01-06 00:00:00'", "timestamp '2023-12-31 00:00:00'", "null", "timestamp '2099-01-01 00:00:00'"), "created_at", "c.event_id % 7"))
def _(t: Tables) -> DataFrame:
    return cleaned(t).select("event_id", "created_at")


@query("h73_time_issues", _expected("created_at", ("''", "''", "''", "''", "''", "'MALFORMED_TIMESTAMP'", "'FUTURE_TIMESTAMP'"), "issue", "c.event_id % 7"))
def _(t: Tables) -> DataFrame:
    return cleaned(t).select("event_id", _issues("MISSING_TIMESTAMP", "MALFORMED_TIMESTAMP", "FUTURE_TIMESTAMP", "IMPLAUSIBLE_TIMESTAMP").alias("issue"))


@query("b20_intake", "select event_id, case when event_id % 13 in (9, 10) and event_id % 8 = 6 then 'no text or location' when event_id % 8 = 5 then 'out of range' end as reason from complaints")
def _(t: Tables) -> DataFrame:
    return t.complaints.select("event_id", intake.intake_reject("description", "lat", "lon").alias("reason"))


@query("h42_media_types", "select event_id, case when (event_id % 2 = 0)::int + (event_id % 3 = 0)::int + (event_id % 5 = 0)::int > 1 then 'MULTIMODAL' when event_id % 3 = 0 then 'AUDIO' when event_id % 5 = 0 then 'IMAGE' else 'TEXT' end as media from events")
def _(t: Tables) -> DataFrame:
    has = lambda n: F.col("event_id") % n == 0
    return t.base("events").select("event_id", intake.media_type(has(2), has(3), has(5)).alias("media"))


@query("h41_understanding", "select event_id, case when event_id % 3 = 0 then 'UNDERSTOOD' when event_id % 3 = 1 and event_id % 13 in (9, 10) then 'FAILED' else 'PARTIAL' end as status from complaints")
def _(t: Tables) -> DataFrame:
    last = F.when(F.col("event_id") % 3 == 0, "SKIPPED").when(F.col("event_id") % 3 == 1, "FAILED").otherwise("FALLBACK")
    rows = t.complaints.withColumn("stages", F.create_map(F.lit("language"), F.lit("OK"), F.lit("translation"), last))
    return rows.select("event_id", intake.understanding_status("stages", ["description"]).alias("status"))


# ---- normalisation ---------------------------------------------------------
@query("h66a_category_aliases", _expected("category", ("'WATER', 'WATER'", "'ROAD', 'ROAD'", "'ELECTRICITY', 'ELECTRICITY'", "'EDUCATION', 'EDUCATION'", "null, 'UNKNOWN'", "null, 'UNKNOWN'", "null, 'UNKNOWN'", "'PUBLIC_SAFETY', 'PUBLIC_SAFETY'", "'WATER', 'WATER'", "null, 'UNKNOWN'"), "resolved, sector", "c.event_id % 10"))
def _(t: Tables) -> DataFrame:
    rows = t.complaints.withColumn("resolved", vocabulary.resolve_category("category"))
    return rows.select("event_id", "resolved", vocabulary.sector_for("resolved").alias("sector"))


_CAT = "case event_id % 10 when 0 then 'WATER' when 1 then 'ROAD' when 2 then 'ELECTRICITY' when 3 then 'EDUCATION' when 7 then 'PUBLIC_SAFETY' when 8 then 'WATER' end"
_SUB = "case event_id % 7 when 0 then case when k is null or k = 'WATER' then 'WATER_SUPPLY_DISRUPTION' end when 1 then case when k is null or k = 'ROAD' then 'DAMAGED_ROAD' end when 2 then case when k is null or k = 'ELECTRICITY' then 'POWER_OUTAGE' when k = 'WATER' then 'WATER_SUPPLY_DISRUPTION' end when 4 then case when k is null or k = 'SANITATION' then 'SOLID_WASTE' end when 6 then case when k is null or k = 'ELECTRICITY' then 'STREET_LIGHTING' end end"


@query("h66b_sub_category_aliases", f"select event_id, {_SUB} as sub_category, k is not null and event_id % 7 in (0, 1, 2, 4, 6) and ({_SUB}) is null as mismatch from (select event_id, {_CAT} as k from complaints) x")
def _(t: Tables) -> DataFrame:
    rows = t.complaints.withColumn("k", vocabulary.resolve_category("category"))
    _, sub, mismatch = vocabulary.resolve_sub_category("sub_category", F.col("k"))
    return rows.select("event_id", sub.alias("sub_category"), mismatch.alias("mismatch"))


@query("h66c_sub_category_keywords", _expected("description", ("'hospital', 'HOSPITAL_ACCESS'", "'no water', 'WATER_SUPPLY_DISRUPTION'", "'bijli nahi', 'POWER_OUTAGE'", "null, null", "null, null", "'சாலை பழுது', 'DAMAGED_ROAD'", "'street light', 'STREET_LIGHTING'", "'garbage', 'SOLID_WASTE'", "null, null", "null, null", "null, null", "null, null", "'no medicine', 'MEDICINE_SHORTAGE'"), "keyword, sub_category", "c.event_id % 13"))
def _(t: Tables) -> DataFrame:
    rows = t.complaints.withColumn("text", tx.normalize_description("description"))
    return rows.select("event_id", vocabulary.best_keyword("text", "language", None, True).alias("k")).select("event_id", "k.keyword", "k.sub_category")


@query("h66d_category_keywords", _expected("description", ("'road', 'ROAD', 7.0", "'water', 'WATER', 8.0", "null, null, null", "'पानी', 'WATER', 4.0", "null, null, null", "null, null, null", "null, null, null", "null, null, null", "null, null, null", "null, null, null", "null, null, null", "null, null, null", "'clinic', 'HEALTHCARE', 9.0"), "keyword, category, score", "c.event_id % 13").replace("v.score", "cast(v.score as double) as score"))
def _(t: Tables) -> DataFrame:
    rows = t.complaints.withColumns({"text": tx.normalize_description("description"), "language": F.lit("en")})
    return rows.select("event_id", vocabulary.best_keyword("text", "language", None, False).alias("k")).select("event_id", "k.keyword", "k.category", (-F.col("k.score")).alias("score"))


def normalized(t: Tables) -> DataFrame:
    return vocabulary.normalize(cleaned(t).join(t.complaints.select("event_id", F.col("sub_category").alias("given_sub")), "event_id"))


_SUB_CLEAN = _SUB
_TEXT_SUB = "case event_id % 13 when 0 then ['HEALTHCARE', 'HOSPITAL_ACCESS'] when 1 then ['WATER', 'WATER_SUPPLY_DISRUPTION'] when 2 then ['ELECTRICITY', 'POWER_OUTAGE'] when 5 then ['ROAD', 'DAMAGED_ROAD'] when 6 then ['ELECTRICITY', 'STREET_LIGHTING'] when 7 then ['SANITATION', 'SOLID_WASTE'] when 12 then ['HEALTHCARE', 'MEDICINE_SHORTAGE'] end"
_NORM = f"""nm as (select *, case when s is not null then coalesce(k, case event_id % 7 when 0 then 'WATER' when 1 then 'ROAD' when 2 then 'ELECTRICITY' when 4 then 'SANITATION' when 6 then 'ELECTRICITY' end) when k is not null then k when x is not null then x[1] when event_id % 13 = 3 then 'WATER' else 'UNKNOWN' end as norm_category,
  coalesce(s, case when k is null or k = x[1] then x[2] end, 'UNCLASSIFIED') as norm_sub_category,
  case when s is not null then 'explicit' when k is not null and k = x[1] then 'explicit_category+inferred_sub_category' when k is not null then 'category_only' when x is not null then 'inferred' when event_id % 13 = 3 then 'category_only' else 'fallback' end as norm_source,
  k is not null and event_id % 7 in (0, 1, 2, 4, 6) and s is null as norm_mismatch
  from (select *, {_SUB} as s, {_TEXT_SUB} as x from (select *, {_CAT} as k from complaints) a) b)"""


@query("h66e_resolution_order", f"with {_NORM} select event_id, norm_category, norm_sub_category, norm_source, norm_mismatch from nm")
def _(t: Tables) -> DataFrame:
    return normalized(t).select("event_id", "norm_category", "norm_sub_category", "norm_source", "norm_mismatch")


@query("h40_confidence_ladder", f"with {_NORM} select event_id, cast(case norm_source when 'explicit' then 0.95 when 'explicit_category+inferred_sub_category' then 0.85 when 'inferred' then 0.7 when 'category_only' then 0.55 else 0 end as double) as confidence from nm")
def _(t: Tables) -> DataFrame:
    return normalized(t).select("event_id", F.col("norm_confidence").alias("confidence"))


@query("b17_groupable", f"with {_NORM} select event_id, norm_category <> 'UNKNOWN' and norm_sub_category <> 'UNCLASSIFIED' as groupable from nm")
def _(t: Tables) -> DataFrame:
    return normalized(t).select("event_id", vocabulary.groupable("norm_category", "norm_sub_category").alias("groupable"))


# ---- places ----------------------------------------------------------------
PLACES = [("P1", "Bengaluru Urban", "Karnataka", 12.97, 77.59, 12.8, 13.1, 77.4, 77.8), ("P2", "Chennai", "Tamil Nadu", 13.08, 80.27, None, None, None, None), ("P3", None, None, None, None, None, None, None, None)]
ALIASES = [("Gandhi Nagar", "P1"), ("market", "P3"), ("nagar", "P2")]
COUNTRIES = [("India", 0, 6.0, 37.0, 68.0, 98.0), ("North", 1, 0.0, 90.0, -180.0, 180.0)]


def located(t: Tables) -> DataFrame:
    make = t.spark.createDataFrame
    places = make(PLACES, "place string, district string, state string, p_lat double, p_lon double, south double, north double, west double, east double")
    return geocode.geocode(t.complaints.select("event_id", "place", "lat", "lon").withColumnRenamed("place", "said"), places, make(ALIASES, "alias string, place string"), make(COUNTRIES, "country string, order int, south double, north double, west double, east double"), "event_id", "said")


_BY = "case when event_id % 4 = 0 then 'P1' when event_id % 4 = 3 then 'P3' when event_id % 8 in (0, 7) then 'P1' when event_id % 8 = 1 then 'P2' end"
_POINT = "event_id % 8 not in (5, 6)"
_METHOD = f"case when event_id % 4 in (0, 3) and {_POINT} then 'gazetteer_text+coordinates' when event_id % 4 in (0, 3) then 'gazetteer_text' when event_id % 8 = 1 then 'nearest_place' when {_POINT} then 'coordinates_only' else 'unresolved' end"


@query("h33a_geocode_ladder", f"select event_id, {_BY} as place, {_METHOD} as method, cast(case when event_id % 4 = 0 then 0.9 when event_id % 4 = 3 then 0.6 when event_id % 8 in (0, 7) then case event_id % 8 when 0 then 0.8 else 0.7 end when event_id % 8 = 1 then 0.7 when event_id % 8 in (2, 3) then 0.4 when event_id % 8 = 4 then 0.3 else 0 end as double) as confidence, case when event_id % 4 = 0 or event_id % 8 = 1 then 'RESOLVED' when {_POINT} then 'PARTIAL' else 'UNRESOLVED' end as status from complaints")
def _(t: Tables) -> DataFrame:
    return located(t).select("event_id", "place", "method", "confidence", "status")


@query("c12_countries", "select event_id, case when event_id % 8 in (0, 1, 2, 7) then 'India' when event_id % 8 = 3 then 'North' end as country from complaints")
def _(t: Tables) -> DataFrame:
    return located(t).select("event_id", "country")


@query("h33b_hints", "select event_id, case when event_id % 4 = 0 then 'Bengaluru Urban' when event_id % 8 = 1 then 'Chennai' else 'Hinted' end as district, case when event_id % 8 in (5, 6) then 'RESOLVED' else 'RESOLVED' end as status from complaints")
def _(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    hints = t.complaints.select("event_id", F.lit("Hinted").alias("district"), none.alias("state"), none.alias("country"), F.lit(9.0).alias("lat"), F.lit(77.0).alias("lon"))
    return geocode.with_hints(located(t), hints, "event_id").select("event_id", "district", "status")


@query("j2_geocoder_chain", "select event_id, case when event_id % 4 = 0 or event_id % 8 = 1 then 'first' when event_id % 3 = 0 then 'second' else 'first' end as provider from complaints")
def _(t: Tables) -> DataFrame:
    first = located(t).select("event_id", "status", F.lit("first").alias("provider"))
    second = t.complaints.select("event_id", F.when(F.col("event_id") % 3 == 0, "RESOLVED").otherwise("UNRESOLVED").alias("status"), F.lit("second").alias("provider"))
    return geocode.first_resolved("event_id", first, second).select("event_id", "provider")


@query("n6_geocode_flags", "select event_id, case when event_id % 4 = 0 then 'Bengaluru Urban, Karnataka' when event_id % 8 = 1 then 'Chennai, Tamil Nadu' else '' end as admin from complaints")
def _(t: Tables) -> DataFrame:
    return located(t).select("event_id", geocode.admin_line("district", "state").alias("admin"))


_GRID_POINTS = [("A", 81.0, 10.0), ("B", 81.001, 10.01), ("C", 10.0, 179.99), ("D", 10.0, -179.99), ("E", 89.99, 0.0), ("F", 89.99, 180.0), ("G", 30.0, 78.2501), ("H", 30.0, 78.1501), ("I", 60.0, 20.0), ("J", 60.0, 20.21), ("K", -89.99, 45.0)]
_GRID_SQL = ", ".join(f"('{c}', {a}, {b})" for c, a, b in _GRID_POINTS)


@query("c5_pairs_everywhere", f"with p as (select * from (values {_GRID_SQL}) v(w, lat, lon)) select a.w as a, b.w as b from p a join p b on a.w < b.w where 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 12000")
def _(t: Tables) -> DataFrame:
    from wardloom.operators import intel

    return intel.near_pairs(t.spark.createDataFrame(_GRID_POINTS, "ward_code string, latitude double, longitude double")).select("a", "b")


@query("h8_two_boxes", "select event_id, round(lat - degrees(1000 / 6371008.8), 9) as south, round(lon + degrees(1000 / 6371008.8) / greatest(cos(radians(lat)), 0.000001), 9) as east, round(lat - 1000 / 111320.0, 9) as south2, round(lon + 1000 / 111320.0 / greatest(cos(radians(lat)), 0.01), 9) as east2 from complaints where event_id % 8 in (0, 2, 3)")
def _(t: Tables) -> DataFrame:
    rows = t.complaints.where("event_id % 8 in (0, 2, 3)")
    exact, plain = grid.bounding_box(F.col("lat"), F.col("lon"), 1000.0), grid.bounding_box(F.col("lat"), F.col("lon"), 1000.0, 0.01, 111320.0)
    return rows.select("event_id", F.round(exact["south"], 9).alias("south"), F.round(exact["east"], 9).alias("east"), F.round(plain["south"], 9).alias("south2"), F.round(plain["east"], 9).alias("east2"))


# ---- findings --------------------------------------------------------------
def judged(t: Tables) -> DataFrame:
    """Complaints that have been cleaned, normalised and geocoded, with findings, quality and statuses."""
    rows = normalized(t).join(located(t).select("event_id", "district", "state", F.col("status").alias("location_status")), "event_id")
    rows = rows.withColumn("found", records.all_findings(F.lit(AS_OF))).withColumns({"validation": records.status_of("found"), "quality": records.quality_score(F.lit(AS_OF))})
    return rows.withColumn("quality_status", records.quality_status("validation", "quality")).withColumn("processing", intake.processing_status("quality_status"))


_LOC = f"case when event_id % 4 = 0 or event_id % 8 = 1 then 'RESOLVED' when {_POINT} then 'PARTIAL' else 'UNRESOLVED' end"
_RULES = f"""fd as (select *, list_filter([case when event_id % 6 > 1 then 'INVALID_REQUEST_ID:e' end, case when event_id % 10 in (5, 6, 9) and event_id % 13 in (8, 9, 10) then 'MISSING_CATEGORY:e' end, case when norm_category = 'UNKNOWN' then 'INVALID_CATEGORY:e' end, case when norm_sub_category = 'UNCLASSIFIED' then 'MISSING_SUB_CATEGORY:w' end,
  case when norm_mismatch then 'CATEGORY_SUBCATEGORY_MISMATCH:w' end, case when not {_PLACED} then 'MISSING_LOCATION:e' end, case when event_id % 11 <> 0 and event_id % 5 in (2, 3) then 'INCOMPLETE_COORDINATES:e' end, case when event_id % 11 <> 0 and event_id % 5 = 1 then 'INVALID_COORDINATES:e' end,
  case when {_PLACED} and {_LOC} = 'UNRESOLVED' then 'LOCATION_UNRESOLVED:w' end, case when {_PLACED} and {_LOC} = 'PARTIAL' then 'LOCATION_PARTIALLY_RESOLVED:w' end, case when event_id % 7 = 5 then 'MISSING_TIMESTAMP:e' end, case when event_id % 7 = 6 then 'FUTURE_TIMESTAMP:w' end,
  case when event_id % 8 in (2, 4, 5) then 'MISSING_SEVERITY:w' end, case when event_id % 8 in (3, 6) then 'INVALID_SEVERITY:e' end, case when event_id % 13 in (8, 9, 10) then 'MISSING_DESCRIPTION:w' end, case when event_id % 9 in (3, 4, 6, 7, 8) then 'UNSUPPORTED_LANGUAGE:w' end, case when norm_source = 'fallback' then 'NORMALIZATION_FAILED:e' end], lambda x: x is not null) as f from nm)"""
_STATUS = "case when list_contains(list_transform(f, lambda x: x[-1]), 'e') then 'INVALID' when len(f) > 0 then 'NEEDS_REVIEW' else 'VALID' end"
_ADMIN = "(event_id % 4 = 0 or event_id % 8 = 1)"
_VALID = "(event_id % 11 = 0 or event_id % 5 = 0)"
_SCORE = f"""round(cast(0.22 * (case when event_id % 6 < 2 then 0.25 else 0 end + case when event_id % 10 in (5, 6, 9) and event_id % 13 in (8, 9, 10) then 0 else 0.25 end + case when {_PLACED} then 0.25 else 0 end + case when event_id % 7 = 5 then 0 else 0.25 end)
  + 0.14 * (case when {_VALID} and {_ADMIN} then 1 when {_VALID} then 0.75 when {_ADMIN} then 0.6 when event_id % 11 = 0 or event_id % 4 in (0, 3) then 0.35 else 0 end) + 0.14 * (case when norm_category = 'UNKNOWN' then 0.1 when norm_sub_category = 'UNCLASSIFIED' then 0.75 else 1 end)
  + 0.10 * (case event_id % 7 when 5 then 0 when 6 then 0.4 else 1 end) + 0.14 * (case {_LOC} when 'RESOLVED' then 1 when 'PARTIAL' then 0.6 else 0 end) + 0.10 * (case when event_id % 8 in (2, 4, 5) then 0.4 when event_id % 8 in (3, 6) then 0 else 1 end) + 0.16 * (case when event_id % 13 in (8, 9, 10) then 0 else 1 end) as double), 3)"""


@query("h34_all_findings", f"with {_NORM}, {_RULES} select event_id, array_to_string(list_transform(f, lambda x: split_part(x, ':', 1)), ',') as findings, {_STATUS} as status from fd")
def _(t: Tables) -> DataFrame:
    return judged(t).select("event_id", F.array_join(F.transform("found", lambda f: f["code"]), ",").alias("findings"), F.col("validation").alias("status"))


@query("h23_all_factors", f"with {_NORM} select event_id, {_SCORE} as quality from nm")
def _(t: Tables) -> DataFrame:
    return judged(t).select("event_id", "quality")


@query("h35_quality_status", f"with {_NORM}, {_RULES}, q as (select *, {_SCORE} as quality, {_STATUS} as v from fd) select event_id, case when v <> 'VALID' then v when quality >= 0.85 then 'VALID' else 'NEEDS_REVIEW' end as quality_status, case when v = 'INVALID' then 'REJECTED' when v = 'NEEDS_REVIEW' or quality < 0.85 then 'NEEDS_REVIEW' else 'PROCESSED' end as processing from q")
def _(t: Tables) -> DataFrame:
    return judged(t).select("event_id", "quality_status", "processing")


@query("n27_findings_by_severity", f"with {_NORM}, {_RULES} select event_id, len(list_filter(f, lambda x: x[-1] = 'e')) as errors, len(list_filter(f, lambda x: x[-1] = 'w')) as warnings from fd")
def _(t: Tables) -> DataFrame:
    n = lambda level: F.size(intake.of_severity("found", level)).cast("long")
    return judged(t).select("event_id", n("error").alias("errors"), n("warning").alias("warnings"))


@query("a10_payloads", f"with {_NORM}, {_RULES} select event_id, norm_category as category, case event_id % 6 when 0 then 'REQ-' || event_id when 1 then 'a_b-7' else 'REQ-UNASSIGNED-' || upper(substr(sha256(cast(event_id as varchar)), 1, 12)) end as request_id, {_STATUS} as status from fd")
def _(t: Tables) -> DataFrame:
    rows = judged(t).withColumn("payload", F.to_json(F.struct("request_id", F.col("norm_category").alias("category"), F.col("validation").alias("status"))))
    back = F.from_json("payload", "request_id string, category string, status string").alias("p")
    return rows.select("event_id", back).select("event_id", "p.category", "p.request_id", "p.status")


# ---- entities --------------------------------------------------------------
_ENTITIES = [
    (0, "LANDMARK", "hospital", 27, 35, 0.85, None, None), (0, "ADMIN_UNIT", "nagar", 21, 26, 0.85, None, None), (0, "DURATION", "since three weeks", 46, 63, 0.8, 3, "weeks"), (0, "DURATION", "since", 46, 51, 0.8, None, "relative"),
    (1, "DURATION", "for 12 days", 9, 20, 0.8, 12, "days"), (1, "ADMIN_UNIT", "ward", 24, 28, 0.85, None, None), (1, "PINCODE", "560001", 41, 47, 0.97, None, None), (5, "PINCODE", "560001", 19, 25, 0.97, None, None),
    (6, "PHONE", "9876543210", 5, 15, 0.95, None, None), (6, "PHONE", "+91 9123456789", 19, 33, 0.95, None, None), (6, "INFRA_ASSET", "street light", 44, 56, 0.85, None, None), (6, "COORDINATE", "12.9716, 77.5946", 60, 76, 0.99, None, None),
    (7, "DATE", "12/05/2024", 11, 21, 0.7, None, None), (7, "INFRA_ASSET", "drain", 23, 28, 0.85, None, None), (7, "DURATION", "for months", 37, 47, 0.8, None, "relative"),
]
_ENTITY_SQL = ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in _ENTITIES)
_FOUND = f"en as (select c.event_id, v.type, v.value, v.start, v.stop, cast(v.confidence as double) as confidence, v.amount, v.unit from complaints c join (values {_ENTITY_SQL}) v(i, type, value, start, stop, confidence, amount, unit) on v.i = c.event_id % 13)"


@query("h64_entities", f"with {_FOUND} select * from en")
def _(t: Tables) -> DataFrame:
    return records.entities(t.complaints, "event_id", "description")


@query("d37_longest_durations", "select event_id, case event_id % 13 when 0 then 21 else 12 end as days from complaints where event_id % 13 in (0, 1)")
def _(t: Tables) -> DataFrame:
    return records.longest_days(records.entities(t.complaints, "event_id", "description"), "event_id")


@query("e12_surest_entities", "select event_id, 'A' as type from events")
def _(t: Tables) -> DataFrame:
    make = lambda kind, sure: F.struct(F.lit(kind).alias("type"), F.lit("x").alias("value"), F.lit(3).alias("start"), F.lit(4).alias("stop"), F.lit(sure).alias("confidence"))
    rows = t.base("events").select("event_id", F.explode(F.array(make("B", 0.5), make("C", 0.9), make("A", 0.9))).alias("e")).select("event_id", "e.*")
    return records.surest(rows, "event_id").select("event_id", "type")


@query("g2_merged_entities", f"with {_FOUND} select event_id, type, value from en union all select event_id, 'PINCODE', '111111' from complaints")
def _(t: Tables) -> DataFrame:
    first = records.entities(t.complaints, "event_id", "description").select("event_id", "type", "value")
    extra = t.complaints.select("event_id", F.lit("PINCODE").alias("type"), F.lit("111111").alias("value"))
    return records.merged_entities(first, first.withColumn("value", F.upper("value")).unionByName(extra), "event_id")


# ---- runs ------------------------------------------------------------------
_RANK = "rk as (select cast(c_custkey as varchar) as hotspot_code, row_number() over (order by c_acctbal desc, c_custkey) as rank, round(c_acctbal / 100, 1) as score, case when c_acctbal >= 7000 then 'HIGH' when c_acctbal >= 4500 then 'MEDIUM' else 'LOW' end as band from customer)"


def ranking_of(t: Tables) -> DataFrame:
    return t.spark.sql(_RANK[len("rk as (") : -1].replace("from customer", "from {customer}").replace("varchar", "string"), customer=t.base("customer"))


_PAST = "ps as (select cast(o_custkey as varchar) as hotspot_code, o_orderkey as run_id, o_orderkey % 100 as rank, round(o_totalprice / 5000, 1) as score, cast(o_orderdate as timestamp) + to_seconds(o_orderkey) as recorded_at from orders)"


def past_of(t: Tables) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey"))
    return t.base("orders").select(F.col("o_custkey").cast("string").alias("hotspot_code"), F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 100).alias("rank"), F.round(F.col("o_totalprice") / 5000, 1).alias("score"), at.alias("recorded_at"))


@query("n16_ranking_payload", f"with {_RANK}, {_PAST}, b as (select hotspot_code, arg_max(rank, recorded_at) as pr, arg_max(score, recorded_at) as psc from ps group by 1) select rk.hotspot_code, rk.rank, rk.score, rk.band, psc as previous_score, round(rk.score - psc, 1) as score_change, pr - rk.rank as rank_change from rk left join b using (hotspot_code)")
def _(t: Tables) -> DataFrame:
    return runs.ranking_payload(ranking_of(t), past_of(t))


@query("n16_band_counts", f"with {_RANK} select count(*) as total, count(*) filter (where band = 'HIGH') as high, count(*) filter (where band = 'MEDIUM') as medium, count(*) filter (where band = 'LOW') as low from rk")
def _(t: Tables) -> DataFrame:
    return runs.band_counts(ranking_of(t))


@query("n17_recent_history", f"with {_PAST} select hotspot_code, run_id from (select *, row_number() over (partition by hotspot_code order by recorded_at desc) as n from ps) x where n <= 20")
def _(t: Tables) -> DataFrame:
    return runs.latest(past_of(t), "hotspot_code", 20, F.desc("recorded_at")).select("hotspot_code", "run_id")


_RUN_SQL = "rn as (select cast(o_orderkey as varchar) as run_id, case o_orderstatus when 'F' then 'SUCCESS' when 'P' then 'FAILED' else 'RUNNING' end as status, case when o_orderstatus <> 'O' then (o_orderkey % 1000) * 1000 end as duration_ms, case when o_orderstatus = 'F' then o_custkey else 0 end as scored, case when o_orderstatus = 'P' then 'lost' end as error, cast(o_orderdate as timestamp) + to_seconds(o_orderkey % 1000) as finished_at from orders)"


def runs_of(t: Tables) -> DataFrame:
    begun = F.col("o_orderdate").cast("timestamp")
    none, status = F.lit(None), F.col("o_orderstatus")
    event = lambda at, what, scored, error: F.struct(at.alias("at"), what.alias("what"), F.lit("manual").alias("trigger"), scored.cast("long").alias("scored"), error.cast("string").alias("error"))
    ended = begun + F.make_dt_interval(secs=F.col("o_orderkey") % 1000)
    rows = t.base("orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.explode(F.array(event(begun, F.lit("started"), none, none), event(F.when(status != "O", ended), F.when(status == "F", "finished").when(status == "P", "failed"), F.when(status == "F", F.col("o_custkey")), F.when(status == "P", "lost")))).alias("e"))
    return runs.run_rows(rows.select("run_id", "e.*").where("at is not null"))


@query("a20_run_rows", f"with {_RUN_SQL} select run_id, status, duration_ms, scored, error from rn")
def _(t: Tables) -> DataFrame:
    return runs_of(t).select("run_id", "status", "duration_ms", "scored", "error")


@query("n17_latest_success", f"with {_RUN_SQL} select run_id from rn where status = 'SUCCESS' order by finished_at desc, run_id desc limit 1")
def _(t: Tables) -> DataFrame:
    return runs.latest_success(runs_of(t)).select("run_id")


@query("a19_archived_rows", f"with {_RANK} select hotspot_code, case when rank % 2 = 0 then 'R1' else 'R2' end as run_id, rank from rk")
def _(t: Tables) -> DataFrame:
    standing = ranking_of(t).withColumn("run_id", F.when(F.col("rank") % 2 == 0, "R1"))
    return runs.archived(standing, "R2", F.lit(AS_OF)).select("hotspot_code", "run_id", "rank")


# ---- small ones ------------------------------------------------------------
@query("h4_shares", "select o_orderkey, least(1, greatest(0, case when o_custkey % 5 = 0 then 0 else o_totalprice / (o_custkey % 5 * 50000) end)) as share from orders")
def _(t: Tables) -> DataFrame:
    return t.base("orders").select("o_orderkey", columns.share("o_totalprice", (F.col("o_custkey") % 5) * 50000).alias("share"))


@query("h9_round_or_none", "select event_id, case when event_id % 3 <> 0 then round(lat, 1) end as lat from complaints")
def _(t: Tables) -> DataFrame:
    return t.complaints.select("event_id", columns.round_or_none(F.when(F.col("event_id") % 3 != 0, F.col("lat")), 1).alias("lat"))


@query("h3_mean_or_zero", "select event_id % 8 as k, coalesce(avg(lat), 0) as mean from complaints group by 1")
def _(t: Tables) -> DataFrame:
    return t.complaints.groupBy((F.col("event_id") % 8).alias("k")).agg(columns.mean_or_zero("lat").alias("mean"))


@query("h70_utc", "select event_id, date_trunc('second', ts) - case when event_id % 2 = 0 then interval 330 minute else interval 0 minute end as at from events")
def _(t: Tables) -> DataFrame:
    rows = t.base("events").withColumn("zone", F.when(F.col("event_id") % 2 == 0, "Asia/Kolkata"))
    return rows.select("event_id", F.date_trunc("second", columns.utc("ts", "zone")).alias("at"))


@query("n13_date_prefixes", _expected("created_at", ("date '2024-01-05'", "date '2024-01-06'", "null", "null", "null", "null", "date '2099-01-01'"), "day", "c.event_id % 7"))
def _(t: Tables) -> DataFrame:
    return t.complaints.select("event_id", columns.date_prefix("created_at").alias("day"))


@query("n3_insert_once", "select event_id from events where event_id % 3 <> 0")
def _(t: Tables) -> DataFrame:
    new = t.base("events").select("event_id")
    return new.join(new.where("event_id % 3 = 0"), "event_id", "left_anti")
