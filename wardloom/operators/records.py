"""Complaint records: cleaning, classification, validation, quality, entities and ingestion."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.functions.columns import clamp, lookup, valid_point
from wardloom.functions.text import BETWEEN, normalize_text, once, tokens
from wardloom.operators.terms import dealt_join, occurrences
from wardloom.vocab import SECTORS

#: Our own lexicon: (category, sub_category, term, weight). A phrase counts 1, a lemma a half.
LEXICON = (
    ("ROAD", "DAMAGED_ROAD", "pothole", 1.0), ("ROAD", "DAMAGED_ROAD", "potholes", 1.0), ("ROAD", "DAMAGED_ROAD", "broken road", 1.0), ("ROAD", "ROAD_SAFETY", "speed breaker", 1.0), ("ROAD", "ROAD_SAFETY", "traffic signal", 1.0), ("ROAD", "FOOTPATH", "footpath", 1.0), ("ROAD", "DAMAGED_ROAD", "road", 0.5),
    ("WATER", "DRINKING_WATER", "drinking water", 1.0), ("WATER", "WATER_SUPPLY_DISRUPTION", "no water", 1.0), ("WATER", "WATER_SUPPLY_DISRUPTION", "water supply", 1.0), ("WATER", "WATER_QUALITY", "dirty water", 1.0), ("WATER", "PIPE_LEAK", "pipe leak", 1.0), ("WATER", "BOREWELL", "borewell", 1.0), ("WATER", "DRINKING_WATER", "water", 0.5),
    ("ELECTRICITY", "POWER_OUTAGE", "power cut", 1.0), ("ELECTRICITY", "POWER_OUTAGE", "no power", 1.0), ("ELECTRICITY", "STREET_LIGHTING", "street light", 1.0), ("ELECTRICITY", "TRANSFORMER_ISSUE", "transformer", 1.0), ("ELECTRICITY", "LIVE_WIRE", "live wire", 1.0), ("ELECTRICITY", "POWER_OUTAGE", "electricity", 0.5), ("ELECTRICITY", "POWER_OUTAGE", "voltage", 0.5),
    ("HEALTHCARE", "AMBULANCE_SERVICE", "ambulance", 1.0), ("HEALTHCARE", "HOSPITAL_ACCESS", "hospital", 1.0), ("HEALTHCARE", "MEDICINE_SHORTAGE", "no medicine", 1.0), ("HEALTHCARE", "DOCTOR_SHORTAGE", "no doctor", 1.0), ("HEALTHCARE", "HOSPITAL_ACCESS", "clinic", 0.5), ("HEALTHCARE", "DISEASE_OUTBREAK", "dengue", 1.0),
    ("EDUCATION", "SCHOOL_INFRASTRUCTURE", "school building", 1.0), ("EDUCATION", "TEACHER_SHORTAGE", "no teacher", 1.0), ("EDUCATION", "MIDDAY_MEAL", "midday meal", 1.0), ("EDUCATION", "SCHOOL_ACCESS", "school", 0.5), ("EDUCATION", "SCHOOL_ACCESS", "classroom", 0.5),
    ("SANITATION", "SOLID_WASTE", "garbage", 1.0), ("SANITATION", "SOLID_WASTE", "waste bin", 1.0), ("SANITATION", "DRAINAGE", "drain", 1.0), ("SANITATION", "DRAINAGE", "drainage", 1.0), ("SANITATION", "SEWAGE", "sewage", 1.0), ("SANITATION", "PUBLIC_TOILET", "public toilet", 1.0), ("SANITATION", "MOSQUITOES", "mosquito", 0.5),
    ("TRANSPORT", "BUS_SHELTER", "bus stop", 1.0), ("TRANSPORT", "BUS_FREQUENCY", "no bus", 1.0), ("TRANSPORT", "PUBLIC_TRANSPORT", "bus", 0.5), ("TRANSPORT", "PUBLIC_TRANSPORT", "train", 0.5), ("DIGITAL_CONNECTIVITY", "INTERNET_CONNECTIVITY", "internet", 1.0), ("DIGITAL_CONNECTIVITY", "MOBILE_NETWORK", "mobile network", 1.0), ("DIGITAL_CONNECTIVITY", "MOBILE_NETWORK", "no signal", 1.0), ("DIGITAL_CONNECTIVITY", "INTERNET_CONNECTIVITY", "wifi", 0.5),
    ("HOUSING", "LAND_ENCROACHMENT", "encroachment", 1.0), ("HOUSING", "HOUSING_SCHEME", "housing scheme", 1.0), ("HOUSING", "UNSAFE_BUILDING", "collapsed wall", 1.0), ("HOUSING", "HOUSING_SCHEME", "house", 0.5), ("PUBLIC_SAFETY", "STREET_CRIME", "theft", 1.0), ("PUBLIC_SAFETY", "WOMEN_SAFETY", "harassment", 1.0), ("PUBLIC_SAFETY", "STRAY_ANIMALS", "stray dogs", 1.0), ("PUBLIC_SAFETY", "STREET_CRIME", "police", 0.5),
)
SEVERITY = {"critical": ("danger", "dangerous", "accident", "emergency", "death", "electrocuted", "collapsed"), "high": ("broken", "urgent", "blocked", "contaminated", "severe"), "medium": ("problem", "issue", "damaged", "delay", "dirty"), "mitigator": ("minor", "small", "slight", "suggestion"), "personal_health": ("my child is sick", "fever", "injured", "fell ill")}


def classify(rows: DataFrame, key: str, text: str, floor: float = 0.20, lexicon: DataFrame | None = None) -> DataFrame:
    """(key, category, sub_category, confidence): the category with most matched weight, its share of all; UNKNOWN under the floor.

    Each lexicon term is looked for in the tokens; only matches are exploded, so rows grow with what is found. lexicon(category, sub_category,
    term, weight) of any size takes the place of this module's.
    """
    words = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    hit = F.array(*[F.when(F.contains(F.col("__w"), F.lit(f" {term} ")), F.struct(F.lit(c).alias("category"), F.lit(s).alias("sub_category"), F.lit(w).alias("weight"))) for c, s, term, w in LEXICON])
    told = rows.select(F.col(key), words.alias("__w"))
    if lexicon is None:
        found = told.select(key, F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("h")).select(key, "h.*")
    else:
        entries = lexicon.select(F.lower("term").alias("term"), "category", "sub_category", "weight")
        found = dealt_join(occurrences(told, entries, key, "__w", whole_words=True), entries, key)
    per = found.groupBy(key, "category", "sub_category").agg(F.sum("weight").alias("weight"))
    per = per.withColumns({"of_category": F.sum("weight").over(Window.partitionBy(key, "category")), "of_all": F.sum("weight").over(Window.partitionBy(key))})
    best = per.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("of_category"), "category", F.desc("weight"), "sub_category"))).where("n = 1")
    best = best.select(key, "category", "sub_category", F.round(F.col("of_category") / F.col("of_all"), 4).alias("confidence"))
    out = rows.select(key).join(best, key, "left")
    sure = F.coalesce(F.col("confidence") >= floor, F.lit(False))
    return out.select(key, F.when(sure, F.col("category")).otherwise("UNKNOWN").alias("category"), F.when(sure, F.col("sub_category")).otherwise("UNCLASSIFIED").alias("sub_category"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def severity(text: str, days: Column) -> Column:
    """1 to 5: the strongest word's band, one more from seven days, at least 4 for personal health, at most 2 with a mitigator."""

    def of_words(words: Column) -> Column:
        has = lambda k: reduce(or_, [F.contains(words, F.lit(f" {p} ")) for p in SEVERITY[k]])

        def of_band(band: Column) -> Column:
            score = band + F.when(days >= 7, 1).otherwise(0)
            score = F.when(has("personal_health"), F.greatest(score, F.lit(4))).otherwise(score)
            return F.when((band < 5) & has("mitigator"), F.least(score, F.lit(2))).otherwise(score)

        return once(F.when(has("critical"), 5).when(has("high"), 4).when(has("medium"), 3).otherwise(2), of_band)

    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), BETWEEN, " "), F.lit(" "))
    return once(once(words, of_words), lambda score: clamp(score, 1, 5)).cast("int")


# Number words, and days of each unit of a duration.
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "एक": 1, "दो": 2, "तीन": 3, "चार": 4, "ஒன்று": 1, "இரண்டு": 2, "மூன்று": 3, "நான்கு": 4, "ఒకటి": 1, "రెండు": 2, "మూడు": 3, "నాలుగు": 4}
UNIT_DAYS = {"day": 1, "days": 1, "night": 1, "nights": 1, "din": 1, "दिन": 1, "दिनों": 1, "நாள்": 1, "நாட்கள்": 1, "రోజు": 1, "రోజులు": 1, "week": 7, "weeks": 7, "सप्ताह": 7, "வாரம்": 7, "வாரங்கள்": 7, "month": 30, "months": 30, "महीना": 30, "மாதம்": 30, "மாதங்கள்": 30, "నెల": 30, "నెలల": 30}
_EDGE = r"[\p{L}\p{M}\p{N}_]"
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
# What each kind of entity looks like in lower case, and how sure it is.
ENTITIES = {
    "COORDINATE": (r"-?\d{1,2}\.\d{3,}\s*[,/]?\s*-?\d{1,3}\.\d{3,}", 0.99),
    "PHONE": (r"(?:\+?91[\s-]?)?[6-9]\d{9}(?!\d)", 0.95),
    "PINCODE": (r"(?<!\d)\d{6}(?!\d)", 0.97),
    "DURATION": (rf"(?<!{_EDGE})(?:for\s+|since\s+)?(?:\d{{1,3}}|{'|'.join(NUMBERS)})\s+(?:{'|'.join(sorted(UNIT_DAYS, key=lambda u: (-len(u), u)))})(?!{_EDGE})", 0.80),
    "SINCE": (rf"(?<!{_EDGE})(?:since|for a long time|for months|for weeks|மாதங்கள்|వారాలుగా|महीनों|दिनों)(?!{_EDGE})", 0.80),
    "DATE": (rf"(?<!{_EDGE})(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|{_MONTHS})(?!{_EDGE})", 0.70),
}
#: Our own gazetteer of kinds of places and things.
PLACES = {"LANDMARK": ("hospital", "railway station", "bus stop", "market", "temple", "school"), "ADMIN_UNIT": ("ward", "district", "panchayat", "taluk", "nagar"), "INFRA_ASSET": ("street light", "transformer", "borewell", "drain", "bridge", "water tank")}
PLACE_CONFIDENCE = 0.85


def matches(text: str, pattern: str) -> Column:
    """Array of (value, start, stop) of a pattern's matches in a column, by the lengths of the pieces between them."""
    pieces = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("value"), F.split(F.col(text), pattern, -1).alias("gap"))
    none = F.array().cast("array<struct<value:string,start:int,stop:int>>")
    start = lambda s, x: s["at"] + F.length(x["gap"])
    step = lambda s, x: F.struct((start(s, x) + F.coalesce(F.length(x["value"]), F.lit(0))).alias("at"), F.when(x["value"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(x["value"].alias("value"), start(s, x).alias("start"), (start(s, x) + F.length(x["value"])).alias("stop"))))).alias("out"))
    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])


def entities(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, type, value, start, stop, confidence, amount, unit): entities of normal text, of each span the surest; a relative time has no amount.

    Coordinates must be a point. Places are found as words of the text, at the first place where they stand.
    """
    low = rows.select(key, F.lower(normalize_text(text)).alias("__t"))
    number = lambda m: F.regexp_extract(m["value"], r"(\S+)\s+\S+$", 1)
    part = lambda m, i: F.regexp_extract(m["value"], r"(-?\d{1,2}\.\d{3,})\s*[,/]?\s*(-?\d{1,3}\.\d{3,})", i).try_cast("double")

    def of(kind: str, pattern: str, sure: float) -> Column:
        spans = matches("__t", pattern)
        if kind == "COORDINATE":
            spans = F.filter(spans, lambda m: part(m, 1).between(-90, 90) & part(m, 2).between(-180, 180))

        def made(m: Column) -> Column:
            amount = F.coalesce(lookup(number(m), NUMBERS), number(m).try_cast("int")) if kind == "DURATION" else F.lit(None)
            unit = F.regexp_extract(m["value"], r"(\S+)$", 1) if kind == "DURATION" else F.lit("relative" if kind == "SINCE" else None)
            return F.struct(F.lit("DURATION" if kind == "SINCE" else kind).alias("type"), m["value"].alias("value"), m["start"].alias("start"), m["stop"].alias("stop"), F.lit(sure).alias("confidence"), amount.cast("int").alias("amount"), unit.cast("string").alias("unit"))

        return F.transform(spans, made)

    found = [of(kind, pattern, sure) for kind, (pattern, sure) in ENTITIES.items()]
    terms = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(t).alias("value")) for k, names in PLACES.items() for t in names])
    padded = F.concat(F.lit(" "), F.array_join(tokens("__t"), " "), F.lit(" "))
    at = lambda p: F.greatest(F.call_function("instr", F.col("__t"), p["value"]) - 1, F.lit(0))
    here = F.filter(terms, lambda p: F.contains(F.col("__w"), F.concat(F.lit(" "), p["value"], F.lit(" "))))
    found.append(F.transform(here, lambda p: F.struct(p["type"].alias("type"), p["value"].alias("value"), at(p).cast("int").alias("start"), (at(p) + F.length(p["value"])).cast("int").alias("stop"), F.lit(PLACE_CONFIDENCE).alias("confidence"), F.lit(None).cast("int").alias("amount"), F.lit(None).cast("string").alias("unit"))))
    every = low.withColumn("__w", padded).select(key, F.explode(F.flatten(F.array(*found))).alias("e")).select(key, "e.*")
    return surest(every, key)


def surest(found: DataFrame, key: str) -> DataFrame:
    """Of the entities on one span the one of the highest confidence, then of the first type by name."""
    rest = [c for c in found.columns if c not in (key, "start", "stop")]
    best = found.groupBy(key, "start", "stop").agg(F.min_by(F.struct(*rest), F.struct((-F.col("confidence")).alias("c"), "type", "value")).alias("e"))
    return best.select(key, "e.type", "e.value", "start", "stop", *[f"e.{c}" for c in rest if c not in ("type", "value")])


def merged_entities(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of the first pass, and of the second what the first does not know by type and text."""
    known = first.select(key, "type", F.lower("value").alias("__v")).distinct()
    return first.unionByName(second.withColumn("__v", F.lower("value")).join(known, [key, "type", "__v"], "left_anti").drop("__v"))


def longest_days(found: DataFrame, key: str) -> DataFrame:
    """(key, days): the longest duration with an amount."""
    days = F.col("amount") * lookup("unit", UNIT_DAYS)
    return found.where("type = 'DURATION' and amount is not null").groupBy(key).agg(F.max(days).alias("days")).where("days is not null")


def translate(text: Column, glossary: dict[str, str]) -> Column:
    """(gloss, hits, confidence): each term replaced, longest first."""
    terms = sorted(glossary, key=lambda t: (-len(t), t))
    out, hits = text, F.lit(0)
    for t in terms:
        hits = hits + (F.length(out) - F.length(F.replace(out, F.lit(t), F.lit("")))) / len(t)
        out = F.replace(out, F.lit(t), F.lit(glossary[t]))
    return F.struct(out.alias("gloss"), hits.cast("long").alias("hits"), F.least(F.lit(0.6), 0.2 + 0.08 * hits).alias("confidence"))


def request_id_valid(x: str) -> Column:
    return F.coalesce(F.col(x).rlike(r"^[A-Za-z0-9_-]{1,64}$") & F.col(x).rlike("[A-Za-z0-9]"), F.lit(False))


#: A date, alone or with a time of the day, and its zone, in the long and the short form of ISO 8601.
ISO_TIME = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?([Zz]|[+-]\d{2}(?::?\d{2})?)?)?$"
#: Seconds since 1970 of the first and the last moment that a timestamp can be.
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799


def parsed_time(x: str) -> Column:
    """ISO and other written times, or seconds or milliseconds since 1970; null where it is none, whatever the text is. Times without a zone are UTC; eight digits are a date."""
    text = F.trim(F.col(x))
    part = lambda i: F.regexp_extract(text, ISO_TIME, i)
    filled = lambda i: F.when(part(i) == "", "00").otherwise(part(i))
    zone = F.when(part(8).rlike("^[+-]"), F.rpad(F.replace(part(8), F.lit(":")), 5, "0")).otherwise("+0000")
    iso = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), filled(4), F.lit(":"), filled(5), F.lit(":"), filled(6), F.lit("."), F.rpad(part(7), 6, "0"), F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))
    number = F.when(~text.rlike(r"^\d{8}$") & text.rlike(r"^[+-]?\d+([.]\d+)?([eE][+-]?\d+)?$"), text.try_cast("double"))
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    epoch = F.when(seconds.between(FIRST_SECOND, LAST_SECOND), F.timestamp_micros((seconds * 1e6).try_cast("long")))
    # a text without a pattern's signs isn't tried, as a failure costs much more than the look
    has = lambda p: reduce(and_, [F.contains(text, F.lit(c)) for c in sorted(set(p) & set("/-:"))])
    written = [F.when(has(p), F.try_to_timestamp(F.concat(text, F.lit(" +00:00")), F.lit(f"{p} xxx"))) for p in ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd")]
    return F.coalesce(F.when(text.rlike(ISO_TIME), iso.try_cast("timestamp")), epoch, *written)


def findings(as_of: Column) -> Column:
    """Array of (code, severity) for a record of category, sub_category, latitude, longitude, created_at, severity, description, language."""
    have = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    half = F.col("latitude").isNotNull() != F.col("longitude").isNotNull()
    # Codes and levels of the findings.
    rules = [
        (F.col("category").isNull(), "MISSING_CATEGORY", "error"),
        (F.col("category").isNotNull() & ~F.col("category").isin(*SECTORS), "INVALID_CATEGORY", "error"),
        (F.col("sub_category").isNull() | (F.col("sub_category") == "UNCLASSIFIED"), "MISSING_SUB_CATEGORY", "warning"),
        (~have & ~half, "MISSING_LOCATION", "error"),
        (half, "INCOMPLETE_COORDINATES", "error"),
        (have & ~valid_point("latitude", "longitude"), "INVALID_COORDINATES", "error"),
        (F.col("created_at").isNull(), "MISSING_TIMESTAMP", "error"),
        (F.col("created_at") > as_of + F.expr("interval 1 day"), "FUTURE_TIMESTAMP", "warning"),
        (F.year("created_at") < 1970, "IMPLAUSIBLE_TIMESTAMP", "error"),
        (F.col("severity").isNull(), "MISSING_SEVERITY", "warning"),
        (~F.col("severity").between(1, 5), "INVALID_SEVERITY", "error"),
        (F.coalesce(F.trim("description"), F.lit("")) == "", "MISSING_DESCRIPTION", "warning"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"))) for c, code, level in rules]), lambda x: x.isNotNull())


def all_findings(as_of: Column) -> Column:
    """Array of (code, severity) of a record that has been cleaned, normalised and geocoded.

    Reads request_id_valid, category, description, norm_category, norm_sub_category, norm_mismatch, norm_source, location_present, latitude, longitude,
    location_status, created_at, severity, language_supported. Without a place nothing else is said of it.
    """
    lat, lon, placed = F.col("latitude"), F.col("longitude"), F.col("location_present")
    half = lat.isNull() != lon.isNull()
    # Codes and levels of the findings.
    rules = [
        (~F.col("request_id_valid"), "INVALID_REQUEST_ID", "error"),
        (F.col("category").isNull() & F.col("description").isNull(), "MISSING_CATEGORY", "error"),
        (F.col("norm_category") == "UNKNOWN", "INVALID_CATEGORY", "error"),
        (F.col("norm_sub_category") == "UNCLASSIFIED", "MISSING_SUB_CATEGORY", "warning"),
        (F.col("norm_mismatch"), "CATEGORY_SUBCATEGORY_MISMATCH", "warning"),
        (~placed, "MISSING_LOCATION", "error"),
        (placed & half, "INCOMPLETE_COORDINATES", "error"),
        (placed & lat.isNotNull() & lon.isNotNull() & ~valid_point(lat, lon), "INVALID_COORDINATES", "error"),
        (placed & (F.col("location_status") == "UNRESOLVED"), "LOCATION_UNRESOLVED", "warning"),
        (placed & (F.col("location_status") == "PARTIAL"), "LOCATION_PARTIALLY_RESOLVED", "warning"),
        (F.col("created_at").isNull(), "MISSING_TIMESTAMP", "error"),
        (F.col("created_at") > as_of + F.expr("interval 1 day"), "FUTURE_TIMESTAMP", "warning"),
        (F.year("created_at") < 1970, "IMPLAUSIBLE_TIMESTAMP", "error"),
        (F.col("severity").isNull(), "MISSING_SEVERITY", "warning"),
        (~F.col("severity").between(1, 5), "INVALID_SEVERITY", "error"),
        (F.col("description").isNull(), "MISSING_DESCRIPTION", "warning"),
        (~F.col("language_supported"), "UNSUPPORTED_LANGUAGE", "warning"),
        (F.col("norm_source") == "fallback", "NORMALIZATION_FAILED", "error"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"))) for c, code, level in rules]))


def status_of(found: str) -> Column:
    return F.when(F.exists(found, lambda f: f["severity"] == "error"), "INVALID").when(F.exists(found, lambda f: f["severity"] == "warning"), "NEEDS_REVIEW").otherwise("VALID")


# Weights of the quality factors, and the least score of a valid record.
QUALITY_WEIGHTS = {"required": 0.22, "location": 0.14, "category": 0.14, "timestamp": 0.10, "geocode": 0.14, "severity": 0.10, "description": 0.16}
VALID_SCORE = 0.85


def quality(as_of: Column) -> dict[str, Column]:
    """Factors from 0 to 1 of a record as for ``all_findings``, with district, state and location_text."""
    have = valid_point("latitude", "longitude")
    admin = F.col("district").isNotNull() | F.col("state").isNotNull()
    present = lambda c: F.when(c, 0.25).otherwise(0.0)
    return {
        "required": present(F.col("request_id_valid")) + present(F.col("category").isNotNull() | F.col("description").isNotNull()) + present(F.col("location_present")) + present(F.col("created_at").isNotNull()),
        "location": F.when(have & admin, 1.0).when(have, 0.75).when(admin, 0.6).when(F.col("location_text").isNotNull(), 0.35).otherwise(0.0),
        "category": F.when(F.col("norm_category") == "UNKNOWN", 0.1).when(F.col("norm_sub_category") == "UNCLASSIFIED", 0.75).otherwise(1.0),
        "timestamp": F.when(F.col("created_at").isNull(), 0.0).when(F.col("created_at") > as_of, 0.4).when(F.year("created_at") < 1970, 0.2).otherwise(1.0),
        "geocode": F.when(F.col("location_status") == "RESOLVED", 1.0).when(F.col("location_status") == "PARTIAL", 0.6).otherwise(0.0),
        "severity": F.when(F.col("severity").isNull(), 0.4).when(F.col("severity").between(1, 5), 1.0).otherwise(0.0),
        "description": F.when(F.coalesce(F.trim("description"), F.lit("")) != "", 1.0).otherwise(0.0),
    }


def quality_score(as_of: Column) -> Column:
    total = F.lit(0.0)
    for k, v in quality(as_of).items():
        total = total + v * QUALITY_WEIGHTS[k]
    return F.round(total / sum(QUALITY_WEIGHTS.values()), 3)


def quality_status(validation: str, score: str) -> Column:
    """The status of the findings, but that a valid record needs a score too."""
    return F.when(F.col(validation).isin("INVALID", "NEEDS_REVIEW"), F.col(validation)).when(F.col(score) >= VALID_SCORE, "VALID").otherwise("NEEDS_REVIEW")


# ---- ingestion -------------------------------------------------------------
def first_by_request(rows: DataFrame) -> DataFrame:
    """One row of each request: the first by time, then event."""
    order = Window.partitionBy("request_id").orderBy("ts", "event_id")
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def running_demand(rows: DataFrame) -> DataFrame:
    """Counts, true mean severity and span of each user and event type; replays are taken out before."""
    return first_by_request(rows).groupBy("user_id", "event_type").agg(F.count("*").alias("complaint_count"), F.round(F.avg("severity"), 6).alias("avg_severity"), F.max("severity").alias("max_severity"), F.count_if(F.col("severity") >= 4).alias("critical_count"), F.min("ts").alias("observed_from"), F.max("ts").alias("observed_to"))


def event_type_for(status: str) -> Column:
    return F.when(F.col(status) == "VALID", "CIVIC_RECORD_PROCESSED").when(F.col(status) == "NEEDS_REVIEW", "CIVIC_RECORD_NEEDS_REVIEW").otherwise("CIVIC_RECORD_REJECTED")
