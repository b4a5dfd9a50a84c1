"""Raw complaints: cleaning with a list of what was found wrong, and what follows from a cleaned record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.functions.columns import lookup, valid_point
from wardloom.functions.text import normalize_text, once, to_double
from wardloom.operators.records import parsed_time
from wardloom.vocab import LANGUAGE_NAMES, NULL_TOKENS, SUPPORTED_LANGUAGES

# Characters of a description and of another text at most, keys that a description and a place may stand under, mandatory fields.
MOST_DESCRIPTION, MOST_TEXT, MOST_ID = 5_000, 1_000, 64
DESCRIPTION_KEYS = ("text", "description", "message", "content", "raw_text")
PLACE_KEYS = ("text", "address", "place", "name")
MANDATORY = ("request_id", "category", "location", "created_at")
#: A text of more bytes is no null token: a character has four at most, and none becomes fewer in lower case.
MOST_NULL_BYTES = 4 * max(map(len, NULL_TOKENS))


def _text(x: str) -> Column:
    return F.when(F.trim(F.col(x).cast("string")) != "", F.col(x).cast("string"))


def _usable(x: Column) -> Column:
    """Normal text, null where it stands for nothing."""
    nothing = lambda plain: (F.octet_length(plain) <= MOST_NULL_BYTES) & F.lower(plain).isin(*NULL_TOKENS)
    return once(normalize_text(x), lambda plain: F.when((plain != "") & ~nothing(plain), plain))


def _issue(when: Column, code: str, field: str, severity: str = "error") -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("field")))


def clean_request_id(x: str = "request_id", row_key: str = "event_id") -> tuple[Column, list[Column]]:
    """A usable id, or one made from the row's key, so that a replay gets the same."""
    given = F.trim(_text(x))
    good = F.coalesce(F.regexp_replace(given, "[-_]", "").rlike(r"^[\p{L}\p{N}]+$") & (F.length(given) <= MOST_ID), F.lit(False))
    made = F.concat(F.lit("REQ-UNASSIGNED-"), F.upper(F.substring(F.sha2(F.col(row_key).cast("string"), 256), 1, 12)))
    return F.when(good, given).otherwise(made), [_issue(given.isNull(), "MISSING_REQUEST_ID", "request_id"), _issue(given.isNotNull() & ~good, "MALFORMED_REQUEST_ID", "request_id")]


def clean_language(x: str = "language") -> tuple[Column, Column, list[Column]]:
    """The code of a language, if texts are normalised in it, and the issues; of an unknown one the first ten characters."""
    given = _text(x)
    key = F.lower(F.trim(given))
    names = {n: code for code, all_names in LANGUAGE_NAMES.items() for n in all_names}
    code = F.coalesce(lookup(key, names), lookup(F.substring_index(key, "-", 1), names))
    supported = F.coalesce(code.isin(*SUPPORTED_LANGUAGES), F.lit(False))
    issues = [_issue(given.isNull(), "MISSING_LANGUAGE", "language", "warning"), _issue(given.isNotNull() & code.isNull(), "UNKNOWN_LANGUAGE", "language", "warning"), _issue(code.isNotNull() & ~supported, "LANGUAGE_NOT_SUPPORTED", "language", "warning")]
    return F.coalesce(code, F.substring(key, 1, 10)), supported, issues


def clean_description(keys: tuple[str, ...]) -> tuple[Column, list[Column]]:
    """The first text that is not blank under the keys, normal and cut."""
    plain = _usable(F.coalesce(*[_text(k) for k in keys]))
    return F.substring(plain, 1, MOST_DESCRIPTION), [_issue(F.length(plain) > MOST_DESCRIPTION, "DESCRIPTION_TRUNCATED", "description", "warning")]


def clean_text(x: str) -> Column:
    """Another text: null where it stands for nothing, else normal and cut."""
    return F.substring(_usable(_text(x)), 1, MOST_TEXT)


def clean_severity(x: str = "severity", number: Column | None = None) -> tuple[Column, list[Column]]:
    """A number, kept though it may lie outside 1 to 5; number is that of x where it has been read already."""
    number = to_double(F.col(x).cast("string")) if number is None else number
    return number, [_issue(number.isNull() & (F.coalesce(F.col(x).cast("string"), F.lit("")) != ""), "MALFORMED_SEVERITY", "severity", "warning"), _issue(~number.between(1, 5), "SEVERITY_OUT_OF_RANGE", "severity")]


def clean_point(latitude: Column, longitude: Column, numbers: tuple[Column, Column] | None = None) -> tuple[Column, Column, list[Column]]:
    """Two numbers, kept though they may be no point; numbers are those of both where they have been read already."""
    lat, lon = numbers or (to_double(latitude), to_double(longitude))
    bad = lambda raw, x: (F.coalesce(F.trim(raw), F.lit("")) != "") & x.isNull()
    issues = [_issue(bad(latitude, lat) | bad(longitude, lon), "MALFORMED_COORDINATES", "location"), _issue(~lat.between(-90, 90) | ~lon.between(-180, 180), "COORDINATES_OUT_OF_RANGE", "location"), _issue(lat.isNull() != lon.isNull(), "INCOMPLETE_COORDINATES", "location")]
    return lat, lon, issues


def nested_or_flat(nested: str, flat: str, path: str) -> Column:
    """A value of a nested JSON text, else of a column of its own."""
    return F.coalesce(F.get_json_object(nested, path), F.col(flat).cast("string"))


def clean(rows: DataFrame, as_of: Column, row_key: str = "event_id") -> DataFrame:
    """Cleaned records of raw ones.

    rows: row_key, request_id, language, category, sub_category, severity, created_at, latitude, longitude (texts), location (a JSON text or null), place (a text) and any
    of DESCRIPTION_KEYS. Gives row_key, the cleaned fields, flags that follow from them, ``missing`` (mandatory fields without a value) and
    ``issues`` (code, severity, field). No row is lost: what can't be read is null and has its issue.
    """
    have = [k for k in DESCRIPTION_KEYS if k in rows.columns]
    # numbers and times are columns of their own, so that they are read once, not again for each issue
    rows = rows.withColumns({"__severity": to_double(F.col("severity").cast("string")), "__latitude": nested_or_flat("location", "latitude", "$.latitude"), "__longitude": nested_or_flat("location", "longitude", "$.longitude"), "__at": parsed_time("created_at")})
    rows = rows.withColumns({"__lat": to_double("__latitude"), "__lon": to_double("__longitude")})
    request, i1 = clean_request_id("request_id", row_key)
    language, supported, i2 = clean_language()
    description, i3 = clean_description(tuple(have))
    severity, i4 = clean_severity("severity", F.col("__severity"))
    lat, lon, i5 = clean_point(F.col("__latitude"), F.col("__longitude"), (F.col("__lat"), F.col("__lon")))
    place = F.coalesce(*[_usable(F.get_json_object("location", f"$.{k}")) for k in PLACE_KEYS], clean_text("place"))
    at = F.col("__at")
    i6 = [_issue(_text("created_at").isNull(), "MISSING_TIMESTAMP", "created_at"), _issue(_text("created_at").isNotNull() & at.isNull(), "MALFORMED_TIMESTAMP", "created_at"), _issue(at > as_of + F.expr("interval 1 day"), "FUTURE_TIMESTAMP", "created_at", "warning"), _issue(at < F.lit("1970-01-01").cast("timestamp"), "IMPLAUSIBLE_TIMESTAMP", "created_at")]
    out = rows.select(
        row_key, request.alias("request_id"), i1[0].isNull().__and__(i1[1].isNull()).alias("request_id_valid"), language.alias("language"), supported.alias("language_supported"), clean_text("category").alias("category"), clean_text("sub_category").alias("sub_category"),
        description.alias("description"), severity.alias("severity"), lat.alias("latitude"), lon.alias("longitude"), place.alias("location_text"), at.alias("created_at"), F.array_compact(F.array(*i1, *i2, *i3, *i4, *i5, *i6)).alias("issues"),
    )
    out = out.withColumns(derived_flags())
    there = {"request_id": F.col("request_id_valid"), "category": F.col("category").isNotNull() | F.col("description").isNotNull(), "location": F.col("location_present"), "created_at": F.col("created_at").isNotNull()}
    return out.withColumn("missing", F.array_compact(F.array(*[F.when(~there[f], f) for f in MANDATORY])))


def derived_flags() -> dict[str, Column]:
    """What follows from a cleaned record."""
    return {
        "coordinates_present": F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
        "coordinates_valid": valid_point("latitude", "longitude"),
        "location_present": F.col("latitude").isNotNull() | F.col("longitude").isNotNull() | F.col("location_text").isNotNull(),
        "severity_valid": F.coalesce(F.col("severity").between(1, 5), F.lit(False)),
        "has_errors": F.exists("issues", lambda i: i["severity"] == "error"),
    }


def of_severity(found: str, severity: str) -> Column:
    """The findings of one severity."""
    return F.filter(found, lambda f: f["severity"] == severity)


def media_type(has_text: Column, has_audio: Column, has_image: Column) -> Column:
    many = has_text.cast("int") + has_audio.cast("int") + has_image.cast("int")
    return F.when(many > 1, "MULTIMODAL").when(has_audio, "AUDIO").when(has_image, "IMAGE").otherwise("TEXT")


def intake_reject(text: str, latitude: str, longitude: str) -> Column:
    """Why a new request is refused, null if it is taken: it has neither text nor place, or half a point, or one out of range."""
    lat, lon = F.col(latitude), F.col(longitude)
    nothing = (F.coalesce(F.trim(text), F.lit("")) == "") & lat.isNull() & lon.isNull()
    return F.when(nothing, "no text or location").when(lat.isNull() != lon.isNull(), "half a point").when(lat.isNotNull() & ~valid_point(lat, lon), "out of range")


def understanding_status(stages: str, texts: list[str]) -> Column:
    """UNDERSTOOD if every stage of a map is OK or SKIPPED, FAILED if one failed and no text is left, else PARTIAL."""
    values = F.map_values(stages)
    good = F.forall(values, lambda v: v.isin("OK", "SKIPPED"))
    none = F.lit(True)
    for t in texts:
        none = none & (F.coalesce(F.col(t), F.lit("")) == "")
    return F.when(good, "UNDERSTOOD").when(F.array_contains(values, "FAILED") & none, "FAILED").otherwise("PARTIAL")


def processing_status(quality: str) -> Column:
    return F.when(F.col(quality) == "INVALID", "REJECTED").when(F.col(quality) == "NEEDS_REVIEW", "NEEDS_REVIEW").otherwise("PROCESSED")
