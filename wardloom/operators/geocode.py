"""Offline geocoding against a gazetteer of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.functions.columns import valid_point
from wardloom.functions.grid import within
from wardloom.operators.terms import dealt_join, occurrences

#: Degrees of a cell that boxes are dealt to.
CELL = 1.0
# Confidence by the way in which a place was found.
CONFIDENCE = {"gazetteer_text": 0.90, "gazetteer_text_without_point": 0.60, "gazetteer_bbox": 0.80, "nearest_place": 0.70, "country": 0.40, "coordinates": 0.30}


def by_text(rows: DataFrame, gazetteer: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place): the place whose alias stands in the text, the longest alias first, then the least.

    Names are looked for in one pass over the texts; of an alias of several places the least counts. A row without any has a null place.
    """
    names = gazetteer.select(F.lower("alias").alias("term"), "place").where("term <> ''").groupBy("term").agg(F.min("place").alias("place"))
    found = occurrences(rows, names, key, text).groupBy(key).agg(F.min(F.struct((-F.length("term")).alias("n"), "term"))["term"].alias("term"))
    return rows.select(key).join(dealt_join(found, names, key).select(key, "place"), key, "left")


def _boxed(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """rows(lat, lon) with every box(south, north, west, east, ...) around them; both meet in cells of a degree. A box whose west lies east of its east goes across 180 degrees."""
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / CELL), F.floor(F.col(high) / CELL)))
    sides = F.when(F.col("west") <= F.col("east"), F.array(F.struct("west", "east"))).otherwise(F.array(F.struct("west", F.lit(180.0).alias("east")), F.struct(F.lit(-180.0).alias("west"), "east")))
    rest = [c for c in boxes.columns if c not in ("west", "east")]
    dealt = boxes.where("south <= north and west is not null and east is not null").withColumns({"west": F.col("west").cast("double"), "east": F.col("east").cast("double")}).select(*rest, F.explode(sides).alias("__side")).select(*rest, "__side.*")
    dealt = dealt.withColumn("__y", cells("south", "north")).withColumn("__x", cells("west", "east"))
    here = rows.withColumns({"__y": F.floor(F.col("lat") / CELL), "__x": F.floor(F.col("lon") / CELL)})
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    return here.join(dealt, ["__y", "__x"]).where(inside).drop("__y", "__x")


def by_box(rows: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """(key, place): the smallest of boxes(place, south, north, west, east) around rows(key, lat, lon)."""
    area = (F.col("north") - F.col("south")) * (F.col("east") - F.col("west") + F.when(F.col("west") > F.col("east"), 360).otherwise(0))
    best = _boxed(rows.select(key, "lat", "lon"), boxes.withColumn("__area", area)).groupBy(key).agg(F.min(F.struct("__area", "place"))["place"].alias("place"))
    return rows.select(key).join(best, key, "left")


def country_of(rows: DataFrame, countries: DataFrame, key: str) -> DataFrame:
    """(key, country): the first in order of countries(country, order, south, north, west, east) around rows(key, lat, lon)."""
    best = _boxed(rows.select(key, "lat", "lon"), countries).groupBy(key).agg(F.min_by("country", "order").alias("country"))
    return rows.select(key).join(best, key, "left")


def nearest(rows: DataFrame, gazetteer: DataFrame, key: str, most_m: float = 60_000.0) -> DataFrame:
    """(key, place, metres): the nearest of gazetteer(place, p_lat, p_lon) within most_m."""
    pairs = within(rows.select(key, "lat", "lon"), gazetteer.select("place", "p_lat", "p_lon"), ("lat", "lon"), ("p_lat", "p_lon"), most_m)
    best = pairs.groupBy(key).agg(F.min(F.struct("metres", "place")).alias("b"))
    return rows.select(key).join(best, key, "left").select(key, F.col("b.place").alias("place"), F.col("b.metres").alias("metres"))


def location_status(have_point: Column, have_admin: Column) -> Column:
    return F.when(have_point & have_admin, "RESOLVED").when(have_point | have_admin, "PARTIAL").otherwise("UNRESOLVED")


def admin_line(*parts: str) -> Column:
    """The administrative parts that are there, from small to large."""
    return F.concat_ws(", ", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts])


def geocode(rows: DataFrame, places: DataFrame, aliases: DataFrame, countries: DataFrame, key: str, text: str) -> DataFrame:
    """rows(key, text, lat, lon) resolved by the first way that finds a place.

    A place named in the text, then the smallest place whose box holds the point, then the nearest within its limit, then the point alone with its country.
    places: (place, district, state, p_lat, p_lon, south, north, west, east); aliases: (alias, place). Gives key, place, district, state, country,
    latitude, longitude (the row's own point where it is valid), method, confidence and status. A row without place or point is UNRESOLVED.
    """
    pointed = valid_point("lat", "lon")
    named = by_text(rows, aliases, key, text).withColumnRenamed("place", "by_text")
    pts = rows.where(pointed).select(key, "lat", "lon")
    boxed = by_box(pts, places.where("south is not null"), key).withColumnRenamed("place", "by_box")
    near = nearest(pts, places.where(valid_point("p_lat", "p_lon")), key).select(key, F.col("place").alias("by_point"))
    out = rows.join(named, key, "left").join(boxed, key, "left").join(near, key, "left").join(country_of(pts, countries, key), key, "left")
    out = out.withColumn("place", F.coalesce("by_text", "by_box", "by_point"))
    out = out.join(places.select("place", "district", "state", "p_lat", "p_lon"), "place", "left")
    has_point = valid_point("p_lat", "p_lon")
    method = F.when(F.col("by_text").isNotNull() & pointed, "gazetteer_text+coordinates").when(F.col("by_text").isNotNull(), "gazetteer_text").when(F.col("by_box").isNotNull(), "gazetteer_bbox").when(F.col("by_point").isNotNull(), "nearest_place").when(pointed, "coordinates_only").otherwise("unresolved")
    sure = F.when(F.col("by_text").isNotNull(), F.when(has_point, CONFIDENCE["gazetteer_text"]).otherwise(CONFIDENCE["gazetteer_text_without_point"])).when(F.col("by_box").isNotNull(), CONFIDENCE["gazetteer_bbox"]).when(F.col("by_point").isNotNull(), CONFIDENCE["nearest_place"])
    sure = sure.when(pointed, F.when(F.col("country").isNotNull(), CONFIDENCE["country"]).otherwise(CONFIDENCE["coordinates"])).otherwise(0.0)
    latitude, longitude = F.when(pointed, F.col("lat")).otherwise(F.col("p_lat")), F.when(pointed, F.col("lon")).otherwise(F.col("p_lon"))
    status = location_status(valid_point(latitude, longitude), F.col("district").isNotNull() | F.col("state").isNotNull())
    return out.select(key, "place", "district", "state", "country", latitude.alias("latitude"), longitude.alias("longitude"), method.alias("method"), sure.alias("confidence"), status.alias("status"))


def with_hints(found: DataFrame, hints: DataFrame, key: str) -> DataFrame:
    """found by ``geocode``, its gaps filled from hints(key, district, state, country, lat, lon), and the status by one rule."""
    h = hints.select(key, *[F.col(c).alias(f"hint_{c}") for c in ("district", "state", "country", "lat", "lon")])
    out = found.join(h, key, "left")
    fill = F.col("latitude").isNull() & valid_point("hint_lat", "hint_lon")
    out = out.withColumns({"district": F.coalesce("district", "hint_district"), "state": F.coalesce("state", "hint_state"), "country": F.coalesce("country", "hint_country"), "latitude": F.when(fill, F.col("hint_lat")).otherwise(F.col("latitude")), "longitude": F.when(fill, F.col("hint_lon")).otherwise(F.col("longitude"))})
    out = out.withColumn("status", location_status(valid_point("latitude", "longitude"), F.col("district").isNotNull() | F.col("state").isNotNull()))
    return out.drop(*[f"hint_{c}" for c in ("district", "state", "country", "lat", "lon")])


def first_resolved(key: str, *tries: DataFrame) -> DataFrame:
    """A chain of geocoders: of each key the RESOLVED row of the first that has one, then PARTIAL ones, else the first's own."""
    rank = F.when(F.col("status") == "RESOLVED", 0).when(F.col("status") == "PARTIAL", 1).otherwise(2)
    every = None
    for i, t in enumerate(tries):
        t = t.withColumn("__order", F.struct(rank.alias("rank"), F.lit(i).alias("at")))
        every = t if every is None else every.unionByName(t)
    columns = [c for c in every.columns if c not in (key, "__order")]
    best = every.groupBy(key).agg(F.min_by(F.struct(*columns), "__order").alias("b"))
    return best.select(key, "b.*")
