"""Joins of points within a distance, through a grid over the globe."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.functions.columns import haversine_m

EARTH_M = 6_371_008.8


def bounding_box(lat: Column, lon: Column, radius_m: Column | float, floor: float = 1e-6, degree_m: float | None = None) -> dict[str, Column]:
    """South, north, west and east of a circle: by the earth's radius, or by ``degree_m`` metres to a degree. cos(latitude) is at least ``floor``; latitudes are clamped."""
    metres = F.lit(radius_m) if isinstance(radius_m, (int, float)) else radius_m
    dy = metres / degree_m if degree_m else F.degrees(metres / EARTH_M)
    dx = dy / F.greatest(F.cos(F.radians(lat)), F.lit(floor))
    return {"south": F.greatest(lat - dy, F.lit(-90.0)), "north": F.least(lat + dy, F.lit(90.0)), "west": lon - dx, "east": lon + dx}


def within(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], radius_m: float, earth_m: float = EARTH_M) -> DataFrame:
    """Rows of left and right, whose column names differ, with their distance in ``metres`` where it is ``radius_m`` or less.

    Both sides meet in cells as high as the radius; a row of right goes to the neighbouring ones, to as many east and west as its latitude
    asks for, all around near a pole, and across 180 degrees. Each pair meets once. Points that are not valid meet none.
    """
    step = math.degrees(radius_m / earth_m)
    cell = max(step, 0.01)
    n = max(1, int(360 / cell))
    width = 360 / n
    row = lambda lat: F.floor((F.col(lat) + 90) / cell)
    column = lambda lon: F.floor((F.col(lon) + 180) / width)
    here = left.withColumns({"__y": row(left_at[0]), "__x": F.pmod(column(left_at[1]), F.lit(n))})
    part = F.lit(math.sin(radius_m / earth_m)) / F.greatest(F.cos(F.radians(F.abs(F.col(right_at[0])))), F.lit(1e-12))
    reach = F.when(part < 1, F.ceil(F.degrees(F.asin(F.least(part, F.lit(1.0)))) / width)).otherwise(F.lit(n))
    offsets = F.when(2 * reach + 1 >= n, F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).otherwise(F.sequence(-reach, reach))
    there = right.withColumn("__dy", F.explode(F.expr("sequence(-1L, 1L)"))).withColumn("__dx", F.explode(offsets))
    there = there.withColumns({"__y": row(right_at[0]) + F.col("__dy"), "__x": F.pmod(column(right_at[1]) + F.col("__dx"), F.lit(n))}).drop("__dy", "__dx")
    met = here.join(there, ["__y", "__x"]).drop("__y", "__x")
    return met.withColumn("metres", haversine_m(*left_at, *right_at, earth_m)).where(F.col("metres") <= radius_m)


def tiles(lat: Column, lon: Column, size: float, radius_m: float = 0.0, lead: str = "") -> Column:
    """Array of the names of the tiles that a circle touches, behind ``lead``; one for a point. Tiles are ``size`` degrees high and as wide or wider, in metres, at every latitude; they end at 180 degrees and meet there."""
    reach = math.degrees(radius_m / EARTH_M) * (1 + 1e-9)
    rows = max(1, int(180 / size))
    height = 180 / rows
    row = lambda y: F.greatest(F.lit(0), F.least(F.lit(rows - 1), F.floor((y + 90) / height))).cast("int")
    part = F.lit(math.sin(math.radians(min(reach, 90.0)))) / F.greatest(F.cos(F.radians(F.abs(lat))), F.lit(1e-12))
    east = F.when(part < 1, F.degrees(F.asin(F.least(part, F.lit(1.0)))) * (1 + 1e-9)).otherwise(F.lit(180.0))

    name = lambda r, c: F.concat(F.lit(lead), F.concat_ws(":", r, c))

    def across(r: Column) -> Column:
        edge = F.greatest(F.abs(r * height - 90), F.abs((r + 1) * height - 90))
        return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / height)).cast("int")

    def of(r: Column) -> Column:
        n = across(r)
        low, high = F.floor((lon + 180 - east) * n / 360).cast("int"), F.floor((lon + 180 + east) * n / 360).cast("int")
        columns = F.when(high - low + 1 >= n, F.sequence(F.lit(0), n - 1)).otherwise(F.array_distinct(F.transform(F.sequence(low, high), lambda c: F.pmod(c, n))))
        return F.transform(columns, lambda c: name(r, c))

    # A point has one tile, and nearly all circles touch two rows and two columns at most: these are named without a function for each element, which runs uncompiled.
    if reach == 0:
        return F.array(name(row(lat), F.pmod(F.floor((lon + 180) * across(row(lat)) / 360).cast("int"), across(row(lat)))))
    every = F.flatten(F.transform(F.sequence(row(lat - reach), row(lat + reach)), of))
    few, names = row(lat + reach) - row(lat - reach) <= 1, []
    for r in (row(lat - reach), row(lat + reach)):
        n = across(r)
        ends = [F.floor((lon + 180 + side) * n / 360).cast("int") for side in (-east, east)]
        few = few & (ends[1] - ends[0] <= 1) & (n > 2)
        names += [name(r, F.pmod(c, n)) for c in ends]
    return F.when(few, F.array_distinct(F.array(*names))).otherwise(every)
