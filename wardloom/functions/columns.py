"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def col(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x: Col, low: float = 0.0, high: float = 1.0) -> Column:
    """x within low and high; not-a-number and null become low."""
    x = col(x)
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(low)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def safe_div(n: Col, d: Col) -> Column:
    """n / d, 0 where d is 0 or null."""
    return F.coalesce(F.try_divide(col(n).cast("double"), col(d).cast("double")), F.lit(0.0))


def percent_change(first: Col, last: Col) -> Column:
    """From 0 to more is 100, from 0 to 0 is 0; else rounded to two places."""
    a, b = col(first).cast("double"), col(last).cast("double")
    return F.when(a == 0, F.when(b > 0, F.lit(100.0)).otherwise(F.lit(0.0))).otherwise(F.round((b - a) / F.abs(a) * 100, 2))


def normalise_0_100(x: Col) -> Column:
    return F.round(clamp(col(x), 0.0, 100.0), 2)


def haversine_m(lat1: Col, lon1: Col, lat2: Col, lon2: Col, radius: float = 6_371_008.8) -> Column:
    """Metres between two points; null where one is not valid."""
    a, b, c, d = map(col, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(c - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), 2)
    return F.when(valid_point(a, b) & valid_point(c, d), 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def valid_point(lat: Col, lon: Col) -> Column:
    return F.coalesce(col(lat).between(-90, 90) & col(lon).between(-180, 180), F.lit(False))


def inside(x: Col, low: Col, high: Col) -> Column:
    """x within bounds, a null bound being open."""
    return F.coalesce(col(x) >= col(low), F.lit(True)) & F.coalesce(col(x) <= col(high), F.lit(True))


def lookup(key: Col, values: dict, default=None) -> Column:
    """values[key], as one literal map."""
    table = F.create_map(*[F.lit(v) for kv in values.items() for v in kv])
    found = F.try_element_at(table, col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def band(x: Col, cuts: dict[str, float], otherwise: str) -> Column:
    """The first name whose limit x reaches; cuts are in falling order."""
    out = None
    for name, limit in cuts.items():
        out = F.when(col(x) >= limit, name) if out is None else out.when(col(x) >= limit, name)
    return out.otherwise(otherwise)


def title(x: Col) -> Column:
    """An upper-case name with underscores, as words."""
    return F.initcap(F.replace(col(x), F.lit("_"), F.lit(" ")))


def percent(x: Col) -> Column:
    return F.concat(F.format_string("%.0f", F.round(col(x) * 100, 0)), F.lit("%"))


def printed(x: Col, places: int) -> Column:
    """A number of 0 or more with no or one place, rounded as C's printf does: by its exact value, ties to the even digit. ``format_string`` rounds the shortest decimal form half-up."""
    x = col(x).cast("double")
    if places == 0:
        return F.format_string("%.0f", F.rint(x))
    if places != 1:
        raise ValueError("no or one place")
    # exact: a fraction from 2**-7 on has no bit below 2**-59, and a smaller one is far from a tie
    one = 1 << 59
    part = (x - F.floor(x)) * float(one)
    tenths = part.cast("long") * 10
    digit, rest, half = F.shiftright(tenths, 59), tenths % one, F.lit(one >> 1)
    up = (rest > half) | (rest == half) & (digit % 2 == 1)
    digit = digit + up.cast("long")
    return F.concat((F.floor(x).cast("long") + F.floor(digit / 10)).cast("string"), F.lit("."), (digit % 10).cast("string"))


def plural(n: Col) -> Column:
    return F.when(col(n) == 1, "").otherwise("s")


def share(n: Col, d: Col) -> Column:
    """n / d within 0 and 1; 0 where d is 0 or null."""
    return clamp(safe_div(n, d))


def mean_or_zero(x: Col) -> Column:
    """The mean of a group, 0 for one without values."""
    return F.coalesce(F.avg(col(x)), F.lit(0.0))


def round_or_none(x: Col, places: int) -> Column:
    return F.when(~F.isnan(col(x).cast("double")), F.round(col(x), places))


def utc(x: Col, zone: Col | None = None) -> Column:
    """A time as UTC: one without a zone is UTC already, another is shifted by its zone."""
    return col(x).cast("timestamp") if zone is None else F.when(col(zone).isNull(), col(x).cast("timestamp")).otherwise(F.to_utc_timestamp(col(x), F.coalesce(col(zone), F.lit("UTC"))))


def date_prefix(x: Col) -> Column:
    """The date that a text begins with; null where it begins with none."""
    return F.substring(col(x), 1, 10).try_cast("date")
