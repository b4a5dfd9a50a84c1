"""Trends, emerging risks, hotspots and snapshots."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.config import GapConfig, IntelConfig
from wardloom.functions.columns import band, clamp, haversine_m, percent_change, safe_div, title, valid_point
from wardloom.functions.grid import EARTH_M, within
from wardloom.functions.ordered import running, stored
from wardloom.operators.mesh import ACTIVE_STATUSES, elapsed

CONFIG = IntelConfig()
# Halvings of a cube after which, and pairs of places up to which, two boxes are compared place by place; pairs of places up to which all that is left is.
MOST_HALVINGS, FEW_PAIRS, DIRECT_PAIRS = 20, 1024, 1_000_000
# Shares of the rank from which a tier begins.
TIER_CUTS = {"CRITICAL": 0.90, "HIGH": 0.75, "MODERATE": 0.50}


# ---- trends ----------------------------------------------------------------
def direction(pct: Column, slope: Column, threshold: float = CONFIG.change_pct) -> Column:
    """A change counts only where level and slope agree."""
    return F.when((pct >= threshold) & (slope > 0), "WORSENING").when((pct <= -threshold) & (slope < 0), "IMPROVING").otherwise("STABLE")


def trends(windows: DataFrame, config: IntelConfig = CONFIG) -> DataFrame:
    """A trend of each ward, sector and window length, over its windows in order of time.

    One shuffle on the key serves the numbering and the grouping. One window alone is UNKNOWN.
    """
    key = ["ward_code", "sector", "window_days"]
    order = Window.partitionBy(*key).orderBy("bucket")
    rows = windows.select(*key, "bucket", "complaint_count", (F.row_number().over(order) - 1).alias("i"), (F.col("complaint_count") - F.lag("complaint_count").over(order)).alias("step"))
    out = rows.groupBy(*key).agg(
        F.min_by("complaint_count", "i").alias("first_count"),
        F.max_by("complaint_count", "i").alias("last_count"),
        F.count("*").alias("sample_count"),
        F.round(F.coalesce(F.regr_slope("complaint_count", "i"), F.lit(0.0)), 6).alias("slope"),
        F.coalesce(F.max_by("step", "i"), F.lit(0)).cast("double").alias("momentum"),
        F.round(F.coalesce(F.stddev_pop("complaint_count"), F.lit(0.0)), 4).alias("volatility"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "complaint_count"))), lambda x: x["complaint_count"].cast("string")), ",").alias("series"),
    )
    single = F.col("sample_count") < 2
    out = out.withColumn("pct_change", F.when(single, F.lit(0.0)).otherwise(percent_change("first_count", "last_count")))
    return out.withColumn("direction", F.when(single, "UNKNOWN").otherwise(direction(F.col("pct_change"), F.col("slope"), config.change_pct)))


# ---- risks -----------------------------------------------------------------
def last_two(windows: DataFrame) -> DataFrame:
    """The latest and the window before it, of each ward, sector and window length (T6: lengths aren't mixed)."""
    order = Window.partitionBy("ward_code", "sector", "window_days").orderBy(F.desc("bucket"))
    rows = windows.withColumn("n", F.row_number().over(order)).where("n <= 2")
    return rows.groupBy("ward_code", "sector", "window_days").agg(F.max(F.when(F.col("n") == 1, F.col("complaint_count"))).alias("recent"), F.max(F.when(F.col("n") == 2, F.col("complaint_count"))).alias("previous")).where("previous is not null")


def risk_code(kind: str) -> Column:
    return F.concat_ws(":", F.lit(kind), F.coalesce("ward_code", F.lit("CITY")), F.coalesce("sector", F.lit("ALL")))


def _risk(rows: DataFrame, kind: str, severity: Column, confidence: Column, extra: Column | None = None) -> DataFrame:
    code = risk_code(kind) if extra is None else F.concat_ws(":", risk_code(kind), extra)
    return rows.select(F.lit(kind).alias("risk_type"), code.alias("risk_code"), "ward_code", "sector", severity.alias("severity"), F.round(confidence, 4).alias("confidence"))


def spikes(pairs: DataFrame, config: IntelConfig = CONFIG) -> DataFrame:
    ratio = F.col("recent") / F.col("previous")
    rows = pairs.where((F.col("recent") >= config.spike_min) & (F.col("previous") > 0)).where(ratio >= config.spike_ratio)
    severity = F.when(ratio >= 3 * config.spike_ratio, "CRITICAL").when(ratio >= 2 * config.spike_ratio, "HIGH").otherwise("MEDIUM")
    return _risk(rows, "SPIKE", severity, clamp(0.6 + 0.1 * F.least(ratio / config.spike_ratio - 1, F.lit(1.0)), 0.0, 0.95))


def new_categories(pairs: DataFrame, config: IntelConfig = CONFIG) -> DataFrame:
    return _risk(pairs.where((F.col("previous") <= 0) & (F.col("recent") >= config.new_min)), "NEW_CATEGORY", F.lit("MEDIUM"), F.lit(0.5))


def active_money(projects: DataFrame) -> DataFrame:
    return projects.where(F.col("status").isin(*ACTIVE_STATUSES)).groupBy("ward_code", "sector").agg(F.count("*").alias("active"), F.sum("budget_lakhs").alias("committed"), F.sum("spent_lakhs").alias("spent"))


def deteriorating(pairs: DataFrame, projects: DataFrame, config: IntelConfig = CONFIG) -> DataFrame:
    change, absorbed = percent_change("previous", "recent"), safe_div("spent", "committed")
    rows = pairs.join(active_money(projects), ["ward_code", "sector"]).where((change >= config.change_pct) & (F.col("recent") > F.col("previous")))
    return _risk(rows, "DETERIORATING_WITH_SPEND", F.when(absorbed < config.stall_spend, "CRITICAL").when(change >= 3 * config.change_pct, "HIGH").otherwise("MEDIUM"), F.lit(0.75))


def stalled_absorption(projects: DataFrame, as_of: dt.date, config: IntelConfig = CONFIG) -> DataFrame:
    late = elapsed(as_of, missing=0.0) >= config.stall_elapsed
    rows = projects.where(F.col("status").isin(*ACTIVE_STATUSES) & late & (F.col("budget_lakhs") > 0) & (safe_div("spent_lakhs", "budget_lakhs") < config.stall_spend))
    return _risk(rows, "STALLED_ABSORPTION", F.when(F.col("budget_lakhs") - F.col("spent_lakhs") > 500, "HIGH").otherwise("MEDIUM"), F.lit(0.8), F.col("project_code"))


def critical_concentration(pairs: DataFrame, gaps: DataFrame) -> DataFrame:
    worst = gaps.where("severity = 'CRITICAL'").select("ward_code", "sector")
    return _risk(pairs.join(worst, ["ward_code", "sector"]).where("recent > previous"), "CRITICAL_CONCENTRATION", F.lit("CRITICAL"), F.lit(0.7))


def risks(windows: DataFrame, projects: DataFrame, gaps: DataFrame, as_of: dt.date, config: IntelConfig = CONFIG) -> DataFrame:
    """All five rules' findings."""
    pairs = last_two(windows)
    out = spikes(pairs, config)
    for part in (new_categories(pairs, config), deteriorating(pairs, projects, config), stalled_absorption(projects, as_of, config), critical_concentration(pairs, gaps)):
        out = out.unionByName(part)
    return out


def confirmatory(found: DataFrame) -> DataFrame:
    """Findings of wards and sectors that more than one rule points at."""
    many = found.groupBy("ward_code", "sector").agg(F.count_distinct("risk_type").alias("kinds")).where("kinds > 1").select("ward_code", "sector")
    return found.join(many, ["ward_code", "sector"], "left_semi")


# ---- places ----------------------------------------------------------------
def near_pairs(points: DataFrame, radius_m: float = CONFIG.radius_m) -> DataFrame:
    """(a, b, metres) of points(ward_code, latitude, longitude) within the radius, a before b; poles and 180 degrees are no border."""
    left = points.select(F.col("ward_code").alias("a"), F.col("latitude").alias("lat_a"), F.col("longitude").alias("lon_a"))
    right = points.select(F.col("ward_code").alias("b"), F.col("latitude").alias("lat_b"), F.col("longitude").alias("lon_b"))
    return within(left, right, ("lat_a", "lon_a"), ("lat_b", "lon_b"), radius_m).where("a < b").select("a", "b", "metres")


def clusters(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ward_code, cluster): the least ward_code reachable over pairs(a, b), itself included.

    Labels spread to neighbours and jump along labels until none changes; each round is stored.
    """
    both = stored(pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b"))
    labels = stored(points.select("ward_code", F.col("ward_code").alias("cluster")))
    while True:
        seen = both.join(labels, F.col("b") == F.col("ward_code")).groupBy("a").agg(F.min("cluster").alias("least"))
        new = labels.join(seen, F.col("ward_code") == F.col("a"), "left").select("ward_code", F.least("cluster", "least").alias("cluster"), F.col("cluster").alias("old"))
        jump = new.select(F.col("ward_code").alias("w"), F.col("cluster").alias("c"))
        new = stored(new.join(jump, F.col("cluster") == F.col("w"), "left").select("ward_code", F.least("cluster", "c").alias("cluster"), "old"))
        if new.where("cluster <> old").isEmpty():
            return new.select("ward_code", "cluster")
        labels = new.drop("old")


def _box_number(axes: tuple[str, ...], depth: int) -> Column:
    """The number of a place's box within its cube, halved depth times."""
    out = F.lit(0).cast("long")
    for bit in range(1, depth + 1):
        for k in axes:
            out = out * 2 + F.pmod(F.floor(F.col(k) * 2.0**bit), F.lit(2))
    return out


def near_clusters(points: DataFrame, radius_m: float = CONFIG.radius_m) -> DataFrame:
    """(ward_code, cluster) of points(ward_code, latitude, longitude): what ``clusters`` makes of their ``near_pairs``, without these pairs, whose number grows with the square of a dense place.

    Points of one cube of space whose diagonal is within the radius are linked. Of cubes that lie near each other only those are looked into which nothing else has linked: boxes of their
    places are halved until one pair is found to be near, or none can be; few places are compared with each other. A point that is not valid is a cluster of its own.
    A ward_code has one row; where points of several places have it, it links them.
    """
    chord = 2 * EARTH_M * math.sin(min(radius_m / EARTH_M / 2, math.pi / 2))
    side = max(chord / math.sqrt(3) * 0.999, 1e-6)
    axes, far = ("x", "y", "z"), F.cos(F.radians("latitude"))
    space = {"x": far * F.cos(F.radians("longitude")), "y": far * F.sin(F.radians("longitude")), "z": F.sin(F.radians("latitude"))}
    there = points.where(valid_point("latitude", "longitude")).select("ward_code", "latitude", "longitude")
    cube = [F.floor(v * EARTH_M / side).alias(f"c{k}") for k, v in space.items()]
    places = there.groupBy("latitude", "longitude").agg(F.min("ward_code").alias("ward_code")).withColumns({k: v * EARTH_M / side for k, v in space.items()})
    key = [f"c{k}" for k in axes]
    bounds = [f(k).alias(f"{n}_{k}") for k in axes for n, f in (("low", F.min), ("high", F.max))] + [F.min(F.struct("latitude", "longitude")).alias("one"), F.count("*").alias("n")]
    cubes = stored(places.withColumns({f"c{k}": F.floor(k) for k in axes}).groupBy(*key).agg(F.min("ward_code").alias("cube"), *bounds))

    def judged(pairs: DataFrame) -> DataFrame:
        """pairs(a, b) of boxes that may hold near places, and if they do for sure."""
        gap, span = F.lit(0.0), F.lit(0.0)
        for k in axes:
            low_a, high_a, low_b, high_b = (F.col(f"{s}.{n}_{k}") for s in ("a", "b") for n in ("low", "high"))
            gap = gap + F.pow(F.greatest(F.lit(0.0), low_b - high_a, low_a - high_b), F.lit(2))
            span = span + F.pow(F.greatest(high_b - low_a, high_a - low_b), F.lit(2))
        most = (chord / side) ** 2
        one = haversine_m(F.col("a.one.latitude"), F.col("a.one.longitude"), F.col("b.one.latitude"), F.col("b.one.longitude")) <= radius_m
        return pairs.where(gap <= most * (1 + 1e-6)).withColumn("sure", one | (span <= most * (1 - 1e-6)))

    around = [(x, y, z) for x in range(-2, 3) for y in range(-2, 3) for z in range(-2, 3) if (x, y, z) > (0, 0, 0)]
    row = F.struct("cube", *[f"{n}_{k}" for k in axes for n in ("low", "high")], "one", "n")
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{k}") for k, v in zip(axes, o)]) for o in around]))
    left = cubes.select(row.alias("a"), *key, steps.alias("o")).select("a", *[(F.col(f"c{k}") + F.col(f"o.d{k}")).alias(f"c{k}") for k in axes])
    met = stored(judged(left.join(cubes.select(row.alias("b"), *key), key).drop(*key)))
    seated = places.withColumns({f"c{k}": F.floor(k) for k in axes}).join(cubes.select("cube", *key), key).select("cube", "latitude", "longitude", *axes)
    shared = there.select("ward_code", *cube).join(cubes.select("cube", *key), key).groupBy("ward_code").agg(F.collect_set("cube").alias("cubes")).where(F.size("cubes") > 1)
    shared = shared.select(F.explode("cubes").alias("a"), F.array_min("cubes").alias("b")).where("a <> b").distinct()
    nodes, found = cubes.select(F.col("cube").alias("ward_code")).distinct(), met.where("sure").select(F.col("a.cube").alias("a"), F.col("b.cube").alias("b")).unionByName(shared)
    product = F.col("a.n") * F.col("b.n")
    count = lambda pairs: pairs.agg(F.sum(product).alias("n")).first()["n"] or 0

    def near(pairs: DataFrame, at: DataFrame, level: int) -> DataFrame:
        """The rows of pairs whose boxes hold two places that are near."""
        at = at.withColumn("p", _box_number(axes, level))
        side_of = lambda n: at.select(F.col("cube").alias(f"cube_{n}"), F.col("p").alias(f"p{n}"), F.col("latitude").alias(f"lat_{n}"), F.col("longitude").alias(f"lon_{n}"))
        return pairs.join(side_of("a"), ["cube_a", "pa"]).join(side_of("b"), ["cube_b", "pb"]).where(haversine_m("lat_a", "lon_a", "lat_b", "lon_b") <= radius_m)

    start = met.where("not sure").select("a", "b", F.col("a.cube").alias("cube_a"), F.col("b.cube").alias("cube_b"), F.lit(0).cast("long").alias("pa"), F.lit(0).cast("long").alias("pb"))
    if count(start) <= DIRECT_PAIRS:
        joined = clusters(nodes, found.unionByName(near(start.drop("a", "b"), seated, 0).select(F.col("cube_a").alias("a"), F.col("cube_b").alias("b")).distinct()))
    else:
        joined = clusters(nodes, found)
        own = lambda n: joined.select(F.col("ward_code").alias(f"cube_{n}"), F.col("cluster").alias(f"in_{n}"))
        # only pairs whose cubes nothing has linked so far
        open_, level, links = stored(start.join(own("a"), "cube_a").join(own("b"), "cube_b").where("in_a <> in_b")), 0, None
        at = stored(seated.join(open_.select(F.explode(F.array("cube_a", "cube_b")).alias("cube")).distinct(), "cube"))
        while (n := count(open_)) > 0:
            last = level >= MOST_HALVINGS or n <= DIRECT_PAIRS
            few = F.lit(last) | (product <= FEW_PAIRS)
            new = near(open_.where(few).drop("a", "b"), at, level).select("in_a", "in_b")
            level += 1
            if not last:
                halves = at.withColumn("p", _box_number(axes, level)).groupBy("cube", "p").agg(*bounds)
                half = lambda n: halves.select(F.col("cube").alias(f"cube_{n}"), F.shiftright("p", 3).alias(f"p{n}"), F.col("p").alias(f"q{n}"), row.alias(n))  # noqa: B023, E731
                split = stored(judged(open_.where(~few).drop("a", "b").join(half("a"), ["cube_a", "pa"]).join(half("b"), ["cube_b", "pb"])))
                new = new.unionByName(split.where("sure").select("in_a", "in_b"))
            new = stored(new.distinct())
            links = new if links is None else links.unionByName(new)
            if last:
                break
            rest = split.where("not sure").join(new, ["in_a", "in_b"], "left_anti")
            open_ = stored(rest.select("a", "b", "cube_a", "cube_b", "in_a", "in_b", F.col("qa").alias("pa"), F.col("qb").alias("pb")))
        if links is not None:
            again = clusters(joined.select(F.col("cluster").alias("ward_code")).distinct(), links.select(F.col("in_a").alias("a"), F.col("in_b").alias("b"))).toDF("cluster", "whole")
            joined = joined.join(again, "cluster").select("ward_code", F.col("whole").alias("cluster"))
    named = cubes.select(*key, F.col("cube")).join(joined.select(F.col("ward_code").alias("cube"), "cluster"), "cube").select(*key, "cluster")
    own = there.select("ward_code", *cube).join(named, key).select("ward_code", "cluster")
    alone = points.where(~valid_point("latitude", "longitude")).select("ward_code", F.col("ward_code").alias("cluster"))
    return stored(own.unionByName(alone).groupBy("ward_code").agg(F.min("cluster").alias("cluster")))


def ward_signals(wards: DataFrame, demand: DataFrame) -> DataFrame:
    """Complaints, critical ones, worst severity and sectors of each ward; a ward without demand has zeros."""
    own = demand.groupBy("ward_code").agg(F.sum("complaint_count").alias("complaints"), F.sum("critical_count").alias("critical"), F.max("avg_severity").alias("peak_severity"), F.collect_set("sector").alias("sectors"))
    rows = wards.join(own, "ward_code", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("complaints", "critical")} | {"peak_severity": F.coalesce("peak_severity", F.lit(0.0))})
    return rows.withColumn("intensity", F.round(F.col("complaints") / (F.greatest("population", F.lit(1)) / 1000), 4))


def cluster_sums(members: DataFrame) -> DataFrame:
    """Sums of each cluster over its wards, rows of ``ward_signals`` with a cluster. No column grows with the cluster."""
    return members.groupBy("cluster").agg(
        F.min_by("district", "ward_code").alias("district"),
        F.avg("latitude").alias("latitude"),
        F.avg("longitude").alias("longitude"),
        F.sum("population").alias("population"),
        F.sum("complaints").alias("complaints"),
        F.sum("critical").alias("critical"),
        F.max("intensity").alias("peak_intensity"),
        F.round(F.max("peak_severity"), 4).alias("peak_severity"),
        F.count("*").alias("wards"),
    )


def tiers(sums: DataFrame, signals: DataFrame) -> DataFrame:
    """Clusters with complaints, their rate, z-score against all wards and tier by rank."""
    spread = signals.agg(F.avg("intensity").alias("mean"), F.stddev_pop("intensity").alias("dev"))
    rate = F.col("complaints") / (F.greatest("population", F.lit(1)) / 1000)
    out = stored(sums.where("complaints >= 1").crossJoin(F.broadcast(spread)).withColumns({"mean_intensity": F.round(rate, 4), "z": F.when(F.col("dev") > 0, F.round((rate - F.col("mean")) / F.col("dev"), 4)).otherwise(F.lit(0.0))}).drop("mean", "dev"))
    # the share of hotspots up to a rate, ties included: rates are counted, then summed in order
    upto = running(out.groupBy("mean_intensity").agg(F.count("*").alias("n")), ["mean_intensity"], upto=F.col("n")).drop("n")
    total = out.agg(F.count("*").alias("total"))
    out = out.join(upto, "mean_intensity").crossJoin(F.broadcast(total))
    return out.withColumn("rank_fraction", F.round(F.col("upto") / F.col("total"), 4)).drop("upto", "total").withColumn("tier", band("rank_fraction", TIER_CUTS, "NORMAL"))


def with_lists(spots: DataFrame, members: DataFrame) -> DataFrame:
    """Hotspots with their ward codes and sectors as comma-joined names, for what shows one hotspot in a row."""
    lists = members.groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_list("ward_code")), ",").alias("ward_codes"))
    sectors = members.select("cluster", F.explode("sectors").alias("s")).distinct().groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_list("s")), ",").alias("sectors"))
    lists = lists.join(sectors, "cluster", "left").withColumn("sectors", F.coalesce("sectors", F.lit("")))
    return spots.join(lists, "cluster")


def hotspots(wards: DataFrame, demand: DataFrame, radius_m: float = CONFIG.radius_m, grouped: DataFrame | None = None, lists: bool = True) -> DataFrame:
    """Clusters of wards with complaints, their rate, z-score against all wards and tier by rank. grouped: the wards' clusters, where they are known; lists: with ``with_lists``."""
    signals = ward_signals(wards, demand)
    members = signals.join(near_clusters(wards, radius_m) if grouped is None else grouped, "ward_code")
    spots = tiers(cluster_sums(members), signals)
    return with_lists(spots, members) if lists else spots


def assign_to_ward(points: DataFrame, wards: DataFrame, config: GapConfig = GapConfig(), half: float = 0.025) -> DataFrame:
    """points(point_id, lat, lon) with ward_code and how it was found: in a ward's box (least code first), else the nearest centroid.

    Both ways meet wards through grid cells, and only places meet: points and wards at one place count once. The nearest centroid is sought by ``within``,
    first close by, and further away for the places that have none there.
    """
    cell, at = 0.05, ["lat", "lon"]
    centres = wards.groupBy("latitude", "longitude").agg(F.min("ward_code").alias("ward_code"))
    spots = stored(points.where("lat is not null and lon is not null").select(*at).distinct())
    boxed = centres.select("ward_code", "latitude", "longitude", F.explode(F.sequence(F.floor((F.col("latitude") - half) / cell), F.floor((F.col("latitude") + half) / cell))).alias("y"))
    boxed = boxed.withColumn("x", F.explode(F.sequence(F.floor((F.col("longitude") - half) / cell), F.floor((F.col("longitude") + half) / cell))))
    here = spots.withColumns({"y": F.floor(F.col("lat") / cell), "x": F.floor(F.col("lon") / cell)})
    boxed_in = (F.abs(F.col("lat") - F.col("latitude")) <= half) & (F.abs(F.col("lon") - F.col("longitude")) <= half)
    found = stored(here.join(boxed, ["y", "x"]).where(boxed_in).groupBy(*at).agg(F.min("ward_code").alias("ward_code")).withColumn("method", F.lit("BOX")))
    for part in (8, 1):
        near = within(spots.join(found, at, "left_anti"), centres, ("lat", "lon"), ("latitude", "longitude"), config.max_assignment_m / part, config.earth_radius_m)
        best = near.groupBy(*at).agg(F.min(F.struct("metres", "ward_code")).alias("m"))
        found = found.unionByName(stored(best.select(*at, F.col("m.ward_code").alias("ward_code"), F.lit("NEAREST").alias("method"))))
    return points.join(found, at, "left").select("point_id", "ward_code", F.coalesce("method", F.lit("NONE")).alias("method"))


# ---- snapshots -------------------------------------------------------------
def latest(rows: DataFrame, key: list[str], at: str, ties: bool) -> DataFrame:
    """The newest rows of each key; all of them with ties, else one (least by all columns)."""
    order = Window.partitionBy(*key).orderBy(F.desc(at), *([] if ties else [c for c in rows.columns if c not in (*key, at)]))
    rank = F.rank() if ties else F.row_number()
    return rows.withColumn("__rank", rank.over(order)).where("__rank = 1").drop("__rank")


def insert_if_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key).distinct(), key, "left_anti"))


def insert_if_changed(history: DataFrame, new: DataFrame, key: list[str], compared: list[str], at: str) -> DataFrame:
    """The rows of new whose compared columns differ from the key's newest row, or that have none."""
    now = latest(history, key, at, ties=False).select(*key, *[F.col(c).alias(f"__{c}") for c in compared], F.lit(True).alias("__known"))
    same = F.col("__known")
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return new.dropDuplicates(key).join(now, key, "left").where(~F.coalesce(same, F.lit(False))).select(*new.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """new over old by key; the columns of ``keep`` stay as they were where the key was known."""
    o = old.select(*key, *[F.col(c).alias(f"__{c}") for c in old.columns if c not in key], F.lit(True).alias("__old"))
    n = new.withColumn("__new", F.lit(True))
    joined = n.join(o, key, "full_outer")
    cols = [F.when(F.col("__new").isNull() | (F.lit(c in keep) & F.col("__old").isNotNull()), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in old.columns if c not in key]
    return joined.select(*key, *cols)


def risk_title(kind: str) -> Column:
    return F.concat(title("sector"), F.lit(f" {kind} in "), F.col("ward_code"))


def hotspots_in_order(found: DataFrame) -> DataFrame:
    """Hotspots, the highest rate first, then the most critical complaints, then by district."""
    return found.orderBy(F.desc("mean_intensity"), F.desc("critical"), "district", "cluster")


def open_risks(found: DataFrame, ward: str | None = None) -> DataFrame:
    """Risks that are still open, of one ward or of all."""
    rows = found.where("status = 'OPEN'")
    return rows if ward is None else rows.where(F.col("ward_code") == ward)


def trends_of_hotspots(spots: DataFrame, trends: DataFrame) -> DataFrame:
    """(cluster, ward_code, sector, ...): the trends of a hotspot's wards in its own sectors; both are comma-joined names."""
    own = spots.select("cluster", F.explode(F.split("ward_codes", ",")).alias("ward_code"), F.split("sectors", ",").alias("__sectors"))
    return own.join(trends, "ward_code").where(F.array_contains("__sectors", F.col("sector"))).drop("__sectors")


def missing_tables(wanted: tuple[str, ...], there: tuple[str, ...]) -> tuple[str, ...]:
    """Tables that are wanted and not there, in order."""
    return tuple(t for t in wanted if t not in set(there))
