"""Issue groups: each report joins the best group that stands when it comes, or opens one."""

from __future__ import annotations

import difflib
import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.config import DedupConfig
from wardloom.functions.columns import valid_point
from wardloom.functions.grid import EARTH_M, tiles
from wardloom.functions.ordered import checkpoint_dir, stored

#: Degrees of a tile of places; how far a group is told of, and how far around a tile guests are taken from, in radii. The box of a radius reaches 1.42, and a report that joins a group lies one radius from it.
TILE, TOLD, HALO = 0.1, 1.5, 2.5
#: Reports of one tile, district or state up to which one task matches them with standing groups; pairs of texts and of places and texts that a task remembers; groups that are looked through at once.
CROWD, PAIRS_KEPT, PLACES_KEPT, CHUNK = 100_000, 65_536, 4_096, 4_096
ROWS = "shard string, at long, last long, report_id string, own boolean, group_id string, lat double, lon double, district string, state string, text string"
OWN = "category string, sub_category string, of string"
FOUND = f"home string, at long, report_id string, group_id string, score double, lat double, lon double, district string, state string, text string, {OWN}"
DECIDED = ("report_id", "group_id", "score", "category", "sub_category", "at", "lat", "lon", "district", "state", "text")
STATE = ("group_id", "category", "sub_category", "lat", "lon", "district", "state", "text", "last")


def metres(lat: float, lon: float, lat2: float, lon2: float) -> float:
    a, b = math.radians(lat), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(1.0, h)))


def text_similarity(a: str, b: str, needed: float = 0.0) -> float:
    """1 if one text holds the other, else the mean of the shared share of words and of matching blocks; 0 where it can't reach ``needed``, which is told from the lengths and letters first."""
    if a in b or b in a:
        return 1.0
    x, y = set(a.split()), set(b.split())
    words = len(x & y) / len(x | y) if x or y else 0.0
    m = difflib.SequenceMatcher(None, a, b)
    if (m.real_quick_ratio() + words) / 2 < needed or (m.quick_ratio() + words) / 2 < needed:
        return 0.0
    return (m.ratio() + words) / 2


class Similarities(dict):
    """``text_similarity`` of pairs of texts, for a bounded number of pairs: what a pair was asked for, and its similarity or 0."""

    def __call__(self, a: str, b: str, needed: float) -> float:
        known = self.get((a, b))
        if known is not None and (known[1] or needed >= known[0]):
            return known[1]
        if len(self) >= PAIRS_KEPT:
            self.clear()
        like = text_similarity(a, b, needed)
        self[a, b] = (needed, like)
        return like


class Group:
    __slots__ = ("district", "id", "last", "lat", "lon", "state", "text")

    def __init__(self, id: str, last: int, lat: float | None, lon: float | None, district: str | None, state: str | None, text: str | None):
        self.id, self.last, self.lat, self.lon, self.district, self.state, self.text = id, last, lat, lon, district, state, text


def best_of(groups: Iterator[Group], at: int, lat: float | None, lon: float | None, district: str | None, state: str | None, text: str | None, c: DedupConfig, similarity: Callable[[str, str, float], float] = text_similarity) -> tuple[Group | None, float | None]:
    """The best of the groups that a report may join: the newest ``candidates`` in its box, district or state, scored by place, text and time; of equal ones the newer, then the first by id."""
    since, dy = at - c.horizon_hours * 3.6e9, math.degrees(c.radius_m / EARTH_M)
    if lat is not None:
        dx = dy / max(math.cos(math.radians(lat)), 1e-6)
        near = [g for g in groups if g.last >= since and g.lat is not None and -dy <= g.lat - lat <= dy and (-dx <= g.lon - lon <= dx or 360 - abs(g.lon - lon) <= dx)]
    elif district:
        near = [g for g in groups if g.last >= since and g.district == district]
    elif state:
        near = [g for g in groups if g.last >= since and g.state == state]
    else:
        near = [g for g in groups if g.last >= since and not (g.lat is not None or g.district or g.state)]
    if len(near) > c.candidates:
        near = heapq.nsmallest(c.candidates, near, key=lambda g: (-g.last, g.id))
    likely = []
    for g in near:
        far = metres(lat, lon, g.lat, g.lon) if lat is not None else 0.0
        if far <= c.radius_m:
            place = 1 - far / c.radius_m if lat is not None else 0.6 if district else 0.4 if state else 0.3
            late = max(0.0, 1 - abs(at - g.last) / 3.6e9 / c.horizon_hours)
            likely.append((c.geo * place + c.time * late, g))
    likely.sort(key=lambda x: -x[0])
    best, top = None, c.least
    for said, g in likely:
        if said + c.text < top:
            break  # not even equal texts would do, here and further on
        like = 0.5
        if text and g.text:
            needed = max(c.least_text, (top - said) / c.text - 1e-9)
            like = similarity(text, g.text, needed)
            if like < c.least_text:
                continue
        score = said + c.text * like
        if score > top or score == top and (best is None or (-g.last, g.id) < (-best.last, best.id)):
            best, top = g, score
    return best, top if best else None


def _scan(batches: Iterator[pa.RecordBatch], c: DedupConfig) -> Iterator[pa.RecordBatch]:
    """Decisions on the own reports of each shard, whose rows come in order of time; the decisions of other shards are taken as they are. Holds the open groups of one shard.

    An own row brings the id of the group that it would open.
    """
    shard, groups, similarity, schema = None, {}, Similarities(), pa.schema([(name, {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[kind]) for name, kind in map(str.split, FOUND.split(", "))])
    for batch in batches:
        out = []
        for here, at, last, report_id, own, group_id, lat, lon, district, state, text, *named in zip(*(column.to_pylist() for column in batch.columns)):
            if here != shard:
                shard, groups = here, {}
            if not own:
                g = groups.get(group_id)
                if g is None:
                    groups[group_id] = Group(group_id, last, lat, lon, district, state, text)
                else:
                    g.last, g.district, g.state = max(g.last, last), g.district or district, g.state or state
                continue
            if len(groups) > 64:
                since = at - c.horizon_hours * 3.6e9
                if sum(g.last < since for g in groups.values()) > len(groups) // 2:
                    groups = {k: g for k, g in groups.items() if g.last >= since}
            g, score = best_of(groups.values(), at, lat, lon, district, state, text, c, similarity)
            g = g or groups.get(group_id)
            if g is None:
                g = groups[group_id] = Group(group_id, at, lat, lon, district, state, text)
            else:
                g.last, g.district, g.state = max(g.last, at), g.district or district, g.state or state
            out.append((shard, at, report_id, g.id, score, g.lat, g.lon, g.district, g.state, g.text, *named))
        columns = list(zip(*out)) or [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


class Standing:
    """The groups of one shard, which no report changes, in order of the newest, then by id.

    The newest ``candidates`` around a place are the same for every report there; those within its horizon are the first of them. They and their similarity to a text are remembered for a bounded number of places and texts.
    """

    def __init__(self, rows: list[tuple], config: DedupConfig, similarity: Similarities):
        rows = sorted(rows, key=lambda r: (-r[1], r[0]))
        self.ids, self.texts = [r[0] for r in rows], [r[4] for r in rows]
        self.last = np.array([r[1] for r in rows], np.int64)
        self.lat, self.lon = (np.array([np.nan if r[i] is None else r[i] for r in rows], float) for i in (2, 3))
        self.config, self.similarity, self.around, self.alike = config, similarity, {}, {}

    def _boxed(self, lat: float, lon: float) -> list[int]:
        c, found = self.config, []
        dy = math.degrees(c.radius_m / EARTH_M)
        dx = dy / max(math.cos(math.radians(lat)), 1e-6)
        for start in range(0, len(self.ids), CHUNK):
            north, east = self.lat[start : start + CHUNK] - lat, np.abs(self.lon[start : start + CHUNK] - lon)
            found += (np.flatnonzero((-dy <= north) & (north <= dy) & ((east <= dx) | (360 - east <= dx))) + start).tolist()
            if len(found) >= c.candidates:
                return found[: c.candidates]
        return found

    def candidates(self, lat: float | None, lon: float | None, place: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, last, the part of the score that the place gives)."""
        known = self.around.get((lat, lon, place))
        if known is None:
            c = self.config
            if lat is None:
                at = list(range(min(c.candidates, len(self.ids))))
                near = [c.geo * place] * len(at)
            else:
                far = [(i, metres(lat, lon, float(self.lat[i]), float(self.lon[i]))) for i in self._boxed(lat, lon)]
                at = [i for i, f in far if f <= c.radius_m]
                near = [c.geo * (1 - f / c.radius_m) for _, f in far if f <= c.radius_m]
            if len(self.around) >= PLACES_KEPT:
                self.around.clear()
            known = self.around[lat, lon, place] = (np.array(at, np.int64), self.last[at], np.array(near, float))
        return known

    def best(self, at: int, lat: float | None, lon: float | None, district: str | None, state: str | None, text: str | None) -> tuple[str | None, float | None]:
        """As ``best_of``: id and score of the best group."""
        c = self.config
        place = 1.0 if lat is not None else 0.6 if district else 0.4 if state else 0.3
        where, last, near = self.candidates(lat, lon, place)
        n = int(np.count_nonzero(last >= at - c.horizon_hours * 3.6e9))
        if not n:
            return None, None
        said = near[:n] + c.time * np.maximum(0.0, 1 - np.abs(at - last[:n]) / 3.6e9 / c.horizon_hours)
        like = self._likes(where, lat, lon, place, text)
        if like is None:
            return self._by_text(where, said, text)
        score = np.where(like[:n] < 0, -1.0, said + c.text * like[:n])
        i = int(np.argmax(score))  # of equal ones the first: the newest, then the first by id
        return (self.ids[where[i]], float(score[i])) if score[i] >= c.least else (None, None)

    def _likes(self, where: np.ndarray, lat: float | None, lon: float | None, place: float, text: str | None) -> np.ndarray | None:
        """The similarity of each candidate's text; None where these are too many to compare them all."""
        known = self.alike.get((lat, lon, place, text), False)
        if known is False:
            texts = [self.texts[i] for i in where]
            known = None
            if not text or len(set(texts)) <= 32:
                of = {t: self.similarity(text, t, 0.0) if text and t else None for t in set(texts)}
                # refused ones are below zero; where a text is missing none is refused
                known = np.array([0.5 if of[t] is None else of[t] if of[t] >= self.config.least_text else -1.0 for t in texts], float)
            if len(self.alike) >= PLACES_KEPT:
                self.alike.clear()
            self.alike[lat, lon, place, text] = known
        return known

    def _by_text(self, where: np.ndarray, said: np.ndarray, text: str) -> tuple[str | None, float | None]:
        c, best, top = self.config, None, self.config.least
        for i in np.argsort(-said, kind="stable").tolist():
            if said[i] + c.text < top:
                break  # not even equal texts would do, here and further on
            like, t = 0.5, self.texts[where[i]]
            if t:
                like = self.similarity(text, t, max(c.least_text, (top - said[i]) / c.text - 1e-9))
                if like < c.least_text:
                    continue
            score = float(said[i] + c.text * like)
            if score > top or score == top and (best is None or i < best):
                best, top = i, score
        return (None, None) if best is None else (self.ids[where[best]], top)


def _match(frames: Iterator[pd.DataFrame], c: DedupConfig) -> Iterator[pd.DataFrame]:
    """The best group of each report; the groups of a shard come before its reports."""
    shard, rows, standing, similarity = None, [], None, Similarities()
    none = lambda x: None if x is None or x != x else x
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            if r.shard != shard:
                shard, rows, standing = r.shard, [], None
            lat, lon, district, state, text = map(none, (r.lat, r.lon, r.district, r.state, r.text))
            if not r.own:
                rows.append((r.group_id, r.last, lat, lon, text))
                continue
            if standing is None:
                standing, rows = Standing(rows, c, similarity), []
            out.append((r.report_id, *standing.best(r.at, lat, lon, district, state, text)))
        yield pd.DataFrame(out, columns=["report_id", "group_id", "score"])


def _shards(rows: DataFrame, places: Column) -> DataFrame:
    """rows with their shard, one for each of an array of places."""
    # the array has a step of its own: within explode its expression would run uncompiled
    return rows.withColumn("__places", places).withColumn("__place", F.explode("__places")).withColumn("shard", F.concat_ws("\x1f", "category", "sub_category", "__place")).drop("__places", "__place")


def _seen_from(rows: DataFrame, c: DedupConfig) -> DataFrame:
    """Groups or decisions, one row for each shard whose reports may join the group."""
    none = F.array().cast("array<string>")
    one = lambda kind, x: F.when(x.isNotNull(), F.array(F.concat_ws("\x1f", F.lit(kind), x))).otherwise(none)
    point = F.when(F.col("lat").isNotNull(), tiles(F.col("lat"), F.col("lon"), TILE, TOLD * c.radius_m, "P\x1f")).otherwise(none)
    nowhere = F.when(F.col("lat").isNull() & F.col("district").isNull() & F.col("state").isNull(), F.lit("-"))
    return _shards(rows, F.concat(point, one("D", F.col("district")), one("S", F.col("state")), one("N", nowhere)))


def _dealt(reports: DataFrame) -> DataFrame:
    """Reports with the shard that is their home; those that can't be grouped aren't ``ready``."""
    checkpoint_dir(reports.sparkSession)
    given = {c.lower() for c in reports.columns}
    value = lambda n, kind: (F.col(n) if n in given else F.lit(None)).cast(kind).alias(n)
    filled = lambda n: F.when(value(n, "string") != "", value(n, "string")).alias(n)
    rows = reports.select(value("report_id", "string"), value("category", "string"), value("sub_category", "string"), value("at", "timestamp"), value("lat", "double"), value("lon", "double"), filled("district"), filled("state"), filled("text"))
    rows = rows.groupBy("report_id").agg(F.min_by(F.struct(*rows.columns[1:]), F.struct(*[F.col(n).isNull() for n in ("at", "category", "sub_category")], "at", *[n for n in rows.columns[1:] if n != "at"])).alias("r")).select("report_id", "r.*")
    ready = F.col("report_id").isNotNull() & F.col("at").isNotNull() & F.col("category").isNotNull() & F.col("sub_category").isNotNull()
    here = valid_point("lat", "lon")
    kind = F.when(here, "P").when(F.col("district").isNotNull(), "D").when(F.col("state").isNotNull(), "S").otherwise("N")
    place = F.when(here, tiles(F.col("lat"), F.col("lon"), TILE)[0]).otherwise(F.coalesce("district", "state", F.lit("-")))
    rows = rows.withColumns({"ready": ready, "home": F.concat_ws("\x1f", "category", "sub_category", kind, place)})
    return rows.withColumns({"at": F.unix_micros("at"), "lat": F.when(here | ~ready, F.col("lat")), "lon": F.when(here | ~ready, F.col("lon"))})


def _standing(groups: DataFrame, own: DataFrame, c: DedupConfig) -> DataFrame:
    """Rows of groups for each shard with own reports that may join them; they come before all reports."""
    seen = _seen_from(groups.select(*STATE), c).select("shard", F.lit(-(2**62)).alias("at"), F.unix_micros(F.col("last").cast("timestamp")).alias("last"), F.col("group_id").alias("report_id"), F.lit(False).alias("own"), "group_id", "lat", "lon", "district", "state", "text")
    return seen.join(own.select(F.col("home").alias("shard")).distinct(), "shard", "left_semi")


def _dealt_in_order(rows: DataFrame) -> DataFrame:
    # By a hash of the shard: a deal by the shard itself is left out above a union of joins on it, whose partitions need not match.
    return rows.repartition(F.xxhash64("shard")).sortWithinPartitions("shard", "at", "last", "report_id", "own")


def _newest(groups: DataFrame, c: DedupConfig) -> DataFrame:
    """Groups without those that are never among the newest ``candidates``: so many newer ones stand at the same place, or in the same district or state for reports without one."""
    def of(rows: DataFrame, *way: str) -> DataFrame:
        """The newest of each way to meet a group, without what the other ways go by."""
        order = Window.partitionBy("category", "sub_category", *way).orderBy(F.desc("last"), "group_id")
        bare = rows.withColumns({x: F.lit(None).cast(t) for x, t in (("lat", "double"), ("lon", "double"), ("district", "string"), ("state", "string")) if x not in way})
        return bare.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= c.candidates).drop("__n")

    out = of(groups.where("lat is not null"), "lat", "lon").unionByName(of(groups.where("lat is null and district is null and state is null")))
    return out.unionByName(of(groups.where("district is not null"), "district")).unionByName(of(groups.where("state is not null"), "state"))


def _decided(rows: DataFrame, c: DedupConfig) -> DataFrame:
    return _dealt_in_order(rows).mapInArrow(lambda batches: _scan(batches, c), FOUND)


def match_issues(reports: DataFrame, groups: DataFrame, config: DedupConfig = DedupConfig()) -> DataFrame:
    """(report_id, group_id, score): the best of groups, as from ``states``, for each report that has one; the rules are those of ``group_issues``, but reports don't change the groups.

    Of groups at one place only the newest ``candidates`` are told to the tiles around, since no report meets others. The reports of a crowded tile are dealt to several tasks, each with its groups.
    """
    own = _dealt(reports).where("ready")
    names = [x.split()[0] for x in ROWS.split(", ")]
    parts = own.groupBy(F.col("home").alias("shard")).agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts"))
    part_of = F.concat_ws("\x1f", "shard", "part")
    mine = own.withColumnRenamed("home", "shard").join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("report_id"), F.col("parts")))
    mine = mine.select(part_of.alias("shard"), "at", F.col("at").alias("last"), "report_id", F.lit(True).alias("own"), F.lit(None).cast("string").alias("group_id"), "lat", "lon", "district", "state", "text")
    known = groups.select(*STATE).where("group_id is not null and last is not null")
    seen = _standing(_newest(known, config), own, config).join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("shard", part_of)
    found = _dealt_in_order(mine.select(*names).unionByName(seen.select(*names))).mapInPandas(lambda frames: _match(frames, config), "report_id string, group_id string, score double")
    return found.where("group_id is not null")


def group_issues(reports: DataFrame, config: DedupConfig = DedupConfig(), earlier: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """(report_id, group_id, score, category, sub_category, at, lat, lon, district, state, text): the group of each report, whose place and text follow.

    Reads report_id, category, sub_category, at and, where they are there, lat, lon, district, state and text. In order of time, then report, each report joins the best group of its category and
    sub-category that was joined within ``horizon_hours`` and lies within ``radius_m`` of it; a report without a valid point those of its district, or else of its state, or else those that have no
    place either. A group keeps the place and text of its first report, and takes a district or state from the first that brings one. ``earlier`` has groups that stand already, as from ``states``.
    ``history`` has the decisions that these came from, as this function gives them: with it each report meets the groups as they stood when it came, not as they stand now.

    Reports are dealt by tiles of place, districts and states, so that no category is one task. Tiles first decide with the reports around them; then decisions that are news to a tile, a district or
    a state are told to it, and it decides again with these, until none changes: each round settles what depends on one edge more, and only who is told something new runs. The result is that of
    one pass in order of time.
    Defined cases: rows with a null report, time, category or sub-category have no group; of rows of one report the first counts; equal times go by report; null and empty texts count as missing; an
    empty table gives no rows.
    """
    dealt = stored(_dealt(reports))
    own, left = dealt.where("ready").drop("ready"), dealt.where("not ready")
    if earlier is not None:
        # A report that opened a group and left it opens its next one under a new number.
        base, number = F.regexp_replace("group_id", r"~\d+$", ""), F.regexp_extract("group_id", r"~(\d+)$", 1).try_cast("int")
        taken = earlier.where("group_id is not null").groupBy(base.alias("report_id")).agg((F.max(F.coalesce(number, F.lit(1))) + 1).alias("n"))
        own = own.join(taken, "report_id", "left").withColumn("fresh", F.when(F.col("n").isNull(), F.col("report_id")).otherwise(F.concat_ws("~", "report_id", "n"))).drop("n")
    else:
        own = own.withColumn("fresh", F.col("report_id"))
    if history is not None:
        # A report that opened its group and is as it was opens the same again, should it match none, itself included.
        same = ["category", "sub_category", "lat", "lon", "text"]
        opened = history.where(F.regexp_replace("group_id", r"~\d+$", "") == F.col("report_id")).select("report_id", F.col("group_id").alias("had"), *[F.col(c).alias(f"__{c}") for c in same])
        own = own.join(opened, "report_id", "left").withColumn("fresh", F.when(F.expr(" and ".join(f"{c} <=> __{c}" for c in same)), F.coalesce("had", "fresh")).otherwise(F.col("fresh"))).drop("had", *[f"__{c}" for c in same])
    if earlier is not None or history is not None:
        own = stored(own)
    names = [x.split()[0] for x in ROWS.split(", ")]
    mine = own.select(F.col("home").alias("shard"), "at", F.col("at").alias("last"), "report_id", F.lit(True).alias("own"), F.col("fresh").alias("group_id"), "lat", "lon", "district", "state", "text", "category", "sub_category", F.col("home").alias("of"))
    homes = stored(own.select(F.col("home").alias("shard")).distinct())
    foreign = lambda rows: rows.select("shard", "at", F.col("at").alias("last"), "report_id", F.lit(False).alias("own"), "group_id", "lat", "lon", "district", "state", "text")
    if history is not None:
        stand = foreign(_seen_from(history.where("group_id is not null").withColumn("at", F.unix_micros("at")), config)).join(homes, "shard", "left_semi").checkpoint()
    else:
        stand = None if earlier is None else _standing(earlier, own, config).checkpoint()

    of_others = lambda rows: rows.select(*names, *[F.lit(None).cast("string").alias(x.split()[0]) for x in OWN.split(", ")])
    facts = ["at", "group_id", "lat", "lon", "district", "state", "text"]

    def told(rows: DataFrame) -> DataFrame:
        """rows, one for each other shard that they are told to. Shards are found once for each state of a group, of which there are far fewer than reports."""
        key = ["category", "sub_category", "lat", "lon", "district", "state"]
        seen = stored(_seen_from(rows.select(*key).distinct(), config).join(homes, "shard", "left_semi").select("shard", *[F.col(c).alias(f"__{c}") for c in key]))
        return rows.join(seen, F.expr(" and ".join(f"{c} <=> __{c}" for c in key)) & (F.col("shard") != F.col("home"))).drop(*[f"__{c}" for c in key])

    def differing(a: DataFrame, b: DataFrame) -> DataFrame:
        """Rows of a whose report is told of otherwise in b."""
        other = b.select("report_id", *[F.col(c).alias(f"__{c}") for c in facts])
        return a.join(other, "report_id").where(~F.expr(" and ".join(f"{c} <=> __{c}" for c in facts))).select(*a.columns)

    # At first each tile also decides on the guests around it, so that what happens at an edge is seen whole from both sides. Guests of a tile that is nobody's home tell nothing.
    point = F.col("lat").isNotNull()
    around = _shards(mine.where(point), tiles(F.col("lat"), F.col("lon"), TILE, HALO * config.radius_m, "P\x1f")).join(homes, "shard", "left_semi").select(*mine.columns)
    spread = around.unionByName(mine.where(~point))
    first = stored(_decided(spread if stand is None else spread.unionByName(of_others(stand)), config))
    now, guests = first.where("home = of").drop("of"), first.where("home <> of").drop("of")
    news = told(now).join(guests.select(F.col("home").alias("shard"), "report_id"), ["shard", "report_id"], "left_anti").select("shard").unionByName(differing(guests, now).select(F.col("home").alias("shard")))
    while True:
        active = stored(news.distinct())
        if active.isEmpty():
            break
        inputs = mine if stand is None else mine.unionByName(of_others(stand))
        inputs = inputs.unionByName(of_others(foreign(told(now)))).join(active, "shard", "left_semi")
        at_home = active.withColumnRenamed("shard", "home")
        new = stored(_decided(inputs, config).drop("of").unionByName(now.join(at_home, "home", "left_anti")))
        again = lambda rows: rows.join(at_home, "home", "left_semi")  # noqa: B023, E731
        news = told(differing(again(new), again(now)).unionByName(differing(again(now), again(new)))).select("shard")
        now = new
    named = ["report_id", "group_id", "score", "category", "sub_category", F.timestamp_micros("at").alias("at"), "lat", "lon", "district", "state", "text"]
    return now.select(*named).unionByName(left.withColumns({"group_id": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}).select(*named))


def states(grouped: DataFrame) -> DataFrame:
    """Groups as they stand after their decisions: place and text of the first report, the first district and state, and when one was last joined."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("at", "report_id"))).alias(c)
    lead = lambda c: F.min_by(c, F.struct("at", "report_id")).alias(c)
    return grouped.where("group_id is not null").groupBy("group_id").agg(*[lead(c) for c in ("category", "sub_category", "lat", "lon")], first("district"), first("state"), lead("text"), F.max("at").alias("last"))


def issue_totals(assigned: DataFrame, reports: DataFrame) -> DataFrame:
    """(group_id, report_count, severity_avg, severity_max, first_at, last_at) of assigned(report_id, group_id) and reports(report_id, severity, at). Counts follow from who belongs where, so that no replay adds to them; groups that all have left are gone."""
    own = assigned.where("group_id is not null").select("report_id", "group_id").join(reports.select("report_id", "severity", "at").groupBy("report_id").agg(F.min_by(F.struct("severity", "at"), F.struct("at", "severity")).alias("r")), "report_id").select("group_id", "r.*")
    return own.groupBy("group_id").agg(F.count("*").alias("report_count"), F.round(F.avg("severity"), 3).alias("severity_avg"), F.max("severity").alias("severity_max"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def regroup(assigned: DataFrame, groups: DataFrame, changed: DataFrame, config: DedupConfig = DedupConfig()) -> tuple[DataFrame, DataFrame]:
    """assigned(report_id, group_id) and groups, as from ``states``, after the reports of changed were processed again.

    Each of them is matched with the groups that stand, its own among them: it stays where its own is still the best, and else leaves it and joins or opens another. What other reports belong to never changes.
    Where assigned has all columns that ``group_issues`` gives, and so has the result, groups stand for a report as they did when it came: a report that is as it was stays, whatever was opened or joined since.
    """
    full = set(DECIDED) <= set(assigned.columns)
    again = group_issues(changed, config, groups, assigned.select(*DECIDED) if full else None).checkpoint()
    kept = assigned.join(again.select("report_id"), "report_id", "left_anti")
    names = DECIDED if full else ("report_id", "group_id")
    now = kept.select(*names).unionByName(again.select(*names))
    every = updated_states(groups, again)
    return now, every.join(now.select("group_id").distinct(), "group_id", "left_semi")


def updated_states(groups: DataFrame, grouped: DataFrame) -> DataFrame:
    """Groups after further decisions: known ones keep their place and text, and take districts and states they lacked."""
    both = groups.select(*STATE, F.lit(0).alias("__n")).unionByName(states(grouped).select(*STATE, F.lit(1).alias("__n")))
    old = lambda c: F.min_by(c, "__n").alias(c)
    filled = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__n"))).alias(c)
    return both.groupBy("group_id").agg(*[old(c) for c in ("category", "sub_category", "lat", "lon")], filled("district"), filled("state"), old("text"), F.max("last").alias("last")).select(*STATE)
