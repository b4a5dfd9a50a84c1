"""Queries over issue groups: in one pass, as a stream, processed again, and matches with groups that stand."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.functions.ordered import checkpoint_dir
from wardloom.operators import issues
from wardloom.plans.registry import query
from wardloom.sources.store import Store
from wardloom.sources.testdata import Tables
from wardloom.streaming.issues import ASSIGNED, IssueStream

#: Reports at 97 places, a few metres to either side of an edge of tiles or of 180 degrees; their texts hold each other or are missing.
_REPORTS = """select printf('R%08d', event_id) as report_id, event_id, event_type as category, concat('S', cast(event_id % 3 as varchar(1))) as sub_category, ts + interval '45' day * cast(event_id % 7 as int) as seen, cast(event_id % 97 as int) as place,
  round(-80 + event_id % 97 * 1.6, 1) + case when event_id % 2 = 0 then 0.00001 else -0.00001 end as lat,
  case when event_id % 97 = 0 then case when event_id % 2 = 0 then 179.99999 else -179.99999 end else -180 + event_id % 97 * 3.7 end as lon,
  case when event_id % 4 = 0 then null when event_id % 4 = 1 then 'water' else concat('no water in ', event_type) end as text, cast(1 + event_id % 5 as double) as severity from events"""


def _made(t: Tables, sql: str) -> DataFrame:
    return t.spark.sql(sql.replace("from events", "from {events}"), events=t.base("events"))


def _reports(t: Tables) -> DataFrame:
    rows = _made(t, _REPORTS).withColumnRenamed("seen", "at")
    return rows.withColumns({"lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double")})


_SESSIONS = f"""
r as ({_REPORTS}), g as (select *, coalesce(seen - lag(seen) over w > interval 720 hours, true) as opens from r window w as (partition by category, sub_category, place order by seen, report_id)),
n as (select *, count(*) filter (where opens) over (partition by category, sub_category, place order by seen, report_id) as n from g),
s as (select *, first_value(report_id) over (partition by category, sub_category, place, n order by seen, report_id) as group_id from n)"""
_TOTALS = "select group_id, count(*) as report_count, round(avg(severity), 3) as severity_avg, max(severity) as severity_max, min(seen) as first_at, max(seen) as last_at from s group by group_id"


@query("i6_groups_over_edges", f"with {_SESSIONS} select report_id, group_id from s")
def _(t: Tables) -> DataFrame:
    return issues.group_issues(_reports(t)).select("report_id", "group_id")


@query("d36_totals_of_groups", f"with {_SESSIONS} {_TOTALS}")
def _(t: Tables) -> DataFrame:
    rows = _reports(t)
    return issues.issue_totals(issues.group_issues(rows), rows)


@query("i7_stream_of_reports", f"with {_SESSIONS} select report_id, group_id from s")
def _(t: Tables) -> DataFrame:
    """Batches that overlap in time by a third of it, one of them delivered twice; what each may hold back is as long as they are late."""
    rows = _reports(t).drop("event_id", "place").withColumn("at", F.col("at").cast("timestamp"))
    spark = t.spark
    bounds = rows.agg(F.min(F.unix_micros("at")).alias("low"), F.max(F.unix_micros("at")).alias("high")).first()
    third = ((bounds["high"] or 0) - (bounds["low"] or 0)) / 3
    late = F.unix_micros("at") + F.lit(third) * (F.pmod(F.xxhash64("report_id"), F.lit(100)) / 100)
    arrival = F.least(F.lit(2), F.greatest(F.lit(0), F.floor((late - (bounds["low"] or 0)) / F.lit(third * 4 / 3 / 3 + 1))))
    arrived = rows.withColumn("arrival", arrival)
    flow = IssueStream(Store(spark, f"{checkpoint_dir(spark)}/issues-{uuid.uuid4().hex}"), third / 3.6e9 + 1)
    for n in (0, 1, 1, 2):
        flow.merge(arrived.where(F.col("arrival") == n).drop("arrival"), n)
    flow.finish()
    return flow.store.snapshot().table(ASSIGNED).select("report_id", "group_id")


@query("i8_processed_again", f"with {_SESSIONS} {_TOTALS}")
def _(t: Tables) -> DataFrame:
    """All reports processed a second time: each stays where it is, and no count grows."""
    rows = _reports(t)
    found = issues.group_issues(rows).checkpoint()
    again, _ = issues.regroup(found, issues.states(found), rows)
    return issues.issue_totals(again, rows)


@query("c26_records_of_groups", f"with {_SESSIONS}, c as (select group_id, count(*) as n from s group by 1) select s.group_id, s.report_id, s.event_id from s join c on c.group_id = s.group_id where c.n >= 3")
def _(t: Tables) -> DataFrame:
    rows = _reports(t)
    found = issues.group_issues(rows).select("report_id", "group_id")
    large = found.groupBy("group_id").agg(F.count("*").alias("n")).where("n >= 3").select("group_id")
    return found.join(large, "group_id").join(rows.select("report_id", "event_id"), "report_id").select("group_id", "report_id", "event_id")


#: Of each place, district and state one group stands; every fourth report has no point, and of these some have a district, a state or nothing.
_STANDING = f"""
r as ({_REPORTS}), h as (select report_id, category, sub_category, seen, place, case when event_id % 4 <> 3 then lat end as lat, case when event_id % 4 <> 3 then lon end as lon, text,
  case when event_id % 12 in (3, 4) then concat('D', cast(event_id % 5 as varchar(1))) end as district, case when event_id % 12 in (3, 7) then concat('S', cast(event_id % 2 as varchar(1))) end as state from r),
g as (select category, sub_category, concat('P', cast(place as varchar(3))) as name, min(lat) as lat, min(lon) as lon, cast(null as varchar(1)) as district, cast(null as varchar(1)) as state, 'water' as text, max(seen) as last from h where lat is not null group by category, sub_category, place
  union all select category, sub_category, concat('D', district), null, null, district, null, null, max(seen) from h where district is not null group by category, sub_category, district
  union all select category, sub_category, concat('S', state), null, null, null, state, null, max(seen) from h where state is not null group by category, sub_category, state
  union all select category, sub_category, 'N', null, null, null, null, 'water', max(seen) from h group by category, sub_category)"""


@query(
    "h24_best_of_standing",
    f"""with {_STANDING}, m as (select h.report_id, g.name, case when h.lat is not null then 1 - 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(g.lat - h.lat) / 2), 2) + cos(radians(h.lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - h.lon) / 2), 2)))) / 1000 when h.district is not null then 0.6 when h.state is not null then 0.4 else 0.3 end as near,
  case when h.text is null or g.text is null then 0.5 else 1.0 end as alike, 1 - abs(epoch_us(h.seen) - epoch_us(g.last)) / 3.6e9 / 720 as hours
  from h join g on g.category = h.category and g.sub_category = h.sub_category and epoch_us(g.last) >= epoch_us(h.seen) - 720 * 3600000000
    and case when h.lat is not null then g.name = concat('P', cast(h.place as varchar(3))) when h.district is not null then g.district = h.district when h.state is not null then g.state = h.state else g.name = 'N' end
  where h.text is null or g.text is null or contains(h.text, g.text) or contains(g.text, h.text))
select report_id, name as group_id, round(0.4 * near + 0.4 * alike + 0.2 * greatest(hours, 0), 6) as score from m where 0.4 * near + 0.4 * alike + 0.2 * greatest(hours, 0) >= 0.55""",
)
def _(t: Tables) -> DataFrame:
    reports, groups = _made(t, f"with {_STANDING} select * from h").withColumnRenamed("seen", "at"), _made(t, f"with {_STANDING} select * from g")
    standing = groups.withColumn("group_id", F.concat_ws("/", "category", "sub_category", "name"))
    found = issues.match_issues(reports, standing)
    return found.select("report_id", F.element_at(F.split("group_id", "/"), -1).alias("group_id"), F.round("score", 6).alias("score"))
