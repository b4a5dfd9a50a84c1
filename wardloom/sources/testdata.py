"""The civic tables, made from the star-schema test tables.

Each is one SQL text that both engines read: table names in braces are DataFrames here and views there.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _pick(key: str, values: tuple[str, ...]) -> str:
    quoted = ["null" if v is None else v if v.startswith("concat(") or v.startswith("repeat(") else "'" + v + "'" for v in values]
    return "case " + " ".join(f"when {key} = {i} then {v}" for i, v in enumerate(quoted)) + " end"


_SECTORS = ("WATER", "ELECTRICITY", "ROAD", "SANITATION", "HEALTHCARE", "EDUCATION", "TRANSPORT", "DIGITAL_CONNECTIVITY")
_TYPES = ("WATER_SUPPLY", "BOREWELL", "ELECTRICITY_POLE", "TRANSFORMER", "STREET_LIGHT", "ROAD", "DRAIN", "SEWAGE_LINE", "WASTE_BIN", "HEALTH_CLINIC", "SCHOOL", "BUS_STOP", "PUBLIC_TOILET", "WIFI_HOTSPOT")
_WARD = "concat('W', lpad(cast({} as string), 5, '0'))"

ADAPTERS = {
    "wards": f"""
select {_WARD.format("s_suppkey")} as ward_code, concat('Ward ', cast(s_suppkey as string)) as name, n_name as district, r_name as state,
  10 + cast((s_suppkey * 7919) % 10007 as double) / cast(10007 as double) as latitude, 78 + cast((s_suppkey * 104729) % 10007 as double) / cast(10007 as double) as longitude,
  cast(6000 + (s_suppkey * 7907) % 26000 as bigint) as population
from {{supplier}} join {{nation}} on s_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey""",
    "demand_windows": f"""
select ward_code, sector, cast(30 as int) as window_days, bucket, count(*) as complaint_count, cast(sum(case when sev >= 4 then 1 else 0 end) as bigint) as critical_count, avg(cast(sev as double)) as avg_severity, max(sev) as max_severity
from (select {_WARD.format("l_suppkey")} as ward_code, {_pick("l_partkey % 8", _SECTORS)} as sector, cast(floor((year(l_shipdate) * 12 + month(l_shipdate) - 23941) / 3) as int) as bucket, cast(1 + (l_linenumber - 1) % 5 as int) as sev from {{lineitem}}) x
group by ward_code, sector, bucket""",
    "citizen_demand": f"""
select ward_code, sector, category, cast(90 as int) as window_days, count(*) as complaint_count, avg(cast(sev as double)) as avg_severity, max(sev) as max_severity, cast(sum(case when sev >= 4 then 1 else 0 end) as bigint) as critical_count
from (select {_WARD.format("l_suppkey")} as ward_code, {_pick("l_partkey % 8", _SECTORS)} as sector, concat('C', cast(l_partkey % 3 as string)) as category, cast(1 + (l_linenumber - 1) % 5 as int) as sev from {{lineitem}} where year(l_shipdate) >= 1999) x
group by ward_code, sector, category""",
    "assets": f"""
select concat('A', cast(p_partkey as string)) as asset_code, concat('W', lpad(cast(p_partkey % (select count(*) from {{supplier}}) as string), 5, '0')) as ward_code, {_pick("p_size % 14", _TYPES)} as asset_type,
  {_pick("p_partkey % 5", ("FUNCTIONAL", "PARTIAL", "BROKEN", "UNDER_REPAIR", "NOT_STARTED"))} as status, {_pick("p_size % 4", ("GOOD", "FAIR", "POOR", "CRITICAL"))} as grade,
  cast(1 + p_size % 3 as int) as capacity_units, cast(1980 + p_size % 20 as int) as installed_year
from {{part}}""",
    "projects": f"""
select concat('P', cast(o_orderkey as string)) as project_code, concat('W', lpad(cast(o_orderkey % (select count(*) from {{supplier}}) as string), 5, '0')) as ward_code, {_pick("o_custkey % 8", _SECTORS)} as sector, concat('Project ', cast(o_orderkey as string)) as title,
  {_pick("cast(substr(o_orderpriority, 1, 1) as int) - 1", ("PLANNED", "IN_PROGRESS", "COMPLETED", "DELAYED", "CANCELLED"))} as status,
  o_totalprice / cast(1000 as double) as budget_lakhs, o_totalprice / cast(1000 as double) * cast(case o_orderstatus when 'F' then 1.0 when 'P' then 0.5 else 0.1 end as double) as spent_lakhs,
  cast(o_orderdate as date) as sanctioned_on, cast(180 + o_orderkey % 720 as int) as planned_days, cast(o_orderkey % 200 as int) as delay_days
from {{orders}}""",
    "envelopes": """
select event_id, concat('REQ-2024-', lpad(cast(case when event_id % 7 = 3 then event_id - 3 else event_id end as string), 6, '0')) as request_id, ts, user_id, event_type, value, props from {events}""",
}


#: Raw complaints: written as citizens and other systems write them, in every form that cleaning knows.
COMPLAINT_TEXTS = (
    "The road near Gandhi Nagar hospital is broken since three weeks", "No water for 12 days in ward 14, pincode 560001", "bijli nahi hai mere gaon mein", "मेरी सड़क बहुत खराब है और पानी नहीं है", "माझ्या गावात पाणी नाही आणि रस्ता खराब आहे", "சாலை பழுது pincode 560001",
    "Call 9876543210 or +91 9123456789 about the street light at 12.9716, 77.5946", "Garbage on 12/05/2024, drain blocked for months", " N/A ", "", None, "Kein Strom in der Strasse", "Dr. O’Neil’s “clinic” –  no medicine…",
)
COMPLAINT_FIELDS = {
    "request_id": (6, ("concat('REQ-', cast(event_id as string))", " a_b-7 ", "bad id!", None, "---", "repeat('x', 65)")),
    "language": (9, ("en", "EN-in", "Tamil", "mr", "xx-unknown-long", "hindi", "", None, "zh_Hans")),
    "category": (10, ("water", "Roads", "POWER", "school", "noise", None, "", "Public Safety", "jal", "unknown")),
    "sub_category": (7, ("no water", "pothole", "disruption", None, "garbage pile", "xyz", "street light")),
    "description": (13, COMPLAINT_TEXTS),
    "severity": (8, ("3", "4,5", "abc", "9", "", None, "0", "5")),
    "latitude": (5, ("12.9716", "91", "abc", None, "")),
    "longitude": (5, ("77.5946", "10", "77", "77.1", "")),
    "location": (11, ('{{"latitude": 13.08, "longitude": 80.27, "address": "MG Road"}}', *[None] * 10)),
    "place": (4, ("Near Gandhi Nagar", "unknown", None, "  Market   street ")),
    "created_at": (7, ("2024-01-05T10:00:00Z", "2024-01-06 11:00:00", "1704499200", "1704499200000", "31/12/2023", "not a date", "2099-01-01")),
}
ADAPTERS["complaints"] = "select event_id, " + ", ".join(f"{_pick(f'event_id % {n}', values)} as {name}" for name, (n, values) in COMPLAINT_FIELDS.items()) + ", cast(case event_id % 8 when 0 then 12.9716 when 1 then 13.3 when 2 then 28.6 when 3 then 60 when 4 then -40 when 5 then 91 when 7 then 13.2 end as double) as lat, cast(case event_id % 8 when 0 then 77.5946 when 1 then 80.3 when 2 then 77.2 when 3 then 10 when 4 then 10 when 5 then 10 when 7 then 77.59 end as double) as lon from {events}"


def with_tables(sql: str) -> str:
    """sql behind the adapters that it names, as common table expressions over the registered views."""
    plain = {t: t for t in BASE}
    return "with " + ", ".join(f"{n} as ({t.format(**plain)})" for n, t in ADAPTERS.items()) + "\n" + sql


class Tables:
    """DataFrames of the civic tables and of those that they are made from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _made(self, name: str) -> DataFrame:
        text = ADAPTERS[name]
        return self.spark.sql(text, **{t: self.base(t) for t in BASE if "{" + t + "}" in text})

    wards = cached_property(lambda self: self._made("wards"))
    demand_windows = cached_property(lambda self: self._made("demand_windows"))
    citizen_demand = cached_property(lambda self: self._made("citizen_demand"))
    assets = cached_property(lambda self: self._made("assets"))
    projects = cached_property(lambda self: self._made("projects"))
    complaints = cached_property(lambda self: self._made("complaints"))
    envelopes = cached_property(lambda self: self._made("envelopes"))
