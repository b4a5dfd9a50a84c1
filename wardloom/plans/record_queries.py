"""Queries of records, texts, events and duplicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.functions import text as tx
from wardloom.functions.columns import title, valid_point
from wardloom.operators import issues, records
from wardloom.plans.registry import query
from wardloom.sources import io
from wardloom.sources.testdata import Tables
from wardloom.vocab import SECTORS

REC = """rec as (select event_id, request_id, ts as created_at, user_id, event_type, props, case when event_id % 11 = 0 then null else case event_id % 6 when 0 then 'ROAD' when 1 then 'WATER' when 2 then 'HEALTHCARE' when 3 then 'NOISE' when 4 then 'HOUSING' else 'SANITATION' end end as category,
  case when event_id % 5 = 0 then 'UNCLASSIFIED' else 'DRAINAGE' end as sub_category, case when event_id % 13 = 0 then null else cast(event_id % 7 as int) end as severity, case when event_id % 17 = 0 then null else cast(event_id % 200 - 100 as double) end as latitude, case when event_id % 19 = 0 then null else cast(event_id % 400 - 200 as double) end as longitude,
  case when event_id % 23 = 0 then '  ' else event_type end as description from envelopes)"""
_REC_BODY = REC[len("rec as (") : -1]
FOUND = """fd as (select *, list_filter([case when category is null then 'MISSING_CATEGORY:e' end, case when category is not null and category = 'NOISE' then 'INVALID_CATEGORY:e' end, case when sub_category = 'UNCLASSIFIED' then 'MISSING_SUB_CATEGORY:w' end, case when latitude is null and longitude is null then 'MISSING_LOCATION:e' end,
  case when (latitude is null) <> (longitude is null) then 'INCOMPLETE_COORDINATES:e' end, case when latitude is not null and longitude is not null and not (latitude between -90 and 90 and longitude between -180 and 180) then 'INVALID_COORDINATES:e' end, case when created_at > timestamp '2024-01-20' + interval 1 day then 'FUTURE_TIMESTAMP:w' end,
  case when severity is null then 'MISSING_SEVERITY:w' end, case when not severity between 1 and 5 then 'INVALID_SEVERITY:e' end, case when trim(description) = '' then 'MISSING_DESCRIPTION:w' end], lambda x: x is not null) as f from rec)"""
STATUS = "case when list_contains(list_transform(f, lambda x: x[-1]), 'e') then 'INVALID' when len(f) > 0 then 'NEEDS_REVIEW' else 'VALID' end"


def records_of(t: Tables) -> DataFrame:
    rows = t.spark.sql(_REC_BODY.replace("from envelopes", "from {envelopes}"), envelopes=t.envelopes)
    have = valid_point("latitude", "longitude")
    known = F.when(F.col("category").isin(*SECTORS), F.col("category")).otherwise("UNKNOWN")
    none = F.lit(None).cast("string")
    return rows.withColumns({"request_id_valid": F.lit(True), "norm_category": known, "norm_sub_category": F.col("sub_category"), "location_present": F.col("latitude").isNotNull() | F.col("longitude").isNotNull(), "location_status": F.when(have, "PARTIAL").otherwise("UNRESOLVED"), "district": none, "state": none, "location_text": none})


def _as_of():
    return F.lit(dt.datetime(2024, 1, 20))


@query("h34_validation", f"with {REC}, {FOUND} select event_id, array_to_string(list_transform(f, lambda x: split_part(x, ':', 1)), ',') as findings, {STATUS} as status from fd")
def _(t: Tables) -> DataFrame:
    rows = records_of(t).withColumn("f", records.findings(_as_of()))
    return rows.select("event_id", F.array_join(F.transform("f", lambda x: x["code"]), ",").alias("findings"), records.status_of("f").alias("status"))


@query("h23_record_quality", f"with {REC} select event_id, round(cast(0.22 * (0.75 + case when latitude is null and longitude is null then 0 else 0.25 end) + 0.14 * (case when ok then 0.75 else 0 end) + 0.14 * (case when category is not null and category <> 'NOISE' then case when sub_category <> 'UNCLASSIFIED' then 1 else 0.75 end else 0.1 end) + 0.10 * (case when created_at > timestamp '2024-01-20' then 0.4 else 1 end) + 0.14 * (case when ok then 0.6 else 0 end) + 0.10 * (case when severity is null then 0.4 when severity between 1 and 5 then 1 else 0 end) + 0.16 * (case when trim(description) <> '' then 1 else 0 end) as double), 3) as quality from (select *, coalesce(latitude between -90 and 90 and longitude between -180 and 180, false) as ok from rec) x")
def _(t: Tables) -> DataFrame:
    return records_of(t).select("event_id", records.quality_score(_as_of()).alias("quality"))


@query("a9_event_types", f"with {REC}, {FOUND}, s as (select {STATUS} as status from fd) select case status when 'VALID' then 'CIVIC_RECORD_PROCESSED' when 'NEEDS_REVIEW' then 'CIVIC_RECORD_NEEDS_REVIEW' else 'CIVIC_RECORD_REJECTED' end as event, count(*) as n from s group by 1")
def _(t: Tables) -> DataFrame:
    rows = records_of(t).withColumn("f", records.findings(_as_of())).withColumn("status", records.status_of("f"))
    return rows.groupBy(records.event_type_for("status").alias("event")).agg(F.count("*").alias("n"))


@query("n9_findings_log", f"with {REC}, {FOUND} select code, count(*) as n from (select split_part(unnest(f), ':', 1) as code from fd) x group by 1")
def _(t: Tables) -> DataFrame:
    return records_of(t).select(F.explode(records.findings(_as_of())).alias("f")).groupBy(F.col("f.code").alias("code")).agg(F.count("*").alias("n"))


@query("b18_counted_records", f"with {REC}, {FOUND} select count(*) as counted from (select distinct request_id from fd where {STATUS} <> 'INVALID') x")
def _(t: Tables) -> DataFrame:
    rows = records_of(t).withColumn("f", records.findings(_as_of())).where(records.status_of("f") != "INVALID")
    return rows.select("request_id").distinct().agg(F.count("*").alias("counted"))


@query("i3_first_by_request", "select request_id, event_id from (select *, row_number() over (partition by request_id order by ts, event_id) as n from envelopes) x where n = 1")
def _(t: Tables) -> DataFrame:
    return records.first_by_request(t.envelopes).select("request_id", "event_id")


@query("i4_changed_replays", "select request_id, count(*) as n, count(distinct sha256(props)) as versions from envelopes group by request_id having count(distinct sha256(props)) > 1")
def _(t: Tables) -> DataFrame:
    return t.envelopes.groupBy("request_id").agg(F.count("*").alias("n"), F.count_distinct(F.sha2("props", 256)).alias("versions")).where("versions > 1")


@query("d35_running_demand", "with u as (select *, cast(1 + event_id % 5 as int) as severity, row_number() over (partition by request_id order by ts, event_id) as n from envelopes) select user_id, event_type, count(*) as complaint_count, round(avg(severity), 6) as avg_severity, max(severity) as max_severity, count(*) filter (where severity >= 4) as critical_count, min(ts) as observed_from, max(ts) as observed_to from u where n = 1 group by 1, 2")
def _(t: Tables) -> DataFrame:
    return records.running_demand(t.envelopes.withColumn("severity", (1 + F.col("event_id") % 5).cast("int")))


@query("a7_envelope_keys", "select event_id, request_id as request_key from envelopes where event_id % 10 <> 0")
def _(t: Tables) -> DataFrame:
    lines = t.envelopes.select(F.when(F.col("event_id") % 10 == 0, "not an object").otherwise(io.envelope(F.col("event_type"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("request_id")), F.col("ts").cast("string"), F.create_map(F.lit("request_id"), F.col("request_id")))).alias("value"))
    good, _ = io.parsed(lines)
    return good.select(F.col("event_id").cast("long").alias("event_id"), "request_key")


@query("i10_malformed_events", "select count(*) as malformed from envelopes where event_id % 10 = 0")
def _(t: Tables) -> DataFrame:
    lines = t.envelopes.select(F.when(F.col("event_id") % 10 == 0, '{"correlation_id":"","payload":{}}').otherwise(F.to_json(F.struct("request_id"))).alias("value"))
    return io.parsed(lines)[1].agg(F.count("*").alias("malformed"))


@query("a8_outbox_status", "select case when event_id % 4 = 0 then 'PUBLISHED' when event_id % 4 = 1 then 'FAILED' else 'PENDING' end as status, count(*) as n, cast(sum(case when event_id % 4 < 2 then 2 else 0 end) as bigint) as attempts from envelopes group by 1")
def _(t: Tables) -> DataFrame:
    rows = t.envelopes.select("event_id")
    tries = rows.where("event_id % 4 < 2").select("event_id", F.explode(F.array(F.lit(False), F.col("event_id") % 4 == 0)).alias("ok"))
    return io.outbox(rows, tries).groupBy("status").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@query("b10_pending_events", "select event_id from envelopes where event_id % 4 <> 0")
def _(t: Tables) -> DataFrame:
    rows = t.envelopes.select("event_id")
    tries = rows.where("event_id % 4 < 2").select("event_id", (F.col("event_id") % 4 == 0).alias("ok"))
    return io.outbox(rows, tries).where("status in ('PENDING', 'FAILED')").select("event_id")


@query("a2_request_ids", "select event_id, printf('REQ-2024-%06d', row_number() over (order by event_id)) as request_no from events")
def _(t: Tables) -> DataFrame:
    return io.request_ids(t.base("events").select("event_id"), "event_id", 2024)


@query("n20_surrogate_ids", "select o_orderkey, 'EVT-' || upper(substr(sha256(cast(o_orderkey as varchar)), 1, 12)) as id from orders")
def _(t: Tables) -> DataFrame:
    return t.base("orders").select("o_orderkey", io.surrogate("EVT", F.col("o_orderkey")).alias("id"))


@query("a6_enrich_from_requests", "select e.event_id, r.user_id from envelopes e join (select request_id, min(user_id) as user_id from envelopes group by 1) r on r.request_id = e.request_id where e.event_type = 'error'")
def _(t: Tables) -> DataFrame:
    stored = t.envelopes.groupBy("request_id").agg(F.min("user_id").alias("user_id"))
    return t.envelopes.where("event_type = 'error'").select("event_id", "request_id").join(stored, "request_id").select("event_id", "user_id")


@query("a14_json_columns", """select event_id, cast(json_extract(props, '$.k') as bigint) as k from events""")
def _(t: Tables) -> DataFrame:
    return t.base("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("f8_paging", "select event_id from events order by ts, event_id limit 25 offset 100")
def _(t: Tables) -> DataFrame:
    return t.base("events").orderBy("ts", "event_id").select("event_id").offset(100).limit(25)


@query("i_windowed_demand", "select event_type, time_bucket(interval 1 day, ts) as day, count(*) as n from events group by 1, 2")
def _(t: Tables) -> DataFrame:
    return t.base("events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("day"), "n")


# ---- text ------------------------------------------------------------------
@query("h46_token_counts", r"select doc_id, len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}_]+'), lambda x: x <> '')) as n from documents")
def _(t: Tables) -> DataFrame:
    return t.base("documents").select("doc_id", F.size(tx.tokens("text")).cast("long").alias("n"))


@query("h47_contains_phrase", r"select doc_id from documents where contains(' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}_]+'), lambda x: x <> ''), ' ') || ' ', ' all rights reserved ')")
def _(t: Tables) -> DataFrame:
    return t.base("documents").where(tx.contains_phrase(tx.tokens("text"), F.lit("all rights reserved"))).select("doc_id")


@query("h48_truncate", "select doc_id, sha256(substr(text, 1, 50)) as cut, length(text) > 50 as was_cut from documents")
def _(t: Tables) -> DataFrame:
    cut, was = tx.truncate("text", 50)
    return t.base("documents").select("doc_id", F.sha2(cut, 256).alias("cut"), was.alias("was_cut"))


@query("h49_sha256", "select doc_id, sha256(text) as hash from documents")
def _(t: Tables) -> DataFrame:
    return t.base("documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("h43_normalized_length", r"select doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) as n from documents")
def _(t: Tables) -> DataFrame:
    return t.base("documents").select("doc_id", F.length(tx.normalize_text("text")).cast("long").alias("n"))


_MARKS = lambda lang: "[" + ", ".join(f"'{w}'" for w in tx.MARKERS[lang]) + "]"


@query("h60_language", rf"with dw as (select doc_id, coalesce(text, '') as text, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}_]+'), lambda x: x <> '')) as w from documents) select doc_id, case when trim(text) = '' then 'und' when len(list_intersect(w, {_MARKS('romanised')})) > len(list_intersect(w, {_MARKS('en')})) then 'romanised' when len(list_intersect(w, {_MARKS('en')})) > 0 then 'en' else 'und' end as language from dw")
def _(t: Tables) -> DataFrame:
    return t.base("documents").select("doc_id", tx.detect_language("text")["language"].alias("language"))


_TERMS = ", ".join(f"('{c}', '{s}', ' {term} ', cast({w} as double))" for c, s, term, w in records.LEXICON)


@query("h62_classification", rf"with lx as (select * from (values {_TERMS}) v(category, sub_category, term, weight)), dw as (select doc_id, ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}_]+'), lambda x: x <> ''), ' ') || ' ' as w from documents), h as (select doc_id, category, sub_category, sum(weight) as weight from dw join lx on contains(w, term) group by 1, 2, 3), s as (select *, sum(weight) over (partition by doc_id, category) as oc, sum(weight) over (partition by doc_id) as oa from h), b as (select *, row_number() over (partition by doc_id order by oc desc, category, weight desc, sub_category) as n from s) select d.doc_id, case when coalesce(oc / oa >= 0.2, false) then category else 'UNKNOWN' end as category, case when coalesce(oc / oa >= 0.2, false) then sub_category else 'UNCLASSIFIED' end as sub_category, coalesce(round(oc / oa, 4), 0) as confidence from documents d left join b on b.doc_id = d.doc_id and n = 1")
def _(t: Tables) -> DataFrame:
    return records.classify(t.base("documents"), "doc_id", "text")


_HAS = lambda words: "(" + " or ".join(f"contains(w, ' {x} ')" for x in words) + ")"
_BASE = f"case when {_HAS(records.SEVERITY['critical'])} then 5 when {_HAS(records.SEVERITY['high'])} then 4 when {_HAS(records.SEVERITY['medium'])} then 3 else 2 end + case when doc_id % 10 >= 7 then 1 else 0 end"


@query("h63_severity", rf"with dw as (select doc_id, ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}_]+'), lambda x: x <> ''), ' ') || ' ' as w from documents), b as (select doc_id, w, case when {_HAS(records.SEVERITY['personal_health'])} then greatest(4, {_BASE}) else {_BASE} end as b from dw) select doc_id, cast(least(5, case when {_HAS(records.SEVERITY['mitigator'])} and not {_HAS(records.SEVERITY['critical'])} then least(2, b) else b end) as int) as severity from b")
def _(t: Tables) -> DataFrame:
    return t.base("documents").select("doc_id", records.severity("text", F.col("doc_id") % 10).alias("severity"))


@query("h65_glossary", "select doc_id, sha256(replace(replace(text, 'License', 'Lizenz'), 'the', 'das')) as gloss from documents")
def _(t: Tables) -> DataFrame:
    return t.base("documents").select("doc_id", F.sha2(records.translate(F.col("text"), {"the": "das", "License": "Lizenz"})["gloss"], 256).alias("gloss"))


@query("h54_titles", "select distinct event_type, upper(substr(event_type, 1, 1)) || substr(event_type, 2) as label from events")
def _(t: Tables) -> DataFrame:
    return t.base("events").select("event_type").distinct().select("event_type", title("event_type").alias("label"))


@query("h69_timestamps", "select event_id, date_trunc('second', ts) as at from events")
def _(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.unix_timestamp("ts").cast("string")).otherwise((F.unix_timestamp("ts") * 1000).cast("string"))
    return t.base("events").select("event_id", raw.alias("raw")).select("event_id", records.parsed_time("raw").alias("at"))


@query("h59_comma_decimals", "select o_orderkey, round(o_totalprice, 2) as price from orders")
def _(t: Tables) -> DataFrame:
    raw = F.replace(F.format_string(" %.2f ", "o_totalprice"), F.lit("."), F.lit(","))
    return t.base("orders").select("o_orderkey", tx.to_double(raw).alias("price"))


@query("h58_null_tokens", "select event_id, case when event_id % 4 = 0 then null else event_type end as cleaned from events")
def _(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 4 == 0, F.element_at(F.array(F.lit(" NULL "), F.lit("n/a"), F.lit("")), (F.col("event_id") % 3 + 1).cast("int"))).otherwise(F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")))
    return t.base("events").select("event_id", tx.null_if_token(raw).alias("cleaned"))


@query("g4_token_jaccard", r"with w as (select doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}_]+'), lambda x: x <> '')) as s from documents), p as (select a.doc_id, a.s as x, b.s as y from w a join w b on b.doc_id = a.doc_id + 1) select doc_id, round(len(list_intersect(x, y)) / cast(len(list_distinct(list_concat(x, y))) as double), 6) as jaccard from p where len(x) + len(y) > 0")
def _(t: Tables) -> DataFrame:
    w = t.base("documents").select("doc_id", tx.tokens("text").alias("x"))
    other = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y"))
    return w.join(other, "doc_id").select("doc_id", F.round(tx.jaccard("x", "y"), 6).alias("jaccard")).where("jaccard is not null")


def reports_of(t: Tables) -> DataFrame:
    place = lambda k: (F.col("event_id") * k % 101).cast("double") / 101 * 0.04
    return t.base("events").select(F.format_string("R%08d", "event_id").alias("report_id"), F.col("event_type").alias("category"), F.concat(F.lit("S"), (F.col("event_id") % 3).cast("string")).alias("sub_category"), (10 + place(31)).alias("lat"), (78 + place(57)).alias("lon"), F.col("ts").alias("at"), F.concat(F.col("event_type"), F.lit(" near place "), (F.col("event_id") % 29).cast("string")).alias("text"))


@query("i6_issue_groups")
def _(t: Tables) -> DataFrame:
    return issues.group_issues(reports_of(t)).select("report_id", "group_id")


@query("c8_best_match")
def _(t: Tables) -> DataFrame:
    rows = reports_of(t)
    # groups stand from the even days on, and reports come on the odd ones, so that both sides grow with the events
    day = F.unix_date(F.to_date("at"))
    groups = rows.where(day % 2 == 0).select(F.col("report_id").alias("group_id"), "category", "sub_category", "lat", "lon", F.lit(None).cast("string").alias("district"), F.lit(None).cast("string").alias("state"), "text", F.col("at").alias("last"))
    return issues.match_issues(rows.where(day % 2 == 1), groups)


@query("j1_embedding_similarity", "with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings) select a.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) as cosine from v a join v b on b.vec_id = a.vec_id + 1")
def _(t: Tables) -> DataFrame:
    v = t.base("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("o"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return v.join(other, "vec_id").select("vec_id", F.round(dot("e", "o") / (F.sqrt(dot("e", "e")) * F.sqrt(dot("o", "o"))), 6).alias("cosine"))
