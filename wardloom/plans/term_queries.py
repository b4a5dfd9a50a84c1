"""Queries that look for the terms of a table in all texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.operators import geocode, terms, vocabulary
from wardloom.plans.registry import query
from wardloom.sources.testdata import Tables

#: Keywords of six letters and more and pairs of neighbouring words of the benchmark, both as a dictionary.
_WORDS = "select item_id, unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) as word from benchmark"
_PAIRS = "select distinct concat(ws[i], ' ', ws[i + 1]) as term from (select ws, unnest(range(1, len(ws))) as i from (select string_split(lower(text), ' ') as ws from benchmark) a) b"


def _words(t: Tables) -> DataFrame:
    plain = F.regexp_replace(F.lower("text"), "[^a-z]+", " ")
    return t.base("benchmark").select("item_id", F.explode(F.split(plain, " ")).alias("word"))


def _pairs(t: Tables) -> DataFrame:
    ws = t.base("benchmark").select(F.split(F.lower("text"), " ").alias("ws"))
    return ws.select(F.explode(F.transform(F.slice("ws", 2, F.greatest(F.size("ws") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get("ws", i), w))).alias("term")).distinct()


_FOUND = f"with p as ({_PAIRS}), d as (select doc_id, lower(text) as low from documents) select doc_id, count(*) as n_terms, min(term) as least, max(term) as largest, sum(length(term))::bigint as chars from d join p on contains(low, term) group by doc_id"


def _counted(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.min("term").alias("least"), F.max("term").alias("largest"), F.sum(F.length("term")).alias("chars"))


@query("c9_terms_in_texts", _FOUND)
def _(t: Tables) -> DataFrame:
    return _counted(terms.occurrences(t.base("documents"), _pairs(t), "doc_id", "text"))


@query("c9_terms_by_heads", _FOUND)
def _(t: Tables) -> DataFrame:
    """The same where the terms are more than one automaton is to hold."""
    return _counted(terms.occurrences(t.base("documents"), _pairs(t), "doc_id", "text", most_chars=12_000))


@query("c9_longest_name", f"with p as ({_PAIRS}), d as (select doc_id, lower(coalesce(text, '')) as low from documents), h as (select doc_id, term, row_number() over (partition by doc_id order by length(term) desc, term) as n from d join p on contains(low, term)) select d.doc_id, length(h.term) as place from d left join h on h.doc_id = d.doc_id and n = 1")
def _(t: Tables) -> DataFrame:
    names = _pairs(t).select(F.col("term").alias("alias"), F.length("term").cast("long").alias("place"))
    return geocode.by_text(t.base("documents"), names, "doc_id", "text")


_DICTIONARY = f"select distinct concat('C', item_id % 5) as category, concat('S', item_id % 3) as sub_category, case item_id % 4 when 0 then 'en' when 1 then 'fr' when 2 then 'de' else 'es' end as language, word as keyword from ({_WORDS}) w where length(word) >= 6"


@query(
    "h66_dictionary_keywords",
    f"""with k as ({_DICTIONARY}), d as (select doc_id, lang, lower(text) as low from documents), u as (select distinct keyword from k),
    m as (select doc_id, lang, k.* from (select doc_id, lang, keyword from d join u on contains(low, keyword)) f join k on k.keyword = f.keyword),
    p as (select doc_id, category, sub_category, keyword, row_number() over (partition by doc_id, category, sub_category order by length(keyword) desc, keyword, case when language is not distinct from lang then 0 else 1 end) as n, length(keyword) + case when language is not distinct from lang then 3.0 else 0.0 end as score from m)
    select doc_id, row_number() over (partition by doc_id order by score desc, keyword, category, sub_category)::int as rank, score::double as score, keyword, category, sub_category from p where n = 1""",
)
def _(t: Tables) -> DataFrame:
    tag = F.when(F.col("item_id") % 4 == 0, "en").when(F.col("item_id") % 4 == 1, "fr").when(F.col("item_id") % 4 == 2, "de").otherwise("es")
    dictionary = _words(t).where("length(word) >= 6").select(F.concat(F.lit("C"), F.col("item_id") % 5).alias("category"), F.concat(F.lit("S"), F.col("item_id") % 3).alias("sub_category"), tag.alias("language"), F.col("word").alias("keyword")).distinct()
    return vocabulary.keyword_matches(t.base("documents"), dictionary, "doc_id", "text", "lang")


@query(
    "h64g_gazetteer_entities",
    rf"""with g as (select distinct word as name, concat('T', item_id % 3) as type from ({_WORDS}) w where length(word) >= 4),
    tok as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}_]+')) as name from documents)
    select doc_id, type, name as text, count(*) as n, cast(count(*) * length(name) as bigint) as chars, 0.85::double as confidence from tok join g using (name) group by doc_id, type, name""",
)
def _(t: Tables) -> DataFrame:
    gazetteer = _words(t).where("length(word) >= 4").select(F.col("word").alias("name"), F.concat(F.lit("T"), F.col("item_id") % 3).alias("type"))
    spans = terms.gazetteer_entities(t.base("documents"), gazetteer, "doc_id", "text")
    return spans.groupBy("doc_id", "type", "text").agg(F.countDistinct("start").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"), F.max("confidence").alias("confidence"))
