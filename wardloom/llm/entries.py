"""The registered queries of the operators and of the pipeline, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.llm.collocations import collocations
from wardloom.llm.common import documents, stored
from wardloom.llm.decontaminate import contamination
from wardloom.llm import katz
from wardloom.llm import line_quality
from wardloom.llm.line_dedup import dedup_lines
from wardloom.llm.piece_codec import encode_documents
from wardloom.llm.private_data import KINDS, count_of, find_private, written
from wardloom.llm.simhash import simhash_components
from wardloom.llm.vector_dedup import link_embeddings
from wardloom.llm.substring_dedup import remove_repeats
from wardloom.llm.weak_quality import fit_quality, score_quality
from wardloom.llm.word_runs import collapse_runs
from wardloom.llm.zstd_language import fit_dictionaries, held_out, predict_language

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(documents(spark, sf_dir))
    counts = [count_of("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(documents(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    test = held_out("doc_id", 5, 0)
    dictionaries = fit_dictionaries(docs.where(F.col("doc_id").isNotNull() & ~test))
    found = predict_language(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", test.alias("held_out"), "lang_pred", "score", "accepted")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_quality(docs, documents(spark, sf_dir, "labels"))
    return score_quality(docs.select("doc_id", "text"), model).drop("text")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    test = held_out("doc_id", 7, 2)
    train = F.col("doc_id").isNotNull() & ~test
    model = katz.fit(docs, train)
    scored = katz.score(docs, model, train)
    found = stored(scored.select("doc_id", test.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"))
    model.drop(spark)
    return found


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def made_periodic(doc_id: str, text: str) -> Column:
    """The text of a document whose id asks for it with its words repeated from one of them on, by the rule of op11's contract; other texts as they are."""
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)

    def written(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        block = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, 1, a), F.slice(block, 1, n - a)), " ")

    words = F.array_remove(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), "")
    return F.when((h % 10 == 0) & F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.transform(F.array(words), written)[0]).otherwise(F.col(text))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", made_periodic("doc_id", "text").alias("text"))
    greater = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)  # noqa: E731
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))  # noqa: E731
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), greater)
    found = collapse_runs(docs).withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_quality.clean_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_navigation", "n_boilerplate", "n_punctuation", F.sha2("text", 256).alias("cleaned_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir).select("lang", "text"))


OP1_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.doc_id, k.i, k.line, (h.key IS NOT NULL AND k.doc_id <> h.top) AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM s),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 35)) AS p FROM g JOIN r USING (h)),
k AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
a AS (SELECT d.doc_id, d.w, unnest(range(1, len(d.w) + 1)) AS p FROM d),
b AS (SELECT a.doc_id, string_agg(a.w[a.p], ' ' ORDER BY a.p) AS kept FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.p = c.p WHERE c.p IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(k.gone), 0) AS n_removed, sha256(coalesce(b.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN b ON d.doc_id = b.doc_id
"""

#: Brute force: every diagonal of every document and item that has equal words.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') AS t FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dp AS (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM d),
bp AS (SELECT item_id, least(20, len(w)) AS width, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM b WHERE len(w) >= 3),
m AS (SELECT doc_id, item_id, width, i - j AS o, j, count(*) OVER (PARTITION BY doc_id, item_id, i - j) AS n FROM dp JOIN bp USING (x)),
p AS (SELECT doc_id, item_id, width, count(*) OVER (PARTITION BY doc_id, item_id, o ORDER BY j RANGE BETWEEN width - 1 PRECEDING AND CURRENT ROW) AS same FROM m WHERE n >= 0.8 * width),
f AS (SELECT doc_id, item_id, max(same / CAST(width AS DOUBLE)) AS part FROM p GROUP BY 1, 2 HAVING max(same / CAST(width AS DOUBLE)) >= 0.8),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, max(part) AS part FROM f GROUP BY 1)
SELECT d.doc_id, g.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids, coalesce(part, 0) AS part FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""

OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS len FROM v WHERE label IS NOT NULL AND list_dot_product(e, e) > 0),
p AS (SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

#: All pairs of equal 16 words of a document, which any run of 24 words and three periods has at its period, in islands of one distance.
OP11_SQL = r"""
WITH e AS (SELECT doc_id, text, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), CAST(range(8) AS BIGINT[])), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))) AS crc FROM documents),
d AS (SELECT doc_id, xor(crc, 4294967295) AS h, list_filter(string_split_regex(coalesce(text, ''), '[ 	

]+'), lambda x: x <> '') AS w FROM e),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM p),
s AS (SELECT doc_id, w, unnest(range(0, n - 15)) AS i FROM t WHERE n >= 16),
m AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + 16), ' ')) AS m FROM s),
q AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.m = y.m AND x.i < y.i),
o AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM q),
l AS (SELECT doc_id, q, min(i) AS start, count(*) + 15 + q AS length FROM o GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM l WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
b AS (SELECT x.* FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.doc_id = x.doc_id AND (y.length * x.period > x.length * y.period OR (y.length * x.period = x.length * y.period AND (y.start < x.start OR (y.start = x.start AND y.period < x.period)))))),
c AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM t),
k AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.i = u.i WHERE g.i IS NULL GROUP BY u.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(c.runs, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM t LEFT JOIN c ON c.doc_id = t.doc_id LEFT JOIN b ON b.doc_id = t.doc_id LEFT JOIN k ON k.doc_id = t.doc_id
"""

_SQL_SPACES = r"[ \t\n\x0B\f\r]+"

OP12_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
w AS (SELECT *, list_filter(string_split_regex(line, '{_SQL_SPACES}'), lambda x: x <> '') AS w FROM l),
c AS (SELECT *, len(w) AS n, array_to_string(w, ' ') AS plain, length(array_to_string(w, '')) AS chars, len(regexp_extract_all(line, '{line_quality.SYMBOLS}')) AS symbols,
  len(list_filter(w, lambda x: regexp_matches(x, '{line_quality.SEPARATOR}'))) AS seps, len(list_filter(w, lambda x: regexp_matches(x, '{line_quality.MARKED}'))) AS marks FROM w),
j AS (SELECT *, CASE WHEN n = 0 THEN NULL
  WHEN seps >= 3 AND 100 * seps >= 25 * n OR n <= 6 AND regexp_matches(lower(plain), '^({"|".join(line_quality.MENU)})[.:]?$') THEN 'navigation'
  WHEN n <= 30 AND regexp_matches(lower(plain), '{"|".join(line_quality.BOILERPLATE)}') THEN 'boilerplate'
  WHEN symbols >= 3 AND 100 * symbols > 30 * n OR marks >= 3 AND 100 * marks > 33 * n OR n < 4 AND NOT regexp_matches(plain, '{line_quality.FINAL.replace("'", "''")}') THEN 'punctuation' END AS failed,
  n > 0 AND row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM c),
d AS (SELECT doc_id, sum(n) AS n_words, sum(chars) AS word_chars, sum(symbols) AS n_symbols, count(*) FILTER (WHERE again) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE failed IS NOT NULL), 0) AS lost,
  count(*) FILTER (WHERE failed = 'navigation') AS n_navigation, count(*) FILTER (WHERE failed = 'boilerplate') AS n_boilerplate, count(*) FILTER (WHERE failed = 'punctuation') AS n_punctuation,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE failed IS NULL), '')) AS cleaned_sha256 FROM j GROUP BY doc_id),
t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_SQL_SPACES}'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r WHERE n > 1) GROUP BY doc_id),
f AS (SELECT d.*, coalesce(p.n_repeat_words, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(p.n_repeat_words, 0) > 20 * n_words AS base_failed FROM d LEFT JOIN p USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost <= 70 * word_chars AS kept,
  n_navigation, n_boilerplate, n_punctuation, cleaned_sha256 FROM f
"""

OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
g AS (SELECT lang, list_slice(w, i, i + k - 1) AS g, k FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, array_to_string(g, ' ') AS phrase, k, count(*) AS a FROM g GROUP BY lang, g, k HAVING count(*) >= 100),
v AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
e AS (SELECT lang, array_to_string(list_slice(w, 1, k - 1), ' ') AS phrase, a FROM v UNION ALL SELECT lang, array_to_string(list_slice(w, 2, k), ' '), a FROM v),
x AS (SELECT lang, phrase, max(a) AS longer FROM e GROUP BY lang, phrase),
c AS (SELECT v.* FROM v LEFT JOIN x USING (lang, phrase) WHERE k >= 2 AND (longer IS NULL OR longer < a)),
u AS (SELECT lang, phrase, a, unnest(range(1, k)) AS cut, w, k FROM c),
z AS (SELECT u.lang, u.phrase, u.a, u.cut, l.a AS l, r.a AS r, t.n, CAST(1000 AS HUGEINT) * u.a * t.n // (CAST(l.a AS HUGEINT) * r.a) AS score FROM u
  JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(list_slice(w, 1, cut), ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(list_slice(w, cut + 1, u.k), ' ') JOIN t ON t.lang = u.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS worst FROM z),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE worst = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000
"""


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_private_data": op3_private_data,
        "op4_decontamination": op4_decontamination,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_language_id": op6_language_id,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_quality": op8_quality,
        "op9_language_model": op9_language_model,
        "op10_simhash": op10_simhash,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_quality_rules": op12_quality_rules,
        "op13_collocations": op13_collocations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op4_decontamination": OP4_SQL, "op5_embedding_dedup": OP5_SQL, "op11_periodic_runs": OP11_SQL, "op12_quality_rules": OP12_SQL, "op13_collocations": OP13_SQL}
