"""Benchmark decontamination by spaced seeds. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.llm.common import stored, unused

#: Masks by the words of an item (from, up to): the token positions that each compares; the others may differ. Each set has been chosen so
#: that for every way in which ``WINDOW`` words (all of a shorter item) can agree in ``AGREE`` of them, some mask meets unchanged words only.
#: All masks of a set have the same last position.
MASKS = (
    (3, 4, ((0, 1, 2),)),
    (5, 8, ((0, 1, 3), (0, 2, 3))),
    (9, 19, ((0, 1, 5, 7), (0, 3, 4, 7))),
    (20, None, ((0, 1, 3, 5, 8, 9), (0, 4, 6, 7, 8, 9), (0, 1, 2, 3, 4, 9), (0, 1, 3, 5, 6, 9))),
)
#: Words of the window that is verified, the part of them that must agree, and bytes of seeds that may be broadcast.
WINDOW, AGREE, BROADCAST_BYTES = 20, 0.8, 32_000_000


def words(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits, in order; an empty one may stand at either end, which nothing matches."""
    return F.transform(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w))


def _spans(rows: DataFrame, tokens: str, sets: Column) -> DataFrame:
    """rows, without tokens, with (at, w0, w1 ..., set, ends) for each position and mask set of ``sets`` that fits there.

    ends hashes the first and the last word, which all masks of a set compare. The words of a span are laid
    side by side, so no row carries a text.
    """
    offsets = sorted({o for _, _, masks in MASKS for m in masks for o in m})
    beside = F.arrays_zip(*[F.slice(tokens, o + 1, F.size(tokens)).alias(f"w{o}") for o in offsets])
    others = [c for c in rows.columns if c != tokens]
    rows = rows.select(*others, F.posexplode(beside).alias("at", "beside")).select(*others, "at", "beside.*")
    ends = [F.when(F.col(f"w{masks[0][-1]}").isNotNull() & F.array_contains(sets, k), F.struct(F.lit(k).alias("set"), F.xxhash64(F.lit(k), "w0", f"w{masks[0][-1]}").alias("ends"))) for k, (_, _, masks) in enumerate(MASKS)]
    return rows.withColumn("e", F.explode(F.array(*ends))).where("e is not null").select("*", "e.set", "e.ends").drop("e")


def _seeds(spans: DataFrame) -> DataFrame:
    """spans with the seed of each mask of their set, without the words."""
    seeds = [F.when(F.col("set") == k, F.xxhash64(F.lit(100 * k + i), *[f"w{o}" for o in m])) for k, (_, _, masks) in enumerate(MASKS) for i, m in enumerate(masks)]
    keep = [c for c in spans.columns if not (c[0] == "w" and c[1:].isdigit())]
    return spans.select(*keep, F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def _best_part() -> Column:
    """Largest share of agreeing words in a window of the item, from tokens, item and offset.

    A running count over the words that agree, less those that have left the window; windows that are not full yet never count more than full ones.
    """
    n, skipped = F.size("item"), F.greatest(-F.col("offset"), F.lit(0))
    beside = F.zip_with(F.slice("tokens", F.greatest("offset", F.lit(0)) + 1, n - skipped), F.slice("item", skipped + 1, n - skipped), lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    width = F.least(F.lit(WINDOW), n)
    same = F.concat(F.array_repeat(F.lit(0), skipped), beside)
    steps = F.slice(F.arrays_zip(same.alias("come"), F.concat(F.array_repeat(F.lit(0), width), same).alias("gone")), F.lit(1), n)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    best = F.aggregate(steps, start, lambda s, x: F.struct((s["now"] + x["come"] - x["gone"]).alias("now"), F.greatest(s["best"], s["now"] + x["come"] - x["gone"]).alias("best")), lambda s: s["best"])
    return best / width


def overlaps(docs: DataFrame, benchmark: DataFrame, agree: float = AGREE) -> DataFrame:
    """(doc_id, th, item_id, part): the documents, told apart by doc_id and hash of the text, and items with a verified overlap.

    Each item has the masks of its own length. Positions whose span begins and ends like one of the benchmark go on, and
    their spaced-seed hashes are joined with its own. On the diagonal of each hit the document is laid against the
    item, and the words that agree are counted in every window of WINDOW of the item's words (all of a
    shorter item); part is the largest share, and ``agree`` or more makes an overlap, so words may be
    replaced. The masks find every such overlap from AGREE on. Benchmark seeds are broadcast if
    they are small, else both sides are shuffled; texts are fetched for hits alone.
    """
    if agree < AGREE:
        raise ValueError(f"the masks find overlaps of {AGREE} and more")
    items = benchmark.select("item_id", F.filter(words(F.col("text")), lambda w: w != F.xxhash64(F.lit(""))).alias("item")).distinct()
    items = stored(items.where(F.size("item") >= MASKS[0][0]))
    n = F.size("item")
    own = F.lit(len(MASKS) - 1)
    for k, (_, last, _) in reversed(list(enumerate(MASKS[:-1]))):
        own = F.when(n <= last, k).otherwise(own)
    items = items.withColumn("own", own)
    spans = _spans(items.select("item_id", F.xxhash64("item").alias("ih"), "own", "item"), "item", F.array("own"))
    ends, seeds = spans.select("ends").distinct(), stored(_seeds(spans).select("seed", "item_id", "ih", F.col("at").alias("item_at")))
    if seeds.agg(F.coalesce(F.sum(40 + F.length(F.col("item_id").cast("string"))), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        ends, seeds = F.broadcast(ends), F.broadcast(seeds)
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("tokens"))
    every = F.array(*[F.lit(k) for k in range(len(MASKS))])
    hits = _seeds(_spans(texts, "tokens", every).join(ends, "ends", "left_semi")).join(seeds, "seed")
    hits = stored(hits.select("doc_id", "th", "item_id", "ih", (F.col("at") - F.col("item_at")).alias("offset")).distinct())
    hit = hits.alias("h").join(items.select(F.col("item_id").alias("same_id"), F.xxhash64("item").alias("same_ih"), "item"), [F.col("h.item_id").eqNullSafe(F.col("same_id")), F.col("h.ih") == F.col("same_ih")]).drop("same_id", "same_ih")
    # the texts of documents without a hit stay where they are, for the keys of the others are small enough to be broadcast or cheap to shuffle
    found = stored(hits.select(F.col("doc_id").alias("found_id"), F.col("th").alias("found_th")).distinct())
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    texts = texts.join(found, texts["doc_id"].eqNullSafe(found["found_id"]) & (texts["th"] == found["found_th"]), "left_semi").select("doc_id", "th", words(F.col("text")).alias("tokens"))
    laid = texts.alias("t").join(hit.alias("h"), [F.col("t.doc_id").eqNullSafe(F.col("h.doc_id")), F.col("t.th") == F.col("h.th")])
    laid = laid.select("h.doc_id", "h.th", "h.item_id", "offset", "item", "tokens").withColumn("part", _best_part())
    return laid.where(F.col("part") >= agree).groupBy("doc_id", "th", "item_id").agg(F.max("part").alias("part"))


def contamination(docs: DataFrame, benchmark: DataFrame, agree: float = AGREE) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, part), one row for each of docs.

    item_ids are sorted; part is the largest share over all items, 0 without one. Defined cases: null or
    empty text has no words and is clean; an item of fewer than three words, or without text, matches nothing; items with one id are several
    texts of one item; rows are told apart by doc_id and text, so repeated rows repeat their finding, rows of one doc_id with
    unlike texts have their own, and a null doc_id is a document like others; shares that tie need no order; a text of any length takes
    time linear in it; an empty benchmark makes all documents clean and no documents give no rows; other columns are not read.
    """
    found = overlaps(docs, benchmark, agree).groupBy("doc_id", "th").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("item_ids"), F.max("part").alias("part"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th")).alias("d").join(found.alias("f"), [F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), F.col("d.th") == F.col("f.th")], "left")
    return rows.select("d.doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"), F.coalesce("part", F.lit(0.0)).alias("part"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows of contaminated documents, by doc_id and text; all columns are carried, whatever their names. Cases as in ``contamination``."""
    doc, th, key = unused(docs, "doc", "th", "key")
    hit = stored(overlaps(docs, benchmark).select(F.col("doc_id").alias(doc), F.col("th").alias(th)).distinct())
    rows = docs.withColumn(key, F.xxhash64("text"))
    return rows.join(hit, rows["doc_id"].eqNullSafe(hit[doc]) & (rows[key] == hit[th]), "left_anti").drop(key)
