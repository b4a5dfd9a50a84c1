"""Personal data: base patterns, and bootstrapped contextual extraction. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.llm.common import stored

KINDS = ("email", "ip", "card", "phone")

# Each pattern finds what the contract's pattern finds, in time linear in the text. A run that has failed
# from its first character fails from all later ones, so a match starts at the first, or where the last
# match ended (\G). The card pattern wants the whole chain of digits, so it takes 16 to 19 at most.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: A word that may be an identifier: it holds a digit or an at sign.
CANDIDATE = r"(?<![^ \t-\r])[^ \t-\r]*[0-9@][^ \t-\r]*"
#: Rounds, known instances that a pattern needs, its least confidence, the least score of a discovery and the
#: patterns that it needs, and unseen instances added to what a pattern has matched.
ROUNDS, SUPPORT, CONFIDENCE, ACCEPT, AGREEING, PRIOR = 3, 5, 0.8, 0.9, 2, 2
#: The last and the first word of a gap, whole, in time linear in the gap.
LAST_WORD, FIRST_WORD = r"(?<![^ \t-\r])([^ \t-\r]++)[ \t-\r]*+$", r"^[ \t-\r]*+([^ \t-\r]++)"


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return text.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "phone":
        return F.length(F.regexp_replace(text, "[^0-9]", "")).between(8, 15)
    if kind == "card":
        digits = F.reverse(F.regexp_replace(text, "[^0-9]", ""))
        places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
        total = F.aggregate(places, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
        return total % 10 == 0
    return F.lit(True)


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, at, value, gap, before, after), one more than matches: the text between matches, and the match that ends it.

    gap is its length, before its last word and after its first one, lower-cased. A lambda reads its own
    element alone; an outer expression in it would be evaluated for each element.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("gap"), F.lower(F.regexp_extract(g, LAST_WORD, 1)).alias("before"), F.lower(F.regexp_extract(g, FIRST_WORD, 1)).alias("after")))
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), gaps.alias("g"))
    rows = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x["value"].alias("value"), x["g"]["gap"].alias("gap"), x["g"]["before"].alias("before"), x["g"]["after"].alias("after")))
    here = text.rlike("[0-9@]") & (text.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True))
    return F.filter(F.when(here, rows), lambda r: (r["at"] > 0) | r["value"].isNotNull())


def _spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each of docs, and (doc_id, th, kind, value, before, after, start, stop) of valid base matches and candidates."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = (*KINDS, "candidate")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), *[_matches(text, k, PATTERNS.get(k, CANDIDATE)).alias(k) for k in kinds])
    kept = stored(kept)
    parts = [kept.where(F.size(k) > 0).select("doc_id", "th", F.explode(k).alias("r")).select("doc_id", "th", "r.*") for k in kinds]
    flat = parts[0]
    for part in parts[1:]:
        flat = flat.unionByName(part)
    order = "over (partition by doc_id, th, kind order by at"
    flat = flat.distinct().withColumns({"stop": F.expr(f"sum(gap + coalesce(length(value), 0)) {order} rows between unbounded preceding and current row)").cast("int"), "after": F.expr(f"lead(after) {order})")})
    flat = flat.where("value is not null").withColumn("start", F.col("stop") - F.length("value"))
    valid = F.lit(True)
    for k in KINDS:
        valid = F.when(F.col("kind") == k, _valid(k, F.col("value"))).otherwise(valid)
    return kept.select("doc_id", "th"), flat.where(valid).drop("gap", "at")


def _edges(items: DataFrame) -> DataFrame:
    """(kind, value, side, l, r), each once: an instance and the patterns that it stands in, the word before it, the word after it, and both."""
    left, right = F.when(F.col("before") != "", F.col("before")), F.when(F.col("after") != "", F.col("after"))
    sides = [("l", left, F.lit("")), ("r", F.lit(""), right), ("b", left, right)]
    patterns = F.array(*[F.struct(F.lit(s).alias("side"), l.alias("l"), r.alias("r")) for s, l, r in sides])
    return items.select("kind", F.lower("value").alias("value"), F.explode(patterns).alias("p")).select("kind", "value", "p.*").where("l is not null and r is not null").distinct()


def discover(seeds: DataFrame, candidates: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE, accept: float = ACCEPT) -> DataFrame:
    """(value, kind): candidates that the contexts of seeds, and of what these have discovered, give to a kind.

    seeds and candidates have kind, value, before, after. Known instances are the seeds and, from the second round on, what the round before has
    accepted, so discoveries induce patterns of their own. A pattern's confidence in a kind is the scores of its known
    instances of that kind (1 for a seed) over all its distinct instances, known or not, and PRIOR more; a candidate's score is the noisy-or
    of the patterns that reach ``confidence`` with ``support`` known instances of the kind, and it is accepted from
    ``accept`` with AGREEING patterns or more. Of several kinds the one of the larger score wins, then of the later
    name. Each round is grouped sums and joins; nothing is gathered. Without seeds nothing is discovered; instances are compared in lower
    case, in whatever number they repeat; null contexts make no pattern.
    """
    key = ["side", "l", "r"]
    known = stored(_edges(seeds))
    free = stored(_edges(candidates).drop("kind").join(known.select("value").distinct(), "value", "left_anti"))
    everything = stored(known.select("value", *key).distinct().unionByName(free).groupBy(*key).agg(F.count("*").alias("n")))
    per_kind = known.groupBy(*key, "kind").agg(F.count("*").alias("s"), F.count("*").cast("double").alias("g"))
    found = None
    for _ in range(rounds):
        mass = per_kind
        if found is not None:
            more = free.join(found, "value").groupBy(*key, "kind").agg(F.count("*").alias("s"), F.sum("score").alias("g"))
            mass = per_kind.unionByName(more).groupBy(*key, "kind").agg(F.sum("s").alias("s"), F.sum("g").alias("g"))
        trust = mass.where(F.col("s") >= support).join(everything, key).select(*key, "kind", (F.col("g") / (F.col("n") + PRIOR)).alias("c")).where(F.col("c") >= confidence)
        score = free.join(trust, key).groupBy("value", "kind").agg(F.count("*").alias("patterns"), (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("c"), F.lit(1e-9)))))).alias("score"))
        best = score.where((F.col("score") >= accept) & (F.col("patterns") >= AGREEING)).groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b"))
        found = stored(best.select("value", F.col("b.kind").alias("kind"), F.col("b.score").alias("score")))
    return found.select("value", "kind")


def find_private(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans), one row for each of docs: arrays of (order, start, stop), order being that of KINDS.

    ``base`` holds the patterns' spans, ``spans`` these and the discovered ones, in code points, stop
    exclusive, each sorted. Defined cases: null text is empty text and has no spans; documents are told apart by
    doc_id and text, so repeated rows give repeated rows and a null doc_id is a document like others; a text
    without digit or at sign is passed by; other columns are not read. A candidate that overlaps a base span
    is never added, and a text of any length takes time linear in it. An empty table gives an empty one.
    """
    kept, found = _spans(docs)
    found = stored(found)
    base = found.where(F.col("kind") != "candidate")
    span = F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("order"), F.col("start"), F.col("stop"))
    per_doc = base.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(span)).alias("base"))
    same = [F.col("c.doc_id").eqNullSafe(F.col("d.doc_id")), F.col("c.th") == F.col("d.th")]
    free = found.where(F.col("kind") == "candidate").alias("c").join(per_doc.alias("d"), same, "left")
    free = free.where(~F.coalesce(F.exists("d.base", lambda s: (s["start"] < F.col("c.stop")) & (s["stop"] > F.col("c.start"))), F.lit(False))).select("c.*")
    new = discover(base, free)
    added = free.withColumn("low", F.lower("value")).drop("kind").join(new.withColumnRenamed("value", "low"), "low")
    spans = base.select("doc_id", "th", "kind", "start", "stop").unionByName(added.select("doc_id", "th", "kind", "start", "stop"))
    spans = spans.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    rows = kept.alias("k")
    for name, frame in (("base", per_doc), ("spans", spans)):
        rows = rows.join(frame.alias("d"), [F.col("k.doc_id").eqNullSafe(F.col("d.doc_id")), F.col("k.th") == F.col("d.th")], "left").select("k.*", F.coalesce(f"d.{name}", F.array().cast("array<struct<order:int,start:int,stop:int>>")).alias(name)).alias("k")
    return rows.select("doc_id", "base", "spans")


def written(spans: str) -> Column:
    """The spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["order"]), s["start"], s["stop"])), ",")


def count_of(spans: str, kind: str) -> Column:
    order = KINDS.index(kind) + 1
    return F.size(F.filter(spans, lambda s: s["order"] == order)).cast("long")
