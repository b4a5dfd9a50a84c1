"""Collocations by stripes: each prefix keys the counts of the words that follow it."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardloom.llm.common import drop_stored, mapped, stored

#: Words of a phrase at most, occurrences at least, phrases of a language in the result, and per cent of a phrase's count from which a longer one stands for it.
LONGEST, LEAST, TOP, SUBSUMED = 5, 100, 2000, 100
#: Bytes of text counted together in a task.
FLUSH = 16_000_000
#: A prefix with more than one in so many of all words is hot: there are no more of them than that, and their stripes are dealt over all partitions.
HOT = 1024
#: Bits of the map of frequent phrases for each of them, and at most. A fuller map lets more phrases be counted in vain; it misses none.
BITS_EACH, MAP_BITS = 16, 28
MIX = np.uint64(0x9E3779B97F4A7C15)
BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
STRIPES = "lang string, prefix string, shard int, next array<string>, n array<bigint>"


def _hashes(seed: int, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of their words, one array for each place in the phrase."""
    h = np.full(len(words[0]), seed, np.uint64)
    for w in words:
        h = (h ^ (h >> np.uint64(29))) * MIX + w
    return h ^ (h >> np.uint64(32))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


@dataclass
class Known:
    """What is known of the phrases with one word less: a map of the frequent ones, which holds others too, and the hashes of the hot ones."""

    words: int = 0
    bits: Broadcast | None = None
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.bits.value, np.uint8)
        at = h & np.uint64(8 * len(bits) - 1)
        return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def pieces(data: bytes, limit: int = FLUSH) -> Iterator[bytes]:
    """Text in lower case (A-Z), with \\n where a piece ends, in parts of about ``limit`` bytes that end where a piece does."""
    data = data.lower().translate(BREAKS)
    while len(data) > limit and (cut := data.find(b"\n", limit)) >= 0:
        yield data[:cut]
        data = data[cut + 1 :]
    yield data


def stripes(lang: str, data: bytes, known: Known, shards: int) -> pa.RecordBatch:
    """The stripes of phrases with one word more than ``known``: for each prefix the words that follow it in data, with their counts. Equal words of one prefix may come twice."""
    number = defaultdict(count().__next__)
    number[b""], number[b"\n"]
    ids = np.fromiter(map(number.__getitem__, data.replace(b"\n", b" \n ").split(b" ")), np.int64)
    ids = ids[ids > 0]
    words, k = list(number), known.words
    hashes = _word_hashes(words)
    spelled = pa.array(words, pa.binary()).cast(pa.string())
    if k == 0:
        n = np.bincount(ids, minlength=len(words))[2:]
        last, first, prefix, shard = np.arange(2, len(words)), np.zeros(len(n), np.int64), None, (hashes[2:] % np.uint64(shards)).astype(np.int32)
    else:
        breaks = np.concatenate([[0], np.cumsum(ids == 1)])
        size = max(0, len(ids) - k)
        of = hashes[ids]
        grams = _hashes(xxhash.xxh3_64_intdigest(lang.encode()), [of[j : j + size + 1] for j in range(k)])
        fine = known.may_hold(grams)
        at = np.nonzero(fine[:-1] & fine[1:] & (breaks[k + 1 : k + 1 + size] == breaks[:size]))[0]
        column = lambda places, j: ids[places + j]
        at = at[np.argsort(grams[at] * MIX + of[at + k])]
        new = np.ones(len(at), bool)
        new[1:] = np.logical_or.reduce([column(at[1:], j) != column(at[:-1], j) for j in range(k + 1)])
        first = np.nonzero(new)[0]
        n = np.diff(np.append(first, len(at)))
        first = at[first]
        last, prefix = ids[first + k], grams[first]
        shard = np.where(np.isin(prefix, known.hot), hashes[last] % np.uint64(shards), 0).astype(np.int32)
    order = np.lexsort([shard] if prefix is None else [shard, prefix])
    first, last, n, shard = first[order], last[order], n[order], shard[order]
    new = np.ones(len(n), bool)
    new[1:] = shard[1:] != shard[:-1]
    for j in range(k):
        new[1:] |= column(first[1:], j) != column(first[:-1], j)
    heads = np.nonzero(new)[0]
    offsets = pa.array(np.append(heads, len(n)), pa.int32())
    parts = [spelled.take(pa.array(column(first[heads], j))) for j in range(k)]
    named = pc.binary_join_element_wise(*parts, " ") if k else pa.array([""] * len(heads), pa.string())
    lists = [pa.ListArray.from_arrays(offsets, spelled.take(pa.array(last))), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(heads), pa.string()), named, pa.array(shard[heads]), *lists], names=["lang", "prefix", "shard", "next", "n"])


def _counted(docs: DataFrame, known: Known, shards: int) -> DataFrame:
    """(lang, prefix, next, n): the stripes of all tasks, merged word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = defaultdict(list)
        size = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[lang].append(text.encode())
                size += len(held[lang][-1])
                if size > FLUSH:
                    yield from flushed(held)
                    size = 0
        yield from flushed(held)

    def flushed(held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        while held:
            lang, said = held.popitem()
            for part in pieces(b"\n".join(said)):
                yield stripes(lang, part, known, shards)

    each = mapped(docs, run, docs.sparkSession.createDataFrame([], STRIPES).schema)
    merged = each.repartition("lang", "prefix", "shard").select("lang", "prefix", "shard", F.inline(F.arrays_zip("next", "n")))
    return merged.groupBy("lang", "prefix", "shard", "next").agg(F.sum("n").alias("n")).drop("shard")


def _known(spark: SparkSession, level: DataFrame, words: int, rows: int, total: int) -> Known:
    """The map of a level's phrases, or'ed together from its parts, and the hashes of its hot ones."""
    size = min(MAP_BITS, max(12, int(BITS_EACH * rows - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.zeros(b.num_rows, np.uint64)
            langs = np.array(b.column(0).to_pylist(), object)
            said = [x.encode().split(b" ") for x in b.column(1).to_pylist()]
            of = _word_hashes([w for s in said for w in s]).reshape(-1, words)
            for lang in set(langs):
                mine = langs == lang
                h[mine] = _hashes(xxhash.xxh3_64_intdigest(lang.encode()), list(of[mine].T))
            at = h & np.uint64((1 << size) - 1)
            bit = (np.uint64(1) << (at & np.uint64(31))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(5)).astype(np.int64)), pa.array(bit), pa.array(h.view(np.int64)), b.column(2)], names=["at", "bit", "h", "n"])

    named = level.select("lang", F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next")).alias("phrase"), "n")
    hashed = stored(mapped(named, run, spark.createDataFrame([], "at bigint, bit bigint, h bigint, n bigint").schema))
    found = hashed.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 5), np.uint32)
    bits[found.column("at").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    hot = np.array([r["h"] for r in hashed.where(F.col("n") * HOT > total).select("h").collect()], np.int64).view(np.uint64)
    drop_stored(hashed)
    return Known(words, spark.sparkContext.broadcast(bits.tobytes()), hot)


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) with the number of words of each language, and for each length up to ``longest`` the (lang, prefix, next, n) that are said ``least`` times or more.

    One pass for each length. Phrases are counted only where both of their parts with one word less are in the map of frequent ones; the merged counts decide.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = stored(_counted(docs, Known(), shards))
    totals = stored(every.groupBy("lang").agg(F.sum("n").alias("n")))
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    levels = [stored(every.where(F.col("n") >= least))]
    drop_stored(every)
    for words in range(1, longest):
        rows = levels[-1].count()
        if not rows:
            break
        known = _known(spark, levels[-1], words, rows, total)
        levels.append(stored(_counted(docs, known, shards).where(F.col("n") >= least)))
        known.bits.unpersist()
    return totals, levels


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the ``top`` phrases of 2 to ``longest`` words, by score, count and spelling.

    Words are lower-cased (A-Z) and parted by space and tab, pieces by . , ; : ! ? and line ends. a counts a phrase, n all words of its language. Cut in two parts, said l and r times, a phrase scores
    floor(1000 a n / (l r)); its worst cut counts, the first one of equal. The stripes give all of it: an entry is a phrase's count, the entries one word shorter are the totals of its prefixes, and the greatest entry
    among a phrase's extensions to either side tells if a longer one, said ``subsumed`` per cent as often, stands for it. Defined cases: a null language is ``und``, a null text is
    empty; long texts are counted in parts; repeated rows count again; ties are broken by spelling in bytes; other columns are not read; an empty table gives no rows. Counts
    beyond 10^18 raise an error.
    """
    totals, levels = phrase_counts(docs, longest, least)
    phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    named = [t.select("lang", phrase.alias("phrase"), "prefix", F.lit(k + 1).alias("k"), "n") for k, t in enumerate(levels)]
    every = named[0]
    for t in named[1:]:
        every = every.unionByName(t)
    said = every.select("lang", "phrase", F.col("n").alias("a"), "k", "prefix")
    part = lambda name, total: every.select("lang", F.col("phrase").alias(name), F.col("n").alias(total))
    words = F.split("phrase", " ")
    sides = F.array(F.col("prefix"), F.array_join(F.slice(words, 2, longest), " "))
    longer = every.where("k > 2").select("lang", F.explode(sides).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    alone = said.where("k > 1").join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < subsumed * F.col("a")))
    cuts = alone.select("lang", "phrase", "a", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(F.array_join(F.slice(words, F.lit(1), i), " ").alias("first"), F.array_join(F.slice(words, i + 1, F.lit(longest)), " ").alias("rest")))).alias("cut", "parts"))
    cuts = cuts.select("lang", "phrase", "a", "cut", "parts.*").join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(F.broadcast(totals), "lang")
    exact = "cast(cast(1000 * a as decimal(21,0)) * cast(n as decimal(18,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)"
    scored = cuts.withColumn("score", F.expr(exact)).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("worst")).select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # The best of each language are among the best of its parts, so no task holds a whole language.
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
