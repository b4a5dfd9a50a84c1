"""Terms of a table, however many, found in texts in one pass: place names, keywords, entries of a lexicon.

An automaton looks for all terms at once, so a text is read once and gives rows for what is found alone. Terms up to a checked size are
the automaton; of more, their first characters are, and what follows these in a text is met with the terms in a join.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that one automaton may hold, lengths of terms counted as one each; it takes some 40 bytes a character in a worker.
MOST_CHARS = 2_000_000
#: Numbers of first characters that are tried where the terms themselves are too many.
HEADS = (32, 24, 16, 12, 8, 6, 4, 3, 2, 1)
#: Parts that one term's finds are dealt over in a join, since a single term may stand in a third of all texts.
SALT = 8
#: Bits of the map of all terms that candidates must be in, as a power of two; terms beyond it let more candidates through and lose none.
SIEVE = 24
#: Texts that a worker takes at a time, and finds that it gives back at a time.
TEXTS, FINDS = 1000, 50_000


def _wordlike(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LNM"


def _sieve(wanted: DataFrame) -> bytes:
    """A map of a fixed size with a bit set for the checksum of each term."""
    at = wanted.select((F.crc32(F.encode("term", "UTF-8")) % (1 << SIEVE)).alias("at"))
    words = at.groupBy(F.expr("cast(at div 32 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 32 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << SIEVE - 5, dtype="<u4")
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().astype("<u4")
    return bits.tobytes()


def _finds(rows: DataFrame, key: str, text: Column, heads: DataFrame, whole_words: bool, sieve: bytes | None) -> DataFrame:
    """(key, term, starts): what stands behind each head in the lengths that its terms have, where the sieve has it. Texts come and finds go in small batches."""
    spark = rows.sparkSession
    # bounded: the caller has summed its characters
    shared = spark.sparkContext.broadcast(([(r["head"], tuple(r["lengths"])) for r in heads.collect()], sieve))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, TEXTS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS)
    mask = (1 << SIEVE) - 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = shared.value
        automaton = ahocorasick.Automaton()
        for head, lengths in known:
            automaton.add_word(head, (len(head), lengths))
        if known:
            automaton.make_automaton()

        def of(text: str) -> dict[str, list[int]]:
            starts: dict[str, list[int]] = {}
            for last, (n, lengths) in automaton.iter(text) if known else ():
                start = last - n + 1
                if whole_words and start and _wordlike(text[start - 1]):
                    continue
                for length in lengths:
                    end = start + length
                    if end > len(text) or whole_words and end < len(text) and _wordlike(text[end]):
                        continue
                    term = text[start:end]
                    if bits is not None:
                        at = zlib.crc32(term.encode()) & mask
                        if not bits[at >> 3] >> (at & 7) & 1:
                            continue
                    starts.setdefault(term, []).append(start)
            return starts

        for batch in batches:
            at, names, places = [], [], []
            given = lambda: pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(names, pa.string()), pa.array(places, pa.list_(pa.int32()))], names=["k", "term", "starts"])  # noqa: B023, E731
            for i, text in enumerate(batch.column(1)):
                for term, starts in of(text.as_py()).items():
                    at.append(i)
                    names.append(term)
                    places.append(sorted(starts))
                    if len(at) >= FINDS:
                        yield given()
                        at, names, places = [], [], []
            yield given()

    given = rows.select(F.col(key).alias("k"), text.alias("text"))
    schema = T.StructType([given.schema["k"], T.StructField("term", T.StringType()), T.StructField("starts", T.ArrayType(T.IntegerType()))])
    return given.mapInArrow(find, schema).withColumnRenamed("k", key)


def _headed(terms: DataFrame, chars: int | None) -> DataFrame:
    """(head, lengths): the first so many characters of terms, or whole ones, and the lengths of the terms behind each."""
    head = F.col("term") if chars is None else F.substring("term", 1, chars)
    return terms.select(head.alias("head"), F.length("term").alias("n")).groupBy("head").agg(F.sort_array(F.collect_set("n")).alias("lengths"))


def _size(heads: DataFrame) -> int:
    return heads.agg(F.sum(F.length("head") + F.size("lengths")).alias("n")).first()["n"] or 0


def dealt_join(found: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """found(key, term, ...) with all columns of entries(term, ...); finds of one term are dealt over several tasks by their key."""
    copies = entries.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return found.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int")).join(copies, ["term", "__salt"]).drop("__salt")


def occurrences(rows: DataFrame, terms: DataFrame, key: str, text: str, term: str = "term", whole_words: bool = False, most_chars: int = MOST_CHARS) -> DataFrame:
    """(key, term, starts): each term that stands in the text of a row, in lower case, and where, in code points of the lowered text.

    Overlaps count. With whole_words no letter, mark, digit or underscore stands before or behind a find. Terms are told apart in
    lower case; null and empty ones, and texts, give nothing; rows with equal keys give their own rows each. Texts are read whole and are not shuffled.
    Up to most_chars the terms are one automaton in each task. Beyond, the longest heads of ``HEADS`` that fit are; a find of a
    head gives one candidate for each length of its terms, once a text, if a map of the terms' checksums has it, and an equi-join with the terms keeps the right ones. key is neither ``term`` nor ``starts``.
    """
    wanted = terms.select(F.lower(F.col(term)).alias("term")).where("term <> ''").distinct()
    heads, whole = _headed(wanted, None), True
    if _size(heads) > most_chars:
        whole = False
        for chars in HEADS:
            heads = _headed(wanted, chars)
            # single characters are the least: as many as there are code points, with the lengths of terms
            if chars == 1 or _size(heads) <= most_chars:
                break
    found = _finds(rows, key, F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), heads, whole_words, None if whole else _sieve(wanted))
    return found if whole else dealt_join(found, wanted, key).select(key, "term", "starts")


def gazetteer_entities(rows: DataFrame, gazetteer: DataFrame, key: str, text: str, confidence: float = 0.85) -> DataFrame:
    """(key, type, text, start, end, confidence): names of gazetteer(name, type) that stand in a text as whole words, each place of each once by type."""
    names = gazetteer.select(F.lower("name").alias("term"), "type").distinct()
    found = dealt_join(occurrences(rows, names, key, text, whole_words=True), names, key)
    spans = found.select(key, "type", F.col("term").alias("text"), F.explode("starts").alias("start"))
    return spans.select(key, "type", "text", "start", (F.col("start") + F.length("text")).alias("end"), F.lit(confidence).alias("confidence"))
