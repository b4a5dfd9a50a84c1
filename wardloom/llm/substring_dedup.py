"""Substring deduplication: seeds on winnowed anchors, extended to maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.common import long_array, mapped, stored, texts, unused, without

#: Words of a repeat at least, and words of an anchor.
WINDOW, ANCHOR = 35, 16
#: Bits of the map of repeated anchors, whatever the corpus; texts handled at a time; buckets for each shuffle partition.
MAP_BITS, TEXTS, BUCKETS_EACH = 27, 1000, 4
BASE, BASE2, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
WORDS_KEPT = 300_000


class _Hashes(dict):
    """Word hashes, kept for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def _rolled(a: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of each k consecutive values, modulo 2^64, by doubling."""
    n = len(a) - k + 1
    out, done, width, part = np.zeros(n, np.uint64), 0, 1, a
    while True:
        if k & width:
            out = out * _power(base, width) + part[done : done + n]
            done += width
        if done == k:
            return out
        part = part[:-width] * _power(base, width) + part[width:]
        width *= 2


def _first_least(v: np.ndarray, k: int) -> np.ndarray:
    """Position of the first least of each k consecutive values, by doubling."""
    at, width = np.arange(len(v)), 1
    while width < k:
        step = min(width, k - width)
        left, right = at[:-step], at[step:]
        at = np.where(v[right] < v[left], right, left)
        width += step
    return at


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


def _windows(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of one text: its hash and position. Both follow from the window's words alone."""
    grams = _mixed(_rolled(words, anchor, BASE))
    at = _first_least(grams, window - anchor + 1)
    return grams[at], at


def _place(t: np.ndarray, start: np.ndarray) -> np.ndarray:
    return _mixed(t.view(np.uint64) * BASE + start.astype(np.uint64) * BASE2)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("t"), text.alias("text"))


def _hashed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(t, word hashes) of the texts that are long enough, TEXTS at a time, each text once in it."""
    known = _Hashes()
    get = known.__getitem__
    for whole in batches:
        for i in range(0, whole.num_rows, TEXTS):
            b = whole.slice(i, TEXTS)
            t, first = np.unique(b.column("t").to_numpy(), return_index=True)
            rows = [np.fromiter(map(get, w), np.uint64, len(w)) for w in (x.encode().split() for x in texts(b.column("text").take(pa.array(first))))]
            keep = [j for j, r in enumerate(rows) if len(r) >= window]
            if keep:
                yield t[keep], [rows[j] for j in keep]


def _anchors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, rows in _hashed(batches, window):
            found, place = [], []
            for one, words in zip(t, rows):
                h, at = _windows(words, window, anchor)
                new = np.flatnonzero(np.diff(at, prepend=-1))
                found.append(h[new])
                place.append(_place(np.full(len(new), one), at[new]))
            yield pa.record_batch([long_array(np.concatenate(found)), long_array(np.concatenate(place))], names=["anchor", "place"])

    return run


def _extended(window: int, anchor: int, buckets: int, shared):
    """Windows around repeated anchors, dealt by their hash; those that repeat within TEXTS texts are told at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for t, rows in _hashed(batches, window):
            parts = []
            for one, words in zip(t, rows):
                h, _ = _windows(words, window, anchor)
                slot = h >> np.uint64(64 - MAP_BITS)
                start = np.flatnonzero((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
                if len(start):
                    w = _mixed(_rolled(words, window, BASE))[start]
                    c = (_mixed(_rolled(words, window, BASE2))[start] >> np.uint64(48)).astype(np.uint16)
                    parts.append((w, c, np.full(len(start), one), start.astype(np.uint32)))
            if not parts:
                continue
            w, c, t_, start = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((c, w))
            same = (w[order][1:] == w[order][:-1]) & (c[order][1:] == c[order][:-1])
            again, before = np.zeros(len(w), bool), np.zeros(len(w), bool)
            again[order[1:]] = same  # not the first of its window here
            before[order[:-1]] = same
            yield from _told(t_[again | before], start[again | before], buckets)
            w, c, t_, start = (x[~again] for x in (w, c, t_, start))
            bucket = (w % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            names, first = np.unique(bucket[order], return_index=True)
            payload = [b"".join(x[own].tobytes() for x in (w, c, t_, start)) for own in np.split(order, first[1:])]
            n = len(names)
            yield pa.record_batch([pa.array(names), pa.array(payload, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=["bucket", "payload", "t", "starts"])

    return run


def _told(t: np.ndarray, start: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows that say which windows of which texts repeat."""
    if len(t):
        order = np.lexsort((start, t))
        names, first = np.unique(t[order], return_index=True)
        starts = [x.tobytes() for x in np.split(start[order].astype(np.uint32), first[1:])]
        yield pa.record_batch([pa.array((names % buckets).astype(np.int32)), pa.nulls(len(names), pa.binary()), pa.array(names), pa.array(starts, pa.binary())], names=["bucket", "payload", "t", "starts"])


def _repeated(buckets: int):
    """Over partitions sorted by bucket: the windows found in more than one place."""

    def settle(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        cells = []
        for p in held:
            n = len(p) // 22
            cells.append((np.frombuffer(p, np.uint64, n), np.frombuffer(p, np.uint16, n, 8 * n), np.frombuffer(p, np.int64, n, 10 * n), np.frombuffer(p, np.uint32, n, 18 * n)))
        w, c, t, start = (np.concatenate(x) for x in zip(*cells))
        order = np.lexsort((c, w))
        w, c, t, start = (x[order] for x in (w, c, t, start))
        first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (c[1:] != c[:-1])]))
        place = _place(t, start)
        many = np.minimum.reduceat(place, first) != np.maximum.reduceat(place, first)
        many = np.repeat(many, np.diff(np.append(first, len(w))))
        yield from _told(t[many], start[many], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            told = b.column("payload").is_null()
            yield b.filter(told)
            for bucket, payload in zip(b.column("bucket").to_pylist(), b.column("payload").to_pylist()):
                if payload is None:
                    continue
                if bucket != now and held:
                    yield from settle(held)
                    held = []
                now = bucket
                held.append(payload)
        if held:
            yield from settle(held)

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(t, starts, whole): by hash of the text, the first words of its repeated windows, and if the text itself repeats.

    Any two equal windows choose the same anchor: the first least hash of their runs of ``anchor`` words. Seeds are
    the anchors found in more than one place; they are counted with grouped minima, so no anchor is gathered, and
    marked in a map of fixed size, which may let others through but drops none. Each seed is then extended both ways to all
    windows that hold it as their anchor, and these meet their equals by hash (80 bits). Neighbouring repeated
    windows unite to maximal repeats. A window that repeats within a task is sent once, so a passage
    shared by very many texts makes no large group; texts that are equal as a whole count as one place.
    """
    spark = docs.sparkSession
    if not 0 < anchor < window:
        raise ValueError("an anchor must be shorter than a window")
    keyed = _keyed(docs)
    seeds = keyed.mapInArrow(_anchors(window, anchor), "anchor long, place long").groupBy("anchor").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b")
    slot = F.shiftrightunsigned("anchor", 64 - MAP_BITS)
    marked = seeds.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(anchor, {64 - MAP_BITS}) & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bits[marked.column("word").to_numpy()] = marked.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)
    buckets = BUCKETS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed.mapInArrow(_extended(window, anchor, buckets, shared), "bucket int, payload binary, t long, starts binary")
    told = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeated(buckets), "bucket int, payload binary, t long, starts binary")
    copies = keyed.groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select("t", F.lit(None).cast("binary").alias("starts"), F.lit(True).alias("whole"))
    every = told.select("t", "starts", F.lit(False).alias("whole")).unionByName(copies)
    return every.groupBy("t").agg(F.collect_list("starts").alias("starts"), F.max("whole").alias("whole"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs with ``text`` cut down to the words outside all repeats, joined by one space, and ``n_words``, ``n_removed``.

    A word goes if a window of ``window`` words that holds it starts anywhere else too, in the same text
    or another row; windows are judged on the input. Defined cases: null text has no words; repeated rows are other places, so
    a text of ``window`` words or more in two rows goes whole; doc_id is not read; columns named n_words or
    n_removed are replaced, all others are carried, whatever their names; texts of any length are read whole; an empty table gives an empty one.
    """
    docs = without(docs, "n_words", "n_removed").withColumn("text", F.col("text").cast("string"))
    names = docs.columns
    at = names.index("text")
    t_, starts_, whole_ = unused(docs, "t", "starts", "whole")
    found = stored(repeated_windows(docs, window, anchor)).select(F.col("t").alias(t_), F.col("starts").alias(starts_), F.col("whole").alias(whole_))
    joined = docs.join(found, F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(t_), "left").drop(t_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n_words, n_removed = [], [], []
            for text, starts, whole in zip(texts(b.column("text")), b.column(starts_).to_pylist(), b.column(whole_).to_pylist()):
                words = text.encode().split()
                n = len(words)
                gone = np.zeros(n, bool)
                if n >= window and whole:
                    gone[:] = True
                elif starts:
                    step = np.zeros(n + 1, np.int64)
                    s = np.unique(np.frombuffer(b"".join(starts), np.uint32)).astype(np.int64)
                    step[s] += 1
                    np.add.at(step, s + window, -1)
                    gone = np.cumsum(step)[:n] > 0
                n_words.append(n)
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(words if not gone.any() else [w for w, g in zip(words, gone.tolist()) if not g]).decode())
            columns = [b.column(c) for c in names]
            columns[at] = pa.array(kept, pa.string())
            yield pa.record_batch([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*names, "n_words", "n_removed"])

    return mapped(joined, run, docs.withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema)
