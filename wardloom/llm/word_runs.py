"""Periodic runs of words: suffix classes united by decreasing common prefix, and texts with each run cut to one period."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.common import mapped, texts, without

#: Words of a run at least, and periods of a run at least.
LEAST, TIMES = 24, 3
#: Words handled at a time; one text is never split.
WORDS = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUNS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Run = tuple[int, int, int]


def shared_words(least: int, times: int) -> int:
    """The fewest words that the suffixes at a run's first word and one period later share."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def _repeated_grams(ids: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the documents that hold some ``width`` words twice. Hashes decide, so others may be among them; none is missed."""
    h, done = (ids.astype(np.uint64) + np.uint64(1)) * MIX, 1
    while done < width:
        step = min(done, width - done)
        h = h[:-step] * MIX + (h[step:] ^ (h[step:] >> np.uint64(31)))
        done += step
        if not len(h):
            return np.zeros(0, np.int64)
    first = doc[: len(h)]
    inside = first == doc[width - 1 :]
    first = first[inside]
    keys = h[inside] ^ (first.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(keys)
    keys, first = keys[order], first[order]
    return np.unique(first[1:][(keys[1:] == keys[:-1]) & (first[1:] == first[:-1])])


def _suffixes(ids: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, each ending with its document, and how many words each shares with the one before. By doubling; the ranks of each width are kept for the second."""
    n, ranks = len(ids), []
    rank = np.unique(doc.astype(np.int64) << 32 | ids, return_inverse=True)[1]
    places, width = np.arange(n), 1
    while True:
        ranks.append(rank.astype(np.int32))
        if rank.max() == n - 1:
            break
        after = np.minimum(places + width, n - 1)
        key = rank * (n + 1) + np.where(places + width < end, rank[after] + 1, 0)
        rank = np.unique(key, return_inverse=True)[1]
        width *= 2
    order = np.argsort(rank)
    a, b = order[:-1], order[1:]
    shared = np.zeros(n - 1, np.int64)
    same = doc[a] == doc[b]
    for level in range(len(ranks) - 1, -1, -1):
        r, x, y = ranks[level], a + shared, b + shared
        equal = same & (x < end[a]) & (y < end[b])
        equal &= r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)]
        shared[equal] += 1 << level
    return order, shared


def _seeds(order: np.ndarray, shared: np.ndarray, least: int, times: int) -> Iterator[Run]:
    """(first place, distance, shared words) of suffixes that become neighbours when their classes are united, in decreasing order of what they share.

    A class is the sorted places of one union-find tree. The lesser class goes into the greater, so each place moves a logarithmic number of times. Of two places of one class all the words between
    them and the words they share from there on repeat with their distance; the first place of a run and the one a period on are neighbours at just the
    moment when the shared words of both are reached, since a place between them would give the run a smaller period.
    """
    use = np.nonzero(shared >= shared_words(least, times))[0]
    use = use[np.argsort(-shared[use], kind="stable")]
    parent: dict[int, int] = {}
    places: dict[int, list[int]] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for a, b, long in zip(order[use].tolist(), order[use + 1].tolist(), shared[use].tolist()):
        a, b = root(a), root(b)
        great, small = places.pop(a, None) or [a], places.pop(b, None) or [b]
        if len(great) < len(small):
            a, b, great, small = b, a, small, great
        before = -1
        for i, x in enumerate(small):
            k = bisect_left(great, x)
            if k and (low := great[k - 1]) > before:
                gap = x - low
                if long >= least - gap and long >= (times - 1) * gap:
                    yield low, gap, long
            if k < len(great) and (i + 1 == len(small) or great[k] < small[i + 1]):
                gap = great[k] - x
                if long >= least - gap and long >= (times - 1) * gap:
                    yield x, gap, long
            before = x
        if len(small) < 16:
            for x in small:
                insort(great, x)
        else:
            great = sorted(great + small)
        parent[b] = a
        places[a] = great


def word_runs(sentences: list[list[int]], least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """(start, length, period) of all runs of each list of word numbers, by start, then period.

    Only lists that hold as many words twice as any run must share with itself are sorted and united.
    """
    found: list[list[Run]] = [[] for _ in sentences]
    sizes = np.array([len(s) for s in sentences], np.int64)
    ids, doc = np.fromiter((x for s in sentences for x in s), np.int64, int(sizes.sum())), np.repeat(np.arange(len(sizes)), sizes)
    some = np.isin(doc, _repeated_grams(ids, doc, shared_words(least, times)))
    if not some.any():
        return found
    ids, doc = ids[some], doc[some]
    begin = np.searchsorted(doc, np.arange(len(sizes)))
    end = np.searchsorted(doc, doc, side="right")
    words, of = ids.tolist(), doc.tolist()
    for start, period, long in _seeds(*_suffixes(ids, doc, end), least, times):
        at = int(begin[of[start]])
        if start == at or words[start - 1] != words[start - 1 + period]:
            found[of[start]].append((start - at, long + period, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds after its first period, with spaces between them."""
    if not runs:
        return b" ".join(words)
    kept = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        kept[start + period : start + length] = bytes(length - period)
    return b" ".join([w for w, k in zip(words, kept) if k])


def collapse_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with ``runs``, all (start, length, period) by start, then period, and ``text`` without the words that a run holds after its first period.

    Words are what white space (space and \\x09-\\x0D) parts, numbered from 0. A run is a stretch of words with the smallest period q, of ``least`` words and ``times`` periods
    or more, which no neighbouring word extends. One pass over each text, no shuffle. Defined cases: a null or empty text, or one without words, has no runs and becomes the
    empty text; very long texts are taken whole; equal lengths and periods are separate runs by their starts; repeated rows, null ids and other columns are carried; columns
    named ``runs`` are replaced; an empty table gives an empty one.
    """
    docs = without(docs, "runs")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            said = [x.encode().split() for x in texts(whole.column(at))]
            begin = 0
            while begin < len(said):
                stop, total = begin, 0
                while stop < len(said) and (stop == begin or total + len(said[stop]) <= WORDS):
                    total += len(said[stop])
                    stop += 1
                number = defaultdict(count().__next__)
                runs = word_runs([list(map(number.__getitem__, s)) for s in said[begin:stop]], least, times)
                text = pa.array([collapsed(*x) for x in zip(said[begin:stop], runs)], pa.binary()).cast(pa.string())
                columns = whole.slice(begin, stop - begin).columns
                columns[at] = text
                yield pa.RecordBatch.from_arrays([*columns, pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs], RUNS_TYPE)], names=[*names, "runs"])
                begin = stop

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return mapped(docs, run, docs.withColumn("runs", F.lit(None).cast(RUNS)).schema)
