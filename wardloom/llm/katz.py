"""Katz backoff language model over words, kept in partitioned tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from wardloom.llm.common import drop_stored, stored, texts, unused, without

#: Counts up to TOP are discounted by Good-Turing; larger ones by as much as TOP is.
TOP = 5
#: Texts and words of a bundle at most, buckets of the table at least, and the share of a bundle (over buckets) from which a word is spread.
BUNDLE_TEXTS, BUNDLE_WORDS, BUCKETS, HOT = 4096, 1_000_000, 64, 8
END, BEGIN = np.uint64(1), np.uint64(2)
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
WORDS_KEPT = 200_000
#: Bits of a bundle's number within its input partition, and so 26 for the partition's, beside the 13 of a text in its bundle.
BUNDLE_BITS = 24


class _Hashes(dict):
    """64-bit hashes of words, for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) | 4  # 1 and 2 are taken
        return value


def _keyed(docs: DataFrame, train: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("t"), text.alias("text"), F.coalesce(train, F.lit(False)).alias("train"))


@dataclass(frozen=True)
class _Bundle:
    """Some texts, each once: hashes, training copies, token counts, and for each token its text, word and the word before."""

    t: np.ndarray
    copies: np.ndarray
    lengths: np.ndarray
    text: np.ndarray
    word: np.ndarray
    before: np.ndarray


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[_Bundle]:
    get = _Hashes().__getitem__

    def made(rows: list[tuple[int, bool, np.ndarray]]) -> _Bundle:
        t, first, where = np.unique(np.array([r[0] for r in rows]), return_index=True, return_inverse=True)
        copies = np.bincount(where, [r[1] for r in rows]).astype(np.uint32)
        words = [rows[i][2] for i in first]
        lengths = np.array([len(w) for w in words])
        word = np.concatenate(words)
        before = np.concatenate([[BEGIN], word[:-1]])
        before[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = BEGIN
        return _Bundle(t, copies, lengths, np.repeat(np.arange(len(t)), lengths), word, before)

    held, size = [], 0
    for b in batches:
        for t, text, train in zip(b.column("t").to_pylist(), texts(b.column("text")), b.column("train").to_pylist()):
            w = text.encode().lower().split()
            row = np.empty(len(w) + 1, np.uint64)
            row[:-1] = np.fromiter(map(get, w), np.uint64, len(w))
            row[-1] = END
            held.append((t, train, row))
            size += len(row)
            if len(held) >= BUNDLE_TEXTS or size >= BUNDLE_WORDS:
                yield made(held)
                held, size = [], 0
    if held:
        yield made(held)


def _heavy(buckets: int):
    """(word, n): words that make up much of a bundle and their counts there, and a null word with the bundle's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _bundles(batches):
            word, n = np.unique(b.word, return_counts=True)
            much = n * HOT * buckets > len(b.word)
            yield pa.record_batch([pa.array([None, *word[much].view(np.int64).tolist()], pa.int64()), pa.array([len(b.word), *n[much].tolist()], pa.int64())], names=["word", "n"])

    return run


def _hot_words(keyed: DataFrame, buckets: int) -> np.ndarray:
    """Words that would crowd a bucket: those whose counts in bundles that they fill reach a part of all tokens.

    A word with 1.5 / (HOT * buckets) of the tokens is among them, and there are at most 2 * HOT * buckets of them, since their counts sum to all tokens at most.
    """
    sums = stored(keyed.mapInArrow(_heavy(buckets), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = sums.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r["word"] for r in sums.where("word is not null").where(F.col("n") * (2 * HOT * buckets) >= total).collect()]
    drop_stored(sums)
    return np.array(hot, np.int64).view(np.uint64)


def _bucket(word: np.ndarray, before: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    key = np.where(np.isin(word, hot), word ^ (before * MIX), word) * MIX
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _grams(buckets: int, hot: np.ndarray):
    """(bucket, bundle, payload, head): pairs of words with the texts of the bundle that hold them, and once its texts' t and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, b in enumerate(_bundles(batches)):
            high = np.uint64(0xFFFFFFFF00000000)
            order = np.argsort((b.word & high) | (b.before >> np.uint64(32)), kind="stable")
            word, before, text = b.word[order], b.before[order], b.text[order]
            new_pair = np.concatenate([[True], (word[1:] != word[:-1]) | (before[1:] != before[:-1])])
            new_cell = new_pair | np.concatenate([[True], text[1:] != text[:-1]])
            cell = np.flatnonzero(new_cell)
            count = np.diff(np.append(cell, len(word))).astype(np.uint32)
            pair = np.flatnonzero(new_pair[cell])
            run_length = np.diff(np.append(pair, len(cell))).astype(np.uint32)
            word, before, text, copies = word[cell][pair], before[cell][pair], text[cell].astype(np.uint16), b.copies[text[cell]]
            bucket = _bucket(word, before, hot, buckets)
            by = np.argsort(bucket, kind="stable")
            cells_of = np.repeat(bucket, run_length)
            cells_by = np.argsort(cells_of, kind="stable")
            names, first = np.unique(bucket[by], return_index=True)
            _, first_cell = np.unique(cells_of[cells_by], return_index=True)
            payload = []
            for p, c in zip(np.split(by, first[1:]), np.split(cells_by, first_cell[1:])):
                payload.append(np.array([len(p), len(c)], np.uint32).tobytes() + b"".join(x.tobytes() for x in (word[p], before[p], run_length[p], text[c], count[c], copies[c])))
            if number >> BUNDLE_BITS:
                raise ValueError("a partition has more bundles than a place can name")
            bundle = (part << BUNDLE_BITS) | number
            rows = [(int(n), bundle, p, None) for n, p in zip(names, payload)]
            rows.append((int(bundle % buckets), bundle, None, b.t.tobytes() + b.lengths.astype(np.int64).tobytes()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "bundle", "payload", "head"])

    return run


@dataclass
class _Counted:
    """A bucket of the table: its distinct pairs with training counts, and cells that tell which bundle's texts hold which pair."""

    word: np.ndarray
    before: np.ndarray
    count: np.ndarray  # of the pair in training
    total: np.ndarray  # of the word in training, of the pair's part for a hot word
    pair: np.ndarray  # of each cell
    bundle: np.ndarray
    text: np.ndarray
    n: np.ndarray


def _few(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of long runs, and where each element is in them."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    names, at = np.unique(x[start], return_inverse=True)
    return names, np.repeat(at, np.diff(np.append(start, len(x))))


def _counted(table: pa.Table) -> _Counted:
    kinds = (np.uint64, np.uint64, np.uint32, np.uint16, np.uint32, np.uint32)
    held: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    bundle = [np.zeros(0, np.int64)]
    for name, payload in zip(table.column("bundle").to_pylist(), table.column("payload").to_pylist()):
        p, c = np.frombuffer(payload, np.uint32, 2).tolist()
        at = 8
        for out, kind, size in zip(held, kinds, (p, p, p, c, c, c)):
            out.append(np.frombuffer(payload, kind, size, at))
            at += out[-1].nbytes
        bundle.append(np.full(c, name))
    word, before, runs, text, n, copies = map(np.concatenate, held)
    order = np.argsort((word * MIX) ^ (before * MIX2))  # brings equal pairs together
    new = np.concatenate([[True], (word[order][1:] != word[order][:-1]) | (before[order][1:] != before[order][:-1])]) if len(word) else np.zeros(0, bool)
    number = np.empty(len(word), np.int64)
    number[order] = np.cumsum(new) - 1
    pair = np.repeat(number, runs.astype(np.int64))
    first = order[new]
    count = np.bincount(pair, copies * n.astype(float), minlength=len(first))
    w = word[first]
    _, where = np.unique(w, return_inverse=True)
    total = np.bincount(where, count)[where] if len(w) else count
    return _Counted(w, before[first], count, total, pair, np.concatenate(bundle), text.astype(np.int64), n.astype(float))


@dataclass(frozen=True)
class Discounts:
    """What is left of a count: Good-Turing's (r + 1) n[r+1] / n[r] up to TOP, then as much off as at TOP."""

    kept: np.ndarray  # of counts 0 to TOP

    @staticmethod
    def of(n: np.ndarray) -> Discounts:
        """n: how many types were seen 1, 2 ... TOP + 1 times. Where the ratio isn't between 0 and r, half a count is taken off."""
        kept = [0.0]
        for r in range(1, TOP + 1):
            left = (r + 1) * n[r] / n[r - 1] if n[r - 1] else 0.0
            kept.append(left if 0 < left < r else r - 0.5)
        return Discounts(np.array(kept))

    def __call__(self, count: np.ndarray) -> np.ndarray:
        small = np.minimum(count, TOP).astype(int)
        return np.where(count <= TOP, self.kept[small], count - (TOP - self.kept[TOP]))


@dataclass(frozen=True)
class Katz:
    """The model: the bucketed n-gram table, the backoff table, and what all tokens share."""

    table: str
    backoff: DataFrame | None
    singles: Discounts
    pairs: Discounts
    tokens: int
    types: int
    texts: int
    unknown: float
    hot: dict[int, float]

    def drop(self, spark: SparkSession) -> None:
        """Deletes the model's tables; no plan that reads them can run afterwards."""
        spark.sql(f"drop table if exists {self.table}")
        if self.backoff is not None:
            drop_stored(self.backoff)

    def single(self, count: np.ndarray) -> np.ndarray:
        """P(word) by its training count; all unseen words share what the discounts leave."""
        return np.where(count > 0, self.singles(count) / max(self.tokens, 1), self.unknown)

    def totals(self, c: _Counted) -> np.ndarray:
        if not self.hot:
            return c.total
        names = np.array(sorted(self.hot), np.uint64)
        values = np.array([self.hot[int(x)] for x in names])
        at = np.minimum(np.searchsorted(names, c.word), len(names) - 1)
        return np.where(names[at] == c.word, values[at], c.total)


def _buckets(spark: SparkSession, table: str) -> GroupedData:
    """The table's grams by bucket, as it is stored: no shuffle."""
    return spark.table(table).where("payload is not null").select("bucket", "bundle", "payload").groupBy("bucket")


def fit(docs: DataFrame, train: Column) -> Katz:
    """Learns from the rows of docs(text) for which train holds.

    One pass packs each bundle of texts into pairs of neighbouring words and writes them to a table
    bucketed by the second word; words so frequent that they would crowd a bucket are spread by both
    words (see ``_hot_words``). Later passes read the table bucket by bucket without a shuffle: one
    for counts of counts, one for the discounts and lower-order mass of each context, summed to the
    backoff table. A backoff weight is the mass taken off a context's pairs over the lower-order mass of the words
    not seen after it, so the probabilities after each context, one unknown word included, sum to 1.
    Rows for which train does not hold teach nothing, but can be scored: documents to be scored are among docs. The tables stay until ``drop``.
    Defined cases: a null text is empty; a null train is false; repeated rows count again; texts are read whole; without
    training rows the model knows no word; other columns are not read.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, train)
    buckets = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = _hot_words(keyed, buckets)
    name = f"ngrams_{uuid.uuid4().hex}"
    keyed.mapInArrow(_grams(buckets, hot), "bucket int, bundle long, payload binary, head binary").write.option("compression", "zstd").bucketBy(buckets, "bucket").saveAsTable(name)
    texts_ = int(keyed.where("train").count())

    def counts(table: pa.Table) -> pa.Table:
        c = _counted(table)
        words, at = np.unique(c.word, return_index=True)
        total, spread = c.total[at], np.isin(words, hot)
        plain = total[~spread & (total > 0)]
        of = lambda x: np.bincount(np.minimum(x, TOP + 2).astype(int), minlength=TOP + 3)[1 : TOP + 2]
        single, pair = of(plain), of(c.count[c.count > 0])
        rows = [("single", r + 1, float(v)) for r, v in enumerate(single)] + [("pair", r + 1, float(v)) for r, v in enumerate(pair)]
        rows += [("tokens", 0, float(plain.sum())), ("types", 0, float(len(plain)))]
        rows += [("hot", int(w.view(np.int64)), float(t)) for w, t in zip(words[spread], total[spread])]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.float64()))], names=["what", "at", "n"])

    # at most TOP + 1 counts of each kind and the few hot words come to the driver
    got = {(r["what"], r["at"]): r["n"] for r in _buckets(spark, name).applyInArrow(counts, "what string, at long, n double").groupBy("what", "at").agg(F.sum("n").alias("n")).collect()}
    hot_counts = {int(np.int64(at).view(np.uint64)): n for (what, at), n in got.items() if what == "hot"}
    n1, n2 = (np.array([got.get((what, r), 0.0) for r in range(1, TOP + 2)]) for what in ("single", "pair"))
    for v in hot_counts.values():
        if 0 < v <= TOP + 1:
            n1[int(v) - 1] += 1
    tokens = int(got.get(("tokens", 0), 0) + sum(hot_counts.values()))
    types = int(got.get(("types", 0), 0) + sum(v > 0 for v in hot_counts.values()))
    singles, pairs = Discounts.of(n1), Discounts.of(n2)
    small = n1[:TOP]
    off = float(sum(n * (r - singles.kept[r]) for r, n in enumerate(small, 1)) + (types - small.sum()) * (TOP - singles.kept[TOP]))
    model = Katz(name, None, singles, pairs, tokens, types, texts_, off / tokens if tokens else 1.0, hot_counts)

    def contexts(table: pa.Table) -> pa.Table:
        c = _counted(table)
        own = np.flatnonzero(c.count > 0)
        before, where = np.unique(c.before[own], return_inverse=True)
        off = np.bincount(where, c.count[own] - model.pairs(c.count[own]), minlength=len(before))
        seen = np.bincount(where, model.single(model.totals(c)[own]), minlength=len(before))
        return pa.table({"context": before.view(np.int64), "off": off.astype(float), "seen": seen.astype(float)})  # sums of nothing are integers

    summed = _buckets(spark, name).applyInArrow(contexts, "context long, off double, seen double").groupBy("context").agg(F.sum("off").alias("off"), F.sum("seen").alias("seen"))
    # weight is log10 of the backoff weight times the context's count
    backoff = stored(summed.select("context", F.log10(F.col("off") / F.greatest(1 - F.col("seen"), F.lit(1e-12))).alias("weight")))
    return replace(model, backoff=backoff)


def score(docs: DataFrame, model: Katz, train: Column) -> DataFrame:
    """docs with ``n_tokens``, ``n_known``, ``base_score`` and ``score``: log10 probabilities of the whole text.

    Every text of docs must be among those that the model was fitted on, taught or not: one that is not ends the job with an error, since it has no counts. log10 P(word | context) is log10 of the
    discounted pair count over the context's count, or for an unseen pair the backoff weight and the word's own
    probability; after an unseen context it is the word's own. A text's score is summed in the words' buckets:
    what a pair gives there, less the count of each word as the next one's context; unseen pairs alone are sent on to the
    backoff table. Defined cases: null text is empty and has its end token alone; score and counts follow from the
    text, so repeated rows repeat; texts of any length are read whole; with nothing to learn from, every token is the unknown word; an empty table
    gives an empty one; columns of docs with the names of the new ones are replaced, all others are carried.
    """
    spark = docs.sparkSession
    n_texts = max(model.texts, 1)
    floor = np.log10(model.tokens + model.types + 1)
    model, backoff = replace(model, backoff=None), model.backoff  # a DataFrame can't go to the workers

    def parts(kind: str):
        def run(table: pa.Table) -> pa.Table:
            c = _counted(table)
            total = model.totals(c)
            seen = c.count > 0
            if kind == "unseen":
                cell = np.flatnonzero(~seen[c.pair])
                return pa.table({"context": c.before[c.pair[cell]].view(np.int64), "place": (c.bundle[cell] << 13) | c.text[cell], "n": c.n[cell]})
            with np.errstate(divide="ignore"):
                value = np.where(seen, np.log10(model.pairs(c.count)), np.log10(model.single(total)))
                if model.texts:
                    value -= np.where(c.before == BEGIN, np.log10(n_texts), 0)
                value -= np.where((c.word != END) & (total > 0), np.log10(np.maximum(total, 1)), 0)
            base = np.log10(total + 1) - floor
            bundles, at = _few(c.bundle)
            where = at * 8192 + c.text
            if len(bundles) * 8192 > 8 * len(where) + 100_000:  # else a slot for each text is smaller than a sort
                slots, where = np.unique(where, return_inverse=True)
            else:
                slots = np.arange(len(bundles) * 8192)
            sums = [np.bincount(where, x[c.pair] * c.n, minlength=len(slots)).astype(float) for x in (value, base, (total > 0).astype(float))]
            full = np.bincount(where, minlength=len(slots)) > 0
            slots, sums = slots[full], [x[full] for x in sums]
            place = (bundles[slots >> 13] << 13) | (slots & 8191)
            bundle = place >> 13
            names, first = np.unique(bundle, return_index=True)
            cells = [(place & 8191).astype(np.uint16), sums[0], sums[1], sums[2].astype(np.uint32)]
            packed = [b"".join(x.tobytes() for x in p) for p in zip(*(np.split(x, first[1:]) for x in cells))]
            return pa.table({"bundle": names, "packed": pa.array(packed, pa.binary()), "head": pa.nulls(len(names), pa.binary())})

        return run

    def settle(table: pa.Table) -> pa.Table:
        head = next((h for h in table.column("head").to_pylist() if h is not None))
        n = len(head) // 16
        t, lengths = np.frombuffer(head, np.int64, n), np.frombuffer(head, np.int64, n, 8 * n)
        sums = np.zeros((3, n))
        for p in table.column("packed").to_pylist():
            if p is not None:
                k = len(p) // 22
                at = np.frombuffer(p, np.uint16, k)
                for row, kind, size, start in zip(sums, (np.float64, np.float64, np.uint32), (8, 8, 4), (2, 10, 18)):
                    row[at] += np.frombuffer(p, kind, k, start * k)
        return pa.table({"t": t, "place": (table.column("bundle")[0].as_py() << 13) | np.arange(n), "n_tokens": lengths, "score": sums[0], "base_score": sums[1], "n_known": sums[2].astype(np.int64)})

    sums = _buckets(spark, model.table).applyInArrow(parts("sums"), "bundle long, packed binary, head binary")
    heads = spark.table(model.table).where("head is not null").select("bundle", F.lit(None).cast("binary").alias("packed"), "head")
    own = sums.unionByName(heads).groupBy("bundle").applyInArrow(settle, "t long, place long, n_tokens long, score double, base_score double, n_known long")
    unseen = _buckets(spark, model.table).applyInArrow(parts("unseen"), "context long, place long, n double")
    more = unseen.join(backoff, "context").groupBy("place").agg(F.sum(F.col("n") * F.col("weight")).alias("more"))
    docs = without(docs, "n_tokens", "n_known", "base_score", "score")
    t, key = unused(docs, "t", "key")
    scores = own.join(more, "place", "left").select(F.col("t").alias(t), "n_tokens", "n_known", "base_score", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
    scores = scores.groupBy(t).agg(*[F.min(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    # each text has one row of scores, so that copies of one text, however many, only repeat its key on one side
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    unknown = F.raise_error(F.lit("a text to be scored was not among those that the model was fitted on; give it to fit with train false"))
    return keyed.join(scores, F.col(key) == F.col(t), "left").withColumns({c: F.coalesce(c, unknown) for c in ("n_tokens", "n_known", "base_score", "score")}).drop(key, t)
