"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.common import mapped, stored, texts, without

# Common insults, of English and of other languages; each list is read by labellers of its own.
INSULTS = frozenset("idiot moron stupid worthless pathetic trash loser clown disgusting scum dumb imbecile fool garbage filthy vermin jerk".split())
INSULTS_ELSEWHERE = frozenset(
    "connard connasse salaud salope abruti imbécile crétin enfoiré ordure débile "
    "arschloch dummkopf trottel schwachkopf depp abschaum schlampe hurensohn vollidiot mistkerl "
    "estúpido imbécil gilipollas cabrón pendejo idiota basura tarado mierda malnacido "
    "stronzo bastardo coglione deficiente cretino otário babaca vagabundo canalha desgraçado".split()
)
MARKS = "#$%&*|<>{}\\^~"
#: Words of a window whose distinct share is taken.
SPAN = 50
#: Documents that a scorer is fitted on at most, rounds of expectation-maximisation, epochs and rate of the
#: scorer, and the standard errors by which a hash's share must differ between the classes for it to be used.
FIT_DOCS, EM_ROUNDS, EPOCHS, RATE, TELLING = 12_000, 60, 400, 0.5, 4.0
#: A text counts in the fit as often as it occurs, but not more often than this, or one text would be all that is learned.
COPIES = 100
#: Rows' worth of belief, as a share of all rows, that a labeller's vote is right, and how often it is believed wrong.
PRIOR, WRONG = 0.02, 0.02
#: Of the toxic scorer: what the posteriors of all rows without a label weigh together in its first fit, in labelled rows;
#: rounds that then renew them by the scorer, whose words go beyond the lexicon; and what one of them weighs in these.
START, ROUNDS, WEIGHT = 3.0, 2, 0.3
WORD_BITS, SHAPE_BITS, WORDS_KEPT = 20, 14, 200_000
EDGES = {"marks": (0.002, 0.01, 0.02, 0.04, 0.08), "caps": (0.02, 0.1, 0.3, 0.5, 0.8), "bars": (0.01, 0.05, 0.1, 0.2, 0.4), "distinct": (0.1, 0.3, 0.45, 0.6, 0.75, 0.9), "stutter": (0.01, 0.05, 0.15, 0.3, 0.5), "length": (1, 3, 10, 50, 500)}
#: Score from which a text is toxic, picked for recall on held-out labels; README gives recall and false positives.
TOXIC = 0.3
TASKS = ("quality", "toxic")
RARE = {"quality": 0, "toxic": 1}


def measures(words: list[str], text: str) -> dict[str, float]:
    """Shares that the labellers read, over the whole text."""
    n = max(1, len(words))
    spans = [words[i : i + SPAN] for i in range(0, len(words), SPAN)]
    spans = [s for s in spans if len(s) >= 12]
    return {
        "marks": sum(map(text.count, MARKS)) / max(1, len(text)),
        "caps": sum(map(str.isupper, words)) / n,
        "bars": words.count("|") / n,
        "distinct": float(np.mean([len(set(s)) / len(s) for s in spans])) if spans else 1.0,
        "stutter": sum(map(eq, words, words[1:])) / n,
        "length": float(len(words)),
    }


def votes(m: dict[str, float], found: int, elsewhere: int = 0) -> dict[str, tuple[int, ...]]:
    """Votes of each task's labellers: 0 or 1 for a class, 2 for none. A defect's labeller votes against or not at all."""
    few = m["length"] < 5
    defects = (m["marks"] >= 0.02, not few and m["caps"] >= 0.5, m["bars"] >= 0.15, m["length"] >= 12 and m["distinct"] <= 0.5, not few and m["stutter"] >= 0.2)
    sound = m["marks"] < 0.01 and (few or m["caps"] < 0.2) and m["bars"] < 0.05 and m["distinct"] > 0.55 and m["stutter"] < 0.1
    return {
        "quality": (*[0 if d else 2 for d in defects], 1 if sound else 2, 1 if sound and m["length"] >= 20 else 2),
        "toxic": (1 if found else 2, 1 if found >= 2 else 2, 1 if found > 0.02 * m["length"] else 2, 1 if elsewhere else 2, 1 if elsewhere > 0.02 * m["length"] else 2, 2 if found or elsewhere else 0),
    }


class _Words(dict):
    """(hash of a word's letters or -1, hash of its outline), for a bounded number of words.

    The outline has runs of upper and lower case and of digits as one sign each, other characters as they are.
    """

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        if word.isalpha():
            core, outline = word.lower(), "a" if word.islower() else "A" if word.isupper() else "Aa"
        else:
            core = re.sub(r"[\W\d_]+", "", word.lower())
            outline = re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", lambda g: "A" if g[0].isupper() else "a" if g[0].islower() else "Aa", word))[:12]
        value = self[word] = (xxhash.xxh64_intdigest(core) & ((1 << WORD_BITS) - 1) if core else -1, _bucket(outline))
        return value


@lru_cache(maxsize=100_000)
def _bucket(name: str) -> int:
    return xxhash.xxh64_intdigest(name) & ((1 << SHAPE_BITS) - 1)


def _word_of(names: frozenset[str]) -> re.Pattern:
    return re.compile(rf"(?<![^\W\d_])(?:{'|'.join(sorted(names))})(?![^\W\d_])")


INSULT, INSULT_ELSEWHERE = _word_of(INSULTS), _word_of(INSULTS_ELSEWHERE)


def insults(text: str) -> tuple[int, int]:
    """Whole words of the two lists of insults."""
    low = text.lower()
    return tuple(len(found.findall(low)) if any(map(low.__contains__, names)) else 0 for names, found in ((INSULTS, INSULT), (INSULTS_ELSEWHERE, INSULT_ELSEWHERE)))


@dataclass(frozen=True)
class Features:
    words: np.ndarray
    shapes: np.ndarray
    weights: np.ndarray


def features(text: str, known: _Words) -> Features:
    """Hashes of the distinct words, and hashes of outlines and measures with their weights."""
    words = text.split()
    pairs = list(map(known.__getitem__, words))
    own = {p[0] for p in pairs}
    own.discard(-1)
    counted = Counter([p[1] for p in pairs])
    buckets = [_bucket(f"{k}:{bisect_left(EDGES[k], v)}") for k, v in measures(words, text).items()]
    n = max(1, len(words))
    shapes = np.fromiter([*counted, *buckets], np.int64, len(counted) + len(buckets))
    weights = np.concatenate([np.sqrt(np.fromiter(counted.values(), float, len(counted)) / n), np.ones(len(buckets))])
    return Features(np.fromiter(own, np.int64, len(own)), shapes, weights)


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int, float]], rare: int, rounds: int = EM_ROUNDS) -> tuple[dict[tuple[int, ...], float], np.ndarray, float]:
    """Posterior of class 1 for each vote pattern, P(vote | class) of each labeller, and the share of class 1.

    patterns: (votes, known class or -1, count). Rows of a known class keep it. Starts from the votes for the rare class. A labeller that
    does not vote says nothing: defects exclude each other, so their absence must not count for a text.
    """
    v = np.array([p[0] for p in patterns], int)
    known = np.array([p[1] for p in patterns])
    n = np.array([p[2] for p in patterns], float)
    post = np.where(known >= 0, known, np.where((v == rare).any(1), 0.1 + 0.8 * rare, 0.9 - 0.8 * rare))
    for _ in range(rounds):
        share = float(np.clip((n * post).sum() / n.sum(), 1e-4, 1 - 1e-4))
        table = np.zeros((v.shape[1], 2, 3))
        for j in range(v.shape[1]):
            for k in range(3):
                at = v[:, j] == k
                table[j, 1, k], table[j, 0, k] = (n * post)[at].sum() + 0.5, (n * (1 - post))[at].sum() + 0.5
            table[j] += PRIOR * n.sum() * np.array([[1 - WRONG, WRONG, 0], [WRONG, 1 - WRONG, 0]])
            table[j] /= table[j].sum(1, keepdims=True)
        log = np.log(share) - np.log(1 - share) + sum(np.where(v[:, j] < 2, np.log(table[j, 1, v[:, j]] / table[j, 0, v[:, j]]), 0) for j in range(v.shape[1]))
        post = np.where(known >= 0, known, 1 / (1 + np.exp(-np.clip(log, -40, 40))))
    free = 1 / (1 + np.exp(-np.clip(log, -40, 40)))
    return {p[0]: float(x) for p, x in zip(patterns, free)}, table, share


def _telling(rows: list[np.ndarray], target: np.ndarray, copies: np.ndarray, size: int, least: int) -> np.ndarray:
    """If each hash is in ``least`` texts or more, copies counted, and tells the classes apart; rows are counted 2,000 at a time to spare the driver's memory."""
    seen, positive = np.zeros(size), np.zeros(size)
    for i in range(0, len(rows), 2000):
        part = rows[i : i + 2000]
        column, n = np.concatenate(part), [len(r) for r in part]
        seen += np.bincount(column, np.repeat(copies[i : i + 2000], n), minlength=size)
        positive += np.bincount(column, np.repeat((copies * target)[i : i + 2000], n), minlength=size)
    share = (copies * target).sum() / max(1, copies.sum())
    return (seen >= least) & (np.abs(positive - share * seen) >= TELLING * np.sqrt(np.maximum(seen * share * (1 - share), 1e-9)))


def _fit(rows: list[np.ndarray], values: list[np.ndarray] | None, target: np.ndarray, copies: np.ndarray, size: int, least: int, known: np.ndarray | None = None, weight: float = 1.0) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer by full-batch adaptive gradients; hashes of fewer than ``least`` texts, or that tell no class, stay 0.

    Without ``values`` all are 1. A row counts ``copies`` times; rows that are not ``known`` count by ``weight``; a hash may tell the classes apart in all rows or in the known ones.
    """
    telling = _telling(rows, target, copies, size, least)
    mass = copies / copies.sum()
    if known is not None and known.any():
        telling |= _telling([rows[i] for i in np.flatnonzero(known)], target[known], copies[known], size, least)
        mass = copies * np.where(known, 1.0, weight)
        mass /= mass.sum()
    kept = [telling[r] for r in rows]
    column = np.concatenate([r[k] for r, k in zip(rows, kept)])
    value = np.ones(len(column)) if values is None else np.concatenate([v[k] for v, k in zip(values, kept)])
    row = np.repeat(np.arange(len(rows)), [int(k.sum()) for k in kept])
    del kept
    names, column = np.unique(column, return_inverse=True)
    w, b = np.zeros(len(names)), 0.0
    gw, gb = np.full(len(names), 1e-6), 1e-6
    for _ in range(EPOCHS):
        z = np.bincount(row, w[column] * value, minlength=len(rows)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * mass
        g = np.bincount(column, d[row] * value, minlength=len(names)) + 1e-6 * w
        gw += g * g
        gb += d.sum() ** 2
        w -= RATE * g / np.sqrt(gw)
        b -= RATE * d.sum() / np.sqrt(gb)
    out = np.zeros(size + 1, np.float32)
    out[names], out[-1] = w, b
    return out


def _fit_toxic(rows: list[np.ndarray], target: np.ndarray, copies: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The toxic scorer on labels and posteriors, in one way for any number of either.

    That the lexicon finds no insult says little of a text in another language. So the posteriors weigh little at first, and are
    then the larger of the votes' and the scorer's own.
    """
    free = np.flatnonzero(~known)
    model = _fit(rows, None, target, copies, 1 << WORD_BITS, 3, known, min(1.0, START / max(1.0, float(copies[free].sum()))))
    for _ in range(ROUNDS if len(free) else 0):
        renewed = target.copy()
        score = np.array([model[rows[i]].sum() + model[-1] for i in free])
        renewed[free] = np.maximum(target[free], 1 / (1 + np.exp(-np.clip(score, -30, 30))))
        model = _fit(rows, None, renewed, copies, 1 << WORD_BITS, 3, known, WEIGHT)
    return model


@dataclass(frozen=True)
class QualityModel:
    """Weights of the scorers of hashed outlines (quality) and hashed words (toxic)."""

    quality: np.ndarray
    toxic: np.ndarray


def fit_quality(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> QualityModel:
    """Fits the model on docs(doc_id, text) and labels(doc_id, quality, toxic), which may be few or none.

    The labellers vote on every document; only the counts of vote patterns, of which there are a fixed number at
    most, come to the driver. Expectation-maximisation over all of them estimates each labeller's accuracies,
    labelled rows keeping their label. The scorers are then fitted on the labels and posteriors of about
    fit_docs distinct labelled texts and fit_docs others at most, taken by a hash of the text; a text in any number of copies is one of
    them, once for each labelling that it has, and weighs as COPIES at most. Defined cases: null and empty texts and labels of a null doc_id are left out; of
    several labels of a doc_id the smallest counts; repeated rows vote again but are fitted on once; texts are read whole; an empty table of
    documents gives a model that keeps nothing for certain (all scores 0.5), one of labels leaves the posteriors alone; other columns are not read.
    """
    gold = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.min(t).cast("int").alias(f"gold_{t}") for t in TASKS])
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("ord")).where("text is not null and text <> ''")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [votes(measures(x.split(), x), *insults(x)) for x in texts(b.column("text"))]
            packed = ["".join(map(str, f["quality"])) + "," + "".join(map(str, f["toxic"])) for f in found]
            yield pa.record_batch([b.column("doc_id"), b.column("ord"), pa.array(packed, pa.string())], names=["doc_id", "ord", "votes"])

    voted = stored(rows.mapInArrow(vote, "doc_id long, ord long, votes string").join(gold, "doc_id", "left"))
    counts = voted.groupBy("votes", *[f"gold_{t}" for t in TASKS]).agg(F.count("*").alias("n")).collect()
    if not counts:
        return QualityModel(np.zeros((1 << SHAPE_BITS) + 1, np.float32), np.zeros((1 << WORD_BITS) + 1, np.float32))
    posterior = {}
    for i, task in enumerate(TASKS):
        grouped: dict[tuple[tuple[int, ...], int], float] = {}
        for r in counts:
            key = (tuple(map(int, r["votes"].split(",")[i])), -1 if r[f"gold_{task}"] is None else r[f"gold_{task}"])
            grouped[key] = grouped.get(key, 0) + r["n"]
        posterior[task] = expectation_maximisation([(*k, n) for k, n in grouped.items()], RARE[task])[0]

    labelled = F.col("gold_quality").isNotNull() | F.col("gold_toxic").isNotNull()
    sizes = {bool(r["l"]): r["n"] for r in voted.groupBy(labelled.alias("l")).agg(F.approx_count_distinct("ord", 0.02).alias("n")).collect()}
    step = {l: max(1, n // fit_docs) for l, n in sizes.items()}
    share = F.when(labelled, step.get(True, 1)).otherwise(step.get(False, 1))
    kinds = ["ord", "votes", *[f"gold_{t}" for t in TASKS]]
    # about fit_docs texts of each sort in at most nine labellings: small enough to broadcast, so that no text is shuffled
    chosen = stored(voted.where(F.pmod(F.xxhash64("ord"), share) == 0).groupBy(*kinds).agg(F.min("doc_id").alias("doc_id"), F.least(F.count("*"), F.lit(COPIES)).cast("int").alias("copies")).where("doc_id is not null"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for b in batches:
            found = [features(x, memo) for x in texts(b.column("text"))]
            cells = [[f.words.astype("<i4").tobytes() for f in found], [f.shapes.astype("<i4").tobytes() for f in found], [f.weights.astype("<f4").tobytes() for f in found]]
            yield pa.record_batch([*[b.column(c) for c in carried], *[pa.array(c, pa.binary()) for c in cells]], names=[*carried, "words", "shapes", "weights"])

    carried = [*kinds, "copies"]
    picked = rows.join(F.broadcast(chosen), ["doc_id", "ord"]).select("text", *carried)
    picked = picked.mapInArrow(featured, "ord long, votes string, gold_quality int, gold_toxic int, copies int, words binary, shapes binary, weights binary")
    table = picked.dropDuplicates(kinds).drop("ord").toArrow().combine_chunks()

    def parts(name: str, kind: str) -> list[np.ndarray]:
        """The cells of a binary column, read where they lie."""
        out = []
        for chunk in table.column(name).chunks:
            ends = np.frombuffer(chunk.buffers()[1], "<i4", len(chunk) + 1, 4 * chunk.offset) // 4
            data = np.frombuffer(chunk.buffers()[2] or b"", kind)
            out += [data[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return out

    targets = {}
    for i, task in enumerate(TASKS):
        guess = [posterior[task].get(tuple(map(int, v.split(",")[i])), 0.5) for v in table.column("votes").to_pylist()]
        targets[task] = np.array([p if g is None else g for p, g in zip(guess, table.column(f"gold_{task}").to_pylist())], float)
    word_rows, shape_rows = parts("words", "<i4"), parts("shapes", "<i4")
    copies = table.column("copies").to_numpy().astype(float)
    toxic = _fit_toxic(word_rows, targets["toxic"], copies, table.column("gold_toxic").is_valid().to_numpy())
    quality = _fit(shape_rows, parts("weights", "<f4"), targets["quality"], copies, 1 << SHAPE_BITS, 3)
    return QualityModel(quality, toxic)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with ``quality_score``, ``toxic_score`` (0 to 1) and ``keep``: quality of 0.5 or more, toxic under TOXIC.

    Defined cases: null or empty text is not kept (quality 0, toxic 0); texts are read whole; a score follows from the text alone, so repeated rows
    repeat theirs; a score at a threshold counts as reaching it; rows and columns, repeated or null, are
    carried; columns of docs with the names of the new ones are replaced; an empty table gives an empty one.
    """
    docs = without(docs, "quality_score", "toxic_score", "keep").withColumn("text", F.col("text").cast("string"))
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((model.quality, model.toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quality, toxic = shared.value
        memo = _Words()
        for b in batches:
            q, t = [], []
            for text in texts(b.column("text")):
                if not text:
                    q.append(0.0), t.append(0.0)
                    continue
                f = features(text, memo)
                q.append(float(1 / (1 + np.exp(-np.clip(quality[f.shapes] @ f.weights + quality[-1], -30, 30)))))
                t.append(float(1 / (1 + np.exp(-np.clip(toxic[f.words].sum() + toxic[-1], -30, 30)))))
            yield pa.record_batch([*b.columns, pa.array(q), pa.array(t), pa.array([a >= 0.5 and c < TOXIC for a, c in zip(q, t)])], names=[*names, "quality_score", "toxic_score", "keep"])

    return mapped(docs, run, docs.withColumns({"quality_score": F.lit(0.0), "toxic_score": F.lit(0.0), "keep": F.lit(True)}).schema)
