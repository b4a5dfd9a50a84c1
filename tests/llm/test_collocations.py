"""Collocations against counts of all phrases in one place."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wardloom.llm.collocations import Known, _hashes, _word_hashes, collocations, phrase_counts, pieces, stripes

SCHEMA = "doc_id long, text string, lang string, prefix string, n long"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def counts(rows, longest):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return n, f


def brute(rows, longest, least, top, subsumed=100):
    n, f = counts(rows, longest)
    out = []
    for lang, of in f.items():
        found = []
        said = {p: a for p, a in of.items() if a >= least}
        for p, a in said.items():
            longer = [b for q, b in said.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if len(p) > 1 and not any(100 * b >= subsumed * a for b in longer):
                score, k = min((1000 * a * n[lang] // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed, docs=120):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "é", "ß", "new", "york", "\x1f", "a-b", *(f"w{i}" for i in range(30))]
    out = [(None, "en"), ("", "en"), ("the the the the the the the", "de"), ("x" * 5000, None), ("of the " * 2000, None)]
    for _ in range(docs):
        text = "".join(rng.choice(vocab[: rng.choice([7, 39])]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "!"]) for _ in range(rng.randrange(60)))
        out.append((text, rng.choice(["en", "en", "de", None])))
    return out + out[5:9]


@pytest.mark.parametrize("longest, least, top, subsumed", [(5, 3, 2000, 100), (5, 2, 7, 100), (3, 4, 50, 60), (2, 1, 10, 100)])
def test_collocations(spark, longest, least, top, subsumed):
    rows = corpus(least)
    table = spark.createDataFrame([(None, t, g, "mine", 5) for t, g in rows], SCHEMA).repartition(5)
    got = collocations(table, longest, least, top, subsumed).collect()
    assert sorted(map(tuple, got)) == brute(rows, longest, least, top, subsumed)


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations(empty).count() == 0
    assert collocations(spark.createDataFrame([(1, "one two", "en", "", 1)], SCHEMA)).count() == 0


def test_levels(spark):
    rows = corpus(9)
    totals, levels = phrase_counts(spark.createDataFrame([(None, t, g, None, None) for t, g in rows], SCHEMA), 4, 3)
    n, f = counts(rows, 4)
    assert {r["lang"]: r["n"] for r in totals.collect()} == {g: x for g, x in n.items() if x}
    for k, level in enumerate(levels):
        got = {(r["lang"], *r["prefix"].split(" ")[: None if k else 0], r["next"]): r["n"] for r in level.collect()}
        assert got == {(g, *p): a for g, of in f.items() for p, a in of.items() if len(p) == k + 1 and a >= 3}


class Bits:
    value = bytes([255]) * 512


def test_stripes_of_hot_prefixes():
    """Each entry comes once for each of its counts; a hot prefix is dealt over the shards by its next words; parts end where pieces do."""
    text = "a b a c a b, a d. A b\ta e " * 9
    for hot in (False, True):
        h = _hashes(xxhash.xxh3_64_intdigest(b"en"), [_word_hashes([b"a"])])
        got, shards = Counter(), set()
        for part in pieces(text.encode(), 20):
            for r in stripes("en", part, Known(1, Bits(), h if hot else h[:0]), 16).to_pylist():
                got.update({(r["prefix"], x): n for x, n in zip(r["next"], r["n"])})
                shards |= {(r["prefix"], r["shard"])}
        want = counts([(text, "en")], 2)[1]["en"]
        assert got == {p: a for p, a in want.items() if len(p) == 2}
        assert (len({s for p, s in shards if p == "a"}) > 1) == hot
    assert b"\n".join(pieces(b"A.b" * 50, 7)) == b"a\nb" * 50


def test_scores_beyond_64_bits(spark):
    expr = "cast(cast(1000 * a as decimal(21,0)) * cast(n as decimal(18,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)"
    rng = np.random.default_rng(1)
    rows = [(int(a), int(n), int(a * 7), int(a * 3)) for a, n in zip(rng.integers(100, 10**12, 50), rng.integers(10**15, 10**17, 50))]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select(F.expr(expr), "a", "n", "l", "r").collect()
    assert all(x == 1000 * a * n // (le * r) for x, a, n, le, r in map(tuple, got))
