"""Periodic runs against brute force over all periods."""

import random
import re
import zlib

import pytest

from wardloom.llm.entries import made_periodic
from wardloom.llm.word_runs import collapse_runs, shared_words, word_runs


def brute(w, least, times):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                found.setdefault((start, i - start + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def odd_sentence(rng, letters):
    out = []
    while len(out) < rng.randrange(160):
        block = [rng.randrange(letters) for _ in range(rng.randrange(1, 14))]
        out += block * rng.randrange(1, 9) + block[: rng.randrange(len(block) + 1)]
    return out


@pytest.mark.parametrize("least, times", [(24, 3), (10, 2), (5, 2), (6, 3)])
def test_runs(least, times):
    rng = random.Random(least)
    for _ in range(120):
        sentences = [odd_sentence(rng, rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(1, 5))]
        assert word_runs(sentences, least, times) == [brute(s, least, times) for s in sentences]


def test_least_shared_words():
    assert shared_words(24, 3) == 16
    assert word_runs([]) == [] and word_runs([[], [1]]) == [[], []]


def test_very_long_texts():
    n = 60_000
    assert word_runs([[7] * n, [i % 2 for i in range(n)], list(range(n)), [bin(i).count("1") % 2 for i in range(n)]]) == [[(0, n, 1)], [(0, n, 2)], [], []]


def test_texts(spark):
    block = "a b c d e f g h i"
    texts = [None, "", " \t\n", "x", f"no {' '.join([block] * 4)} a b end", "é " * 30, "\x1f \x1f " * 12, "x\x1fy z " * 12]
    schema = "doc_id long, text string, runs string, lang string"
    rows = spark.createDataFrame([(i, t, "mine", "l") for i, t in enumerate(texts)] + [(None, texts[4], None, None), (4, texts[4], "mine", "l")], schema)
    got = [(r["doc_id"], r["text"], [tuple(x) for x in r["runs"]], r["lang"]) for r in collapse_runs(rows).collect()]
    once = (f"no {block} end", [(1, 38, 9)])
    want = [("", []), ("", []), ("", []), ("x", []), once, ("é", [(0, 30, 1)]), ("\x1f", [(0, 24, 1)]), ("x\x1fy z", [(0, 24, 2)])]
    assert sorted(got, key=str) == sorted([(i, *w, "l") for i, w in enumerate(want)] + [(None, *once, None), (4, *once, "l")], key=str)
    assert collapse_runs(rows.limit(0)).count() == 0


def test_made_periodic(spark):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice("abc") for _ in range(rng.randrange(90))) + rng.choice(["", "\n", " \t"]) for i in range(400)} | {-7: "a b", None: "a b"}
    rows = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    changed = 0
    for r in rows.select("doc_id", made_periodic("doc_id", "text").alias("text")).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])
        h = zlib.crc32(str(r["doc_id"]).encode()) if r["doc_id"] is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        assert re.findall(r"[^\x20\x09-\x0D]+", r["text"]) == w
    assert changed > 20
