"""Quality rules against counts one text at a time, and what each rule of the lines says."""

import random
import re

import pytest

from wardloom.llm.line_quality import clean_lines

SPACE = " \t\n\x0b\x0c\r"
GOOD = "The council met on Monday and agreed to repair the old bridge over the river."


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_base(spark):
    rng = random.Random(2)
    parts = ["a", "b", "c", "é", "🙂", "x|", "#", "*", "word", "\x1f"]
    gaps = [" ", " ", " ", "\n", "\n", "  ", "\t", "\r\n", "\x0b"]
    texts = [None, "", " \n\t\n", "a a a a a a a a a a a a", GOOD, " ".join(["one two three four five six seven"] * 3000)]
    texts += ["".join(rng.choice(parts[: rng.choice([2, 4, 10])]) + rng.choice(gaps) for _ in range(rng.randrange(70))) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in clean_lines(rows).collect():
        assert tuple(r[n] for n in names) == base(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


@pytest.mark.parametrize(
    "line, rule",
    [
        (GOOD, None),
        ("", None),
        ("Home | News | Sport | Weather", "navigation"),
        ("Home › News › Sport › Weather", "navigation"),
        ("Read more.", "navigation"),
        ("ANMELDEN", "navigation"),
        ("She said read more books and you will see.", None),
        ("Licensed under the Apache License, Version 2.0.", "boilerplate"),
        ("Diese Seite verwendet Cookies, um Ihnen zu helfen.", "boilerplate"),
        ("WIN!! BIG!! PRIZES!! TODAY!!", "punctuation"),
        ("abc*** def### ghi&&& jkl$$$", "punctuation"),
        ("Chapter one", "punctuation"),
        ("Yes, it is.", None),
        ("No! Not that one, she said; the other | one & only.", None),
        ("a well-known state-of-the-art device, it seems to me", None),
        (f"{GOOD} It uses cookies. {GOOD} {GOOD}", None),
    ],
)
def test_rule_of_a_line(spark, line, rule):
    text = f"{GOOD}\n{line}\nIt rained again on the way to the town, and nobody had brought an umbrella."
    r = clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert {k: r[f"n_{k}"] for k in ("navigation", "boilerplate", "punctuation")} == {k: int(k == rule) for k in ("navigation", "boilerplate", "punctuation")}
    assert r["text"] == (text if rule is None else text.replace(f"\n{line}", "")) and (r["kept"] or r["base_failed"])


def test_documents_that_lose_too_much(spark):
    junk = "Home | News | Sport | Weather | Video | Shop"
    distinct = "\n".join(f"Home{i} | News{i} | Sport{i} | Weather{i}" for i in range(9))
    rows = [(1, f"{GOOD}\n{junk}"), (2, f"{GOOD}\n{distinct}"), (3, distinct), (4, GOOD), (4, GOOD), (None, GOOD), (5, f"{GOOD}\nAll rights reserved.")]
    got = [(r["doc_id"], r["kept"], r["base_failed"]) for r in clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, True, False), (2, False, False), (3, False, False), (4, True, False), (4, True, False), (None, True, False), (5, True, False)], key=str)
