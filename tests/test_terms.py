"""Terms of a table in texts: against brute force, by heads, in large numbers, and through the operators that use them."""

import random
import time

import pytest

from wardloom.operators import geocode, records, terms, vocabulary


def brute(texts, words, whole):
    out = {}
    wordlike = terms._wordlike
    for k, t in texts:
        low = (t or "").lower()
        for w in {w.lower() for w in words if w}:
            at = [i for i in range(len(low) - len(w) + 1) if low.startswith(w, i) and not (whole and ((i and wordlike(low[i - 1])) or (i + len(w) < len(low) and wordlike(low[i + len(w)]))))]
            if at:
                out[k, w] = at
    return out


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("most_chars", [10**6, 30, 1])
def test_terms_equal_brute_force(spark, whole, most_chars):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("aAbé_ 😀") for _ in range(n))
    words = [word(rng.randint(1, 6)) for _ in range(60)] + ["", None, "aa", "AA", "a b"]
    texts = [(i, word(rng.choice((0, 3, 40)))) for i in range(60)] + [(60, None), (61, "aaaa aaaa"), (62, "a" * 20_000)]
    rows, table = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame([(w,) for w in words], "w string")
    got = [(r["k"], r["term"], r["starts"]) for r in terms.occurrences(rows, table, "k", "t", "w", whole, most_chars).collect()]
    assert len({x[:2] for x in got}) == len(got) and {x[:2]: x[2] for x in got} == brute(texts, words, whole)


def test_empty_tables(spark):
    rows, none = spark.createDataFrame([(1, "abc")], "k int, t string"), spark.createDataFrame([], "term string")
    assert terms.occurrences(rows, none, "k", "t").count() == 0
    assert terms.occurrences(rows.where("false"), rows.selectExpr("t as term"), "k", "t").count() == 0


def test_a_hundred_thousand_terms_and_a_hot_one(spark):
    names = spark.range(100_000).selectExpr("concat('ward ', id, ' road') as alias", "id as place")
    rows = spark.range(20_000).selectExpr("id as k", "concat('near Ward ', if(id % 3 = 0, 5, id), ' Road and ward 99999 roadside') as t")
    begin = time.time()
    for most in (terms.MOST_CHARS, 50_000):
        found = terms.occurrences(rows, names, "k", "t", "alias", True, most)
        assert found.where("term = 'ward 5 road'").count() == 6668 and found.count() == 20_000
    assert time.time() - begin < 60
    plan = geocode.by_text(rows, names, "k", "t")._jdf.queryExecution().toString()
    assert len(plan) < 40_000 and "ward 77 road" not in plan


def test_names_of_several_places_and_repeated_texts(spark):
    rows = spark.createDataFrame([(1, "Old Town Hall"), (2, "old town"), (3, ""), (4, None)], "k int, t string")
    names = spark.createDataFrame([("old town", "B"), ("Old Town", "A"), ("town hall", "C"), ("", "E"), (None, "F")], "alias string, place string")
    assert {r["k"]: r["place"] for r in geocode.by_text(rows, names, "k", "t").collect()} == {1: "C", 2: "A", 3: None, 4: None}


def test_dictionary_gives_what_the_short_list_gives(spark):
    said = ["no water, water supply is off", "paani nahi", "road and garbage", "", None, "bijli nahi hai", "the school building near the bus stop", "theft and harassment", "पानी नहीं", "Street Light power cut"]
    rows = spark.createDataFrame([(i, None if i % 3 else "ROAD", None, ("en", "hi", "romanised")[i % 3], s) for i, s in enumerate(said)], "k int, category string, sub_category string, language string, description string")
    table = spark.createDataFrame(list(vocabulary.KEYWORDS), "category string, sub_category string, language string, keyword string")
    columns = [c for c in vocabulary.normalize(rows).columns]
    plain, by_table = vocabulary.normalize(rows), vocabulary.normalize(rows, dictionary=table, key="k")
    assert sorted(map(str, plain.select(columns).collect())) == sorted(map(str, by_table.select(columns).collect()))


def test_lexicon_table_classifies_as_the_built_in_one(spark):
    said = ["broken road, pothole; potholes", "no water and dirty   water", "hospital school", "nothing", None, "BROKEN-ROAD", "brokenroad"]
    rows = spark.createDataFrame(list(enumerate(said)), "k int, t string")
    table = spark.createDataFrame(list(records.LEXICON), "category string, sub_category string, term string, weight double")
    assert sorted(records.classify(rows, "k", "t").collect()) == sorted(records.classify(rows, "k", "t", lexicon=table).collect())


def test_gazetteer_spans(spark):
    rows = spark.createDataFrame([(1, "MG Road, mg roads; MG Road")], "k int, t string")
    names = spark.createDataFrame([("mg road", "STREET"), ("MG Road", "LANDMARK"), ("road", "STREET")], "name string, type string")
    got = sorted((r["type"], r["text"], r["start"], r["end"]) for r in terms.gazetteer_entities(rows, names, "k", "t").collect())
    assert got == [("LANDMARK", "mg road", 0, 7), ("LANDMARK", "mg road", 19, 26), ("STREET", "mg road", 0, 7), ("STREET", "mg road", 19, 26), ("STREET", "road", 3, 7), ("STREET", "road", 22, 26)]


def test_candidates_that_are_no_terms_stay_in_the_worker(spark, monkeypatch):
    rows = spark.range(50).selectExpr("id as k", "repeat(concat('abcdefghij', id), 200) as t")
    table = spark.createDataFrame([("a" + "x" * n,) for n in range(1, 40)] + [("abcdefghij7",)], "term string")
    met = []
    join = terms.dealt_join
    monkeypatch.setattr(terms, "dealt_join", lambda found, *rest: met.append(found.count()) or join(found, *rest))
    monkeypatch.setattr(terms, "FINDS", 3)
    got = terms.occurrences(rows, table, "k", "t", most_chars=1).collect()
    assert [(r["k"], r["term"], len(r["starts"])) for r in got] == [(7, "abcdefghij7", 200)] and met[0] < 50
