"""Extra columns, clashing names and nulls pass through every operator that returns its input's rows."""

import pytest
from pyspark.sql import functions as F

from wardloom.llm import katz
from wardloom.llm.decontaminate import decontaminate
from wardloom.llm.line_dedup import dedup_lines
from wardloom.llm.line_quality import clean_lines
from wardloom.llm.piece_codec import encode_documents
from wardloom.llm.simhash import dedup_simhash
from wardloom.llm.substring_dedup import remove_repeats
from wardloom.llm.vector_dedup import link_embeddings
from wardloom.llm.weak_quality import QualityModel, fit_quality, score_quality
from wardloom.llm.word_runs import collapse_runs
from wardloom.llm.zstd_language import predict_language


def model_file():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def bench(spark):
    return spark.createDataFrame([(0, "a b c d e f g h i j k l m n o p")], "item_id long, text string")


def quality(docs):
    labels = docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit_quality(docs, labels)
    assert isinstance(model, QualityModel)
    return score_quality(docs, model)


OPERATORS = {
    "lines": dedup_lines,
    "repeats": remove_repeats,
    "pieces": lambda d: encode_documents(d, model_file()),
    "simhash": dedup_simhash,
    "leaks": lambda d: decontaminate(d, bench(d.sparkSession)),
    "language": lambda d: predict_language(d, {"en": b"the and ing", "de": b"sch ung ein"}),
    "quality": quality,
    "runs": collapse_runs,
    "line rules": clean_lines,
    "katz": lambda d: katz.score(d, katz.fit(d, F.lit(True)), F.lit(True)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_text_operators(spark, name):
    rows = [(1, "one two three", "x", None, 1), (None, None, None, "y", None), (2, "", "z", "z", 2)]
    schema = "doc_id long, text string, `odd name.x` string, score string, t int"
    out = OPERATORS[name](spark.createDataFrame(rows, schema)).collect()
    assert len(out) in (2, 3)
    got = {r["doc_id"]: (r["odd name.x"], r["t"]) for r in out}
    want = {1: ("x", 1), None: (None, None), 2: ("z", 2)}
    assert all(got[k] == want[k] for k in got) and 1 in got
    empty = OPERATORS[name](spark.createDataFrame([], schema))
    assert empty.count() == 0 and {"doc_id", "odd name.x", "t"} <= set(empty.columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_and_repeated_rows(spark, name):
    """Every column keeps its values though it is named like one that some operator makes for itself; repeated rows stay or go together."""
    extra = ("__t", "__h1", "__doc", "__starts", "__key", "t", "key", "doc", "left", "right", "starts", "whole", "th", "Gone", "rep", "ord", "tokens", "text_")
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in extra)
    rows = [(i, text, *[f"{n}{i}" for n in extra]) for i, text in ((1, "one two three"), (1, "one two three"), (2, "ein zwei drei"), (None, "x"))]
    out = OPERATORS[name](spark.createDataFrame(rows, schema)).collect()
    for r in out:
        assert all(r[n] == f"{n}{r['doc_id']}" for n in extra)
    assert sorted(r["doc_id"] or 0 for r in out if r["doc_id"] == 1) in ([1, 1], [1] if name == "simhash" else [], [])


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 3, "a", 9, "k"), (2, [1.0, 0.01], 3, None, None, "k"), (None, None, None, None, 1, "k")]
    schema = "vec_id long, embedding array<float>, label int, rep string, n_links int, __k1 string"
    out = {r["vec_id"]: (r["n_links"], r["rep"], r["__k1"]) for r in link_embeddings(spark.createDataFrame(rows, schema)).collect()}
    assert out == {1: (1, "a", "k"), 2: (1, None, "k"), None: (0, None, "k")}
    assert link_embeddings(spark.createDataFrame([], schema)).count() == 0
