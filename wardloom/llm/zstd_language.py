"""Language identification by compression."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.common import mapped, stored, without

#: Fitting: bytes of a dictionary, documents sampled for each language, and bytes of a segment taken from one.
DICT_BYTES, SAMPLE_DOCS, SEGMENT = 96_000, 1_000, 480
#: Characters of a text that are compressed at a time, and the margin below which a prediction is rejected.
PIECE, MARGIN, LEVEL = 2_000, 0.01, 6
#: Letters, and number signs such as ² or Ⅷ, which ``str.isalpha`` then tells apart.
LETTERS_OR_SIGNS = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTERS_OR_SIGNS.finditer(text))


def fit_dictionaries(train: DataFrame, dict_bytes: int = DICT_BYTES, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Raw dictionary content for each non-null lang of train(text, lang).

    The distinct texts of each language are counted over all rows; then about sample_docs of them, by a hash of the text, give
    segments from all over their texts, so the driver gets dict_bytes for each language about twice. A text in any number of copies is one
    text: it is neither lost nor sent again for each. Defined cases: rows with a null lang or a null or empty text teach nothing; a language of
    few texts gives what these have; an empty table gives no dictionary; long texts are sampled all over; other columns are not read.
    """
    train = train.select("lang", "text").where("lang is not null and text is not null and text <> ''")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).collect()}
    if not sizes:
        return {}
    each = {lang: max(1, -(-2 * dict_bytes // (SEGMENT * min(n, sample_docs)))) for lang, n in sizes.items()}

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                data = text.lower().encode()
                for k in range(min(each[lang], -(-len(data) // SEGMENT))):
                    order = xxhash.xxh64_intdigest(data, k)
                    at = order % max(1, len(data) - SEGMENT + 1)
                    out.append((lang, order >> 1, data[at : at + SEGMENT]))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()))], names=["lang", "ord", "data"])

    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, max(1, n // sample_docs))])
    sample = train.where(F.pmod(F.xxhash64("text"), share[F.col("lang")]) == 0)
    found: dict[str, list[tuple[int, bytes]]] = {}
    for r in sample.mapInArrow(segments, "lang string, ord long, data binary").distinct().collect():
        found.setdefault(r["lang"], []).append((r["ord"], bytes(r["data"])))
    return {lang: b"\n".join(d for _, d in sorted(rows))[:dict_bytes] for lang, rows in sorted(found.items())}


def predict_language(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """docs with ``lang_pred``, ``score`` and ``accepted``.

    Every piece of the whole text, in lower case, is compressed with every language's dictionary; the smallest total
    wins, ties going to the first language by name. score is the part by which the second smallest total
    is larger than the smallest, of the second; a prediction with less than ``margin`` is not accepted.
    Defined cases: text that is null or has no letter is ``und`` with score 0, not accepted; one known
    language has score 1; no known language makes all texts ``und``; repeated rows repeat their prediction; long texts are compressed
    whole, piece by piece; columns of docs with the names of the new ones are replaced, all others are carried; an empty table gives an empty one. Only text is read.
    """
    docs = without(docs, "lang_pred", "score", "accepted")
    names = docs.columns
    langs = sorted(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        for lang in langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        for b in batches:
            pred, score, sure = [], [], []
            for text in b.column("text").to_pylist():
                if not langs or text is None or not has_letter(text):
                    pred.append(UNKNOWN), score.append(0.0), sure.append(False)
                    continue
                text = text.lower()
                pieces = [text[i : i + PIECE].encode() for i in range(0, len(text), PIECE)]
                sizes = np.array([sum(len(c(p)) for p in pieces) for c in coders], float)
                best = int(sizes.argmin())
                second = np.delete(sizes, best).min() if len(langs) > 1 else np.inf
                part = float(1 - sizes[best] / second)
                pred.append(langs[best]), score.append(part), sure.append(part >= margin)
            yield pa.record_batch([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())], names=[*names, "lang_pred", "score", "accepted"])

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return mapped(docs, run, docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "accepted": F.lit(True)}).schema)


def held_out(doc_id, folds: int, fold: int):
    """If crc32 of doc_id as text leaves ``fold`` modulo ``folds``; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))
