"""The corpus pipeline: five stages over documents, each written and read again as the next one's input.

All stages read whole texts and tables, take a null text as an empty one, carry null doc_ids like others unless said otherwise, and give no rows for no
documents. Their input has the columns of documents; further columns are dropped.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.llm.common import documents, shared_dir, small_batches
from wardloom.llm.decontaminate import decontaminate
from wardloom.llm.line_dedup import dedup_lines
from wardloom.llm.piece_codec import encode_documents
from wardloom.llm.simhash import dedup_near
from wardloom.llm.weak_quality import fit_quality, score_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps. Null and empty texts go; repeated rows stay or go together; a score at the threshold of quality stays, of toxicity goes."""
    small_batches(spark)
    model = fit_quality(docs, documents(spark, sf_dir, "labels"))
    return score_quality(docs, model).where("keep").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars follows the text. No document goes, even if all its lines do; of the documents that share a line the largest doc_id keeps it; rows of one doc_id are one document."""
    small_batches(spark)
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, its smallest doc_id: Jaccard 0.8 or more on five-word shingles.

    op10's four bits, which its contract binds, leave most of these in the corpus; fingerprints of more blocks find them, and their shingles verify them. Texts
    without words are one group; a row with a null doc_id stays; a repeated row stays once.
    """
    small_batches(spark)
    return dedup_near(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Rows are judged by their own text, so repeated rows go together; an empty benchmark leaves all."""
    small_batches(spark)
    return decontaminate(docs, documents(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of its decoded text; a text without characters has the begin and end ids alone."""
    small_batches(spark)
    coded = encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination), ("sentencepiece", tokens)]

#: SQL can't express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
