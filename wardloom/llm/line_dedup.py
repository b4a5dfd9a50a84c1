"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.llm.common import SPACE, long_array, mapped, stored, texts, unused, without

MIN_POINTS, MIN_DOCS = 20, 3
#: Batches that the operator feeds to the runs, and runs that a level holds before they are merged.
BATCHES, FANOUT = 3, 2


def line_hash(line: str, min_points: int) -> bytes | None:
    """128-bit hash of a line's key; None for a key that is too short. bytes.lower() changes A-Z alone."""
    key = line.strip(SPACE)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_points else None


def line_hashes(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(doc_id, h1, h2), once for each row of docs and distinct key of enough code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, counts = [], []
            for text in texts(b.column("text")):
                own = {h for line in text.split("\n") if (h := line_hash(line, min_points))}
                digests += own
                counts.append(len(own))
            h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            rows = np.repeat(np.arange(b.num_rows), counts)
            yield pa.record_batch([b.column("doc_id").take(pa.array(rows)), long_array(h[:, 0]), long_array(h[:, 1])], names=["doc_id", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, h1 long, h2 long")


class LineRuns:
    """Sorted runs of line keys in levels, as tables bucketed by key so that merging needs no shuffle of a run.

    A key is in one run only: the run of the batch that brought it first. ``add`` merge-anti-joins a
    batch with all runs (in one marking join), writes the new keys as a run of level 0 and notes the returning keys beside
    them. A level of FANOUT runs is merged into one run of the next level. Runs hold n_docs, max_doc
    of their batch; ``totals`` adds what returned later.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.name = spark, fanout, f"line_run_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as a grouping by key deals them, so each bucket is one file
        self.levels: dict[int, list[str]] = {}
        self.returned: list[DataFrame] = []
        self.made = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"{self.name}_{self.made}"
        self.made += 1
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self.levels.setdefault(level, []).append(name)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels.values() for n in level]

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, n_docs, max_doc), each key once, of documents not added before."""
        if not self.made:
            self._write(batch, 0)
            return
        held = _union([run.select("h1", "h2", F.lit(True).alias("held")) for run in self.runs()])
        batch = stored(batch.join(held, ["h1", "h2"], "left"))
        self.returned.append(batch.where("held").drop("held"))
        self._write(batch.where("held is null").drop("held"), 0)
        level = 0
        while len(self.levels.get(level, ())) >= self.fanout:
            old = self.levels.pop(level)
            self._write(_union([self.spark.table(n) for n in old]), level + 1)
            for n in old:
                self.spark.sql(f"drop table {n}")
            level += 1

    def totals(self, min_docs: int) -> DataFrame:
        """(h1, h2, n_docs, max_doc) of the keys found in min_docs documents or more."""
        first = _union(self.runs())
        if not self.returned:
            return first.where(F.col("n_docs") >= min_docs)
        later = _union(self.returned).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n2"), F.max("max_doc").alias("m2"))
        total = F.col("n_docs") + F.coalesce("n2", F.lit(0))
        return first.join(later, ["h1", "h2"], "left").where(total >= min_docs).select("h1", "h2", total.alias("n_docs"), F.greatest("max_doc", "m2").alias("max_doc"))

    def drop(self) -> None:
        for names in self.levels.values():
            for n in names:
                self.spark.sql(f"drop table if exists {n}")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def dedup_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with ``text`` cut down to its kept lines, and ``n_lines``, ``n_dropped``.

    A key (a line stripped of white space at both ends, A-Z lower-cased) of min_points code points
    that min_docs documents hold loses all its lines but those of the largest doc_id that holds it.
    Defined cases: null or empty text is one empty line; rows with the same doc_id are one document
    when documents are counted, and each keeps its own row; a null doc_id is one document, below all
    others; of the documents that hold a line the largest doc_id keeps all its copies of it; texts of any length are read whole; an
    empty table gives an empty table; a column of docs named n_lines or n_dropped is replaced, all other columns are carried, whatever their names.
    """
    spark = docs.sparkSession
    docs = without(docs, "n_lines", "n_dropped")
    lines = line_hashes(docs, min_points).distinct()
    lines = stored(lines.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "batch")
    runs = LineRuns(spark)
    for i in range(batches):
        runs.add(lines.where(F.col("batch") == i).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc")))
    heavy = stored(runs.totals(min_docs))
    runs.drop()
    drops = lines.join(heavy, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    doc, left, right = unused(docs, "doc", "left", "right")
    drops = drops.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list("h1").alias(left), F.collect_list("h2").alias(right))
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(drops[doc]), "left").drop(doc)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, h1, h2 in zip(texts(b.column("text")), b.column(left), b.column(right)):
                own = text.split("\n")
                n_lines.append(len(own))
                if h1.is_valid:
                    pairs = np.stack([h1.values.to_numpy(), h2.values.to_numpy()], axis=1).tobytes()
                    gone = {pairs[i : i + 16] for i in range(0, len(pairs), 16)}
                    own = [x for x in own if line_hash(x, min_points) not in gone]
                n_dropped.append(n_lines[-1] - len(own))
                kept.append("\n".join(own))
            columns = [b.column(c) for c in names]
            columns[at] = pa.array(kept, pa.string())
            yield pa.record_batch([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    schema = joined.select(*[F.col(f"`{c}`") for c in names]).withColumns({"text": F.col("text").cast("string"), "n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
    return mapped(joined, run, schema)
