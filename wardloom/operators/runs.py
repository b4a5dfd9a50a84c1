"""Runs, rankings and their history."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("trigger", T.StringType()), T.StructField("started_at", T.TimestampType()), T.StructField("finished_at", T.TimestampType()), T.StructField("scored", T.LongType()), T.StructField("error", T.StringType())])


def archived(current: DataFrame, run_id: str, recorded_at: Column) -> DataFrame:
    """The rows of a standing ranking as history, stamped with the run that made them, or with the one that archives them where none is known."""
    return current.select("hotspot_code", F.coalesce("run_id", F.lit(run_id)).alias("run_id"), "rank", "score", "band", recorded_at.alias("recorded_at"))


def replace_ranking(spark: SparkSession, folder: str, ranking: DataFrame, run_id: str, recorded_at: dt.datetime) -> str:
    """Installs ranking(hotspot_code, rank, score, band) in folder and puts the one before it into the history.

    History is appended first, then the ranking is written under a name of its own, and last a one-row table names it. A reader sees the old
    ranking or the new one; a run that fails between leaves the old one standing, and its repetition archives the same rows again under the same run, which ``history`` tells apart by run.
    """
    old = current_ranking(spark, folder)
    if old is not None:
        archived(old, run_id, F.lit(recorded_at)).write.mode("append").parquet(f"{folder}/history")
    name = f"ranking-{uuid.uuid4().hex}"
    ranking.withColumn("run_id", F.lit(run_id)).write.parquet(f"{folder}/{name}")
    spark.createDataFrame([(name, recorded_at)], "name string, at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/pointer")
    return name


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # the reader names a missing path in the message alone
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def current_ranking(spark: SparkSession, folder: str) -> DataFrame | None:
    pointers = _there(spark, f"{folder}/pointer")
    row = None if pointers is None else pointers.agg(F.max_by("name", "at").alias("name")).first()
    return spark.read.parquet(f"{folder}/{row['name']}") if row and row["name"] else None


def history(rows: DataFrame) -> DataFrame:
    """Each hotspot's history without repetitions of one run, newest first."""
    return rows.dropDuplicates(["hotspot_code", "run_id"]).orderBy("hotspot_code", F.desc("recorded_at"), "run_id")


def latest(rows: DataFrame, per: str, most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows of each key in an order; a tie within it is the caller's to break."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def run_rows(events: DataFrame) -> DataFrame:
    """Audit rows of runs from events(run_id, at, what, trigger, scored, error): started, finished or failed; a run without an end is RUNNING."""
    at = lambda *what: F.max(F.when(F.col("what").isin(*what), F.col("at")))
    ended = F.max_by(F.when(F.col("what") != "started", F.struct("what", "scored", "error")), F.when(F.col("what") != "started", F.col("at")))
    out = events.groupBy("run_id").agg(F.max("trigger").alias("trigger"), F.min(F.when(F.col("what") == "started", F.col("at"))).alias("started_at"), at("finished", "failed").alias("finished_at"), ended.alias("e"))
    status = F.when(F.col("e").isNull(), "RUNNING").when(F.col("e.what") == "finished", "SUCCESS").otherwise("FAILED")
    millis = F.unix_millis("finished_at") - F.unix_millis("started_at")
    return out.select("run_id", "trigger", status.alias("status"), "started_at", "finished_at", millis.alias("duration_ms"), F.coalesce("e.scored", F.lit(0)).cast("long").alias("scored"), F.col("e.error").alias("error"))


def latest_success(runs: DataFrame) -> DataFrame:
    """The run that finished last with success, if there is one."""
    return runs.where("status = 'SUCCESS'").agg(F.max_by(F.struct(*runs.columns), F.struct("finished_at", "run_id")).alias("r")).where("r is not null").select("r.*")


def ranking_payload(ranking: DataFrame, past: DataFrame) -> DataFrame:
    """ranking with its movement against the latest row of past(hotspot_code, rank, score, recorded_at): previous score, change of score and of rank."""
    before = past.groupBy("hotspot_code").agg(F.max_by(F.struct("rank", "score"), "recorded_at").alias("p"))
    out = ranking.join(before, "hotspot_code", "left")
    return out.withColumns({"previous_score": F.col("p.score"), "score_change": F.round(F.col("score") - F.col("p.score"), 1), "rank_change": F.col("p.rank") - F.col("rank")}).drop("p")


def band_counts(ranking: DataFrame, bands: tuple[str, ...] = ("HIGH", "MEDIUM", "LOW")) -> DataFrame:
    """One row: how many of each band."""
    return ranking.agg(F.count("*").alias("total"), *[F.count_if(F.col("band") == b).alias(b.lower()) for b in bands])
