"""Stages that fail by row: a failure gives the row its fallback and a warning, and never ends a job or loses a record."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

WARNING = "array<struct<stage: string, message: string>>"


@dataclass(frozen=True)
class Stage:
    """One step of a pipeline over columns.

    values: what it gives, of expressions that are null where they can't be had (try_cast, try_divide, from_json), not ones that raise. failed: why it failed for a row, null
    where it did not. fallback: what its columns are then, null where nothing is named. needs: stages without which it is not tried; it fails for rows that one of them failed for.
    """

    name: str
    values: dict[str, Column]
    failed: Column
    fallback: dict[str, object] = field(default_factory=dict)
    needs: tuple[str, ...] = ()


def unreadable(source: str | Column, value: Column, what: str) -> Column:
    """The reason of a stage that reads a value: something is said and nothing could be read."""
    said = F.col(source) if isinstance(source, str) else source
    return F.when((F.coalesce(F.trim(said.cast("string")), F.lit("")) != "") & value.isNull(), F.concat(F.lit(f"{what}: "), F.substring(said.cast("string"), 1, 80)))


def run(rows: DataFrame, stages: list[Stage]) -> DataFrame:
    """rows with the columns of all stages and ``warnings`` (stage, message), in the order of the stages.

    A later stage sees the fallbacks of earlier ones. Every row stays, each by itself, without a shuffle; an existing ``warnings`` is
    added to, so that runs may follow each other. Rows may repeat; an empty table gives an empty one. Names of stages are distinct, and a need must come before.
    """
    seen: set[str] = set()
    for s in stages:
        if s.name in seen or not set(s.needs) <= seen:
            raise ValueError(f"stage {s.name} is there twice or comes before one that it needs")
        seen.add(s.name)
    if "warnings" not in rows.columns:
        rows = rows.withColumn("warnings", F.array().cast(WARNING))
    for s in stages:
        before = F.exists("warnings", lambda w: w["stage"].isin(*s.needs)) if s.needs else F.lit(False)  # noqa: B023
        why = F.when(before, F.lit("a stage before it failed")).otherwise(s.failed)
        rows = rows.withColumn("__why", why)
        ok = F.col("__why").isNull()
        rows = rows.withColumns({c: F.when(ok, v).otherwise(F.lit(s.fallback.get(c))) for c, v in s.values.items()})
        warning = F.array(F.struct(F.lit(s.name).alias("stage"), F.col("__why").alias("message")))
        rows = rows.withColumn("warnings", F.when(ok, F.col("warnings")).otherwise(F.concat("warnings", warning))).drop("__why")
    return rows


def by_row(fn: Callable, kind: T.DataType) -> Callable[..., Column]:
    """A Python function of one row's values as a Column function of (value, error): what it raises is that row's error. For what no built-in function does."""

    @F.pandas_udf(T.StructType([T.StructField("value", kind), T.StructField("error", T.StringType())]))
    def safe(*columns: pd.Series) -> pd.DataFrame:
        out = []
        for args in zip(*columns):
            try:
                out.append((fn(*args), None))
            except Exception as e:  # noqa: BLE001  any failure is the row's own
                out.append((None, f"{type(e).__name__}: {e}"[:200]))
        return pd.DataFrame({"value": pd.Series([v for v, _ in out], dtype=object), "error": pd.Series([e for _, e in out], dtype=object)})

    return safe


def failures(rows: DataFrame, key: str) -> DataFrame:
    """(key, stage, message): the side table of all warnings."""
    return rows.select(key, F.explode("warnings").alias("w")).select(key, "w.stage", "w.message")


def failure_counts(rows: DataFrame) -> DataFrame:
    """(stage, failed, message): how many rows each stage failed for, and the least of its messages."""
    return rows.select(F.explode("warnings").alias("w")).groupBy("w.stage").agg(F.count("*").alias("failed"), F.min("w.message").alias("message"))


def observed(rows: DataFrame, stages: list[Stage], name: str = "stages") -> tuple[DataFrame, Observation]:
    """rows, and what will be known once they were written: ``rows``, ``clean`` and how many each stage failed for. No further pass over the rows."""
    seen = Observation(name)
    of = [F.count_if(F.exists("warnings", lambda w: w["stage"] == s.name)).alias(s.name) for s in stages]  # noqa: B023
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("warnings") == 0).alias("clean"), *of), seen
