"""Named queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardloom.sources.testdata import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _behind(sql: str) -> str:
    """sql behind the adapters, its own common table expressions after theirs."""
    text = sql.lstrip()
    if not text.lower().startswith("with"):
        return with_tables(text)
    head, rest = with_tables("").rstrip(), text[4:].lstrip()
    if rest.lower().startswith("recursive"):
        head, rest = head.replace("with ", "with recursive ", 1), rest[9:]
    return f"{head}, {rest}"


def query(name: str, sql: str | None = None) -> Callable:
    """Registers fn(tables) -> DataFrame; sql may name the civic tables and the test tables."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = _behind(sql)
        return fn

    return register
