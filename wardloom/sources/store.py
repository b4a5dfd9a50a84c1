"""Keyed tables as Parquet folders, and one small file that names the folders that stand: commits of several tables at once, merges by key, and pinned reads.

A commit writes new folders first and then its file, so a reader sees all of it or nothing, and a job that is killed before leaves folders that nobody reads. A table's later
folders replace the rows of equal keys in earlier ones; after ``COMPACT`` of them they are written as one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders of a table before they are written as one.
COMPACT = 16
POLICIES = ("skip", "stored", "refresh", "overwrite", "insert", "update")


class ConflictError(RuntimeError):
    """Another commit took the version, or rows of the policy ``insert`` are known already."""


@dataclass(frozen=True)
class Snapshot:
    """One version of all tables. Reads of one snapshot agree with each other whatever is committed meanwhile."""

    spark: SparkSession
    version: int = 0
    tables: dict[str, dict] = field(default_factory=dict)
    writers: dict[str, int] = field(default_factory=dict)

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def table(self, name: str) -> DataFrame:
        """The rows that stand: of equal keys the one that was committed last. A table without a key has all its rows."""
        of = self.tables[name]
        schema = T.StructType.fromJson(of["schema"])
        parts = [self.spark.read.schema(schema).parquet(f).withColumn("__at", F.lit(i)) for i, f in enumerate(of["folders"])]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if len(parts) == 1 or not of["key"]:
            return rows.drop("__at")
        rest = [c for c in schema.names if c not in of["key"]]
        last = rows.groupBy(*of["key"]).agg(F.max_by(F.struct(*rest), "__at").alias("row"))
        return last.select(*[F.col(c) if c in of["key"] else F.col("row")[c].alias(c) for c in schema.names])


class Store:
    """Tables under one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or the one asked for."""
        folder = self._at(f"{self.path}/commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        versions = sorted(int(n[:-5]) for n in names if n.endswith(".json"))
        if version is None:
            version = versions[-1] if versions else 0
        if version == 0:
            return Snapshot(self.spark)
        said = json.loads(self.spark.read.text(f"{self.path}/commits/{version:012d}.json", wholetext=True).first()[0])
        return Snapshot(self.spark, **said)

    def commit(self, writer: str, batch: int, tables: dict[str, tuple[DataFrame, list[str]]], base: Snapshot | None = None) -> Snapshot:
        """Adds rows to tables, name -> (rows, key), as one version. A batch of a writer that was committed before changes nothing.

        Rows of one commit must have distinct keys. Raises ConflictError if another commit was made since ``base``.
        """
        base = base or self.snapshot()
        if base.writers.get(writer, -1) >= batch:
            return base
        version, now = base.version + 1, dict(base.tables)
        for name, (rows, key) in tables.items():
            folders = list(now[name]["folders"]) if name in now else []
            folder = f"{self.path}/{name}/{version:012d}-{uuid.uuid4().hex}"
            rows.write.parquet(folder)
            now[name] = {"key": key, "folders": [*folders, folder], "schema": now[name]["schema"] if name in now else json.loads(rows.schema.json())}
            if len(now[name]["folders"]) > COMPACT:
                whole = f"{folder}-whole"
                Snapshot(self.spark, version, now).table(name).write.parquet(whole)
                now[name] = now[name] | {"folders": [whole]}
        made = Snapshot(self.spark, version, now, base.writers | {writer: batch})
        self._put(f"{self.path}/commits/{version:012d}.json", json.dumps({"version": version, "tables": now, "writers": made.writers}))
        return made

    def _put(self, path: str, text: str) -> None:
        """Writes a file that must not be there yet; it appears whole."""
        if self._fs.exists(self._at(path)):
            raise ConflictError(f"{path} was committed by another writer")
        part = self._at(f"{self.path}/parts/{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(self._at(path).getParent())
        if not self._fs.rename(part, self._at(path)):
            raise ConflictError(f"{path} was committed by another writer")

    def merge(
        self, name: str, rows: DataFrame, key: list[str], writer: str, batch: int, policy: str = "skip", order: list[str] | None = None, columns: list[str] | None = None,
        with_new: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]] | None = None,
    ) -> DataFrame:
        """Brings rows into a table by key, once for each batch of a writer; gives (key, outcome, changed, repeats) of each key.

        Of equal keys in the batch the first in ``order`` counts, the others are its ``repeats``; changed tells that a known key came with other values.
        Keys that are not known yet are ``inserted``. For known ones ``policy`` says:
        skip and stored leave the stored row (outcome skipped or returned); refresh takes ``columns`` from the new row and keeps the rest, so what was counted once stays counted once;
        overwrite replaces the row; insert raises ConflictError and commits nothing; update is refresh that inserts nothing (outcome unknown).
        with_new: further tables, name -> (rows made from the inserted ones, key), that the same commit writes. Outcomes are kept in ``<name>_outcomes``.
        Rows with a null in their key are ``rejected``. Other columns may be null; a batch may be empty.
        """
        if policy not in POLICIES:
            raise ValueError(f"policy must be one of {POLICIES}")
        base, log = self.snapshot(), f"{name}_outcomes"
        if base.writers.get(writer, -1) >= batch:
            return self.outcomes(name, writer, batch, base)
        rest = [c for c in rows.columns if c not in key]
        first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*(order or rest))).alias("new"), (F.count("*") - 1).alias("repeats"))
        valid = F.lit(True)
        for k in key:
            valid = valid & F.col(k).isNotNull()
        if name in base:
            old = base.table(name)
            first = first.join(old.select(*key, F.struct(*[c for c in old.columns if c not in key]).alias("old")), key, "left")
        else:
            first = first.withColumn("old", F.lit(None).cast(f"struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in rows.schema if f.name not in key)}>"))
        known = {"skip": "skipped", "stored": "returned", "refresh": "refreshed", "overwrite": "overwritten", "insert": "conflict", "update": "updated"}[policy]
        outcome = F.when(~valid, "rejected").when(F.col("old").isNotNull(), known).otherwise("unknown" if policy == "update" else "inserted")
        stored_names = [f["name"] for f in base.tables[name]["schema"]["fields"]] if name in base else []
        shared = [c for c in rest if not stored_names or c in stored_names]
        same = F.lit(True)
        for c in shared:
            same = same & F.col("new")[c].eqNullSafe(F.col("old")[c])
        staged_at = f"{self.path}/staged/{name}-{uuid.uuid4().hex}"
        first.select(*key, "new", "old", "repeats", outcome.alias("outcome"), (F.col("old").isNotNull() & ~same).alias("changed")).write.parquet(staged_at)
        staged = self.spark.read.parquet(staged_at)
        if policy == "insert" and not staged.where("outcome = 'conflict'").isEmpty():
            raise ConflictError(f"keys of {name} are known already")
        target = stored_names or rows.columns
        take = {"refresh": set(columns or rest), "update": set(columns or rest), "overwrite": set(rest)}.get(policy, set())

        def value(c: str) -> Column:
            new = F.col("new")[c] if c in rest else F.lit(None)
            return new if c in take or c not in rest else F.when(F.col("old").isNull(), new).otherwise(F.col("old")[c])

        values = [F.col(c) if c in key else (value(c) if c in rest else F.col("old")[c]).alias(c) for c in target]
        delta = staged.where(F.col("outcome").isin("inserted", "refreshed", "overwritten", "updated")).select(*values)
        new = staged.where("outcome = 'inserted'").select(*[F.col(c) if c in key else F.col("new")[c].alias(c) for c in rows.columns])
        log_rows = staged.select(F.lit(writer).alias("writer"), F.lit(batch).cast("long").alias("batch"), F.to_json(F.struct(*key)).alias("key"), "outcome", "changed", "repeats")
        extra = {other: (make(new), k) for other, (make, k) in (with_new or {}).items()}
        made = self.commit(writer, batch, {name: (delta, key), log: (log_rows, []), **extra}, base)
        self._fs.delete(self._at(staged_at), True)
        return self.outcomes(name, writer, batch, made)

    def outcomes(self, name: str, writer: str, batch: int, at: Snapshot | None = None) -> DataFrame:
        """(key as JSON, outcome, changed, repeats) of a batch."""
        return (at or self.snapshot()).table(f"{name}_outcomes").where((F.col("writer") == writer) & (F.col("batch") == batch)).drop("writer", "batch")

    def counters(self, name: str) -> DataFrame:
        """(writer, batch, processed, known, changed, repeats, rejected) of each batch that a table has taken in."""
        at = self.snapshot().table(f"{name}_outcomes")
        count = lambda c: F.count_if(c).alias
        new, bad = F.col("outcome") == "inserted", F.col("outcome").isin("rejected", "unknown")
        return at.groupBy("writer", "batch").agg(count(new)("processed"), count(~new & ~bad)("known"), count(F.col("changed"))("changed"), F.sum("repeats").alias("repeats"), count(bad)("rejected"))
