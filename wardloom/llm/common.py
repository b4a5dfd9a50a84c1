"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the contracts: space and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts go to Python so many rows at a time, not Spark's 10,000, which are tens of MB several times over in each worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. Where none is named, a temporary one for a master in one process, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wardloom-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    schema = df.schema
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._wardloom_path = path
    return back


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables made by ``stored`` that no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._wardloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to make (case-insensitive)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for an operator's own columns that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for column names of any kind: Spark's own reads a dot in a name as a path."""
    names = df.columns
    if not any("." in n or "`" in n for n in (*names, *schema.names)):
        return df.mapInArrow(run, schema)

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=[f"o{i}" for i in range(b.num_columns)])

    plain = T.StructType([T.StructField(f"o{i}", f.dataType) for i, f in enumerate(schema)])
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, plain).toDF(*schema.names)


def texts(column: pa.Array) -> list[str]:
    """Values of a string column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the smallest node that each is linked to, by hooking and pointer jumping."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _with_least(ends: DataFrame, least: DataFrame, hubs: DataFrame) -> DataFrame:
    """ends(a, b) with the m of least(a, m); hubs(a, m), of which there are few, are looked up where their ends lie, so none is dealt to one task."""
    at = ends.join(F.broadcast(hubs), "a", "left")
    return at.where("m is not null").unionByName(at.where("m is null").drop("m").join(least, "a"))


def _are_stars(links: DataFrame) -> bool:
    """If every node of links(a, b) is linked to one other as its a, and no b is linked on."""
    roles = links.select(F.col("a").alias("id"), F.lit(1).alias("on"), F.lit(0).alias("centre")).unionByName(links.select(F.col("b").alias("id"), F.lit(0).alias("on"), F.lit(1).alias("centre")))
    return roles.groupBy("id").agg(F.sum("on").alias("on"), F.max("centre").alias("centre")).where('"on" > 1 or ("on" = 1 and centre = 1)'.replace('"', "`")).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges(a, b): the smallest node reachable.

    Alternates large-star and small-star steps until all links are stars around their smallest node. Each step is one grouped minimum, combined before its
    shuffle, and one join back; nothing is gathered per node, and each round is written to the
    shared folder. A hub has more than a thousandth of the edges' number as its degree (64 at least), so there are 2,000 of them at most,
    and these are broadcast. Self-links and repeated links are harmless; null ends are ignored.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = stored(edges.where("a is not null and b is not null and a <> b").select(high.alias("a"), low.alias("b")).distinct())
    while not _are_stars(now):
        hub = F.col("n") > max(64, now.count() // 1000)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _with_least(both.where("b > a"), least.drop("n"), least.where(hub).drop("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least.drop("n"), least.where(hub).drop("n")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = stored(small)
        drop_stored(now)
        now = new
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
