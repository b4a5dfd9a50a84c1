"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.common import connected_components, local_components, stored, unused, without

COSINE = 0.93
#: Chance that no pass brings an isolated pair at the least cosine together; the number of passes follows from it and from the largest label.
MISS = 0.001
#: Bits that are concatenated in each pass, neighbours compared after each vector, and vectors of a tile.
CODE_BITS, WINDOW, TILE, SEED = 48, 64, 2048, 20240229
#: Passes compare 16-bit components; a product of unit vectors is off by 2**-10 at most, and a little for components near zero.
SLACK = 0.002


def passes_for(n: int, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at ``cosine`` among n vectors of one label has been missed with chance ``miss``.

    Two sorted codes whose first log2(n / window) bits are equal are about ``window`` apart at most; a random hyperplane gives both ends of the pair one sign with chance 1 - angle / pi.
    """
    alike = (1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi) ** max(1.0, math.log2(max(2, n) / window) + 1)
    return 1 if alike >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - alike)))


def _unit(rows: list[list[float]]) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(passes: int, code_bits: int):
    """(turn, group, code, rep, unit) of each class in each pass; the unit vector has 16-bit components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(code_bits, dtype=np.int64)[::-1]
        planes: dict[tuple[int, int], np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                dims = np.array([len(v) for v in b.column("vector")])
                for d in np.unique(dims).tolist():
                    part = b.take(pa.array(np.flatnonzero(dims == d)))
                    x = _unit(part.column("vector").to_pylist())
                    unit = pa.array([r.tobytes() for r in x.astype("<f2")], pa.binary())
                    for p in range(passes):
                        if (p, d) not in planes:
                            planes[p, d] = np.random.default_rng([SEED, d, p]).standard_normal((d, code_bits))
                        code = ((x @ planes[p, d]) > 0) @ powers
                        yield pa.record_batch([pa.array(np.full(len(x), p, np.int32)), part.column("group"), pa.array(code), part.column("rep"), unit], names=["turn", "group", "code", "rep", "unit"])

    return run


def _neighbours(cosine: float, window: int):
    """Over sorted partitions: candidate links of each vector with the next ``window``, cut down to a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        ends: list[np.ndarray] = []
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                b = whole.slice(at, 4000)
                now = pa.Table.from_batches([b] if rest is None else [rest, b]).combine_chunks()
                group = np.stack([now.column(c).to_numpy() for c in ("turn", "group")])
                rep = now.column("rep").to_numpy()
                units = now.column("unit").to_pylist()
                dims = np.array([len(u) // 2 for u in units])
                x = np.zeros((len(rep), int(dims.max())), np.float32)
                for d in np.unique(dims):
                    own = np.flatnonzero(dims == d)
                    x[own, :d] = np.frombuffer(b"".join(units[i] for i in own), "<f2").reshape(-1, d)
                for k in range(1, min(window, len(rep) - 1) + 1):
                    same = (group[:, k:] == group[:, :-k]).all(0)
                    near = np.flatnonzero(same & (np.einsum("ij,ij->i", x[k:], x[:-k]) >= cosine - SLACK))
                    ends.append(np.stack([rep[near], rep[near + k]]))
                rest = now.slice(max(0, len(rep) - window)).to_batches()[0] if len(rep) else rest
                a, c = local_components(*np.concatenate(ends, axis=1)) if ends else (np.zeros(0, np.int64),) * 2
                ends = [np.stack([a[a != c], c[a != c]])]
        if ends and ends[0].shape[1]:
            yield pa.record_batch([pa.array(ends[0][0]), pa.array(ends[0][1])], names=["a", "b"])

    return run


def _tile(cosine: float):
    """Of two parts of a candidate component: (rep, n) with the links of each vector to the other part, and (a, b) with a forest of the links."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        part, rep, n = (table.column(c).to_numpy() for c in ("part", "rep", "n"))
        label = np.unique(table.column("label").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
        rows = table.column("vector").to_pylist()
        dims = np.array([len(v) for v in rows])
        found = np.zeros(len(rep), np.int64)
        ends: list[np.ndarray] = []
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            x = _unit([rows[k] for k in own])
            a, b = np.flatnonzero(part[own] == i), np.flatnonzero(part[own] == j)
            near = (x[a] @ x[b].T >= cosine) & (rep[own][a][:, None] != rep[own][b][None, :]) & (label[own][a][:, None] == label[own][b][None, :])
            found[own[a]] += near @ n[own][b]
            if i != j:
                found[own[b]] += near.T @ n[own][a]
            left, right = np.nonzero(near)
            ends.append(np.stack([rep[own[a[left]]], rep[own[b[right]]]]))
        nodes, roots = local_components(*np.concatenate(ends, axis=1))
        keep = nodes != roots
        counts = pa.table({"rep": rep, "n": found, "a": pa.nulls(len(rep), pa.int64()), "b": pa.nulls(len(rep), pa.int64())})
        forest = pa.table({"rep": pa.nulls(int(keep.sum()), pa.int64()), "n": pa.nulls(int(keep.sum()), pa.int64()), "a": nodes[keep], "b": roots[keep]})
        return pa.concat_tables([counts, forest])

    return run


def link_embeddings(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, window: int = WINDOW, tile: int = TILE) -> DataFrame:
    """vectors with ``n_links``, ``component_id`` and ``kept``.

    Rows with one label and vector are one class. In each pass the classes are ordered by label and a
    code of concatenated random hyperplane signs and compared with the next ``window`` of them; there are as many passes
    as the largest label needs for the chance ``miss`` of losing an isolated pair (a border between two sorted partitions
    hides at most ``window`` classes on each side in one pass). The candidates of all passes, compared with some slack, are
    united. Inside each united group all links are then counted in double precision, in tiles of two parts, so that none is lost
    however large the group, and the links found make the components. Defined cases: a vector that is null, empty, zero or holds a null or
    non-finite component, or whose label or vec_id is null, links with nothing (component_id is its
    vec_id); vectors of unlike length never link; repeated rows are one vector and give repeated rows; of equal vectors the smallest vec_id
    is kept; columns named like the new ones are replaced, all others are carried; an empty table gives an empty one.
    """
    vectors = without(vectors, "n_links", "component_id", "kept")
    v, k1, k2, c1, c2 = unused(vectors, "v", "k1", "k2", "c1", "c2")
    keyed = vectors.withColumn(v, F.col("embedding").cast("array<double>"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.expr(f"coalesce(exists(`{v}`, x -> x <> 0) and not exists(`{v}`, x -> x is null or isnan(x) or abs(x) = double('infinity')), false)")
    keyed = keyed.withColumn(k1, F.when(sound, F.xxhash64("label", v))).withColumn(k2, F.when(sound, F.xxhash64(v, "label", F.lit(1))))
    one = keyed.where(F.col(k1).isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col(v).alias("vector"), F.col(k1).alias("k1"), F.col(k2).alias("k2"))
    classes = stored(one.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n"), F.first("vector").alias("vector")))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    passes = passes_for(largest, cosine, window, miss)
    coded = classes.select(F.xxhash64("label", F.size("vector")).alias("group"), "rep", "vector").mapInArrow(_coded(passes, CODE_BITS), "turn int, group long, code long, rep long, unit binary")
    order = ["turn", "group", "code", "rep"]
    links = coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(cosine, window), "a long, b long")
    united = stored(connected_components(links))
    members = classes.join(united, classes["rep"] == united["id"]).select("component", "label", "rep", "n", "vector")
    sizes = united.groupBy("component").agg(F.ceil(F.count("*") / tile).cast("int").alias("k"))
    members = members.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "label", "rep", "n", "vector")
    # dealt by all three, or a large component's tiles would stay in the task that the join put it in
    tiles = stored(dealt.repartition("component", "i", "j").groupBy("component", "i", "j").applyInArrow(_tile(cosine), "rep long, n long, a long, b long"))
    reach = connected_components(tiles.where("a is not null").select("a", "b"))
    counted = tiles.where("rep is not null").groupBy("rep").agg(F.sum("n").alias("more"))
    per_class = classes.select(F.col("k1").alias(c1), F.col("k2").alias(c2), "rep", "n").join(counted, "rep", "left").join(reach, F.col("rep") == reach["id"], "left")
    per_class = per_class.select(c1, c2, (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keyed.join(per_class, (keyed[k1] == per_class[c1]) & (keyed[k2] == per_class[c2]), "left").drop(v, k1, k2, c1, c2)
    out = out.withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component_id": F.coalesce("component_id", F.col("vec_id").cast("long"))})
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
