"""SimHash near-duplicates by covering anchors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.common import connected_components, local_components, long_array, stored, texts, unused

SHINGLE, BITS, SEED = 4, 4, 42
#: First bit and width of each block. Two fingerprints within 4 bits differ by one bit at most in one of three blocks.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints of one anchor that are compared in one tile, and pairs held at a time.
TILE, PAIRS = 4096, 1_000_000
#: Near-duplicate documents: words of a shingle, least Jaccard similarity, chance that a pair of just that similarity meets at no anchor,
#: and bits of the sketch by which candidates are compared before their shingles are.
NEAR_SHINGLE, SIMILAR, MISS, SKETCH = 5, 0.8, 0.03, 128
#: Standard errors by which a candidate's sketch may differ more than that of the least similarity, documents of a tile whose shingles are compared, and shingles at a time.
ERRORS, DOCS, COLUMNS = 3, 512, 4096


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 hashes of all word shingles. bytes.lower() and .split() know ASCII alone."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        counts += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row for each of docs; null text is empty text, whose fingerprint is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, shingle) for x in texts(b.column("text"))], np.uint64)
            yield pa.record_batch([b.column("doc_id"), long_array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Syndrome of the low 15 bits under the [15,11] Hamming code: the XOR of the positions of its ones."""
    s = np.zeros(x.shape, np.int64)
    for i in range(15):
        s ^= ((x >> i) & 1) * (i + 1)
    return s


def _steps(width: int) -> list[np.ndarray]:
    """For each syndrome, what leads from a word to all code words within distance two of it.

    The code joins the [15,11] Hamming code with all words of the other bits. It is perfect: each word
    is within radius one of exactly one code word, its home. Two words that differ in one bit at most
    are then both within two bits of each other's home.
    """
    single = [1 << i for i in range(width)]
    reach = np.array([0, *single, *(a | b for i, a in enumerate(single) for b in single[:i])], np.int64)
    s = _syndrome(reach)
    return [reach[s == k] for k in range(16)]


def anchored(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, home) of the words of one block: every anchor that each word goes to, and if it is the word's own."""
    anchors, rows, homes = [], [], []
    s = _syndrome(words)
    home = np.where(s > 0, words ^ (1 << np.maximum(s - 1, 0)), words)
    for v, steps in enumerate(_steps(width)):
        at = np.flatnonzero(s == v)
        a = words[at][:, None] ^ steps[None, :]
        anchors.append(a.ravel())
        rows.append(np.repeat(at, len(steps)))
        homes.append((a == home[at][:, None]).ravel())
    return np.concatenate(anchors), np.concatenate(rows), np.concatenate(homes)


def _meetings(group: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the homes and of all rows of their group, the rows being sorted by group; a bounded number of pairs at a time."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    lengths = np.diff(np.append(starts, len(group)))
    number = np.repeat(np.arange(len(starts)), lengths)
    own = np.flatnonzero(home)
    total = np.concatenate([[0], np.cumsum(lengths[number[own]])])
    at = 0
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        h = own[at:to]
        n = lengths[number[h]]
        left = np.repeat(h, n)
        yield left, np.repeat(starts[number[h]], n) + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        at = to


def _tiles(compare: Callable[[dict, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]):
    """Over partitions sorted by group: the links that compare finds, cut down to a forest before they leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        rest: dict[str, np.ndarray] | None = None

        def take(rows: dict[str, np.ndarray]) -> None:
            nonlocal held, size
            for left, right in _meetings(rows["group"], rows["home"]):
                held.append(compare(rows, left, right))
                size += len(held[-1][0])
                if size > 4 * PAIRS:
                    held = [_forest(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0])

        for b in batches:
            got = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
            if rest is not None:
                got = {c: np.concatenate([rest[c], x]) for c, x in got.items()}
            to = int(np.searchsorted(got["group"], got["group"][-1])) if len(got["group"]) else 0  # the last group may go on
            if to:
                take({c: x[:to] for c, x in got.items()})
            rest = {c: x[to:] for c, x in got.items()}
        if rest is not None and len(rest["group"]):
            take(rest)
        if size:
            a, b = _forest(*(np.concatenate(x) for x in zip(*held)))
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, roots = local_components(a, b)
    keep = nodes != roots
    return nodes[keep], roots[keep]


def _dealt(rows: DataFrame, name: str, tile: int) -> DataFrame:
    """rows(anchor, home, name, ...) with their group instead of the anchor, dealt out and sorted by it.

    An anchor with more than ``tile`` rows becomes tiles (i, j) of the homes of part i against all of part j, so that no task holds it whole.
    """
    counts = rows.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    hot = stored(counts.select("anchor", F.ceil(F.col("n") / tile).cast("int").alias("k")))
    others = [c for c in rows.columns if c not in ("anchor", "home")]
    if hot.isEmpty():
        dealt = rows.withColumnRenamed("anchor", "group")
    else:
        k = F.coalesce("k", F.lit(1))
        parted = rows.join(hot, "anchor", "left").withColumns({"k": k, "part": F.pmod(F.xxhash64(name, F.lit("tile")), k).cast("long")})
        every = parted.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1)))
        homes = every.where("home").select(F.xxhash64("anchor", F.col("part").alias("i"), F.col("other").alias("j")).alias("group"), F.lit(True).alias("home"), *others)
        rest = every.select(F.xxhash64("anchor", F.col("other").alias("i"), F.col("part").alias("j")).alias("group"), F.lit(False).alias("home"), *others)
        dealt = homes.unionByName(rest)
    return dealt.repartition("group").sortWithinPartitions("group")


def near_fingerprints(fps: DataFrame, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints fps(fp) within ``bits`` of each other: a forest of them in each task.

    Every fingerprint goes to each anchor within the covering radius plus threshold of each block and is
    compared with those whose home the anchor is.
    """
    if bits > 4:
        raise ValueError("three blocks cover 4 differing bits at most")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                fp = whole.slice(i, 4096).column("fp").to_numpy().view(np.uint64)
                for k, (first, width) in enumerate(BLOCKS):
                    word = ((fp >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
                    anchor, row, home = anchored(word, width)
                    yield pa.record_batch([pa.array(anchor | (k << 24)), long_array(fp[row]), pa.array(home)], names=["anchor", "fp", "home"])

    def compare(rows: dict, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp = rows["fp"].view(np.uint64)
        apart = np.bitwise_count(fp[left] ^ fp[right])
        keep = (apart <= bits) & (apart > 0)
        return rows["fp"][left[keep]], rows["fp"][right[keep]]

    rows = fps.mapInArrow(spread, "anchor long, fp long, home boolean")
    return _dealt(rows, "fp", tile).mapInArrow(_tiles(compare), "a long, b long")


def simhash_components(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id), one row for each of docs.

    Documents with one fingerprint are one class; classes are linked, not their copies. Defined cases:
    null or empty text has fingerprint zero and is linked like any other; texts of fewer words than a
    shingle have their whole word sequence as the only one; a null doc_id is in a class but never its
    component_id, which is null only where all of a component are; repeated rows give repeated rows; an
    empty table gives an empty one.
    """
    own = stored(fingerprints(docs, shingle))
    classes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = near_fingerprints(classes.select("fp"), bits, tile)
    reach = connected_components(links)
    joined = classes.join(reach, classes["fp"] == reach["id"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = joined.select("fp", "root").join(least, "root").select("fp", "component_id")
    return own.join(labels, "fp").select("doc_id", "fp", "component_id")


def shingles(text: str, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all word shingles. bytes.lower() and .split() know ASCII alone, as in the fingerprints."""
    words = text.encode().lower().split()
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n))


def wide_fingerprint(h: np.ndarray, n_bits: int) -> np.ndarray:
    """Majority bits of the hashes h, as many as are asked for, as 0 and 1; each 64 of them come from another mixing of the hashes."""
    counts = np.zeros(-(-n_bits // 64) * 64, np.int64)
    for at in range(0, len(h), 8192):
        for k in range(len(counts) // 64):
            x = (h[at : at + 8192] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
            counts[64 * k : 64 * k + 64] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return (2 * counts > len(h)).astype(np.uint8)[:n_bits]


def blocks_for(n: int, similar: float = SIMILAR, miss: float = MISS) -> tuple[int, int, float]:
    """(blocks, bits of each, share of differing bits): of fingerprints of n documents, so that a pair of the least similarity meets but for the chance ``miss``.

    Sets of one size and Jaccard similarity s have vectors at the angle acos(2 s / (1 + s)), of which a bit differs with chance angle / pi. A block meets if it
    differs in one bit at most. Its width grows with n, so that the documents of an anchor stay a few dozens.
    """
    width = min(40, max(15, math.ceil(math.log2(max(2, n))) - 2))
    p = math.acos(2 * similar / (1 + similar)) / math.pi
    meet = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    return (1 if meet >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - meet)))), width, p


def _jaccard_tile(similar: float):
    """Of two parts of a candidate group: a forest of the links between documents of either, by the sizes of their shared shingles."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        part, ids = (table.column(c).to_numpy() for c in ("part", "id"))
        own = table.column("own").combine_chunks()
        lengths = own.value_lengths().to_numpy()
        _, column, times = np.unique(own.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(ids)), lengths)
        again = times > 1  # a shingle of one document is shared with none
        number = np.cumsum(again) - 1
        keep = again[column]
        row, column = row[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        a, b = np.flatnonzero(part == i), np.flatnonzero(part == j)
        shared = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, int(again.sum()), COLUMNS):
            lo, hi = np.searchsorted(column, [at, at + COLUMNS])
            x = np.zeros((len(ids), COLUMNS), np.float32)
            x[row[lo:hi], column[lo:hi] - at] = 1
            shared += x[a] @ x[b].T
        shared = shared.astype(np.float64)
        linked = (shared >= similar * (lengths[a][:, None] + lengths[b][None, :] - shared)) & (ids[a][:, None] != ids[b][None, :])
        left, right = np.nonzero(linked)
        nodes, roots = _forest(ids[a[left]], ids[b[right]])
        return pa.table({"a": nodes, "b": roots})

    return run


def near_documents(docs: DataFrame, similar: float = SIMILAR, shingle: int = NEAR_SHINGLE, miss: float = MISS, tile: int = TILE, tile_docs: int = DOCS) -> DataFrame:
    """(doc_id, component_id): the documents that are not the first of their component of verified links.

    Texts with one set of shingles are one class, named by its smallest doc_id; classes are linked, not their copies. A fingerprint of the
    set is long enough for a number of blocks, in each of which it goes to the anchors of a covering code as in ``near_fingerprints``;
    classes that meet at an anchor and whose sketches are close are candidates. Each task sends a forest of its candidates on, and these
    are united. Inside each united group the shingles of all documents are then compared, in tiles of two parts of the group, and a
    link is a Jaccard similarity of ``similar`` or more. No anchor and no group is cut, and no list of pairs leaves a task.

    Defined cases: null text is empty text; a text of fewer words than a shingle is one shingle; a text of any length is read whole; a null doc_id is in no class; repeated rows are
    one document; a doc_id with unlike texts is in the component of each, the smallest counting; an empty table gives an empty one.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks, width, p = blocks_for(rows.count(), similar, miss)
    sketch = min(SKETCH, blocks * width)
    limit = math.floor(sketch * p + ERRORS * math.sqrt(sketch * p * (1 - p)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(x, shingle) for x in texts(b.column("text"))]
            fps = [np.packbits(wide_fingerprint(h, blocks * width), bitorder="little").tobytes() for h in found]
            yield pa.record_batch([b.column("doc_id"), pa.array([xxhash.xxh128_digest(h.tobytes()) for h in found], pa.binary()), pa.array(fps, pa.binary())], names=["doc_id", "digest", "fp"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(width, dtype=np.int64)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                ids = b.column("least").to_numpy()
                packed = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(len(ids), -1)
                bits = np.unpackbits(packed, axis=1, bitorder="little")[:, : blocks * width]
                first = np.zeros((len(ids), 128), np.uint8)
                first[:, :sketch] = bits[:, :sketch]
                s = np.packbits(first, axis=1, bitorder="little").view("<i8")
                for k in range(blocks):
                    anchor, row, home = anchored(bits[:, k * width : (k + 1) * width] @ powers, width)
                    yield pa.record_batch([pa.array(anchor | (k << 48)), pa.array(ids[row]), pa.array(s[row, 0]), pa.array(s[row, 1]), pa.array(home)], names=["anchor", "id", "s0", "s1", "home"])

    def compare(r: dict, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = sum(np.bitwise_count((r[c][left] ^ r[c][right]).view(np.uint64)).astype(np.int16) for c in ("s0", "s1"))
        keep = (apart <= limit) & (r["id"][left] != r["id"][right])
        return r["id"][left[keep]], r["id"][right[keep]]

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(x, shingle) for x in texts(b.column("text"))]
            yield pa.record_batch([b.column("doc_id"), pa.array([xxhash.xxh128_digest(h.tobytes()) for h in found], pa.binary()), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], names=["doc_id", "digest", "own"])

    signed = stored(rows.mapInArrow(sign, "doc_id long, digest binary, fp binary"))
    classes = stored(signed.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp")))
    anchors = classes.select("least", "fp").mapInArrow(spread, "anchor long, id long, s0 long, s1 long, home boolean")
    united = stored(connected_components(_dealt(anchors, "id", tile).mapInArrow(_tiles(compare), "a long, b long")))
    sizes = united.groupBy("component").agg(F.ceil(F.count("*") / tile_docs).cast("int").alias("k"))
    wanted = stored(classes.select("digest", F.col("least").alias("doc_id")).join(united.join(sizes, "component"), F.col("doc_id") == F.col("id")).select("doc_id", "digest", "component", "k"))
    # a doc_id may stand in several rows of unlike text, so the digest is compared too
    found = rows.join(wanted.select("doc_id"), "doc_id", "left_semi").mapInArrow(shingled, "doc_id long, digest binary, own array<long>")
    members = found.join(wanted, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", F.col("doc_id").alias("id"), "own")
    links = stored(dealt.repartition("component", "i", "j").groupBy("component", "i", "j").applyInArrow(_jaccard_tile(similar), "a long, b long"))
    reach = connected_components(links)
    copies = signed.join(classes.select("digest", "least"), "digest").select("doc_id", "least")
    labelled = copies.join(reach, copies["least"] == reach["id"], "left").select("doc_id", F.coalesce("component", "least").alias("component_id"))
    return labelled.where("doc_id <> component_id").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def _first_only(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the doc_ids of gone, each text of a doc_id once."""
    (name,) = unused(docs, "gone")
    gone = stored(gone.select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti").dropDuplicates(["doc_id", "text"])


def dedup_near(docs: DataFrame, similar: float = SIMILAR, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """One document of each component of ``near_documents`` stays: the one with its smallest doc_id. A row with a null doc_id stays; a repeated row stays once."""
    return _first_only(docs, near_documents(docs, similar, shingle))


def dedup_simhash(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component of fingerprints stays: the one with its smallest doc_id. A row with a null doc_id stays; a repeated row stays once."""
    return _first_only(docs, simhash_components(docs, bits, shingle).where("doc_id <> component_id"))
