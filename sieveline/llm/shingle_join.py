"""All pairs of texts whose sets of word shingles have a Jaccard similarity of at least 0.8, linked exactly.

A prefix filter finds them: in one order of all shingles, two such sets share one among the first n - ceil(0.8 n) + 1 of
each. The order puts shingles first that few texts have, as estimated by a sketch of counters over all texts; any order
gives the same links, and this one keeps what many texts share out of the prefixes. A shingle that the sketch counts
once is in no other text and keys nothing. Places in the order and the parities of 1,024 classes of hashes bound how
much two sets can share; candidates within these bounds are verified by the whole sets. Components that are linked need
no further pairs, so rounds start with few pairs for each text and end with all that are left between components.
Shingles are equal by a 64-bit hash.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm._shared import BLOCK_ROWS, comparison_units, components, mapped, packed, partitions, runs_of, scratch, unpacked, work_path, written

SHINGLE_WORDS = 5
#: Pairs are near at NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 4, 5
#: Counters of the sketch for each slice, and at most (executors map a byte each; beyond, the order is coarser and the links are the same).
SLICE_BITS, MOST_BITS = 22, 33
BYTES_PER_SHINGLE = 6
#: Shingles that a task holds at once.
SHINGLES_AT_ONCE = 500_000
#: Classes of hashes whose parities are kept.
CLASSES = 1024
#: Sets that a task remembers while it verifies.
REMEMBERED = 64
_STEP = np.uint64(0x9E3779B97F4A7C13)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The ascending distinct hashes of a text's word shingles; one for fewer words, none for none."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.empty(0, np.uint64)
    w = np.array(list(map(xxhash.xxh64_intdigest, split)), np.uint64)
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        h = h * _STEP + w[j : len(w) - size + 1 + j]
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return np.unique(h ^ (h >> np.uint64(33)))


def parities(h: np.ndarray) -> bytes:
    """A bit for each class of hashes: whether the set has an odd number of them. Sets differ by as many members at least as bits."""
    odd = np.bincount((h & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have at least the similarity asked for."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DENOMINATOR >= NUMERATOR * (len(a) + len(b) - both)


def _some(batch: pa.RecordBatch, column: int, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of a batch's rows, by their first, as sets of a bounded size together (a larger one stands alone)."""
    first, held, total = 0, [], 0
    for i, text in enumerate(batch.column(column)):
        h = shingles(text.as_py(), words)
        if total and total + len(h) > SHINGLES_AT_ONCE:
            yield first, held
            first, held, total = i, [], 0
        held.append(h)
        total += len(h)
    if held:
        yield first, held


def _sketched(words: int, bits: int):
    """Rows (slice, at, n): counters of a slice and how many of a part's sets hold a shingle that falls there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _some(batch, 0, words):
                at, n = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True)
                at = at.astype(np.int64)
                found = [(s, packed(at[x:y] & ((1 << SLICE_BITS) - 1)), pa.compress(n[x:y].astype("<u4").tobytes(), "zstd", asbytes=True)) for s, x, y in runs_of(at >> SLICE_BITS)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.binary())], names=["slice", "at", "n"])

    return run


def _merged(folder: str):
    """Writes the logarithms of the summed counters, a file for each slice, and tells the slices; a repeated task writes the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        now, sums = None, None

        def told() -> pa.RecordBatch:
            name = f"{root}/{now}-{uuid.uuid4().hex}"
            with fs.open_output_stream(name, compression=None) as out:
                out.write(np.minimum(255, np.rint(8 * np.log2(np.maximum(1, sums)))).astype(np.uint8).tobytes())
            fs.move(name, f"{root}/{now}")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32())], names=["slice"])

        for batch in batches:
            for s, a, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if s != now:
                    if now is not None:
                        yield told()
                    now, sums = s, np.zeros(1 << SLICE_BITS, np.uint32)
                at = unpacked(a.as_py())
                sums[at] += np.frombuffer(pa.decompress(n.as_py(), 4 * len(at), "zstd", asbytes=True), "<u4")
        if now is not None:
            yield told()

    return run


class Rarity:
    """Logarithms of how many texts have a shingle, never too small; 0 tells that one text has it. Slices are mapped when they are needed."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.slices = folder, bits, {}

    def of(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        part = (at >> SLICE_BITS).astype(np.uint16)
        order, out = np.argsort(part, kind="stable"), np.zeros(len(h), np.uint8)
        for s, x, y in runs_of(part[order]):
            if s not in self.slices:
                self.slices[s] = mapped(f"{self.folder}/{s}")
            out[order[x:y]] = self.slices[s][at[order[x:y]] & ((1 << SLICE_BITS) - 1)]
        return out


def _prefixes(words: int, bits: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = Rarity(folder, bits)
        for batch in batches:
            for first, sets in _some(batch, 1, words):
                rare = np.split(rarity.of(np.concatenate(sets)), np.cumsum([len(h) for h in sets])[:-1])
                out: list[tuple] = []
                for h, r in zip(sets, rare):
                    order = np.argsort(r, kind="stable")[: len(h) - -(-NUMERATOR * len(h) // DENOMINATOR) + 1 if len(h) else 0]
                    at = np.flatnonzero(r[order] > 0)
                    out.append((xxhash.xxh64_intdigest(h.tobytes()), len(h), int((r == 0).sum()), parities(h), at, h[order[at]].view(np.int64)))
                digests, sizes, own, odd, at, keys = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(own, pa.int32()), pa.array(odd, pa.binary()), pa.array(at, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))],
                    names=["node", "digest", "n", "own", "odd", "at", "key"],
                )

    return run


def _possible(t: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether two sets can be near that share a shingle at these places of theirs and differ by so many parities."""
    n, at = t["n"], t["at"]
    both, left = n[i] + n[j], np.minimum(n[i] - at[i], n[j] - at[j])
    ok = (left * (NUMERATOR + DENOMINATOR) >= NUMERATOR * both) & (t["group"][i] != t["group"][j])
    if t["low"][0] != t["high"][0]:
        ok &= t["block"][i] != t["block"][j]
    at = np.flatnonzero(ok)
    ok[at] = _apart(t, i[at], j[at]) * (NUMERATOR + DENOMINATOR) <= (DENOMINATOR - NUMERATOR) * both[at]
    return ok


def _apart(t: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(t["odd"][i] ^ t["odd"][j]).sum(axis=1, dtype=np.int64)


def _star(t: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The set that least of is its own with all others, and each with the next by size."""
    m = len(t["n"])
    hub, rows = int((t["own"] / np.maximum(1, t["n"])).argmin()), np.arange(m)
    for i, j in ((np.full(m - 1, hub), np.delete(rows, hub)), (rows[:-1], rows[1:])):
        ok = _possible(t, i, j)
        yield i[ok], j[ok]


def _all(t: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs that can be near; the sets that can be near to one are a run behind it, as they ascend by size."""
    n = t["n"]
    ends = np.searchsorted(n, n * DENOMINATOR // NUMERATOR, "right")
    for s in range(len(n) - 1):
        j = np.arange(s + 1, ends[s])
        ok = _possible(t, np.full(len(j), s), j)
        if ok.any():
            yield np.full(int(ok.sum()), s), j[ok]


def _best(t: dict[str, np.ndarray], at_once: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of all pairs that can be near the closest one for each two groups."""
    held: list[np.ndarray] = []

    def least() -> np.ndarray:
        i, j = np.concatenate(held, axis=1)
        g, k = t["group"][i], t["group"][j]
        g, k = np.minimum(g, k), np.maximum(g, k)
        order = np.lexsort((_apart(t, i, j) / (t["n"][i] + t["n"][j]), k, g))
        g, k = g[order], k[order]
        new = order[np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])]
        return np.stack([i[new], j[new]])

    size = 0
    for i, j in _all(t):
        held.append(np.stack([i, j]))
        size += len(i)
        if size > at_once:
            held = [least()]
            size = 0
    if held:
        yield tuple(least())


ROUNDS = {"star": _star, "best": _best, "all": _all}


def _candidates(kind: str):
    """Pairs of different groups of each unit, whose rows follow one another by size; a pair once for each part of a task's work."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    names = ("key", "low", "high", "block", "node", "n", "own", "at", "group")
    chosen = ROUNDS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[np.ndarray] = []
        size = 0

        def told() -> pa.RecordBatch:
            nonlocal size
            found = np.unique(np.concatenate(out), axis=0)
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=schema)

        def compare(parts: list[dict]) -> Iterator[pa.RecordBatch]:
            nonlocal size
            t = {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}
            new = np.concatenate([[True], (t["key"][1:] != t["key"][:-1]) | (t["low"][1:] != t["low"][:-1]) | (t["high"][1:] != t["high"][:-1])])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(new)))
            for s, m in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                unit = {k: v[s : s + m] for k, v in t.items()}
                if (unit["group"] == unit["group"][0]).all():
                    continue
                for i, j in chosen(unit):
                    a, b = unit["node"][i], unit["node"][j]
                    out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
                    size += len(a)
                    if size > 1_000_000:
                        yield told()

        for batch in batches:
            now = {k: batch.column(k).to_numpy().astype(np.int64) for k in names}
            now["odd"] = np.frombuffer(b"".join(batch.column("odd").to_pylist()), np.uint64).reshape(len(batch), -1)
            last = np.flatnonzero((now["key"] != now["key"][-1]) | (now["low"] != now["low"][-1]) | (now["high"] != now["high"][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                held.append({k: v[:cut] for k, v in now.items()})
                yield from compare(held)
                held = []
            held.append({k: v[cut:] for k, v in now.items()})
        if held:
            yield from compare(held)
        if out:
            yield told()

    return run


def _verified(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in known:
                known[node] = shingles(text.as_py(), words)
                if len(known) > REMEMBERED:
                    known.popitem(last=False)
            known.move_to_end(node)
            return known[node]

        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            ok = [near(of(x, t), of(y, u)) for x, y, t, u in zip(a.to_pylist(), b.to_pylist(), batch.column("a_text"), batch.column("b_text"))]
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok, pa.bool_())), b.filter(pa.array(ok, pa.bool_()))], names=["src", "dst"])

    return run


def near_copies(docs: DataFrame, key_col: str, text_col: str = "text", words: int = SHINGLE_WORDS, block_rows: int = BLOCK_ROWS, propose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key_col, component) for each distinct key: keys whose texts are linked by near pairs share a component.

    ``key_col`` is a long, not null; rows that repeat a key have the same text. Texts without words are copies of each
    other and of nothing else; null counts as empty; an empty table gives an empty result. Further columns are ignored.
    ``propose`` gets (node, text) of the texts that share a prefix, one for each set of shingles, and returns pairs
    (a, b) of nodes that may be near. These are verified first and spare the rounds the pairs that they connect; the
    result is the same without. It is a table of its own; all that led to it is deleted.
    """
    spark = docs.sparkSession
    result = work_path(spark, "near-copies")
    rows = docs.select(F.col(key_col).alias("node"), F.col(text_col).cast("string").alias("text"))
    with scratch(spark):
        return written(_near_copies(rows, words, block_rows, propose).withColumnRenamed("node", key_col), "", result)


def _near_copies(rows: DataFrame, words: int, block_rows: int, propose: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(SLICE_BITS, (total // BYTES_PER_SHINGLE).bit_length()))
    folder = work_path(spark, "rarity")
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    parts = rows.select("text").mapInArrow(_sketched(words, bits), "slice int, at binary, n binary")
    parts.repartition(partitions(spark), "slice").sortWithinPartitions("slice").mapInArrow(_merged(folder), "slice int").agg(F.count(F.lit(1))).collect()
    sets = written(rows.mapInArrow(_prefixes(words, bits, folder), "node long, digest long, n int, own int, odd binary, at array<int>, key array<long>"), "sets")
    firsts = written(sets.groupBy("digest").agg(F.min("node").alias("node")), "firsts")
    distinct = written(sets.join(firsts.select("node"), "node", "left_semi").dropDuplicates(["node"]).drop("digest"), "distinct")
    every = distinct.select("node", F.explode(F.arrays_zip("at", "key")).alias("k")).select("node", "k.at", "k.key")
    shared = written(every.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key"), "shared")
    met = written(every.join(shared, "key", "left_semi"), "met")
    texts = written(rows.join(met.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "texts")
    traits = distinct.select("node", "n", "own", "odd")
    none = spark.createDataFrame([], "src long, dst long")

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        pairs = written(pairs.distinct(), "pairs")
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
        return written(both.select("a", "b", "a_text", "b_text").mapInArrow(_verified(words), "src long, dst long"), name)

    def round_of(kind: str, found: DataFrame) -> DataFrame:
        """The near pairs of a round, between what is not yet linked by ``found``."""
        grouped = met.join(found, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
        if kind == "star":  # a text's rarest shingle that another has: few pairs, which link most of what is near
            first = grouped.groupBy("node", "group").agg(F.min(F.struct("at", "key")).alias("k"))
            grouped = first.select("node", "k.at", "k.key", "group")
        grouped = written(grouped, "grouped")
        alive = written(grouped.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x < y").select("key"), "alive")
        if alive.isEmpty():
            return none
        units = comparison_units(grouped.join(alive, "key", "left_semi"), "node", block_rows).join(traits, "node")
        dealt = units.repartition(partitions(spark), "key", "low", "high").sortWithinPartitions("key", "low", "high", "n", "node")
        return checked(dealt.mapInArrow(_candidates(kind), "a long, b long"), kind)

    links = checked(propose(texts), "proposed") if propose else none
    found = components(links)
    for kind in ROUNDS:
        links = links.unionByName(round_of(kind, found))
        found = components(links)
    classes = firsts.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return sets.select("node", "digest").distinct().join(classes, "digest").select("node", "component")
