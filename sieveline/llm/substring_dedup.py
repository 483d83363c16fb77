"""Substring dedup with a count-min prefilter.

First pass: every partition sketches how often it sees each window of words, as sorted counter positions; the merged
sketch overestimates the corpus's counts, so a window that it counts once occurs once. Executors merge it and write its
slices, which workers map into memory. Second pass: windows that it counts at least twice are grouped exactly by a
96-bit hash of their words' 128-bit ones and attributed to the smallest document that holds them.
A task settles what repeats among its own documents by itself and sends on one document for each window, so windows
that very many documents share never gather in one place.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm._shared import mapped, packed, partitions, runs_of, unpacked, work_path

WINDOW_WORDS = 13
DEPTH = 2
#: Counters of a sketch row for each window of the corpus, as estimated from its bytes.
COUNTERS_PER_WINDOW = 3
BYTES_PER_WORD = 6
#: Counters of a sketch row at most, which executors map (a gigabyte); beyond, the filter lets more windows through and stays exact. A counter is one bit once merged.
MOST_COUNTERS = 1 << 33
SLICE_COUNTERS = 1 << 23
#: Words that a task holds at once.
WORDS_AT_ONCE = 500_000
#: Windows of the corpus for each group of the second pass.
WINDOWS_PER_BUCKET = 1_000_000
#: Windows of the corpus for each shard of documents.
WINDOWS_PER_SHARD = 5_000_000


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def window_hashes(word_lists: list[list[bytes]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window of ``n`` words, and which list and which word of it the window starts at."""
    digest = xxhash.xxh3_128_digest
    sizes = np.array([len(w) for w in word_lists], np.int64)
    words = np.frombuffer(b"".join([digest(w) for ws in word_lists for w in ws]), "<u8").reshape(-1, 2)
    high, low = np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = np.flatnonzero(at + n <= np.repeat(sizes, sizes))
    a = np.full(len(starts), 0x9E3779B97F4A7C15, np.uint64)
    b = np.full(len(starts), 0xC2B2AE3D27D4EB4F, np.uint64)
    for j in range(n):
        a = (a ^ high[starts + j]) * np.uint64(0xFF51AFD7ED558CCD)
        a ^= a >> np.uint64(32)
        b = (b + low[starts + j]) * np.uint64(0xC4CEB9FE1A85EC53)
        b ^= b >> np.uint64(29)
    return a, b, doc[starts], at[starts]


def counters(a: np.ndarray, b: np.ndarray, width: int) -> list[np.ndarray]:
    """A position in each row of the sketch for every window."""
    return [((h >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64) for h in (a, b)][:DEPTH]


def _lists(batch: pa.RecordBatch, column: int) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Rows of a batch and their words, a bounded number of words at once (a longer document stands alone)."""
    rows: list[int] = []
    lists: list[list[bytes]] = []
    total = 0
    for i, text in enumerate(batch.column(column)):
        words = split_words(text.as_py())
        if total and total + len(words) > WORDS_AT_ONCE:
            yield rows, lists
            rows, lists, total = [], [], 0
        rows.append(i)
        lists.append(words)
        total += len(words)
    if rows:
        yield rows, lists


def _sketched(n: int, width: int):
    """Rows (slice, once, twice): positions that a part of a partition counts once, and at least twice; the former as packed differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, lists in _lists(batch, 0):
                a, b, _, _ = window_hashes(lists, n)
                for depth, positions in enumerate(counters(a, b, width)):
                    at, count = np.unique(positions, return_counts=True)
                    out: list[tuple[int, bytes, bytes]] = []
                    for s, x, y in runs_of(at // SLICE_COUNTERS):
                        low = (at[x:y] - s * SLICE_COUNTERS).astype("<u4")
                        out.append((depth << 20 | s, packed(low), low[count[x:y] > 1].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=["slice", "once", "twice"])

    return run


def _merged(folder: str):
    """Writes the bitmap of counters that reach two, a file for each slice, and tells the slices; a repeated task writes the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        now, once, twice = None, None, None

        def told() -> pa.RecordBatch:
            name = f"{root}/{now}-{uuid.uuid4().hex}"
            with fs.open_output_stream(name, compression=None) as out:
                out.write(np.packbits(twice, bitorder="little").tobytes())
            fs.move(name, f"{root}/{now}")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32())], names=["slice"])

        for batch in batches:
            for s, o, t in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if s != now:
                    if now is not None:
                        yield told()
                    now, once, twice = s, np.zeros(SLICE_COUNTERS, bool), np.zeros(SLICE_COUNTERS, bool)
                at = unpacked(o.as_py())
                twice[at[once[at]]] = True
                once[at] = True
                twice[np.frombuffer(t.as_py(), "<u4")] = True
        if now is not None:
            yield told()

    return run


def build_sketch(texts: DataFrame, n: int, width: int) -> str:
    """Sketches all windows of ``texts`` (one string column) and returns the folder of the merged bitmap's slices in the shared folder."""
    spark = texts.sparkSession
    parts = texts.mapInArrow(_sketched(n, width), "slice int, once binary, twice binary")
    folder = work_path(spark, "sketch")
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    merged = parts.repartition(partitions(spark), "slice").sortWithinPartitions("slice").mapInArrow(_merged(folder), "slice int")
    merged.agg(F.count(F.lit(1))).collect()
    return folder


class Sketch:
    """The merged bitmap, whose slices are mapped when they are needed; one that was never written counts nothing twice."""

    def __init__(self, folder: str):
        self.folder, self.slices = folder, {}
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        self.present = {f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(root))}

    def twice(self, depth: int, positions: np.ndarray) -> np.ndarray:
        """Whether each position of a sketch row counts two at least."""
        out = np.zeros(len(positions), bool)
        part = (positions // SLICE_COUNTERS).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        for s, x, y in runs_of(part[order]):
            name = str(depth << 20 | s)
            if name in self.present:
                if name not in self.slices:
                    self.slices[name] = mapped(f"{self.folder}/{name}")
                c = positions[order[x:y]] - s * SLICE_COUNTERS
                out[order[x:y]] = (self.slices[name][c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
        return out


def runs(positions: np.ndarray) -> np.ndarray:
    """Ascending positions as (first, last) pairs of unbroken runs."""
    cut = np.flatnonzero(np.diff(positions) > 1)
    return np.stack([positions[np.concatenate([[0], cut + 1])], positions[np.concatenate([cut, [len(positions) - 1]])]], axis=1).astype("<i4")


def _places(doc: np.ndarray, key: np.ndarray, at: np.ndarray, shards: int) -> tuple[list[int], list[bytes]]:
    """Starts of repeated windows as a payload for each shard of documents."""
    shard = doc % shards
    order = np.lexsort((at, key, doc, shard))
    found = [(i, order[s:e]) for i, s, e in runs_of(shard[order])]
    return [i for i, _ in found], [_payload(doc[x], key[x], at[x]) for _, x in found]


def _payload(doc: np.ndarray, key: np.ndarray, at: np.ndarray, *hashes: np.ndarray) -> bytes:
    """Windows as columns: documents and keys once each, then for every window which of them, where, and its hashes."""
    table, which = np.unique(np.stack([doc, key]), axis=1, return_inverse=True)
    return np.array([len(at), table.shape[1]], "<u4").tobytes() + table.astype("<i8").tobytes() + which.reshape(-1).astype("<u4").tobytes() + at.astype("<u4").tobytes() + b"".join(h.tobytes() for h in hashes)


def _columns(raw: bytes, *kinds: str) -> list[np.ndarray]:
    n, m = np.frombuffer(raw, "<u4", 2).tolist()
    table = np.frombuffer(raw, "<i8", 2 * m, 8).reshape(2, m)
    at = 8 + 16 * m
    which, starts = np.frombuffer(raw, "<u4", n, at), np.frombuffer(raw, "<u4", n, at + 4 * n)
    out, at = [table[0][which], table[1][which], starts.astype(np.int64)], at + 8 * n
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _smaller(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window (by its hashes), whether the same one starts in a smaller document, and whether it stands in its smallest document."""
    order = np.lexsort((doc, b, a))
    x, y, d = a[order], b[order], doc[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, bool)
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(x) else d
    repeated = np.empty(len(doc), bool)
    repeated[order] = d > least
    return repeated, ~repeated


_ROWS = "bucket int, payload binary"


def _suspects(n: int, width: int, sketch: str, buckets: int, shards: int):
    """Windows that the sketch counts twice, by bucket of their hash; settled ones have the bucket -1 - shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Sketch(sketch)
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, lists in _lists(batch, 2):
                a, b, doc, at = window_hashes(lists, n)
                keep = np.ones(len(a), bool)
                for depth, c in enumerate(counters(a, b, width)):
                    keep &= bits.twice(depth, c)
                a, b, at, row = a[keep], b[keep].astype("<u4"), at[keep], np.array(rows)[doc[keep]]
                doc, key = ids[row], keys[row]
                repeated, first = _smaller(a, b, doc)
                to, out = _places(doc[repeated], key[repeated], at[repeated], shards)
                to = [-1 - x for x in to]
                bucket = (a % np.uint64(buckets)).astype(np.int64)
                order = np.flatnonzero(first)[np.argsort(bucket[first], kind="stable")]
                for x, s, e in runs_of(bucket[order]):
                    i = order[s:e]
                    to.append(x)
                    out.append(_payload(doc[i], key[i], at[i], a[i], b[i]))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "payload"])

    return run


def _settled(shards: int, at_once: int = 2_000_000):
    """Groups the windows of each bucket exactly; rows (shard, payload) of the starts of repeated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: list[bytes] = []
        out: list[list[np.ndarray]] = []

        def rows(shard: list[int], payload: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(payload, pa.binary())], names=["shard", "payload"])

        def settle() -> None:
            doc, key, at, a, b = (np.concatenate(x) for x in zip(*(_columns(raw, "<u8", "<u4") for raw in held)))
            repeated, _ = _smaller(a, b, doc)
            out.append([doc[repeated], key[repeated], at[repeated]])

        def told() -> pa.RecordBatch:
            doc, key, at = (np.concatenate(x) for x in zip(*out))
            out.clear()
            return rows(*_places(doc, key, at, shards))

        for batch in batches:
            bucket = batch.column(0).to_numpy()
            done = np.flatnonzero(bucket < 0)
            if len(done):
                yield rows((-1 - bucket[done]).tolist(), batch.column(1).take(pa.array(done)).to_pylist())
            for i in np.flatnonzero(bucket >= 0).tolist():
                if bucket[i] != now:
                    if held:
                        settle()
                        if sum(len(x[0]) for x in out) > at_once:
                            yield told()
                    now, held = int(bucket[i]), []
                held.append(batch.column(1)[i].as_py())
        if held:
            settle()
        if out:
            yield told()

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, runs) of the documents of each shard."""
    now: int | None = None
    held: list[bytes] = []

    def told() -> pa.RecordBatch:
        doc, key, at = (np.concatenate(x) for x in zip(*map(_columns, held)))
        order = np.lexsort((at, key, doc))
        doc, key, at = doc[order], key[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
        found = [runs(np.unique(x)).tobytes() for x in np.split(at, new[1:])]
        return pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(key[new]), pa.array(found, pa.binary())], names=["doc_id", "key", "runs"])

    for batch in batches:
        for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if shard != now:
                if held:
                    yield told()
                now, held = shard, []
            held.append(raw)
    if held:
        yield told()


def _kept(n: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, found in zip(batch.column(1), batch.column(2)):
                words = split_words(text.as_py())
                gone = np.zeros(len(words) + 1, np.int32)
                if (raw := found.as_py()) is not None:
                    r = np.frombuffer(raw, "<i4").reshape(-1, 2)
                    np.add.at(gone, r[:, 0], 1)
                    np.add.at(gone, r[:, 1] + n, -1)
                covered = np.cumsum(gone[:-1]) > 0
                left = b" ".join([w for w, c in zip(words, covered.tolist()) if not c] if covered.any() else words)
                out.append((len(words), int(covered.sum()), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "surrogatepass") if with_text else None))
            columns = [batch.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string()), pa.array([o[3] for o in out], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW_WORDS, with_text: bool = True, per_window: float = COUNTERS_PER_WINDOW, most_counters: int = MOST_COUNTERS) -> DataFrame:
    """One row for each row: ``id_col``, n_words, n_removed, kept_sha256, kept (the words left, joined by one space; null without ``with_text``).

    A null, empty or blank text has no words. Rows that repeat an id are judged as parts of one document and keep a row
    each; rows whose id is null are left out; an empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    rows = rows.withColumn("key", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    windows = max(1, size // BYTES_PER_WORD)
    width = int(min(most_counters, max(SLICE_COUNTERS, windows * per_window)))
    width = -(-width // SLICE_COUNTERS) * SLICE_COUNTERS
    sketch = build_sketch(rows.select("text"), n, width)
    buckets = max(partitions(spark), -(-windows // WINDOWS_PER_BUCKET))
    shards = max(partitions(spark), -(-windows // WINDOWS_PER_SHARD))
    suspects = rows.select("doc_id", "key", "text").mapInArrow(_suspects(n, width, sketch, buckets, shards), _ROWS)
    dealt = suspects.repartition(shards, "bucket").sortWithinPartitions("bucket")
    places = dealt.mapInArrow(_settled(shards), "shard int, payload binary")
    found = places.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_gathered, "doc_id long, key long, runs binary")
    joined = rows.join(found, ["doc_id", "key"], "left").select("doc_id", "text", "runs")
    out = joined.mapInArrow(_kept(n, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.withColumnRenamed("doc_id", id_col)
