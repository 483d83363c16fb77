"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 21, 21 and 22 bits, each padded to a 23-bit word of the perfect
Golay code. A segment's keys are the codeword indices to which the words within one bit of it decode: one key, or six
for words at distance three from their codeword. Segments at most two bits apart share a key, as the word midway
between them decodes to it. Of four differing bits at most one segment can hold three or more, so two segments always
hold two or fewer: fingerprints are joined on the index pairs of two segments, and each candidate is verified exactly.

Pairs of 12-bit indices grow crowded with very many fingerprints. Then wide keys are taken: either all segments are two
bits apart at most, and share a triple of indices; or one differs by three or more, and of the others one is equal and
one within a bit, so they share the equal segment's bits with the other's index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import shingle_join
from sieveline.llm._shared import BLOCK_ROWS, comparison_units, components, delete, forest, partitions, work_path, written

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
HASH_SEED = 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Distinct fingerprints from which wide keys are taken; either kind finds every pair.
WIDE_FROM = 1 << 26
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the binary Golay code of length 23.
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for at in range(22, 10, -1):
        if word >> at & 1:
            word ^= GENERATOR << (at - 11)
    return word


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word, and the error pattern (weight three at most) of each syndrome."""
    low = np.array([_remainder(x) for x in range(1 << 12)], np.int32)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int32)
    errors = np.zeros(1 << 11, np.int32)
    bits = [1 << i for i in range(23)]
    patterns = bits + [a | b for i, a in enumerate(bits) for b in bits[i + 1 :]] + [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[i + 1 :], i + 1) for c in bits[j + 1 :]]
    for e in patterns:
        errors[low[e & 4095] ^ high[e >> 12]] = e
    return low, high, errors


_TABLES = golay_tables()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    low, high, errors = _TABLES
    return (words ^ errors[low[words & 4095] ^ high[words >> 12]]) >> 11


def segment_keys(segment: np.ndarray, bits: int) -> np.ndarray:
    """Codeword indices of each segment and of its ``bits`` neighbours; repeats are -1. Shape (rows, at most 1 + bits)."""
    flips = np.array([0, *(1 << i for i in range(bits))], np.int32)
    keys = np.sort(codeword_index(segment[:, None].astype(np.int32) ^ flips), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    keys = -np.sort(-keys, axis=1)
    return keys[:, : max(1, int((keys >= 0).sum(axis=1).max(initial=1)))]


def fuzzy_keys(fingerprints: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint (unsigned 64-bit)."""
    segments = [((fingerprints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    keys = [segment_keys(x, bits).astype(np.int64) for x, (_, bits) in zip(segments, SEGMENTS)]
    if wide:
        a, b, c = keys[0][:, :, None, None], keys[1][:, None, :, None], keys[2][:, None, None, :]
        found = [np.where((a >= 0) & (b >= 0) & (c >= 0), (a << 24) | (b << 12) | c, -1)]
        for n, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
            found.append(np.where(keys[j] >= 0, ((n + 1) << 36) | (segments[i][:, None] << 12) | keys[j], -1))
    else:
        found = []
        for n, (i, j) in enumerate(PAIRS):
            a, b = keys[i][:, :, None], keys[j][:, None, :]
            found.append(np.where((a >= 0) & (b >= 0), (n << 24) | (a << 12) | b, -1))
    rows, out = [], []
    for key in found:
        key = key.reshape(len(fingerprints), -1)
        row, at = np.nonzero(key >= 0)
        rows.append(row)
        out.append(key[row, at])
    return np.concatenate(rows), np.concatenate(out)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included; zero without words."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return 0
    joined = b" ".join(split)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(split) - words + 1)
    starts, ends = starts[:n], ends[min(words, len(split)) - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for c in range(0, n, 1 << 15):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[c : c + (1 << 15)].tolist(), ends[c : c + (1 << 15)].tolist())], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), words, seed) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return run


def _keyed(wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.slice(start, 1024)
                rows, keys = fuzzy_keys(batch.column(1).to_numpy().view(np.uint64), wide)
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *taken.columns], names=["key", "node", "print"])

    return run


def _verified(max_distance: int, dense: int = 24):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a ^ b) <= max_distance

    def large(node: np.ndarray, prints: np.ndarray, block: np.ndarray, low: int, high: int) -> tuple[list, list]:
        left = np.arange(len(node)) if low == high else np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        a: list[int] = []
        b: list[int] = []
        for s in range(0, len(left), 256):
            i = left[s : s + 256]
            p, q = np.nonzero(near(prints[i][:, None], prints[right][None, :]))
            pairs = np.array(forest(node[i[p]].tolist(), node[right[q]].tolist()), np.int64).reshape(-1, 2)
            a += pairs[:, 0].tolist()
            b += pairs[:, 1].tolist()
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        a: list[int] = []
        b: list[int] = []

        def compare(t: list[np.ndarray]) -> None:
            key, node, prints, block, low, high = t
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
            sizes = np.diff(np.append(new, len(key)))
            for s, n in zip(new[sizes > dense].tolist(), sizes[sizes > dense].tolist()):
                x, y = large(node[s : s + n], prints[s : s + n], block[s : s + n], int(low[s]), int(high[s]))
                a.extend(x)
                b.extend(y)
            left = np.repeat(np.where(sizes <= dense, sizes, 0), sizes) - (np.arange(len(key)) - np.repeat(new, sizes))  # rows of the group from here on
            at = np.flatnonzero(left > 1)
            for lag in range(1, dense):
                at = at[left[at] > lag]
                if not len(at):
                    break
                hit = at[near(prints[at], prints[at + lag]) & ((low[at] == high[at]) | (block[at] != block[at + lag]))]
                a.extend(node[hit].tolist())
                b.extend(node[hit + lag].tolist())

        def told() -> pa.RecordBatch:
            pairs = np.array(forest(a, b), np.int64).reshape(-1, 2)
            a.clear()
            b.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

        for batch in batches:
            now = [batch.column(n).to_numpy() for n in ("key", "node", "print", "block", "low", "high")]
            now[2] = now[2].view(np.uint64)
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[4] != now[4][-1]) | (now[5] != now[5][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                compare([np.concatenate(x) for x in zip(*held, [x[:cut] for x in now])] if held else [x[:cut] for x in now])
                held = []
            held.append([x[cut:] for x in now])
            if len(a) > 1_000_000:
                yield told()
        if held:
            compare([np.concatenate(x) for x in zip(*held)])
        yield told()

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE, seed: int = HASH_SEED, block_rows: int = BLOCK_ROWS, wide: bool | None = None
) -> DataFrame:
    """One row for each input row: ``id_col``, fingerprint (16 hex digits), component_id, kept.

    A null, empty or blank text has no words and the fingerprint zero, which links like any other. Equal fingerprints
    are compared once. Rows that repeat an id keep a row each; rows whose id is null are left out; an empty table gives
    an empty result; further columns are ignored. ``max_distance`` may not exceed four, for which the keys are proven. ``wide`` keys are taken from
    ``WIDE_FROM`` distinct fingerprints on unless it says; the result is the same.
    """
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError(f"max_distance must lie between 0 and {MAX_DISTANCE}")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    prints = written(rows.mapInArrow(_fingerprints(words, seed), "doc_id long, print long"), "prints")
    distinct = prints.groupBy("print").agg(F.min("doc_id").alias("node")).select("node", "print")
    distinct = written(distinct, "distinct")
    wide = distinct.count() >= WIDE_FROM if wide is None else wide
    keys = work_path(spark, "keys")
    keyed = written(distinct.repartition(partitions(spark)).mapInArrow(_keyed(wide), "key long, node long, print long"), "", keys)
    units = comparison_units(keyed, "print", block_rows)
    dealt = units.repartition(partitions(spark), "key", "low", "high").sortWithinPartitions("key", "low", "high")
    joined = components(dealt.mapInArrow(_verified(max_distance), "src long, dst long"))
    delete(spark, keys)
    classes = distinct.join(joined, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "print").select(
        F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")
    )


def near_copies(docs: DataFrame, key_col: str, text_col: str = "text", words: int = shingle_join.SHINGLE_WORDS) -> DataFrame:
    """(key_col, component): texts linked by a Jaccard similarity of at least 0.8 of their word shingles share a component.

    Fingerprints of the shingles propose groups, whose members are verified against the smallest one by their whole
    sets. Most pairs at 0.8 are further apart than any number of bits that keys can be joined on, so an exact join
    finds those that the groups leave apart. Keys, nulls, repeats and empty tables are as in ``shingle_join.near_copies``.
    """

    def propose(texts: DataFrame) -> DataFrame:
        found = near_duplicates(texts, "node", "text", words)
        return found.where("not kept").select(F.col("component_id").alias("a"), F.col("node").alias("b"))

    return shingle_join.near_copies(docs, key_col, text_col, words, propose=propose)
