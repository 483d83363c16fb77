"""Embedding near-dedup by lattice hashing.

Each of several tables projects the unit vectors with random orthonormal rows to blocks of eight dimensions and decodes
each block to its nearest point of the E8 lattice; the points of a table's blocks together are a cell. A vector is
filed under its own cell and under neighbouring cells (the second-nearest lattice point of one block at a time), and
vectors that share a cell of a table are compared by cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm._shared import BLOCK_ROWS, comparison_units, components, partitions, written

THRESHOLD = 0.9
TABLES = 12
BLOCKS = 2
SCALE = 0.27
SEED = 20240


def nearest_d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest D8 point (integers of even sum) to each row, its squared distance, and the cost of the next parity repair."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    rows = np.arange(len(x))
    odd = near.sum(axis=1) % 2 != 0
    step = np.where(off[rows, worst] >= 0, 1.0, -1.0)
    near[rows[odd], worst[odd]] += step[odd]
    return near, ((x - near) ** 2).sum(axis=1), worst


def nearest_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest E8 point to each row of ``x`` and that of the other coset, a neighbouring cell; coordinates doubled, so whole numbers."""
    a, da, _ = nearest_d8(x)
    b, db, _ = nearest_d8(x - 0.5)
    a, b = (2 * a).astype(np.int64), (2 * b + 1).astype(np.int64)
    swap = (db < da)[:, None]
    return np.where(swap, b, a), np.where(swap, a, b)


def projections(dims: int, tables: int = TABLES, blocks: int = BLOCKS, seed: int = SEED) -> np.ndarray:
    """(tables, dims, 8 * blocks) with orthonormal columns where ``dims`` allows it."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        g = rng.standard_normal((dims, 8 * blocks))
        out.append(np.linalg.qr(g)[0] if dims >= 8 * blocks else g / math.sqrt(dims))
    return np.stack(out)


def cell_keys(unit: np.ndarray, planes: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """Cell keys of unit vectors: int64 (rows, tables, 1 + blocks); first the own cell, then one neighbour for each block."""
    n, (tables, dims, width) = len(unit), planes.shape
    blocks = width // 8
    keys = np.empty((n, tables, 1 + blocks), np.int64)
    rng = np.random.default_rng(7)
    mix = rng.integers(1, 2**62, size=(tables, blocks, 8), dtype=np.int64) | 1
    # a coordinate's spread is 1 / sqrt(dims): the scale counts in units of what it is for 64 dimensions
    step = scale * 8 / math.sqrt(dims)
    with np.errstate(over="ignore"):
        for t in range(tables):
            z = (unit @ planes[t]) / step
            own, other = [], []
            for b in range(blocks):
                first, second = nearest_e8(z[:, 8 * b : 8 * b + 8])
                own.append((first * mix[t, b]).sum(axis=1))
                other.append((second * mix[t, b]).sum(axis=1))
            total = sum(own)
            for j, h in enumerate([total, *(total - own[b] + other[b] for b in range(blocks))]):
                h = h * np.int64(-7046029254386353131) + np.int64(t)
                keys[:, t, j] = h ^ (h >> np.int64(29))
    return keys


def packed(v: np.ndarray) -> bytes:
    """A vector's components: four bytes each where that loses nothing, else eight; the first byte tells which."""
    with np.errstate(over="ignore"):
        short = v.astype("<f4")
    return b"\4" + short.tobytes() if np.array_equal(short, v) else b"\10" + v.astype("<f8").tobytes()


def _units(raw: list[bytes]) -> np.ndarray:
    """Unit vectors of packed ones, all of one length."""
    width = max(map(len, raw))
    short = [x if x[0] == 4 else None for x in raw]
    if None not in short:
        v = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), width)[:, 1:].copy().view("<f4").astype(np.float64)
    else:
        v = np.stack([np.frombuffer(x, "<f4" if x[0] == 4 else "<f8", offset=1).astype(np.float64) for x in raw])
    v /= np.abs(v).max(axis=1)[:, None]
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("node", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary())])
    for batch in batches:
        out = [packed(np.array(x, np.float64)) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], schema=schema)


def _keyed(tables: int, blocks: int, scale: float, seed: int):
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("at", pa.int32()), ("dims", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for whole in batches:
            for start in range(0, len(whole), 256):
                batch = whole.slice(start, 256)
                sizes = np.array([(len(x) - 1) // x[0] for x in batch.column(2).to_pylist()])
                for dims in np.unique(sizes):
                    part = batch.filter(pa.array(sizes == dims))
                    planes = made.setdefault(int(dims), projections(int(dims), tables, blocks, seed))
                    keys = cell_keys(_units(part.column(2).to_pylist()), planes, scale) ^ (int(dims) << 40)
                    keys = keys.reshape(len(part), -1)
                    # a vector goes once to each cell
                    order = np.argsort(keys, axis=1, kind="stable")
                    ordered = np.take_along_axis(keys, order, axis=1)
                    rows, place = np.nonzero(np.concatenate([np.ones((len(keys), 1), bool), ordered[:, 1:] != ordered[:, :-1]], axis=1))
                    at = order[rows, place]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[rows, at]), part.column(0).take(pa.array(rows)), pa.array((at // (1 + blocks)).astype(np.int32)), pa.array(np.full(len(rows), dims, np.int32))], schema=schema)

    return run


def _first_meeting(a: np.ndarray, b: np.ndarray, key: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether ``key`` of ``table`` is the first cell that each pair of rows shares; a and b are (pairs, tables, cells)."""
    first = np.ones(len(a), bool)
    for t in range(int(table.max(initial=-1)) + 1):
        for i in range(a.shape[2]):
            met = (a[:, t, i, None] == b[:, t, :]).any(axis=1) & (t <= table)
            first &= ~met | ((t == table) & (a[:, t, i] >= key))
    return first


def spanning(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, root) that connect what the given edges connect; the root is the smallest node."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        np.minimum.at(root, before, root)  # what was a root takes along what hung on it
        root = root[root]
        if np.array_equal(root, before):
            break
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


#: Pairs that a task holds at once, and pairs after which it tells what they come to.
PAIRS_AT_ONCE = 1 << 15
PAIRS_TOLD = 1 << 18


def _compared(threshold: float, tables: int, blocks: int, scale: float, seed: int, dense: int = 12):
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
    made: dict[int, np.ndarray] = {}

    def keys_of(x: np.ndarray) -> np.ndarray:
        planes = made.setdefault(x.shape[1], projections(x.shape[1], tables, blocks, seed))
        return cell_keys(x, planes, scale) ^ (x.shape[1] << 40)

    def told(x: np.ndarray, c: dict[str, np.ndarray], keys: dict[str, np.ndarray], first: int, p: np.ndarray, q: np.ndarray) -> Iterator[np.ndarray]:
        """Of pairs of rows those that first meet in their cell, as node, node, copies, copies; ``keys`` are of the rows from ``first`` on, found when a row is first in a pair."""
        for s in range(0, len(p), PAIRS_AT_ONCE):
            i, j = p[s : s + PAIRS_AT_ONCE], q[s : s + PAIRS_AT_ONCE]
            used = np.zeros(len(keys["known"]), bool)
            used[i - first] = used[j - first] = True
            fresh = np.flatnonzero(used & ~keys["known"])
            if len(fresh):
                keys["keys"][fresh], keys["known"][fresh] = keys_of(x[first + fresh]), True
            ok = _first_meeting(keys["keys"][i - first], keys["keys"][j - first], c["key"][i], c["at"][i])
            i, j = i[ok], j[ok]
            yield np.stack([c["node"][i], c["node"][j], c["copies"][i], c["copies"][j]])

    def compare(x: np.ndarray, c: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
        """All pairs within the units of sorted rows that reach the threshold and first meet there, some at a time."""
        key, low, high = c["key"], c["low"], c["high"]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        sizes = np.diff(np.append(new, len(key)))
        for s, n in zip(new[sizes > dense].tolist(), sizes[sizes > dense].tolist()):
            rows = np.arange(s, s + n)
            same = low[s] == high[s]
            left = rows if same else rows[c["block"][rows] == low[s]]
            right = rows if same else rows[c["block"][rows] == high[s]]
            keys = {"known": np.zeros(n, bool), "keys": np.empty((n, tables, 1 + blocks), np.int64)}
            step = max(1, 4 * PAIRS_AT_ONCE // max(1, len(right)))
            for t in range(0, len(left), step):
                p, q = np.nonzero(x[left[t : t + step]] @ x[right].T >= threshold)
                p, q = left[t + p], right[q]
                yield from told(x, c, keys, s, *((p[p < q], q[p < q]) if same else (p, q)))
        left = np.repeat(np.where(sizes <= dense, sizes, 0), sizes) - (np.arange(len(key)) - np.repeat(new, sizes))  # rows of the unit from here on
        at = np.flatnonzero(left > 1)
        for lag in range(1, dense):
            at = at[left[at] > lag]
            if not len(at):
                break
            hit = at[(np.einsum("ij,ij->i", x[at], x[at + lag]) >= threshold) & ((low[at] == high[at]) | (c["block"][at] != c["block"][at + lag]))]
            for s in range(0, len(hit), PAIRS_AT_ONCE):
                p = hit[s : s + PAIRS_AT_ONCE]
                used, where = np.unique(np.concatenate([p, p + lag]), return_inverse=True)
                keys = keys_of(x[used])
                ok = _first_meeting(keys[where[: len(p)]], keys[where[len(p) :]], key[p], c["at"][p])
                i, j = p[ok], p[ok] + lag
                yield np.stack([c["node"][i], c["node"][j], c["copies"][i], c["copies"][j]])

    def summed(pairs: np.ndarray) -> pa.RecordBatch:
        """Counts of links by node (kind 0) and edges of a forest (kind 1): at most twice as many rows as nodes."""
        nodes, at = np.unique(pairs[:2].reshape(-1), return_inverse=True)
        counts = np.zeros(len(nodes), np.int64)
        np.add.at(counts, at.reshape(-1), pairs[[3, 2]].reshape(-1))  # a link counts as often as the partner occurs
        child, root = spanning(pairs[0], pairs[1])
        kind = np.repeat(np.array([0, 1], np.int32), [len(nodes), len(child)])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([nodes, child])), pa.array(np.concatenate([counts, root]))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "low", "high", "block", "node", "copies", "at")
        held: dict[int, list[tuple[np.ndarray, dict[str, np.ndarray]]]] = {}  # by dimensions, which a key depends on: the rows of a unit that may go on
        out: list[np.ndarray] = []

        def compared(parts: list) -> Iterator[pa.RecordBatch]:
            for pairs in compare(*joined(parts)):
                out.append(pairs)
                if sum(x.shape[1] for x in out) > PAIRS_TOLD:
                    yield summed(np.concatenate(out, axis=1))
                    out.clear()

        def joined(parts: list) -> tuple[np.ndarray, dict[str, np.ndarray]]:
            return np.concatenate([p[0] for p in parts]), {n: np.concatenate([p[1][n] for p in parts]) for n in names}

        for batch in batches:
            for dims in np.unique(batch.column("dims").to_numpy()).tolist():
                t = batch.filter(pa.compute.equal(batch.column("dims"), dims))
                x, c = _units(t.column("vector").to_pylist()), {n: t.column(n).to_numpy() for n in names}
                last = np.flatnonzero((c["key"] != c["key"][-1]) | (c["low"] != c["low"][-1]) | (c["high"] != c["high"][-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield from compared([*held.pop(dims, []), (x[:cut], {n: v[:cut] for n, v in c.items()})])
                held.setdefault(dims, []).append((x[cut:], {n: v[cut:] for n, v in c.items()}))
        for parts in held.values():
            yield from compared(parts)
        if out:
            yield summed(np.concatenate(out, axis=1))

    return run


def usable(vector):
    """Whether a vector links at all: it has components, none null or non-finite, and some is not zero."""
    return F.coalesce(
        vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, seed: int = SEED, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row for each input row: ``id_col``, n_links, component_id, kept.

    Equal vectors are compared once and counted as often as they occur. Null, empty, zero and non-finite vectors, and
    those with a null component, link with nothing: n_links 0 and their own id. Vectors of different lengths never
    link. Rows whose id is null are left out; rows that repeat an id with the same vector count as copies, each
    keeping its own row. An empty table gives an empty result; further columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v")).where("_id is not null")
    rows = rows.withColumn("_v", F.when(usable(F.col("_v")), F.col("_v")))
    distinct = rows.where("_v is not null").groupBy("_v").agg(F.min("_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    distinct = written(distinct, "vectors")
    raw = written(distinct.select("node", "copies", "_v").mapInArrow(_packed, "node long, copies long, vector binary"), "packed")
    cells = written(raw.mapInArrow(_keyed(tables, blocks, scale, seed), "key long, node long, at int, dims int"), "cells")
    # cells travel by number; a vector follows to those only that it shares with another
    shared = written(cells.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key"), "shared")
    units = comparison_units(written(cells.join(shared, "key", "left_semi"), "met"), "node", block_rows).join(raw, "node")
    dealt = units.repartition(partitions(vectors.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high")
    links = written(dealt.mapInArrow(_compared(threshold, tables, blocks, scale, seed), "kind int, a long, b long"), "links")
    return _result(rows, distinct, links, id_col)


def _result(rows: DataFrame, distinct: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    counts = links.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    joined = components(links.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    classes = distinct.join(counts, "node", "left").join(joined, "node", "left")
    classes = classes.select("_v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = rows.where("_v is not null").join(classes, "_v").select("_id", "n_links", "component_id")
    alone = rows.where("_v is null").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("_id").alias(id_col), F.col("n_links").cast("long"), "component_id", (F.col("_id") == F.col("component_id")).alias("kept"))
