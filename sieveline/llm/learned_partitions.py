"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors is joined to a graph of near neighbours, the graph is cut into balanced parts with few
edges between them, and a softmax classifier learns to which part a vector's neighbours belong. It files every vector
of the table in its most probable part. A query goes to several of its most probable parts, and is ranked against all
vectors there by inner product in double precision. How many parts that takes is measured, not assumed: some queries
are answered against the whole table, and the parts of what they find tell the recall of every number of parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm._shared import partitions, written

K = 20
#: Vectors that the parts are learned from at most; every vector of the table is filed and searched.
SAMPLE = 8192
#: Vectors for each part of a small table, and parts of a large one.
ROWS_PER_PART = 256
MOST_PARTS = 32
#: Neighbours of a vector in the sample's graph.
NEIGHBOURS = 16
#: Queries that are answered exactly to measure recall, and the recall that decides the number of parts.
TRIALS = 256
RECALL = 0.95
#: Vectors and queries of one unit of comparison.
BLOCK_ROWS = 32_768
BLOCK_QUERIES = 32_768
SEED = 12


# ---- the model ----
def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row by inner product, some hundred rows at a time."""
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), 256):
        near = x[s : s + 256] @ x.T
        near[np.arange(len(near)), np.arange(s, s + len(near))] = -np.inf
        out[s : s + 256] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced(score: np.ndarray, room: int) -> np.ndarray:
    """The best column for each row such that no column gets more than ``room``: each takes its best rows, the others try their next."""
    rows, parts = score.shape
    order, tried = np.argsort(-score, axis=1, kind="stable"), np.zeros(rows, np.int64)
    out, free, left = np.empty(rows, np.int64), np.full(parts, room), np.arange(rows)
    while len(left):
        want = order[left, tried[left]]
        by = np.lexsort((-score[left, want], want))
        sorted_want = want[by]
        place = np.arange(len(by)) - np.searchsorted(sorted_want, np.arange(parts))[sorted_want]
        taken = place < free[sorted_want]
        out[left[by[taken]]] = sorted_want[taken]
        free -= np.bincount(sorted_want[taken], minlength=parts)
        left = left[by[~taken]]
        tried[left] += 1
    return out


def cut_graph(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 15, seed: int = SEED) -> np.ndarray:
    """A part for each row, balanced to a twentieth: means first, then each row moves to where most of its neighbours are while there is room."""
    room = int(np.ceil(len(x) / parts * 1.05))
    means = x[np.random.default_rng(seed).choice(len(x), parts, replace=False)]
    for _ in range(rounds):
        part = balanced(x @ means.T, room)
        sums = np.zeros((parts, x.shape[1]))
        np.add.at(sums, part, x)
        means = sums / np.maximum(np.sqrt((sums**2).sum(axis=1, keepdims=True)), 1e-300)
    rows = np.repeat(np.arange(len(x)), near.shape[1])
    for _ in range(rounds):
        edges = np.zeros((len(x), parts))
        np.add.at(edges, (rows, part[near].reshape(-1)), 1)
        np.add.at(edges, (near.reshape(-1), np.repeat(part, near.shape[1])), 1)
        edges[np.arange(len(x)), part] += 0.5
        moved = balanced(edges, room)
        if (moved != part).mean() < 0.002:
            break
        part = moved
    return part


def learn(x: np.ndarray, near: np.ndarray, part: np.ndarray, parts: int, steps: int = 150, rate: float = 0.5) -> np.ndarray:
    """Weights (dims + 1, parts) of a softmax classifier whose targets are the parts of a row and of its neighbours; whole-batch Adam."""
    inputs = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].reshape(-1)), 0.5 / near.shape[1])
    target[np.arange(len(x)), part] += 0.5
    w, mean, square = (np.zeros((inputs.shape[1], parts)) for _ in range(3))
    for i in range(1, steps + 1):
        p = inputs @ w
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = inputs.T @ (p - target) / len(x)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w -= rate * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-9)
    return w


def logits(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How probable each part is for vectors of any length; directions alone decide."""
    size = np.abs(x).max(axis=1, keepdims=True, initial=0)
    unit = x / np.where(size > 0, size, 1)
    unit = unit / np.sqrt((unit**2).sum(axis=1, keepdims=True))
    return unit @ weights[:-1] + weights[-1]


def fit(x: np.ndarray, parts: int) -> np.ndarray:
    """The classifier's weights from a sample of vectors; equal ones count once."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = np.unique(x / np.sqrt((x**2).sum(axis=1, keepdims=True)), axis=0)
    parts = max(1, min(parts, len(x) // 4))
    if parts == 1:
        return np.zeros((x.shape[1] + 1, 1))
    near = neighbours(x, min(NEIGHBOURS, len(x) - 1))
    return learn(x, near, cut_graph(x, near, parts), parts)


# ---- vectors in Arrow batches ----
def lists_of(x: np.ndarray) -> pa.Array:
    """Rows as byte strings."""
    width = x.shape[1] * x.dtype.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int64) * width
    if offsets[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
    return pa.array([r.tobytes() for r in x], pa.binary())


def rows_of(column: pa.Array, kind: str) -> np.ndarray:
    """Byte strings of one length as rows of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), -1).astype(np.float64)


def _packed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind)
            dims = batch.column(1).to_numpy()
            at = np.concatenate([[0], np.cumsum(dims)])
            raw = [flat[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["vec_id", "dims", "vector"])

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, str]:
    """(vec_id, dims, vector as bytes) of the rows that take part, and the kind of number in them: eight bytes, or four where the table holds no more."""
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.coalesce(F.col(id_col).isNotNull() & whole, F.lit(False)))
    cast = F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>")
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.size(vector_col).alias("dims"), cast.alias("vector")).mapInArrow(_packed(kind), "vec_id long, dims int, vector binary"), kind


def _sampled(rows: DataFrame, n: int, size: int, salt: int) -> DataFrame:
    """About ``size`` rows at most, chosen by a hash of id and vector; what comes near them is all that is sorted."""
    mark = F.xxhash64(F.lit(salt), "vec_id", "vector")
    if n > 4 * size:
        rows = rows.where(F.pmod(mark, F.lit(n // (2 * size))) == 0)
    return rows.orderBy(mark, "vec_id").limit(size)


def _fitted(kind: str, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [rows_of(b.column(0), kind) for b in batches if len(b)]
        if held:
            w = fit(np.concatenate(held), parts)
            yield pa.RecordBatch.from_arrays([pa.array([w.shape[1]], pa.int32()), pa.array([w.astype("<f8").tobytes()], pa.binary())], names=["parts", "weights"])

    return run


def _filed(weights: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                part = logits(rows_of(batch.column(1), kind), weights).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), batch.column(0), batch.column(1)], names=["part", "vec_id", "vector"])

    return run


@dataclass
class Index:
    """All vectors of one length by part (part, vec_id, vector), the classifier, the rows of each part, and the parts that a query is sent to."""

    rows: DataFrame
    kind: str
    weights: np.ndarray
    sizes: np.ndarray
    probes: int


def build(rows: DataFrame, kind: str, queries: DataFrame, k: int = K, recall: float = RECALL, sample: int = SAMPLE, rows_per_part: int = ROWS_PER_PART, most_parts: int = MOST_PARTS, trials: int = TRIALS) -> Index:
    """Learns the parts from a sample of ``rows`` (vec_id, vector, all of one length), files every row, and measures on some of ``queries`` how many parts to ask."""
    n = rows.count()
    parts = max(1, min(most_parts, n // rows_per_part))
    model = _sampled(rows, n, sample, 1).select("vector").coalesce(1).mapInArrow(_fitted(kind, parts), "parts int, weights binary").first()
    weights = np.frombuffer(model["weights"], "<f8").reshape(-1, model["parts"])
    filed = written(rows.select("vec_id", "vector").mapInArrow(_filed(weights, kind), "part int, vec_id long, vector binary"), "filed")
    sizes = np.zeros(weights.shape[1], np.int64)
    for r in filed.groupBy("part").count().collect():  # a row for each part
        sizes[r["part"]] = r["count"]
    asked = _sampled(queries, queries.count(), trials, 2).select("vec_id", "vector").collect() if weights.shape[1] > 1 else []
    probes = 1
    if asked:
        q = np.stack([np.frombuffer(r["vector"], kind).astype(np.float64) for r in asked])
        found = nearest(filed, kind, np.array([r["vec_id"] for r in asked]), q, k)
        probes = probes_for(logits(q, weights), [(r["query"], r["part"]) for r in found.select("query", "part").collect()], recall)
    return Index(filed, kind, weights, sizes, probes)


def probes_for(score: np.ndarray, found: list[tuple[int, int]], recall: float) -> int:
    """The fewest parts such that a share ``recall`` of what queries should find lies in their most probable ones."""
    place = np.argsort(np.argsort(-score, axis=1, kind="stable"), axis=1)
    ranks = np.sort([place[q, p] for q, p in found])
    return 1 if not len(ranks) else int(ranks[max(0, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def nearest(filed: DataFrame, kind: str, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(query, part, vec_id, score): the k nearest of all rows to each of a few queries, which go to every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: tuple[np.ndarray, ...] = (np.empty((len(q), 0)), np.empty((len(q), 0), np.int64), np.empty((len(q), 0), np.int32))
        for whole in batches:
            for start in range(0, len(whole), 4096):
                batch = whole.slice(start, 4096)
                own = batch.column(1).to_numpy()
                score = q @ rows_of(batch.column(2), kind).T
                score[ids[:, None] == own[None, :]] = -np.inf
                both = [np.concatenate([a, np.broadcast_to(b, score.shape)], axis=1) for a, b in zip(best, (score, own, batch.column(0).to_numpy()))]
                if both[0].shape[1] > k:
                    top = np.argpartition(-both[0], k - 1, axis=1)[:, :k]
                    both = [np.take_along_axis(x, top, axis=1) for x in both]
                best = tuple(both)
        rows, at = np.nonzero(best[0] > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(best[2][rows, at]), pa.array(best[1][rows, at]), pa.array(best[0][rows, at])], names=["query", "part", "vec_id", "score"])

    found = filed.mapInArrow(run, "query int, part int, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


# ---- the search ----
UNIT = "part int, block int, query_block int, asks boolean, query long, vec_id long, vector binary"


def _routed(index: Index, blocks: np.ndarray, k: int):
    """Each query once for every block of rows of its most probable parts; of as many more parts as it takes to hold k rows besides those of its id."""
    weights, sizes, kind, probes = index.weights, index.sizes, index.kind, index.probes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.slice(start, 1024)
                order = np.argsort(-logits(rows_of(batch.column("vector"), kind), weights), axis=1, kind="stable")
                enough = (np.cumsum(sizes[order], axis=1) < k + batch.column("own").to_numpy()[:, None]).sum(axis=1) + 1
                query, place = np.nonzero(np.arange(len(sizes))[None, :] < np.maximum(enough, probes)[:, None])
                part = order[query, place]
                times = blocks[part]
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                query, part = pa.array(np.repeat(query, times)), np.repeat(part, times)
                taken = {c: batch.column(c).take(query) for c in ("query_block", "query", "vec_id", "vector")}
                columns = [pa.array(part.astype(np.int32)), pa.array(block.astype(np.int32)), taken["query_block"], pa.array(np.ones(len(part), bool)), taken["query"], taken["vec_id"], taken["vector"]]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "query_block", "asks", "query", "vec_id", "vector"])

    return run


def prepared(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by id. Of equal vectors those of the k + 1 smallest ids are left, as no other can be among the k nearest to anything."""
    same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).reshape(-1), return_inverse=True)[1].reshape(-1)
    order = np.lexsort((ids, same))
    group, number = same[order], ids[order]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    upto = np.cumsum(first | np.concatenate([[True], number[1:] != number[:-1]]))
    kept = order[upto - upto[np.flatnonzero(first)][np.cumsum(first) - 1] <= k]
    kept = kept[np.argsort(ids[kept], kind="stable")]
    return ids[kept], x[kept]


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up from the first component to the last, so equal vectors have equal ones."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def top(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which query, which row, score) of the k nearest rows to each query; ties go to smaller ids, rows of its own id don't count."""
    near = q @ x.T
    low, high = np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")
    for i in np.flatnonzero(high > low).tolist():
        near[i, low[i] : high[i]] = -np.inf
    least = np.partition(near, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(q), -np.inf)
    # the product of whole matrices may round otherwise than row by row: what comes close is looked at again
    slack = 1e-9 * np.sqrt((q**2).sum(axis=1)) * np.sqrt((x**2).sum(axis=1).max())
    which, row = np.nonzero((near >= (least - slack)[:, None]) & (near > -np.inf))
    score = inner(q[which], x[row])
    order = np.lexsort((ids[row], -score, which))
    which, row, score = which[order], row[order], score[order]
    place = np.arange(len(which)) - np.searchsorted(which, np.arange(len(q)))[which]
    return which[place < k], row[place < k], score[place < k]


def _ranked(kind: str, k: int):
    """The k nearest rows of its unit to each query; units come one after the other, their rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1) | (asks[1:] != asks[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                if s == e:
                    continue
                if (key := tuple(keys[s].tolist())) != now:
                    now, held, ready = key, [], None
                if not asks[s]:
                    held.append((batch.column(5).slice(s, e - s).to_numpy(), rows_of(batch.column(6).slice(s, e - s), kind)))
                    continue
                if ready is None and held:
                    ready = prepared(*(np.concatenate(x) for x in zip(*held)), k)
                if ready is None:
                    continue
                for at in range(s, e, 128):
                    asked = batch.slice(at, min(128, e - at))
                    which, row, score = top(rows_of(asked.column(6), kind), asked.column(5).to_numpy(), ready[1], ready[0], k)
                    yield pa.RecordBatch.from_arrays([asked.column(4).take(pa.array(which)), asked.column(5).take(pa.array(which)), pa.array(ready[0][row]), pa.array(score)], names=["query", "query_id", "vec_id", "score"])

    return run


def ranked(index: Index, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): what the index finds for ``queries`` (vec_id, vector)."""
    spark = queries.sparkSession
    distinct = queries.select("vec_id", "vector").distinct().join(queries.groupBy("vec_id").agg(F.count(F.lit(1)).alias("own")), "vec_id")
    query_blocks = max(1, -(-queries.count() // block_queries))
    asked = distinct.withColumn("query", F.xxhash64("vec_id", "vector")).withColumn("query_block", F.pmod(F.col("query"), F.lit(query_blocks)).cast("int"))
    blocks = np.maximum(1, -(-index.sizes // block_rows))
    # rows are dealt to the blocks of their part by their place in the stored table, so repeated ones spread too
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.element_at(F.lit(blocks.tolist()), F.col("part") + 1)).cast("int")
    rows = index.rows.withColumn("block", block).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    rows = rows.select("part", "block", "query_block", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("query"), "vec_id", "vector")
    units = rows.unionByName(asked.mapInArrow(_routed(index, blocks, k), UNIT))
    dealt = units.repartition(partitions(spark), "part", "block", "query_block").sortWithinPartitions("part", "block", "query_block", "asks")
    found = dealt.mapInArrow(_ranked(index.kind, k), "query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = K, **settings) -> DataFrame:
    """The k nearest vectors to each row whose id is divisible by ``every``, as its index finds them: query_id, rank, vec_id, score.

    Null, empty and zero vectors, those with a null or non-finite component, and rows without an id take no part.
    Vectors of different lengths don't meet: each length has an index of its own. A row that repeats another asks once,
    but is found as often as it occurs; rows of the query's own id are not found. Ties go to smaller ids. A query gets k
    rows, or all there are; an empty table gives an empty result; further columns are ignored. ``settings`` go to ``build``.
    """
    rows, kind = usable(vectors, id_col, vector_col)
    rows = written(rows, "vectors")
    found = []
    for r in rows.select("dims").distinct().collect():  # a row for each length that occurs
        these = rows.where(F.col("dims") == r["dims"])
        queries = these.where(F.col("vec_id") % every == 0)
        found.append(ranked(build(these, kind, queries, k, **settings), queries, k))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)
