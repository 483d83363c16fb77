"""Hard negatives by a two-dimensional block matrix multiply.

Anchors and rows are dealt to shards, and each shard's whole-number components to chunks of dimensions. A task
multiplies one chunk of an anchor shard with the same chunk of a row shard, which gives a tile of partial scores; the
tiles of all chunks are added up after a shuffle by anchor and row shard. Every finished tile is reduced to the first
rows of each anchor's label, and once these are known for the whole table, to the first rows of other labels within the
window of each anchor and positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm._shared import partitions, written

POSITIVES = 5
NEGATIVES = 5
#: A negative's score lies between so many hundredths of the positive's and all of it.
LEAST_SHARE = 80
SCALE = 256
#: Anchors and rows of a tile, and dimensions that are multiplied at once.
ANCHOR_ROWS = 128
SHARD_ROWS = 8192
CHUNK_DIMS = 32
_EXACT = 2.0**53


# ---- whole numbers as bytes ----
def packed(values: np.ndarray) -> bytes:
    """Whole numbers in two bytes each, those that don't fit beside them with their places."""
    flat = values.reshape(-1).astype(np.int64)
    small = flat.astype("<i2")
    odd = np.flatnonzero(small != flat)
    return len(odd).to_bytes(8, "little") + odd.astype("<i8").tobytes() + flat[odd].astype("<i8").tobytes() + small.tobytes()


def unpacked(raw: bytes, rows: int) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    at, values = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(2, n)
    out = np.frombuffer(raw, "<i2", offset=8 + 16 * n).astype(np.int64)
    out[at] = values
    return out.reshape(rows, -1)


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exactly: in doubles where no sum can pass 2^53, else in 64-bit numbers, and an error where these may not do."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most >= 2.0**62:
        raise ValueError("components are too large for scores of 64 bits")
    return a @ b.T


# ---- shards ----
def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, dims, vector) of the rows that take part; of ids divisible by ``relabel_every`` the label is the next one."""
    v = F.col(vector_col).cast("array<double>")
    whole = (F.size(vector_col) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.coalesce(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & whole, F.lit(False)))
    label = F.col(label_col).cast("long")
    moved = F.when(F.col(id_col) % relabel_every == 0, (label + 1) % labels).otherwise(label)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), moved.alias("label"), F.size(vector_col).alias("dims"), v.alias("vector"))


def _sharded(chunk_dims: int, scale: float):
    """Rows (dims, shard, chunk, ids, labels, values) of each shard: its ids and labels with the first chunk, its scaled components by chunk."""
    names = ["dims", "shard", "chunk", "ids", "labels", "vals"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def told() -> pa.RecordBatch:
            ids, labels, values = (np.concatenate(x) for x in zip(*held))
            cuts = range(0, values.shape[1], chunk_dims)
            first = [True] + [False] * (len(cuts) - 1)
            columns = [pa.array([now[0]] * len(cuts), pa.int32()), pa.array([now[1]] * len(cuts), pa.int32()), pa.array(range(len(cuts)), pa.int32())]
            columns += [pa.array([x.astype("<i8").tobytes() if f else None for f in first], pa.binary()) for x in (ids, labels)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([packed(values[:, c : c + chunk_dims]) for c in cuts], pa.binary())], names=names)

        for batch in batches:
            dims, shard = batch.column("dims").to_numpy(), batch.column("shard").to_numpy()
            cuts = np.flatnonzero((dims[1:] != dims[:-1]) | (shard[1:] != shard[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                if s == e:
                    continue
                if (key := (int(dims[s]), int(shard[s]))) != now:
                    if held:
                        yield told()
                    now, held = key, []
                part = batch.slice(s, e - s)
                values = np.floor(scale * part.column("vector").flatten().to_numpy(zero_copy_only=False)).reshape(e - s, -1)
                if np.abs(values).max(initial=0) >= 2.0**31:
                    raise ValueError("components are too large for scores of 64 bits")
                held.append((part.column("vec_id").to_numpy(), part.column("label").to_numpy(), values.astype(np.int64)))
        if held:
            yield told()

    return run


def shards(rows: DataFrame, size: int, chunk_dims: int = CHUNK_DIMS, scale: float = SCALE) -> DataFrame:
    """Deals the rows of each length to shards of about ``size`` rows, numbered from 0, whatever their ids; ``of`` is the number of shards."""
    n = rows.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("of"))
    dealt = rows.withColumn("_place", F.monotonically_increasing_id()).join(n, "dims").withColumn("shard", F.pmod(F.xxhash64("_place"), F.col("of")).cast("int"))
    dealt = dealt.repartition(partitions(rows.sparkSession), "dims", "shard").sortWithinPartitions("dims", "shard").select("dims", "shard", "vec_id", "label", "vector")
    made = dealt.mapInArrow(_sharded(chunk_dims, scale), "dims int, shard int, chunk int, ids binary, labels binary, vals binary")
    return written(made.join(n, "dims"), "shards")


# ---- tiles ----
TILE = "dims int, i int, j int, anchors binary, anchor_labels binary, ids binary, labels binary, tile binary"


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial tile of each pair of chunks."""
    for batch in batches:
        for r in range(len(batch)):
            row = batch.slice(r, 1)
            dims, chunk = row.column("dims")[0].as_py(), row.column("chunk")[0].as_py()
            a, b = (row.column(c)[0].as_py() for c in ("anchor_vals", "vals"))
            n, m = row.column("n_anchors")[0].as_py(), row.column("n_rows")[0].as_py()
            tile = packed(product(unpacked(a, n), unpacked(b, m)))
            yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("dims", "i", "j", "chunk", "n_anchors", "anchors", "anchor_labels", "ids", "labels")), pa.array([tile], pa.binary())], names=["dims", "i", "j", "chunk", "n_anchors", "anchors", "anchor_labels", "ids", "labels", "tile"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partial tiles of each pair of shards, which follow one another with the first chunk's first."""
    now, total, head = None, None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*head, pa.array([packed(total)], pa.binary())], names=["dims", "i", "j", "anchors", "anchor_labels", "ids", "labels", "tile"])

    for batch in batches:
        for r in range(len(batch)):
            row = batch.slice(r, 1)
            key = tuple(row.column(c)[0].as_py() for c in ("dims", "i", "j"))
            tile = unpacked(row.column("tile")[0].as_py(), row.column("n_anchors")[0].as_py())
            if key == now:
                total = total + tile
                continue
            if now is not None:
                yield told()
            now, total, head = key, tile, [row.column(c) for c in ("dims", "i", "j", "anchors", "anchor_labels", "ids", "labels")]
    if now is not None:
        yield told()


def score_tiles(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Finished tiles of all anchor shards against all row shards of their length, from ``shards`` of both."""
    spark = rows.sparkSession
    size = rows.where("chunk = 0").select("dims", F.col("shard").alias("j"), F.col("of").alias("of_rows"), (F.length("ids") / 8).cast("int").alias("n_rows"))
    n_rows = size.select("dims", "of_rows").distinct()
    n_anchors = anchors.where("chunk = 0").select("dims", F.col("of").alias("of_anchors")).distinct()
    heights = anchors.where("chunk = 0").select("dims", F.col("shard").alias("i"), (F.length("ids") / 8).cast("int").alias("n_anchors"))
    # a chunk goes to each tile that it takes part in
    left = anchors.join(n_rows, "dims").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("of_rows") - 1))).withColumnRenamed("shard", "i")
    left = left.join(heights, ["dims", "i"]).select("dims", "i", "j", "chunk", "n_anchors", F.col("ids").alias("anchors"), F.col("labels").alias("anchor_labels"), F.col("vals").alias("anchor_vals"))
    right = rows.join(n_anchors, "dims").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("of_anchors") - 1))).withColumnRenamed("shard", "j")
    right = right.join(size.drop("of_rows"), ["dims", "j"]).select("dims", "i", "j", "chunk", "n_rows", "ids", "labels", "vals")
    partial = left.join(right.hint("shuffle_merge"), ["dims", "i", "j", "chunk"]).mapInArrow(_multiplied, "dims int, i int, j int, chunk int, n_anchors int, anchors binary, anchor_labels binary, ids binary, labels binary, tile binary")
    dealt = partial.repartition(partitions(spark), "dims", "i", "j").sortWithinPartitions("dims", "i", "j", "chunk")
    return written(dealt.mapInArrow(_added, TILE), "tiles")


# ---- windows ----
def first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the k highest scores stand, ties by smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _positives(k: int):
    """(dims, i, place, anchor_id, positive_id, score): the first rows of each anchor's label in each tile; ``place`` is the anchor's in its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                dims, i, _, anchors, own, ids, labels, tile = (c[r].as_py() for c in batch.columns)
                anchors, own, ids, labels = map(_longs, (anchors, own, ids, labels))
                scores = unpacked(tile, len(anchors))
                places, found, best = [], [], []
                for a in range(len(anchors)):
                    at = np.flatnonzero((labels == own[a]) & (ids != anchors[a]))
                    at = at[first_of(scores[a, at], ids[at], k)]
                    places.append(np.full(len(at), a))
                    found.append(ids[at])
                    best.append(scores[a, at])
                places = np.concatenate(places)
                n = len(places)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dims, np.int32)), pa.array(np.full(n, i, np.int32)), pa.array(places.astype(np.int32)), pa.array(anchors[places]), pa.array(np.concatenate(found)), pa.array(np.concatenate(best))], names=["dims", "i", "place", "anchor_id", "positive_id", "score"])

    return run


def _negatives(k: int, least: int):
    """(dims, i, place, nth, anchor_id, positive_id, positive_score, negative_id, score): the first rows of other labels in each tile and window."""
    names = ["dims", "i", "place", "nth", "anchor_id", "positive_id", "positive_score", "negative_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                anchors, own, ids, labels = (_longs(batch.column(c)[r].as_py()) for c in ("anchors", "anchor_labels", "ids", "labels"))
                dims, i, windows = (batch.column(c)[r].as_py() for c in ("dims", "i", "windows"))
                scores = unpacked(batch.column("tile")[r].as_py(), len(anchors))
                by_place: dict[int, list] = {}
                for w in windows:
                    by_place.setdefault(w["place"], []).append((w["nth"], w["positive_id"], w["score"]))
                out: list[tuple] = []
                for place, asked in sorted(by_place.items()):
                    low, high = min(-(-least * p // 100) for _, _, p in asked), max(p for _, _, p in asked)
                    row = scores[place]
                    at = np.flatnonzero((labels != own[place]) & (row >= low) & (row <= high))
                    at = at[np.lexsort((ids[at], -row[at]))]
                    falling = -row[at]
                    for nth, positive, p in asked:
                        start = int(np.searchsorted(falling, -p, "left"))
                        end = int(np.searchsorted(falling, -(-(-least * p // 100)), "right"))
                        out += [(dims, i, place, nth, int(anchors[place]), positive, p, n, s) for n, s in zip(ids[at[start:end][:k]].tolist(), row[at[start:end][:k]].tolist())]
                kinds = [pa.int32()] * 4 + [pa.int64()] * 5
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], names=names)

    return run


def _best(found: DataFrame, keys: list[str], other: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), other)
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def mine(rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, least_share: int = LEAST_SHARE, scale: float = SCALE, anchor_rows: int = ANCHOR_ROWS, shard_rows: int = SHARD_ROWS, chunk_dims: int = CHUNK_DIMS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``rows`` as ``usable`` gives them.

    Anchors are rows whose id is divisible by ``every``; vectors of different lengths don't meet. Rows of the anchor's
    own id are not among its positives. Rows that repeat are each a row of their own, as anchors too. A positive score
    below 0 has no window, and one of 0 only negatives of 0. An empty table gives an empty result; components whose
    scores may not fit 64 bits are an error.
    """
    rows = written(rows, "rows")
    tiles = score_tiles(shards(rows.where(F.col("vec_id") % every == 0), anchor_rows, chunk_dims, scale), shards(rows, shard_rows, chunk_dims, scale))
    near = tiles.mapInArrow(_positives(positives), "dims int, i int, place int, anchor_id long, positive_id long, score long")
    best = _best(near, ["dims", "i", "place"], "positive_id", positives)
    # one row for each anchor shard, of a shard's anchors times their positives
    windows = written(best.groupBy("dims", "i").agg(F.collect_list(F.struct("place", "nth", "positive_id", "score")).alias("windows")), "windows")
    found = tiles.join(windows, ["dims", "i"]).mapInArrow(_negatives(negatives, least_share), "dims int, i int, place int, nth int, anchor_id long, positive_id long, positive_score long, negative_id long, score long")
    found = _best(found.withColumnRenamed("nth", "positive_nth"), ["dims", "i", "place", "positive_nth"], "negative_id", negatives)
    return found.select("anchor_id", "positive_id", F.col("nth").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))
