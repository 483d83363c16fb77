"""Helpers that several corpus operators use: the shared work folder, splitting of hot keys, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.sources.shared import delete, scratch, shared_dir, work_path, written

__all__ = ["BLOCK_ROWS", "comparison_units", "components", "delete", "forest", "mapped", "packed", "partitions", "runs_of", "scratch", "shared_dir", "unpacked", "work_path", "written"]

#: Rows of one key that a single comparison unit may hold on each of its two sides.
BLOCK_ROWS = 4096


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def comparison_units(keyed: DataFrame, salt: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Splits the rows of each ``key`` into units that one task can hold.

    ``keyed`` has a long column ``key``; ``salt`` names a long column that spreads a key's rows. A key with more
    than ``block_rows`` rows is cut into n blocks, and each row goes to the n units (low, high) that its block takes
    part in, so every pair of rows meets in exactly one unit (pairs of one block in its unit (b, b)). Adds ``block``,
    ``low`` and ``high``.
    """
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
    blocks = F.coalesce(F.ceil(F.col("_n") / block_rows), F.lit(1)).cast("int")
    block = F.pmod(F.xxhash64(F.col(salt)), F.col("_blocks")).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("low"), F.greatest(j, F.col("block")).alias("high")))
    return (
        keyed.join(counts, "key", "left")
        .withColumn("_blocks", blocks)
        .withColumn("block", block)
        .withColumn("_unit", F.explode(both))
        .select(*keyed.columns, "block", "_unit.low", "_unit.high")
    )


def forest(left, right):
    """Edges (child, root) that connect what the given edges connect; arrays of node ids in, list of pairs out."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top and y != x:
            up[x] = top
            x = y
        return top

    for a, b in zip(left, right):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in list(up)]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (src long, dst long; either direction, repeats and self-links allowed).

    Returns (node, component): every node that reaches a smaller one, with the smallest that it reaches. Alternates
    large-star and small-star steps, so hubs with very many edges converge in a few rounds and no neighbourhood is ever
    gathered. Each round's edges and each node's least neighbour are written to the shared folder, so the join of the
    two is between tables, whose large keys adaptive execution splits; rounds that are past are deleted. Null ends are
    ignored; without edges the result is empty.
    """
    spark = edges.sparkSession
    path = work_path(spark, "links")
    now = written(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "", path)
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    state = None
    while True:
        past, least_path, path = path, work_path(spark, "least"), work_path(spark, "links")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m")), "", least_path)
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "", path)
        delete(spark, past)
        delete(spark, least_path)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = seen


def mapped(uri: str):
    """The bytes of a file in the shared folder as an array: mapped into memory where the folder is mounted, else read."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    if fs.type_name == "local":
        return np.memmap(path, np.uint8, "r")
    with fs.open_input_stream(path) as f:
        return np.frombuffer(f.read(), np.uint8)


def runs_of(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    if not len(values):
        return []
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]])
    return list(zip(values[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist()))


def packed(positions: np.ndarray) -> bytes:
    """Ascending positions as 16-bit differences; steps of 65535 and more take several."""
    steps = np.diff(positions.astype(np.int64), prepend=0)
    more = steps // 65535
    out = np.full(len(steps) + int(more.sum()), 65535, "<u2")
    out[np.arange(len(steps)) + np.cumsum(more)] = steps % 65535
    return len(out).to_bytes(4, "little") + pa.compress(out.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[:4], "little")
    steps = np.frombuffer(pa.decompress(raw[4:], 2 * size, "zstd", asbytes=True), "<u2").astype(np.int64)
    return np.cumsum(steps)[steps != 65535]
