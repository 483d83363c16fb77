"""Token ids as Parquet list columns.

Documents are range-sorted by id and written one sorted file for each range. The id lists are dictionary encoded (a
vocabulary fits a dictionary page), document ids and counts delta encoded; row groups and pages have stated sizes and
the files carry page indexes, so readers fetch single row groups, pages or only the metadata columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm import _tokens
from sieveline.llm._shared import partitions, work_path

END_ID = 0
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
#: Bytes of text for each shard, which is one task's work and one file.
SHARD_BYTES = 64 << 20
#: Bytes of text that are encoded at once: the more, the fewer words the library meets again.
SLICE_BYTES = 3_000_000
SCHEMA = "doc_id long, shard int, row int, n_tokens int, tokens array<int>"

WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#row": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = _tokens.LibraryEncoder(path), 0
        for batch in batches:
            at = 0
            for texts in _tokens.slices(_tokens.strings_of(batch.column(1)), SLICE_BYTES):
                ids, starts = encoder.encode(texts)
                n = len(texts)
                ids, starts = np.insert(ids, starts[1:], np.int32(end_id)), starts + np.arange(n + 1)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))
                rows, sizes = np.arange(row, row + n, dtype=np.int32), np.diff(starts).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array(rows), pa.array(sizes), lists], names=["doc_id", "shard", "row", "n_tokens", "tokens"])
                row, at = row + n, at + n

    return run


def write(docs: DataFrame, tokenizer_path: str, to: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shards: int | None = None) -> str:
    """Writes the ids of every text, the end id after each, in ascending order of document ids; returns the files' folder.

    A null or empty text is the end id alone; rows whose id is null are left out; rows that repeat an id stand next to
    each other by text; an empty table gives files without rows; further columns are ignored. ``row`` counts within a
    shard, and shards ascend, so (shard, row) is the order of the corpus. ``shards`` follows the bytes of text where it
    isn't given, and is at least the session's number of shuffle partitions.
    """
    spark = docs.sparkSession
    to = to or work_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    if shards is None:
        shards = max(partitions(spark), -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    dealt = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())
    dealt.select("doc_id", "text", "shard").mapInArrow(_encoded(tokenizer_path, end_id), SCHEMA).write.options(**WRITER).parquet(to)
    return to


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        flat, cuts = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(cuts).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "shard", "row", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The stored rows: doc_id, shard, row, n_tokens, tokens. Selecting metadata alone reads no token page."""
    return spark.read.schema(SCHEMA).parquet(folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document from the files: doc_id, start (ids before it), n_tokens, ids_crc32.

    The shards' totals come from the count column alone, one row a shard; positions within a shard are running sums.
    """
    stored = read(spark, folder)
    totals = stored.groupBy("shard").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over one row a shard
    before = totals.select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    digests = stored.select("doc_id", "shard", "row", "tokens").mapInArrow(_digests, "doc_id long, shard int, row int, n_tokens long, ids_crc32 long")
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    placed = digests.withColumn("within", F.coalesce(within, F.lit(0)))
    return placed.join(before, "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
