"""Interaction of filters by a Walsh-Hadamard audit.

Every document has a mask of the filters it fails. Each part's documents are summed with the sign that the parity of
their mask within each subset of filters gives them, once for all documents, once for the good and once for the toxic
ones. These sums are inverted exactly to the number of documents with each mask, and from these numbers follow all
orders of the filters, step by step, and the filters' Shapley values, as a document that fails f filters is removed by
each of them in one of f orders.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import _tokens
from sieveline.llm._shared import written

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Bytes of a text whose words are told apart at once.
STRETCH = 1 << 20
#: Bytes of texts that a task judges at once; a longer text stands alone.
SLICE_BYTES = 4_000_000
#: What is counted: all documents, those of quality 1, those marked toxic.
COUNTED = ("all", "good", "toxic")
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_ODD = np.isin(np.arange(256), list(b"#$%&*|"))


def word_counts(raw: bytes) -> tuple[int, int]:
    """Words of a text and how many differ; a long text is cut at white space, so its words are never listed at once."""
    if len(raw) <= STRETCH:
        words = raw.split()
        return len(words), len(set(words))
    n, seen, start = 0, set(), 0
    while start < len(raw):
        cut = _WHITE.search(raw, start + STRETCH)
        end = cut.start() if cut else len(raw)
        words = raw[start:end].split()
        n, start = n + len(words), end
        seen.update(words)
    return n, len(seen)


def judged(texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """The filters A to D that each text fails, as bits from A on, and the SHA-256 of each text."""
    data, at = _tokens.raw_of(texts)
    data, at = data[at[0] : at[-1]], at - at[0]

    def per_text(marks: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return upto[at[1:]] - upto[at[:-1]]

    raw = [data[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
    words = np.array([word_counts(x) for x in raw], np.int64).reshape(-1, 2)
    fails = (
        words[:, 0] < LEAST_WORDS,
        100 * words[:, 1] < 50 * words[:, 0],
        100 * per_text((data >= 65) & (data <= 90)) > 2 * per_text((data & 0xC0) != 0x80),
        per_text(_ODD[data]) > 0,
    )
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails)), [hashlib.sha256(x).digest() for x in raw]


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start = 0
        for texts in _tokens.slices(_tokens.strings_of(batch.column(2)), SLICE_BYTES):
            mask, digests = judged(texts)
            rows = batch.slice(start, len(texts))
            start += len(texts)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(digests, pa.binary()), pa.array(mask, pa.int32())], names=["doc_id", "part", "digest", "mask"])


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each row: doc_id, part, mask (bits of the filters it fails, A first).

    Null texts are empty, null parts the empty string. Texts are the same if their SHA-256 is. Rows without an id have
    no place among the others: they never fail E and make no other fail it; of rows that repeat the smallest id of a
    text none fails it. An empty table gives an empty result; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = written(rows.mapInArrow(_judged, "doc_id long, part string, digest binary, mask int"), "judged")
    known = found.where("doc_id is not null")
    # the first of each text is found by its id too: however many copies a text has, the ids spread them
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copies = known.join(first, ["doc_id", "digest"], "left")
    copied = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return copies.select("doc_id", "part", F.col("mask").bitwiseOR(copied).alias("mask")).unionByName(found.where("doc_id is null").select("doc_id", "part", "mask"))


def labelled(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``good`` (some label row of the document has quality 1) and ``toxic`` (some has toxic 1)."""
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = failed.where("doc_id is not null").join(flags, "doc_id", "left")
    out = known.unionByName(failed.where("doc_id is null").withColumn("good", F.lit(False)).withColumn("toxic", F.lit(False)))
    return out.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def parity_sums(rows: DataFrame, n: int = len(FILTERS)) -> DataFrame:
    """(part, sums): for each thing counted, and each subset of the n filters, the documents with an even number of failures in it less those with an odd one."""
    sums = []
    for counted in COUNTED:
        for subset in range(1 << n):
            sign = 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(subset)) % 2)
            sums.append(F.sum(sign if counted == "all" else F.when(F.col(counted), sign).otherwise(0)).cast("long"))
    return rows.groupBy("part").agg(F.array(*sums).alias("sums"))


def parities(n: int = len(FILTERS)) -> np.ndarray:
    """The Walsh-Hadamard matrix: 1 where two subsets share an even number of elements, else -1."""
    bits = np.arange(1 << n)
    return np.array([[1 - 2 * ((a & b).bit_count() % 2) for b in bits.tolist()] for a in bits.tolist()], np.int64)


def cells(sums: np.ndarray) -> np.ndarray:
    """Documents with each mask from the signed sums of subsets along the last axis; exact, as the matrix is its own inverse but for its size."""
    size = sums.shape[-1]
    return sums @ parities(size.bit_length() - 1) // size


def _steps(filters: str) -> tuple[list[str], np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Orders, the steps' numbers and filters, and for each step which masks are kept after it, removed by it, or fail its filter after their removal."""
    n = len(filters)
    orders, step, bit, before = [], [], [], []
    for order in permutations(range(n)):
        gone = 0
        for i, f in enumerate(order):
            orders.append("".join(filters[x] for x in order))
            step.append(i + 1)
            bit.append(f)
            before.append(gone)
            gone |= 1 << f
    mask, own, past = np.arange(1 << n), 1 << np.array(bit)[:, None], np.array(before)[:, None]
    fails, alive = (mask & own) != 0, (mask & past) == 0
    return orders, np.array(step, np.int32), np.array(bit), {"kept": alive & ~fails, "removed": alive & fails, "redundant": fails & ~alive}


def _evaluated(filters: str):
    orders, step, bit, which = _steps(filters)
    n = len(filters)
    which = {k: v.astype(np.int64).T for k, v in which.items()}
    every = len(set(orders))
    # a mask of f failures is removed by each of its filters in one of f orders
    share = np.array([[every // m.bit_count() if m >> f & 1 else 0 for m in range(1 << n)] for f in range(n)], np.int64).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 256):
                batch = whole.slice(start, 256)
                sums = np.array(batch.column(1).to_pylist(), np.int64).reshape(len(batch), len(COUNTED), 1 << n)
                every_doc, good, toxic = cells(sums).transpose(1, 0, 2)
                out = {name: every_doc @ where for name, where in which.items()}
                out["unique_fails"] = every_doc[:, 1 << bit]
                out["good_lost"], out["toxic_lost"] = good @ which["removed"], toxic @ which["removed"]
                out["shapley"] = (every_doc @ share)[:, bit]
                part = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), len(orders))))
                yield pa.RecordBatch.from_arrays([part, pa.array(orders * len(batch)), pa.array(np.tile(step, len(batch))), *(pa.array(v.reshape(-1)) for v in out.values())], names=["part", "filter_order", "step", *out])

    return run


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What each filter does at each step of every order of ``filters``, by part.

    ``rows`` has a row for each document: part, mask, good, toxic. Returns part, filter_order, step, and documents kept
    after the step, removed by it, redundant (failing its filter, but removed earlier), unique_fails (failing this filter
    alone), good_lost, toxic_lost and shapley (what the filter removes, summed over all orders). No rows, no result.
    """
    counts = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return parity_sums(rows, len(filters)).mapInArrow(_evaluated(filters), f"part string, filter_order string, step int, {counts}")
