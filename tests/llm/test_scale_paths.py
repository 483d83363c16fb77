"""Shards and their bounds, archives of very many records, footers of the token store, sketches in slices."""

import glob
import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sieveline.llm import _shared, lattice_dedup, substring_dedup, token_store, warc_writer
from tests.llm.test_operators import BYTE_BPE, docs


@pytest.mark.parametrize("starts", [[], [5], [-(2**63), 3], [1, 2, 3], [-7, 0, 4, 9, 20], list(range(-300, 300, 7))])
def test_shard_of(spark, starts):
    ids = [-(2**63), -301, -8, -7, 0, 1, 2, 3, 4, 5, 8, 9, 19, 20, 299, 2**63 - 1]
    got = spark.createDataFrame([(i,) for i in ids], "page_id long").select("page_id", warc_writer.shard_of("page_id", starts).alias("s")).collect()
    assert {r["page_id"]: r["s"] for r in got} == {i: sum(x <= i for x in starts) for i in ids}


def test_bounds_of_repeated_ids(spark):
    ids = [(7,)] * 500 + [(i,) for i in range(20)] + [(None,)]
    starts = warc_writer.bounds(spark.createDataFrame(ids, "page_id long"), "page_id", 4)
    assert starts == [5, 10, 15] and warc_writer.bounds(spark.createDataFrame([], "page_id long"), "page_id", 4) == []


def test_a_shard_is_a_task(spark):
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("x"), 20).alias("html"))
    folder = warc_writer.write(pages, shards=9)
    manifest = spark.read.json(f"{folder}/manifest").collect()
    assert len(manifest) == 9 and all(400 < r["n_records"] < 490 for r in manifest)


def test_parsing_time_follows_the_records():
    def archive(n):
        return b"".join(warc_writer.record(i, "u", b"<p>%d</p>" % i, "0" * 64, None, 1) for i in range(n))

    def took(raw, n):
        began = time.perf_counter()
        assert sum(1 for _ in warc_writer.parse(raw)) == n
        return time.perf_counter() - began

    small, large = archive(2000), archive(32_000)
    took(small, 2000)
    assert took(large, 32_000) < 40 * max(0.02, took(small, 2000))
    assert list(warc_writer.parse(b"")) == []


def test_token_files(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["the", "of", "house", "river", "Ünder"], k=rng.randint(1, 200))) for _ in range(3000)]
    folder = token_store.write(docs(spark, texts), BYTE_BPE, shards=2).removeprefix("file://")
    files = [f for f in glob.glob(f"{folder}/*.parquet") if pq.ParquetFile(f).metadata.num_rows]
    assert len(files) == 2
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        tokens = columns.pop("tokens.list.element")
        assert "RLE_DICTIONARY" in tokens.encodings and tokens.has_dictionary_page
        for name in ("doc_id", "row", "n_tokens"):
            assert "DELTA_BINARY_PACKED" in columns[name].encodings and not columns[name].has_dictionary_page
        assert all(c.has_offset_index and c.has_column_index for c in [tokens, *columns.values()])
    stored = token_store.read(spark, f"file://{folder}")
    assert "tokens:array" in stored._jdf.queryExecution().executedPlan().toString() and "tokens:array" not in stored.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()


def test_sketch_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE_COUNTERS", 64)
    rng = np.random.default_rng(4)
    width = 64 * 40
    times = [rng.integers(0, width, 500) for _ in range(2)]
    folder = f"file://{tmp_path}/sketch"
    (tmp_path / "sketch").mkdir()
    for depth, at in enumerate(times):
        count = np.bincount(at, minlength=width).reshape(-1, 64)
        for s in np.flatnonzero((count > 1).any(axis=1)):
            (tmp_path / "sketch" / str(depth << 20 | int(s))).write_bytes(np.packbits(count[s] > 1, bitorder="little").tobytes())
    sketch = substring_dedup.Sketch(folder)
    for depth, at in enumerate(times):
        some = rng.integers(0, width, 3000)
        assert (sketch.twice(depth, some) == (np.bincount(at, minlength=width)[some] > 1)).all()


def test_cells_are_told_once():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((50, 64)).astype(np.float32)
    import pyarrow as pa

    raw = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([1] * 50), pa.array([lattice_dedup.packed(x.astype(np.float64)) for x in v], pa.binary())], names=["node", "copies", "vector"])
    got = [r for b in lattice_dedup._keyed(3, 2, 5.0, 7)([raw]) for r in b.to_pylist()]  # wide cells, so that keys repeat
    want = lattice_dedup.cell_keys(lattice_dedup._units(raw.column(2).to_pylist()), lattice_dedup.projections(64, 3, 2, 7), 5.0) ^ (64 << 40)
    assert sorted((r["node"], r["key"]) for r in got) == sorted((i, k) for i, row in enumerate(want.reshape(50, -1).tolist()) for k in set(row))
    assert all(r["key"] in want[r["node"], r["at"]] for r in got)


def test_scratch_and_shared_folder(spark):
    with _shared.scratch(spark):
        table = _shared.written(spark.range(3), "x")
        path = table.inputFiles()[0].rsplit("/", 1)[0]
        assert table.count() == 3 and glob.glob(path.removeprefix("file://").removeprefix("file:"))
    assert not glob.glob(path.removeprefix("file://").removeprefix("file:"))
