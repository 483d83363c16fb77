"""Cases that must stay small: a full hot unit of vectors, long texts without white space."""

import random
import resource
import time

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from sieveline.llm import lattice_dedup, queries, token_count


def test_edges_that_connect():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60):
        a, b = rng.integers(0, 40, n), rng.integers(0, 40, n)
        component = {x: x for x in {*a.tolist(), *b.tolist()}}
        for _ in component:
            for x, y in zip(a.tolist(), b.tolist()):
                component[x] = component[y] = min(component[x], component[y])
        got = dict(zip(*(x.tolist() for x in lattice_dedup.spanning(a, b))))
        assert got == {x: r for x, r in component.items() if x != r}


def test_two_full_blocks_of_near_copies():
    n, dims = 4096, 64
    rng = np.random.default_rng(0)
    x = rng.standard_normal(dims) + rng.standard_normal((2 * n, dims)) * 0.02
    vectors = pa.array([lattice_dedup.packed(v) for v in x.astype("f4").astype("f8")], pa.binary())
    planes = lattice_dedup.projections(dims)
    keys = lattice_dedup.cell_keys(lattice_dedup._units(vectors.to_pylist()), planes) ^ (dims << 40)
    values, counts = np.unique(keys[:, 0, 0], return_counts=True)
    key = values[counts.argmax()]  # what most of them share in the first table
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.full(2 * n, key)), pa.array(np.zeros(2 * n, np.int32)), pa.array(np.ones(2 * n, np.int32)), pa.array(np.repeat(np.array([0, 1], np.int32), n)), pa.array(np.arange(2 * n)), pa.array(np.ones(2 * n, np.int64)), pa.array(np.zeros(2 * n, np.int32)), vectors, pa.array(np.full(2 * n, dims, np.int32))],
        names=["key", "low", "high", "block", "node", "copies", "at", "vector", "dims"],
    )
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.monotonic()
    links = nodes = 0
    for out in lattice_dedup._compared(0.9, lattice_dedup.TABLES, lattice_dedup.BLOCKS, lattice_dedup.SCALE, lattice_dedup.SEED)(iter([batch])):
        kind = out.column(0).to_numpy()
        links += int(out.column(2).to_numpy()[kind == 0].sum())
        nodes += len(out)
    assert links == 2 * n * n  # each of one block with each of the other, told from both ends
    assert time.monotonic() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_texts_without_white_space_are_encoded_once(spark):
    rng = random.Random(3)
    alone = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(200_000))
    mixed = " ".join([alone[:90_000], "some words here " * 20_000, alone[:70_000], "and the end"])
    assert token_count.overlap_for(alone, 256) >= len(alone) and token_count.overlap_for("a b " * 9999, 256) == 256
    df = spark.createDataFrame([(1, alone), (2, mixed), (3, alone[:40_000] + "\n" + alone[:40_000])], "doc_id long, text string")
    chunks = list(token_count._chunks(32_768, 256)(iter([pa.RecordBatch.from_pydict({"row": ["a", "b"], "text": [alone, mixed]})])))
    assert sum(len(c.column(7)[0].as_py()) for c in chunks) <= 2 * (len(alone) + len(mixed))
    tok = Tokenizer.from_file(queries.WORD_BPE)
    tok.no_truncation()
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(df, queries.WORD_BPE).collect()}
    assert got == {r["doc_id"]: len(tok.encode(r["text"], add_special_tokens=False).ids) for r in df.collect()}
