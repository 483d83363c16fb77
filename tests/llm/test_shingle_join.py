"""Near copies by shingle sets against brute force over tuples of words."""

import itertools
import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import golay_simhash, shingle_join
from tests.llm.test_operators import ODD, classes, docs


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def is_near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def planted():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    common = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for n in (12, 60, 200):
        base = [rng.choice(vocabulary) for _ in range(n)] + common
        for edits in [*range(8), *[2] * 12]:
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += [" ".join([*common, *(rng.choice(vocabulary) for _ in range(rng.randint(1, 80)))]) for _ in range(40)]
    return texts + ODD + ["A B c", "a b  C", "a b c d e", "x\ty x y"]


@pytest.mark.parametrize("how", [{}, {"block_rows": 5}, {"block_rows": 7}])
def test_near_copies(spark, how):
    texts = planted()
    known = [sets(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if is_near(known[a], known[b])]
    want = classes(range(len(texts)), links)
    rows = docs(spark, texts)
    got = {r["doc_id"]: r["component"] for r in shingle_join.near_copies(rows.unionByName(rows), "doc_id", **how).collect()}
    assert len(set(want.values())) < len(want) and {i: min(k for k in got if got[k] == c) for i, c in got.items()} == want
    assert shingle_join.near_copies(docs(spark, []), "doc_id", **how).count() == 0
    if not how:
        found = {r["doc_id"]: r["component"] for r in golay_simhash.near_copies(rows.unionByName(rows), "doc_id").collect()}
        assert {i: min(k for k in found if found[k] == c) for i, c in found.items()} == want
        assert golay_simhash.near_copies(docs(spark, []), "doc_id").count() == 0


def test_stage_removes_near_copies_at_0_8(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    base = [[rng.choice(vocabulary) for _ in range(100)] for _ in range(20)]
    near, far = [], []
    for w in base:
        near.append([*w[:88], *(rng.choice(vocabulary) for _ in range(4)), *w[92:]])  # similarity 88 / 104 of shingles
        far.append([*w[:80], *(rng.choice(vocabulary) for _ in range(10)), *w[90:]])  # 82 / 110
    rows = docs(spark, [" ".join(w) for w in base + near + far])
    got = {r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, rows.select(*corpus_pipeline.COLUMNS), "").collect()}
    assert got == {*range(20), *range(40, 60)}


@pytest.mark.parametrize("bits", [2, 9])
def test_rarity_is_never_too_small(tmp_path, monkeypatch, bits):
    monkeypatch.setattr(shingle_join, "SLICE_BITS", 7)
    bits = max(7, bits)
    texts = planted()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["node", "text"])
    halves = [batch.slice(0, 30), batch.slice(30)]
    rows = sorted((tuple(r.values()) for h in halves for out in shingle_join._sketched(5, bits)([h.select(["text"])]) for r in out.to_pylist()), key=lambda r: r[0])
    merged = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["slice", "at", "n"])
    list(shingle_join._merged(f"file://{tmp_path}")([merged]))
    h = np.concatenate([shingle_join.shingles(t) for t in texts])
    known, times = np.unique(h, return_counts=True)
    found = shingle_join.Rarity(f"file://{tmp_path}", bits).of(known)
    assert (found >= np.rint(8 * np.log2(times))).all() and found.max() > 0


def test_rounds_choose_pairs(spark):
    rng = np.random.default_rng(4)
    m = 40
    unit = {"key": np.zeros(m, np.int64), "n": np.sort(rng.integers(90, 120, m)), "at": rng.integers(0, 5, m), "own": rng.integers(0, 9, m), "group": rng.integers(0, 6, m), "node": np.arange(m)}
    unit |= {"low": np.zeros(m, np.int64), "high": np.zeros(m, np.int64), "block": np.zeros(m, np.int64), "odd": rng.integers(0, 2**3, (m, 16)).astype(np.uint64)}
    pairs = {(int(i), int(j)) for a, b in shingle_join._all(unit) for i, j in zip(a, b)}
    apart = lambda i, j: int(np.bitwise_count(unit["odd"][i] ^ unit["odd"][j]).sum())
    want = {(i, j) for i, j in itertools.combinations(range(m), 2) if unit["group"][i] != unit["group"][j] and 9 * min(unit["n"][i] - unit["at"][i], unit["n"][j] - unit["at"][j]) >= 4 * (unit["n"][i] + unit["n"][j]) and 9 * apart(i, j) <= unit["n"][i] + unit["n"][j]}
    assert pairs == want and want
    for most in (1, 10, 10**6):
        got = [(int(i), int(j)) for a, b in shingle_join._best(unit, most) for i, j in zip(a, b)]
        groups = lambda i, j: tuple(sorted((int(unit["group"][i]), int(unit["group"][j]))))
        least = {g: min(apart(i, j) / (unit["n"][i] + unit["n"][j]) for i, j in want if groups(i, j) == g) for g in {groups(*p) for p in want}}
        assert len(got) == len(least) and {groups(i, j): apart(i, j) / (unit["n"][i] + unit["n"][j]) for i, j in got} == least
