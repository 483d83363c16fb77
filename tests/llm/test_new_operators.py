"""Operators 11 to 13 against brute force, with the cases that tables can hold."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import filter_audit, hard_negatives, learned_partitions

VEC = "vec_id long, embedding array<double>, label int, rank int, score double"


# ---- 11 ----
def brute_audit(docs, labels):
    def words(t):
        return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, source in docs:
        text = text or ""
        w = words(text)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text)}
        f["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        fails.append((source or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out = set()
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        removed = {}
        rows = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in own) - len(gone)
                left = [x for x in left if f not in x[1]]
                removed[f] = removed.get(f, 0) + len(gone)
                rows.append((part, "".join(order), step, len(left), len(gone), redundant, sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f))
        out |= {(*r[:9], removed[r[9]]) for r in rows}
    return out


def test_audit_against_every_order(spark):
    rng = random.Random(1)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "  \t\x0b", "one two", long, long + " #", long.upper(), "same " * 300, "é" * 50 + " X", long + "\x85\xa0", "SAME % " * 150, "x" * 3000, "\x1c".join(["a"] * 300)]
    docs = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(80)] + [(None, long, "a"), (None, None, None), (5, long, "b"), (5, long, "b"), (7, "", "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(60)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, source string, mask int, part string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.labelled(filter_audit.failures(d), lab)).collect()
    assert {tuple(r) for r in got} == brute_audit(docs, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in docs})


def test_audit_of_nothing(spark):
    d, lab = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.labelled(filter_audit.failures(d), lab)).count() == 0
    one = spark.createDataFrame([(1, "a", "s")], d.schema)
    assert filter_audit.audit(filter_audit.labelled(filter_audit.failures(one), lab)).count() == 600


def test_inversion_is_exact():
    counts = np.random.default_rng(3).integers(0, 10**12, (4, 3, 32))
    sums = counts @ filter_audit.parities()
    assert (filter_audit.cells(sums) == counts).all()


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(filter_audit, "STRETCH", 50)
    raw = (" ".join(random.Random(2).choice("abc") * random.Random(i).randint(1, 90) for i in range(99)) + "\t\n end").encode()
    assert filter_audit.word_counts(raw) == (len(raw.split()), len(set(raw.split())))
    assert filter_audit.judged(pa.array(["a b", "", "A#"]).slice(1))[0].tolist() == [1, 1 | 4 | 8]


# ---- 12 ----
def vectors(n, dims, seed=0, start=0):
    x = np.random.default_rng(seed).standard_normal((n, dims))
    return [(start + i, [float(v) for v in r], i % 3, 0, 0.0) for i, r in enumerate(x)]


def brute_nearest(rows, k=20, every=20):
    good = [(i, v) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, q in good:
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(near, 1)}
    return out


def test_search_of_all_parts_is_exact(spark):
    rows = vectors(400, 8) + [(i, [1.0, 2.0] + [0.0] * 6, 1, 0, 0.0) for i in range(400, 470)]
    rows += [(480, None, 1, 0, 0.0), (500, [], 1, 0, 0.0), (520, [0.0] * 8, 1, 0, 0.0), (540, [1.0, None] + [0.0] * 6, 1, 0, 0.0), (560, [float("nan")] * 8, 1, 0, 0.0), (580, [float("inf")] + [0.0] * 7, 1, 0, 0.0), (None, [1.0] * 8, 1, 0, 0.0)]
    rows += [(600, [1.0, 1.0], 1, 0, 0.0), (601, [2.0, 0.5], 1, 0, 0.0), (-20, [3.0] * 8, 1, 0, 0.0), (30, rows[30][1], 1, 0, 0.0)]
    df = spark.createDataFrame(rows, VEC)
    got = learned_partitions.search(df, rows_per_part=50, recall=1.0, trials=1000).collect()
    want = brute_nearest(rows)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {w[:3] for w in want}
    assert {(r["query_id"], r["rank"]): r["score"] for r in got} == pytest.approx({w[:2]: w[3] for w in want})


def test_blocks_do_not_change_the_result(spark):
    df = spark.createDataFrame(vectors(600, 16) + [(i, [0.5] * 16, 0, 0, 0.0) for i in range(600, 900)], VEC)
    rows, kind = learned_partitions.usable(df)
    queries = rows.where("vec_id % 20 = 0")
    index = learned_partitions.build(rows, kind, queries, rows_per_part=100)
    whole, cut = (sorted(map(tuple, learned_partitions.ranked(index, queries, 20, a, b).collect())) for a, b in ((32768, 32768), (40, 7)))
    assert whole == cut and len(whole) == 45 * 20


def test_recall_at_production_settings(spark):
    rows = vectors(6000, 32, 5)
    found = learned_partitions.search(spark.createDataFrame(rows, VEC)).collect()
    want = {w[:1] + w[2:3] for w in brute_nearest([r for r in rows])}
    assert len(found) == len(want) and len({(r["query_id"], r["vec_id"]) for r in found} & want) >= 0.93 * len(want)


def test_parts_are_balanced_and_the_fit_is_fixed():
    x = np.random.default_rng(2).standard_normal((1000, 8))
    near = learned_partitions.neighbours(x, 8)
    part = learned_partitions.cut_graph(x, near, 10)
    assert np.bincount(part, minlength=10).max() <= 105
    assert (part[near] == part[:, None]).mean() > 0.3  # a tenth, were it by chance
    assert (learned_partitions.fit(x, 10) == learned_partitions.fit(x, 10)).all()


def test_search_of_few_rows(spark):
    assert learned_partitions.search(spark.createDataFrame([], VEC)).collect() == []
    got = learned_partitions.search(spark.createDataFrame([(0, [1.0, 0.0], 1, 0, 0.0), (3, [0.5, 0.0], None, 0, 0.0), (9, [0.5, 0.0], 1, 0, 0.0)], VEC)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 3, 0.5), (0, 2, 9, 0.5)]
    assert learned_partitions.search(spark.createDataFrame([(20, [1.0], 1, 0, 0.0)], VEC)).collect() == []


# ---- 13 ----
def brute_mine(rows, every=100):
    good = []
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, q, label in good:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, other) for j, v, other in good if j != i and len(v) == len(q))
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            found = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"anchor_rows": 3, "shard_rows": 40, "chunk_dims": 3}])
def test_mining_against_all_rows(spark, settings):
    rows = vectors(700, 8, 3) + [(700 + i, [0.9, 0.1, -0.3] + [0.2] * 5, i % 4, 0, 0.0) for i in range(120)]
    rows += [(1000, None, 1, 0, 0.0), (1100, [1.0, None] + [0.0] * 6, 1, 0, 0.0), (1200, [float("nan")] * 8, 1, 0, 0.0), (1300, [1.0] * 8, None, 0, 0.0), (None, [1.0] * 8, 1, 0, 0.0), (1400, [], 1, 0, 0.0)]
    rows += [(1500, [0.0] * 8, 2, 0, 0.0), (1600, [5.0, 1.0], 1, 0, 0.0), (1601, [4.0, 1.0], 1, 0, 0.0), (1602, [4.0, 0.9], 2, 0, 0.0), (-100, [0.3] * 8, 9, 0, 0.0), (800, [2000.5] * 8, 1, 0, 0.0)]
    df = spark.createDataFrame(rows, VEC)
    got = hard_negatives.mine(hard_negatives.usable(df), **settings)
    assert sorted(map(tuple, got.collect())) == brute_mine(rows)


def test_mining_of_nothing_and_of_scores_too_large(spark):
    assert hard_negatives.mine(hard_negatives.usable(spark.createDataFrame([], VEC))).collect() == []
    assert hard_negatives.mine(hard_negatives.usable(spark.createDataFrame([(1, [1.0], 1, 0, 0.0)], VEC))).collect() == []
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine(hard_negatives.usable(spark.createDataFrame([(0, [1e30], 1, 0, 0.0), (1, [1e30], 1, 0, 0.0)], VEC))).collect()


def test_tiles_keep_every_number():
    x = np.array([[0, -1, 32767, -32768], [32768, 2**61, -(2**61), 5]])
    assert (hard_negatives.unpacked(hard_negatives.packed(x), 2) == x).all()
    a, b = np.array([[2**29, 3]]), np.array([[2**30, -1], [1, 1]])
    assert hard_negatives.product(a, b).tolist() == [[2**59 - 3, 2**29 + 3]]
