"""Benchmark items that are out of the ordinary, on the inlined, the broadcast and the shuffled path."""

import pytest

from sieveline.llm import decontaminate
from tests.llm.test_operators import docs

PATHS = [{}, {"inline": 1}, {"inline": 1, "broadcast": 1}]


@pytest.mark.parametrize("how", PATHS)
def test_very_long_words(spark, how):
    long, item = "Ab9" * 20_000, " ".join(f"w{i}" for i in range(14))
    texts = [f"x {item} y", f"x {long} y", " ".join([long, *["z"] * 12]), f"{long}x", "clean"]
    benchmark = spark.createDataFrame([("a,\t\n=b", item), ("", item), ("é", long), ("c", " ".join([long, *["z"] * 12]))], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.decontaminate(docs(spark, texts), benchmark, **how).collect()}
    assert got == {0: (14, ["", "a,\t\n=b"], True), 1: (1, ["é"], True), 2: (13, ["c", "é"], True), 3: (0, [], False), 4: (0, [], False)}


@pytest.mark.parametrize("how", PATHS)
def test_items_without_id(spark, how):
    one, two = (" ".join(f"{k}{i}" for i in range(14)) for k in "ab")
    texts = [f"x {one} y", f"{one} {two}", two, "clean"]
    benchmark = spark.createDataFrame([(None, one), (None, one), (7, two), (None, two), (None, None)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in decontaminate.decontaminate(docs(spark, texts), benchmark, **how).collect()}
    assert got == {0: (14, 0, [], True), 1: (28, 1, ["7"], True), 2: (14, 1, ["7"], True), 3: (0, 0, [], False)}


@pytest.mark.parametrize("how", PATHS)
def test_rows_that_differ_by_nulls_and_borders(spark, how):
    benchmark = spark.createDataFrame([(1, "5"), (2, "q x"), (3, "x"), (4, "5 q")], "item_id long, text string")
    rows = spark.createDataFrame([(None, "5 q x"), (5, "q x"), (5, "q x"), (None, "q x"), (None, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["items"])) for r in decontaminate.decontaminate(rows, benchmark, **how).collect())
    assert got == [("5", 2, 2, "2,3"), ("5", 2, 2, "2,3"), ("None", 0, 0, ""), ("None", 2, 2, "2,3"), ("None", 3, 3, "1,2,3,4")]


@pytest.mark.parametrize("how", PATHS)
def test_more_windows_than_lists(spark, how):
    item = " ".join(f"w{i}" for i in range(3000))
    got = decontaminate.decontaminate(docs(spark, [item, f"a {item} b", "w1 w2"]), spark.createDataFrame([("i", item)], "item_id string, text string"), **how).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == {0: (3000, 3000, ["i"]), 1: (3002, 3000, ["i"]), 2: (2, 0, [])}
