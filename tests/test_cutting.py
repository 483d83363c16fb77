"""Words are cut from the bytes of texts, some texts at a time, and once for all that reads them."""

import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from sieveline.operators import search

rng = random.Random(1)
TEXTS = [rng.choice([None, "", "a", "_", "é", "aé", "éa b", *["".join(rng.choices("ab0_ é\n-日", k=rng.randint(0, 12))) for _ in range(9)]]) for _ in range(3000)]


def words(text):
    return [t for t in re.split("[^a-z0-9_]+", text or "") if t]


def test_words_of_slices_equal_a_regular_expression(monkeypatch):
    monkeypatch.setattr(search, "SLICE_BYTES", 50)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS, pa.string())], names=["d", "words"])
    for whole in (batch, batch.slice(5), batch.slice(0, 0)):
        parts = list(search.counted()([whole]))
        rows = [r for b in parts for r in b.to_pylist()]
        assert [r["d"] for r in rows] == whole.column(0).to_pylist()
        assert all(b.num_rows == 1 or sum(len((TEXTS[i] or "").encode()) for i in b.column(0).to_pylist()) <= 50 for b in parts)
        for r in rows:
            assert dict(zip(r["terms"], r["tfs"])) == Counter(words(TEXTS[r["d"]])) and r["dl"] == len(words(TEXTS[r["d"]]))
    few = [r for b in search.counted(["a", "ab"])([batch]) for r in b.to_pylist()]
    assert all(dict(zip(r["terms"], r["tfs"])) == {t: n for t, n in Counter(words(TEXTS[r["d"]])).items() if t in ("a", "ab")} and r["dl"] == len(words(TEXTS[r["d"]])) for r in few)


def test_texts_are_cut_once_for_all_that_scores_need(spark):
    cuts = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        cuts.add(1)
        return text

    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[:40])], "doc_id long, content string")
    asked = spark.createDataFrame([("q", "a"), ("q", "ab")], "query_id string, term string")
    postings, lengths = search.build_postings(chunks, text=seen(F.col("content")), terms=["a", "ab"])
    assert search.bm25(postings, lengths, asked).count() == sum(bool({"a", "ab"} & set(words(t))) for t in TEXTS[:40])
    assert cuts.value <= 80  # whether a text is null, and the text
    assert {r["doc_id"] for r in lengths.where("dl is null").collect()} == {i for i, t in enumerate(TEXTS[:40]) if t is None}
