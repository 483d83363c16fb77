"""Rows without an id, and rows that share one, in the stages that drop rows."""

import random

import corpus_pipeline


def test_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(3)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    a, b, c, d, item = prose(60), prose(60), prose(60), prose(60), prose(30)
    leak = f"{item} {prose(20)}"
    rows = [(None, "12 34"), (1, None), (1, a), (1, a), (None, a.upper()), (None, b), (None, b), (2, leak), (2, c), (None, leak), (None, d), (3, d), (3, "?!"), (3, f"{c} end")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")

    def left(df):
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=key)

    language, near, clean = (stage for _, stage in corpus_pipeline.STAGES[:3])
    docs = language(spark, docs, str(tmp_path))
    assert left(docs) == sorted((r for r in rows if r[1] not in (None, "12 34", "?!")), key=key)
    assert left(clean(spark, docs, str(tmp_path))) == sorted((r for r in rows if r[1] not in (None, "12 34", "?!", leak)), key=key)
    docs = near(spark, docs, str(tmp_path))
    assert left(docs) == sorted([(1, a), (None, b), (2, leak), (2, c), (3, d)], key=key)
    assert left(clean(spark, docs, str(tmp_path))) == sorted([(1, a), (None, b), (2, c), (3, d)], key=key)


def test_no_labels_at_all(spark, tmp_path):
    rows = [(1, "a b"), (2, "½"), (None, "z"), (3, None)]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["text"] for r in corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()} == {"a b", "z"}


def test_keys_tell_all_columns_apart(spark):
    rows = [(1, "ab", "c", "s", 2), (1, "a", "bc", "s", 2), (1, None, "c", "s", 2), (1, "-", "c", "s", 2), (1, "", "c", "s", 2), (1, "2:ab", "c", "s", 2), (None, "ab", "c", "s", 2), (12, "ab", "c", "s", None), (1, "ab", None, "s", 2), (1, "é", "c", "s", 2)]
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string, lang string, source string, n_chars long")
    keyed = corpus_pipeline._keyed(docs).collect()
    assert len({r["_key"] for r in keyed}) == len(rows) == len({tuple(r) for r in keyed}) and all(len(r["_key"]) == 64 for r in keyed)


def test_rows_that_are_the_same_leave_one(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, "en", "s", 1)] * 40 + [(5, text, "de", "s", 1)] * 3 + [(4, f"{text} end", "en", "s", 1), (None, None, None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_stage(spark, docs, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(4, f"{text} end", "en", "s", 1), (None, None, None, None, None)], key=str)
    assert corpus_pipeline.near_stage(spark, docs.where("false"), str(tmp_path)).count() == 0
