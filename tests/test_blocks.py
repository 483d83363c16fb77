"""Best matches from blocks of postings: equal to scoring everything, and what is gone through."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import search
from sieveline.operators.blocks import BlockIndex

SCHEMA = "doc_id long, path string, symbol string, content string"


def index_of(spark, chunks):
    postings = search.postings_of(chunks)
    return search.TextIndex(postings, search.terms_of(postings), search.corpus_of(chunks, postings))


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of common words, among which each has some of many rare ones; every fifth text is there three times."""
    rng = random.Random(5)
    texts = []
    for i in range(1200):
        words = rng.choices([f"c{j}" for j in range(12)], weights=range(1, 13), k=rng.randint(0, 60)) + [f"r{int(rng.paretovariate(0.6)) % 900}" for _ in range(6)]
        texts += [" ".join(rng.sample(words, len(words)))] * (3 if i % 5 == 0 else 1)
    return spark.createDataFrame([(i, f"p{i % 7}/f{i}", "s", t) for i, t in enumerate(texts)] + [(99_999, "none", "s", None)], SCHEMA)


@pytest.fixture(scope="module")
def both(spark, corpus, tmp_path_factory):
    plain = index_of(spark, corpus)
    path = str(tmp_path_factory.mktemp("blocks") / "b")
    BlockIndex.of(plain, rows=16).write(path)
    return plain, BlockIndex.read(spark, path)


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(6)
    rows = {(q, t) for q in range(25) for t in rng.sample([f"c{j}" for j in range(12)], 8) + [f"r{rng.randint(1, 60)}" for _ in range(5)]}
    more = {(100, "c11"), (101, "nowhere"), (102, "r5"), (102, "nowhere"), (103, "none")}
    return spark.createDataFrame(sorted(rows | more), "query_id long, term string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 7, 5000])
def test_equal_to_scoring_everything(both, asked, k):
    plain, blocks = both
    found = rows(blocks.best(asked, k))
    assert found == rows(plain.best(asked, k))
    assert {q for q, *_ in found} == {*range(25), 100, 102}  # a null text has no words


def test_within_a_scope(both, asked, corpus):
    plain, blocks = both
    some = corpus.where("path like 'p3/%'").select("doc_id")
    found = rows(blocks.best(asked, 5, some))
    assert found == rows(plain.best(asked, 5, some)) and found
    assert rows(blocks.best(asked, 5, some.where("false"))) == []


def test_most_postings_are_left(both, asked):
    read = both[1].reads(asked.where("query_id < 25"), 2).first()
    assert read["first"] + read["tried"] + read["read"] + read["opened"] < read["whole"] / 2
    assert read["read"] < read["whole"] / 4


def test_blocks_hold_each_posting_once(both):
    plain, blocks = both
    each = blocks.blocks.select("term", "top", F.inline("postings"))
    assert each.count() == plain.postings.count() == each.select("term", "doc_id").distinct().count()
    assert each.where("weight > top").isEmpty()
    assert blocks.blocks.agg(F.max(F.size("postings"))).first()[0] < 16 * 4


def test_no_texts_and_no_questions(spark, both, asked):
    none = index_of(spark, spark.createDataFrame([], SCHEMA))
    assert rows(BlockIndex.of(none).best(asked, 3)) == []
    assert rows(both[1].best(asked.where("false"), 3)) == []
