"""What a search for many questions shuffles: postings and each task's best, not a score for each question and document."""

import random

from pyspark.sql import functions as F

from sieveline.operators import search

SCHEMA = "doc_id long, path string, symbol string, content string"


def test_scores_stay_where_they_are_made(spark, monkeypatch):
    rng = random.Random(7)
    chunks = spark.createDataFrame([(i, f"p{i}", "s", " ".join(rng.choices([f"c{j}" for j in range(12)], k=10))) for i in range(1000)], SCHEMA)
    postings = search.postings_of(chunks).localCheckpoint()
    index = search.TextIndex(postings, search.terms_of(postings), search.corpus_of(chunks, postings))
    asked = spark.createDataFrame([(q, f"c{j}") for q in range(60) for j in rng.sample(range(12), 6)], "query_id long, term string")
    scores = index.scores(asked).localCheckpoint()
    want = search.top_k(scores, 5, partition=["query_id"]).collect()
    for size in (search.TASK_SCORES, 9_000):  # one task, several
        monkeypatch.setattr(search, "TASK_SCORES", size)
        for within in (None, chunks.where("doc_id % 3 = 1")):
            spark.sparkContext.setJobGroup(f"best {size}", "best")
            found = index.best(asked, 5, within).select("query_id", "doc_id", "score", "rank").collect()
            tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
            jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(f"best {size}")]
            moved = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in {s for j in jobs for s in j.stageIds} if tracker.getStageInfo(s))
            if within is None:
                assert sorted(map(tuple, found)) == sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in want)
            else:
                some = search.top_k(scores.where(F.col("doc_id") % 3 == 1), 5, partition=["query_id"]).select("query_id", "doc_id", "score", "rank")
                assert sorted(map(tuple, found)) == sorted(map(tuple, some.collect()))
            spark.sparkContext.setJobGroup("", "")
            assert moved < scores.count() / 2, (moved, scores.count())
