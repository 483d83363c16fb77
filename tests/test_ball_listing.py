"""A search lists the folders of the balls that it reads, not all of them again in each wave."""

import numpy as np

from sieveline.operators import balls, search


def test_balls_that_are_not_read_are_not_listed(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((60, 8)) * 3, 20, axis=0) + rng.standard_normal((1200, 8)) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>")
    index = balls.BallIndex(spark, str(tmp_path / "balls"))
    index.build(df, "l2", ball_rows=20)
    want = [tuple(r) for r in search.top_k(search.vector_scores(df, x[5].tolist(), metric="l2"), 10).orderBy("rank").collect()]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("balls", "")
    found = index.nearest(x[5].tolist(), 10)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("balls") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("rest", "")
    assert [tuple(r) for r in found.rows.orderBy("rank").collect()] == want
    assert found.balls > 36 and found.read < found.balls / 2
    assert max(s.numTasks for s in stages if s) < 33  # a job lists more folders than 32, a task each
