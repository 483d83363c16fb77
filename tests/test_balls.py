"""The index of balls against a scan of all vectors, and what it doesn't read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.engine import Engine
from sieveline.operators import balls, search
from tests.test_engine import repo  # noqa: F401


@pytest.mark.parametrize("metric,dims", [("cosine", 24), ("l2", 7), ("dot", 16)])
def test_equals_a_scan_and_reads_few_balls(spark, tmp_path, metric, dims):
    rng = np.random.default_rng(dims)
    centres = rng.standard_normal((40, dims)) * 3
    x = np.repeat(centres, 50, axis=0) + rng.standard_normal((2000, dims)) * 0.05
    rows = [(i, f"p{i % 5}/x", v.tolist()) for i, v in enumerate(x)] + [(3000 + i, "p0/x", x[7].tolist()) for i in range(30)]
    rows += [(4000, "p0/x", None), (4001, "p0/x", [])] + ([(4002, "p0/x", [0.0] * dims)] if metric == "cosine" else [])
    df = spark.createDataFrame(rows, "doc_id long, path string, vector array<double>")
    index = balls.BallIndex(spark, str(tmp_path / "balls"))
    index.build(df, metric, ball_rows=50)
    fit = df.where("vector is not null and size(vector) > 0")
    more = spark.createDataFrame([(5000, (x[7] * 1.01).tolist()), (5001, (-x[7]).tolist())], "doc_id long, vector array<double>")
    for query, where in ((x[7], None), (x[1999], F.col("path") == "p1/x"), (rng.standard_normal(dims), None), (centres[3], F.col("path") == "nowhere")):
        every = fit if where is None else fit.where(where)
        for extra in (None, more) if (query == x[7]).all() else (None,):
            whole = every.select("doc_id", "vector") if extra is None else every.select("doc_id", "vector").unionByName(extra)
            want = [tuple(r) for r in search.top_k(search.vector_scores(whole, query.tolist(), metric=metric), 10).orderBy("rank").collect()]
            got = index.nearest(query.tolist(), 10, where, extra)
            assert [tuple(r) for r in got.rows.orderBy("rank").collect()] == want and got.balls > 20
    assert index.nearest(x[7].tolist(), 10).read * 3 < got.balls
    with pytest.raises(ValueError):
        index.nearest([1.0], 10)
    with pytest.raises(ValueError):
        index.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "doc_id long, vector array<double>"), metric)
    index.build(df.where("false"), metric)
    assert index.nearest([1.0], 10).rows.count() == 0


def test_an_engine_answers_the_same_with_balls(spark, repo):  # noqa: F811
    e = Engine(spark, repo, {"embedder": {"dimensions": 64}})
    e.build()

    def hits():
        return [tuple(r) for r in e.search("connect a row", k=5, absolute=False).orderBy("rank").drop("content").collect()]

    before = hits()
    assert e.store.nearest([0.0] * 64, "cosine", F.lit(True)) is None
    assert e.maintain()["balls"] == "ok" and hits() == before
    (repo / "src/util.py").write_text("def connect(row):\n    return other(row)\n\ndef other(row):\n    return row\n")
    (repo / "src/lib.ts").unlink()
    e.build()  # the balls don't know of this yet
    changed = hits()
    e.store.balls = balls.BallIndex(spark, str(repo / "none"))
    assert changed == hits() != before
