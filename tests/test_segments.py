"""The text index: segments, deletions, merges, and what an update cuts."""

import random

import pytest

from sieveline.engine import Engine
from sieveline.operators import search, segments
from tests.test_engine import repo  # noqa: F401

WORDS = ["alpha", "beta", "gamma", "Delta", "delta", "x1", "y_2", "été", "", "ZZ"]
SCHEMA = "doc_id string, path string, symbol string, content string"


def text(rng):
    return rng.choice([" ".join(rng.choices(WORDS, k=rng.randint(0, 30))), "", None])


def scores(spark, index):
    asked = spark.createDataFrame([("q", t) for t in ("alpha", "delta", "x1", "nothing")], "query_id string, term string")
    return sorted((r["doc_id"], r["score"]) for r in index.scores(asked, ["alpha", "delta", "x1", "nothing"]).collect())


def test_updates_equal_a_full_build(spark, tmp_path, monkeypatch):
    rng, files = random.Random(4), {}
    cut = []
    monkeypatch.setattr(segments, "cut", lambda chunks, **k: (cut.append({r["path"] for r in chunks.select("path").collect()}), search.cut(chunks, **k))[1])
    index = segments.TextSegments(spark, str(tmp_path / "text"), fan_in=3)
    assert index.index() is None and not index.exists()
    with pytest.raises(ValueError):
        index.update(spark.createDataFrame([], "path string"), spark.createDataFrame([], SCHEMA))

    def rows(paths):
        return spark.createDataFrame([(f"{p}:{i}", p, "s", t) for p in paths for i, t in enumerate(files[p])], SCHEMA)

    for p in range(12):
        files[f"p{p}"] = [text(rng) for _ in range(rng.randint(1, 3))]
    index.build(rows(files))
    for step in range(5):
        cut.clear()
        changed = rng.sample(sorted(files), 2) + [f"n{step}"]
        gone = rng.sample(sorted(set(files) - set(changed)), 1)
        for p in changed:
            files[p] = [text(rng) for _ in range(rng.randint(0, 3))]
        for p in gone:
            del files[p]
        index.update(spark.createDataFrame([(p,) for p in changed + gone], "path string"), rows(changed))
        assert len(cut) == 1 and cut[0] <= set(changed)
    full = segments.TextSegments(spark, str(tmp_path / "full"))
    full.build(rows(files))
    assert (m := index.manifest)["n"] == full.manifest["n"] == sum(map(len, files.values())) and m["total"] == full.manifest["total"]
    for a, b in ((index.terms(), full.terms()), (index.postings(), full.postings())):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert scores(spark, index.index()) == scores(spark, full.index())
    tiers = [index.tier(s["docs"]) for s in m["segments"]]
    assert all(tiers.count(t) < 3 for t in tiers) and len(m["terms"]) <= 3 and len(m["deleted"]) <= 3
    index.maintain()
    assert len(index.manifest["segments"]) <= 1 and not index.manifest["deleted"] and scores(spark, index.index()) == scores(spark, full.index())
    index.update(spark.createDataFrame([(p,) for p in files], "path string"), spark.createDataFrame([], SCHEMA))
    assert index.manifest["n"] == 0 and index.terms().count() == 0 and scores(spark, index.index()) == []


def test_an_engine_cuts_what_changed(spark, repo, monkeypatch):  # noqa: F811
    cut = []
    monkeypatch.setattr(segments, "cut", lambda chunks, **k: (cut.append({r["path"] for r in chunks.select("path").collect()}), search.cut(chunks, **k))[1])
    e = Engine(spark, repo, {"embedder": {"dimensions": 64}})
    e.build()
    alias = e.workspace.checkouts[0].alias
    assert len(cut.pop()) == 4
    (repo / "src/util.py").write_text("def renamed_thing(row):\n    return row\n")
    (repo / "src/lib.ts").unlink()
    e.build()
    assert cut == [{f"{alias}/src/util.py"}]
    found = {r["term"]: r["df"] for r in e.store.text.terms().collect()}
    assert "retry" not in found and "renamed_thing" in found and e.store.text.manifest["n"] == e.store.chunk_count()
    assert e.search("renamed thing", absolute=False).first()["search_mode"] == "hybrid"
