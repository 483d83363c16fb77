"""Relations of parts: what a change opens and writes, marks in large parts, writers at odds, compaction."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline.errors import WriteConflictError
from sieveline.schema import STORED_CHUNK
from sieveline.sources.store import Store, chunk_id


def rows(spark, given):
    return spark.createDataFrame(sorted(given.items()), "path string, sha256 string")


def paths(spark, names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def content(store):
    return sorted((r["path"], r["sha256"]) for r in store.read("file_state").collect())


def opened(store, monkeypatch):
    """Which parts a change looks into, call by call."""
    seen = []
    alive = store._alive
    monkeypatch.setattr(store, "_alive", lambda name, df, marks: (seen.append(sorted({f.split("/")[-2] for f in df.inputFiles()})), alive(name, df, marks))[1])
    return seen


@pytest.mark.parametrize("small", [1 << 30, 0])
def test_changes_against_a_dictionary(spark, tmp_path, small):
    """The same whether parts are written anew or their files marked, through merges of marks and compaction."""
    rng, store, want = random.Random(small), Store(spark, tmp_path, small=small), {}
    names = [f"d{i % 3}/é [{i}].py" for i in range(12)]
    for step in range(22):
        gone = rng.sample(names, rng.randint(0, 3))
        fresh = {n: f"{n}@{step}" for n in gone if rng.random() < 0.7}
        store.replace("file_state", rows(spark, fresh), paths(spark, [*gone, *gone, None, "nowhere"]))
        want = {n: v for n, v in want.items() if n not in gone} | fresh
        if step % 4 == 3 or step > 18:
            assert content(store) == sorted(want.items())
        if step == 12:
            assert store.maintain()["file_state"] == "ok" and len(store._parts("file_state")) == 1 and content(store) == sorted(want.items())
    assert bool(store._manifest("file_state")[1]["marks"]) == (small == 0)
    store.maintain()
    assert store._manifest("file_state")[1]["marks"] == [] and content(store) == sorted(want.items())
    assert sorted(x.name for x in (tmp_path / "file_state").iterdir()) == ["manifests", *store._parts("file_state")]


def test_batches_of_other_files_open_no_part(spark, tmp_path, monkeypatch):
    store = Store(spark, tmp_path)
    seen = opened(store, monkeypatch)
    for i in range(8):
        batch = {f"f{i}{j}": "x" for j in range(3)}
        store.replace("file_state", rows(spark, batch), paths(spark, batch))
    assert seen == [] and len(store._parts("file_state")) == 8
    third = store._parts("file_state")[2]
    store.replace("file_state", rows(spark, {"f21": "y"}), paths(spark, ["f21"]))
    assert seen[0] == [third] and third not in store._parts("file_state") and len(store._parts("file_state")) == 8
    assert dict(content(store))["f21"] == "y" and len(content(store)) == 24


def test_a_change_in_a_large_part_writes_what_changed(spark, tmp_path):
    store = Store(spark, tmp_path, small=0)
    store.write("file_state", rows(spark, {f"f{i:04d}": "x" for i in range(2000)}))
    big = store._parts("file_state")[0]
    store.replace("file_state", rows(spark, {"f0007": "y"}), paths(spark, ["f0007", "f0008"]))
    assert store._parts("file_state")[0] == big
    fresh = store._manifest("file_state")[1]["parts"][1]
    assert (fresh["low"], fresh["high"]) == ("f0007", "f0007") and spark.read.parquet(f"{tmp_path}/file_state/{fresh['name']}").count() == 1
    got = dict(content(store))
    assert len(got) == 1999 and got["f0007"] == "y" and "f0008" not in got
    store.replace("file_state", rows(spark, {"f0008": "z"}), paths(spark, []))  # without paths it appends
    assert dict(content(store))["f0008"] == "z"


def test_of_two_writers_one_commits(spark, tmp_path, monkeypatch):
    one, other = Store(spark, tmp_path), Store(spark, tmp_path)
    one.write("file_state", rows(spark, {"a": "1"}))
    staged = one._staged

    def late(*given):
        found = staged(*given)
        other.replace("file_state", rows(spark, {"b": "2"}), paths(spark, ["b"]))
        return found

    monkeypatch.setattr(one, "_staged", late)
    with pytest.raises(WriteConflictError):
        one.replace("file_state", rows(spark, {"c": "3"}), paths(spark, ["c"]))
    assert content(one) == [("a", "1"), ("b", "2")]
    # both had seen the same manifest, and neither a newer one, when they published
    monkeypatch.undo()
    base = one._manifest("file_state")[0]
    monkeypatch.setattr(one, "_manifest", lambda name: (base, {"parts": [], "marks": []}))
    other._commit("file_state", base, other._manifest("file_state")[1]["parts"], [])
    with pytest.raises(WriteConflictError):
        one._commit("file_state", base, [], [])
    assert content(other) == [("a", "1"), ("b", "2")]


def test_nearest_leaves_out_what_was_marked(spark, tmp_path):
    store = Store(spark, tmp_path, dimensions=4, small=0)
    rng = random.Random(4)
    data = [(f"p{i}.py", 1, 2, f"s{i}", "text", [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    schema = ", ".join(f"{n} {STORED_CHUNK[n].dataType.simpleString()}" for n in ("path", "start_line", "end_line", "symbol", "content", "vector"))
    store.insert_chunks(spark.createDataFrame(data, schema))
    store.maintain()
    changed = [(p, a, b, s, c, [-x for x in v]) for p, a, b, s, c, v in data[:20]]
    store.insert_chunks(spark.createDataFrame(changed[:10], schema), paths(spark, [r[0] for r in changed]))
    assert store._manifest("chunks")[1]["marks"] and store.chunk_count() == 50
    query = data[3][5]
    found = [(r["doc_id"], r["score"]) for r in store.nearest(query, "cosine", F.lit(True))(7).orderBy("rank").collect()]
    from sieveline.operators.search import top_k, vector_scores

    every = vector_scores(store.read("chunks").withColumn("doc_id", chunk_id()), query)
    assert found == [(r["doc_id"], r["score"]) for r in top_k(every, 7).orderBy("rank").collect()]
    assert not {f"p{i}.py" for i in range(10, 20)} & {x.split(":")[0] for x, _ in found}


def test_files_after_compaction_follow_the_bytes(spark, tmp_path):
    store = Store(spark, tmp_path, file_bytes=20_000)
    store.write("file_state", spark.range(5000).select(F.concat(F.lit("f"), F.format_string("%05d", "id")).alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("sha256")))
    before = store._manifest("file_state")[1]["parts"][0]["bytes"]
    store.maintain()
    files = store.read("file_state").groupBy(F.input_file_name().alias("f")).agg(F.min("path").alias("low"), F.max("path").alias("high")).orderBy("low").collect()
    assert abs(len(files) - before / 20_000) <= 1.5 and all(a["high"] < b["low"] for a, b in zip(files, files[1:]))
    assert store.read("file_state").count() == 5000
