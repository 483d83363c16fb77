"""Builds in batches that go on after a cut, what an update reads and parses, parts of relations, the text index, tools and observers."""

import io
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from sieveline.engine import Engine
from sieveline.functions import parsers
from sieveline.operators import predicates
from sieveline.server import Server
from sieveline.service import Service
from sieveline.sources import checkouts
from sieveline.sources.shared import written
from sieveline.streaming import events as ev
from sieveline.timing import Phases
from tests.test_engine import repo  # noqa: F401

SMALL = {"embedder": {"dimensions": 64}}


def graph_of(e):
    return {tuple(r) for r in e.graph().collect()}


def test_a_build_goes_on_after_a_cut(spark, repo, monkeypatch):  # noqa: F811
    e = Engine(spark, repo, SMALL)
    e.batch = 1
    stored, done = e._store_batch, []

    def cut(f, now, paths, index):
        if len(done) == 2:
            raise KeyboardInterrupt
        stored(f, now, paths, index)
        done.extend(r["path"] for r in paths.collect())

    monkeypatch.setattr(e, "_store_batch", cut)
    with pytest.raises(KeyboardInterrupt):
        e.build()
    assert e.state.meta.state == "incomplete" and e.state.meta.current_run.processed_count == 2 and len(e.state.meta.current_run.paths_to_process) == 4
    again = Engine(spark, repo, SMALL)
    parsed = []
    monkeypatch.setattr(again, "_store_batch", lambda f, now, paths, index, g=again._store_batch: (parsed.extend(r["path"] for r in paths.collect()), g(f, now, paths, index)))
    assert again.build() == {"cached": 2, "updated": 2, "removed": 0}
    assert not set(parsed) & set(done) and len(parsed) == 2 and again.state.meta.state == "done"
    assert {"discover", "chunks and facts", "graph", "text index"} == again.phases.keys()
    fresh = Engine(spark, repo, SMALL | {"index": {"path": str(repo / "other")}})
    fresh.build(full=True)
    assert graph_of(fresh) == graph_of(again) and fresh.store.chunk_count() == again.store.chunk_count()


def test_an_update_reads_and_parses_what_changed(spark, repo, monkeypatch):  # noqa: F811
    e = Engine(spark, repo, SMALL)
    e.build()
    read, parsed = [], []
    monkeypatch.setattr("sieveline.engine.contents", lambda found: (read.append(sorted(r["path"] for r in found.collect())), checkouts.contents(found))[1])
    facts = parsers.facts
    monkeypatch.setattr(parsers, "facts", lambda f, index=None: (parsed.append(sorted(r["path"] for r in f.select("path").collect())), facts(f, index))[1])
    a = e.workspace.checkouts[0].alias
    assert e.build() == {"cached": 4, "updated": 0, "removed": 0} and read == [[]] and parsed == []
    (repo / "src/util.py").write_text("def connect(row):\n    return row\n")
    assert e.build() == {"cached": 3, "updated": 1, "removed": 0} and read.pop() == [f"{a}/src/util.py"] and parsed == [[f"{a}/src/util.py"]]
    subprocess.run("git checkout -q src/util.py", shell=True, cwd=repo, check=True)  # back to what is committed, without a commit
    assert e.build() == {"cached": 3, "updated": 1, "removed": 0} and read[-1] == [f"{a}/src/util.py"]
    # a new module, and one that goes, change what imports of other files mean
    (repo / "src/app.py").write_text("from src.late import go\n\ndef run():\n    return go()\n")
    e.build()
    parsed.clear()
    (repo / "src/late.py").write_text("def go():\n    return 1\n")
    e.build()
    assert parsed == [[f"{a}/src/late.py"], [f"{a}/src/app.py"]]
    (repo / "src/util.py").unlink()
    e.build()
    fresh = Engine(spark, repo, SMALL | {"index": {"path": str(repo / "other")}})
    fresh.build(full=True)
    assert graph_of(fresh) == graph_of(e) and (f"{a}/src/app.py::run", f"{a}/src/late.py::go", "calls") in graph_of(e)


def test_parts_of_relations(spark, tmp_path):
    from sieveline.sources.store import Store

    store = Store(spark, tmp_path)

    def rows(*names):
        return spark.createDataFrame([(n, n * 2) for n in names], "path string, sha256 string")

    store.replace("file_state", rows("a", "b"), rows("a", "b"))
    store.replace("file_state", rows("c"), rows("c"))
    first = store._parts("file_state")
    assert len(first) == 2
    store.replace("file_state", rows("c"), rows("c", "x"))
    assert store._parts("file_state")[0] == first[0] and first[1] not in store._parts("file_state")
    assert sorted(r["path"] for r in store.read("file_state").collect()) == ["a", "b", "c"]
    assert store.maintain()["file_state"] == "ok" and len(store._parts("file_state")) == 1 and store.read("file_state").count() == 3
    assert store.load_graph(tmp_path / "graph") is None
    store.write("nodes", spark.createDataFrame([("f", "module", "f", 1, 2, "f", "f")], store.read("nodes").schema))
    store.write("edges", spark.createDataFrame([("f", "g", "calls")], store.read("edges").schema))
    store.export_graph(tmp_path / "graph")
    nodes, edges = store.load_graph(tmp_path / "graph")
    assert [tuple(r) for r in edges.collect()] == [("f", "g", "calls")] and nodes.first()["file_path"] == "f"
    (tmp_path / "graph/version.json").write_text('{"schema_version": 99}')
    assert store.load_graph(tmp_path / "graph") is None


def test_text_index_and_its_absence(spark, repo, caplog):  # noqa: F811
    e = Engine(spark, repo, SMALL)
    e.build()
    terms = {r["term"]: r["df"] for r in e.store.text.terms().collect()}
    assert terms["connect"] >= 2 and e.store.text.manifest["n"] == e.store.chunk_count()
    assert e.search("connect a row").first()["search_mode"] == "hybrid"
    import shutil

    shutil.rmtree(e.folder / "text")
    with caplog.at_level("ERROR", "sieveline"):
        for _ in range(3):
            assert e.search("connect a row").first()["search_mode"] == "vector"
    assert len(caplog.records) == 1
    e.build(full=True)
    assert e.search("connect a row").first()["search_mode"] == "hybrid" and e._failures == 0


def test_test_paths(spark):
    yes = ["tests/a.py", "x/test/a.py", "x/test_a.py", "test_a.py", "a_test.py", "conftest.py", "conftest_db.py", "a.spec.ts", "a.spec.js", "a.spec.tsx", "a.spec.jsx", "__tests__/a.js"]
    no = ["src/a.py", "spec/a.py", "a.test.ts", "a.test.js", "latest.py", "contest.py", "testing/a.py"]
    df = spark.createDataFrame([(p,) for p in yes + no], "path string")
    assert {r["path"] for r in df.where(predicates.is_test_path(F.col("path"))).collect()} == set(yes)


def test_registered_passes(spark, repo, monkeypatch):  # noqa: F811
    monkeypatch.setitem(parsers.PASSES, "own", (lambda edges, nodes: edges.where("kind <> 'imports'"),))
    e = Engine(spark, repo, SMALL)
    e.build()
    assert e.graph("calls").count() and not e.graph("imports").count()


def test_bursts_of_a_table_against_loops(spark):
    import random

    rng = random.Random(2)
    at = sorted(rng.choices(range(400), k=120))
    rows = [(rng.randint(0, 1), t, i, f"p{rng.randint(0, 4)}", rng.choice(["changed", "removed"])) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "k int, t int, seq long, path string, op string").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r["key"], r["s"], r["e"], r["path"], r["op"]) for r in ev.debounced(df, "5 seconds", F.col("k")).withColumn("s", F.unix_timestamp("start")).withColumn("e", F.unix_timestamp("end")).collect()}
    want = set()
    for k in (0, 1):
        bursts: list[list] = []
        for r in (r for r in rows if r[0] == k):
            if bursts and r[1] - bursts[-1][-1][1] <= 5:
                bursts[-1].append(r)
            else:
                bursts.append([r])
        for b in bursts:
            last = {r[3]: r[4] for r in b}
            want |= {(k, b[0][1], b[-1][1] + 5, p, op) for p, op in last.items()}
    assert got == want
    assert written(ev.debounced(df.where("false")), "none").count() == 0


def test_tool_server(spark, repo):  # noqa: F811
    Engine(spark, repo).build()
    ask = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "nothing"},
        {"id": 4, "method": "tools/call", "params": {"name": "semantic_search", "arguments": {"root": str(repo), "query": "connect a row", "top_k": 2}}},
        {"id": 5, "method": "tools/call", "params": {"name": "semantic_search", "arguments": {"root": str(repo), "query": " "}}}, {"id": 6, "method": "tools/call", "params": {"name": "x"}},
    ]
    sink = io.StringIO()
    Server(Service(spark)).serve(io.StringIO("\n".join([*map(json.dumps, ask), "", "{", "[]"])), sink)
    got = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, 6, None, None] and got[2]["error"]["code"] == -32601 and [g["error"]["code"] for g in got[-2:]] == [-32700, -32600]
    tools = {t["name"]: t["inputSchema"] for t in got[1]["result"]["tools"]}
    assert tools["semantic_search"]["required"] == ["root", "query"] and tools["semantic_search"]["properties"]["repos"]["type"] == "array"
    assert len(json.loads(got[3]["result"]["content"][0]["text"])) == 2 and got[4]["result"]["isError"] and got[5]["result"]["isError"]


def test_phases():
    ticks = iter(range(100))
    p = Phases(lambda: next(ticks))
    with p.phase("a"), p.phase("b"):
        pass
    with p.phase("b"):
        pass
    assert p.seconds == {"a": 3, "b": 2}
