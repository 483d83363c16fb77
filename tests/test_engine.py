"""The engine end to end over a small repository, its state, its streams, and properties against brute force."""

import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from sieveline import cli
from sieveline import config as cfg
from sieveline.engine import Engine
from sieveline.errors import ConfigError, IndexStaleError, SearchError
from sieveline.functions import parsers
from sieveline.operators import graph, impact, ranking
from sieveline.operators.state import IndexState, Source
from sieveline.sources import files

SRC = {
    "src/store.py": 'from src.util import connect\n\nclass Store:\n    """Keeps rows."""\n    def save(self, row):\n        return connect(row)\n',
    "src/util.py": "def connect(row):\n    return retry(row)\n\ndef retry(row):\n    return row\n",
    "src/app.ts": "import { thing } from './lib';\nexport function start() { return thing(); }\n",
    "src/lib.ts": "export function thing() { return 1; }\n",
    "docs/readme.md": "no code",
}


@pytest.fixture
def repo(tmp_path):
    for name, text in SRC.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / ".gitignore").write_text(".sieveline/\n")
    subprocess.run("git init -q . && git add -A && git -c user.name=t -c user.email=t@t commit -qm x", shell=True, cwd=tmp_path, check=True)
    return tmp_path


def test_build_search_impact(spark, repo, capsys):
    e = Engine(spark, repo, {"embedder": {"dimensions": 64}})
    assert e.build() == {"cached": 0, "updated": 4, "removed": 0}
    alias = e.workspace.checkouts[0].alias
    assert e.build() == {"cached": 4, "updated": 0, "removed": 0}
    hits = e.search("connect a row", k=3, absolute=False).orderBy("rank").collect()
    assert any(h["symbol"] == "connect" for h in hits) and hits[0]["relevance"] == "high"
    before = {tuple(r) for r in e.graph().collect()}
    found = e.impact(f"{alias}/src/util.py::retry", 3)
    assert {r["qualified_name"] for r in found.nodes.collect()} >= {"connect", "Store.save"}
    assert e.impact("nowhere").hint and "Store" in e.skeleton(str(repo / "src/store.py"))
    assert e.skeleton(str(repo / "docs/readme.md")) == "no code"
    with pytest.raises(ValueError):
        e.skeleton("/etc/passwd")
    with pytest.raises(SearchError):
        e.search(" ")
    # a changed callee keeps the edges of callers that didn't change; a removed file goes
    (repo / "src/util.py").write_text(SRC["src/util.py"] + "\ndef extra():\n    pass\n")
    (repo / "src/lib.ts").unlink()
    assert e.build() == {"cached": 2, "updated": 1, "removed": 1}
    kept = {tuple(r) for r in e.graph().collect()}
    assert (f"{alias}/src/store.py::Store.save", f"{alias}/src/util.py::connect", "calls") in kept & before
    fresh = Engine(spark, repo, {"embedder": {"dimensions": 64}, "index": {"path": str(repo / "other")}})
    fresh.build(full=True)
    assert {tuple(r) for r in fresh.graph().collect()} == kept
    assert e.maintain()["chunks"] == "ok" and e.status()["state"] == "done"
    e.state.start([])
    with pytest.raises(IndexStaleError):
        e.search("connect")
    assert cli.main(["--root", str(repo), "list", "--limit", "3"]) == 0 and "src/" in capsys.readouterr().out


def test_state(tmp_path):
    s = IndexState(tmp_path, clock=lambda: 5.0)
    assert s.meta is None and s.mode(False) == "full" and s.mode(True) == "incremental"
    s.set_errored("x")
    assert s.meta is None
    s.start([Source("a", "c", "b", True)])
    s.save_progress(["p", "q"], 1)
    assert s.is_in_progress and s.has_partial_progress and s.mode(True) == "full" and s.primary.alias == "a"
    s.set_incomplete()
    assert s.meta.state == "incomplete"
    s.set_errored(ValueError("bad"))
    assert s.meta.error == "bad" and not s.is_in_progress
    s.finish({"p": "h"})
    assert s.meta.state == "done" and s.hashes == {"p": "h"}
    (tmp_path / "meta.json").write_text(json.dumps({"state": "done", "last_commit": "k", "branch": "m"}))
    assert s.meta.sources == (Source("root", "k", "m", True),)
    (tmp_path / "meta.json").write_text("{")
    assert s.meta is None and not s.version_matches()
    s.write_version()
    assert s.version_matches()


def test_config(tmp_path):
    assert cfg.load(tmp_path).search.metric == "cosine"
    with pytest.raises(ConfigError):
        cfg.load(tmp_path, {"serch": {}})
    with pytest.raises(ConfigError):
        cfg.load(tmp_path, {"index": {"roots": [{"repo": "."}, {"repo": "."}]}})
    with pytest.raises(ConfigError):
        cfg.load(tmp_path, {"index": {"roots": [{"repo": ".", "include": ["../x"]}]}})
    assert cfg.unique_aliases(["dup", "dup", "dup-2"]) == ["dup", "dup-2", "dup-2-2"] and cfg.sanitize_alias("--a b!") == "--a_b" and cfg.sanitize_alias("!!") == "root"


def test_git_and_ignore():
    assert files.parse_status("R  old.py -> new.py") == ("R ", "new.py") and files.parse_status("??") is None
    ignore = files.Ignore(["*.log", "build/", "/top.py", "!keep.log", "a/**/z.py"])
    assert [ignore(p) for p in ("x/y.log", "x/build/f.py", "top.py", "x/top.py", "keep.log", "a/b/c/z.py", "building/f.py")] == [True, True, True, False, False, True, False]


def test_containment_and_tiers_against_loops(spark):
    rng = random.Random(3)
    rows = [(f"f{rng.randint(0, 3)}", a := rng.randint(1, 8), a + rng.randint(0, 5), r, rng.choice([0.0, 1.0, 0.4, 0.1])) for _ in range(40) for r in [0]]
    hits = [(p, a, b, i + 1, s) for i, (p, a, b, _, s) in enumerate(sorted(rows, key=lambda x: -x[4]))]
    dropped = set()
    for i, x in enumerate(hits):
        if any(j != i and j not in dropped and x[0] == y[0] and x[1] <= y[1] and x[2] >= y[2] for j, y in enumerate(hits)):
            dropped.add(i)
    df = spark.createDataFrame(hits, "path string, start_line int, end_line int, rank int, score double")
    assert {r["rank"] for r in ranking.drop_enclosing(df).collect()} == {h[3] for i, h in enumerate(hits) if i not in dropped}
    tier, want = 0, []
    for i, h in enumerate(hits):
        if i and hits[i - 1][4] > 0 and h[4] / hits[i - 1][4] < 0.5:
            tier = min(2, tier + 1)
        want.append(["high", "medium", "low"][tier])
    assert [r["relevance"] for r in ranking.relevance_tiers(df).orderBy("rank").collect()] == want


def test_containment_of_very_many_spans(spark):
    import time

    n = 1_000_000
    spans = spark.range(n).select(F.lit("f").alias("path"), (F.col("id") % 1000).cast("int").alias("start_line"), (F.col("id") % 1000 + F.floor(F.col("id") / 1000)).cast("int").alias("end_line"), F.col("id").cast("int").alias("rank"))
    began = time.monotonic()
    left = {(r["start_line"], r["end_line"]) for r in ranking.drop_enclosing(spans).collect()}
    assert left == {(i, i) for i in range(1000)} and time.monotonic() - began < 60
    odd = spark.createDataFrame([(None, 1, 9, 1), (None, 2, 3, 2), ("f", None, 9, 3), ("f", 1, None, 4), ("f", 2, 3, 5), ("f", 1, 9, 6)], "path string, start_line int, end_line int, rank int")
    assert {r["rank"] for r in ranking.drop_enclosing(odd).collect()} == {1, 2, 3, 4, 5}


def test_impact_against_a_queue(spark):
    rng = random.Random(5)
    ids = [f"m{i}" for i in range(3)] + [f"m{i % 3}::f{i}" for i in range(12)]
    edges = {(rng.choice(ids), rng.choice(ids), rng.choice(["calls", "imports", "defines"])) for _ in range(40)}
    nodes = [(i, "function" if "::" in i else "module", i.split("::")[0], 1, 2, i.split("::")[-1], i.split("::")[-1]) for i in ids]
    n, e = spark.createDataFrame(nodes, "id string, kind string, file_path string, start_line int, end_line int, name string, qualified_name string"), spark.createDataFrame(list(edges), "source string, target string, kind string")
    for depth in (0, 1, 3):
        seen, queue = {}, [(s, 1) for s, t, k in edges if t == "m0::f0" and k != "defines"]
        while queue:
            node, hop = queue.pop(0)
            if node in seen:
                continue
            seen[node] = hop
            if hop < depth and "::" in node:
                queue += [(s, hop + 1) for s, t, k in edges if t == node and k != "defines"]
        got = {(r["id"], r["hop"]) for r in impact.reach(spark.createDataFrame([("m0::f0",)], "id string"), n, e, depth).collect()}
        assert got == set(seen.items())


def test_inherited_seeds(spark):
    n = spark.createDataFrame([("a::B", "class", "a", 1, 2, "B", "B"), ("a::B.run", "function", "a", 1, 2, "run", "B.run"), ("b::C.run", "function", "b", 1, 2, "run", "C.run"), ("c::x", "function", "c", 1, 2, "x", "x")], "id string, kind string, file_path string, start_line int, end_line int, name string, qualified_name string")
    e = spark.createDataFrame([("b::C", "a::B", "inherits"), ("c::x", "a::B.run", "calls")], "source string, target string, kind string")
    assert {r["id"] for r in impact.impact_radius("b::C.run", n, e, 1).collect()} == {"c::x"}
    assert {r["symbol"]: r["n"] for r in graph.ambiguous(n).collect()} == {"run": 2}


def test_skeleton_rows(spark):
    df = spark.createDataFrame([("a.py", SRC["src/store.py"]), ("b.unknown", "x"), ("c.py", None)], "path string, content string")
    rows = parsers.skeleton(df)
    assert {r["path"] for r in rows.collect()} == {"a.py"}
    assert parsers.render(parsers.matches_symbol(rows, "Store.save")).first()["text"] == 'a.py:3-6\nclass Store:\n    """Keeps rows."""\na.py:5-6\n    def save(self, row):\n        ...'
    assert parsers.available_symbols(rows).first()["symbols"] == "Store, Store.save"
    assert parsers.matches_symbol(rows, "Store").where(F.col("kind") == "function").count() == 1


def test_service(spark, repo):
    from sieveline.errors import IndexMissingError
    from sieveline.service import Service

    s = Service(spark)
    with pytest.raises(IndexMissingError):
        s.semantic_search(str(repo), "connect")
    s.engine(str(repo)).build()
    assert any(h["symbol"] == "connect" and h["path"].startswith(str(repo)) for h in s.semantic_search(str(repo), "connect", 3))
    assert "def retry(row):" in s.get_file_skeleton(str(repo), "src/util.py")
    assert {n["name"] for n in s.get_impact_radius(str(repo), "retry", 2)["nodes"]} == {"connect", "save"}
    assert s.index_status(str(repo))["state"] == "done" and "No symbol" in s.get_impact_radius(str(repo), "zzz")["hint"]
