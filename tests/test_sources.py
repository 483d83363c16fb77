"""Files of any name through discovery, reading, version control and builds."""

import subprocess

import pytest
from pyspark.sql import functions as F

from sieveline.engine import Engine
from sieveline.sources import checkouts, files
from sieveline.sources.files import Checkout, Git, Workspace

NAMES = ["a b.py", "100%.py", "café.py", "[slug].ts", "new\nline.py", "q'\"$.js", "tab\t.py", "*.py", "-x.py", " lead.py", "日本/語.ts"]
SMALL = {"embedder": {"dimensions": 64}}


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


@pytest.fixture
def odd(tmp_path):
    root = tmp_path / "repo"
    for n in NAMES:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(f"def f{NAMES.index(n)}():\n    return 1\n" if n.endswith(".py") else f"export function f{NAMES.index(n)}() {{ return 1; }}\n")
    (root / ".gitignore").write_text(".sieveline/\nother/\n")
    git(tmp_path, "init", "-q", str(root))
    git(root, "add", "-A")
    git(root, "commit", "-qm", "x")
    return root


def test_discovery_and_reading_of_any_name(spark, odd):
    ws = Workspace([Checkout(odd, "r")])
    assert sorted(k for k, _ in ws.discover()) == sorted(f"r/{n}" for n in NAMES)
    found = checkouts.files(spark, ws, splits=3)
    read = {r["path"]: r["content"] for r in checkouts.contents(found).collect()}
    assert read == {f"r/{n}": (odd / n).read_text() for n in NAMES}
    assert {r["path"] for r in files.read_files(spark, ws.discover()).collect()} == read.keys()


def test_names_that_are_no_utf8(spark, odd):
    raw = bytes(odd) + b"/b\xff.py"
    with open(raw, "wb") as f:
        f.write(b"x = '\xff'\n")
    found = {r["path"]: r["content"] for r in checkouts.contents(checkouts.files(spark, Workspace([Checkout(odd, "r")]))).collect()}
    assert found["r/b\\xff.py"] == "x = '�'\n" and len(found) == len(NAMES) + 1


def test_a_vanished_file_is_one_warned_row(spark, odd, caplog):
    found = spark.createDataFrame([("r/a b.py", bytearray(bytes(odd / "a b.py"))), ("r/gone.py", bytearray(bytes(odd / "gone.py")))], checkouts.FILES)
    with caplog.at_level("WARNING", "sieveline"):
        read = checkouts.contents(found)
        from sieveline.timing import logger

        assert checkouts.told_missing(read, logger) == 1
    assert "r/gone.py" in caplog.text and {(r["path"], r["content"] is None, r["error"] is None) for r in read.collect()} == {("r/a b.py", False, True), ("r/gone.py", True, False)}
    assert [r["path"] for r in files.read_files(spark, [("r/gone.py", odd / "gone.py"), ("r/a b.py", odd / "a b.py")]).collect()] == ["r/a b.py"]


def test_changes_of_any_name(spark, odd):
    since = Git(odd).head
    git(odd, "mv", "a b.py", "moved é.py")
    git(odd, "rm", "-q", "100%.py")
    (odd / "café.py").write_text("x = 1\n")
    git(odd, "add", "-A")
    git(odd, "commit", "-qm", "y")
    (odd / "[slug].ts").write_text("let x = 1;\n")
    (odd / "un\ntracked.py").write_text("x = 1\n")
    git(odd, "mv", "tab\t.py", "staged name.py")
    (odd / "*.py").unlink()
    want = ({"moved é.py", "café.py", "[slug].ts", "un\ntracked.py", "staged name.py"}, {"a b.py", "100%.py", "tab\t.py", "*.py"})
    assert Git(odd).changes(since) == want
    told = {(r["path"], r["action"]) for r in checkouts.changes(spark, Workspace([Checkout(odd, "r")]), {"r": since}).collect()}
    assert told == {(f"r/{p}", a) for found, a in zip(want, ("changed", "removed")) for p in found}
    # a checkout that is a folder of the repository
    (odd / "日本/neu.ts").write_text("let y = 1;\n")
    assert Git(odd / "日本").changes(since) == ({"neu.ts"}, set()) and Git(odd / "日本").discover() == ["neu.ts", "語.ts"]


def test_a_repository_of_odd_names_builds_updates_and_answers(spark, odd):
    e = Engine(spark, odd, SMALL)
    assert e.build() == {"cached": 0, "updated": len(NAMES), "removed": 0}
    alias = e.workspace.checkouts[0].alias
    listed = {r["path"] for r in e.list().collect()}
    assert listed == {f"{alias}/{n}" for n in NAMES}
    git(odd, "mv", "a b.py", "c d.py")
    git(odd, "commit", "-qm", "y")
    (odd / "café.py").write_text("def coffee_machine():\n    return 1\n")
    assert e.build() == {"cached": len(NAMES) - 2, "updated": 2, "removed": 1}
    hits = e.search("coffee machine", k=3, absolute=False).orderBy("rank").collect()
    assert hits[0]["path"] == f"{alias}/café.py"
    assert e.graph(target="c d.py").count() and not e.graph(target="a b.py").count()


def test_failing_checkouts_add_nothing(spark, odd, tmp_path):
    ws = Workspace([Checkout(odd, "r", ("日本",)), Checkout(tmp_path / "missing", "m")], ["nothing/"])
    assert [r["path"] for r in checkouts.files(spark, ws).collect()] == ["r/日本/語.ts"]
    assert checkouts.changes(spark, ws, {}).count() == 0


def test_modules_are_resolved_by_joins(spark):
    rows = [("r/a.py", "import b\nfrom pkg import c, d\nimport os.path as p\n\ndef f():\n    b.g()\n    c.h()\n"), ("r/b.py", "def g():\n    pass\n"), ("r/pkg/c.py", "def h():\n    pass\n"), ("r/x.ts", "import { thing } from './lib';\nexport function s() { return thing(); }\n"), ("r/lib.ts", "export function thing() { return 1; }\n"), ("r/none.txt", "x")]
    from sieveline.functions import parsers
    from sieveline.operators import graph

    df = spark.createDataFrame(rows, "path string, content string")
    index = graph.module_index(df.select("path"))
    asked = parsers.lookups(df)
    assert {"b", "pkg.c", "pkg/c", "os.path", "r/lib"} <= {r["module"] for r in asked.collect()}
    joined = parsers.facts(parsers.resolved(df, asked, index))
    whole = parsers.facts(df, {r["module"]: r["path"] for r in index.collect()})
    assert {tuple(r) for r in joined.collect()} == {tuple(r) for r in whole.collect()}
    assert joined.where((F.col("source") == "r/a.py::f") & (F.col("target") == "r/pkg/c.py::h")).count() == 1
