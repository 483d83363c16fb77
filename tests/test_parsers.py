"""Goldens for the parsers, written by hand."""

from collections import Counter

from sieveline.functions import parse_jsts, parse_python, parsers

PY = '''"""Doc."""
import os
from .b import helper as h, Base
# note
X = 1


@deco
class A(Base):
    """A class."""

    def __init__(self, svc: "Svc | None" = None):
        self.svc = svc
        super().__init__()

    async def run(self, x):
        def inner():
            h()
        inner()
        self.svc.go()


class Svc:
    def go(self): pass

if __name__ == "__main__":
    a = A()
    a.run(2)
'''


def test_python_chunks():
    found = [(c[1], c[2], c[3]) for c in parse_python.chunks("app/a.py", PY)]
    assert found == [(1, 29, "<module>"), (8, 20, "A"), (12, 14, "__init__"), (16, 20, "run"), (17, 18, "inner"), (23, 24, "Svc"), (24, 24, "go")]
    texts = {c[3]: c[4] for c in parse_python.chunks("app/a.py", PY)}
    assert texts["<module>"] == '"""Doc."""\nimport os\nfrom .b import helper as h, Base\n# note\nX = 1\nif __name__ == "__main__":\n    a = A()\n    a.run(2)'
    assert texts["inner"] == "def inner():\n            h()" and texts["A"].startswith("@deco\nclass A(Base):")


def test_python_outline():
    rows = [(r.depth, r.kind, r.qualified, r.start, r.end, r.signature, r.docstring) for r in parse_python.outline(PY)]
    assert rows == [
        (0, "expression", "", 1, 1, '"""Doc."""', None),
        (0, "expression", "", 5, 5, "X = 1", None),
        (0, "class", "A", 9, 20, "@deco\nclass A(Base):", '"""A class."""'),
        (1, "function", "A.__init__", 12, 14, 'def __init__(self, svc: "Svc | None" = None):', None),
        (1, "function", "A.run", 16, 20, "async def run(self, x):", None),
        (2, "function", "A.run.inner", 17, 18, "def inner():", None),
        (0, "class", "Svc", 23, 24, "class Svc:", None),
        (1, "function", "Svc.go", 24, 24, "def go(self):", None),
    ]
    assert any(r.kind == "import" for r in parse_python.outline(PY, include_imports=True))


def test_python_facts():
    found = parse_python.facts("app/a.py", PY, {"app/b": "app/b.py"})
    a = "app/a.py"
    assert Counter(n[0] for n in found.nodes) == Counter([a, f"{a}::A", f"{a}::A.__init__", f"{a}::A.run", f"{a}::A.run.inner", f"{a}::Svc", f"{a}::Svc.go"])
    assert {e for e in found.edges if e[2] != "defines"} == {
        (a, "os", "imports"),
        (a, "app/b.py", "imports"),
        (f"{a}::A", "app/b.py::Base", "inherits"),
        (f"{a}::A", "deco", "calls"),
        (f"{a}::A.__init__", "app/b.py::Base.__init__", "calls"),
        (f"{a}::A.run", f"{a}::A.run.inner", "calls"),
        (f"{a}::A.run", f"{a}::Svc.go", "calls"),
        (f"{a}::A.run.inner", "app/b.py::helper", "calls"),
        (a, f"{a}::A", "calls"),
        (a, f"{a}::A.run", "calls"),
    }
    assert (f"{a}::A", f"{a}::A.run", "defines") in found.edges and (a, f"{a}::Svc", "defines") in found.edges


def test_python_types():
    src = "from functools import partial\nfrom m import Conn\ndef make() -> tuple[A, B]: ...\nx, y = make()\nx.go()\ny.stop()\np = partial(make)\np()\nwith Conn() as c:\n    c.send()\nclass A:\n    @property\n    def b(self) -> B: ...\n    def f(self):\n        self.b.stop()\nclass B:\n    def stop(self): ...\n"
    calls = {(s, t) for s, t, k in parse_python.facts("p.py", src, {"m": "m.py"}).edges if k == "calls"}
    assert {("p.py", "p.py::A.go"), ("p.py", "p.py::B.stop"), ("p.py", "p.py::make"), ("p.py", "m.py::Conn.send"), ("p.py::A.f", "p.py::B.stop")} <= calls


def test_python_with_an_error():
    broken = "def ok():\n    return 1\n\nclass C:\n    def m(self):\n        x = (\n"
    assert [(u.qualified, u.start, u.end) for u in parse_python.units(broken)] == [("ok", 1, 2), ("C", 4, 6), ("C.m", 5, 6)]
    assert parse_python.chunks("x.py", "") == []


JS = """import def, { a as b, c } from './lib/x';
import * as ns from "../y";
export class K extends c {
  constructor(q) { super(q); this.v = `a${b({x: 1})}c}`; }
  async run(x) { if (x) { return ns.go(x); } return this.run(1); }
}
export const arrow = async (p) => {
  b(p); // }
};
interface I extends J { a: string }
type T = { a: number };
function main() { new K(); arrow(1); const re = /[}/]/; }
main();
"""


def test_jsts():
    assert {(c[1], c[2], c[3]) for c in parse_jsts.chunks("app/k.ts", JS)} >= {(1, 14, "<module>"), (3, 6, "K"), (4, 4, "constructor"), (5, 5, "run"), (7, 9, "arrow"), (10, 10, "I"), (11, 11, "T"), (12, 12, "main")}
    edges = {e for e in parse_jsts.facts("app/k.ts", JS, {"app/lib/x": "app/lib/x.ts", "y": "y.ts"}).edges if e[2] != "defines"}
    k = "app/k.ts"
    assert edges == {
        (k, "app/lib/x.ts", "imports"),
        (k, "y.ts", "imports"),
        (f"{k}::K", "app/lib/x.ts::c", "inherits"),
        (f"{k}::I", "J", "inherits"),
        (f"{k}::K.constructor", "app/lib/x.ts::c.constructor", "calls"),
        (f"{k}::K.constructor", "app/lib/x.ts::a", "calls"),
        (f"{k}::K.run", "y.ts::go", "calls"),
        (f"{k}::K.run", f"{k}::K.run", "calls"),
        (f"{k}::arrow", "app/lib/x.ts::a", "calls"),
        (f"{k}::main", f"{k}::arrow", "calls"),
        (k, f"{k}::main", "calls"),
    }


SOURCE = 'from b import helper\n\nclass A(Base):\n    """Doc."""\n    def run(self):\n        return self.stop()\n\n    def stop(self):\n        return helper(1)\n\ndef main():\n    A().run()\n'


def test_files_of_two_languages_and_none(spark):
    """Inheritance, calls of own methods, of imported names and of what a call returns, by hand."""
    ts = "import { go } from './lib';\nexport function start(n: number) {\n  return go(n);\n}\n"
    files = spark.createDataFrame([("p/a.py", SOURCE), ("p/k.ts", ts), ("p/notes.md", "none"), ("p/gone.py", None)], "path string, content string")
    chunks = {(r["path"], r["start_line"], r["end_line"], r["symbol"], len(r["content"])) for r in parsers.chunk_files(files).collect()}
    assert chunks == {("p/a.py", 1, 13, "<module>", 20), ("p/a.py", 3, 9, "A", 121), ("p/a.py", 5, 6, "run", 41), ("p/a.py", 8, 9, "stop", 40), ("p/a.py", 11, 12, "main", 25), ("p/k.ts", 1, 5, "<module>", 27), ("p/k.ts", 2, 4, "start", 52)}
    edges = {tuple(r) for r in parsers.graph_facts(files)[1].collect()}
    assert edges == {
        ("p/a.py", "b", "imports"), ("p/a.py", "p/a.py::A", "defines"), ("p/a.py", "p/a.py::main", "defines"), ("p/a.py::A", "p/a.py::A.run", "defines"), ("p/a.py::A", "p/a.py::A.stop", "defines"), ("p/a.py::A", "Base", "inherits"),
        ("p/a.py::A.run", "p/a.py::A.stop", "calls"), ("p/a.py::A.stop", "b::helper", "calls"), ("p/a.py::main", "p/a.py::A", "calls"), ("p/a.py::main", "run", "calls"),
        ("p/k.ts", "p/lib", "imports"), ("p/k.ts", "p/k.ts::start", "defines"), ("p/k.ts::start", "p/lib::go", "calls"),
    }
