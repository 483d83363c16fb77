"""Calls of a bare name that no node has as its id count for the nodes that bear it."""

import duckdb

from sieveline.operators import impact
from sieveline.plans import queries as q
from sieveline.schema import NODE

NODES = [("m0", "module", "m0", 1, 2, "m0", "m0"), ("m0::f", "function", "m0", 1, 2, "f", "f"), ("m1::f", "function", "m1", 1, 2, "f", "f"), ("m0::A.go", "function", "m0", 1, 2, "go", "A.go"), ("m1::A.run", "function", "m1", 1, 2, "run", "A.run"), ("m2::B.run", "function", "m2", 1, 2, "run", "B.run")] + [
    (f"m3::c{i}", "function", "m3", 1, 2, f"c{i}", f"c{i}") for i in range(5)
]
# the qualified name is an alias of all that bear it, a short one of the only node that has it; run is the name of two, and m0 is a node
EDGES = [("m3::c0", "f", "calls"), ("m3::c1", "A.go", "imports"), ("m3::c2", "go", "calls"), ("m3::c3", "run", "calls"), ("m3::c4", "m0", "imports"), ("m3::c3", "f", "mentions")]
FOUND = {"m0::f": {"m3::c0"}, "m1::f": {"m3::c0"}, "m0::A.go": {"m3::c1", "m3::c2"}, "m0": {"m3::c4"}}


def test_bare_names(spark):
    n, e = spark.createDataFrame(NODES, NODE), spark.createDataFrame(EDGES, "source string, target string, kind string")
    got = {}
    for r in impact.impact_radius_many(n.select("id"), n, e, 2).collect():
        got.setdefault(r["origin"], set()).add(r["id"])
    assert got == FOUND
    for i in ("m1::f", "m0::A.go", "m1::A.run"):
        assert {r["id"] for r in impact.impact_radius(i, n, e, 2).collect()} == FOUND.get(i, set())


def test_the_sql_has_bare_names():
    con = duckdb.connect()
    con.execute(f"CREATE TABLE n AS SELECT * FROM (VALUES {', '.join(map(str, NODES))}) t(id, kind, file_path, start_line, end_line, name, qualified_name)")
    con.execute(f"CREATE TABLE e AS SELECT * FROM (VALUES {', '.join(map(str, EDGES))}) t(source, target, kind)")
    sql = q._impact_many_sql(2).replace(q.a.NODES, "SELECT * FROM n").replace(q.a.EDGES, "SELECT * FROM e")
    got = {}
    for origin, found in con.execute(f"SELECT origin, id FROM ({sql})").fetchall():
        got.setdefault(origin, set()).add(found)
    assert got == FOUND
