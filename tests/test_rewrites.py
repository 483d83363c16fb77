"""Names that calls are moved to: of edges that are distinct, those alone are compared that may have become the same."""

import pytest

from sieveline.operators import graph
from sieveline.schema import NODE

NODES = [(i, "function", i.split("::")[0], 1, 2, f"n{i[-1]}", i.split("::")[1]) for i in ("m0::f0", "m0::f1", "m1::f2", "m1::f3")] + [("m2::f4", "function", "m2", 1, 2, "n3", "f4")]
EDGES = [("s", "n0", "calls"), ("s", "f0", "calls"), ("s", "pkg::f0", "calls"), ("s", "m0::f0", "calls"), ("s", "m0::f0", "imports"), ("s", "n0", "imports"), ("t", "n0", "calls"), ("t", "pkg::f1", "calls"), ("t", "n3", "calls"), ("t", "nowhere", "calls"), ("t", "pkg::nowhere", "calls"), ("u", None, "calls"), (None, "f1", "calls")]


def plain(f):
    """What the rewriting of each edge alone gives."""
    found = {}
    for i, _, _, _, _, name, qualified in NODES:
        found.setdefault(name, set()).add(i)
        found.setdefault(qualified, set()).add(i)
    ids, out = {n[0] for n in NODES}, set()
    for source, target, kind in EDGES:
        if kind == "calls" and target is not None and target not in ids and ("::" in target) == (f is graph.rewrite_package_phantoms):
            named = found.get(target.split("::")[-1], ())
            target = min(named) if len(named) == 1 else target
        out.add((source, target, kind))
    return out


@pytest.mark.parametrize("f", [graph.rewrite_bare_phantoms, graph.rewrite_package_phantoms])
def test_edges_stay_distinct(spark, f):
    n, e = spark.createDataFrame(NODES, NODE), spark.createDataFrame(EDGES, "source string, target string, kind string")
    for got in (f(e, n, unique=True), f(e.unionByName(e), n)):
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == plain(f)


def test_the_query_compares_few_edges(spark):
    from sieveline.plans import queries as q

    sf = "/root/testdata/sf0.001"
    edges = q._graph(spark, sf)[1].count()
    spark.sparkContext.setJobGroup("rewrites", "rewrites")
    assert q.rewrite_bare_phantoms(spark, sf).count() > 0
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("rewrites") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
    spark.sparkContext.setJobGroup("", "")
    assert sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < edges / 2
