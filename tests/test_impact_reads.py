"""What a search for impact goes through: targets that bear a seed's name, and what was found once."""

import re

from sieveline.operators import impact
from sieveline.schema import NODE

NODES = [(i, "module" if "::" not in i else "function", i.split("::")[0], 1, 2, i, i.split("::")[-1]) for i in ("m0", "m1", "m0::f0", "m0::f1", "m1::f2", "m1::f3")]
EDGES = [("m0::f1", "pkg::f0", "calls"), ("m1::f2", "m0::f0", "calls"), ("m1::f2", "m0::f0", "imports"), ("m1", "m1::f2", "imports"), ("m1::f3", "m1::f2", "calls"), ("m0", "m1::f3", "imports")]


def test_only_targets_of_a_seeds_name_are_told_apart(spark, monkeypatch):
    n, e = spark.createDataFrame(NODES, NODE), spark.createDataFrame(EDGES, "source string, target string, kind string")
    given, whole = [], impact.phantom_aliases
    monkeypatch.setattr(impact, "phantom_aliases", lambda of, nodes, edges, tags=(): (given.append({r["target"] for r in edges.collect()}), whole(of, nodes, edges, tags))[1])
    got = {(r["id"], r["hop"]) for r in impact.impact_radius("m0::f0", n, e, 3).collect()}
    assert given == [{"pkg::f0", "m0::f0"}]
    assert got == {("m0::f1", 1), ("m1::f2", 1), ("m1::f3", 2)}  # m1 goes, as f2 is of its file; m0 is the node's own


def test_what_was_found_for_many_is_made_once(spark):
    n, e = spark.createDataFrame(NODES, NODE), spark.createDataFrame(EDGES, "source string, target string, kind string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = impact.impact_radius_many(n.select("id"), n, e, 3)
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(r["id"], r["hop"]) for r in rows if r["origin"] == "m0::f0"} == {("m0::f1", 1), ("m1::f2", 1), ("m1::f3", 2)}
    assert len(re.findall("ReusedExchange", plan)) >= 2
