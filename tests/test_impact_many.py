"""Impact of many symbols at once against a walk from each, and against the search for one."""

import random

import pytest

from sieveline.operators import impact
from sieveline.schema import NODE


def walked(start, edges, modules, depth):
    """First hop of what is met from a list of ids, by a plain walk backwards."""
    seen, frontier = {}, set(start)
    for hop in range(1, max(1, depth) + 1):
        met = {s for s, t, k in edges if t in frontier and k in impact.FOLLOWED}
        new = met - seen.keys()
        seen |= {x: hop for x in new}
        frontier = new - modules
    return seen


@pytest.mark.parametrize("depth", [0, 1, 4])
def test_many_against_walks(spark, depth):
    rng = random.Random(depth)
    ids = [f"m{i}" for i in range(4)] + [f"m{i % 4}::f{i}" for i in range(40)] + ["m0::Base", "m0::Base.run", "m1::Child", "m1::Child.run"]
    nodes = [(i, "module" if "::" not in i else "function", i.split("::")[0], 1, 2, i.split("::")[-1], i.split("::")[-1]) for i in ids]
    edges = {(rng.choice(ids), rng.choice([*ids, "pkg::f3", "m3"]), rng.choice(["calls", "imports", "inherits", "mentions"])) for _ in range(130)}
    edges |= {("m0::f4", "m0::f8", "calls"), ("m0::f8", "m0::f4", "calls"), ("m0::f4", "m0::f4", "calls"), ("m1::Child", "m0::Base", "inherits"), ("m2::f2", "m0::Base.run", "calls"), ("m2::f6", "pkg::f3", "calls")}
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(sorted(edges), "source string, target string, kind string")
    tracker = spark.sparkContext.statusTracker()
    asked = spark.createDataFrame([(i,) for i in [*ids, ids[5], "nowhere::x", None]], "id string")
    spark.sparkContext.setJobGroup(f"many-{depth}", "")
    frame = impact.impact_radius_many(asked, n, e, depth)
    assert not tracker.getJobIdsForGroup(f"many-{depth}")  # nothing runs until the result is asked for
    got = {}
    for r in frame.collect():
        assert r["id"] not in got.setdefault(r["origin"], {})
        got[r["origin"]][r["id"]] = r["hop"]
    spark.sparkContext.setJobGroup("rest", "")
    modules = {i for i in ids if "::" not in i}
    targets = {t for _, t, _ in edges}
    for i in [*ids, "nowhere::x"]:
        start = {i} | ({"m0::Base.run"} if i == "m1::Child.run" else set())
        start |= {t for t in targets - set(ids) if "::" in t and any("::" in x and t.split("::")[1] == x.split("::")[1] for x in start)}
        found = {x: h for x, h in walked(start, edges, modules, depth).items() if x in ids and (x != i.split("::")[0] or x == i)}
        inner = {x.split("::")[0] for x in found if x not in modules}
        assert got.get(i, {}) == {x: h for x, h in found.items() if x not in inner}, i
    for i in ("m0::f4", "m1::Child.run"):
        assert got.get(i, {}) == {r["id"]: r["hop"] for r in impact.impact_radius(i, n, e, depth).collect()}
    assert impact.impact_radius_many(asked.where("false"), n, e, depth).count() == 0
