"""What a search for many symbols shuffles: every edge twice, what is found once, and the graph's edges once when they are stored."""

import uuid

import pytest

from sieveline.operators import impact
from sieveline.plans import adapters as a
from sieveline.schema import NODE

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled(spark):
    """Rows that a frame's job shuffles where no join is a broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def rows(frame):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "")
        frame.write.format("noop").mode("overwrite").save()
        spark.sparkContext.setJobGroup("rest", "")
        tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
        return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)

    yield rows
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_what_is_found_is_shuffled_once(spark, shuffled, tmp_path):
    a.nodes(spark, SF).write.parquet(f"{tmp_path}/n")
    a.edges(spark, SF).write.parquet(f"{tmp_path}/e")
    n, e = spark.read.parquet(f"{tmp_path}/n"), spark.read.parquet(f"{tmp_path}/e")
    found = impact.impact_radius_many(n.select("id"), n, e, 3)
    most = 2 * e.count() + 2 * found.count() + 8 * n.count()
    assert shuffled(found) < most


def test_stored_edges_are_shuffled_once(spark, shuffled):
    stored, edges = a.edges_by_target(spark, SF), a.edges(spark, SF)
    assert sorted(map(tuple, stored.select("source", "target", "kind").collect())) == sorted(map(tuple, edges.select("source", "target", "kind").collect()))
    assert shuffled(stored) < shuffled(edges.repartition("target")) - 0.9 * edges.count()


def test_a_start_beside_a_cycle_and_modules(spark):
    """A seed comes back at its first hop, modules end a walk but not at its start, and sources that no node is are passed."""
    nodes = [(i, "module" if "::" not in i else "function", i.split("::")[0], 1, 2, i, i.split("::")[-1]) for i in ("m0", "m1", "m0::a", "m0::b", "m1::c", "m1::d", "m2::e")]
    edges = [("m0::b", "m0::a", "calls"), ("m0::a", "m0::b", "calls"), ("m0::a", "m0::b", "imports"), ("m1", "m0::b", "imports"), ("m1::d", "m1", "imports"), ("ghost", "m0::b", "calls"), ("m2::e", "ghost", "calls")]
    n, e = spark.createDataFrame([*nodes, nodes[-1]], NODE), spark.createDataFrame(edges, "source string, target string, kind string")
    got = {}
    for r in impact.impact_radius_many(n.select("id"), n, e, 3).collect():
        got.setdefault(r["origin"], []).append((r["id"], r["hop"]))
    assert {o: sorted(x) for o, x in got.items()} == {
        "m0::a": [("m0::a", 2), ("m0::b", 1), ("m1", 2), ("m2::e", 3), ("m2::e", 3)],  # a node of two rows is told twice, as in SQL
        "m0::b": [("m0::a", 1), ("m0::b", 2), ("m1", 1), ("m2::e", 2), ("m2::e", 2)],
        "m1": [("m1::d", 1)],
    }
