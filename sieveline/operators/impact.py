"""Impact radius: what depends on a symbol, by a bounded reverse traversal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.scalar import qualified_of
from sieveline.operators.graph import fuzzy_resolve, resolve
from sieveline.sources.shared import written

FOLLOWED = ("calls", "imports", "inherits")


def overridden(node: DataFrame, nodes: DataFrame, edges: DataFrame, tags: tuple[str, ...] = ()) -> DataFrame:
    """The method of the same name of each parent that a node's class inherits from. ``node`` has (id), and columns that go with it in ``tags``."""
    own = node.select(*tags, "id", F.substring_index("id", "::", 1).alias("_file"), qualified_of(F.col("id")).alias("_q"))
    method = own.where(F.contains("_q", F.lit("."))).select(
        *tags, F.concat("_file", F.lit("::"), F.expr("left(_q, length(_q) - length(substring_index(_q, '.', -1)) - 1)")).alias("_class"), F.substring_index("_q", ".", -1).alias("_name")
    )
    parents = method.join(edges.where("kind = 'inherits'"), F.col("_class") == F.col("source")).select(*tags, F.concat("target", F.lit("."), "_name").alias("id"))
    return parents.join(nodes.select("id"), "id", "left_semi").select(*tags, "id")


def seeds(node: DataFrame, nodes: DataFrame, edges: DataFrame, tags: tuple[str, ...] = ()) -> DataFrame:
    """The node, and the methods that it overrides. ``node`` has (id), and columns that go with it in ``tags``."""
    return node.select(*tags, "id").unionByName(overridden(node, nodes, edges, tags)).distinct()


def phantom_aliases(of: DataFrame, nodes: DataFrame, edges: DataFrame, tags: tuple[str, ...] = ()) -> DataFrame:
    """Missing targets that are a seed's qualified name, bare or after a ``::``, or its short name, if one node alone has that: equalities on derived keys."""
    missing = edges.select(F.col("target").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    # a mark that no name can be stands for null: a filter would reach what makes the seeds, which other joins then couldn't share
    names = of.select(*tags, F.coalesce(qualified_of(F.col("id")), F.lit("::")).alias("_q"))
    named = missing.withColumn("_q", F.substring_index("id", "::", -1)).join(names, "_q").select(*tags, "id")
    bare = missing.where(~F.contains("id", F.lit("::"))).select(F.col("id").alias("name"))
    short = nodes.select("name", "id").join(bare, "name", "left_semi").groupBy("name").agg(F.min("id").alias("id"), F.max("id").alias("_other")).where("id = _other")
    return named.unionByName(of.join(short, "id").select(*tags, F.col("name").alias("id"))).distinct()


def reach(start: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(id, hop): first hop at which each node is met, walking edges backwards, never on from a module.

    Seeds aren't marked as visited, so a cycle may bring them back; depth 0 is as depth 1. Each hop's nodes are written
    to the shared folder, so no hop runs the ones before it again.
    """
    followed = edges.where(F.col("kind").isin(*FOLLOWED)).select("source", "target")
    modules = nodes.where("kind = 'module'").select(F.col("id").alias("target"))
    seen = None
    frontier = start.select(F.col("id").alias("target"))
    for hop in range(1, max(1, depth) + 1):
        found = followed.join(frontier, "target").select(F.col("source").alias("id")).distinct()
        if seen is not None:
            found = found.join(seen, "id", "left_anti")
        found = written(found.withColumn("hop", F.lit(hop)), "hop")
        seen = found if seen is None else seen.unionByName(found)
        frontier = found.select(F.col("id").alias("target")).join(modules, "target", "left_anti")
    return seen


def _least(df: DataFrame, place: str, key: str, order: str) -> DataFrame:
    """The row of least ``order`` for each ``place`` and ``key``. One shuffle by ``place`` alone serves joins on that as well, and a sort that may spill takes the place of a hash table."""
    rank = F.row_number().over(Window.partitionBy(place, key).orderBy(order))
    return df.repartition(place).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def reach_many(start: DataFrame, aliases: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(origin, id, hop): as ``reach`` for every origin of ``start`` and ``aliases`` (origin, id) at once, in one plan that writes nothing on the way.

    What the walk goes on from, sources that are targets as well and no modules, is followed first, hop by hop and over edges
    between such nodes alone. Then all edges are joined with the start and with these, so most of what is met, from which
    nothing goes on, is shuffled once. That is by ``id``, so a join with its nodes shuffles nothing again.
    """
    # two kinds of edge between the same nodes are two rows here and one in what was met
    followed = edges.where(F.col("kind").isin(*FOLLOWED)).select("source", "target")
    modules = nodes.where("kind = 'module'").select(F.col("id").alias("source"))
    passed = followed.select(F.col("target").alias("source")).distinct().join(modules, "source", "left_anti")
    onward = followed.join(passed, "source", "left_semi")
    first, other = (x.select("origin", F.col("id").alias("target")) for x in (start, aliases))
    met = first.join(followed, "target").select("origin", F.col("source").alias("id"), F.lit(1).alias("hop"))
    rest = other.withColumn("hop", F.lit(0))
    if depth > 1:
        here = first.join(onward, "target").unionByName(other.join(onward, "target")).select("origin", F.col("source").alias("target"), F.lit(1).alias("hop")).distinct()
        for hop in range(2, depth):
            # each row comes with those that it leads to, so what was met before is read once
            ways = here.join(onward.withColumnRenamed("target", "_from"), (F.col("target") == F.col("_from")) & (F.col("hop") == hop - 1), "left")
            both = F.array(F.struct("target", "hop"), F.struct(F.col("source").alias("target"), F.lit(hop).alias("hop")))
            ways = ways.select("origin", F.inline(F.when(F.col("source").isNull(), F.slice(both, 1, 1)).otherwise(both)))
            here = ways.groupBy("origin", "target").agg(F.min("hop").alias("hop"))
        rest = rest.unionByName(here)
    met = met.unionByName(rest.join(followed, "target").select("origin", F.col("source").alias("id"), (F.col("hop") + 1).alias("hop")))
    return _least(met, "id", "origin", "hop")


def suppress_modules(found: DataFrame, tags: tuple[str, ...] = (), mark: str = "id", near: DataFrame | None = None) -> DataFrame:
    """Drops a module if something else of its file is reported. Modules alone are joined, with the files of the rest.

    ``mark`` is a column without nulls that all three readers of ``found`` keep: they then share what it is made of.
    ``near`` has the rows of ``found`` whose file has a module, if those of other files are to be left alone.
    """
    rest = "kind is null or kind <> 'module'"
    modules, others = found.where("kind = 'module'"), found.where(rest)
    inner = (others if near is None else near.where(rest)).where("kind is not null").groupBy(*tags, "file_path").agg(F.min(mark).alias("_inner"))
    return others.unionByName(modules.join(inner, [*tags, "file_path"], "left").where("_inner is null").drop("_inner"))


def impact_radius(node: str, nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """Nodes that depend on a node id within ``depth`` hops, with the hop; its own module is left out."""
    spark = nodes.sparkSession
    start = written(seeds(spark.createDataFrame([(node,)], "id string"), nodes, edges), "seeds")
    # of all targets, those that end in a seed's name alone are told apart and looked up
    names = start.select(qualified_of(F.col("id")).alias("_q")).where("_q is not null").unionByName(nodes.join(start, "id", "left_semi").select(F.col("name").alias("_q"))).distinct()
    named = edges.join(names, F.substring_index("target", "::", -1) == F.col("_q"), "left_semi")
    start = written(start.unionByName(phantom_aliases(start, nodes, named)).distinct(), "seeds")
    own = node.split("::", 1)[0]
    found = reach(start, nodes, edges, depth).join(nodes, "id").where((F.col("id") != own) | F.lit(own == node))
    return suppress_modules(found)


def impact_radius_many(asked: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """``impact_radius`` of each node id in ``asked`` (id), with the id that was asked for as ``origin``; one job for all of them.

    Repeated ids count once, a null one and one that nothing depends on have no rows; an empty table gives an empty result.
    """
    tags = ("origin",)
    own = asked.where("id is not null").select(F.col("id").alias("origin"), "id")
    start = _least(own.unionByName(overridden(own, nodes, edges, tags)), "id", "origin", "origin")
    module = F.substring_index("origin", "::", 1)
    met = reach_many(start, phantom_aliases(start, nodes, edges, tags), nodes, edges, depth).where((F.col("id") != module) | (F.col("origin") == module))
    near = nodes.select("id", "kind", "file_path").join(nodes.where("kind = 'module'").select("file_path").distinct(), "file_path", "left_semi")
    return suppress_modules(met.join(nodes, "id"), tags, "hop", met.join(near, "id"))


@dataclass
class Impact:
    """What a request for a symbol found: the node, rows of what depends on it, a warning and a hint."""

    resolved: str | None
    nodes: DataFrame | None
    hint: str | None = None
    warning: str | None = None


def impact(symbol: str, nodes: DataFrame, edges: DataFrame, depth: int = 2) -> Impact:
    asked = nodes.sparkSession.createDataFrame([(symbol,)], "symbol string")
    found, warning = resolve(asked, nodes).first()["id"], None
    if found is None and (near := fuzzy_resolve(asked, nodes).first()):
        found, warning = near["id"], f"{symbol} was taken for {near['id']}"
    if found is None:
        same = nodes.where((F.col("name") == symbol) | (F.col("qualified_name") == symbol)).select("id").distinct().orderBy("id").limit(21).collect()
        if len(same) > 1:
            return Impact(None, None, "Ambiguous; it may be " + ", ".join(r["id"] for r in same[:20]) + (", ..." if len(same) > 20 else ""))
        return Impact(None, None, f"No symbol {symbol} in the graph")
    rows = impact_radius(found, nodes, edges, depth)
    hint = None
    if rows.isEmpty():
        n = importers(edges, found.split("::", 1)[0]).first()["n"]
        hint = f"No caller found; {n} modules import its module" if n else "No caller found, and no module imports its module"
    return Impact(found, rows, hint, warning)


def importers(edges: DataFrame, file: str) -> DataFrame:
    return edges.where((F.col("kind") == "imports") & (F.col("target") == file)).agg(F.count_distinct("source").alias("n"))


def zero_caller_hints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_importers) of nodes that nothing calls or inherits: how many sources import their file."""
    used = edges.where("kind in ('calls', 'inherits')").select(F.col("target").alias("id")).distinct()
    imports = edges.where("kind = 'imports'").groupBy(F.col("target").alias("file_path")).agg(F.count_distinct("source").alias("n"))
    return nodes.join(used, "id", "left_anti").join(imports, "file_path", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_importers"))


