"""The code graph as two relations: nodes and edges. Indexes are joins on their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.scalar import file_of, last_component, module_names, qualified_of
from sieveline.sources.shared import written


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["source", "target", "kind"])


def merged_kinds(edges: DataFrame) -> DataFrame:
    """One row for each (source, target) with its sorted kinds."""
    return edges.groupBy("source", "target").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, phantoms included, and pairs of nodes with an edge."""
    ids = nodes.select("id").unionByName(edges.select(F.col("source").alias("id"))).unionByName(edges.select(F.col("target").alias("id")))
    n = ids.agg(F.count_distinct("id").alias("node_count"))
    return n.crossJoin(edges.select("source", "target").distinct().agg(F.count(F.lit(1)).alias("edge_count")))  # one row each


def phantoms(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Targets that no node has."""
    return edges.select(F.col("target").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")


def module_index(paths: DataFrame) -> DataFrame:
    """(module, path): of the paths that a module name fits, the first in order."""
    return paths.select("path", F.explode(module_names(F.col("path"))).alias("module")).groupBy("module").agg(F.min("path").alias("path"))


def candidates(nodes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(symbol, n, id): how many nodes a short or qualified name may mean, and the id if it is one; of the symbols in ``asked`` alone, if they are given."""
    short = nodes.select(F.col("name").alias("symbol"), "id")
    full = nodes.select(F.col("qualified_name").alias("symbol"), "id")
    if asked is not None:
        short, full = (x.join(asked.select("symbol"), "symbol", "left_semi") for x in (short, full))
    return short.unionByName(full).distinct().groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))


def resolve(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol, id, how): by exact id, then by unique short name, then by unique qualified name; unresolved ones have neither."""
    exact = nodes.select(F.col("id").alias("symbol"), F.col("id").alias("_exact"))
    short = nodes.groupBy(F.col("name").alias("symbol")).agg(F.count_distinct("id").alias("_n"), F.min("id").alias("_short")).where("_n = 1").drop("_n")
    full = nodes.groupBy(F.col("qualified_name").alias("symbol")).agg(F.count_distinct("id").alias("_m"), F.min("id").alias("_full")).where("_m = 1").drop("_m")
    joined = symbols.select("symbol").distinct().join(exact, "symbol", "left").join(short, "symbol", "left").join(full, "symbol", "left")
    how = F.when(F.col("_exact").isNotNull(), "id").when(F.col("_short").isNotNull(), "name").when(F.col("_full").isNotNull(), "qualified")
    return joined.select("symbol", F.coalesce("_exact", "_short", "_full").alias("id"), how.alias("how"))


def ambiguous(nodes: DataFrame) -> DataFrame:
    return candidates(nodes).where("n > 1").select("symbol", "n")


def fuzzy_resolve(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol, id) where a ``file::name`` has one node of that last name in that file."""
    asked = symbols.select("symbol", file_of(F.col("symbol")).alias("file_path"), last_component(F.col("symbol")).alias("_last")).where(F.contains("symbol", F.lit("::")))
    known = nodes.groupBy("file_path", last_component(F.col("qualified_name")).alias("_last")).agg(F.count_distinct("id").alias("_n"), F.min("id").alias("id")).where("_n = 1")
    return asked.join(known, ["file_path", "_last"]).select("symbol", "id")


def _phantom_calls(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.where("kind = 'calls'").join(nodes.select(F.col("id").alias("target")), "target", "left_anti")


def _with_targets(edges: DataFrame, moved: DataFrame, unique: bool) -> DataFrame:
    """``moved`` has (target, new): CALLS edges to those targets point to the new ones, and edges stay distinct.

    Of edges that are ``unique`` as given, as stored ones are, only calls to the new targets can be the same now, and no others are compared.
    """
    joined = edges.join(moved, (edges["target"] == moved["_target"]) & (edges["kind"] == "calls"), "left")
    every = joined.select("source", F.coalesce("new", "target").alias("target"), "kind")
    if not unique:
        return every.distinct()
    met = moved.select(F.col("new").alias("_met")).distinct()
    meets = (every["target"] == met["_met"]) & (every["kind"] == "calls")
    return every.join(met, meets, "left_anti").unionByName(every.join(met, meets, "left_semi").distinct())


def _moved(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target, new) of those of ``asked`` (target, symbol) that one node bears the name of; tables of the shared folder, as they are read several times."""
    asked = written(asked, "asked")
    moved = asked.join(candidates(nodes, asked).where("n = 1"), "symbol").select(F.col("target").alias("_target"), F.col("id").alias("new"))
    return written(moved, "moved")


def rewrite_package_phantoms(edges: DataFrame, nodes: DataFrame, unique: bool = False) -> DataFrame:
    """CALLS to a missing ``package::Symbol`` point to the one node that is named so, if there is one."""
    missing = _phantom_calls(edges, nodes).where(F.contains("target", F.lit("::"))).select("target").distinct()
    return _with_targets(edges, _moved(missing.select("target", qualified_of(F.col("target")).alias("symbol")), nodes), unique)


def prune_phantoms(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Drops CALLS to missing targets whose name no node has, and bare ones that several have."""
    missing = _phantom_calls(edges, nodes).select("target").distinct()
    asked = missing.withColumn("symbol", F.coalesce(qualified_of(F.col("target")), "target")).join(candidates(nodes).select("symbol", "n"), "symbol", "left")
    gone = asked.where("n is null or (n > 1 and not contains(target, '::'))").select(F.col("target").alias("_gone"))
    return edges.join(gone, (edges["target"] == gone["_gone"]) & (edges["kind"] == "calls"), "left_anti")


def rewrite_bare_phantoms(edges: DataFrame, nodes: DataFrame, unique: bool = False) -> DataFrame:
    """CALLS to a bare name point to the one node that has it, if there is one."""
    missing = _phantom_calls(edges, nodes).where(~F.contains("target", F.lit("::"))).select("target").distinct()
    return _with_targets(edges, _moved(missing.select("target", F.col("target").alias("symbol")), nodes), unique)


def post_merge(edges: DataFrame, nodes: DataFrame, languages: set[str] | None = None) -> DataFrame:
    """All passes in order; the first two are Python's and run if it is among the languages (or none are given)."""
    if languages is None or "python" in languages:
        edges = prune_phantoms(rewrite_package_phantoms(edges, nodes), nodes)
    return rewrite_bare_phantoms(edges, nodes)


def merge(stored: DataFrame, fresh: DataFrame, paths: DataFrame, file_column: str) -> DataFrame:
    """Replaces what stems from ``paths``: nodes by their file, edges by their source's, so callers in other files stay."""
    file = F.col(file_column) if file_column == "file_path" else file_of(F.col(file_column))
    kept = stored.withColumn("_file", file).join(paths.select(F.col("path").alias("_file")).distinct(), "_file", "left_anti").drop("_file")
    return kept.unionByName(fresh)
