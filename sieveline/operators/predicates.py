"""Filters and predicates over paths, chunks, nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.errors import SearchError
from sieveline.functions.scalar import file_of

#: Parts that mark a path as a test's: fixed values.
TEST_PATH_PARTS = ("/tests/", "/test/", "/test_", "_test.py", "/conftest.py", "/conftest_", ".spec.ts", ".spec.js", ".spec.tsx", ".spec.jsx", "/__tests__/")
MAX_CONTENT_LINES = 60


def under_prefix(path: Column, prefix: str | None) -> Column:
    """Within a directory; the prefix is literal, so ``src`` matches neither ``src2/x`` nor wildcards."""
    if not prefix or not prefix.rstrip("/"):
        return F.lit(True)
    return path.startswith(prefix.rstrip("/") + "/")


def not_test_query(path: Column) -> Column:
    """The filter that queries use to leave tests out; deliberately wide, as ``latest.py`` goes too."""
    return ~path.ilike("%test%") & ~path.ilike("%.spec.%") & ~path.ilike("%/__tests__/%")


def is_test_path(path: Column) -> Column:
    rooted = F.concat(F.lit("/"), path)
    return reduce(lambda a, b: a | b, (F.contains(rooted, F.lit(p)) for p in TEST_PATH_PARTS))


def scope(path: Column, prefix: str | None = None, aliases: list[str] | None = None, include_tests: bool = True) -> Column:
    """Prefix, aliases and test filter together."""
    found = under_prefix(path, prefix)
    if aliases and "*" not in aliases:
        found = found & F.substring_index(path, "/", 1).isin(aliases)
    return found if include_tests else found & not_test_query(path)


def default_aliases(given: list[str] | None, known: list[str], primary: str, default_scope: str = "primary") -> list[str] | None:
    """Aliases a request searches: those given, all for ``*``, else the primary one if there are several roots."""
    for a in given or ():
        if a != "*" and a not in known:
            raise ValueError(f"unknown alias {a!r}; known: {', '.join(sorted(known))}")
    if given:
        return None if "*" in given else given
    return [primary] if len(known) > 1 and default_scope == "primary" else None


def check_query(text: str | None) -> None:
    if text is not None and len(text.strip()) < 2:
        raise SearchError("Empty query" if not text.strip() else "Query too short")


def in_scopes(path: Column, scopes: list[str] | None) -> Column:
    """At or below one of the scopes; no scopes means everywhere."""
    if scopes is None:
        return F.lit(True)
    return reduce(lambda a, b: a | b, ((path == s) | path.startswith(s.rstrip("/") + "/") for s in scopes), F.lit(False))


def contains_span(a_path, a_start, a_end, b_path, b_start, b_end) -> Column:
    return (a_path == b_path) & (a_start <= b_start) & (a_end >= b_end)


def within_lines(df: DataFrame, lo: int, hi: int) -> DataFrame:
    return df.where((F.col("start_line") >= lo) & (F.col("end_line") <= hi))


def truncate_content(df: DataFrame, max_lines: int | None = MAX_CONTENT_LINES) -> DataFrame:
    """Adds ``truncated`` and cuts ``content`` to its first lines."""
    if max_lines is None:
        return df.withColumn("truncated", F.lit(False))
    return df.withColumn("truncated", F.size(F.split("content", "\n", -1)) > max_lines).withColumn("content", F.substring_index("content", "\n", max_lines))


def edge_filter(edges: DataFrame, kind: str | None = None, source: str | None = None, target: str | None = None) -> DataFrame:
    for column, part in (("source", source), ("target", target)):
        if part:
            edges = edges.where(F.contains(F.col(column), F.lit(part)))
    return edges.where(F.col("kind") == kind) if kind else edges


def known_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose target lies in a known file; ``files`` has a column ``path``."""
    return edges.join(files.select(F.col("path").alias("_file")).distinct(), file_of(F.col("target")) == F.col("_file"), "left_semi")


def symbol_matches(qualified: Column, symbol: str) -> Column:
    """The symbol itself or anything nested in it."""
    return (qualified == symbol) | qualified.startswith(symbol + ".")
