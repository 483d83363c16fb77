"""The engine's questions as functions of plain values, for tool servers: each returns what JSON can hold."""

from __future__ import annotations

import threading
from pathlib import Path

from pyspark.sql import SparkSession

from sieveline.engine import Engine
from sieveline.errors import IndexMissingError


class Service:
    """One engine for each root, made when first asked for. State is read anew each time, so a rebuild is seen."""

    def __init__(self, spark: SparkSession):
        self.spark, self._engines, self._lock = spark, {}, threading.Lock()

    def engine(self, root: str) -> Engine:
        key = str(Path(root).resolve())
        with self._lock:
            if key not in self._engines:
                self._engines[key] = Engine(self.spark, key)
            return self._engines[key]

    def semantic_search(self, root: str, query: str, top_k: int = 5, path_prefix: str | None = None, repos: list[str] | None = None, include_tests: bool = True) -> list[dict]:
        e = self.engine(root)
        if not e.store.exists():
            raise IndexMissingError("build the index first")
        keep = ("path", "start_line", "end_line", "symbol", "content", "score", "truncated", "relevance", "search_mode")
        return [{k: r[k] for k in keep} for r in e.search(query, top_k, path_prefix, repos, include_tests).orderBy("rank").collect()]

    def get_file_skeleton(self, root: str, path: str, include_imports: bool = False, symbol: str | None = None) -> str:
        return self.engine(root).skeleton(path, include_imports, symbol)

    def get_impact_radius(self, root: str, symbol: str, depth: int = 2) -> dict:
        found = self.engine(root).impact(symbol, depth)
        nodes = [r.asDict() for r in found.nodes.orderBy("hop", "id").collect()] if found.nodes is not None else []
        return {"resolved_node": found.resolved, "nodes": nodes, "hint": found.hint, "resolution_warning": found.warning}

    def index_status(self, root: str) -> dict:
        return self.engine(root).status()
