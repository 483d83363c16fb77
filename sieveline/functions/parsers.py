"""Row-parallel parsing of a files relation (path, content): chunks, outlines, graph facts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import ModuleType

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sieveline.functions import parse_jsts, parse_python
from sieveline.functions.scalar import EXTENSIONS
from sieveline.schema import CHUNK, EDGE, LOOKUP, NODE, SKELETON_ROW

#: Node and edge columns of one row of facts; a row is a node if it has an id, else an edge.
FACT = StructType([StructField(f.name, f.dataType, True) for f in (*NODE.fields, *(x for x in EDGE.fields if x.name != "kind"))])
#: Rows that a task gathers before it passes them on, besides those of the file at which it gets there.
FRAME_ROWS = 2048
#: Languages and what parses them: a module with chunks, outline and facts. Others may be registered.
REGISTRY: dict[str, ModuleType] = {"python": parse_python, "javascript": parse_jsts, "typescript": parse_jsts}


@dataclass(frozen=True)
class LanguagePlugin:
    name: str
    extensions: tuple[str, ...]
    parser: ModuleType
    #: Passes over (edges, nodes) of the whole graph that return its edges, after those that every graph gets.
    post_merge_passes: tuple[Callable[[DataFrame, DataFrame], DataFrame], ...] = ()


#: Passes of registered languages.
PASSES: dict[str, tuple] = {}


def register(plugin: LanguagePlugin) -> None:
    REGISTRY[plugin.name] = plugin.parser
    PASSES[plugin.name] = plugin.post_merge_passes
    EXTENSIONS.update(dict.fromkeys(plugin.extensions, plugin.name))


def parser_of(path: str) -> ModuleType | None:
    name = path.rsplit("/", 1)[-1]
    return REGISTRY.get(EXTENSIONS.get("." + name.rsplit(".", 1)[-1].lower(), "")) if "." in name else None


def _mapped(files: DataFrame, schema, rows, more: tuple[str, ...] = ()) -> DataFrame:
    names, given = schema.fieldNames(), ["path", "content", *more]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for frame in frames:
            for path, content, *x in zip(*(frame[c] for c in given)):
                if content is not None and (p := parser_of(path)):
                    out += rows(p, path, content, *x)
                if len(out) >= FRAME_ROWS:
                    yield pd.DataFrame(out, columns=names, dtype=object)
                    out = []
        yield pd.DataFrame(out, columns=names, dtype=object)

    return files.select(*given).mapInPandas(run, schema)


def chunk_files(files: DataFrame) -> DataFrame:
    return _mapped(files, CHUNK, lambda p, path, content: p.chunks(path, content))


def skeleton(files: DataFrame, include_imports: bool = False) -> DataFrame:
    return _mapped(files, SKELETON_ROW, lambda p, path, content: [(path, r.ord, r.depth, r.kind, r.qualified, r.start, r.end, r.signature, r.docstring) for r in p.outline(content, include_imports)])


class _Asked(dict):
    """An index that knows no module and remembers what it was asked for."""

    def __init__(self):
        self.names: set[str] = set()

    def __bool__(self) -> bool:
        return True

    def get(self, name, default=None):
        self.names.add(name)
        return default


def lookups(files: DataFrame) -> DataFrame:
    """(path, module): the module names that each file's imports may mean, whether or not a file has them."""

    def rows(p, path: str, content: str) -> list[tuple]:
        asked = _Asked()
        p.facts(path, content, asked)
        return [(path, name) for name in sorted(asked.names)]

    return _mapped(files, LOOKUP, rows)


def resolved(files: DataFrame, asked: DataFrame, index: DataFrame) -> DataFrame:
    """Adds to each file what the modules are that it asks for: ``asked`` are its ``lookups``, ``index`` has (module, path)."""
    found = asked.join(index.select("module", F.col("path").alias("_file")), "module")
    modules = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.col("module").alias("module"), F.col("_file").alias("file")))).alias("_found"))
    return files.join(modules, "path", "left").select("path", "content", F.col("_found.module").alias("modules"), F.col("_found.file").alias("targets"))


def facts(files: DataFrame, index: dict[str, str] | None = None) -> DataFrame:
    """Nodes and edges of files that are parsed once, as one relation for ``graph_of``. Imports mean what ``resolved`` adds to each file, or what a small ``index`` says."""
    blank = (None,) * 2

    def rows(p, path: str, content: str, modules=None, targets=None) -> list[tuple]:
        found = p.facts(path, content, dict(zip(modules, targets)) if modules is not None else index or {})
        return [(*n, *blank) for n in found.nodes] + [(None, kind, None, None, None, None, None, source, target) for source, target, kind in sorted(found.edges)]

    return _mapped(files, FACT, rows, ("modules", "targets") if "modules" in files.columns else ())


def graph_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of facts; of definitions with one id the last counts."""
    names = NODE.fieldNames()
    nodes = found.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*names), F.struct("start_line", "end_line")).alias("n")).select("n.*")
    return nodes, found.where("id is null").select(*EDGE.fieldNames()).distinct()


def graph_facts(files: DataFrame, index: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges; who needs both writes ``facts`` first, so that files are parsed once."""
    return graph_of(facts(files, index))


def matches_symbol(df: DataFrame, symbol: str | None) -> DataFrame:
    """Rows of a symbol and of what it holds, and the headers of the classes around it."""
    if not symbol:
        return df
    own = (F.col("qualified_name") == symbol) | F.col("qualified_name").startswith(symbol + ".")
    parents = [".".join(symbol.split(".")[:i]) for i in range(1, symbol.count(".") + 1)]
    return df.where(own | ((F.col("kind") == "class") & F.col("qualified_name").isin(parents)) if parents else own)


def render(rows: DataFrame) -> DataFrame:
    """(path, text): headers with spans, signatures, docstrings, and an ellipsis for each function's body."""
    indent = F.repeat(F.lit("    "), F.col("depth"))
    ellipsis = F.when(F.col("kind") == "function", F.concat(F.lit("\n"), indent, F.lit("    ..."))).otherwise("")
    doc = F.when(F.col("docstring").isNotNull(), F.concat(F.lit("\n"), indent, F.lit("    "), "docstring")).otherwise("")
    header = F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n"))
    text = F.concat(header, indent, "signature", doc, ellipsis)
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def available_symbols(rows: DataFrame) -> DataFrame:
    """(path, symbols): sorted names, or ``(none)``."""
    named = F.collect_set(F.when(F.col("qualified_name") != "", F.col("qualified_name")))
    return rows.groupBy("path").agg(F.when(F.size(named) == 0, "(none)").otherwise(F.array_join(F.array_sort(named), ", ")).alias("symbols"))
