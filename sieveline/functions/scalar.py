"""Scalar functions as column expressions; all stay within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by language: fixed values.
EXTENSIONS = {".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript"}
INIT_STEMS = ("__init__", "index")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def search_text(path: Column, symbol: Column, content: Column) -> Column:
    """What is embedded and indexed of a chunk."""
    return F.concat(path, F.lit("\n"), symbol, F.lit("\n"), content)


def node_id(file: Column, qualified: Column) -> Column:
    return F.when(qualified.isNull() | (qualified == ""), file).otherwise(F.concat(file, F.lit("::"), qualified))


def file_of(node: Column) -> Column:
    return F.substring_index(node, "::", 1)


def qualified_of(node: Column) -> Column:
    """What stands after the first ``::``; null if either side is empty."""
    at = F.instr(node, "::")
    rest = F.substring(node, at + 2, F.length(node))
    return F.when((at > 1) & (rest != ""), rest)


def last_component(name: Column) -> Column:
    return F.substring_index(F.substring_index(name, "::", -1), ".", -1)


def target_kind(target: Column, edge_kind: Column, known: Column) -> Column:
    """resolved_node if the target is a known node or is qualified by a file, module_ref for other imports, else phantom."""
    return F.when(known | F.contains(target, F.lit("::")), "resolved_node").when(edge_kind == "imports", "module_ref").otherwise("phantom")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    ext, out = extension(path), None
    for lang in dict.fromkeys(EXTENSIONS.values()):
        hit = ext.isin([e for e, v in EXTENSIONS.items() if v == lang])
        out = F.when(hit, lang) if out is None else out.when(hit, lang)
    return out


def is_init_file(path: Column) -> Column:
    return F.substring_index(path, "/", -1).rlike(r"^(__init__\.pyi?|index\.(js|jsx|mjs|cjs|ts|tsx))$")


def module_parts(path: Column) -> Column:
    """Segments of a module's path: the longest known extension and a trailing init stem are dropped."""
    ext = "|".join(sorted((e.replace(".", r"\.") for e in EXTENSIONS), key=len, reverse=True))
    parts = F.split(F.regexp_replace(path, f"({ext})$", ""), "/")
    last = F.element_at(parts, -1)
    return F.when(last.isin(*INIT_STEMS) & (F.size(parts) > 1), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def module_names(path: Column) -> Column:
    """Every suffix of the module's path, dotted, and with slashes where that differs."""
    parts = module_parts(path)
    starts = F.sequence(F.lit(1), F.size(parts))
    return F.flatten(
        F.transform(
            starts,
            lambda i: F.when(i == F.size(parts), F.array(F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(
                F.array(F.array_join(F.slice(parts, i, F.size(parts)), "."), F.array_join(F.slice(parts, i, F.size(parts)), "/"))
            ),
        )
    )


def relative_import(path: Column, spec: Column) -> Column:
    """The path that a relative import names: ``./`` and ``../``, or leading dots. Null if it climbs out, or isn't relative.

    One dot stays in the importing file's directory, each further dot or ``../`` climbs one level.
    """
    here = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    slashed = spec.rlike(r"^\.\.?/")
    ups = F.length(F.regexp_replace(F.regexp_extract(spec, r"^((?:\.\./)*)", 1), "/", "")) / 2
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    up = F.when(slashed, ups).otherwise(dots - 1).cast("int")
    tail = F.when(slashed, F.regexp_replace(F.regexp_replace(spec, r"^(\.\./)+", ""), r"^\./", "")).otherwise(F.translate(F.regexp_replace(spec, r"^\.+", ""), ".", "/"))
    base = F.when(up <= F.size(here), F.slice(here, 1, F.greatest(F.size(here) - up, F.lit(0))))
    joined = F.array_join(F.concat(base, F.when(tail == "", F.array().cast("array<string>")).otherwise(F.array(tail))), "/")
    return F.when(slashed | spec.startswith("."), joined)


def sanitize_alias(name: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_-]+", "_"), "_+", "_")
    clean = F.regexp_replace(clean, "^_+|_+$", "")
    return F.when(clean == "", "root").otherwise(clean)


def path_range(arg: Column) -> Column:
    """struct(path, lo, hi, error) of ``path:START-END``; without a range lo and hi are null."""
    pattern = r"^(.*):(\d+)-(\d+)$"
    found = arg.rlike(pattern)
    base = F.when(found, F.regexp_extract(arg, pattern, 1)).otherwise(arg)
    lo, hi = (F.when(found, F.regexp_extract(arg, pattern, g).cast("int")) for g in (2, 3))
    error = F.coalesce((hi < lo) | (lo < 1), F.lit(False)) | (base == "")
    return F.struct(base.alias("path"), lo.alias("lo"), hi.alias("hi"), error.alias("error"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null where a side is a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric in ("l2", "euclidean"):
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    if metric == "dot":
        return 1 - dot(a, b)
    raise ValueError(f"unknown metric: {metric}")


def matryoshka(vector: Column, dims: int) -> Column:
    """The first components, not normalised again."""
    return F.slice(vector, 1, dims)


def needs_prefix(model: str) -> bool:
    name = model.lower().replace("-", "_")
    return any(x in name for x in ("nomic_embed", "nomicai_modernbert", "nomic_ai"))


def with_prefix(text: Column, task: str, model: str) -> Column:
    if not needs_prefix(model):
        return text
    return F.concat(F.lit("search_query: " if task == "query" else "search_document: "), text)


def preview(content: Column, chars: int = 200) -> Column:
    """The first characters with line breaks as spaces, and an ellipsis if there are more."""
    flat = F.translate(content, "\n", " ")
    return F.when(F.length(flat) > chars, F.concat(F.substring(flat, 1, chars), F.lit("..."))).otherwise(flat)
