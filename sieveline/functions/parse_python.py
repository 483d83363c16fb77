"""Python sources: chunks, outlines and graph facts from the standard library's parser.

Where a text doesn't parse, definitions are found by their indentation, so that one error doesn't hide a file.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator
from dataclasses import dataclass, field

DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
FUNCS = (ast.FunctionDef, ast.AsyncFunctionDef)
_BLOCK = re.compile(r"^([ \t]*)(?:async\s+)?(def|class)\s+(\w+)")


@dataclass(frozen=True)
class Unit:
    """A definition: its span with decorators, and the line of its own header."""

    kind: str
    name: str
    qualified: str
    start: int
    end: int
    header: int
    depth: int
    parent_is_unit: bool
    node: ast.AST | None = None


def parse(content: str) -> ast.Module | None:
    try:
        return ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return None


def units(content: str) -> list[Unit]:
    """All definitions in order of appearance."""
    tree = parse(content)
    if tree is None:
        return list(_by_indentation(content))
    out: list[Unit] = []
    stack: list[tuple[ast.AST, str, int]] = [(tree, "", 0)]
    while stack:
        node, prefix, depth = stack.pop()
        if isinstance(node, DEFS):
            name = f"{prefix}{node.name}"
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            out.append(Unit("class" if isinstance(node, ast.ClassDef) else "function", node.name, name, start, node.end_lineno, node.lineno, depth, False, node))
            prefix, depth = name + ".", depth + 1
        stack += [(c, prefix, depth) for c in reversed(list(ast.iter_child_nodes(node)))]
    return out


def _by_indentation(content: str) -> Iterator[Unit]:
    lines = content.split("\n")
    open_: list[tuple[int, str]] = []
    for i, line in enumerate(lines):
        m = _BLOCK.match(line)
        if not m:
            continue
        indent = len(m[1].expandtabs())
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        end = i + 1
        for j in range(i + 1, len(lines)):
            if lines[j].strip():
                if len(lines[j]) - len(lines[j].lstrip()) <= indent:
                    break
                end = j + 1
        name = ".".join([*(n for _, n in open_), m[3]])
        yield Unit("class" if m[2] == "class" else "function", m[3], name, i + 1, end, i + 1, len(open_), False)
        open_.append((indent, m[3]))


def _text(lines: list[str], unit: Unit) -> str:
    part = lines[unit.start - 1 : unit.end]
    if unit.node is not None:
        end = unit.node.end_col_offset
        part = [*part[:-1], part[-1].encode()[:end].decode("utf-8", "replace")]
    return "\n".join(part).lstrip(" \t")


def chunks(path: str, content: str) -> list[tuple[str, int, int, str, str]]:
    """(path, start_line, end_line, symbol, content): what stands at module level, then every definition."""
    lines = content.split("\n")
    found = units(content)
    out = []
    if top := _module_text(content, lines, found):
        out.append((path, 1, len(lines), "<module>", top))
    return out + [(path, u.start, u.end, u.name, _text(lines, u)) for u in found]


def _module_text(content: str, lines: list[str], found: list[Unit]) -> str:
    tree = parse(content)
    if tree is None:
        inside = {i for u in found for i in range(u.start, u.end + 1)}
        return "\n".join(x.strip() for i, x in enumerate(lines, 1) if i not in inside and x.strip())
    parts = [(n.lineno, n.end_lineno, (ast.get_source_segment(content, n) or "").strip()) for n in tree.body if not isinstance(n, DEFS)]
    spans = [(a, b) for a, b, _ in parts] + [(u.start, u.end) for u in found]
    try:
        for t in tokenize.generate_tokens(io.StringIO(content).readline):
            if t.type == tokenize.COMMENT and not any(a <= t.start[0] <= b and (t.start[0] < b or t.start[1] > 0) for a, b in spans):
                parts.append((t.start[0], t.start[0], t.string.strip()))
    except (tokenize.TokenError, IndentationError):
        pass
    return "\n".join(t for _, _, t in sorted(parts) if t)


# ---- outline ----
@dataclass(frozen=True)
class Row:
    ord: int
    depth: int
    kind: str
    qualified: str
    start: int
    end: int
    signature: str
    docstring: str | None


def outline(content: str, include_imports: bool = False) -> list[Row]:
    """Signatures and docstrings with spans, no bodies."""
    lines = content.split("\n")
    tree = parse(content)
    rows: list[tuple] = []
    if tree is None:
        return [Row(i, u.depth, u.kind, u.qualified, u.start, u.end, lines[u.header - 1].strip(), None) for i, u in enumerate(_by_indentation(content))]
    stack: list[tuple[ast.AST, str, int, bool]] = [(n, "", 0, True) for n in reversed(tree.body)]
    while stack:
        node, prefix, depth, top = stack.pop()
        if isinstance(node, DEFS):
            name = f"{prefix}{node.name}"
            decorators = ["@" + (ast.get_source_segment(content, d) or "") for d in node.decorator_list]
            rows.append((depth, "class" if isinstance(node, ast.ClassDef) else "function", name, node.lineno, node.end_lineno, "\n".join([*decorators, _signature(lines, node)]), _docstring(content, node)))
            stack += [(c, name + ".", depth + 1, False) for c in reversed(list(_inner(node)))]
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            if top and include_imports:
                rows.append((depth, "import", "", node.lineno, node.end_lineno, ast.get_source_segment(content, node) or "", None))
        elif top and isinstance(node, (ast.Expr, ast.Assign, ast.AnnAssign, ast.AugAssign)):
            text = ast.get_source_segment(content, node) or ""
            if text[:1] in "\"'" or "=" in text:
                rows.append((depth, "expression", "", node.lineno, node.end_lineno, text, None))
        else:
            stack += [(c, prefix, depth, False) for c in reversed(list(ast.iter_child_nodes(node))) if isinstance(c, (ast.stmt, ast.ExceptHandler))]
    return [Row(i, *r) for i, r in enumerate(rows)]


def _inner(node: ast.AST) -> Iterator[ast.AST]:
    yield from node.body


def _signature(lines: list[str], node: ast.AST) -> str:
    """From ``def`` or ``class`` to the colon before the body."""
    first = node.body[0]
    start = min([first.lineno, *(d.lineno for d in getattr(first, "decorator_list", []))])
    if start == node.lineno:  # the body stands in the header's line
        return lines[node.lineno - 1].encode()[node.col_offset : first.col_offset].decode().rstrip()
    part = lines[node.lineno - 1 : start - 1]
    text = "\n".join([part[0].encode()[node.col_offset :].decode(), *part[1:]])
    cut = max(text.rfind(":\n"), text.rfind(":") if text.rstrip().endswith(":") else -1)
    return text[: cut + 1] if cut >= 0 else text.rstrip()


def _docstring(content: str, node: ast.AST) -> str | None:
    """The first statement of the body that is a string, wherever it stands."""
    for s in node.body:
        if isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str):
            return ast.get_source_segment(content, s)
    return None


# ---- graph facts ----
@dataclass
class Facts:
    nodes: list[tuple[str, str, str, int, int, str, str]] = field(default_factory=list)  # as the nodes relation
    edges: set[tuple[str, str, str]] = field(default_factory=set)  # source, target, kind


def resolve_relative(path: str, module: str | None, level: int) -> str | None:
    """The slashed module that ``from`` dots name; None if they climb out of the root."""
    here = path.split("/")[:-1]
    if level - 1 > len(here):
        return None
    base = here[: len(here) - (level - 1)]
    return "/".join([*base, *(module.split(".") if module else [])])


class _Binder:
    """What a file's names mean: one flat table, the last binding wins."""

    def __init__(self, path: str, index: dict[str, str]):
        self.path, self.index = path, index
        self.symbols: dict[str, str] = {}  # name to target
        self.modules: dict[str, str] = {}  # alias to file, or to a dotted module that no file has
        self.instances: dict[str, list[str]] = {}  # name to class targets
        self.attributes: dict[tuple[str, str], list[str]] = {}  # class and attribute to class targets
        self.returns: dict[str, str] = {}  # function to the text of its return annotation

    def module_file(self, name: str) -> str | None:
        return self.index.get(name) or self.index.get(name.replace(".", "/"))

    def target(self, name: str) -> str:
        if name in self.symbols:
            return self.symbols[name]
        head, _, tail = name.partition(".")
        if tail and head in self.modules:
            return f"{self.modules[head]}::{tail}" if "/" in self.modules[head] or self.modules[head] in self.index.values() else name
        return name

    def types(self, annotation: ast.AST | None) -> list[str]:
        """Classes that an annotation names: strings are read, unions split, None and lower-case names skipped."""
        if annotation is None:
            return []
        if isinstance(annotation, ast.Constant) and isinstance(annotation.value, str):
            inner = parse(annotation.value)
            return self.types(inner.body[0].value) if inner and inner.body and isinstance(inner.body[0], ast.Expr) else []
        if isinstance(annotation, ast.BinOp) and isinstance(annotation.op, ast.BitOr):
            return self.types(annotation.left) + self.types(annotation.right)
        if isinstance(annotation, ast.Subscript) and dotted(annotation.value) in ("Optional", "Union", "typing.Optional", "typing.Union"):
            parts = annotation.slice.elts if isinstance(annotation.slice, ast.Tuple) else [annotation.slice]
            return [t for p in parts for t in self.types(p)]
        name = dotted(annotation)
        return [self.target(name)] if name and name.rsplit(".", 1)[-1][:1].isupper() and name != "None" else []


def dotted(node: ast.AST | None) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Call):
        inner = dotted(node.func)
        parts.append(f"{inner}()" if inner else "()")
    elif isinstance(node, ast.Name):
        parts.append(node.id)
    elif isinstance(node, ast.Subscript):
        return dotted(node.value) if not parts else None
    else:
        return None
    return ".".join(reversed(parts))


def facts(path: str, content: str, index: dict[str, str] | None = None) -> Facts:
    """Nodes and edges of a file. ``index`` maps module names, dotted or slashed, to files."""
    out = Facts()
    lines = content.count("\n") + 1
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    out.nodes.append((path, "module", path, 1, lines, stem, stem))
    tree = parse(content)
    if tree is None:
        for u in _by_indentation(content):
            out.nodes.append((f"{path}::{u.qualified}", u.kind, path, u.header, u.end, u.name, u.qualified))
            _defines(out, path, u.qualified)
        return out
    b = _Binder(path, index or {})
    scoped = list(_walk(tree))
    for node, scope in scoped:
        _bind(b, node, scope, out)
    for node, scope in scoped:  # types that need names bound further down
        _bind_types(b, node, scope)
    for node, scope in scoped:
        _emit(b, node, scope, out)
    out.edges = {e for e in out.edges if e[0] != e[1] or e[2] == "calls"}
    return out


def _walk(tree: ast.AST) -> Iterator[tuple[ast.AST, tuple[tuple[str, str], ...]]]:
    """Nodes in order with their enclosing definitions, (kind, name) each."""
    stack: list[tuple[ast.AST, tuple]] = [(tree, ())]
    while stack:
        node, scope = stack.pop()
        yield node, scope
        inner = (*scope, ("class" if isinstance(node, ast.ClassDef) else "function", node.name)) if isinstance(node, DEFS) else scope
        for c in reversed(list(ast.iter_child_nodes(node))):
            stack.append((c, scope if isinstance(node, DEFS) and c in node.decorator_list else inner))


def _qualified(scope) -> str:
    return ".".join(n for _, n in scope)


def _owner(scope) -> str | None:
    """The innermost class around."""
    at = max((i for i, (k, _) in enumerate(scope) if k == "class"), default=None)
    return None if at is None else _qualified(scope[: at + 1])


def _defines(out: Facts, path: str, qualified: str) -> None:
    parent = qualified.rpartition(".")[0]
    out.edges.add((f"{path}::{parent}" if parent else path, f"{path}::{qualified}", "defines"))


def _bind(b: _Binder, node: ast.AST, scope, out: Facts) -> None:
    if isinstance(node, ast.Import):
        for n in node.names:
            file = b.module_file(n.name)
            out.edges.add((b.path, file or n.name, "imports"))
            b.modules[n.asname or n.name.split(".")[0]] = (file or n.name) if n.asname or "." not in n.name else (b.module_file(n.name.split(".")[0]) or n.name.split(".")[0])
            if "." in n.name and not n.asname and file:
                b.modules[n.name] = file
    elif isinstance(node, ast.ImportFrom):
        if node.module == "__future__":
            return
        module = resolve_relative(b.path, node.module, node.level) if node.level else node.module
        if module is None:
            return
        file = b.module_file(module)
        for n in node.names:
            if n.name == "*":
                out.edges.add((b.path, file or module, "imports"))
                continue
            sub = b.module_file(f"{module}/{n.name}" if node.level else f"{module}.{n.name}")
            out.edges.add((b.path, sub or file or module, "imports"))
            if sub:
                b.modules[n.asname or n.name] = sub
            else:
                b.symbols[n.asname or n.name] = f"{file}::{n.name}" if file else f"{module}::{n.name}"
    elif isinstance(node, DEFS):
        qualified = ".".join([*(n for _, n in scope), node.name])
        kind = "class" if isinstance(node, ast.ClassDef) else "function"
        out.nodes.append((f"{b.path}::{qualified}", kind, b.path, node.lineno, node.end_lineno, node.name, qualified))
        _defines(out, b.path, qualified)
        if not scope or kind == "class" or scope[-1][0] == "function":
            b.symbols[node.name] = f"{b.path}::{qualified}"
        if kind == "function" and node.returns is not None:
            b.returns[qualified] = node.returns


def _bind_types(b: _Binder, node: ast.AST, scope) -> None:
    owner = _owner(scope)
    if isinstance(node, FUNCS):
        for arg in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            if found := b.types(arg.annotation):
                b.instances[arg.arg] = found
        if scope and scope[-1][0] == "class" and any(dotted(d) in ("property", "cached_property", "functools.cached_property") for d in node.decorator_list):
            if found := b.types(node.returns):
                b.attributes[_qualified(scope), node.name] = found
    elif isinstance(node, (ast.With, ast.AsyncWith)):
        for item in node.items:
            if isinstance(item.optional_vars, ast.Name) and (found := _value_types(b, item.context_expr)):
                entered = [t for f in found for t in b.types(b.returns.get(f"{f.split('::')[-1]}.__enter__"))]
                b.instances[item.optional_vars.id] = entered or found
    elif isinstance(node, ast.AnnAssign):
        found = b.types(node.annotation)
        _assign(b, node.target, found, owner)
    elif isinstance(node, ast.Assign):
        for target in node.targets:
            if isinstance(target, ast.Tuple) and isinstance(node.value, ast.Call):
                returned = b.returns.get(b.target(dotted(node.value.func) or "").split("::")[-1])
                if isinstance(returned, ast.Subscript) and isinstance(returned.slice, ast.Tuple):
                    for t, kind in zip(target.elts, returned.slice.elts):
                        _assign(b, t, b.types(kind), owner)
                continue
            _assign(b, target, _value_types(b, node.value), owner)
            if isinstance(target, ast.Name):
                name = dotted(node.value)
                if isinstance(node.value, ast.Call) and dotted(node.value.func) in ("partial", "functools.partial") and node.value.args:
                    name = dotted(node.value.args[0])
                if name and not name.endswith(")") and (name in b.symbols or name.split(".")[0] in b.modules):
                    b.symbols[target.id] = b.target(name)
                elif name and "." in name and "()" not in name and (found := _chain_types(b, name, owner)):
                    b.instances[target.id] = found


def _assign(b: _Binder, target: ast.AST, found: list[str], owner: str | None) -> None:
    if not found:
        return
    if isinstance(target, ast.Name):
        b.instances[target.id] = found
    elif isinstance(target, ast.Attribute) and dotted(target.value) == "self" and owner:
        b.attributes[owner, target.attr] = found


def _value_types(b: _Binder, value: ast.AST) -> list[str]:
    if isinstance(value, ast.Name):
        return b.instances.get(value.id, [])
    if isinstance(value, ast.Call) and (name := dotted(value.func)):
        target = b.target(name)
        if (returned := b.returns.get(target.split("::")[-1])) is not None:
            return b.types(returned)
        if name.rsplit(".", 1)[-1][:1].isupper():
            return [target]
    return []


def _chain_types(b: _Binder, name: str, owner: str | None) -> list[str]:
    """Types along ``a.b.c``: the first name's, then what their attributes hold."""
    head, *rest = name.split(".")
    now = [f"{b.path}::{owner}"] if head == "self" and owner else b.instances.get(head, [])
    for attr in rest:
        now = [t for c in now for t in b.attributes.get((c.split("::")[-1], attr), [])]
    return now


def callees(b: _Binder, raw: str, owner: str | None, bases: dict[str, list[str]]) -> list[str]:
    """Targets of a call: super, then self, then a plain name, then a chain."""
    head, _, rest = raw.partition(".")
    if head == "super()" and rest:
        return [f"{p}.{rest}" for p in bases.get(owner or "", [])] or [rest]
    if head in ("self", "cls") and rest and owner:
        if "." not in rest:
            return [f"{b.path}::{owner}.{rest}"]
    if not rest:
        if head in b.instances:
            return [f"{t}.__call__" for t in b.instances[head]]
        return [b.target(head)]
    if raw in b.symbols:
        return [b.symbols[raw]]
    chain, _, method = raw.rpartition(".")
    if found := _chain_types(b, chain, owner):
        return [f"{t}.{method}" for t in found]
    if chain in b.modules or head in b.modules:
        longest = chain if chain in b.modules else head
        file, tail = b.modules[longest], raw[len(longest) + 1 :]
        return [f"{file}::{tail}" if file in b.index.values() else f"{file}.{tail}"]
    if chain in b.symbols:
        return [f"{b.symbols[chain]}.{method}"]
    return [method]


def _emit(b: _Binder, node: ast.AST, scope, out: Facts) -> None:
    owner = _owner(scope)
    source = f"{b.path}::{_qualified(scope)}" if scope else b.path
    bases = b.__dict__.setdefault("bases", {})
    if isinstance(node, ast.ClassDef):
        qualified = ".".join([*(n for _, n in scope), node.name])
        bases[qualified] = [b.target(n) for x in node.bases if (n := dotted(x))]
        for t in bases[qualified]:
            out.edges.add((f"{b.path}::{qualified}", t, "inherits"))
    if isinstance(node, DEFS):
        own = f"{b.path}::{'.'.join([*(n for _, n in scope), node.name])}"
        for d in node.decorator_list:
            if name := dotted(d.func if isinstance(d, ast.Call) else d):
                out.edges.update((own, t, "calls") for t in callees(b, name, owner, bases))
    elif isinstance(node, ast.Call) and (name := dotted(node.func)) and name != "super":
        out.edges.update((source, t, "calls") for t in callees(b, name, owner, bases))
