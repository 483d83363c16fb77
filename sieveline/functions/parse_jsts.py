"""JavaScript and TypeScript sources: a scanner for strings, comments, templates, regular expressions and braces, and an outline on top of it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from sieveline.functions.parse_python import Facts, Row

_WORD = r"[A-Za-z_$][\w$]*"
_HEAD = re.compile(
    rf"^(?P<export>export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?:"
    rf"(?P<function>(?:async\s+)?function\s*\*?\s*(?P<fname>{_WORD})?)|(?P<class>class\s+(?P<cname>{_WORD}))|(?P<interface>interface\s+(?P<iname>{_WORD}))|(?P<type>type\s+(?P<tname>{_WORD})[^=;\n]*=)|(?P<lexical>(?:const|let)\s+(?P<lname>{_WORD})))"
)
_METHOD = re.compile(rf"^(?:(?:public|private|protected|static|async|readonly|override|get|set|abstract)\s+)*\*?\s*(?P<name>#?{_WORD})\s*(?:<[^>{{}}]*>)?\(")
_ARROW = re.compile(rf"^(?:const|let|var)\s+(?P<name>{_WORD})[^=]*=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{_WORD})\s*(?::[^={{]+)?=>")
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "constructor_", "do", "else", "new", "typeof", "await", "super"}
_IMPORT = re.compile(r"""import\s+(?:type\s+)?(?P<what>[^'";]*?)\s*(?:from\s*)?['"](?P<spec>[^'"]+)['"]""")
_CALL = re.compile(rf"(?<![\w$.])(?P<new>new\s+)?(?P<name>(?:this|super|{_WORD})(?:\s*\??\.\s*{_WORD})*)\s*\(")
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "import", "new", "do", "else", "throw", "delete", "void", "in", "of", "async", "yield"}


def masked(text: str) -> str:
    """The text with the insides of strings, templates, comments and regular expressions blanked; code in ``${}`` stays."""
    out, i, n = list(text), 0, len(text)
    stack: list[int] = []  # brace depth of each open template expression
    depth = 0
    before = ""

    def blank(a: int, b: int) -> None:
        for k in range(a, b):
            if out[k] != "\n":
                out[k] = " "

    def template(start: int) -> int:
        """From after a backtick, or after the brace that ends an expression; returns where code goes on."""
        k = start
        while k < n:
            if text[k] == "\\":
                k += 2
                continue
            if text[k] == "`":
                blank(start, k)
                return k + 1
            if text.startswith("${", k):
                blank(start, k + 2)
                stack.append(depth)
                return k + 2
            k += 1
        blank(start, n)
        return n

    while i < n:
        c = text[i]
        if text.startswith("//", i):
            end = text.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
            i = end
            continue
        if text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            blank(i, end)
            i = end
            continue
        if c in "'\"":
            k = i + 1
            while k < n and text[k] != c and text[k] != "\n":
                k += 2 if text[k] == "\\" else 1
            blank(i + 1, min(k, n))
            i, before = k + 1, "x"
            continue
        if c == "`":
            i, before = template(i + 1), "x"
            continue
        if c == "/" and (before in "" or before in "(,=:[!&|?{};+-*%<>~^"):
            k, inside = i + 1, False
            while k < n and text[k] != "\n" and (text[k] != "/" or inside):
                inside = (inside or text[k] == "[") and text[k] != "]"
                k += 2 if text[k] == "\\" else 1
            blank(i, min(k + 1, n))
            i, before = k + 1, "x"
            continue
        if c == "{":
            depth += 1
        elif c == "}":
            if stack and stack[-1] == depth:
                stack.pop()
                out[i] = " "
                i, before = template(i + 1), "x"
                continue
            depth -= 1
        if not c.isspace():
            before = c
        i += 1
    return "".join(out)


@dataclass(frozen=True)
class Unit:
    kind: str  # the node type's role: function, class, method, interface, type, lexical, arrow, export
    name: str
    qualified: str
    start: int  # offsets
    end: int
    depth: int
    exported: bool


def _close(code: str, at: int) -> int:
    """Where the statement that starts at ``at`` ends: its braces are closed, and a semicolon or line break follows."""
    depth, seen = 0, False
    for k in range(at, len(code)):
        c = code[k]
        if c in "{([":
            depth += 1
            seen = seen or c == "{"
        elif c in "})]":
            depth -= 1
            if depth < 0:
                return k
            if depth == 0 and c == "}" and seen:
                rest = code[k + 1 : k + 2]
                if rest not in (",", ".", "(", ")", " ") or "\n" in code[k + 1 : k + 3] or not code[k + 1 :].split("\n", 1)[0].strip(" ;"):
                    return k + 1 + (1 if rest == ";" else 0)
        elif depth == 0 and c == ";":
            return k + 1
        elif depth == 0 and c == "\n" and code[at:k].rstrip()[-1:] not in ("", "=", ",", "(", "{", "+", "|", "&", ">", ":") and code[k + 1 :].lstrip()[:1] not in ("|", "&", ".", "{", "=", "+", "?", ":"):
            return k
    return len(code)


def units(text: str) -> list[Unit]:
    """Definitions in order of appearance: top-level ones, members of classes, and functions inside functions."""
    code = masked(text)
    out: list[Unit] = []

    def block(start: int, end: int, prefix: str, depth: int, in_class: bool) -> None:
        i = start
        while i < end:
            m = re.compile(r"[^\s;,}]").search(code, i, end)
            if not m:
                return
            i = m.start()
            rest = code[i:end]
            if code[i] == "@":
                i += len(re.match(r"@[\w$.]+", rest)[0]) if re.match(r"@[\w$.]+", rest) else 1
                if code[i : i + 1] == "(":
                    i = _paren(code, i)
                continue
            head = _HEAD.match(rest)
            if head and not (in_class and not head["export"]):
                stop = min(_close(code, i), end)
                kind = next(k for k in ("function", "class", "interface", "type", "lexical") if head[k])
                name = head["fname"] or head["cname"] or head["iname"] or head["tname"] or head["lname"] or "default"
                arrow = kind == "lexical" and _ARROW.match(rest[len(head["export"] or "") :])
                qualified = f"{prefix}{name}"
                out.append(Unit("arrow" if arrow else kind, name, qualified, i, stop, depth, bool(head["export"])))
                body = code.find("{", i + head.end(), stop)
                if body >= 0 and (kind in ("function", "class") or arrow):
                    block(body + 1, stop - 1, qualified + ".", depth + 1, kind == "class")
                i = max(stop, i + 1)
                continue
            method = _METHOD.match(rest) if in_class else None
            if method and method["name"] not in _NOT_METHODS:
                after = _paren(code, i + method.end() - 1)
                body = re.match(r"[^{};]*\{", code[after:end])
                if body:
                    stop = _brace(code, after + body.end() - 1)
                    out.append(Unit("method", method["name"], f"{prefix}{method['name']}", i, stop, depth, False))
                    block(after + body.end(), stop - 1, f"{prefix}{method['name']}.", depth + 1, False)
                    i = stop
                    continue
            i = max(min(_close(code, i), end), i + 1)

    block(0, len(code), "", 0, False)
    return out


def _paren(code: str, at: int) -> int:
    depth = 0
    for k in range(at, len(code)):
        depth += (code[k] == "(") - (code[k] == ")")
        if depth == 0:
            return k + 1
    return len(code)


def _brace(code: str, at: int) -> int:
    depth = 0
    for k in range(at, len(code)):
        depth += (code[k] == "{") - (code[k] == "}")
        if depth == 0:
            return k + 1
    return len(code)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def chunks(path: str, text: str) -> list[tuple[str, int, int, str, str]]:
    """Module level first, then definitions; an exported declaration is one chunk, named after what it exports."""
    found = units(text)
    out, last, rest = [], 0, []
    for u in (u for u in found if u.depth == 0):
        rest.append(text[last : u.start])
        last = max(last, u.end)
    top = "\n".join(x.strip() for part in [*rest, text[last:]] for x in part.split("\n") if x.strip() and x.strip() != ";")
    if top:
        out.append((path, 1, text.count("\n") + 1, "<module>", top))
    return out + [(path, _line(text, u.start), _line(text, max(u.start, u.end - 1)), u.name, text[u.start : u.end]) for u in found]


def outline(text: str, include_imports: bool = False) -> list[Row]:
    """Signatures with spans; the signature ends at the body's brace."""
    code, rows = masked(text), []
    if include_imports:
        rows += [(m.start(), (0, "import", "", _line(text, m.start()), _line(text, m.end()), m[0], None)) for m in _IMPORT.finditer(text) if code.startswith("import", m.start())]
    for u in units(text):
        kind = {"method": "function", "arrow": "function", "lexical": "expression"}.get(u.kind, u.kind)
        body = code.find("{", u.start, u.end)
        after_arrow = code.find("=>", u.start, u.end)
        if u.kind == "arrow" and after_arrow >= 0:
            body = after_arrow + 2
        signature = text[u.start : body].rstrip() if body >= 0 and u.kind not in ("type", "interface", "lexical") else text[u.start : u.end].rstrip()
        comment = re.search(r"/\*\*((?:(?!\*/)[\s\S])*)\*/\s*$", text[: u.start])
        rows.append((u.start, (u.depth, kind, u.qualified, _line(text, u.start), _line(text, max(u.start, u.end - 1)), signature, comment[0].strip() if comment else None)))
    return [Row(i, *r) for i, (_, r) in enumerate(sorted(rows, key=lambda x: x[0]))]


def resolve_spec(path: str, spec: str) -> str | None:
    if not spec.startswith("."):
        return spec.replace("/", ".") if not spec.startswith("@") else spec
    here = path.split("/")[:-1]
    for part in spec.split("/"):
        if part == "..":
            if not here:
                return None
            here.pop()
        elif part != ".":
            here.append(part)
    return re.sub(r"\.(tsx?|jsx?|mjs|cjs)$", "", "/".join(here))


def facts(path: str, text: str, index: dict[str, str] | None = None) -> Facts:
    """Nodes and edges: imports (named, default, namespace), definitions, extends, and calls."""
    index, out, code = index or {}, Facts(), masked(text)
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    out.nodes.append((path, "module", path, 1, text.count("\n") + 1, stem, stem))
    names: dict[str, str] = {}
    spaces: dict[str, str] = {}
    for m in _IMPORT.finditer(text):
        if not code.startswith("import", m.start()):
            continue
        module = resolve_spec(path, m["spec"])
        if module is None:
            continue
        file = index.get(module) or index.get(module.replace("/", "."))
        out.edges.add((path, file or module, "imports"))
        base = file or module
        what = m["what"].strip()
        if ns := re.search(rf"\*\s+as\s+({_WORD})", what):
            spaces[ns[1]] = base
        if inner := re.search(r"\{([^}]*)\}", what):
            for part in inner[1].split(","):
                words = part.replace("type ", "").split()
                if words:
                    names[words[-1]] = f"{base}::{words[0]}"
        if default := re.match(rf"({_WORD})\s*(?:,|$)", what):
            names[default[1]] = f"{base}::{default[1]}"
    kept = [u for u in units(text) if u.kind in ("function", "class", "interface", "type", "arrow", "method")]
    for u in kept:
        kind = "class" if u.kind in ("class", "interface", "type") else "function"
        out.nodes.append((f"{path}::{u.qualified}", kind, path, _line(text, u.start), _line(text, max(u.start, u.end - 1)), u.name, u.qualified))
        parent = u.qualified.rpartition(".")[0]
        out.edges.add((f"{path}::{parent}" if parent else path, f"{path}::{u.qualified}", "defines"))
        if u.depth == 0:
            names[u.name] = f"{path}::{u.qualified}"
    bases: dict[str, str] = {}
    for u in kept:
        if kept and u.kind in ("class", "interface") and (m := re.match(rf"[^{{]*?\bextends\s+({_WORD}(?:\.{_WORD})*)", code[u.start : u.end])):
            bases[u.qualified] = names.get(m[1], m[1])
            out.edges.add((f"{path}::{u.qualified}", bases[u.qualified], "inherits"))
    for m in _CALL.finditer(code):
        name = re.sub(r"\s|\?", "", m["name"])
        around = [u for u in kept if u.start <= m.start() < u.end and u.kind in ("function", "arrow", "method")]
        head, _, rest = name.partition(".")
        if m["new"] or head in _KEYWORDS or any(u.kind in ("method", "function") and code[u.start : m.start()].strip() in ("", "async", "export", "static", "export default", "async function", "function", "export function", "export async function", "export default function") for u in around):
            continue
        source = f"{path}::{max(around, key=lambda u: u.start).qualified}" if around else path
        owner = next((u.qualified for u in reversed(kept) if u.kind == "class" and u.start <= m.start() < u.end), None)
        if head == "super":
            target = f"{bases.get(owner or '', 'super')}.{rest or 'constructor'}"
        elif head == "this" and owner and rest and "." not in rest:
            target = f"{path}::{owner}.{rest}"
        elif not rest:
            target = names.get(head, head)
        elif head in spaces:
            target = f"{spaces[head]}::{rest}"
        elif head in names and names[head].count("::"):
            target = f"{names[head]}.{rest}"
        else:
            target = name.rsplit(".", 1)[-1]
        out.edges.add((source, target, "calls"))
    return out
