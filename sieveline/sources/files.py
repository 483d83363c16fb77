"""Files of one or several repositories: discovery, ignore patterns, version control, contents."""

from __future__ import annotations

import os
import re
import subprocess
import warnings
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.scalar import EXTENSIONS

GIT_TIMEOUT = 30


def ignore_regex(patterns: list[str]) -> str:
    """One regular expression for gitignore-style patterns over relative paths, without look-around; negations can't be part of it."""
    out = []
    for raw in patterns:
        p = raw.rstrip("\n").rstrip()
        if not p or p.startswith(("#", "!")):
            continue
        only_dir, p = p.endswith("/"), p.strip("/") if p.endswith("/") else p
        anchored = "/" in p.lstrip("/") or p.startswith("/") or raw.startswith("/")
        p, body, i = p.lstrip("/"), "", 0
        while i < len(p):
            if p.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif p.startswith("**", i):
                body, i = body + ".*", i + 2
            elif p[i] == "*":
                body, i = body + "[^/]*", i + 1
            elif p[i] == "?":
                body, i = body + "[^/]", i + 1
            elif p[i] == "[" and "]" in p[i:]:
                end = p.index("]", i + 1)
                body, i = body + "[" + p[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            else:
                body, i = body + re.escape(p[i]), i + 1
        out.append(("^" if anchored else "(?:^|.*/)") + body + ("/.*" if only_dir else "(?:/.*)?") + "$")
    return "|".join(out)


class Ignore:
    """Last match wins, as negated patterns take back what earlier ones ignore."""

    def __init__(self, patterns: list[str]):
        self.rules = [(p.startswith("!"), re.compile(ignore_regex([p[1:] if p.startswith("!") else p]))) for p in patterns if ignore_regex([p.removeprefix("!")])]

    def __call__(self, path: str) -> bool:
        out = False
        for negated, rule in self.rules:
            if rule.match(path):
                out = not negated
        return out

    def column(self, path: Column) -> Column:
        out = F.lit(False)
        for negated, rule in self.rules:
            out = F.when(path.rlike(rule.pattern), F.lit(not negated)).otherwise(out)
        return out


def load_ignore(root: Path) -> Ignore:
    try:
        return Ignore((Path(root) / ".gitignore").read_text().splitlines())
    except OSError:
        return Ignore([])


def parse_status(line: str) -> tuple[str, str] | None:
    """(state, path) of a line of ``git status --porcelain``; a rename's new path; None if the line is too short."""
    if len(line) < 4:
        return None
    return line[:2], line[3:].split(" -> ")[-1].strip('"')


def status_columns(line: Column) -> Column:
    path = F.element_at(F.split(F.substring(line, 4, 1 << 20), " -> "), -1)
    return F.when(F.length(line) >= 4, F.struct(F.substring(line, 1, 2).alias("xy"), F.regexp_replace(path, '^"|"$', "").alias("path")))


class Git:
    """What version control knows of a checkout. Paths come as they are: they are separated by zero bytes, so none is quoted."""

    def __init__(self, root: Path):
        self.root = Path(root)

    def run(self, *args: str) -> str | None:
        """What a command prints, bytes that are no UTF-8 as the system's file names have them; None if it fails."""
        try:
            done = subprocess.run(["git", "-C", str(self.root), *args], capture_output=True, timeout=GIT_TIMEOUT)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return os.fsdecode(done.stdout) if done.returncode == 0 else None

    def fields(self, *args: str) -> list[str]:
        """The parts of what a command prints that zero bytes separate."""
        return [x for x in (self.run(*args) or "").split("\0") if x]

    @property
    def head(self) -> str | None:
        return (self.run("rev-parse", "HEAD") or "").strip() or None

    @property
    def branch(self) -> str | None:
        return (self.run("rev-parse", "--abbrev-ref", "HEAD") or "").strip() or None

    def discover(self) -> list[str]:
        """Sorted relative paths with a known extension: what is tracked and what is untracked but not ignored, else what the folder holds."""
        if found := self.fields("ls-files", "-z", "--cached", "--others", "--exclude-standard", *(f"*{e}" for e in EXTENSIONS)):
            return sorted({x for x in found if (self.root / x).is_file()})
        ignored = load_ignore(self.root)
        paths = (p.relative_to(self.root) for p in self.root.rglob("*") if p.suffix.lower() in EXTENSIONS and p.is_file())
        return sorted(str(p) for p in paths if ".git" not in p.parts and not ignored(p.as_posix()))

    def changes(self, since: str | None) -> tuple[set[str], set[str]]:
        """(changed, removed) relative paths since a commit, and in the working tree. A rename removes its old path.

        A checkout may be a folder of a larger repository: what lies outside it doesn't count.
        """
        changed, removed = set(), set()
        if since:
            told = iter(self.fields("diff", "--name-status", "--relative", "-z", f"{since}...HEAD"))
            for state in told:
                path = next(told)
                if state[:1] in "RC":
                    if state[:1] == "R":
                        removed.add(path)
                    path = next(told)
                (removed if state == "D" else changed).add(path)
        within = (self.run("rev-parse", "--show-prefix") or "").rstrip("\n")
        told = iter(self.fields("status", "--porcelain", "-z", "--untracked-files=all", "--", "."))
        for entry in told:
            state, paths = entry[:2], [entry[3:]]
            if state[0] in "RC" or state[1] in "RC":  # the old path follows by itself
                old = next(told)
                if "R" in state:
                    paths.append(old)
            for n, path in enumerate(paths):
                if path.startswith(within):
                    (removed if n or "D" in state else changed).add(path[len(within) :])
        return changed - removed, removed


@dataclass(frozen=True)
class Checkout:
    """A root: where it is, its name, and which subtrees belong to it (None: all)."""

    root: Path
    alias: str
    scopes: tuple[str, ...] | None = None
    is_primary: bool = False

    def contains(self, relative: str) -> bool:
        return self.scopes is None or any(relative == s.rstrip("/") or relative.startswith(s.rstrip("/") + "/") for s in self.scopes)


class Workspace:
    """Several roots under one key: ``alias/relative path``."""

    def __init__(self, checkouts: list[Checkout], exclude: list[str] = ()):
        self.checkouts, self.patterns, self.exclude = checkouts, list(exclude), Ignore(list(exclude))

    def discover(self) -> list[tuple[str, Path]]:
        """(logical path, file), sorted. A root that fails is warned about and adds nothing."""
        out = []
        for c in self.checkouts:
            try:
                out += [(f"{c.alias}/{p}", c.root / p) for p in Git(c.root).discover() if c.contains(p) and not self.exclude(p)]
            except OSError as e:
                warnings.warn(f"{c.alias}: {e}", stacklevel=2)
        return sorted(out)

    def changes(self, since: dict[str, str]) -> tuple[set[str], set[str]]:
        changed, removed = set(), set()
        for c in self.checkouts:
            a, b = Git(c.root).changes(since.get(c.alias))
            changed |= {f"{c.alias}/{p}" for p in a if c.contains(p)}
            removed |= {f"{c.alias}/{p}" for p in b}
        return changed, removed

    def heads(self) -> list[dict]:
        return [{"alias": c.alias, "commit": Git(c.root).head or "", "branch": Git(c.root).branch or "", "is_primary": c.is_primary} for c in self.checkouts]

    def resolve(self, logical: str) -> Path:
        alias, slash, rest = logical.partition("/")
        if not slash:
            raise ValueError(f"no logical path: {logical}")
        return next((c.root / rest for c in self.checkouts if c.alias == alias), None) or _unknown(alias)

    def roots(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c.alias, str(c.root)) for c in self.checkouts], "alias string, root string")

    def indexes(self, path: Path, index_dir: Path) -> tuple[str, str] | None:
        """(logical, relative) of a changed file, or None if it isn't the index's business."""
        path = Path(path)
        if path.is_relative_to(index_dir) or ".git" in path.parts:
            return None
        for c in self.checkouts:
            if path.is_relative_to(c.root):
                rel = path.relative_to(c.root).as_posix()
                if c.contains(rel) and not load_ignore(c.root)(rel) and not self.exclude(rel):
                    return f"{c.alias}/{rel}", rel
        return None


def _unknown(alias: str):
    raise KeyError(alias)


def resolve_paths(df: DataFrame, roots: DataFrame) -> DataFrame:
    """``path`` becomes absolute where its alias is known. There is a row of ``roots`` for each checkout, so they are broadcast."""
    joined = df.join(F.broadcast(roots), F.substring_index("path", "/", 1) == F.col("alias"), "left")
    rest = F.expr("substring(path, length(alias) + 2)")
    return joined.withColumn("path", F.coalesce(F.concat("root", F.lit("/"), rest), "path")).drop("alias", "root")


def read_files(spark: SparkSession, found: list[tuple[str, Path]]) -> DataFrame:
    """(path, content) of a few files, each opened by exactly its path; bytes that are no UTF-8 are replaced, and files that can't be read are warned about."""
    from sieveline.sources.checkouts import contents, told_missing
    from sieveline.timing import logger

    rows = spark.createDataFrame([(k, bytearray(os.fsencode(p))) for k, p in found], "path string, file binary")
    read = contents(rows)
    told_missing(read, logger)
    return read.where("error is null").select("path", "content")
