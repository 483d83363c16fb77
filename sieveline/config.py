"""Configuration: packaged defaults, overlaid by a TOML file of the repository."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from sieveline.errors import ConfigError
from sieveline.operators.ranking import DEFAULT_RULES

FILE = ".sieveline.toml"


@dataclass(frozen=True)
class EmbedderConfig:
    backend: str = "auto"
    model: str = "hashing"
    dimensions: int = 384
    matryoshka_dimensions: int | None = None
    batch_size: int = 64

    @property
    def size(self) -> int:
        return self.matryoshka_dimensions or self.dimensions


@dataclass(frozen=True)
class RootConfig:
    repo: str = "."
    alias: str | None = None
    include: tuple[str, ...] | None = None


@dataclass(frozen=True)
class IndexConfig:
    path: str = ".sieveline"
    exclude: tuple[str, ...] = ("dist/", "build/", ".next/", "out/", "tests/")
    roots: tuple[RootConfig, ...] = (RootConfig(),)


@dataclass(frozen=True)
class SearchConfig:
    metric: str = "cosine"
    hybrid: bool = True
    default_scope: str = "primary"
    rules: tuple[tuple[str, float], ...] = DEFAULT_RULES


@dataclass(frozen=True)
class WatcherConfig:
    debounce: float = 2.0


@dataclass(frozen=True)
class GraphConfig:
    include_external: bool = False


@dataclass(frozen=True)
class Config:
    embedder: EmbedderConfig = field(default_factory=EmbedderConfig)
    index: IndexConfig = field(default_factory=IndexConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
    watcher: WatcherConfig = field(default_factory=WatcherConfig)
    graph: GraphConfig = field(default_factory=GraphConfig)


def sanitize_alias(name: str) -> str:
    return re.sub("_+", "_", re.sub(r"[^A-Za-z0-9_-]+", "_", name)).strip("_") or "root"


def unique_aliases(names: list[str]) -> list[str]:
    """Later repeats become name-2, name-3 and so on; one that is itself taken is skipped."""
    out: list[str] = []
    for n in names:
        candidate, i = n, 2
        while candidate in out:
            candidate, i = f"{n}-{i}", i + 1
        out.append(candidate)
    return out


def deep_merge(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _build(kind, given, where: str):
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(given) - set(known)):
        raise ConfigError(f"unknown keys in {where}: {', '.join(unknown)}")
    out = {}
    for k, v in given.items():
        inner = {"embedder": EmbedderConfig, "index": IndexConfig, "search": SearchConfig, "watcher": WatcherConfig, "graph": GraphConfig}.get(k) if kind is Config else None
        if inner:
            v = _build(inner, v, k)
        elif k == "roots":
            v = tuple(_build(RootConfig, r, "roots") for r in v)
        elif k == "rules":
            v = tuple((p, float(f)) for p, f in v)
            for p, _ in v:
                if re.search(r"\(\?[=!<]", p):
                    raise ConfigError(f"look-around isn't supported in rules: {p}")
        elif isinstance(v, list):
            v = tuple(v)
        if isinstance(v, str):
            v = v.replace("${INDEX_DIR}", given.get("path", IndexConfig.path)) if k != "path" else v
        out[k] = v
    return kind(**out)


def load(root: Path | str, given: dict | None = None) -> Config:
    """Reads the file of ``root`` if there is one, with ``given`` on top, and checks the roots."""
    path = Path(root) / FILE
    try:
        data = tomllib.loads(path.read_text()) if path.exists() else {}
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path}: {e}") from e
    config = _build(Config, deep_merge(data, given or {}), "the configuration")
    check_roots(config.index.roots, Path(root))
    return config


def check_roots(roots: tuple[RootConfig, ...], root: Path) -> list[str]:
    """Aliases of the roots. They are unique and plain; of several roots one is the repository itself; what is included lies within."""
    named = [r.alias for r in roots if r.alias]
    for a in named:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", a):
            raise ConfigError(f"invalid alias: {a}")
    if len(set(named)) != len(named):
        raise ConfigError("aliases must be unique")
    if len(roots) > 1 and sum(r.repo == "." for r in roots) != 1:
        raise ConfigError('of several roots exactly one has repo = "."')
    for r in roots:
        base = (root / r.repo).resolve()
        for i in r.include or ():
            if not (base / i).resolve().is_relative_to(base):
                raise ConfigError(f"{i} lies outside {r.repo}")
    return unique_aliases([r.alias or sanitize_alias((root / r.repo).resolve().name) for r in roots])
