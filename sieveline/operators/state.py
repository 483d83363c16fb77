"""The index's state: a record on the driver, and the same transitions as a query over a log."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IN_PROGRESS, DONE, ERRORED, INCOMPLETE = "in_progress", "done", "errored", "incomplete"
SCHEMA_VERSION = 1


@dataclass(frozen=True)
class Run:
    paths_to_process: tuple[str, ...] = ()
    processed_count: int = 0
    error: str | None = None


@dataclass(frozen=True)
class Source:
    alias: str
    commit: str
    branch: str
    is_primary: bool


@dataclass(frozen=True)
class Meta:
    state: str
    started_at: float
    indexed_at: float
    current_run: Run = Run()
    sources: tuple[Source, ...] = ()
    error: str | None = None


@dataclass
class IndexState:
    """Reads and writes ``meta.json`` and ``file_hashes.json`` of an index folder; a corrupt or missing file counts as none."""

    folder: Path
    clock: object = field(default=time.time)

    def _load(self, name: str):
        try:
            return json.loads((Path(self.folder) / name).read_text())
        except (OSError, ValueError):
            return None

    def _save(self, name: str, what) -> None:
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        staged = Path(self.folder) / f"{name}.new"
        staged.write_text(json.dumps(what, sort_keys=True))
        staged.replace(Path(self.folder) / name)

    @property
    def meta(self) -> Meta | None:
        found = self._load("meta.json")
        if not isinstance(found, dict) or "state" not in found:
            return None
        run = found.get("current_run") or {}
        sources = found.get("sources")
        if sources is None:  # the layout with one source
            sources = [{"alias": "root", "commit": found.get("last_commit") or found.get("commit") or "", "branch": found.get("branch") or "", "is_primary": True}]
        return Meta(
            found["state"], found.get("started_at", 0.0), found.get("indexed_at", found.get("started_at", 0.0)), Run(tuple(run.get("paths_to_process", ())), run.get("processed_count", 0), run.get("error")),
            tuple(Source(**s) for s in sources), found.get("error"),
        )

    @property
    def hashes(self) -> dict[str, str]:
        return self._load("file_hashes.json") or {}

    def _put(self, meta: Meta) -> None:
        self._save("meta.json", asdict(meta))

    def start(self, sources: list[Source]) -> None:
        now = self.clock()
        self._put(Meta(IN_PROGRESS, now, now, Run(), tuple(sources)))

    def save_progress(self, paths: list[str], done: int) -> None:
        if (m := self.meta) and m.state in (IN_PROGRESS, INCOMPLETE):
            self._put(replace(m, current_run=Run(tuple(paths), done, m.current_run.error)))

    def finish(self, hashes: dict[str, str] | None = None, sources: list[Source] | None = None) -> None:
        """The run is done. Hashes are kept here if they are given; an engine keeps them as a relation."""
        if hashes is not None:
            self._save("file_hashes.json", hashes)
        if m := self.meta:
            self._put(Meta(DONE, m.started_at, self.clock(), Run(), tuple(sources) if sources is not None else m.sources))

    def set_incomplete(self) -> None:
        if (m := self.meta) and m.state in (IN_PROGRESS, INCOMPLETE):
            self._put(replace(m, state=INCOMPLETE))

    def set_errored(self, why: Exception | str) -> None:
        if m := self.meta:
            self._put(replace(m, state=ERRORED, error=str(why), current_run=replace(m.current_run, error=str(why))))

    @property
    def is_in_progress(self) -> bool:
        return (m := self.meta) is not None and m.state in (IN_PROGRESS, INCOMPLETE)

    @property
    def has_partial_progress(self) -> bool:
        return (m := self.meta) is not None and bool(m.current_run.paths_to_process) and m.current_run.processed_count > 0

    @property
    def primary(self) -> Source | None:
        return next((s for s in m.sources if s.is_primary), None) if (m := self.meta) else None

    def mode(self, exists: bool) -> str:
        """full without an index or to resume one, else incremental; an errored build isn't resumed."""
        if not exists:
            return "full"
        return "full" if self.is_in_progress and self.has_partial_progress else "incremental"

    def write_version(self) -> None:
        self._save("version.json", {"version": SCHEMA_VERSION})

    def version_matches(self) -> bool:
        found = self._load("version.json")
        return isinstance(found, dict) and found.get("version") == SCHEMA_VERSION




def state_log(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each event's state before and after. ``events`` has ``action``: start, error, finish, incomplete or progress.

    After a start, an error or a finish the state doesn't depend on what it was (given that there is one), so the
    last of these decides; an incomplete counts if that was a start.
    """
    window = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    started = F.max(F.when(F.col("action") == "start", True)).over(window)
    setting = F.when(F.col("action").isin("start", "error", "finish"), F.when((F.col("action") == "start") | started, F.col("action")))
    rows = events.withColumn("_set", F.last(setting, ignorenulls=True).over(window))
    since = F.sum(F.when(setting.isNotNull(), 1).otherwise(0)).over(window)
    rows = rows.withColumn("_run", since)
    within = Window.partitionBy(key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.max(F.when(F.col("action") == "incomplete", True)).over(within)
    after = F.when((F.col("_set") == "start") & cut, INCOMPLETE).when(F.col("_set") == "start", IN_PROGRESS).when(F.col("_set") == "error", ERRORED).when(F.col("_set") == "finish", DONE)
    rows = rows.withColumn("after", after)
    return rows.withColumn("before", F.lag("after").over(Window.partitionBy(key).orderBy(*order))).drop("_set", "_run")
