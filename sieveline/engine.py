"""The engine over repositories: build, update, watch, and the three kinds of question."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import config as cfg
from sieveline.errors import IndexMissingError, IndexStaleError
from sieveline.functions import parsers
from sieveline.functions.embed import backend, embed_column
from sieveline.functions.scalar import content_hash, needs_prefix, search_text, with_prefix
from sieveline.operators import graph, impact, incremental, predicates, search
from sieveline.operators.state import DONE, IndexState, Source
from sieveline.sources import checkouts
from sieveline.sources.checkouts import contents
from sieveline.sources.files import Checkout, Git, Workspace, resolve_paths
from sieveline.sources.shared import scratch, written
from sieveline.sources.store import Store, chunk_id, write_lock
from sieveline.streaming.events import Watch, watch
from sieveline.timing import Phases, logger

#: Searches without a text index, one after another, until an error is logged.
FAILURES_TOLD = 3
#: Files that the record of a run names at most.
RECORDED = 10_000


class Engine:
    def __init__(self, spark: SparkSession, root: Path | str, given: dict | None = None):
        self.spark, self.root = spark, Path(root).resolve()
        self.config = cfg.load(self.root, given)
        roots = self.config.index.roots
        aliases = cfg.check_roots(roots, self.root)
        self.workspace = Workspace([Checkout((self.root / r.repo).resolve(), a, r.include, r.repo == ".") for r, a in zip(roots, aliases)], self.config.index.exclude)
        self.folder = (self.root / self.config.index.path).resolve()
        self.store = Store(spark, self.folder, self.config.embedder.size)
        self.state = IndexState(self.folder)
        self.embedder = backend(self.config.embedder.backend, dimensions=self.config.embedder.size)
        #: Files that a build stores at once, and how long the phases of the last one took.
        self.batch, self.phases = incremental.RESUME_BATCH, {}
        self._failures = 0

    # ---- indexing ----
    def build(self, full: bool = False) -> dict[str, int]:
        """Builds or updates the index, whichever its state calls for; returns counts of files.

        A build that was cut off goes on: what its finished batches stored is kept, and the rest differs from it.
        """
        with write_lock(self.folder):
            before = self.state.meta
            going_on = not full and self.store.exists() and self.state.is_in_progress and self.state.has_partial_progress
            whole = not going_on and (full or self.state.mode(self.store.exists()) == "full")
            done = before is not None and before.state == DONE
            self.state.start([Source(**h) for h in self.workspace.heads()])
            try:
                return self._index(whole, {s.alias: s.commit for s in before.sources} if done and not whole else None)
            except BaseException as e:
                self.state.set_errored(e) if isinstance(e, Exception) else self.state.set_incomplete()
                raise

    update_incremental = build

    def _named(self, since: dict[str, str] | None) -> DataFrame | None:
        """(path) of what version control names since the last build and what it named then; None if every file is to be read."""
        if not since or not all(since.get(c.alias) and Git(c.root).run("cat-file", "-e", since[c.alias]) is not None for c in self.workspace.checkouts):
            return None
        return checkouts.changes(self.spark, self.workspace, since).select("path").unionByName(self.store.read("dirty"))

    def _index(self, whole: bool, since: dict[str, str] | None) -> dict[str, int]:
        time = Phases()
        with scratch(self.spark):
            with time.phase("discover"):
                if whole or not self.store.exists("lookups"):
                    self.store.clear()
                    whole, since = True, None
                found = written(checkouts.files(self.spark, self.workspace), "found")
                stored, named = self.store.read("file_state"), self._named(since)
                wanted = found if named is None else checkouts.known(named.unionByName(found.join(stored, "path", "left_anti").select("path")), found)
                read = written(contents(wanted), "read")
                checkouts.told_missing(read, logger)
                files = read.where("error is null").select("path", "content")
                hashed = files.select("path", content_hash(F.col("content")).alias("sha256"))
                same = stored.join(found, "path", "left_semi").join(read, "path", "left_anti")
                now = written(hashed.unionByName(same), "now")
            plan = written(incremental.incremental_plan(now, stored, now.select("path"), now.select("path").where("false")), "plan")
            counts = incremental.run_summary(plan).first().asDict()
            update = written(incremental.resume_batches(plan.where("action = 'update'").select("path"), self.batch), "update")
            old, new = (written(graph.module_index(x), "modules") for x in (stored.select("path"), now))
            gone, before = plan.where("action = 'remove'").select("path"), self.store._parts("chunks")
            for name in ("chunks", "nodes", "facts", "lookups", "file_state"):
                if counts["removed"]:
                    self.store.replace(name, self.store.read(name).where("false"), gone)
            # the record of a run names so many of its files
            some = [r["path"] for r in update.orderBy("path").limit(RECORDED).collect()]
            self.state.save_progress(some, 0)
            with time.phase("chunks and facts"):
                for n in range(-(-counts["updated"] // self.batch)):
                    self._store_batch(files, now, update.where(F.col("batch") == n).select("path"), new)
                    self.state.save_progress(some, min((n + 1) * self.batch, counts["updated"]))
            with time.phase("graph"):
                self._refresh_graph(found, update, None if whole else old, new, now)
            with time.phase("text index"):
                # a build that was cut may have left chunks that the text index has never seen
                if since is None or not self.store.text.exists():
                    self.store.write_text_index()
                elif counts["updated"] or counts["removed"]:
                    self.store.update_text_index(gone.unionByName(update.select("path")), before)
            for name in ("chunks", "lookups", "file_state"):
                if not self.store.exists(name):
                    self.store.write(name, self.store.read(name))
            self.store.write("dirty", checkouts.changes(self.spark, self.workspace, {}).select("path").distinct())
        self.state.finish()
        self.state.write_version()
        self.phases = time.seconds
        return counts

    def _store_batch(self, files: DataFrame, now: DataFrame, paths: DataFrame, index: DataFrame) -> None:
        """Stores all that stems from some files, their hashes last: a batch whose hashes are stored is done."""
        changed = files.join(paths, "path", "left_semi")
        chunks = parsers.chunk_files(changed)
        text = with_prefix(search_text(F.col("path"), F.col("symbol"), F.col("content")), "document", self.config.embedder.model)
        self.store.insert_chunks(chunks.withColumn("vector", embed_column(text, self.embedder, self.config.embedder.batch_size)), paths)
        self._store_facts(changed, paths, index)
        self.store.replace("file_state", now.join(paths, "path", "left_semi"), paths)

    def _store_facts(self, files: DataFrame, paths: DataFrame, index: DataFrame) -> None:
        with scratch(self.spark):
            asked = written(parsers.lookups(files), "lookups")
            nodes, edges = parsers.graph_of(written(parsers.facts(parsers.resolved(files, asked, index)), "facts"))
            self.store.replace("lookups", asked, paths)
            self.store.replace("nodes", nodes, paths)
            self.store.replace("facts", edges, paths)

    def _refresh_graph(self, found: DataFrame, parsed: DataFrame, old: DataFrame | None, new: DataFrame, now: DataFrame) -> None:
        """Parses files again that ask for a module that isn't the file it was, and resolves names across all."""
        if old is not None:
            moved = old.withColumnRenamed("path", "_old").join(new, "module", "full_outer").where("not (_old <=> path)").select("module")
            asking = self.store.read("lookups").join(moved, "module", "left_semi").select("path").distinct()
            again = written(asking.join(parsed, "path", "left_anti").join(found, "path", "left_semi"), "again")
            if not again.isEmpty():
                read = contents(checkouts.known(again, found)).where("error is null").select("path", "content")
                self._store_facts(read, again, new)
        edges, nodes = self.store.read("facts"), self.store.read("nodes")
        if not self.config.graph.include_external:
            edges = predicates.known_edges(edges, now)
        edges = graph.post_merge(edges, nodes)
        for passes in parsers.PASSES.values():
            for one in passes:
                edges = one(edges, nodes)
        self.store.write("edges", edges)

    def watch(self, events: DataFrame | None = None, checkpoint: str | None = None) -> Watch:
        """Updates the index after each burst of file events: those of a given stream, else of the workspace's files as they change from now on."""
        folder = self.folder / "watch"
        if events is None:
            events = checkouts.events(self.spark, self.workspace, str(folder / "looks"), str(self.folder))
        ignored = "|".join(r.pattern for _, r in self.workspace.exclude.rules) or None
        return watch(events, lambda batch, n: self.build(), checkpoint or str(folder / "checkpoint"), f"{self.config.watcher.debounce} seconds", index_dir=str(self.folder), ignored=ignored)

    # ---- questions ----
    def _ready(self) -> None:
        if self.state.is_in_progress:
            raise IndexStaleError("the index is being built or its build was interrupted")

    def search(self, query: str, k: int = 5, prefix: str | None = None, repos: list[str] | None = None, include_tests: bool = True, absolute: bool = True) -> DataFrame:
        predicates.check_query(query)
        self._ready()
        known = [c.alias for c in self.workspace.checkouts]
        aliases = predicates.default_aliases(repos, known, next((c.alias for c in self.workspace.checkouts if c.is_primary), known[0]), self.config.search.default_scope)
        chunks = self.store.read("chunks").withColumn("doc_id", chunk_id())
        prefixed = f"search_query: {query}" if needs_prefix(self.config.embedder.model) else query
        vector = self.embedder.embed([prefixed])[0]
        index = self._text_index() if self.config.search.hybrid else None
        metric, where = self.config.search.metric, predicates.scope(F.col("path"), prefix, aliases, include_tests)
        nearest = self.store.nearest(vector, metric, where)
        found = search.search(chunks.drop("vector", "search_text"), chunks.select("doc_id", "vector"), query, vector, k, prefix, aliases, include_tests, index is not None, metric, index, nearest).drop("doc_id")
        return resolve_paths(found, self.workspace.roots(self.spark)) if absolute else found

    def _text_index(self) -> search.TextIndex | None:
        """The stored text index; without one searches go by vectors alone, and the third in a row is logged as an error."""
        try:
            found = self.store.text_index()
        except AnalysisException as e:
            logger.warning("the text index can't be read: %s", e)
            found = None
        self._failures = 0 if found is not None else self._failures + 1
        if self._failures == FAILURES_TOLD:
            logger.error("%d searches in a row went without the text index; build it anew", self._failures)
        return found

    def list(self, limit: int = 500, prefix: str | None = None) -> DataFrame:
        return incremental.list_chunks(self.store.read("chunks"), limit, prefix)

    def chunks_by_path(self) -> DataFrame:
        return incremental.chunks_by_path(self.store.read("chunks")).orderBy("path")

    def status(self) -> dict:
        meta = self.state.meta
        return {"exists": self.store.exists(), "state": meta.state if meta else None, "indexed_at": meta.indexed_at if meta else None, "chunks": self.store.chunk_count(), "sources": [s.__dict__ for s in meta.sources] if meta else [], "version_matches": self.state.version_matches()}

    def maintain(self) -> dict[str, str]:
        with write_lock(self.folder):
            return self.store.maintain(metric=self.config.search.metric)

    def skeleton(self, arg: str, include_imports: bool = False, symbol: str | None = None) -> str:
        """The outline of ``path`` or ``path:START-END``; a file of no known language as it is."""
        import re

        m = re.fullmatch(r"(.*):(\d+)-(\d+)", arg)
        path = (self.root / (m[1] if m else arg)).resolve()
        if m and int(m[3]) < int(m[2]):
            raise ValueError(f"the range ends before it starts: {arg}")
        if not any(path.is_relative_to(c.root) for c in self.workspace.checkouts):
            raise ValueError(f"{path} lies outside the workspace")
        content = path.read_text(errors="replace")
        if parsers.parser_of(path.name) is None:
            return content
        files = self.spark.createDataFrame([(str(path), content)], "path string, content string")
        rows = parsers.skeleton(files, include_imports)
        chosen = parsers.matches_symbol(rows, symbol)
        if m:
            chosen = predicates.within_lines(chosen, int(m[2]), int(m[3]))
        found = parsers.render(chosen).first()
        if found is None and symbol:
            known = parsers.available_symbols(rows).first()
            return f"No symbol {symbol}; there are: {known['symbols'] if known else '(none)'}"
        return found["text"] if found else ""

    def graph(self, kind: str | None = None, source: str | None = None, target: str | None = None) -> DataFrame:
        return predicates.edge_filter(self.store.read("edges"), kind, source, target)

    def impact(self, symbol: str, depth: int = 2) -> impact.Impact:
        if not self.store.exists():
            raise IndexMissingError("build the index first")
        return impact.impact(symbol, self.store.read("nodes"), self.store.read("edges"), depth)
