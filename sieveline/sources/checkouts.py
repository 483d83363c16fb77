"""Checkouts as a data source of Spark: their files, what version control says has changed, and a stream of file events.

Each task lists a checkout by itself and takes its share of the paths, so the driver never handles a file. Paths are
bytes: a file is opened by exactly the name that it has, whatever that contains, and nothing is read as a pattern.
"""

from __future__ import annotations

import json
import os
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sieveline.sources.files import Checkout, Git, Ignore, Workspace, load_ignore

FORMAT = "checkout"
#: ``file`` is the absolute path as the system has it; ``path`` the logical one, in which bytes that are no UTF-8 are spelt out.
FILES = "path string, file binary"
CHANGES = "path string, file binary, action string"
EVENTS = "ts timestamp, seq long, event_type string, path string, dest_path string, is_directory boolean"
#: Bytes of contents that a task hands on at once.
BATCH_BYTES = 8_000_000


def shown(path: str | bytes) -> str:
    """A path as text: bytes that are no UTF-8 as escapes."""
    return os.fsencode(path).decode("utf-8", "backslashreplace")


@dataclass
class Share(InputPartition):
    """One task's part of a checkout: the paths whose hash falls to it."""

    root: str
    alias: str
    scopes: tuple[str, ...] | None
    number: int
    of: int
    start: int = 0
    end: int = 0

    def takes(self, path: str) -> bool:
        return zlib.crc32(os.fsencode(path)) % self.of == self.number

    def checkout(self) -> Checkout:
        return Checkout(Path(self.root), self.alias, self.scopes)


class _Options:
    def __init__(self, options):
        self.what = options.get("what", "files")
        self.checkouts = json.loads(options["checkouts"])
        self.exclude = json.loads(options.get("exclude", "[]"))
        self.since = json.loads(options.get("since", "{}"))
        self.splits = int(options.get("splits", "4"))
        self.looks, self.index_dir = options.get("looks"), options.get("index_dir")

    def shares(self, start: int = 0, end: int = 0) -> list[Share]:
        """For changes one a checkout, as version control tells them at once."""
        n = 1 if self.what == "changes" else self.splits
        return [Share(c["root"], c["alias"], tuple(c["scopes"]) if c["scopes"] is not None else None, i, n, start, end) for c in self.checkouts for i in range(n)]

    def indexed(self, share: Share) -> Iterator[tuple[str, bytes]]:
        """(logical path, file) of what is to be indexed of a share."""
        checkout, excluded = share.checkout(), Ignore(self.exclude)
        for p in Git(checkout.root).discover():
            if share.takes(p) and checkout.contains(p) and not excluded(p):
                yield f"{checkout.alias}/{shown(p)}", os.fsencode(checkout.root / p)

    def changed(self, share: Share) -> Iterator[tuple[str, bytes, str]]:
        checkout = share.checkout()
        changed, removed = Git(checkout.root).changes(self.since.get(checkout.alias) or None)
        for found, action in ((changed, "changed"), (removed, "removed")):
            for p in sorted(found):
                if action == "removed" or checkout.contains(p):
                    yield f"{checkout.alias}/{shown(p)}", os.fsencode(checkout.root / p), action

    # ---- looks: what a share's files were like at some time ----
    def look(self, share: Share) -> dict[bytes, tuple[int, int]]:
        """(time of the last change, size) of a share's files."""
        root, checkout, excluded, ignored = Path(share.root), share.checkout(), Ignore(self.exclude), load_ignore(Path(share.root))
        index = os.path.realpath(self.index_dir) if self.index_dir else None
        out = {}
        for folder, names, files in os.walk(root):
            names[:] = [n for n in names if n != ".git" and os.path.join(folder, n) != index]
            for f in files:
                whole = os.path.join(folder, f)
                p = Path(os.path.relpath(whole, root)).as_posix()
                if share.takes(p) and checkout.contains(p) and not ignored(p) and not excluded(p):
                    try:
                        stat = os.stat(whole)
                        out[os.fsencode(whole)] = (stat.st_mtime_ns, stat.st_size)
                    except OSError:  # it went meanwhile
                        pass
        return out

    def _at(self, share: Share, number: int) -> Path:
        return Path(self.looks) / f"{share.alias}-{share.number}-{share.of}-{number}.parquet"

    def stored(self, share: Share, number: int) -> dict[bytes, tuple[int, int]] | None:
        try:
            t = pq.read_table(self._at(share, number))
        except FileNotFoundError:
            return None
        return {f: (m, s) for f, m, s in zip(*(t.column(c).to_pylist() for c in ("file", "modified", "size")))}

    def taken(self, share: Share, number: int) -> dict[bytes, tuple[int, int]]:
        """The stored look of that number; if there is none, one is taken and stored whole, so a repeated task sees the same."""
        if (found := self.stored(share, number)) is None:
            found = self.look(share)
            path = self._at(share, number)
            path.parent.mkdir(parents=True, exist_ok=True)
            staged = path.with_name(f".{uuid.uuid4().hex}")
            columns = {"file": pa.array(list(found), pa.binary()), "modified": pa.array([v[0] for v in found.values()], pa.int64()), "size": pa.array([v[1] for v in found.values()], pa.int64())}
            pq.write_table(pa.table(columns), staged)
            os.replace(staged, path)
        return found


class _Reader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Share]:
        return self.options.shares()

    def read(self, partition: Share) -> Iterator[tuple]:
        if self.options.what == "changes":
            yield from self.options.changed(partition)
        elif self.options.what == "looks":
            self.options.taken(partition, 0)
            yield partition.alias, partition.number
        else:
            yield from self.options.indexed(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are times of looks: a batch compares the looks at its ends, taking the later one if no earlier attempt has."""

    def __init__(self, options: _Options):
        self.options, self.last = options, 0

    def initialOffset(self) -> dict:
        return {"look": 0}

    def latestOffset(self) -> dict:
        self.last = max(self.last + 1, int(time.time() * 1000))
        return {"look": self.last}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return self.options.shares(start["look"], end["look"])

    def read(self, partition: Share) -> Iterator[tuple]:
        from datetime import datetime, timezone

        now, before = self.options.taken(partition, partition.end), self.options.stored(partition, partition.start)
        if before is None:  # nothing to compare with: from here on
            return
        found = [("deleted", p) for p in before.keys() - now.keys()] + [("modified" if p in before else "created", p) for p, s in now.items() if before.get(p) != s]
        at = datetime.fromtimestamp(partition.end / 1000, timezone.utc)
        for n, (kind, p) in enumerate(sorted(found, key=lambda x: x[1])):
            yield at, n, kind, shown(p), None, False

    def commit(self, end: dict) -> None:
        """Looks before the last that is done with go."""
        for p in Path(self.options.looks).glob("*.parquet"):
            number = p.stem.rsplit("-", 1)[1]
            if number.isdigit() and int(number) < end["look"]:
                p.unlink(missing_ok=True)


class CheckoutSource(DataSource):
    """Options: ``checkouts`` (JSON: root, alias, scopes of each), ``exclude`` (JSON patterns), ``what`` (files, changes or
    looks), ``since`` (JSON: commit by alias, for changes), ``splits`` (tasks a checkout), ``looks`` (the folder in which a
    stream keeps what files were like) and ``index_dir`` (a folder that doesn't count)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return {"files": FILES, "changes": CHANGES, "looks": "alias string, share int", "events": EVENTS}[self.options.get("what", "files")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Options(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_Options(self.options))


def _options(workspace: Workspace, **more) -> dict[str, str]:
    found = [{"root": str(c.root), "alias": c.alias, "scopes": list(c.scopes) if c.scopes is not None else None} for c in workspace.checkouts]
    return {"checkouts": json.dumps(found), "exclude": json.dumps(list(workspace.patterns))} | {k: v for k, v in more.items() if v is not None}


def _load(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    spark.dataSource.register(CheckoutSource)
    return spark.read.format(FORMAT).options(**options).load()


def files(spark: SparkSession, workspace: Workspace, splits: int = 4) -> DataFrame:
    """(path, file) of all files that are to be indexed. A checkout that fails is warned about where it is read and adds nothing."""
    return _load(spark, _options(workspace, what="files", splits=str(splits)))


def changes(spark: SparkSession, workspace: Workspace, since: dict[str, str]) -> DataFrame:
    """(path, file, action): what changed or was removed since a commit of each checkout, and in its working tree."""
    return _load(spark, _options(workspace, what="changes", since=json.dumps(since)))


def events(spark: SparkSession, workspace: Workspace, looks: str, index_dir: str | None = None, splits: int = 1) -> DataFrame:
    """A stream of events of the checkouts' files, from now on: what they are like now is stored in ``looks`` at once, if nothing is."""
    options = _options(workspace, looks=looks, index_dir=index_dir, splits=str(splits))
    if not any(Path(looks).glob("*.parquet")):
        _load(spark, options | {"what": "looks"}).count()
    spark.dataSource.register(CheckoutSource)
    return spark.readStream.format(FORMAT).options(**options, what="events").load()


def contents(found: DataFrame) -> DataFrame:
    """(path, content, error) of ``found`` (path, file): bytes that are no UTF-8 are replaced; a file that can't be read, as it went meanwhile, has no content but an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str | None, str | None]] = []
        size = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], pa.string()) for i in range(3)], names=["path", "content", "error"])

        for batch in batches:
            for path, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with open(file, "rb") as f:
                        raw = f.read()
                    held.append((path, raw.decode("utf-8", "replace"), None))
                    size += len(raw)
                except OSError as e:
                    held.append((path, None, e.strerror or str(e)))
                if size > BATCH_BYTES:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    return found.select("path", "file").mapInArrow(run, "path string, content string, error string")


def told_missing(read: DataFrame, logger) -> int:
    """Warns of files without content, the first ones by name, and counts them."""
    missing = read.where("error is not null")
    n = missing.count()
    if n:
        some = ", ".join(f"{r['path']} ({r['error']})" for r in missing.select("path", "error").orderBy("path").limit(10).collect())
        logger.warning("%d files could not be read: %s", n, some)
    return n


def known(paths: DataFrame, found: DataFrame) -> DataFrame:
    """The files of ``found`` whose path is among ``paths``."""
    return found.join(paths.select("path").distinct(), "path", "left_semi").select("path", F.col("file"))
