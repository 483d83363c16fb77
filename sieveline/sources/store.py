"""The index as stored: relations of Parquet parts under numbered manifests, beside the state's records."""

from __future__ import annotations

import contextlib
import fcntl
import json
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.errors import WriteConflictError
from sieveline.functions.scalar import file_of, search_text
from sieveline.operators.balls import BallIndex
from sieveline.operators.search import TextIndex
from sieveline.operators.segments import TextSegments
from sieveline.schema import EDGE, FILE_STATE, LOOKUP, NODE, PATH, STORED_CHUNK
from sieveline.sources.shared import delete, listed, publish, read_text, size_of, write_text

#: ``facts`` are the edges as files state them, before names are resolved across files; ``edges`` what comes of them. ``lookups`` are
#: the module names that files ask for, ``dirty`` the paths that version control named when the last build ended: they may change back without a commit.
SCHEMAS = {"chunks": STORED_CHUNK, "nodes": NODE, "edges": EDGE, "facts": EDGE, "lookups": LOOKUP, "dirty": PATH, "file_state": FILE_STATE}
#: The file that each row of a relation stems from.
FILE_OF = {"chunks": F.col, "file_state": F.col, "lookups": F.col, "nodes": lambda _: F.col("file_path"), "facts": lambda _: file_of(F.col("source"))}
GRAPH_VERSION = 1
#: Parts up to so many bytes are written anew when rows of theirs go; in larger ones the files are marked.
SMALL_PART = 64 << 20
#: Bytes of a file after compaction, and folders of marks that are merged.
FILE_BYTES, MARKS = 128 << 20, 16
MARK = "_marked string, _since long"
#: Digits of a manifest's number in the names of its parts.
NUMBER = 12


@contextlib.contextmanager
def write_lock(folder: Path, timeout: float = 300):
    """One writer at a time."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    with open(Path(folder) / "lock", "w") as f:
        end = time.monotonic() + timeout
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() > end:
                    raise TimeoutError(f"{folder} is locked") from None
                time.sleep(0.2)
        yield


def _part() -> Column:
    """The part that a row was read from."""
    return F.regexp_extract("_metadata.file_path", r"/(v[0-9a-f]{32})/", 1)


def chunk_id() -> Column:
    return F.concat_ws(":", "path", "start_line", "end_line", "symbol")


class Store:
    """Relations by name, each of one or more parts, in a folder that driver and executors share.

    A relation's current parts stand in a numbered manifest. A writer stages new folders and then publishes the manifest
    that follows the one it read; whoever finds that number taken has lost to another writer and changes nothing. Readers
    keep what they opened. The manifest knows each part's range of files, so parts that can't hold a file aren't opened
    for it, and its bytes: small parts that hold rows to be dropped are written anew without them, in large ones the
    files are marked, and reads leave marked rows out until ``maintain`` does away with them.
    """

    def __init__(self, spark: SparkSession, folder: Path | str, dimensions: int = 384, small: int = SMALL_PART, file_bytes: int = FILE_BYTES):
        self.spark, self.folder, self.dimensions = spark, str(folder).rstrip("/"), dimensions
        self.small, self.file_bytes = small, file_bytes
        self.text = TextSegments(spark, f"{self.folder}/text")
        self.balls = BallIndex(spark, f"{self.folder}/balls")

    # ---- manifests ----
    def _manifest(self, name: str) -> tuple[int, dict]:
        """The current manifest and its number; 0 and an empty one before the first."""
        at = f"{self.folder}/{name}/manifests"
        numbers = [x for x in listed(self.spark, at) if x.isdigit()]
        return (int(numbers[-1]), json.loads(read_text(self.spark, f"{at}/{numbers[-1]}"))) if numbers else (0, {"parts": [], "marks": []})

    def _commit(self, name: str, base: int, parts: list[dict], marks: list[str]) -> None:
        taken = self._manifest(name)[0] != base
        if taken or not publish(self.spark, f"{self.folder}/{name}/manifests/{base + 1:012d}", json.dumps({"parts": parts, "marks": marks})):
            raise WriteConflictError(f"{name} was changed by another writer")

    def _parts(self, name: str) -> list[str]:
        return [p["name"] for p in self._manifest(name)[1]["parts"]]

    def exists(self, name: str = "chunks") -> bool:
        return bool(self._parts(name))

    # ---- rows ----
    def _file(self, name: str) -> Column:
        return FILE_OF[name]("path")

    def _alive(self, name: str, rows: DataFrame, marks: list[str]) -> DataFrame:
        """``rows``, which name their ``part``, without those whose file was marked after the part was written."""
        if not marks:
            return rows
        marked = self.spark.read.schema(MARK).parquet(*(f"{self.folder}/{name}/{m}" for m in marks)).groupBy("_marked").agg(F.max("_since").alias("_since"))
        written_at = F.substring("part", 2, NUMBER).cast("long")
        return rows.join(marked, self._file(name) == F.col("_marked"), "left").where(F.col("_since").isNull() | (written_at >= F.col("_since"))).drop("_marked", "_since")

    def _read(self, name: str, parts: list[str], marks: list[str] | None = None) -> DataFrame:
        """Rows of some parts that aren't marked."""
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.folder}/{name}/{p}" for p in parts))
        marks = self._manifest(name)[1]["marks"] if marks is None else marks
        return self._alive(name, rows.withColumn("part", _part()), marks).drop("part") if marks else rows

    def read(self, name: str) -> DataFrame:
        m = self._manifest(name)[1]
        return self._read(name, [p["name"] for p in m["parts"]], m["marks"])

    def _staged(self, name: str, number: int, df: DataFrame) -> dict:
        """Writes a part; its name begins with the number of the manifest that it is for."""
        part = f"v{number:0{NUMBER}d}{uuid.uuid4().hex[NUMBER:]}"
        at = f"{self.folder}/{name}/{part}"
        df.select(*SCHEMAS[name].fieldNames()).write.parquet(at)
        low = high = None
        if name in FILE_OF:
            low, high = self.spark.read.schema(SCHEMAS[name]).parquet(at).agg(F.min(self._file(name)), F.max(self._file(name))).first()
        return {"name": part, "low": low, "high": high, "bytes": size_of(self.spark, at)}

    def write(self, name: str, df: DataFrame) -> None:
        """Stages all rows, then swaps; ``df`` may read what it replaces."""
        base, _ = self._manifest(name)
        self._commit(name, base, [self._staged(name, base + 1, df)], [])

    def replace(self, name: str, fresh: DataFrame, paths: DataFrame) -> None:
        """Drops the rows that stem from ``paths`` (column path) and adds the fresh ones; parts that can't hold such rows aren't opened.

        A null path is no file's; without paths, this appends.
        """
        base, m = self._manifest(name)
        gone = paths.select(F.col("path").alias("_file")).where("_file is not null").distinct()
        low, high = gone.agg(F.min("_file"), F.max("_file")).first() if m["parts"] else (None, None)
        maybe = {p["name"]: p for p in m["parts"] if low is not None and p["low"] is not None and p["low"] <= high and low <= p["high"]}
        hit = []
        if maybe:
            of = self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.folder}/{name}/{p}" for p in maybe)).withColumn("part", _part())
            found = self._alive(name, of, m["marks"]).withColumn("_file", self._file(name)).join(gone, "_file", "left_semi")
            hit = sorted(r["part"] for r in found.select("part").distinct().collect())  # some of the parts' names
        anew = [p for p in hit if maybe[p]["bytes"] <= self.small]
        fresh, marks = fresh.select(*SCHEMAS[name].fieldNames()), m["marks"]
        if anew:
            left = self._read(name, anew, marks).withColumn("_file", self._file(name)).join(gone, "_file", "left_anti").drop("_file")
            fresh = left.unionByName(fresh)
        if len(anew) < len(hit):
            mark = f"d{uuid.uuid4().hex}"
            marked = gone.select(F.col("_file").alias("_marked"), F.lit(base + 1).cast("long").alias("_since"))
            if len(marks) >= MARKS:
                before = self.spark.read.schema(MARK).parquet(*(f"{self.folder}/{name}/{x}" for x in marks))
                marked, marks = before.unionByName(marked).groupBy("_marked").agg(F.max("_since").alias("_since")), []
            marked.write.parquet(f"{self.folder}/{name}/{mark}")
            marks = [*marks, mark]
        self._commit(name, base, [p for p in m["parts"] if p["name"] not in anew] + [self._staged(name, base + 1, fresh)], marks)

    def insert_chunks(self, chunks: DataFrame, replacing: DataFrame | None = None) -> None:
        """Appends chunks with vectors, first dropping those of ``replacing``'s paths. A vector of another length is an error."""
        size = F.size("vector")
        checked = F.when(size != self.dimensions, F.raise_error(F.concat(F.lit(f"a vector has not {self.dimensions} dimensions but "), size.cast("string"))).cast("array<float>")).otherwise(F.col("vector"))
        fresh = chunks.withColumn("vector", checked).withColumn("search_text", search_text(F.col("path"), F.col("symbol"), F.col("content")))
        if replacing is None:
            replacing = fresh.select("path").where("false")
        self.replace("chunks", fresh, replacing)

    def delete_by_paths(self, paths: DataFrame) -> None:
        if self.exists():
            self.replace("chunks", self.read("chunks").where("false"), paths)

    def write_text_index(self) -> None:
        """Cuts the texts of all chunks once; searches read the postings of their terms from then on."""
        self.text.build(self.read("chunks").withColumn("doc_id", chunk_id()))

    def update_text_index(self, paths: DataFrame, since: list[str]) -> None:
        """Replaces what the text index has of ``paths``: cut are their chunks alone, which stand in parts that ``since`` doesn't name."""
        fresh = self._read("chunks", [p for p in self._parts("chunks") if p not in since]).join(paths.select("path").distinct(), "path", "left_semi")
        self.text.update(paths, fresh.withColumn("doc_id", chunk_id()))

    def text_index(self) -> TextIndex | None:
        """The stored text index, or None where a build hasn't made one."""
        return self.text.index()

    def _vectors(self, parts: list[str]) -> DataFrame:
        rows = self.spark.read.schema(SCHEMAS["chunks"]).parquet(*(f"{self.folder}/chunks/{p}" for p in parts)).withColumn("part", _part())
        return self._alive("chunks", rows, self._manifest("chunks")[1]["marks"]).select(chunk_id().alias("doc_id"), "path", "part", "vector")

    def write_ball_index(self, metric: str = "cosine") -> None:
        """Files the vectors of all chunks by ball; searches read the balls that can matter and what has come since."""
        parts = self._parts("chunks")
        if parts:
            self.balls.build(self._vectors(parts), metric, note={"parts": parts})

    def nearest(self, query: list[float], metric: str, where: Column) -> Callable[[int], DataFrame] | None:
        """The nearest chunks that ``where`` (over path) holds for, by the ball index; None without one for that metric and these dimensions."""
        m = self.balls.manifest
        if m is None or m["metric"] != metric or (m["n"] and m["dims"] != len(query)):
            return None
        now = self._manifest("chunks")[1]
        parts = [p["name"] for p in now["parts"]]
        # a part that is current no more has left its remaining rows to a later one
        covered, since = [p for p in parts if p in m["note"]["parts"]], [p for p in parts if p not in m["note"]["parts"]]
        more = self._vectors(since).where(where).select("doc_id", "vector") if since else None
        return lambda k: self.balls.nearest(query, k, where & F.col("part").isin(covered), more, keep=lambda rows: self._alive("chunks", rows, now["marks"])).rows

    def chunk_count(self) -> int:
        return self.read("chunks").count()

    def clear(self) -> None:
        for name in SCHEMAS:
            if self._parts(name):
                self.write(name, self.spark.createDataFrame([], SCHEMAS[name]))

    def maintain(self, metric: str = "cosine") -> dict[str, str]:
        """Compacts each relation, drops old versions and files the vectors; what went wrong is told step by step.

        Rows are sorted by the file that they stem from, in files of about ``file_bytes``, so scans for a prefix skip most of them.
        """
        told = {}
        for name in SCHEMAS:
            try:
                if self._parts(name):
                    self._compact(name)
                    told[name] = "ok"
            except Exception as e:
                told[name] = f"failed: {e}"
        for name, step in (("text", self.text.maintain), ("balls", lambda: self.write_ball_index(metric))):
            try:
                step()
                told[name] = "ok"
            except Exception as e:
                told[name] = f"failed: {e}"
        return told

    def _compact(self, name: str) -> None:
        number, m = self._manifest(name)
        key = self._file(name) if name in FILE_OF else F.col(SCHEMAS[name].fieldNames()[0])
        files = max(1, -(-sum(p["bytes"] for p in m["parts"]) // self.file_bytes))
        self.write(name, self.read(name).repartitionByRange(files, key).sortWithinPartitions(key))
        now = {p["name"] for p in self._manifest(name)[1]["parts"]}
        for old in listed(self.spark, f"{self.folder}/{name}"):
            if old != "manifests" and old not in now:
                delete(self.spark, f"{self.folder}/{name}/{old}")
        for old in listed(self.spark, f"{self.folder}/{name}/manifests"):
            if not old.isdigit() or int(old) < number - MARKS:  # later numbers stay, so that a slow writer finds its own taken
                delete(self.spark, f"{self.folder}/{name}/manifests/{old}")

    def export_graph(self, path: Path) -> None:
        """Nodes and edges as JSON lines beside the layout's version."""
        self.read("nodes").write.mode("overwrite").json(f"{path}/nodes")
        self.read("edges").orderBy("source", "target", "kind").write.mode("overwrite").json(f"{path}/edges")
        write_text(self.spark, f"{path}/version.json", json.dumps({"schema_version": GRAPH_VERSION}))

    def load_graph(self, path: Path) -> tuple[DataFrame, DataFrame] | None:
        """The nodes and edges of an exported graph; None if it is missing, broken or of another version."""
        try:
            if json.loads(read_text(self.spark, f"{path}/version.json") or "{}")["schema_version"] != GRAPH_VERSION:
                return None
            return tuple(self.spark.read.schema(SCHEMAS[n]).option("mode", "FAILFAST").json(f"{path}/{n}") for n in ("nodes", "edges"))
        except (Py4JJavaError, ValueError, KeyError, TypeError, AnalysisException):
            return None
