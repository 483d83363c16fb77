"""Upkeep of the text index: immutable segments, deletions beside them, merges by tiers.

An update cuts the texts of what is new into a segment of its own and marks what it replaces as deleted, in words of
64 documents each. Nothing else is cut or rewritten: how many chunks have a term, how many chunks there are and how long
they are is kept by adding what came and subtracting what went. Segments of like size are merged once there are several,
from the terms that they hold, so each document is written again a logarithmic number of times.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators.search import TextIndex, cut
from sieveline.sources.shared import delete, read_text, write_text

#: Segments of one tier, and parts of counts, that are merged.
FAN_IN = 8
DOC = "n long, doc_id string, path string, dl int, terms array<string>, tfs array<int>"
EMPTY = {"segments": [], "terms": [], "deleted": [], "n": 0, "total": 0}


def _word(n: str = "n") -> Column:
    return F.shiftright(F.col(n), 6)


def _named(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("doc_id", F.col("doc_id").cast("string"))


class TextSegments:
    """The text index in a folder that driver and executors share. One manifest names all that is current, so readers see a whole index or another."""

    def __init__(self, spark: SparkSession, folder: str, fan_in: int = FAN_IN):
        self.spark, self.folder, self.fan_in = spark, str(folder).rstrip("/"), fan_in

    # ---- the manifest ----
    @property
    def manifest(self) -> dict | None:
        found = read_text(self.spark, f"{self.folder}/current")
        return json.loads(found) if found else None

    def exists(self) -> bool:
        return self.manifest is not None

    def _commit(self, m: dict) -> None:
        write_text(self.spark, f"{self.folder}/current", json.dumps(m, sort_keys=True))

    def _new(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/{name}")
        return name

    def _read(self, names: list[str], schema: str, inner: str = "") -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{x}{inner}" for x in names)) if names else self.spark.createDataFrame([], schema)

    # ---- relations ----
    def _docs(self, m: dict, of: list[str] | None = None) -> DataFrame:
        """Documents that aren't deleted, with their segment."""
        ids = [s["id"] for s in m["segments"]] if of is None else of
        docs = self._read(ids, DOC, "/docs").withColumn("segment", F.regexp_extract("_metadata.file_path", r"/([0-9a-f]{32})/docs/", 1)) if ids else self._read([], DOC + ", segment string")
        return self._alive(docs, m)

    def _deleted(self, m: dict) -> DataFrame:
        return self._read(m["deleted"], "segment string, word long, bits long").groupBy("segment", "word").agg(F.bit_or("bits").alias("bits"))

    def _alive(self, rows: DataFrame, m: dict) -> DataFrame:
        if not m["deleted"]:
            return rows
        gone = self._deleted(m).select(F.col("segment").alias("_s"), F.col("word").alias("_w"), "bits")
        joined = rows.join(gone, (F.col("segment") == F.col("_s")) & (_word() == F.col("_w")), "left")
        return joined.where("bits is null or bit_get(bits, cast(n & 63 as int)) = 0").drop("_s", "_w", "bits")

    def postings(self, m: dict | None = None) -> DataFrame:
        """(term, doc_id, tf, dl) of what isn't deleted."""
        m = m or self.manifest or EMPTY
        schema = "term string, n long, doc_id string, tf int, dl int"
        ids = [s["id"] for s in m["segments"]]
        rows = self._read(ids, schema, "/postings").withColumn("segment", F.regexp_extract("_metadata.file_path", r"/([0-9a-f]{32})/postings/", 1)) if ids else self._read([], schema + ", segment string")
        return self._alive(rows, m).select("term", "doc_id", "tf", "dl")

    def terms(self, m: dict | None = None) -> DataFrame:
        """(term, df): in how many chunks each term is."""
        m = m or self.manifest or EMPTY
        return self._read(m["terms"], "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def index(self) -> TextIndex | None:
        if (m := self.manifest) is None:
            return None
        corpus = self.spark.createDataFrame([(m["n"], m["total"] / m["n"] if m["n"] else None)], "n long, avgdl double")
        return TextIndex(self.postings(m), self.terms(m), corpus)

    # ---- changes ----
    def _segment(self, docs: DataFrame) -> dict:
        """Writes documents (doc_id, path, dl, terms, tfs) as a segment, as they are dealt and by path within, and their postings by term."""
        name = uuid.uuid4().hex
        at = f"{self.folder}/{name}"
        docs.sortWithinPartitions("path").withColumn("n", F.monotonically_increasing_id()).select("n", "doc_id", "path", "dl", "terms", "tfs").write.parquet(f"{at}/docs")
        stored = self.spark.read.schema(DOC).parquet(f"{at}/docs")
        each = stored.select("n", "doc_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("_t")).select(F.col("_t.terms").alias("term"), "n", "doc_id", F.col("_t.tfs").alias("tf"), "dl")
        each.repartitionByRange("term", "n").sortWithinPartitions("term", "n").write.parquet(f"{at}/postings")
        size = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return {"id": name, "docs": size[0], "total": size[1]}

    def _counts(self, docs: DataFrame, sign: int) -> DataFrame:
        return docs.select(F.explode("terms").alias("term")).groupBy("term").agg((sign * F.count(F.lit(1))).alias("df"))

    def _add(self, m: dict, docs: DataFrame) -> None:
        s = self._segment(docs)
        if s["docs"]:
            stored = self._read([s["id"]], DOC, "/docs")
            m["terms"].append(self._new(self._counts(stored, 1).repartitionByRange("term").sortWithinPartitions("term")))
            m["segments"].append(s)
            m["n"], m["total"] = m["n"] + s["docs"], m["total"] + s["total"]

    def build(self, chunks: DataFrame, text: Column | None = None) -> None:
        """The index of chunks (doc_id, path, and what their text is made of) and of nothing else."""
        m = json.loads(json.dumps(EMPTY))
        self._add(m, cut(_named(chunks), text=text, more=("path",)))
        self._commit(m)

    def update(self, gone: DataFrame, chunks: DataFrame, text: Column | None = None) -> None:
        """Takes all chunks of the paths in ``gone`` out and puts ``chunks`` in; only their texts are cut."""
        m = self.manifest
        if m is None:
            raise ValueError("there is no text index to update")
        dead = self._docs(m).join(gone.select("path").distinct(), "path", "left_semi")
        bits = dead.groupBy("segment", _word().alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(n & 63 as int))")).alias("bits"))
        name = self._new(bits)
        size = dead.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if size[0]:
            m["terms"].append(self._new(self._counts(dead, -1)))
            m["deleted"].append(name)
            m["n"], m["total"] = m["n"] - size[0], m["total"] - size[1]
        self._add(m, cut(_named(chunks), text=text, more=("path",)))
        self._merge(m)
        self._commit(m)

    def tier(self, docs: int) -> int:
        t = 0
        while docs >= self.fan_in:
            docs, t = docs // self.fan_in, t + 1
        return t

    def _merge(self, m: dict) -> None:
        """Merges tiers that are full, and counts and deletions of which there are many parts."""
        while True:
            tiers: dict[int, list[dict]] = {}
            for s in m["segments"]:
                tiers.setdefault(self.tier(s["docs"]), []).append(s)
            full = next((x for _, x in sorted(tiers.items()) if len(x) >= self.fan_in), None)
            if full is None:
                break
            ids = [s["id"] for s in full]
            whole = self._segment(self._docs(m, ids).drop("segment", "n").repartitionByRange("path", "doc_id"))
            left = self._deleted(m).where(~F.col("segment").isin(ids))
            m["segments"] = [s for s in m["segments"] if s["id"] not in ids] + ([whole] if whole["docs"] else [])
            m["deleted"] = [] if not m["deleted"] or left.isEmpty() else [self._new(left)]
        if len(m["terms"]) > self.fan_in:
            m["terms"] = [self._new(self.terms(m).repartitionByRange("term").sortWithinPartitions("term"))]
        if len(m["deleted"]) > self.fan_in:
            m["deleted"] = [self._new(self._deleted(m))]

    def maintain(self) -> None:
        """One segment without deletions, and nothing else in the folder."""
        m = self.manifest
        if m is None:
            return
        fresh = json.loads(json.dumps(EMPTY))
        self._add(fresh, self._docs(m).drop("segment", "n").repartitionByRange("path", "doc_id"))
        self._commit(fresh)
        for name in {s["id"] for s in m["segments"]} | {*m["terms"], *m["deleted"]}:
            delete(self.spark, f"{self.folder}/{name}")
