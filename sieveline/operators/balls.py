"""Exact nearest vectors from an index of balls.

Vectors are filed by their nearest centre, each ball in files of its own. What a ball can hold at best for a query
follows from its centre and radius, so balls are read best first, in waves that double, and as soon as the k-th best row
found is better than what the rest can hold, the rest is not read. The result is that of a scan of all rows.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from sieveline.operators.search import top_k, vector_scores
from sieveline.sources.shared import read_text, write_text

#: Rows that a ball should hold, balls at most, and rows that centres are found from at most; every row is filed.
BALL_ROWS = 4096
MOST_BALLS = 4096
SAMPLE = 65_536
ROUNDS = 8
#: Scores are rounded to four places: a ball whose bound is so much below a score may still tie with it.
TIE = 5.1e-5


def units(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def bounds(query: np.ndarray, centres: np.ndarray, radii: np.ndarray, metric: str) -> np.ndarray:
    """The best score that a row of each ball can have: 1 less its least distance."""
    if metric == "cosine":
        # of unit vectors, whose product with the query changes by no more than they move
        return np.minimum(1.0, units(query[None, :])[0] @ centres.T + radii)
    if metric == "dot":
        return query @ centres.T + math.sqrt(float(query @ query)) * radii
    least = np.maximum(0.0, np.sqrt(((centres - query) ** 2).sum(axis=1)) - radii)
    return 1 - least**2  # that distance is squared


@dataclass
class Nearest:
    """The rows found, best first, and how many of the balls were read for them."""

    rows: DataFrame
    read: int
    balls: int


class BallIndex:
    """Rows (key, more columns, vector) by ball in a folder that driver and executors share; one manifest names what is current."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id"):
        self.spark, self.folder, self.key = spark, str(folder).rstrip("/"), key

    @property
    def manifest(self) -> dict | None:
        found = read_text(self.spark, f"{self.folder}/current")
        return json.loads(found) if found else None

    def build(self, rows: DataFrame, metric: str = "cosine", ball_rows: int = BALL_ROWS, note: dict | None = None) -> None:
        """Files all of ``rows``; without a vector, or by cosine with a zero one, a row has no score and is left out. Vectors of several lengths are an error."""
        rows = rows.where("vector is not null and size(vector) > 0")
        if metric == "cosine":
            rows = rows.where(F.exists("vector", lambda x: x != 0))
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
        if found["low"] != found["high"]:
            raise ValueError(f"vectors have {found['low']} to {found['high']} dimensions")
        name = uuid.uuid4().hex
        n = max(1, min(MOST_BALLS, -(-found["n"] // ball_rows)))
        centres = self._centres(rows, found["n"], n, metric) if found["n"] else np.zeros((1, 1))
        filed = rows.mapInArrow(_filed(centres, metric, rows.columns.index("vector")), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", ball int, away double")
        at = f"{self.folder}/{name}"
        filed.repartitionByRange("ball", self.key).sortWithinPartitions("ball").write.partitionBy("ball").parquet(f"{at}/rows")
        stored = self._stored(at, rows.schema) if found["n"] else None
        balls = [] if stored is None else [(r["ball"], centres[r["ball"]].tolist(), r["radius"], r["n"]) for r in stored.groupBy("ball").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()]
        self.spark.createDataFrame(balls, "ball int, centre array<double>, radius double, n long").coalesce(1).write.parquet(f"{at}/balls")
        write_text(self.spark, f"{self.folder}/current", json.dumps({"name": name, "metric": metric, "n": found["n"], "dims": found["low"], "schema": rows.schema.json(), "note": note}))

    def _centres(self, rows: DataFrame, n: int, k: int, metric: str) -> np.ndarray:
        """Means of a bounded sample, chosen by a hash of the key."""
        mark = F.xxhash64(self.key)
        some = rows if n <= SAMPLE else rows.where(F.pmod(mark, F.lit(n // SAMPLE + 1)) == 0)
        vector = F.col("vector").cast("array<double>")
        if metric == "cosine":
            size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
            vector = F.transform(vector, lambda x: x / size)
        if k == 1:
            one = some.select(F.posexplode(vector)).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()
            return np.array([[r["m"] for r in one]])
        model = KMeans(k=k, seed=1, maxIter=ROUNDS, initMode="random", featuresCol="v").fit(some.select(array_to_vector(vector).alias("v")))
        return np.stack([np.asarray(c) for c in model.clusterCenters()])

    def _stored(self, at: str, schema, balls: list[int] | None = None) -> DataFrame:
        """All rows, or those of some balls, of which no other folder is listed then."""
        whole = StructType([*schema.fields]).add("away", DoubleType()).add("ball", IntegerType())
        folders = [f"{at}/rows"] if balls is None else [f"{at}/rows/ball={b}" for b in balls]
        return self.spark.read.schema(whole).option("basePath", f"{at}/rows").parquet(*folders)

    def nearest(self, query: list[float], k: int, where: Column | None = None, more: DataFrame | None = None, wave: int = 4, keep: Callable[[DataFrame], DataFrame] | None = None) -> Nearest:
        """The k best rows by score, then key, of those that ``where`` holds for, with ``more`` rows (key, vector) that the index hasn't: (key, score, rank).

        ``keep`` takes rows out that are gone since the index was built, such as by a join.

        Balls are read ``wave`` at first, then twice as many each time, as long as some may hold what belongs to the result.
        """
        m = self.manifest
        schema = StructType.fromJson(json.loads(m["schema"]))
        if m["n"] and m["dims"] != len(query):
            raise ValueError(f"the query has {len(query)} dimensions instead of {m['dims']}")
        at = f"{self.folder}/{m['name']}"
        # a row for each ball, of which there is a stated number at most
        balls = self.spark.read.parquet(f"{at}/balls").collect() if m["n"] else []
        best, read = [], 0
        if more is not None:
            best = self._kept(vector_scores(more, query, self.key, m["metric"]), k)
        if balls:
            q = np.array(query, np.float64)
            bound = bounds(q, np.array([b["centre"] for b in balls]), np.array([b["radius"] for b in balls]), m["metric"]) + 1e-9
            left = [(float(bound[i]), balls[i]["ball"]) for i in np.argsort(-bound, kind="stable").tolist()]
            while left:
                least = best[k - 1]["score"] if len(best) >= k else -math.inf
                left = [x for x in left if x[0] + TIE >= least]
                now, left, wave = [b for _, b in left[:wave]], left[wave:], 2 * wave
                if not now:
                    break
                read += len(now)
                rows = self._stored(at, schema, now)
                rows = rows if where is None else rows.where(where)
                scored = vector_scores(rows if keep is None else keep(rows), query, self.key, m["metric"])
                best = self._kept(scored.unionByName(self._frame(best, schema)), k)
        return Nearest(top_k(self._frame(best, schema), k, self.key), read, len(balls))

    def _frame(self, rows: list, schema) -> DataFrame:
        return self.spark.createDataFrame([(r[self.key], r["score"]) for r in rows], f"{self.key} {schema[self.key].dataType.simpleString()}, score double")

    def _kept(self, scored: DataFrame, k: int) -> list:
        """The k best, in order."""
        return scored.select(self.key, F.col("score").cast("double").alias("score")).orderBy(F.desc("score"), F.asc(self.key)).limit(k).collect()


def _filed(centres: np.ndarray, metric: str, column: int):
    """Adds to each row the nearest centre and how far away it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (centres**2).sum(axis=1)
        for whole in batches:
            for start in range(0, len(whole), 2048):
                batch = whole.slice(start, 2048)
                if not len(batch):
                    continue
                x = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
                x = units(x) if metric == "cosine" else x
                ball = (squares - 2 * (x @ centres.T)).argmin(axis=1)
                away = np.sqrt(((x - centres[ball]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball.astype(np.int32)), pa.array(away)], names=[*batch.schema.names, "ball", "away"])

    return run
