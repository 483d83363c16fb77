"""File events: expansion, scope, debouncing and last-event-wins, for batches and for streams."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveline.operators.predicates import in_scopes
from sieveline.schema import FILE_EVENT
from sieveline.streaming.debounce import LAST, OUTPUT, PROVIDER, Bursts
from sieveline.timing import logger

ACCEPTED = ("created", "modified", "deleted", "moved")
DEBOUNCE = "2 seconds"
#: How often a stream looks for events and ended pauses.
TRIGGER = "500 milliseconds"


def event_source(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of file events from JSON files that a watcher appends to a folder."""
    return spark.readStream.schema(FILE_EVENT).json(folder)


def expand(events: DataFrame) -> DataFrame:
    """(ts, seq, path, op): a move is a deletion of its source and an upsert of its target, before any filter looks at either."""
    kept = events.where(F.col("event_type").isin(*ACCEPTED) & ~F.col("is_directory"))
    one = F.struct(F.col("path"), F.when(F.col("event_type").isin("deleted", "moved"), "removed").otherwise("changed").alias("op"))
    two = F.struct(F.col("dest_path").alias("path"), F.lit("changed").alias("op"))
    parts = F.when((F.col("event_type") == "moved") & F.col("dest_path").isNotNull(), F.array(one, two)).otherwise(F.array(one))
    return kept.select("ts", "seq", F.explode(parts).alias("_p")).select("ts", "seq", "_p.path", "_p.op")


def indexable(path: Column, scopes: list[str] | None = None, index_dir: str | None = None, ignored: str | None = None) -> Column:
    """In scope, neither within .git nor the index, and not matched by the ignore pattern."""
    found = in_scopes(path, scopes) & ~path.rlike(r"(^|/)\.git(/|$)")
    if index_dir:
        found = found & ~in_scopes(path, [index_dir])
    return found & ~path.rlike(ignored) if ignored else found


def last_wins(ops: DataFrame, keys: list) -> DataFrame:
    """The last operation on each path among the keys' rows."""
    return ops.groupBy(*keys, "path").agg(F.max_by("op", F.struct("ts", "seq")).alias("op"))


def debounced(ops: DataFrame, gap: str = DEBOUNCE, key: Column | None = None) -> DataFrame:
    """(key, path, op), of a table also (start, end): bursts of operations that no pause of ``gap`` interrupts, each path's last operation.

    One burst spans all paths, as any event resets the pause; ``key`` makes bursts by something else. A table is cut
    into pieces of time no longer than the pause, whose operations are of one burst: bursts are found from the pieces'
    ends alone, and each path's last operation by a join with them. A stream goes by the time at which events come:
    timers end its bursts (``Bursts``), and its state has one entry for each path of an open burst.
    """
    keyed = ops.withColumn("_k", F.lit(0) if key is None else key)
    if not ops.isStreaming:
        return _bursts(keyed, gap)
    named = keyed.select(F.col("_k").cast("string").alias("key"), F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("ts"), F.coalesce("seq", F.lit(0)).alias("seq"), "path", "op")
    return named.groupBy("key").transformWithState(Bursts(milliseconds(gap)), OUTPUT, "append", "ProcessingTime")


def milliseconds(gap: str) -> int:
    """Of a pause such as ``2 seconds``."""
    n, unit = gap.split()
    return round(float(n) * {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])


def _bursts(keyed: DataFrame, gap: str) -> DataFrame:
    pieces = keyed.where("ts is not null").withColumn("_w", F.window("ts", gap)["start"])
    last = pieces.groupBy("_k", "_w", "path").agg(F.max_by("op", F.struct("ts", "seq")).alias("op"), F.max(F.struct("ts", "seq")).alias("_at"), F.min("ts").alias("_from"))
    ends = last.groupBy("_k", "_w").agg(F.min("_from").alias("_first"), F.max("_at.ts").alias("_last"))
    order = Window.partitionBy("_k").orderBy("_w")  # over the pieces, not the operations
    apart = F.col("_first") > F.lag("_last").over(order) + F.expr(f"INTERVAL {gap}")
    burst = F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(order)
    numbered = ends.withColumn("_burst", burst)
    bounds = numbered.groupBy("_k", "_burst").agg(F.min("_first").alias("start"), (F.max("_last") + F.expr(f"INTERVAL {gap}")).alias("end"))
    placed = last.join(numbered.select("_k", "_w", "_burst"), ["_k", "_w"]).groupBy("_k", "_burst", "path").agg(F.max_by("op", "_at").alias("op"))
    return placed.join(bounds, ["_k", "_burst"]).select(F.col("_k").alias("key"), "start", "end", "path", "op")


class Watch:
    """A running stream of bursts, and what its state holds."""

    def __init__(self, query: StreamingQuery, checkpoint: str, update: Callable[[DataFrame, int], None]):
        self.query, self.checkpoint, self.update = query, checkpoint, update

    def waiting(self) -> DataFrame:
        """(path, op) of the operations that are held and not told yet, as of the last finished batch."""
        spark = self.query.sparkSession if hasattr(self.query, "sparkSession") else SparkSession.active()
        try:
            held = spark.read.format("statestore").option("stateVarName", LAST).load(self.checkpoint)
        except PySparkException as e:
            if not (e.getCondition() or "").startswith("STDS_"):
                raise
            return spark.createDataFrame([], "path string, op string")  # no batch has ended yet
        return held.select(F.col("user_map_key.path").alias("path"), F.col("user_map_value.op").alias("op"))

    @property
    def pending(self) -> int:
        """Paths of open bursts."""
        return self.waiting().count()

    def settle(self, timeout: float = 60) -> None:
        """Waits until two more batches have ended, so that what had come before is taken in."""
        before, end = self._batch(), time.monotonic() + timeout
        while self.query.isActive and self._batch() < before + 2 and time.monotonic() < end:
            time.sleep(0.05)

    def _batch(self) -> int:
        return p["batchId"] if (p := self.query.lastProgress) else -1

    def flush(self) -> None:
        """Ends the stream: what has come is taken in, and if bursts are still open ``update`` is called once for them."""
        self.settle()
        self.stop()
        left = self.waiting()
        if not left.isEmpty():
            self.update(left, -1)

    def stop(self, timeout: float = 2) -> None:
        """Between two batches if that can be had in time, so that none is torn."""
        end = time.monotonic() + timeout
        while self.query.isActive and self.query.status["isTriggerActive"] and time.monotonic() < end:
            time.sleep(0.01)
        self.query.stop()

    def wait(self, timeout: float | None = None) -> bool | None:
        """Until the stream ends; an update that failed ends it with its error, and a new ``watch`` from the checkpoint repeats its batch."""
        return self.query.awaitTermination(timeout) if timeout is not None else self.query.awaitTermination()


def _beats(spark: SparkSession) -> DataFrame:
    """No operation at all, but a new offset every second: ended pauses are noticed without an event, right after a restart too."""
    beats = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load().where(F.col("value") < 0)
    return beats.select(F.col("timestamp").alias("ts"), F.col("value").alias("seq"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("op"))


def watch(events: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, gap: str = DEBOUNCE, trigger: str = TRIGGER, **scope) -> Watch:
    """Starts the stream: each burst goes to ``update`` as a batch of (path, op) once nothing has come for ``gap``. The checkpoint makes it at-least-once."""
    spark = events.sparkSession
    ops = expand(events).where(indexable(F.col("path"), **scope))
    bursts = debounced(ops.unionByName(_beats(spark)), gap)

    def told(batch: DataFrame, n: int) -> None:
        burst = batch.select("path", "op").persist()  # the state is read once, whatever is asked of the burst
        try:
            if not burst.isEmpty():
                update(burst, n)
        except Exception as e:
            logger.exception("the update after a burst failed")
            # the stream searches the text of an error in a way that long ones are too much for
            raise RuntimeError(f"{type(e).__name__}: {str(e).strip().splitlines()[0][:300] if str(e).strip() else ''}") from None
        finally:
            burst.unpersist()

    # a burst's state is of one key, and its timers need this store; a stream keeps the settings that it starts with
    settings = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        query = bursts.writeStream.foreachBatch(told).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=trigger).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return Watch(query, checkpoint, update)
