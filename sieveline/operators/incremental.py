"""Incremental maintenance as joins: what changed, what came, what went, and in which batches to work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESUME_BATCH = 200


def hash_diff(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Paths whose content hash differs from the stored one, or that have none on either side. Both have (path, sha256)."""
    old = stored.select("path", F.col("sha256").alias("_old"))
    joined = now.join(old, "path", "left")
    return joined.where(F.col("_old").isNull() | F.col("sha256").isNull() | (F.col("_old") != F.col("sha256"))).select("path", "sha256")


def scope_reconcile(desired: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, status): stale if indexed and no longer desired, new if desired and not indexed."""
    a, b = desired.select("path").distinct().withColumn("_d", F.lit(True)), indexed.select("path").distinct().withColumn("_i", F.lit(True))
    both = a.join(b, "path", "full_outer")
    return both.where("_d is null or _i is null").select("path", F.when(F.col("_d").isNull(), "stale").otherwise("new").alias("status"))


def incremental_plan(desired: DataFrame, stored: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """(path, action): remove what is stale or removed, update what is new or whose hash differs, keep the rest as cached.

    ``desired`` has (path, sha256) of all files in scope, ``changed`` and ``removed`` the paths that version control names.
    """
    status = scope_reconcile(desired, stored)
    gone = status.where("status = 'stale'").select("path").unionByName(removed.select("path")).distinct()
    gone = gone.join(desired, "path", "left_anti")
    candidates = changed.select("path").unionByName(status.where("status = 'new'").select("path")).distinct()
    update = hash_diff(desired.join(candidates, "path", "left_semi"), stored).select("path")
    kept = desired.select("path").join(update, "path", "left_anti")
    return gone.withColumn("action", F.lit("remove")).unionByName(update.withColumn("action", F.lit("update"))).unionByName(kept.withColumn("action", F.lit("cached")))


def run_summary(plan: DataFrame) -> DataFrame:
    return plan.agg(*(F.count_if(F.col("action") == a).alias(n) for a, n in (("cached", "cached"), ("update", "updated"), ("remove", "removed"))))


def resume_batches(paths: DataFrame, size: int = RESUME_BATCH) -> DataFrame:
    """Adds ``batch``: paths in order, so many each. Ranks come from sorted ranges and their sizes, not from one task."""
    # a stated number of ranges: both uses of the partition's number see the same ones
    ranges = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = paths.repartitionByRange(ranges, "path").sortWithinPartitions("path").withColumn("_part", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("_part").orderBy("path"))
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = ordered.withColumn("_within", within).join(F.broadcast(before), "_part")
    return ranked.withColumn("batch", F.floor((F.col("_before") + F.col("_within") - 1) / size)).drop("_part", "_within", "_before")


def replace_by_path(stored: DataFrame, fresh: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of ``stored`` whose path isn't among ``paths``, and the fresh ones."""
    return stored.join(paths.select("path").distinct(), "path", "left_anti").unionByName(fresh)


def chunks_by_path(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce("path", F.lit("?")).alias("path")).agg(F.count(F.lit(1)).alias("n_chunks"))


def list_chunks(chunks: DataFrame, limit: int = 500, prefix: str | None = None) -> DataFrame:
    from sieveline.operators.predicates import under_prefix

    return chunks.where(under_prefix(F.col("path"), prefix)).select("path", "start_line", "end_line", "symbol").orderBy("path", "start_line", "end_line", "symbol").limit(limit)
