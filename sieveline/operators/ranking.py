"""What happens to ranked hits: boosting, containment dedup, relevance tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Path patterns and factors: fixed values of the default configuration.
DEFAULT_RULES = (
    (r"(^|/)tests?/", 0.5),
    (r"(^|/)(test[^/]*|[^/]*_test)\.py$", 0.5),
    (r"(^|/)conftest\.py$", 0.4),
    (r"\.(spec|test)\.(js|jsx|ts|tsx)$", 0.5),
    (r"(^|/)src/", 1.1),
)
TIER_DROP = 0.5


def boost_factor(path: Column, rules=DEFAULT_RULES) -> Column:
    """The product of the factors of all rules whose pattern the path matches."""
    out = F.lit(1.0)
    for pattern, factor in rules:
        out = out * F.when(path.rlike(pattern), float(factor)).otherwise(1.0)
    return out


def boost(hits: DataFrame, rules=DEFAULT_RULES, partition: list[str] | None = None) -> DataFrame:
    """Keeps the score as ``raw_score``, multiplies it, and ranks anew; ties keep their order. ``hits`` has ``rank`` and ``score``."""
    window = Window.partitionBy(*(partition or [])).orderBy(F.desc("score"), F.asc("_before"))
    boosted = hits.withColumn("raw_score", F.col("score")).withColumn("score", F.col("score") * boost_factor(F.col("path"), rules)).withColumnRenamed("rank", "_before")
    return boosted.withColumn("rank", F.row_number().over(window)).drop("_before")


def drop_enclosing(hits: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """Drops each hit that encloses another of its file; of equal spans the last ranked stays. ``rank`` differs within a file.

    A sweep over each file's spans by falling start, then rising end, then falling rank: whatever a hit encloses comes
    before it, so it goes if the least end so far isn't beyond its own. No pairs are made, and which hits stay doesn't
    depend on the order in which they came. A hit without a file, a start or an end encloses nothing.
    """
    keys = [*(partition or []), "path"]
    before = Window.partitionBy(*keys).orderBy(F.desc("start_line"), F.asc("end_line"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    encloses = F.min("end_line").over(before) <= F.col("end_line")
    for c in (*keys, "start_line"):
        encloses = encloses & F.col(c).isNotNull()
    return hits.withColumn("_encloses", F.coalesce(encloses, F.lit(False))).where(~F.col("_encloses")).drop("_encloses")


def relevance_tiers(hits: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """Adds ``relevance``: high, medium, low; a score under half its predecessor's starts the next tier."""
    window = Window.partitionBy(*(partition or [])).orderBy("rank")
    before = F.lag("score").over(window)
    drop = F.when((before > 0) & (F.col("score") / before < TIER_DROP), 1).otherwise(0)
    tier = F.sum("_drop").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return hits.withColumn("_drop", drop).withColumn("_tier", tier).withColumn("relevance", F.when(F.col("_tier") == 0, "high").when(F.col("_tier") == 1, "medium").otherwise("low")).drop("_drop", "_tier")
