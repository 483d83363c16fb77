"""Exact best matches by BM25 without reading every posting of every term that is asked for.

The postings of a term are filed in blocks by a hash of their document, some 64 to a block, and each block, and each term,
knows the largest weight in it. Terms of a question are taken in the order of what they can add at most. Those that come
first give a score that the k-th best match has at least; once all terms that follow can't add up to it, a document that has
none of the terms before can't be among the best. So common terms are not read through: they are looked up for documents
that are still in question, in blocks whose largest weight doesn't rule them out. The result is that of scoring everything.

A question without a known term has no match, fewer matches than asked for are all told, equal scores go by the smaller key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.operators.search import B, K1, TextIndex, top_k
from sieveline.sources.shared import scratch, work_path, written

#: Postings that a block holds about; for each match wanted, postings from which the first bound comes and documents whose whole scores do.
ROWS, FIRST, LEADERS = 64, 16, 4
#: Scores are ranked by six places; what lies nearer to a bound than this is kept.
SLACK = 1e-5


def _block(key: str) -> Column:
    return F.xxhash64(key).bitwiseAND(F.expr("shiftleft(1L, bits) - 1"))


@dataclass
class BlockIndex:
    """terms (term, df, idf, top, bits) and blocks (term, block, top, postings of key and weight), both sorted by term."""

    terms: DataFrame
    blocks: DataFrame
    key: str = "doc_id"

    @classmethod
    def of(cls, index: TextIndex, key: str = "doc_id", rows: int = ROWS, k1: float = K1, b: float = B) -> "BlockIndex":
        """Of a text index as it is; documents that come later are not in it."""
        weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        weighted = index.postings.crossJoin(F.broadcast(index.corpus)).select("term", key, weight.alias("weight"), "n")  # one row of statistics
        terms = weighted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("top"), F.first("n").alias("n"))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("df") / rows))).cast("int")
        terms = terms.select("term", "df", idf.alias("idf"), "top", bits.alias("bits"))
        placed = weighted.join(terms.select("term", "bits"), "term").select("term", _block(key).alias("block"), key, "weight")
        blocks = placed.groupBy("term", "block").agg(F.max("weight").alias("top"), F.collect_list(F.struct(key, "weight")).alias("postings"))
        return cls(terms.repartitionByRange("term").sortWithinPartitions("term"), blocks.repartitionByRange("term", "block").sortWithinPartitions("term", "block"), key)

    def write(self, path: str) -> None:
        self.terms.write.parquet(f"{path}/terms")
        self.blocks.write.parquet(f"{path}/blocks")

    @classmethod
    def read(cls, spark: SparkSession, path: str, key: str = "doc_id") -> "BlockIndex":
        return cls(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/blocks"), key)

    # ---- the steps of a search ----
    def _known(self, asked: DataFrame) -> DataFrame:
        """Terms of the questions with what they add at most, what they and those after them do, and how many postings come before."""
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term")
        known = asked.select("query_id", "term").join(self.terms, "term").withColumn("bound", F.col("idf") * F.col("top"))
        after = F.sum("bound").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        before = F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return known.withColumn("rest", after).withColumn("before", before)

    def _parts(self, known: DataFrame, within: DataFrame | None) -> DataFrame:
        """(query_id, key, part): scores of the terms given alone."""
        rows = known.select("query_id", "term", "idf").join(self.blocks.select("term", "postings"), "term").select("query_id", "idf", F.inline("postings"))
        if within is not None:
            rows = rows.join(within.select(self.key), self.key, "left_semi")
        return rows.groupBy("query_id", self.key).agg(F.sum(F.col("idf") * F.col("weight")).alias("part"))

    def _least(self, parts: DataFrame, k: int, name: str) -> DataFrame:
        """(query_id, what its k-th best match has at least), for questions with so many matches."""
        best = top_k(parts.withColumnRenamed("part", "score"), k, self.key, ["query_id"])
        return best.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), (F.min("score") - SLACK).alias(name)).where(F.col("_n") == k).drop("_n")

    def _wanted(self, held: DataFrame, later: DataFrame) -> DataFrame:
        """(query_id, key, term, block, idf) of the places where documents would be for terms that weren't read for them."""
        return held.select("query_id", self.key).join(later.select("query_id", "term", "idf", "bits"), "query_id").select("query_id", self.key, "term", _block(self.key).alias("block"), "idf")

    def _opened(self, wanted: DataFrame) -> DataFrame:
        """(term, key, weight) of the blocks in which anything is wanted, each unpacked once for all questions."""
        return self.blocks.join(wanted.select("term", "block").distinct(), ["term", "block"], "left_semi").select("term", F.inline("postings"))

    def _whole(self, held: DataFrame, wanted: DataFrame, opened: DataFrame) -> DataFrame:
        found = wanted.select("query_id", self.key, "term", "idf").join(opened, ["term", self.key]).select("query_id", self.key, (F.col("idf") * F.col("weight")).alias("part"))
        return held.select("query_id", self.key, "part").unionByName(found).groupBy("query_id", self.key).agg(F.sum("part").alias("part"))

    def _steps(self, asked: DataFrame, k: int, within: DataFrame | None) -> dict[str, DataFrame]:
        """What each step leaves is a table of the shared folder, as later steps read it more than once: some rows a question, and documents still in question."""
        known = written(self._known(asked), "known")
        early = F.col("before") < FIRST * k
        first = known.where(early)
        # whole scores of those that lead by the first terms bound the k-th best from below
        leaders = top_k(self._parts(first, within).withColumnRenamed("part", "score"), LEADERS * k, self.key, ["query_id"]).withColumnRenamed("score", "part")
        leaders = written(leaders, "leaders")
        checked = self._wanted(leaders, known.where(~early))
        tried = self._opened(checked)
        least = written(self._least(self._whole(leaders, checked, tried), k, "least"), "least")
        split = known.join(least, "query_id", "left").withColumn("read", F.coalesce(F.col("rest") >= F.col("least"), F.lit(True)))
        later = split.where("not read")
        bounds = later.groupBy("query_id").agg(F.max("rest").alias("rest"), F.first("least").alias("least"))
        parts = self._parts(split.where("read"), within)
        held = parts.join(bounds, "query_id", "left").where(F.coalesce(F.col("part") + F.col("rest") >= F.col("least"), F.lit(True)))
        held = written(held, "held")
        # those that lead now bound the k-th best more sharply, and few are left to be looked up
        ahead = written(top_k(held.withColumnRenamed("part", "score"), LEADERS * k, self.key, ["query_id"]).withColumnRenamed("score", "part"), "ahead")
        checked = self._wanted(ahead, later)
        again = self._opened(checked)
        least = written(self._least(self._whole(ahead, checked, again), k, "nearer"), "nearer")
        held = held.join(least, "query_id", "left").withColumn("least", F.greatest("least", "nearer")).drop("nearer")
        held = written(held.where(F.coalesce(F.col("part") + F.col("rest") >= F.col("least"), F.lit(True))), "held")
        # what the blocks that a document would be in can add; a block that isn't there adds nothing
        places = self._wanted(held, later).join(self.blocks.select("term", "block", "top"), ["term", "block"])
        able = places.groupBy("query_id", self.key).agg(F.sum(F.col("idf") * F.col("top")).alias("more"), F.collect_list(F.struct("term", "block", "idf")).alias("at"))
        able = able.join(held, ["query_id", self.key]).where(F.col("part") + F.col("more") >= F.col("least"))
        wanted = written(able.select("query_id", self.key, F.inline("at")), "wanted")
        return {"first": first, "tried": tried, "again": again, "split": split, "held": held, "wanted": wanted, "opened": self._opened(wanted)}

    def best(self, asked: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
        """(query_id, key, score to six places, rank): the ``k`` best for each question of ``asked``, distinct (query_id, term).

        ``within`` has the keys that count; what others score bounds nothing. The search runs when it is called; its result, ``k`` rows a question, is what stays of it.
        """
        path = work_path(asked.sparkSession, "best")
        with scratch(asked.sparkSession):
            s = self._steps(asked, k, within)
            whole = self._whole(s["held"], s["wanted"], s["opened"])
            return written(top_k(whole.select("query_id", self.key, F.round("part", 6).alias("score")), k, self.key, ["query_id"]), "best", path)

    def reads(self, asked: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
        """One row: postings that are gone through for the first bound (``first``, ``tried``), for terms that are read and in blocks that are opened, and all postings of the questions' terms.

        Those of a term that is read count once for each question that reads it, as they do in ``whole``.
        """
        path = work_path(asked.sparkSession, "reads")
        with scratch(asked.sparkSession):
            s = self._steps(asked, k, within)
            count = [
                s["first"].agg(F.coalesce(F.sum("df"), F.lit(0)).alias("first")),
                s["tried"].unionByName(s["again"]).agg(F.count(F.lit(1)).alias("tried")),
                s["split"].agg(F.coalesce(F.sum(F.when(F.col("read"), F.col("df"))), F.lit(0)).alias("read"), F.coalesce(F.sum("df"), F.lit(0)).alias("whole")),
                s["opened"].agg(F.count(F.lit(1)).alias("opened")),
            ]
            return written(count[0].crossJoin(count[1]).crossJoin(count[2]).crossJoin(count[3]), "reads", path)  # one row each
