"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import bpe_transducer, decontaminate, golay_simhash, language_id, secret_scan
from sieveline.llm._shared import delete, scratch, work_path, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds ``_key``, the SHA-256 of all columns, each with its length and nulls apart: rows share it only if they are the same throughout."""
    told = (F.col(c).cast("string") for c in COLUMNS)
    return docs.withColumn("_key", F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in told)), 256))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter (no text, too) have no language and go; the rest stays as it is, whatever its label or id, null and repeated ids too, and even if no row has a label."""
    rows = _keyed(docs)
    found = language_id.identify(rows, language_id.train(docs), id_col="_key")
    rejected = found.where("letters = 0").select("_key").distinct()
    return rows.join(rejected, "_key", "left_anti").select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (linked by a Jaccard similarity of 0.8 of five-word shingles) the document with the smallest id stays.

    SimHash groups come first and are verified; as 64 bits lose most such pairs, the others are joined exactly. Documents
    without an id come after those with one; of one id, and of rows that are the same in all columns, one row stays.
    Texts without words (a null one, too) are copies of each other; an empty table stays empty.
    """
    # rows that are the same go first, so that the others can be told by numbers, which a table keeps as they are
    rows = written(_keyed(docs).dropDuplicates(["_key"]).withColumn("_n", F.monotonically_increasing_id()), "rows")
    groups = golay_simhash.near_copies(rows, "_n")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key", "_n")
    best = rows.select("_n", "_key", "doc_id").join(groups, "_n").groupBy("component").agg(F.min(first).alias("first")).select(F.col("first._n").alias("_n"))
    return rows.join(best, "_n", "left_semi").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated rows go, whatever their id; others of the same id stay, as do texts without words and every row if the benchmark is empty."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _keyed(docs)
    gone = decontaminate.decontaminate(rows, benchmark, id_col="_key").where("contaminated").select("_key").distinct()
    return rows.join(gone, "_key", "left_anti").select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced: widely copied ones by [EXAMPLE], others by [SECRET]; every row stays, null ids, null texts and repeats included. n_chars follows the text and stays as it is where that is null."""
    keyed = _keyed(docs)
    found = secret_scan.scan(keyed, id_col="_key").where(F.size("base") > 0).select("_key", "found").dropDuplicates(["_key"])
    joined = keyed.join(found, "_key", "left")
    text = F.when(F.col("found").isNotNull(), secret_scan.redact(F.col("text"), F.col("found"))).otherwise(F.col("text"))
    return joined.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text that is left, with digests of the ids and of what they decode to; a row for each row, an empty text has no ids."""
    return bpe_transducer.encode(docs, TOKENIZER)


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("BPE encoding and decoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of ``documents``. Each stage's result is a table; what it needed on the way is deleted with its predecessor's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for _, stage in STAGES[:-1]:
        path = work_path(spark, "stage")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), "", path)
        if last:
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: Words are hashed with XXH64, languages predicted and ids merged in ways that SQL doesn't have; tests hold the stages against brute force.
ORACLE_SQL = None
