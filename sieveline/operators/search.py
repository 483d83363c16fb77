"""Retrieval: text index with BM25, vector search, their fusion, and the whole search."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.errors import EmbeddingDimensionError, ScoreColumnError
from sieveline.functions.scalar import distance, search_text
from sieveline.operators import ranking
from sieveline.operators.predicates import check_query, scope, truncate_content
from sieveline.sources.shared import scratch, work_path, written

K1, B = 1.2, 0.75
RRF = 60
TOKEN_CUT = "[^a-z0-9_]+"
DROPPED = ("vector", "search_text")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_CUT), lambda t: t != "")


def query_terms(query: str) -> list[str]:
    return sorted({t for t in re.split(TOKEN_CUT, query.lower()) if t})


def build_postings(chunks: DataFrame, key: str = "doc_id", text: Column | None = None, terms: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """postings (term, key, tf) and lengths (key, dl), from texts that are cut once into a table of the shared folder. Given ``terms``, others are dropped as they are cut."""
    text = search_text(F.col("path"), F.col("symbol"), F.col("content")) if text is None else text
    each = written(cut(chunks.withColumn("_some", text.isNotNull()), key, text, ("_some",), terms), "cut")
    postings = each.select(key, F.explode(F.arrays_zip("terms", "tfs")).alias("_t")).select(F.col("_t.terms").alias("term"), key, F.col("_t.tfs").alias("tf"))
    return postings, each.select(key, F.when(F.col("_some"), F.col("dl")).alias("dl"))  # a chunk without a text has no length


def bm25(postings: DataFrame, lengths: DataFrame, queries: DataFrame, key: str = "doc_id", k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, key, score rounded to six places); ``queries`` has distinct (query_id, term)."""
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    known = queries.join(df, "term").crossJoin(F.broadcast(stats))  # one row of statistics
    return known.join(postings, "term").join(lengths, key).groupBy("query_id", key).agg(F.round(F.sum(weight), 6).alias("score"))


@dataclass
class TextIndex:
    """postings (term, doc_id, tf, dl), terms (term, df) and one row of corpus statistics (n, avgdl), as a build stores them."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame

    def scores(self, queries: DataFrame, terms: list[str] | None = None, key: str = "doc_id", k1: float = K1, b: float = B) -> DataFrame:
        """As ``bm25``, reading the postings of the asked terms alone; given ``terms``, the scan itself skips the others."""
        postings, df = self.postings, self.terms
        if terms is not None:
            postings, df = postings.where(F.col("term").isin(terms)), df.where(F.col("term").isin(terms))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        known = queries.join(df, "term").crossJoin(F.broadcast(self.corpus))  # one row of statistics
        return known.join(postings, "term").groupBy("query_id", key).agg(F.round(F.sum(weight), 6).alias("score"))

    def _dealt(self, known: DataFrame, key: str, within: DataFrame | None) -> DataFrame:
        """Postings of the asked terms, each once for all questions that ask for it, all of a document in one task."""
        size = self.corpus.select("n").crossJoin(known.agg(F.count_distinct("query_id").alias("q"))).first()  # one row each
        tasks = max(1, min(TASKS, -(-size["n"] * size["q"] // TASK_SCORES)))
        rows = self.postings.join(known.select("term").distinct(), "term", "left_semi").repartition(tasks, key)
        return rows if within is None else rows.join(within.select(key).repartition(tasks, key), key, "left_semi")

    def best(self, asked: DataFrame, k: int, within: DataFrame | None = None, key: str = "doc_id", k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, doc_id, score, rank) of the ``k`` best for each question, of those in ``within``; ``blocks.BlockIndex`` gives the same without scoring every posting.

        Documents are scored where their postings lie, and of a task's scores its ``k`` best a question alone go on. The search runs when it is called; its result is what stays of it.
        """
        path = work_path(asked.sparkSession, "best")
        with scratch(asked.sparkSession):
            idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
            known = asked.select("query_id", "term").join(self.terms, "term").crossJoin(F.broadcast(self.corpus))  # one row of statistics
            known = written(known.select("query_id", "term", idf.alias("idf"), "avgdl"), "known")
            weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
            scored = self._dealt(known, key, within).join(known, "term").groupBy("query_id", key).agg(F.round(F.sum(weight), 6).alias("score"))
            return written(top_k(scored, k, key, ["query_id"]), "best", path)


#: Scores that a task of ``TextIndex.best`` holds about, and how many tasks there are at most; with more to score they hold more each, and spill.
TASK_SCORES, TASKS = 1 << 19, 10_000
#: Bytes of text that a task cuts at once; a longer text stands alone.
SLICE_BYTES = 2_000_000
#: Of each byte, whether words hold it; those of other characters are all above 127.
_HELD = np.array([chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789_" for b in range(256)])


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in lower case, and where each text's start among them and the last ends."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    held, at = _HELD[raw], at - at[0]
    begins, ends = held.copy(), held.copy()
    begins[1:] &= ~held[:-1]
    ends[:-1] &= ~held[1:]
    # a word ends with its text
    cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
    begins[cuts], ends[cuts - 1] = held[cuts], held[cuts - 1]
    starts = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) + 1 - starts
    upto = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(upto), pa.py_buffer(raw[held]))
    return words, np.searchsorted(starts, at)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many bytes together."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else [0]
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(at, at[start] + SLICE_BYTES, "right")) - 1)
        yield start, end
        start = end


def counted(terms: list[str] | None = None):
    """Each row's distinct words and how often it has them, from its text in lower case, which comes last; no row leaves its task. Given ``terms``, others are only counted."""
    asked = None if terms is None else pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in _slices(batch.columns[-1]):
                rows = batch.slice(start, end - start)
                words, at = _words(pc.fill_null(rows.columns[-1], ""))
                sizes = np.diff(at)
                flat = words.dictionary_encode()
                known, codes, row = max(1, len(flat.dictionary)), flat.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(rows)), sizes)
                if asked is not None:
                    wanted = pc.is_in(flat.dictionary, asked).to_numpy(zero_copy_only=False)[codes]
                    codes, row = codes[wanted], row[wanted]
                pairs, times = np.unique(row * known + codes, return_counts=True)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(pairs // known, minlength=len(rows)))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (flat.dictionary.take(pa.array(pairs % known)), pa.array(times.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(sizes.astype(np.int32)), *lists], names=[*rows.schema.names[:-1], "dl", "terms", "tfs"])

    return run


def cut(chunks: DataFrame, key: str = "doc_id", text: Column | None = None, more: tuple[str, ...] = (), terms: list[str] | None = None) -> DataFrame:
    """(key, more columns, dl, terms, tfs): the words of each chunk, counted before anything is exploded or shuffled.

    Texts go to the workers as they are, in lower case, and are cut there by their bytes, some at a time, so a task's memory doesn't grow with its rows.
    """
    text = search_text(F.col("path"), F.col("symbol"), F.col("content")) if text is None else text
    words = chunks.select(key, *more, F.lower(text).alias("words"))
    given = ", ".join(f"`{c}` {words.schema[c].dataType.simpleString()}" for c in (key, *more))
    return words.mapInArrow(counted(terms), f"{given}, dl int, terms array<string>, tfs array<int>")


def postings_of(chunks: DataFrame, key: str = "doc_id", text: Column | None = None) -> DataFrame:
    """(term, key, tf, dl), sorted by term in files that part the terms between them; a term in very many chunks spans several."""
    each = cut(chunks, key, text).select(key, "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("_t"))
    return each.select(F.col("_t.terms").alias("term"), key, F.col("_t.tfs").alias("tf"), "dl").repartitionByRange("term", key).sortWithinPartitions("term", key)


def terms_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).repartitionByRange("term").sortWithinPartitions("term")


def corpus_of(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: chunks, those without a token too, and their mean length."""
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    total = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    return n.crossJoin(total).select("n", (F.col("total") / F.when(F.col("n") > 0, F.col("n"))).alias("avgdl"))  # one row each


def top_k(scored: DataFrame, k: int, key: str = "doc_id", partition: list[str] | None = None) -> DataFrame:
    """The best by score, then key, with their ``rank``."""
    window = Window.partitionBy(*(partition or [])).orderBy(F.desc("score"), F.asc(key))
    if not partition:
        scored = scored.orderBy(F.desc("score"), F.asc(key)).limit(k)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def vector_scores(vectors: DataFrame, query: list[float], key: str = "doc_id", metric: str = "cosine") -> DataFrame:
    """(key, score rounded to four places); the query is a constant of the plan, and a vector of another length is an error."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    checked = F.when(F.size("vector") != len(query), F.raise_error(F.lit(f"a vector has not {len(query)} dimensions")).cast("array<float>")).otherwise(F.col("vector"))
    return vectors.select(key, F.round(1 - distance(checked, literal, metric), 4).alias("score")).where("score is not null")


def check_dimensions(vector: list[float], dimensions: int) -> None:
    if len(vector) != dimensions:
        raise EmbeddingDimensionError(f"{len(vector)} components instead of {dimensions}")


def extract_score(hits: DataFrame) -> DataFrame:
    """One ``score``, rounded to four places: the fused one as it is, a distance turned round. Internal columns go."""
    if "_relevance_score" in hits.columns:
        score, mode = F.col("_relevance_score"), "hybrid"
    elif "_distance" in hits.columns:
        score, mode = 1 - F.col("_distance"), "vector"
    else:
        raise ScoreColumnError("neither a fused score nor a distance")
    out = hits.withColumn("score", F.round(score.cast("double"), 4)).withColumn("search_mode", F.lit(mode))
    return out.drop("_relevance_score", "_distance", "_score", *DROPPED)


def fuse(legs: list[DataFrame], key: str = "doc_id", partition: list[str] | None = None, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of ranked legs; a leg that lacks a row adds nothing to it."""
    keys = [*(partition or []), key]
    parts = [leg.select(*keys, (1.0 / (constant + F.col("rank"))).alias("part")) for leg in legs]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*keys).agg(F.round(F.sum("part"), 4).alias("score"))


def finish(ranked: DataFrame, k: int, partition: list[str] | None = None, rules=ranking.DEFAULT_RULES) -> DataFrame:
    """Boost, truncate, drop enclosing hits, trim to ``k``, tier. ``ranked`` has chunk columns, score and rank."""
    hits = truncate_content(ranking.boost(ranked, rules, partition))
    left = ranking.drop_enclosing(hits, partition)
    window = Window.partitionBy(*(partition or [])).orderBy("rank")
    trimmed = left.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    return ranking.relevance_tiers(trimmed, partition)


def search(chunks: DataFrame, vectors: DataFrame, query: str | None, query_vector: list[float], k: int = 5, prefix: str | None = None, aliases: list[str] | None = None, include_tests: bool = True, hybrid: bool = True, metric: str = "cosine", index: TextIndex | None = None, nearest: Callable[[int], DataFrame] | None = None) -> DataFrame:
    """The whole search. ``chunks`` has doc_id and the chunk columns, ``vectors`` doc_id and vector; ``index`` is the stored text index, else the texts are cut anew.

    ``nearest`` gives so many of the nearest chunks in scope, ranked, where an index of vectors can; else all vectors are read.

    Scope and test filters hold within each leg, before ranks are given; both legs return twice as many as asked for.
    """
    check_query(query)
    wide = 2 * k
    found = chunks.where(scope(F.col("path"), prefix, aliases, include_tests))
    ids = found.select("doc_id")
    legs = [nearest(wide) if nearest is not None else top_k(vector_scores(vectors.join(ids, "doc_id", "left_semi"), query_vector, metric=metric), wide)]
    if hybrid and query is not None:
        terms = query_terms(query)
        # corpus statistics come from the whole index, ranks from what is in scope
        asked = chunks.sparkSession.createDataFrame([("q", t) for t in terms], "query_id string, term string")
        scored = index.scores(asked, terms) if index is not None else bm25(*build_postings(chunks, terms=terms), asked)
        legs.append(top_k(scored.drop("query_id").join(ids, "doc_id", "left_semi"), wide))
        fused = top_k(fuse(legs), wide)
    else:
        fused = legs[0]
    ranked = found.join(fused, "doc_id").withColumn("search_mode", F.lit("hybrid" if len(legs) > 1 else "vector"))
    return finish(ranked, k)


def batch_search(chunks: DataFrame, queries: DataFrame, k: int = 5, prefix: str | None = None, aliases: list[str] | None = None, include_tests: bool = True, index=None) -> DataFrame:
    """Text search for every row of ``queries`` (query_id, query) at once; one ranked result set each. ``index`` is a ``TextIndex`` or a ``BlockIndex``."""
    found = chunks.where(scope(F.col("path"), prefix, aliases, include_tests))
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    if index is not None:
        leg = index.best(asked, 2 * k, found.select("doc_id"))
    else:
        leg = top_k(bm25(*build_postings(chunks), asked).join(found.select("doc_id"), "doc_id", "left_semi"), 2 * k, partition=["query_id"])
    fused = top_k(fuse([leg], partition=["query_id"]), 2 * k, partition=["query_id"])
    return finish(found.join(fused, "doc_id").withColumn("search_mode", F.lit("text")), k, ["query_id"])
