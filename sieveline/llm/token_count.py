"""Token counts by overlap resynchronisation.

A huge document is cut into chunks that overlap their successors. Each chunk is encoded by itself with offsets, on any
executor. Two neighbours are spliced at a position of their overlap where both start a token and white space stands
before: the tokenizer drops white space and cuts there whatever surrounds it, so what precedes and follows is final.
A document with long runs without white space gets wider overlaps, and chunks no shorter than these, so a place is
encoded twice at most. Where two neighbours have no such position nevertheless, their document is cut again with a wider
overlap, until one chunk holds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm import _tokens
from sieveline.llm._shared import partitions, written

HUGE_CHARS = 32_768
OVERLAP_CHARS = 256
WIDER = 8
LIMIT = 2048
#: Latin letters that stay one letter in lower case.
LETTERS = _tokens.LATIN.replace(r"\x{F8}-\x{17F}", r"\x{F8}-\x{12F}\x{131}-\x{17F}")


class WordCounter:
    """Tokens of texts by a tokenizer that cuts at white space and drops it: each distinct word of a slice is encoded once."""

    #: White space to Python and Arrow, but not to the tokenizer; texts that hold one are encoded whole.
    SEPARATORS = r"[\x1c-\x1f]"

    def __init__(self, path: str):
        self.tokenizer = _tokens.tokenizer(path)

    def sizes(self, words: pa.Array) -> np.ndarray:
        """The tokens of each word. Latin letters, alone or before a stop, are one word to the tokenizer in lower case: these go through its model as they are, others through all of it."""
        low = pc.utf8_lower(words)
        alone, stopped = (pc.match_substring_regex(words, rf"\A[{LETTERS}]+{end}\z").to_numpy(zero_copy_only=False) for end in ("", "[.,;:!?]"))
        odd = ~(alone | stopped)
        ended = low.filter(pa.array(stopped))
        parts = [low.filter(pa.array(alone)), pc.utf8_slice_codeunits(ended, 0, -1), pc.utf8_slice_codeunits(ended, -1)]
        known = pa.concat_arrays(parts).dictionary_encode()
        tokenize = self.tokenizer.model.tokenize
        n = np.array([len(tokenize(w)) for w in _tokens.spelt(known.dictionary)], np.int64)[known.indices.to_numpy()]
        heads, tails = len(parts[0]), len(parts[0]) + len(parts[1])
        out = np.empty(len(words), np.int64)
        out[alone], out[stopped] = n[:heads], n[heads:tails] + n[tails:]
        left = words.filter(pa.array(odd)).to_pylist()
        out[odd] = [len(x.ids) for s in range(0, len(left), 50_000) for x in self.tokenizer.encode_batch_fast(left[s : s + 50_000], add_special_tokens=False)]
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        whole = pc.match_substring_regex(texts, self.SEPARATORS)
        cut = pc.utf8_split_whitespace(pc.if_else(whole, pa.scalar("", texts.type), texts))
        words, starts = cut.flatten().dictionary_encode(), cut.offsets.to_numpy()
        upto = _tokens.offsets_of(self.sizes(words.dictionary)[words.indices.to_numpy()])
        out = upto[starts[1:]] - upto[starts[:-1]]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[i] = len(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids)
        return out


def _small(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(path)
        for batch in batches:
            n = [counter.count(texts) for texts in _tokens.slices(_tokens.strings_of(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate([np.empty(0, np.int64), *n]))], names=["row", "n_bytes", "n_tokens"])

    return run


def overlap_for(text: str, least: int) -> int:
    """An overlap that holds white space wherever it lies: ``least``, or as many times eight as the longest run without white space takes."""
    longest = max(map(len, re.split(f"[{_tokens.WHITE}]+", text)))
    while least <= 2 * longest and least < len(text):
        least *= WIDER
    return least


def _chunks(chars: int, overlap: int):
    """Rows (row, chunk, last, start, chars, overlap, lead, text) of each document; a document that one chunk and its overlap hold is one chunk. Chunks are no shorter than overlaps, so no place is in more than two."""
    names = ["row", "chunk", "last", "start", "chars", "overlap", "lead", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                wide = overlap_for(text, overlap)
                stride = max(chars, wide)
                n = max(1, -(-(len(text) - wide) // stride))
                for i in range(n):
                    part = text[i * stride : (i + 1) * stride + wide] if i < n - 1 else text[i * stride :]
                    lead = text[i * stride - 1] if i else ""  # tells whether white space stands before the chunk
                    numbers = [pa.array([x], kind) for x, kind in ((i, pa.int32()), (n - 1, pa.int32()), (i * stride, pa.int64()), (stride, pa.int64()), (wide, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([pa.array([row]), *numbers, pa.array([lead]), pa.array([part])], names=names)

    return run


def _boundaries(path: str):
    """For each chunk its token count and the stable starts in its overlaps: positions in the document, tokens before them."""
    white = re.compile(f"[{_tokens.WHITE}]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokens.tokenizer(path)
        for batch in batches:
            texts = _tokens.strings_of(batch.column(7))
            out: dict[str, list] = {k: [] for k in ("n", "left", "left_at", "right", "right_at")}
            at = 0
            for part in _tokens.slices(texts, 500_000):
                part = part.to_pylist()
                for k, text in enumerate(part, at):
                    last, start, chars, overlap, lead = (batch.column(c)[k].as_py() for c in range(2, 7))
                    places = tokens = np.zeros(0, np.int64)
                    if last:
                        begins = np.array(tok.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)[:, 0]
                        n = len(begins)
                        places, tokens = np.unique(begins, return_index=True)
                    else:  # a whole document has no neighbour to meet
                        n = len(tok.encode_batch_fast([text], add_special_tokens=False)[0])
                    edge = (places < overlap) | (places >= chars)
                    stable = [(i, p) for i, p in zip(tokens[edge].tolist(), places[edge].tolist()) if white.match(text[p - 1] if p else lead)]
                    out["n"].append(n)
                    for side, kept in (("left", [x for x in stable if x[1] < overlap]), ("right", [x for x in stable if x[1] >= chars])):
                        out[side].append([p + start for _, p in kept])
                        out[side + "_at"].append([i for i, _ in kept])
                at += len(part)
            kinds = {"n": pa.int64(), "left": pa.list_(pa.int64()), "left_at": pa.list_(pa.int64()), "right": pa.list_(pa.int64()), "right_at": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(v, kinds[k]) for k, v in out.items())], names=["row", "chunk", "last", *out])

    return run


def _spliced(huge: DataFrame, path: str, chars: int, overlap: int) -> DataFrame:
    """(row, n_tokens) of each document; n_tokens is null where some neighbours don't align."""
    spark = huge.sparkSession
    cut = huge.select("row", "text").mapInArrow(_chunks(chars, overlap), "row string, chunk int, last int, start long, chars long, overlap long, lead string, text string")
    dealt = cut.repartition(partitions(spark), "row", "chunk")
    ends = dealt.mapInArrow(_boundaries(path), "row string, chunk int, last int, n long, left array<long>, left_at array<long>, right array<long>, right_at array<long>")
    order = Window.partitionBy("row").orderBy("chunk")
    met = ends.withColumn("next", F.lead("left").over(order)).withColumn("next_at", F.lead("left_at").over(order))
    met = met.withColumn("at", F.try_element_at(F.array_intersect("right", "next"), F.lit(1)))
    upto = F.when(F.col("chunk") == F.col("last"), F.col("n")).otherwise(F.try_element_at("right_at", F.array_position("right", F.col("at")).cast("int")))
    skip = F.when(F.col("chunk") == F.col("last"), F.lit(0)).otherwise(F.try_element_at("next_at", F.array_position("next", F.col("at")).cast("int")))
    fails = (F.col("chunk") < F.col("last")) & F.col("at").isNull()
    counted = met.select("row", fails.alias("fails"), F.when(~fails, upto - skip).alias("n"))
    return counted.groupBy("row").agg(F.when(~F.max("fails"), F.sum("n")).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, huge_chars: int = HUGE_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row for each row: ``id_col``, n_bytes, n_tokens, over_limit.

    Null and empty texts have no tokens. Rows that repeat an id keep a row each; null ids stay; an empty table gives
    an empty result; further columns are ignored. The tokenizer at ``path`` must cut at white space and drop it.
    """
    rows = docs.select(F.col(id_col).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    is_huge = F.length("text") > huge_chars
    kind = docs.schema[id_col].dataType.simpleString()
    small = rows.where(~is_huge).select("row", "text", F.octet_length("text").cast("long").alias("n_bytes")).mapInArrow(_small(path), f"row {kind}, n_bytes long, n_tokens long")
    huge = rows.where(is_huge).withColumn("id", F.col("row")).withColumn("row", F.concat_ws(":", F.col("id").cast("string"), F.sha2("text", 256)))
    huge = written(huge.withColumn("n_bytes", F.octet_length("text").cast("long")), "huge")
    done, left, wide = None, huge.dropDuplicates(["row"]), overlap
    while True:
        found = written(_spliced(left, path, huge_chars, wide), "spliced")
        good = found.where("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        bad = found.where("n_tokens is null").select("row")
        if bad.isEmpty():
            break
        left, wide = left.join(bad, "row", "left_semi"), wide * WIDER
    counted = huge.join(done, "row").select(F.col("id").alias("row"), "n_bytes", "n_tokens")
    return small.unionByName(counted).select(F.col("row").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
