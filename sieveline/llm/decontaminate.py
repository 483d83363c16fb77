"""Benchmark decontamination with DataFrame functions only.

The benchmark's normalised n-grams become a hash set that every task holds: inlined in the plan while it is small, a
broadcast (or, past that, shuffled) join beyond. Every window of every document is looked up by hash, and hits are
verified by their words.
"""

from __future__ import annotations

import base64
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm._shared import written

WINDOW_WORDS = 13
#: Up to so many distinct windows are inlined in the plan as a hash set; more are joined.
INLINE_WINDOWS = 20_000
#: Up to so many windows are sent to every executor; more are joined by a shuffle. A window takes some 150 bytes.
BROADCAST_WINDOWS = 500_000
#: A document is contaminated if at least one word in so many is hit.
CONTAMINATED_SHARE = 20

#: Parts of the list of inlined windows, by their hash; a window is looked up in one of them.
LISTS = 1024

_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """Maximal runs of 0-9, A-Z lower-cased, a-z and everything beyond ASCII; an empty list for null."""
    plain = F.trim(F.translate(text, _SEPARATORS + string.ascii_uppercase, " " * len(_SEPARATORS) + string.ascii_lowercase))
    return F.when(F.coalesce(F.length(plain), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(plain, " +"))


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(item, size, window, hash) of each distinct window of each item; an item of fewer than ``n`` words is one window."""
    split = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    parts = split.select("item", size.alias("size"), "w", F.explode(starts).alias("at"))
    parts = parts.select("item", "size", F.slice("w", F.col("at"), F.col("size")).alias("p"))
    return parts.select("item", "size", F.array_join("p", " ").alias("window"), F.xxhash64("p").alias("hash")).distinct()


def _kept(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is reckoned once: no filter or projection above can be merged with it and repeat it for each window."""
    return df.select("*", F.explode(F.array(value)).alias(name))


_HITS = "array<struct<at:int,size:int,hash:long,window:string>>"


def _hit(at: Column, size: Column) -> Column:
    part = F.slice("w", at, size)
    return F.struct(at.alias("at"), size.alias("size"), F.xxhash64(part).alias("hash"), F.array_join(part, " ").alias("window"))


def _window(size: int):
    return lambda i: _hit(i, F.lit(size))


def _hashed(size: int):
    return lambda i: F.xxhash64(F.slice("w", i, size))


def _inlined(split: DataFrame, rows: list) -> DataFrame:
    """Adds ``hits``, an array of (at, size, hash, window), for windows whose hash is among ``rows``."""
    by_size: dict[int, set[int]] = {}
    for r in rows:
        by_size.setdefault(r["size"], set()).add(r["hash"])
    found = []
    for size, hashes in sorted(by_size.items()):
        listed = ",".join(f"{h}L" if h > -(2**63) else "-9223372036854775807L - 1L" for h in sorted(hashes))
        at = F.expr(f"filter(sequence(1, size(w) - {size - 1}), i -> xxhash64(slice(w, i, {size})) in ({listed}))")
        hit = F.when(F.size("w") >= size, at)
        found.append(F.transform(hit, _window(size)))
    none = F.array().cast(_HITS)
    return _kept(split, "hits", F.array_sort(F.concat(none, *(F.coalesce(x, none) for x in found))))


def _row_key() -> Column:
    """Tells rows apart by id and words, whatever these hold: JSON names what is not null and marks where strings end."""
    return F.unhex(F.sha2(F.to_json(F.struct(F.col("_id").alias("id"), F.col("w").alias("w"))), 256))


def _joined(split: DataFrame, windows: DataFrame, sizes: list[int], broadcast: bool) -> DataFrame:
    """As ``_inlined`` by a join of all windows with the benchmark's; adds the rows' key, too."""
    rows = split.withColumn("row", _row_key())
    every = None
    for size in sizes:
        at = F.when(F.size("w") >= size, F.sequence(F.lit(1), F.size("w") - size + 1))
        part = rows.select("row", F.posexplode(F.transform(at, _hashed(size))).alias("at", "hash"), F.lit(size).alias("size"))
        every = part if every is None else every.unionByName(part)
    known = windows.select("hash", "size").distinct()
    met = every.join(F.broadcast(known) if broadcast else known, ["hash", "size"]).select("row", "at", "size").distinct()
    met = met.groupBy("row").agg(F.collect_list(F.struct((F.col("at") + 1).alias("at"), "size")).alias("met"))
    hits = F.transform("met", lambda h: _hit(h["at"], h["size"]))
    return rows.join(met, "row", "left").withColumn("hits", F.array_sort(F.coalesce(hits, F.array().cast(_HITS)))).drop("met")


def _listed(items: dict[tuple[int, str], list[str]]) -> str:
    """A line for each of ``LISTS`` ranges of hashes: its windows, each with its items in base64. Windows are cut by blanks alone, so no text needs escapes, and none is too long."""
    lines: list[list[str]] = [[] for _ in range(LISTS)]
    for (h, w), found in items.items():
        lines[h % LISTS].append(f"{w}\t" + ",".join("=" + base64.b64encode(x.encode("utf-8", "surrogatepass")).decode() for x in found))
    return "\n".join("\r".join(line) for line in lines)


def _items(told: Column) -> Column:
    return F.transform(F.filter(F.split(told, ","), lambda x: x != ""), lambda x: F.unbase64(F.substring(x, 2, 2**31 - 1)).cast("string"))


def _covered(hits: Column) -> Column:
    """How many word positions the windows cover; ``hits`` ascend by position."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, h: Column) -> Column:
        end = h["at"] + h["size"] - 1
        return F.struct(F.greatest(s["end"], end).alias("end"), (s["n"] + F.greatest(F.lit(0), end - F.greatest(s["end"], h["at"] - 1))).alias("n"))

    return F.aggregate(hits, start, step, lambda s: s["n"])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW_WORDS, inline: int = INLINE_WINDOWS, broadcast: int = BROADCAST_WINDOWS
) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, n_words, n_hit, n_items, items (sorted), spans, contaminated.

    spans is an array of (at, size): first word (from 1) and words of each occurrence. A null, empty or wordless text
    has no words and is clean; items without words never occur; the windows of items without an id count as hits and contaminate,
    but n_items and items leave them out; an empty benchmark leaves everything clean. Repeated
    rows each keep a row; null ids stay; further columns of either table are ignored.
    """
    windows = item_windows(benchmark, item_col, item_text_col, n)
    split = _kept(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "w", words(F.col("_text"))).drop("_text")
    rows = windows.limit(inline + 1).collect()  # a bounded look at the set's size
    none = F.array().cast("array<string>")
    if len(rows) <= inline:
        out = _inlined(split, rows)
        items: dict[tuple[int, str], list[str]] = {}
        for r in rows:
            items.setdefault((r["hash"], r["window"]), []).extend([] if r["item"] is None else [r["item"]])
        if items:
            lists = F.split(F.lit(_listed(items)), "\n")
            told = lambda h: F.element_at(F.str_to_map(F.element_at(lists, (F.pmod(h["hash"], F.lit(LISTS)) + 1).cast("int")), F.lit("\r"), F.lit("\t")), h["window"])
            out = _kept(out, "told", F.filter(F.transform("hits", lambda h: F.struct(h.alias("hit"), told(h).alias("told"))), lambda x: x["told"].isNotNull()))
            out = out.withColumn("hits", F.transform("told", lambda x: x["hit"]))
            of = F.flatten(F.transform(F.array_distinct(F.transform("told", lambda x: x["told"])), _items))
            out = out.withColumn("items", F.when(F.size("hits") > 0, F.array_sort(F.array_distinct(of))).otherwise(none))
        else:
            out = out.withColumn("items", none)
    else:
        windows = written(windows, "windows")
        small = windows.count() <= broadcast
        met = _joined(split, windows, [r["size"] for r in windows.select("size").distinct().collect()], small)
        hit = met.where(F.size("hits") > 0).select("row", F.explode(F.array_distinct(F.transform("hits", lambda h: h["window"]))).alias("window")).distinct()
        by_row = hit.join(windows.select("window", "item").distinct(), "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"), F.collect_set("window").alias("real"))
        out = met.join(by_row, "row", "left").withColumn("items", F.coalesce("items", none)).withColumn("hits", F.filter("hits", lambda h: F.array_contains("real", h["window"])))
        out = out.withColumn("hits", F.coalesce("hits", F.array().cast(_HITS)))
    counted = out.select("_id", F.size("w").cast("long").alias("n_words"), _covered(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.transform("hits", lambda h: F.struct(h["at"].alias("at"), h["size"].alias("size"))).alias("spans"))
    return counted.select(F.col("_id").alias(id_col), *counted.columns[1:], ((F.col("n_hit") > 0) & (CONTAMINATED_SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
