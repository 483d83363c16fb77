"""Secret scans with DataFrame functions only, and corpus-wide ownership of what they find.

Three patterns give the base spans. The value of each becomes a hash; the hashes are counted by distinct repositories
and owners over the whole corpus. A value that several owners hold is a widely copied example; one of a single owner
looks live, and its spans are reported once more as kind ``live``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm._shared import written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "live")
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: A value of at least so many owners is a copied example.
COPIED_OWNERS = 3

_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is reckoned once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _parts(items: Column) -> Column:
    """An array, not empty, as parts of about the square root of its size: what copies a list at each step copies a short one."""
    size = F.ceil(F.sqrt(F.size(items))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / size).cast("int") - 1), lambda p: F.slice(items, p * size + 1, size))


def _spans(text: Column, pattern: str, rank: int, group: int, least: int, maybe: Column) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has ``least`` characters, in code points.

    The pieces between the matches and the matches themselves give every position: both functions scan alike. Each part
    of the matches is placed by itself and moved by what stands before it.
    """
    between, whole, value = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    none = F.array().cast(f"array<{_SPAN}>")

    def step(s: Column, m: Column) -> Column:
        at = s["at"] + F.length(m["gap"])
        end = at + F.length(m["whole"])
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(KINDS[rank]).alias("kind"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(m["value"]) >= least, F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    def moved(s: Column, part: Column) -> Column:
        by = s["at"]
        spans = F.transform(part["spans"], lambda x: F.struct((x["start"] + by).alias("start"), x["rank"].alias("rank"), (x["end"] + by).alias("end"), x["kind"].alias("kind"), x["value"].alias("value")))
        return F.struct((by + part["at"]).alias("at"), F.concat(s["parts"], F.array(spans)).alias("parts"))

    def placed(matches: Column) -> Column:
        each = F.transform(_parts(matches), lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("spans")), step))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("parts"))
        return F.when(F.size(matches) > 0, F.aggregate(each, start, moved, lambda s: F.flatten(s["parts"]))).otherwise(none)

    matches = _bound(whole, lambda w: F.arrays_zip(F.slice(between, 1, F.size(w)).alias("gap"), w.alias("whole"), value.alias("value")))
    return F.when(maybe, _bound(matches, placed)).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.lower(text)
    keyed = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("apikey")) | F.contains(low, F.lit("api_key"))
    return F.array_sort(
        F.concat(
            _spans(text, ASSIGN, 0, 2, MIN_ASSIGN, keyed & F.rlike(text, F.lit(ASSIGN))),
            _spans(text, ACCESS, 1, 0, MIN_ACCESS, F.contains(text, F.lit("AKIA"))),
            _spans(text, HEX, 2, 0, 1, F.rlike(text, F.lit(HEX))),
        )
    )


def told(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def owner_of(repository: Column) -> Column:
    """What stands before the last slash of a repository's name, or the whole name."""
    return F.regexp_replace(repository, "/[^/]*$", "")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repositories, n_owners, n_spans, verdict) of every candidate value; ``found`` has hash, repository, owner.

    Spans of a repository are summed first, then repositories of an owner, so a value that very many hold is few rows
    when it is counted. A null repository counts as one, a null owner as none; an empty table gives an empty result.
    """
    each = found.groupBy("hash", "repository", "owner").agg(F.count(F.lit(1)).alias("n"))
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"))
    by_hash = by_owner.groupBy("hash").agg(F.sum("r").alias("n_repositories"), F.count("owner").alias("n_owners"), F.sum("n").alias("n_spans"))
    verdict = F.when(F.col("n_owners") >= COPIED_OWNERS, "copied").when(F.col("n_owners") <= 1, "live").otherwise("shared")
    return by_hash.withColumn("verdict", verdict)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source", owner: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, base (spans with their values), found (base spans and live ones, with verdicts).

    Null and empty texts have no spans. A null repository or owner counts as none, so a value seen only there looks
    live. Repeated rows each keep a row, as do null ids; an empty table gives an empty result; further columns are
    ignored. The patterns run once: their spans are written to the shared folder before values are counted.
    """
    repository = F.col(repository_col).cast("string") if repository_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), repository.alias("repository"), (owner_of(repository) if owner is None else owner).alias("owner"), base_spans(F.col(text_col)).alias("base"))
    rows = written(rows, "spans")
    some, none = rows.where(F.size("base") > 0), rows.where(F.size("base") == 0)
    some = some.withColumn("row", F.sha2(F.to_json(F.struct(F.col("_id").cast("string").alias("id"), "repository", "owner", "base")), 256))
    values = some.select("row", "repository", "owner", F.explode("base").alias("s")).withColumn("hash", F.sha2("s.value", 256))
    # rows of the same id, repository and spans get the same verdicts, so one of them stands for all
    owners = written(ownership(values).select("hash", "verdict"), "owners")  # a table, so the join can split the rows of a widely copied value
    judged = values.select("row", "s", "hash").distinct().join(owners, "hash")
    by_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.rank", "s.end", "s.kind", "verdict"))).alias("judged"))
    live = F.transform(F.filter("judged", lambda s: s["verdict"] == "live"), lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"), s["end"].alias("end"), F.lit("live").alias("kind"), s["verdict"].alias("verdict")))
    done = some.join(by_row, "row").select("_id", "base", F.array_sort(F.concat("judged", _bound(F.array_sort(live), _different))).alias("found"))
    empty = none.select("_id", "base", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,verdict:string>>").alias("found"))
    return done.unionByName(empty).withColumnRenamed("_id", id_col)


def _different(spans: Column) -> Column:
    """Sorted spans without repeats."""
    return F.filter(spans, lambda x, i: (i == 0) | (x != F.get(spans, i - 1)))


def redact(text: Column, found: Column) -> Column:
    """``text`` with every span of ``found`` replaced: overlapping spans together, copied values by [EXAMPLE], others by [SECRET].

    A null text, or no spans (an empty or null array), leaves the text as it is. Spans must ascend, as those of ``scan`` do.
    """
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def reach(s: Column, part: Column) -> Column:
        return F.struct(F.greatest(s["at"], F.array_max(F.transform(part, lambda m: m["end"]))).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts"))

    def written_out(part: Column, begin: Column) -> Column:
        """The text from ``begin`` to the end of the part's spans; positions are looked up in that stretch alone."""
        end = F.greatest(begin, F.array_max(F.transform(part, lambda m: m["end"])))
        start = F.struct(begin.alias("at"), F.array().cast("array<string>").alias("out"))

        def within(stretch: Column) -> Column:
            def step(s: Column, m: Column) -> Column:
                word = F.when(m["verdict"] == "copied", "[EXAMPLE]").otherwise("[SECRET]")
                gap = F.substring(stretch, s["at"] - begin + 1, m["start"] - s["at"])
                return F.struct(F.greatest(s["at"], m["end"]).alias("at"), F.when(m["start"] >= s["at"], F.concat(s["out"], F.array(gap, word))).otherwise(s["out"]).alias("out"))

            return F.aggregate(part, start, step, lambda s: F.array_join(s["out"], ""))

        return _bound(F.substring(text, begin + 1, end - begin), within)

    def whole(parts: Column) -> Column:
        def joined(reached: Column) -> Column:
            return F.concat(F.array_join(F.zip_with(parts, reached["starts"], written_out), ""), F.substring(text, reached["at"] + 1, F.length(text)))

        return _bound(F.aggregate(parts, first, reach), joined)

    return F.when(F.size(found) > 0, _bound(_parts(found), whole)).otherwise(text)
