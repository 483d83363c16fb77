"""Language ID of mixed-language text.

Character trigrams of words, learnt from labelled documents, score each word for each language; a word's script first
narrows the languages to those written in it. Viterbi over a text's words, with a penalty for each switch, labels its
spans; the language with most letters is the text's.

Words are the letters of white-space separated tokens, cut where the script changes; scripts that are written without
spaces are cut into short runs. Trigrams are counted by hash in a fixed number of buckets, so the model's size follows
from the number of languages alone and nothing that was seen is left out.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import _tokens

#: Labelled documents to learn from, about (chosen by a hash).
TRAIN_DOCS = 20_000
#: Buckets that trigrams are counted in.
BUCKETS = 1 << 18
SMOOTHING = 0.5
SWITCH_PENALTY = 12.0
#: A language is a candidate for a script that holds at least so large a share of its letters.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
HELD_OUT_FOLDS = 5
#: Languages whose counts a task holds at once.
LANGS_AT_ONCE = 32

#: First code point of ranges of letters, and the script: fixed values of the Unicode blocks.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
_STARTS = [s for s, _ in SCRIPTS]
_NAMES = tuple(n for _, n in SCRIPTS)
#: Scripts written without spaces, and the letters of a word in them.
UNSPACED = frozenset(("han", "kana", "thai", "lao", "burmese", "tibetan"))
RUN_LETTERS = 4


def script_of(letter: str) -> str:
    at = bisect_right(_STARTS, ord(letter)) - 1
    return _NAMES[at] if at >= 0 else "other"


def units(letters: str) -> list[str]:
    """The words of a token's letters: runs of one script, short ones where it has no spaces."""
    out: list[str] = []
    for script, run in groupby(letters, script_of):
        word = "".join(run)
        out += [word[i : i + RUN_LETTERS] for i in range(0, len(word), RUN_LETTERS)] if script in UNSPACED else [word]
    return out


@dataclass
class Words:
    """Distinct words of some texts, and which of them each text holds in order."""

    letters: np.ndarray
    script: np.ndarray
    buckets: np.ndarray
    bucket_starts: np.ndarray
    codes: np.ndarray
    starts: np.ndarray


def words_of(texts: pa.Array) -> Words:
    tokens = pc.utf8_split_whitespace(texts)
    known, cuts = tokens.flatten().dictionary_encode(), tokens.offsets.to_numpy().astype(np.int64)
    bare = pc.replace_substring_regex(pc.utf8_lower(known.dictionary), r"\PL+", "")
    plain = pc.match_substring_regex(bare, rf"\A[{_tokens.LATIN}]+\z").to_numpy(zero_copy_only=False)
    odd = np.flatnonzero(~plain & (pc.binary_length(bare).to_numpy() > 0))
    lists = [units(x) for x in bare.take(pa.array(odd)).to_pylist()]
    sizes = plain.astype(np.int64)
    sizes[odd] = np.fromiter(map(len, lists), np.int64, len(lists))
    found = pa.concat_arrays([bare.filter(pa.array(plain)), pa.array([w for x in lists for w in x], bare.type)]).dictionary_encode()
    number, first = found.indices.to_numpy().astype(np.int64), _tokens.offsets_of(sizes)[:-1]
    in_token = np.empty(len(number), np.int64)
    in_token[first[plain]] = number[: int(plain.sum())]
    in_token[_tokens.ragged(np.arange(len(number)), first[odd], sizes[odd])] = number[int(plain.sum()) :]
    token = known.indices.to_numpy()
    codes, starts = _tokens.ragged(in_token, first[token], sizes[token]), _tokens.offsets_of(sizes[token])[cuts]
    letters = pc.utf8_length(found.dictionary).to_numpy().astype(np.int64)
    padded = np.frombuffer("".join([f"^{w}$" for w in found.dictionary.to_pylist()]).encode("utf-32-le"), "<u4").astype(np.uint64)
    at = _tokens.ragged(np.arange(len(padded)), _tokens.offsets_of(letters + 2)[:-1], letters)  # where each trigram starts
    h = ((padded[at] << np.uint64(42)) ^ (padded[at + 1] << np.uint64(21)) ^ padded[at + 2]) * np.uint64(0x9E3779B97F4A7C15)
    buckets = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    script = np.array([*_NAMES, "other"])[np.searchsorted(_STARTS, padded[_tokens.offsets_of(letters + 2)[:-1] + 1].astype(np.int64), "right") - 1]
    return Words(letters, script, buckets, _tokens.offsets_of(letters), codes, starts)


@dataclass
class Model:
    """Languages, the row of each bucket, log probabilities (row 0 of trigrams never seen; by language), scripts of each language."""

    langs: list[str]
    rows: np.ndarray
    logp: np.ndarray
    scripts: dict[str, np.ndarray]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, what, n): trigrams by bucket, and letters by script, whose numbers are -1 and below."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def told() -> pa.RecordBatch:
        rows = [(lang, np.concatenate([np.flatnonzero(grams), -1 - np.flatnonzero(scripts)]), np.concatenate([grams[grams > 0], scripts[scripts > 0]])) for lang, (grams, scripts) in held.items()]
        held.clear()
        what, n = (np.concatenate([np.empty(0, np.int64), *(r[j] for r in rows)]) for j in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows for _ in r[1]], pa.string()), pa.array(what.astype(np.int32)), pa.array(n)], names=["lang", "what", "n"])

    for batch in batches:
        for lang in pc.unique(batch.column(0)).to_pylist():
            for texts in _tokens.slices(batch.column(1).filter(pc.equal(batch.column(0), lang))):
                words = words_of(texts)
                times = np.bincount(words.codes, minlength=len(words.letters))
                if lang not in held and len(held) == LANGS_AT_ONCE:
                    yield told()
                grams, scripts = held.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(set(_NAMES)), np.int64)))
                grams += np.bincount(words.buckets, np.repeat(times, words.letters), BUCKETS).astype(np.int64)
                scripts += np.bincount(np.searchsorted(sorted(set(_NAMES)), words.script), times * words.letters, len(scripts)).astype(np.int64)
    yield told()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Learns from text and label of the documents that aren't held out; ``train_docs`` bounds their number on average.

    Rows without a text or a label teach nothing, rows that repeat count as often; rows without an id are not held out.
    An empty table, or one without labels, gives a model without languages; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null").where(~held_out(F.col("i")))
    chosen = threshold(rows.count(), train_docs)
    if chosen is not None:
        rows = rows.where(F.xxhash64("i", "text").bitwiseAND(2**63 - 1) < chosen)
    counts = rows.where("text is not null").select("lang", "text").mapInArrow(_counted, "lang string, what int, n long").groupBy("lang", "what").agg(F.sum("n").alias("n"))
    return model_of([(r["lang"], r["what"], r["n"]) for r in counts.where(F.col("lang") != UNKNOWN).collect()])


def threshold(labelled: int, train_docs: int) -> int | None:
    """Of so many labelled rows those teach whose 63-bit hash lies below; None if all do."""
    return None if labelled <= train_docs else (train_docs << 63) // labelled


def model_of(counts: list[tuple[str, int, int]]) -> Model:
    langs = sorted({lang for lang, _, _ in counts})
    used = sorted({what for _, what, _ in counts if what >= 0})
    rows = np.zeros(BUCKETS, np.int32)
    rows[used] = np.arange(1, len(used) + 1)
    seen = np.full((len(used) + 1, len(langs)), SMOOTHING)
    names, scripts = sorted(set(_NAMES)), np.zeros((len(set(_NAMES)), len(langs)), np.int64)
    for lang, what, n in counts:
        if what >= 0:
            seen[rows[what], langs.index(lang)] += n
        else:
            scripts[-1 - what, langs.index(lang)] += n
    if not langs:
        return Model([], rows, seen.astype(np.float32), {})
    logp = np.log(seen / seen.sum(axis=0))
    written_in = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(axis=0))
    return Model(langs, rows, (logp - logp.mean(axis=1, keepdims=True)).astype(np.float32), {n: written_in[i] for i, n in enumerate(names) if written_in[i].any()})


def scores_of(model: Model, words: Words) -> np.ndarray:
    """The score of each word for each language."""
    if not len(words.letters):
        return np.zeros((0, len(model.langs)), np.float32)
    scores = np.add.reduceat(model.logp[model.rows[words.buckets]], words.bucket_starts[:-1], axis=0)
    for name in np.unique(words.script).tolist():
        at, known = np.flatnonzero(words.script == name), model.scripts.get(name)
        if known is None:
            scores[at] = 0
        elif not known.all():
            scores[np.ix_(at, ~known)] = scores[at].min(axis=1, keepdims=True) - 4 * SWITCH_PENALTY
    return scores


def viterbi(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The label of each word on the best path, where each switch costs ``penalty``; ties go to the first language.

    A text mostly stays with the best single language, which needs no walk to be sure of. Say no stretch of words
    favours another language over it by more than the penalty. Then j stretches elsewhere between, before or after
    words of that language gain no more than their j switches or more cost. And j stretches that cover the text cost
    j - 1 switches, while the inner ones gain a penalty each at most: they win only if the first and the last, which
    start and end the text, gain more than one penalty together.
    """
    n, langs = scores.shape
    scores = scores.astype(np.float64)
    best = int(scores.sum(axis=0).argmax())
    sums = np.cumsum(scores - scores[:, [best]], axis=0)
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, langs)), sums[:-1]]), axis=0)
    if (sums - low).max() <= penalty and sums.max() + (sums[-1] - sums).max() <= penalty:
        return np.full(n, best, np.int32)
    came: list[list[int]] = []
    total, own = [0.0] * langs, list(range(langs))
    for s in scores.tolist():
        most = max(total)
        top, least = total.index(most), most - penalty
        came.append([k if total[k] >= least else top for k in own])
        total = [(t if t >= least else least) + x for t, x in zip(total, s)]
    out = np.empty(n, np.int32)
    at = total.index(max(total))
    for i in range(n - 1, -1, -1):
        out[i] = at
        at = came[i][at]
    return out


def label(scores: np.ndarray, letters: np.ndarray, langs: list[str]) -> tuple[str, float, list[tuple[int, int, str]]]:
    """Language, its share of the letters, and spans (first word, last word exclusive, language) of a text, given its words' scores and letters."""
    if not langs or not len(letters):
        return UNKNOWN, 0.0, []
    path = viterbi(scores)
    share = np.bincount(path, weights=letters, minlength=len(langs))
    best = int(share.argmax())
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return langs[best], float(share[best] / share.sum()), [(a, b, langs[path[a]]) for a, b in pairwise(cuts)]


def _labelled(model: Model):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _tokens.slices(_tokens.strings_of(batch.column(1))):
                words = words_of(texts)
                scores, letters = scores_of(model, words), words.letters
                codes = [words.codes[a:b] for a, b in pairwise(words.starts.tolist())]
                out = [label(scores[c], letters[c], model.langs) for c in codes]
                spans = [[{"start": a, "end": b, "lang": lang} for a, b, lang in o[2]] for o in out]
                columns = [batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())]
                columns += [pa.array([int(letters[c].sum()) for c in codes], pa.int64()), pa.array(spans, kind)]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=["row", "held_out", "lang_pred", "score", "letters", "spans"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: ``id_col``, held_out, lang_pred, score, letters, spans of words.

    A null text, and one without letters (of the Unicode category L), is ``und`` with score 0, no letters and no spans.
    So is, letters aside, every text when nothing was learnt. Ties go to the first language in order of names. Rows may repeat; null ids stay and count as not held out; an empty table gives an empty result; further
    columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("row"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    out = rows.mapInArrow(_labelled(model), f"row {kind}, held_out boolean, lang_pred string, score double, letters long, spans array<struct<start:int,end:int,lang:string>>")
    return out.withColumnRenamed("row", id_col)
