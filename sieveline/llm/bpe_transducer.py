"""BPE encoding and decoding with a minimal acyclic transducer.

The corpus's most frequent words (pre-tokens) and their ids are compiled into a minimal acyclic automaton over bytes
with shared suffixes. Each edge carries how many words precede it, so a walk ends at a word's number, which points to
its ids. The automaton is one file in the shared folder that workers map into memory. Words it lacks are merged exactly.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm import _tokens
from sieveline.llm._shared import mapped, work_path, written

LEXICON_WORDS = 50_000
#: Words up to so many bytes are merged together, in blocks of so many of like length; longer ones one by one.
TOGETHER_BYTES, BLOCK_WORDS = 64, 8_192
#: Ids that are written out at once; a text of more is hashed by parts.
IDS_AT_ONCE = 20_000_000
#: Distinct words that a task counts before it sends their counts on.
COUNTED_WORDS = 500_000


class Merger:
    """Exact BPE over the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.vocab: dict[str, int] = model["model"]["vocab"]
        symbols = _tokens.byte_symbols()
        self.byte_ids = [self.vocab[s] for s in symbols]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # the id that each rank's merge makes
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.vocab[a], self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        back = {s: b for b, s in enumerate(symbols)}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in self.vocab.items() if all(c in back for c in s)}
        for t in model["added_tokens"]:
            self.bytes_of[t["id"]] = t["content"].encode()
        pairs = np.array([(a << 32) | b for a, b in self.ranks], np.int64)
        order = np.argsort(pairs)
        self._pairs, self._rank_of = pairs[order], np.fromiter(self.ranks.values(), np.int64, len(pairs))[order]
        self._bytes, self._made = np.array(self.byte_ids, np.int64), np.array(self.made, np.int64)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of lowest rank, leftmost first, is merged until none is left."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > 200:
            return self._merge_long(ids)
        get, none, made = self.ranks.get, len(self.made), self.made
        ranks = [get(p, none) for p in pairwise(ids)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def merge_all(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, given as runs of bytes, and how many each has: words of like length merge together, a pair each at a time."""
        out: list[np.ndarray] = [np.empty(0, np.int64)]
        counts, order = np.zeros(len(sizes), np.int64), np.argsort(sizes, kind="stable")
        short = int(np.searchsorted(sizes[order], TOGETHER_BYTES, "right"))
        for s in range(0, short, BLOCK_WORDS):
            rows = order[s : min(short, s + BLOCK_WORDS)]
            ids, counts[rows] = self._merge_block(raw, starts[rows], sizes[rows])
            out.append(ids)
        for i in order[short:].tolist():
            ids = self.merge(raw[starts[i] : starts[i] + sizes[i]].tobytes())
            counts[i] = len(ids)
            out.append(np.array(ids, np.int64))
        first = np.empty(len(sizes), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return _tokens.ragged(np.concatenate(out), first, counts), counts

    def _merge_block(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, width, none = len(sizes), int(sizes.max(initial=1)) + 1, len(self.made)
        used = np.arange(width) < sizes[:, None]
        ids = np.full(m * width, -1, np.int64)
        ids[used.reshape(-1)] = self._bytes[_tokens.ragged(raw, starts, sizes)]
        after, before = np.arange(1, m * width + 1), np.arange(-1, m * width - 1)

        def ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            pair = (ids[a] << 32) | ids[b]
            at = np.minimum(np.searchsorted(self._pairs, pair), none - 1)
            return np.where((ids[a] >= 0) & (ids[b] >= 0) & (self._pairs[at] == pair), self._rank_of[at], none)

        ranks = np.full(m * width, none, np.int64)
        inner = np.flatnonzero(used[:, 1:].reshape(-1))
        inner += inner // (width - 1)  # places that have a successor within their word
        if not len(inner) or not none:
            return ids[used.reshape(-1)], sizes
        ranks[inner] = ranked(inner, inner + 1)
        table, rows = ranks.reshape(m, width), np.arange(m)
        while len(rows):
            place = table[rows].argmin(axis=1)
            at = rows * width + place  # the leftmost pair of the lowest rank
            more = ranks[at] < none
            rows, at = rows[more], at[more]
            gone = after[at]
            ids[at] = self._made[ranks[at]]
            ids[gone] = -1
            ranks[gone] = none
            after[at] = after[gone]
            before[after[at]] = at  # the last place of a row is never used, so there always is a next one
            ranks[at] = ranked(at, after[at])
            left = before[at]
            has = at % width > 0
            ranks[left[has]] = ranked(left[has], at[has])
        table = ids.reshape(m, width)
        return ids[ids >= 0], (table >= 0).sum(axis=1)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a queue of pairs, for words of any length."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and (rank := self.ranks.get((ids[i], ids[j]))) is not None:
                heapq.heappush(queue, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i] = self.made[rank]
            ids[j] = -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]


def compile_automaton(lexicon: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the minimal acyclic automaton of the words, and their ids by word number (in byte order)."""
    known: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, target), ...)), children before parents

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    words = sorted(lexicon)
    path: list[list] = [[False, []]]  # open nodes along the last word
    last = b""
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for depth in range(len(last), same, -1):
            path[depth - 1][1].append((last[depth - 1], settle(path.pop())))
        for _ in word[same:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], settle(path.pop())))
    root = settle(path[0])
    below = np.zeros(len(states), np.int64)
    keys, targets, skipped = [], [], []
    for s, (final, edges) in enumerate(states):
        seen = int(final)
        for label, target in edges:
            keys.append(s * 256 + label)
            targets.append(target)
            skipped.append(seen)
            seen += int(below[target])
        below[s] = seen
    ids = [lexicon[w] for w in words]
    return {
        "keys": np.array(keys, np.int64),
        "targets": np.array(targets, np.int64),
        "skipped": np.array(skipped, np.int64),
        "final": np.array([f for f, _ in states], np.int64),
        "root": np.array([root], np.int64),
        "starts": np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int64),
        "ids": np.array([x for y in ids for x in y], np.int64),
    }


def save(arrays: dict[str, np.ndarray], uri: str) -> None:
    """One file: sizes as JSON in the first 4096 bytes, then the arrays."""
    head = json.dumps({k: len(v) for k, v in arrays.items()}).encode().ljust(4096)
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(head + b"".join(v.astype("<i8").tobytes() for v in arrays.values()))


class Transducer:
    """The compiled words of a file, mapped into memory where the shared folder is mounted."""

    def __init__(self, uri: str):
        raw = mapped(uri)
        sizes = json.loads(bytes(raw[:4096]))
        raw, at = np.asarray(raw[4096:]).view("<i8"), 0
        for name, n in sizes.items():
            setattr(self, name, raw[at : at + n])
            at += n

    def numbers(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """Each word's number, or -1: all words walk together, a byte at a time."""
        raw, starts = _tokens.raw_of(words if isinstance(words, pa.Array) else pa.array(words, pa.binary()))
        sizes, starts = np.diff(starts), starts[:-1]
        alive = np.argsort(-sizes, kind="stable")
        state, number = np.full(len(words), int(self.root[0])), np.zeros(len(words), np.int64)
        for at in range(int(sizes.max(initial=0))):
            alive = alive[(sizes[alive] > at) & (state[alive] >= 0)]
            if not len(alive) or not len(self.keys):
                state[alive] = -1
                break
            key = state[alive] * 256 + raw[starts[alive] + at]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[edge] == key
            number[alive] += np.where(found, self.skipped[edge], 0)
            state[alive] = np.where(found, self.targets[edge], -1)
        ok = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        return np.where(ok, number, -1)

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


class WordEncoder(_tokens.Encoder):
    """Words are looked up in the transducer, and merged if it lacks them."""

    def __init__(self, path: str, lexicon: str):
        super().__init__(path)
        self.transducer, self.merger = Transducer(lexicon), merger(path)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        number = self.transducer.numbers(words)
        known, unseen = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        raw, at = _tokens.raw_of(words)
        merged, counts = self.merger.merge_all(raw, at[unseen], np.diff(at)[unseen])
        t = self.transducer
        ids = np.concatenate([t.ids, merged]).astype(np.int32)
        starts, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        starts[known], sizes[known] = t.starts[number[known]], np.diff(t.starts)[number[known]]
        starts[unseen], sizes[unseen] = len(t.ids) + np.cumsum(counts) - counts, counts
        return _tokens.ragged(ids, starts, sizes), _tokens.offsets_of(sizes)


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def told() -> list[pa.RecordBatch]:
            whole = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            held.clear()
            return whole.cast(pa.schema([("word", pa.binary()), ("n", pa.int64())])).combine_chunks().to_batches()

        for batch in batches:
            for texts in _tokens.slices(_tokens.strings_of(batch.column(0))):
                found = _tokens.cut(texts, path)
                n = found.counts()
                held.append(pa.table({"word": found.words, "n": n}).filter(pa.array(n > 0)))
                size += len(held[-1])
                if size > COUNTED_WORDS:
                    yield from told()
                    size = 0
        if held:
            yield from told()

    return run


def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", words: int = LEXICON_WORDS) -> str:
    """Counts the words of all texts, compiles the most frequent, ``words`` at most (all or none of those with equal counts), and returns the file's address."""
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counted(path), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "words")
    # the least count at which no more than so many words are left; there are few different counts
    steps = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    least = sizes.withColumn("upto", F.sum("words").over(steps)).where(F.col("upto") <= words).agg(F.min("n")).first()[0]
    top = counts.where(F.col("n") >= least).collect() if least is not None else []
    bpe = merger(path)
    uri = work_path(docs.sparkSession, "lexicon") + "/words.bin"
    save(compile_automaton({bytes(r["word"]): bpe.merge(bytes(r["word"])) for r in top if r["word"]}), uri)
    return uri


def _written_out(ids: np.ndarray, starts: np.ndarray, table: pa.Array, skip: int) -> Iterator[Iterator[memoryview]]:
    """For each text the bytes that its ids stand for, without the first ``skip``, in parts that memory holds."""
    done = 0
    while done < len(starts) - 1:
        end = max(done + 1, int(np.searchsorted(starts, starts[done] + IDS_AT_ONCE, "right")) - 1)
        if starts[end] - starts[done] <= IDS_AT_ONCE:
            found = table.take(pa.array(ids[starts[done] : starts[end]]))
            raw, at = _tokens.raw_of(found)
            cuts = at[starts[done : end + 1] - starts[done]].tolist()
            view = memoryview(raw)
            for a, b in pairwise(cuts):
                yield iter((view[min(a + skip, b) : b],))
        else:
            yield _parts(ids[starts[done] : starts[end]], table, skip)
        done = end


def _parts(ids: np.ndarray, table: pa.Array, skip: int) -> Iterator[memoryview]:
    for s in range(0, len(ids), IDS_AT_ONCE):
        raw, at = _tokens.raw_of(table.take(pa.array(ids[s : s + IDS_AT_ONCE])))
        yield memoryview(raw)[at[0] + (0 if s else skip) : at[-1]]


def _encoded(path: str, lexicon: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path, lexicon)
        table = merger(path).bytes_of
        token_bytes = pa.array([table.get(i, b"") for i in range(max(table) + 1)], pa.binary())
        decimal = pa.array([f",{i}" for i in range(len(token_bytes))])
        for batch in batches:
            at = 0
            for texts in _tokens.slices(_tokens.strings_of(batch.column(1))):
                ids, starts = encoder.encode(texts)
                ids_sha, text_sha = [], []
                for parts in _written_out(ids, starts, decimal, 1):
                    digest = hashlib.sha256()
                    for part in parts:
                        digest.update(part)
                    ids_sha.append(digest.hexdigest())
                for parts in _written_out(ids, starts, token_bytes, 0):
                    digest, decode = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace").decode
                    for part in parts:
                        digest.update(decode(part).encode())
                    digest.update(decode(b"", True).encode())
                    text_sha.append(digest.hexdigest())
                columns = [batch.column(0).slice(at, len(texts)), pa.array(np.diff(starts)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    columns.append(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", words: int = LEXICON_WORDS, lexicon: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row for each row: ``id_col`` (as long), n_tokens, ids_sha256, decoded_sha256, and the ids themselves if ``keep_ids``.

    Null and empty texts have no tokens. Strings of added tokens inside a text become those tokens, as the library has
    it by default. Rows may repeat; null ids stay; an empty table gives an empty result; further columns are ignored.
    ``path`` is the tokenizer's file, which every executor must have; ``lexicon`` reuses a compiled one.
    """
    lexicon = lexicon or build_lexicon(docs, path, text_col, words)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    out = rows.mapInArrow(_encoded(path, lexicon, keep_ids), schema)
    return out.withColumnRenamed("doc_id", id_col)


def decode(ids: list[int], path: str) -> str:
    """The text of ids, added tokens included; bytes that are no UTF-8 become U+FFFD."""
    table = merger(path).bytes_of
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")
