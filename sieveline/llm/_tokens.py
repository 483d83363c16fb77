"""Cutting text where a tokenizer provably cuts it too, so that each distinct word of a batch is encoded once.

A batch of texts is cut into pieces and these into words in Arrow; what texts hold is kept as numbers of pieces and
words, and ids are gathered by offsets, so Python touches no piece of a text twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Code points with the Unicode property White_Space, as in a character class.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNEVEN = re.compile(f" (?:[{WHITE}]|\\Z)")
_CUT = re.compile(f" (?=[^{WHITE}])")
#: The same and classes of letters in the syntax of Arrow's expressions; the letters up to U+017F.
_ARROW_WHITE = re.sub(r"\\[xu]([0-9a-f]+)", r"\\x{\1}", WHITE)
_ARROW_UNEVEN = f" (?:[{_ARROW_WHITE}]|\\z)"
LATIN = r"A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}"
_ALONE, _STOPPED = rf"\A ?[{LATIN}]+\z", rf"\A ?[{LATIN}]+[.,;:!?]\z"
#: Bytes of text that a task cuts and encodes at once; a longer text stands alone.
SLICE_BYTES = 2_000_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def added_strings(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def pieces(text: str) -> list[str]:
    """Cuts ``text`` at each space that something other than white space follows; the space is dropped.

    A byte-level pre-tokenizer starts a word there whatever stands before or after, so the first piece, and each later
    one with its space before it, encode on their own.
    """
    return _CUT.split(text) if _UNEVEN.search(text) else text.split(" ")


#: The words of byte-level BPE, with white space spelt out.
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


def words_of(piece: str, path: str) -> list[str]:
    """The words of a piece of text; scripts beyond Latin are cut by the library itself, whose Unicode tables decide."""
    if not piece or max(piece) <= "\u017f":
        return _WORD.findall(piece)
    back = _back()
    return [bytes(back[c] for c in w).decode() for w, _ in tokenizer(path).pre_tokenizer.pre_tokenize_str(piece)]


@lru_cache(maxsize=1)
def _back() -> dict[str, int]:
    return {s: b for b, s in enumerate(byte_symbols())}


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that start at ``starts`` and have ``sizes``, one after the other."""
    ends = np.cumsum(sizes)
    index = np.arange(int(ends[-1]) if len(ends) else 0)
    index += np.repeat(starts - (ends - sizes), sizes)
    return values[index]


def offsets_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def raw_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and where each of its members starts and the last ends."""
    _, offsets, data = strings.buffers()
    if not len(strings):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at


def strings_of(column: pa.Array) -> pa.Array:
    """Texts with null as empty."""
    return pc.fill_null(column, "")


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterable[pa.Array]:
    """Runs of texts of about so many bytes together."""
    at, start = raw_of(texts)[1], 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(at, at[start] + size, "right")) - 1)
        yield texts.slice(start, end - start)
        start = end


@dataclass
class Cut:
    """Texts as numbers of distinct pieces, pieces as numbers of distinct words; ``starts`` of each text in ``pieces``, of each piece in ``in_piece``."""

    words: pa.Array
    in_piece: np.ndarray
    piece_starts: np.ndarray
    pieces: np.ndarray
    starts: np.ndarray

    def counts(self) -> np.ndarray:
        """How often each word occurs."""
        times = np.bincount(self.pieces, minlength=len(self.piece_starts) - 1)
        return np.bincount(self.in_piece, np.repeat(times, np.diff(self.piece_starts)), len(self.words)).astype(np.int64)

    def gathered(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each text holds, and where, given what each word holds."""
        sizes = np.diff(starts)[self.in_piece]
        ids, starts = ragged(ids, starts[self.in_piece], sizes), offsets_of(sizes)[self.piece_starts]
        sizes = np.diff(starts)[self.pieces]
        return ragged(ids, starts[self.pieces], sizes), offsets_of(sizes)[self.starts]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts and where each text starts among them."""
    uneven = pc.match_substring_regex(texts, _ARROW_UNEVEN).to_numpy(zero_copy_only=False)
    even = texts if not uneven.any() else texts.filter(pa.array(~uneven))
    cut = pc.split_pattern(even, " ")
    values, sizes = cut.flatten(), np.diff(cut.offsets.to_numpy())
    if not uneven.any():
        return values, offsets_of(sizes)
    lists = [pieces(t) for t in listed(texts.filter(pa.array(uneven)))]
    values = pa.concat_arrays([values, pa.array([p for x in lists for p in x], values.type)])
    both = offsets_of(np.concatenate([sizes, np.fromiter(map(len, lists), np.int64, len(lists))]))
    order = np.empty(len(texts), np.int64)
    order[np.concatenate([np.flatnonzero(~uneven), np.flatnonzero(uneven)])] = np.arange(len(texts))
    sizes = np.diff(both)[order]
    return values.take(pa.array(ragged(np.arange(len(values)), both[order], sizes))), offsets_of(sizes)


def _words(strings: pa.Array, path: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of pieces, their numbers piece by piece, and where each piece starts among these."""
    alone = pc.match_substring_regex(strings, _ALONE).to_numpy(zero_copy_only=False)
    stopped = pc.match_substring_regex(strings, _STOPPED).to_numpy(zero_copy_only=False)
    odd = [words_of(p, path) for p in listed(strings.filter(pa.array(~(alone | stopped))))]
    ended = strings.filter(pa.array(stopped))
    parts = [strings.filter(pa.array(alone)), pc.utf8_slice_codeunits(ended, 0, -1), pc.utf8_slice_codeunits(ended, -1), pa.array([w for x in odd for w in x], strings.type)]
    known = pa.concat_arrays(parts).dictionary_encode()
    number = np.split(known.indices.to_numpy(), np.cumsum([len(p) for p in parts[:-1]]))
    sizes = np.where(stopped, 2, 1)
    sizes[~(alone | stopped)] = np.fromiter(map(len, odd), np.int64, len(odd))
    starts = offsets_of(sizes)
    out = np.empty(int(starts[-1]), np.int64)
    first = starts[:-1]
    out[first[alone]], out[first[stopped]], out[first[stopped] + 1] = number[:3]
    rest = ~(alone | stopped)
    out[ragged(np.arange(len(out)), first[rest], sizes[rest])] = number[3]
    return known.dictionary, out, starts


def cut(texts: pa.Array, path: str) -> Cut:
    """The pieces and words of texts without added tokens' strings."""
    values, starts = _split(texts)
    known = values.dictionary_encode()
    codes = known.indices.to_numpy().astype(np.int64)
    # a later piece stands behind its space, a first one behind nothing
    leads, first = np.unique(codes[starts[:-1]], return_inverse=True)
    codes[starts[:-1]] = len(known.dictionary) + first
    behind = pc.binary_join_element_wise(pa.scalar(" ", values.type), known.dictionary, pa.scalar("", values.type))
    words, in_piece, piece_starts = _words(pa.concat_arrays([behind, known.dictionary.take(pa.array(leads))]), path)
    return Cut(words, in_piece, piece_starts, codes, starts)


class Encoder:
    """Encodes texts with a byte-level tokenizer, each distinct word of a slice once, by ``encode_words``.

    Texts that hold an added token's string are encoded whole by the library.
    """

    def __init__(self, path: str):
        self.path, self.added = path, added_strings(path)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and where each one's start and the last end."""
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each one's start and the last end."""
        whole = np.zeros(len(texts), bool)
        for a in self.added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        done = {int(i): tokenizer(self.path).encode(texts[int(i)].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(whole)}
        found = cut(pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts) if done else texts, self.path)
        ids, starts = found.gathered(*self.encode_words(found.words))
        if done:
            at = np.repeat(starts[list(done)], [len(x) for x in done.values()])
            ids = np.insert(ids, at, [x for y in done.values() for x in y])
            sizes = np.diff(starts)
            sizes[list(done)] = [len(x) for x in done.values()]
            starts = offsets_of(sizes)
        return ids, starts


@lru_cache(maxsize=1)
def _spelling() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte's symbol in UTF-8 the first and the last byte and the size, which is one or two."""
    symbols = [s.encode() for s in byte_symbols()]
    return np.array([s[0] for s in symbols], np.uint8), np.array([s[-1] for s in symbols], np.uint8), np.array([len(s) for s in symbols])


def spelt(words: pa.Array) -> list[str]:
    """Words in the characters of byte-level BPE."""
    (raw, at), (first, last, sizes) = raw_of(words), _spelling()
    raw = raw[at[0] : at[-1]]
    ends = offsets_of(sizes[raw])
    out = np.empty(int(ends[-1]), np.uint8)
    out[ends[1:] - 1] = last[raw]
    out[ends[:-1]] = first[raw]
    found = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(ends[at - at[0]]), pa.py_buffer(out))
    return listed(found)


def listed(strings: pa.Array) -> list[str]:
    """The strings of an array, without a scalar for each."""
    return strings.to_numpy(zero_copy_only=False).tolist()


class LibraryEncoder(Encoder):
    """By the library alone: words are cut as its pre-tokenizer does and each goes through its model."""

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        tokenize = tokenizer(self.path).model.tokenize
        ids, starts = [], [0]
        for word in spelt(words):
            ids += [t.id for t in tokenize(word)]
            starts.append(len(ids))
        return np.array(ids, np.int32), np.array(starts)
