"""Words of batches, merges of many words at once and what is written out, against the plain forms and the library."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from sieveline.llm import _tokens, bpe_transducer, token_count
from tests.llm.test_operators import BYTE_BPE, WORD_BPE, mixed_texts


def test_latin_letters_are_those_of_the_class():
    chars = [chr(c) for c in range(1, 0x180)]
    got = pc.match_substring_regex(pa.array(chars), _tokens._ALONE).to_pylist()
    assert got == [c.isalpha() for c in chars]


def test_uneven_spaces():
    white = [chr(c) for c in range(1, 0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]
    texts = [f"a {w}b c {w}" for w in white] + ["", " ", "a", " a", "a ", "a b"]
    values, starts = _tokens._split(pa.array(texts))
    assert [values.to_pylist()[a:b] for a, b in zip(starts[:-1], starts[1:])] == [_tokens.pieces(t) for t in texts]


def test_merge_all():
    bpe = bpe_transducer.merger(BYTE_BPE)
    rng = random.Random(3)
    words = [bytes(rng.choice(b"etaoinshr \xc3\xa9ABz") for _ in range(rng.randint(1, 90))) for _ in range(3000)] + [b"a", b" the", b"aa" * 32, b"aa" * 33, b"x" * 300]
    raw, at = _tokens.raw_of(pa.array(words, pa.binary()))
    for some in (np.arange(len(words)), np.array([], np.int64), np.array([7]), np.flatnonzero(np.diff(at) == 1)):
        ids, counts = bpe.merge_all(raw, at[some], np.diff(at)[some])
        cuts = _tokens.offsets_of(counts)
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [bpe.merge(words[i]) for i in some]


def test_encoders_and_counts_in_slices():
    texts = mixed_texts(80)
    tok = Tokenizer.from_file(BYTE_BPE)
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (50, 8_000_000):
        got, words = [], {}
        for part in _tokens.slices(_tokens.strings_of(pa.array([None, *texts])[1:]), size):
            ids, starts = _tokens.LibraryEncoder(BYTE_BPE).encode(part)
            got += [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]
            found = _tokens.cut(part, BYTE_BPE)
            for w, n in zip(found.words.to_pylist(), found.counts().tolist()):
                words[w] = words.get(w, 0) + n
        assert got == want
        plain = {}
        for t in texts:
            first, *rest = _tokens.pieces(t or "")
            for p in [first, *(" " + r for r in rest)]:
                for w in _tokens.words_of(p, BYTE_BPE):
                    plain[w] = plain.get(w, 0) + 1
        assert {w: n for w, n in words.items() if n} == plain


def test_word_counts_with_separators():
    tok = Tokenizer.from_file(WORD_BPE)
    texts = mixed_texts(80) + [f"a{chr(c)}b {chr(c)} c" for c in [*range(0x1C, 0x20), 0x85, 0xA0, 0x180E, 0x200B, 0x2028, 0x3000]]
    texts = [t or "" for t in texts] + [f"x{chr(c)}y{chr(c)}. {chr(c)}!" for c in range(0x20, 0x180)] + ["e\u0301a e\u0301.", "Don't. it's: we're;"]
    assert token_count.WordCounter(WORD_BPE).count(pa.array(texts)).tolist() == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_written_out_by_parts(monkeypatch):
    table = pa.array([f",{i}" for i in range(300)])
    ids = np.array(random.Random(1).choices(range(300), k=120), np.int32)
    starts = np.array([0, 0, 3, 50, 50, 90, 120])
    want = [",".join(map(str, ids[a:b])) for a, b in zip(starts[:-1], starts[1:])]
    for most in (5, 30, 1000):
        monkeypatch.setattr(bpe_transducer, "IDS_AT_ONCE", most)
        assert [b"".join(map(bytes, parts)).decode() for parts in bpe_transducer._written_out(ids, starts, table, 1)] == want
