"""Training and labelling against plain forms: letters, words, held-out rows, samples, scripts."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import language_id
from sieveline.llm.language_id import BUCKETS, RUN_LETTERS, UNSPACED, script_of

COLUMNS = "doc_id long, text string, lang string, row int, what string, letters int"


def plain_words(text):
    out = []
    for token in text.split():
        run = ""
        for c in (c for c in token.lower() if c.isalpha()):
            if run and (script_of(c) != script_of(run[0]) or script_of(c) in UNSPACED and len(run) == RUN_LETTERS):
                out.append(run)
                run = ""
            run += c
        out += [run] if run else []
    return out


TEXTS = ["Don't stop", "½ ② ³ Ⅷ 12 _", "", "  ", "日本語のテキスト です", "abcдом x", "a\x1cb c", "ไทยภาษาไทย", "ÀÉß İx ŉ", "mixed日本latin"]


def test_words_against_plain_form():
    words = language_id.words_of(pa.array(TEXTS))
    known = {}
    for text, a, b in zip(TEXTS, words.starts[:-1], words.starts[1:]):
        want = plain_words(text)
        got = words.codes[a:b].tolist()
        assert [int(x) for x in words.letters[got]] == [len(w) for w in want] and [words.script[x] for x in got] == [script_of(w[0]) for w in want], text
        for w, x in zip(want, got):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known) == len(words.letters)
    assert words.buckets.min() >= 0 and words.buckets.max() < BUCKETS


def test_a_trigram_has_one_bucket():
    one, two = language_id.words_of(pa.array(["abcd"])), language_id.words_of(pa.array(["zz abcd bcd"]))
    assert one.buckets.tolist() == two.buckets[two.bucket_starts[1] : two.bucket_starts[2]].tolist()
    assert two.buckets[-2:].tolist() == one.buckets[-2:].tolist()  # bcd and cd$


def rows(n=90):
    words = {"en": "the house stands with every window shut tonight".split(), "de": "das große Haus steht über dem Fluss schön".split()}
    return [(i, " ".join(np.random.default_rng(i).choice(words[lang], 20)), lang, 1, "w", 2) for i, lang in zip(range(n), ["en", "de"] * n)]


def test_training_counts_rows_that_are_not_held_out(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    data = [(i, t if not held(i) else "zzyzx qqq", lang if not held(i) else "xx", *rest) for i, t, lang, *rest in rows()]
    data += [data[1], (None, "the house", "en", 1, "w", 2), (900, None, "en", 1, "w", 2), (901, "das Haus", None, 1, "w", 2), (902, "12", "en", 1, "w", 2), (904, "x", "und", 1, "w", 2)]
    model = language_id.train(spark.createDataFrame(data, COLUMNS))
    counts = {}
    for i, text, lang, *_ in data:
        if text and lang in ("en", "de") and not (i is not None and held(i)):
            found = language_id.words_of(pa.array([text]))
            for c in found.codes:
                for b in found.buckets[found.bucket_starts[c] : found.bucket_starts[c + 1]].tolist():
                    counts[lang, b] = counts.get((lang, b), 0) + 1
                counts[lang, -1 - sorted(set(language_id._NAMES)).index(found.script[c])] = counts.get((lang, -1 - sorted(set(language_id._NAMES)).index(found.script[c])), 0) + int(found.letters[c])
    want = language_id.model_of([(*k, n) for k, n in counts.items()])
    assert model.langs == want.langs == ["de", "en"] and (model.rows == want.rows).all() and np.allclose(model.logp, want.logp) and model.scripts.keys() == want.scripts.keys() == {"latin"}
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows(), COLUMNS), model).collect()}
    assert all(got[i]["lang_pred"] == lang and got[i]["held_out"] == held(i) and 0 < got[i]["score"] <= 1 for i, _, lang, *_ in rows())


def test_labels_by_scores():
    model = language_id.model_of([("de", 1, 10), ("en", 2, 10), ("en", -1, 5), ("de", -1, 5)])
    scores = np.array([[4.0, -4], [4, -4], [-30, 30], [-30, 30]])
    assert language_id.label(scores, np.array([4, 4, 5, 5]), model.langs) == ("en", 10 / 18, [(0, 2, "de"), (2, 4, "en")])
    assert language_id.label(np.zeros((2, 2)), np.array([1, 1]), model.langs) == ("de", 1.0, [(0, 2, "de")])  # a tie


@pytest.mark.parametrize("labelled", [10**11, 10**15])
def test_sample_of_very_many_rows(labelled):
    chosen = language_id.threshold(labelled, 20_000)
    assert abs(chosen / 2**63 * labelled - 20_000) < 1 and language_id.threshold(20_000, 20_000) is None


def test_sample_and_letters(spark):
    df = spark.createDataFrame([*rows(), (1000, "½ ② ³", None, 1, "w", 2), (1001, "½ a", None, 1, "w", 2), (None, None, None, 1, "w", 2)], COLUMNS)
    model = language_id.train(df, train_docs=30)
    assert model.langs == ["de", "en"]
    got = language_id.identify(df, model).collect()
    odd = {r["doc_id"]: (r["lang_pred"], r["score"], r["letters"]) for r in got if r["doc_id"] in (1000, 1001, None)}
    assert len(got) == 93 and odd[1000] == odd[None] == ("und", 0.0, 0) and odd[1001][0] != "und" and odd[1001][2] == 1


def test_unspaced_scripts_get_several_labels(spark):
    data = [(i, t, lang, 1, "w", 2) for i, (t, lang) in enumerate([("このテキストはとても長いです", "ja"), ("ภาษาไทยง่ายมาก", "th")] * 20)]
    df = spark.createDataFrame([*data, (100, "このテキストはภาษาไทยง่ายมาก", None, 1, "w", 2)], COLUMNS)
    got = {r["doc_id"]: r for r in language_id.identify(df, language_id.train(df)).collect()}
    assert [s["lang"] for s in got[100]["spans"]] == ["ja", "th"]
