"""The hashing embedder and its column against a plain count of signed words."""

import math
import zlib

import pytest

from sieveline.functions.embed import HashingEmbedder, backend, embed_column

#: Texts, and the words that stand in them by hand.
TEXTS = {
    "save the row": ["save", "save", "the", "the", "row", "row"],
    "saveRow": ["save", "row", "saverow"],
    "A1 b_c": ["a1", "a1", "b", "b", "c", "c"],
    "": [],
    "é!": [],
}


def plain(words, n):
    v = [0] * n
    for w in words:
        h = zlib.crc32(w.encode())
        v[h % n] += 1 if h // 65536 % 2 else -1
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


@pytest.mark.parametrize("batch", [1, 64])
def test_vectors(spark, batch):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "i int, text string")
    got = {r["i"]: r["v"] for r in df.select("i", embed_column(df["text"], HashingEmbedder(16), batch).alias("v")).collect()}
    for i, words in [*enumerate(TEXTS.values()), (99, [])]:
        assert got[i] == pytest.approx(plain(words, 16), abs=1e-6)


def test_backends():
    assert backend().dimensions == 384
    with pytest.raises(ValueError):
        backend("none")
