"""The pipeline's stages against brute force on a few planted documents."""

import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary, n))

    texts = [prose(120) for _ in range(20)]
    item = prose(40)
    planted = {20: texts[0], 21: texts[1].upper(), 22: item + " " + prose(20), 23: prose(60) + " password = hunter2000", 24: "12 34", 25: None, 26: texts[0].replace(" ", "  ")}
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in [*enumerate(texts), *planted.items()]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(kept[0]) == set(range(27)) - {24, 25}
    assert set(kept[1]) == set(kept[0]) - {20, 21, 26}
    assert set(kept[2]) == set(kept[1]) - {22}
    assert set(kept[3]) == set(kept[2]) and kept[3][23].endswith(" [SECRET]") and all(kept[3][i] == kept[2][i] for i in kept[3] if i != 23)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {i: tok.encode(t, add_special_tokens=False).ids for i, t in kept[3].items()}
    assert not re.search("hunter2000", tok.decode(out[23]))
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
