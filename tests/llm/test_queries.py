"""Every registered corpus query over whole tables, of the smallest scale that has what it looks for: against DuckDB, the libraries or brute force."""

import glob
import hashlib
import os
import re
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

from sieveline.llm import queries

SF, WITH_SECRETS = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def documents(sf_dir):
    return {r["doc_id"]: r for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}


@pytest.fixture(scope="module")
def docs():
    return documents(SF)


def result(spark, name, sf_dir=SF):
    return [r.asDict() for r in queries.QUERIES[name](spark, sf_dir).collect()]


def test_all_are_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted(map(str, found.fetchall()))
    got = result(spark, name)
    assert want and sorted(str(tuple(r[c] for c in columns)) for r in got) == want


def test_op2(spark, docs):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(r["text"]) for i, r in docs.items()}
    component = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            least = min(component[b] for b in docs if (prints[a] ^ prints[b]).bit_count() <= 4)
            changed |= least < component[a]
            component[a] = min(least, component[a])
    got = result(spark, "op2_golay_simhash")
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((i, f"{prints[i]:016x}", component[i]) for i in docs)


def test_op3(spark):
    docs = documents(WITH_SECRETS)
    patterns = [
        ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile("[0-9a-f]+"), 0, 24),
    ]
    got = {r["doc_id"]: r for r in result(spark, "op3_secret_ownership", WITH_SECRETS)}
    assert got.keys() == docs.keys()
    some = 0
    for i, doc in docs.items():
        spans = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for rank, (kind, p, group, least) in enumerate(patterns) for m in p.finditer(doc["text"] or "") if len(m[group]) >= least]
        told = [t for _, _, t in sorted(spans)]
        some += len(told)
        assert [got[i][f"n_{k}"] for k, *_ in patterns] == [sum(t.startswith(k + ":") for t in told) for k, *_ in patterns]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        every = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert set(told) <= set(every) and all(t.startswith("live:") for t in every if t not in told)
    assert some


def test_op4(spark, docs):
    got = {r["doc_id"]: r for r in result(spark, "op4_language_id")}
    assert got.keys() == docs.keys()
    langs = {r["lang"] for r in docs.values()} - {None}
    right = total = 0
    for i, doc in docs.items():
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in doc["text"] or "")) and r["lang_pred"] in langs | {"und"}
        if r["held_out"] and doc["lang"] and r["lang_pred"] != "und":
            total, right = total + 1, right + (r["lang_pred"] == doc["lang"])
    assert total and right >= 0.9 * total


def test_op5(spark, docs):
    tok, start = Tokenizer.from_file(queries.BYTE_BPE), 0
    got = {r["doc_id"]: r for r in result(spark, "op5_token_store")}
    assert got.keys() == docs.keys()
    for i in sorted(docs):
        ids = [*tok.encode(docs[i]["text"] or "", add_special_tokens=False).ids, 0]
        crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc)
        start += len(ids)


def test_op6(spark, docs):
    tok = Tokenizer.from_file(queries.WORD_BPE)
    tok.no_truncation()
    tok.no_padding()
    got = {r["doc_id"]: r for r in result(spark, "op6_token_count")}
    assert got.keys() == docs.keys()
    for i, doc in docs.items():
        n = len(tok.encode(doc["text"] or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((doc["text"] or "").encode()), n, n > 2048)


def test_op8(spark, docs):
    tok = Tokenizer.from_file(queries.BYTE_BPE)
    got = {r["doc_id"]: r for r in result(spark, "op8_bpe_transducer")}
    assert got.keys() == docs.keys()
    for i, doc in docs.items():
        ids = tok.encode(doc["text"] or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        want = (len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), decoded)))
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want
