"""The registered queries of the corpus operators, each over its whole table, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import bpe_transducer, decontaminate, filter_audit, golay_simhash, hard_negatives, language_id, lattice_dedup, learned_partitions, secret_scan, substring_dedup, token_count, token_store, warc_writer

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))

    def n(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def verdicts(verdict: str):
        return F.size(F.filter("found", lambda s: (s["verdict"] == verdict) & (s["kind"] != "live"))).cast("long")

    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(secret_scan.told(F.col("base")), 256).alias("base_sha256"), secret_scan.told(F.col("found")).alias("spans"), verdicts("live").alias("n_live"), verdicts("copied").alias("n_copied")
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs)).drop("letters", "spans")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.index(spark, token_store.write(_table(spark, sf_dir, "documents"), BYTE_BPE))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), WORD_BPE)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_transducer.encode(_table(spark, sf_dir, "documents"), BYTE_BPE, keep_ids=False)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op10_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_writer.read(spark, warc_writer.write(_table(spark, sf_dir, "pages"))).drop("payload", "url")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = filter_audit.failures(_table(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.labelled(failed, _table(spark, sf_dir, "labels")))


def op12_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.search(_table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.usable(_table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_lattice_dedup": op1_lattice_dedup,
    "op2_golay_simhash": op2_golay_simhash,
    "op3_secret_ownership": op3_secret_ownership,
    "op4_language_id": op4_language_id,
    "op5_token_store": op5_token_store,
    "op6_token_count": op6_token_count,
    "op7_decontaminate": op7_decontaminate,
    "op8_bpe_transducer": op8_bpe_transducer,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_warc_writer": op10_warc_writer,
    "op11_filter_audit": op11_filter_audit,
    "op12_learned_partitions": op12_learned_partitions,
    "op13_hard_negatives": op13_hard_negatives,
}

_BENCH_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

#: What SQL can express. XXH64 fingerprints, spans of matches, models and tokenizers it can't; tests hold those against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_lattice_dedup": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
    r AS (SELECT vec_id, vec_id AS reach FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach), c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id)
    SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c""",
    "op7_decontaminate": f"""WITH d AS (SELECT doc_id, coalesce({_BENCH_WORDS}, []) AS w FROM documents), b AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark), k AS (SELECT item_id, w, least(len(w), 13) AS size FROM b WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM k)), sizes AS (SELECT DISTINCT size FROM win),
    dw AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)),
    hit AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN win USING (win, size)), n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
    t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op9_substring_dedup": f"""WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents), x AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
    f AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS first FROM x) WHERE first < doc_id), gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM f) GROUP BY doc_id),
    k AS (SELECT doc_id, w, coalesce(ps, []) AS ps FROM d LEFT JOIN gone USING (doc_id))
    SELECT doc_id, len(w) AS n_words, len(ps) AS n_removed, sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' '), '')) AS kept_sha256 FROM k""",
    "op10_warc_writer": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)""",
    "op11_filter_audit": f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, coalesce({_WORDS}, []) AS w FROM documents),
    m AS (SELECT doc_id, part, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B, 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D, coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS E FROM d),
    l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, A::INT + 2 * B::INT + 4 * C::INT + 8 * D::INT + 16 * E::INT AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
    x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
    o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM x a, x b, x c, x d, x e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
    s AS (SELECT filter_order, CAST(step AS INT) AS step, (SELECT bit FROM x WHERE letter = filter_order[step]) AS own, coalesce((SELECT sum(bit) FROM x WHERE contains(filter_order[1:step - 1], letter)), 0)::INT AS past FROM o, (SELECT unnest(range(1, 6)) AS step)),
    t AS (SELECT part, filter_order, step, own, CAST(sum(CASE WHEN mask & (own | past) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN mask & own > 0 AND mask & past = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
      CAST(sum(CASE WHEN mask & own > 0 AND mask & past > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
      CAST(sum(CASE WHEN mask & own > 0 AND mask & past = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN mask & own > 0 AND mask & past = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM f, s GROUP BY part, filter_order, step, own)
    SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM t""",
    "op13_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5""",
}
