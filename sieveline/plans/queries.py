"""The registered queries of the engine's operators over the test tables, each beside the same question in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.functions import parsers, scalar
from sieveline.functions.embed import HashingEmbedder, embed_column
from sieveline.operators import balls, blocks, graph, impact, incremental, predicates, ranking, search, segments, state
from sieveline.plans import adapters as a
from sieveline.sources.shared import kept, work_path
from sieveline.streaming import events as ev

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: What the search queries ask for: a text, and the vector of a stated row.
QUERY = "the heating of the and thand error token license"
QUERY_ID = 7
TERMS = ", ".join(f"('{t}')" for t in search.query_terms(QUERY))


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(a.vectors(spark, sf_dir).where(F.col("doc_id") == QUERY_ID).first()["vector"])


# ---- retrieval ----
NOT_TEST = "path NOT ILIKE '%test%' AND path NOT ILIKE '%.spec.%' AND path NOT ILIKE '%/__tests__/%'"
_BASE = f"""WITH chunks AS ({a.CHUNKS}), vectors AS ({a.VECTORS}), q AS (SELECT vector AS qv FROM vectors WHERE doc_id = {QUERY_ID}),
vs AS (SELECT v.doc_id, round(list_cosine_similarity(v.vector::DOUBLE[], q.qv::DOUBLE[]), 4) AS score, c.path FROM vectors v CROSS JOIN q JOIN chunks c ON c.doc_id = v.doc_id)"""


def _vector_sql(where: str) -> str:
    return f"{_BASE} SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM vs WHERE {where} ORDER BY score DESC, doc_id LIMIT 10"


def _vector(spark, sf_dir, **scope) -> DataFrame:
    ids = a.chunks(spark, sf_dir).where(predicates.scope(F.col("path"), **scope)).select("doc_id")
    return search.top_k(search.vector_scores(a.vectors(spark, sf_dir).join(ids, "doc_id", "left_semi"), _query_vector(spark, sf_dir)), 10)


@query("vector_topk", _vector_sql("true"))
def vector_topk(spark, sf_dir):
    return _vector(spark, sf_dir)


@query("vector_topk_balls", _vector_sql("starts_with(path, 'lib/')"))
def vector_topk_balls(spark, sf_dir):
    """The same by a stored index of balls, which the first of its kind in an application writes for the tables as they are."""
    rows = a.vectors(spark, sf_dir).join(a.chunks(spark, sf_dir).select("doc_id", "path"), "doc_id")
    made = kept(spark, sf_dir, "vectors", lambda: rows)
    at = made.inputFiles()[0].rsplit("/", 1)[0] + "-balls"
    index = balls.BallIndex(spark, at)
    if index.manifest is None:
        index.build(made, ball_rows=128)
    return index.nearest(_query_vector(spark, sf_dir), 10, F.col("path").startswith("lib/")).rows


@query("vector_topk_prefix", _vector_sql("starts_with(path, 'lib/')"))
def vector_topk_prefix(spark, sf_dir):
    return _vector(spark, sf_dir, prefix="lib")


@query("vector_topk_no_tests", _vector_sql(NOT_TEST))
def vector_topk_no_tests(spark, sf_dir):
    return _vector(spark, sf_dir, include_tests=False)


_INDEX = f"""WITH chunks AS ({a.CHUNKS}), toks AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(concat(path, chr(10), symbol, chr(10), content)), '[^a-z0-9_]+'), lambda t: t <> '') AS t FROM chunks),
lengths AS (SELECT doc_id, len(t) AS dl FROM toks), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths)"""


def _bm25_sql(queries: str) -> str:
    return f"""{_INDEX}, asked AS ({queries}), postings AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM asked) GROUP BY term, doc_id),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
bm AS (SELECT query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM asked JOIN df USING (term) CROSS JOIN stats JOIN postings p USING (term) JOIN lengths l ON l.doc_id = p.doc_id GROUP BY query_id, p.doc_id)"""


_ONE = f"SELECT 'q' AS query_id, term FROM (VALUES {TERMS}) v(term)"


def text_index(spark, sf_dir) -> search.TextIndex:
    """The text index of the chunks as a build stores it: made when it is first asked for, read from then on."""
    chunks = a.chunks(spark, sf_dir)
    postings = kept(spark, sf_dir, "postings", lambda: search.postings_of(chunks))
    terms = kept(spark, sf_dir, "terms", lambda: search.terms_of(postings))
    return search.TextIndex(postings, terms, kept(spark, sf_dir, "corpus", lambda: search.corpus_of(chunks, postings)))


def _bm25(spark, sf_dir) -> DataFrame:
    terms = search.query_terms(QUERY)
    asked = spark.createDataFrame([("q", t) for t in terms], "query_id string, term string")
    return text_index(spark, sf_dir).scores(asked, terms).drop("query_id")


@query("text_index_build", _INDEX + " SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY doc_id, term) GROUP BY term")
def text_index_build(spark, sf_dir):
    """The words of all texts, counted within each as a build does, and summed by term; ``text_index_update`` writes its segments."""
    each = search.cut(a.chunks(spark, sf_dir)).select(F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    return each.groupBy(F.col("t.terms").alias("term")).agg(F.count(F.lit(1)).alias("df"), F.sum("t.tfs").alias("n"))


_UPDATED = f"""WITH now AS (SELECT * FROM ({a.CHUNKS}) WHERE doc_id % 11 <> 1), toks AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(concat(path, chr(10), symbol, chr(10), content)), '[^a-z0-9_]+'), lambda t: t <> '') AS t FROM now)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY doc_id, term) GROUP BY term"""


@query("text_index_update", _UPDATED)
def text_index_update(spark, sf_dir):
    """A stored text index of how the documents were, brought up to date by their changes alone, summed by term."""
    chunks = a.chunks(spark, sf_dir)
    stored = chunks.where("doc_id % 10 <> 0").withColumn("content", F.when(F.expr("doc_id % 7 = 0"), F.concat("content", F.lit(" old words"))).otherwise(F.col("content")))
    now = chunks.where("doc_id % 11 <> 1")
    index = segments.TextSegments(spark, work_path(spark, "text"))
    index.build(stored)
    fresh = now.where("doc_id % 10 = 0 or doc_id % 7 = 0")
    index.update(stored.where("doc_id % 11 = 1").select("path").unionByName(fresh.select("path")), fresh)
    return index.postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


@query("bm25_scores_anew", _bm25_sql(_ONE) + " SELECT doc_id, score FROM bm")
def bm25_scores_anew(spark, sf_dir):
    """The same without a stored index."""
    terms = search.query_terms(QUERY)
    asked = spark.createDataFrame([("q", t) for t in terms], "query_id string, term string")
    return search.bm25(*search.build_postings(a.chunks(spark, sf_dir), terms=terms), asked).drop("query_id")


@query("bm25_scores", _bm25_sql(_ONE) + " SELECT doc_id, score FROM bm")
def bm25_scores(spark, sf_dir):
    return _bm25(spark, sf_dir)


@query("bm25_topk", _bm25_sql(_ONE) + " SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM bm ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf_dir):
    return search.top_k(_bm25(spark, sf_dir), 10)


_HYBRID = f"""{_bm25_sql(_ONE)}, vectors AS ({a.VECTORS}), q AS (SELECT vector AS qv FROM vectors WHERE doc_id = {QUERY_ID}),
vs AS (SELECT v.doc_id, round(list_cosine_similarity(v.vector::DOUBLE[], q.qv::DOUBLE[]), 4) AS score FROM vectors v CROSS JOIN q WHERE v.doc_id IN (SELECT doc_id FROM chunks)),
vr AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM vs ORDER BY r LIMIT 20), br AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm ORDER BY r LIMIT 20),
fused AS (SELECT doc_id, round(coalesce(1.0::DOUBLE / (60 + vr.r), 0) + coalesce(1.0::DOUBLE / (60 + br.r), 0), 4) AS score FROM vr FULL OUTER JOIN br USING (doc_id)),
top AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM fused ORDER BY r LIMIT 20)"""


def _fused(spark, sf_dir) -> DataFrame:
    legs = [search.top_k(search.vector_scores(a.vectors(spark, sf_dir).join(a.chunks(spark, sf_dir).select("doc_id"), "doc_id", "left_semi"), _query_vector(spark, sf_dir)), 20), search.top_k(_bm25(spark, sf_dir), 20)]
    return search.top_k(search.fuse(legs), 20)


@query("hybrid_rrf", _HYBRID + " SELECT doc_id, score, CAST(r AS INT) AS rank FROM top")
def hybrid_rrf(spark, sf_dir):
    return _fused(spark, sf_dir)


FACTOR = " * ".join(f"CASE WHEN regexp_matches(path, '{p}') THEN {f}::DOUBLE ELSE 1 END" for p, f in ranking.DEFAULT_RULES)
_BOOSTED = f"{_HYBRID}, boosted AS (SELECT doc_id, path, start_line, end_line, symbol, content, score * ({FACTOR}) AS score, r FROM top JOIN chunks USING (doc_id)), ranked AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, r) AS rank FROM boosted)"


@query("hybrid_boosted", _BOOSTED + " SELECT doc_id, path, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM ranked")
def hybrid_boosted(spark, sf_dir):
    found = a.chunks(spark, sf_dir).select("doc_id", "path").join(_fused(spark, sf_dir), "doc_id")
    return ranking.boost(found).select("doc_id", "path", F.round("score", 9).alias("score"), "rank")


_TIERS = "tiered AS (SELECT *, sum(d) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS t FROM (SELECT *, CASE WHEN lag(score) OVER w > 0 AND score / lag(score) OVER w < 0.5 THEN 1 ELSE 0 END AS d FROM kept WINDOW w AS (PARTITION BY query_id ORDER BY rank)))"
_KEPT = """kept AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM ranked2 a WHERE NOT EXISTS (SELECT 1 FROM ranked2 b WHERE a.query_id = b.query_id AND a.path = b.path AND a.rank <> b.rank
  AND a.start_line <= b.start_line AND a.end_line >= b.end_line AND (a.start_line <> b.start_line OR a.end_line <> b.end_line OR b.rank > a.rank)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= {k})"""
_OUT = "path, start_line, end_line, symbol, array_to_string(string_split(content, chr(10))[1:60], chr(10)) AS content, len(string_split(content, chr(10))) > 60 AS truncated, round(score, 9) AS score, CASE t WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS relevance, CAST(rank AS INT) AS rank"


def _hit() -> list:
    return ["path", "start_line", "end_line", "symbol", "content", "truncated", F.round("score", 9).alias("score"), "relevance", "rank"]



@query("search_pipeline", f"{_BOOSTED}, ranked2 AS (SELECT *, 'q' AS query_id FROM ranked), {_KEPT.format(k=10)}, {_TIERS} SELECT doc_id, {_OUT}, 'hybrid' AS search_mode FROM tiered")
def search_pipeline(spark, sf_dir):
    found = search.search(a.chunks(spark, sf_dir), a.vectors(spark, sf_dir), QUERY, _query_vector(spark, sf_dir), k=10, index=text_index(spark, sf_dir))
    return found.select("doc_id", *_hit(), "search_mode")


_MANY = "SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: t <> '')) AS term FROM benchmark)"


_BATCH = f"""{_bm25_sql(_MANY)}, b1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM bm), b2 AS (SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + r), 4) AS score FROM b1 WHERE r <= 10),
    b3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM b2),
    boosted AS (SELECT query_id, doc_id, path, start_line, end_line, symbol, content, score * ({FACTOR}) AS score, r FROM b3 JOIN chunks USING (doc_id)),
    ranked2 AS (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, r) AS rank FROM boosted), {_KEPT.format(k=5)}, {_TIERS} SELECT query_id, doc_id, {_OUT} FROM tiered"""


def _asked(spark, sf_dir) -> DataFrame:
    return a.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("batch_search", _BATCH)
def batch_search(spark, sf_dir):
    return search.batch_search(a.chunks(spark, sf_dir), _asked(spark, sf_dir), index=text_index(spark, sf_dir)).select("query_id", "doc_id", *_hit())


@query("batch_search_blocks", _BATCH)
def batch_search_blocks(spark, sf_dir):
    """The same from blocks that know their largest weight, of which those are opened that can hold one of the best; written as the text index is."""
    built = blocks.BlockIndex.of(text_index(spark, sf_dir))
    index = blocks.BlockIndex(kept(spark, sf_dir, "block-terms", lambda: built.terms), kept(spark, sf_dir, "blocks", lambda: built.blocks))
    return search.batch_search(a.chunks(spark, sf_dir), _asked(spark, sf_dir), index=index).select("query_id", "doc_id", *_hit())


# ---- hits ----
_LINES = f"SELECT doc_id, path, CAST(i * 20 + 1 AS INT) AS start_line, CAST(least((i + 1) * 20, end_line) AS INT) AS end_line, array_to_string(string_split(content, chr(10))[i * 20 + 1 : (i + 1) * 20], chr(10)) AS content FROM ({a.CHUNKS}) c, LATERAL (SELECT unnest(range(0, CAST(ceil(end_line / 20.0) AS BIGINT))) AS i)"


def line_chunks(chunks: DataFrame, size: int = 20) -> DataFrame:
    """Chunks of so many lines."""
    lines = chunks.select("doc_id", "path", F.split("content", "\n", -1).alias("l"), "end_line")
    each = lines.select("*", F.explode(F.sequence(F.lit(0), ((F.size("l") - 1) / size).cast("int"))).alias("i"))
    return each.select("doc_id", "path", (F.col("i") * size + 1).alias("start_line"), F.least((F.col("i") + 1) * size, F.col("end_line")).alias("end_line"), F.array_join(F.slice("l", F.col("i") * size + 1, size), "\n").alias("content"))


@query("line_chunks", _LINES)
def _line_chunks(spark, sf_dir):
    return line_chunks(a.chunks(spark, sf_dir))


_SPANS = "SELECT CAST(l_orderkey AS STRING) AS path, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INT) AS start_line, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + l_quantity AS INT) AS end_line, l_extendedprice AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_discount, l_tax) AS rank FROM lineitem"


def _spans(spark, sf_dir) -> DataFrame:
    days = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax")
    return a.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), days.alias("start_line"), (days + F.col("l_quantity")).cast("int").alias("end_line"), F.col("l_extendedprice").alias("score"), F.row_number().over(order).alias("rank"))


@query(
    "containment_dedup",
    f"WITH h AS ({_SPANS}) SELECT path, start_line, end_line, score, CAST(rank AS INT) AS rank FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE a.path = b.path AND a.rank <> b.rank AND a.start_line <= b.start_line AND a.end_line >= b.end_line AND (a.start_line <> b.start_line OR a.end_line <> b.end_line OR b.rank > a.rank))",
)
def containment_dedup(spark, sf_dir):
    return ranking.drop_enclosing(_spans(spark, sf_dir))


@query(
    "relevance_tiers",
    f"WITH kept AS (SELECT path AS query_id, score, rank FROM ({_SPANS})), {_TIERS} SELECT query_id AS path, score, CAST(rank AS INT) AS rank, CASE t WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS relevance FROM tiered",
)
def relevance_tiers(spark, sf_dir):
    return ranking.relevance_tiers(_spans(spark, sf_dir).select("path", "score", "rank"), ["path"])


@query("boost_multiplier", f"SELECT doc_id, path, {FACTOR} AS factor FROM ({a.CHUNKS})")
def boost_multiplier(spark, sf_dir):
    return a.chunks(spark, sf_dir).select("doc_id", "path", ranking.boost_factor(F.col("path")).alias("factor"))


@query("content_truncate", f"SELECT doc_id, array_to_string(string_split(content, chr(10))[1:60], chr(10)) AS content, len(string_split(content, chr(10))) > 60 AS truncated FROM ({a.CHUNKS})")
def content_truncate(spark, sf_dir):
    return predicates.truncate_content(a.chunks(spark, sf_dir)).select("doc_id", "content", "truncated")


@query("content_preview", f"SELECT doc_id, CASE WHEN length(content) > 200 THEN concat(substr(replace(content, chr(10), ' '), 1, 200), '...') ELSE replace(content, chr(10), ' ') END AS preview FROM ({a.CHUNKS})")
def content_preview(spark, sf_dir):
    return a.chunks(spark, sf_dir).select("doc_id", scalar.preview(F.col("content")).alias("preview"))


#: Written out once more, so that the query's answer doesn't follow from the engine's own list.
_TEST_PARTS = ["/tests/", "/test/", "/test_", "_test.py", "/conftest.py", "/conftest_", ".spec.ts", ".spec.js", ".spec.tsx", ".spec.jsx", "/__tests__/"]


@query(
    "test_path_flag",
    f"SELECT doc_id, path, {' OR '.join(f'''contains('/' || path, '{p}')''' for p in _TEST_PARTS)} AS is_test, NOT ({NOT_TEST}) AS test_filtered, CASE WHEN regexp_matches(path, '[.]py$') THEN 'python' ELSE 'typescript' END AS language FROM ({a.CHUNKS})",
)
def test_path_flag(spark, sf_dir):
    path = F.col("path")
    return a.chunks(spark, sf_dir).select("doc_id", "path", predicates.is_test_path(path).alias("is_test"), (~predicates.not_test_query(path)).alias("test_filtered"), scalar.language(path).alias("language"))


# ---- listing and aggregation ----
_BY_DIR = f"SELECT regexp_replace(path, '/[^/]*$', '') AS path, doc_id FROM ({a.CHUNKS})"


@query("chunks_by_path", f"SELECT path, count(*) AS n_chunks FROM ({_BY_DIR}) GROUP BY path")
def chunks_by_path(spark, sf_dir):
    return incremental.chunks_by_path(a.chunks(spark, sf_dir).withColumn("path", F.regexp_replace("path", "/[^/]*$", "")))


@query("list_chunks", f"SELECT path, start_line, end_line, symbol FROM ({a.CHUNKS}) WHERE starts_with(path, 'app/') ORDER BY path, start_line, end_line, symbol LIMIT 50")
def list_chunks(spark, sf_dir):
    return incremental.list_chunks(a.chunks(spark, sf_dir), 50, "app")


@query("chunk_count", f"SELECT count(*) AS n FROM ({a.CHUNKS})")
def chunk_count(spark, sf_dir):
    return a.chunks(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query(
    "scoped_chunks",
    f"SELECT doc_id, path FROM ({a.CHUNKS}) WHERE split_part(path, '/', 1) IN ('app', 'lib') AND {NOT_TEST}",
)
def scoped_chunks(spark, sf_dir):
    return a.chunks(spark, sf_dir).where(predicates.scope(F.col("path"), aliases=["app", "lib"], include_tests=False)).select("doc_id", "path")


# ---- incremental ----
_STORED = f"SELECT {a.PATH} AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN concat(text, 'x') ELSE text END) AS sha256 FROM documents WHERE doc_id % 10 <> 0"
_NOW = f"SELECT {a.PATH} AS path, sha256(text) AS sha256 FROM documents WHERE doc_id % 11 <> 1"


def _files(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = a.table(spark, sf_dir, "documents").withColumn("path", F.expr(a.PATH))
    stored = docs.where("doc_id % 10 <> 0").select("path", scalar.content_hash(F.when(F.expr("doc_id % 7 = 0"), F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("sha256"))
    return docs.where("doc_id % 11 <> 1").select("path", scalar.content_hash(F.col("text")).alias("sha256")), stored


@query("hash_diff", f"SELECT n.path, n.sha256 FROM ({_NOW}) n LEFT JOIN ({_STORED}) s ON n.path = s.path WHERE s.path IS NULL OR n.sha256 <> s.sha256")
def hash_diff(spark, sf_dir):
    return incremental.hash_diff(*_files(spark, sf_dir))


_RECONCILE = f"SELECT coalesce(n.path, s.path) AS path, CASE WHEN n.path IS NULL THEN 'stale' ELSE 'new' END AS status FROM ({_NOW}) n FULL OUTER JOIN ({_STORED}) s ON n.path = s.path WHERE n.path IS NULL OR s.path IS NULL"


@query("scope_reconcile", _RECONCILE)
def scope_reconcile(spark, sf_dir):
    return incremental.scope_reconcile(*_files(spark, sf_dir))


_PLAN = f"""WITH now AS ({_NOW}), stored AS ({_STORED}), status AS ({_RECONCILE}), upd AS (SELECT n.path FROM now n LEFT JOIN stored s ON n.path = s.path WHERE (contains(n.path, 'src1') OR n.path IN (SELECT path FROM status WHERE status = 'new')) AND (s.path IS NULL OR s.sha256 <> n.sha256)),
plan AS (SELECT path, 'remove' AS action FROM status WHERE status = 'stale' UNION ALL SELECT path, 'update' FROM upd UNION ALL SELECT path, 'cached' FROM now WHERE path NOT IN (SELECT path FROM upd))"""


def _plan(spark, sf_dir) -> DataFrame:
    now, stored = _files(spark, sf_dir)
    changed = now.where(F.contains("path", F.lit("src1"))).select("path")
    return incremental.incremental_plan(now, stored, changed, changed.where("false"))


@query("incremental_plan", _PLAN + " SELECT path, action FROM plan")
def incremental_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query("run_summary", _PLAN + " SELECT count(*) FILTER (action = 'cached') AS cached, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'remove') AS removed FROM plan")
def run_summary(spark, sf_dir):
    return incremental.run_summary(_plan(spark, sf_dir))


@query("resume_batches", f"SELECT path, CAST((row_number() OVER (ORDER BY path) - 1) // 200 AS BIGINT) AS batch FROM ({a.CHUNKS})")
def resume_batches(spark, sf_dir):
    return incremental.resume_batches(a.chunks(spark, sf_dir).select("path"))


@query("replace_by_path", f"SELECT path, sha256 FROM ({_STORED}) WHERE path NOT IN (SELECT path FROM ({_NOW})) UNION ALL {_NOW}")
def replace_by_path(spark, sf_dir):
    now, stored = _files(spark, sf_dir)
    return incremental.replace_by_path(stored, now, now)


# ---- graph ----
_GRAPH = f"WITH RECURSIVE nodes AS ({a.NODES}), edges AS ({a.EDGES}), cand AS (SELECT symbol, count(*) AS n, min(id) AS id FROM (SELECT name AS symbol, id FROM nodes UNION SELECT qualified_name, id FROM nodes) GROUP BY symbol), miss AS (SELECT DISTINCT target FROM edges WHERE kind = 'calls' AND target NOT IN (SELECT id FROM nodes))"


@query("edge_filter", f"{_GRAPH} SELECT source, target, kind FROM edges WHERE kind = 'imports' AND contains(source, 'nation_1') AND contains(target, '::n')")
def edge_filter(spark, sf_dir):
    return predicates.edge_filter(a.edges(spark, sf_dir), "imports", "nation_1", "::n")


@query("external_edges", f"{_GRAPH} SELECT source, target, kind FROM edges WHERE split_part(target, '::', 1) IN (SELECT file_path FROM nodes)")
def external_edges(spark, sf_dir):
    return predicates.known_edges(a.edges(spark, sf_dir), a.nodes(spark, sf_dir).select(F.col("file_path").alias("path")))


@query("multi_kind_edges", f"{_GRAPH} SELECT source, target, string_agg(kind, ',' ORDER BY kind) AS kinds FROM edges GROUP BY source, target")
def multi_kind_edges(spark, sf_dir):
    return graph.merged_kinds(a.edges(spark, sf_dir))


@query("graph_counts", f"{_GRAPH} SELECT (SELECT count(*) FROM (SELECT id FROM nodes UNION SELECT source FROM edges UNION SELECT target FROM edges)) AS node_count, (SELECT count(*) FROM (SELECT DISTINCT source, target FROM edges)) AS edge_count")
def graph_counts(spark, sf_dir):
    return graph.counts(a.nodes(spark, sf_dir), a.edges(spark, sf_dir))


@query(
    "symbol_resolve",
    f"""{_GRAPH}, s AS (SELECT DISTINCT name AS symbol FROM nodes UNION SELECT qualified_name FROM nodes UNION SELECT id FROM nodes WHERE kind <> 'function' UNION SELECT 'nowhere'),
    sn AS (SELECT name AS symbol, min(id) AS id FROM nodes GROUP BY name HAVING count(DISTINCT id) = 1), qn AS (SELECT qualified_name AS symbol, min(id) AS id FROM nodes GROUP BY qualified_name HAVING count(DISTINCT id) = 1)
    SELECT s.symbol, coalesce(e.id, sn.id, qn.id) AS id, CASE WHEN e.id IS NOT NULL THEN 'id' WHEN sn.id IS NOT NULL THEN 'name' WHEN qn.id IS NOT NULL THEN 'qualified' END AS how FROM s LEFT JOIN nodes e ON e.id = s.symbol LEFT JOIN sn ON sn.symbol = s.symbol LEFT JOIN qn ON qn.symbol = s.symbol""",
)
def symbol_resolve(spark, sf_dir):
    nodes = a.nodes(spark, sf_dir)
    asked = nodes.select(F.col("name").alias("symbol")).unionByName(nodes.select(F.col("qualified_name").alias("symbol"))).unionByName(nodes.where("kind <> 'function'").select(F.col("id").alias("symbol")))
    return graph.resolve(asked.unionByName(spark.createDataFrame([("nowhere",)], "symbol string")), nodes)


@query("ambiguous_symbols", f"{_GRAPH} SELECT symbol, n FROM cand WHERE n > 1")
def ambiguous_symbols(spark, sf_dir):
    return graph.ambiguous(a.nodes(spark, sf_dir))


_METHODS = "SELECT concat('f', CAST(c_nationkey AS STRING), '::K', CAST(c_custkey AS STRING), '.go', CAST(c_custkey % 9 AS STRING)) AS id, concat('f', CAST(c_nationkey AS STRING)) AS file_path, concat('K', CAST(c_custkey AS STRING), '.go', CAST(c_custkey % 9 AS STRING)) AS qualified_name FROM customer"


@query(
    "fuzzy_resolve",
    f"WITH m AS ({_METHODS}), asked AS (SELECT DISTINCT file_path || '::Any.go' || i AS symbol, file_path, 'go' || i AS last FROM m, (SELECT unnest(range(0, 12)) AS i)), k AS (SELECT file_path, list_last(string_split(qualified_name, '.')) AS last, min(id) AS id FROM m GROUP BY 1, 2 HAVING count(DISTINCT id) = 1) SELECT symbol, id FROM asked JOIN k USING (file_path, last)",
)
def fuzzy_resolve(spark, sf_dir):
    """Methods of several classes in a file: names that one, several or no method there has."""
    nodes = a.view(spark, sf_dir, _METHODS, "customer")
    asked = nodes.select(F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"), "file_path").select(F.concat("file_path", F.lit("::Any.go"), F.col("i").cast("string")).alias("symbol")).distinct()
    return graph.fuzzy_resolve(asked, nodes)


@query("phantom_calls", f"{_GRAPH} SELECT target AS id FROM miss")
def phantom_calls(spark, sf_dir):
    return graph.phantoms(a.nodes(spark, sf_dir), a.edges(spark, sf_dir))


_REWRITE = "SELECT DISTINCT source, coalesce(m.id, target) AS target, kind FROM edges LEFT JOIN ({moved}) m ON m.t = target AND kind = 'calls'"


@query("rewrite_bare_phantoms", f"{_GRAPH} " + _REWRITE.format(moved="SELECT target AS t, id FROM miss JOIN cand ON symbol = target AND n = 1 WHERE NOT contains(target, '::')"))
def rewrite_bare_phantoms(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.rewrite_bare_phantoms(edges, nodes, unique=True)


@query("rewrite_package_phantoms", f"{_GRAPH} " + _REWRITE.format(moved="SELECT target AS t, id FROM miss JOIN cand ON symbol = split_part(target, '::', 2) AND n = 1 WHERE contains(target, '::')"))
def rewrite_package_phantoms(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.rewrite_package_phantoms(edges, nodes, unique=True)


@query(
    "prune_phantoms",
    f"""WITH nodes AS MATERIALIZED ({a.NODES}), edges AS MATERIALIZED ({a.EDGES}), cand AS MATERIALIZED (SELECT symbol, count(*) AS n FROM (SELECT name AS symbol, id FROM nodes UNION SELECT qualified_name, id FROM nodes) GROUP BY symbol),
    calls AS MATERIALIZED (SELECT DISTINCT target FROM edges WHERE kind = 'calls'), miss AS MATERIALIZED (SELECT c.target, CASE WHEN contains(c.target, '::') THEN split_part(c.target, '::', 2) ELSE c.target END AS symbol FROM calls c ANTI JOIN nodes n ON c.target = n.id),
    gone AS MATERIALIZED (SELECT target FROM miss LEFT JOIN cand USING (symbol) WHERE n IS NULL OR (n > 1 AND NOT contains(target, '::')))
    SELECT source, target, kind FROM edges WHERE kind <> 'calls' UNION ALL SELECT e.source, e.target, e.kind FROM edges e ANTI JOIN gone g ON e.target = g.target WHERE e.kind = 'calls'""",
)
def prune_phantoms(spark, sf_dir):
    return graph.prune_phantoms(a.edges(spark, sf_dir), a.nodes(spark, sf_dir))


def _impact_sql(node: str, depth: int) -> str:
    return f"""{_GRAPH}, start AS (SELECT '{node}' AS id UNION SELECT target FROM edges WHERE target NOT IN (SELECT id FROM nodes) AND contains(target, '::') AND split_part(target, '::', 2) = split_part('{node}', '::', 2)),
    reach(id, hop) AS (SELECT e.source, 1 FROM edges e JOIN start s ON e.target = s.id WHERE e.kind IN ('calls', 'imports', 'inherits') UNION SELECT e.source, r.hop + 1 FROM reach r JOIN edges e ON e.target = r.id WHERE r.hop < {depth} AND e.kind IN ('calls', 'imports', 'inherits') AND r.id NOT IN (SELECT id FROM nodes WHERE kind = 'module')),
    found AS (SELECT id, min(hop) AS hop FROM reach GROUP BY id), rep AS (SELECT n.id, CAST(hop AS INT) AS hop, kind, file_path FROM found JOIN nodes n USING (id) WHERE n.id <> split_part('{node}', '::', 1) OR '{node}' = split_part('{node}', '::', 1))
    SELECT id, hop, kind FROM rep a WHERE NOT (kind = 'module' AND EXISTS (SELECT 1 FROM rep b WHERE b.file_path = a.file_path AND b.kind <> 'module'))"""


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as a build stores them, the edges by target: made when they are first asked for, read from then on."""
    return kept(spark, sf_dir, "nodes", lambda: a.nodes(spark, sf_dir)), kept(spark, sf_dir, "edges", lambda: a.edges_by_target(spark, sf_dir))


def _impact(node: str, depth: int):
    return lambda spark, sf_dir: impact.impact_radius(node, *_graph(spark, sf_dir), depth).select("id", "hop", "kind")


for _d in (1, 2, 3):
    query(f"impact_radius_d{_d}", _impact_sql("region_1", _d))(_impact("region_1", _d))
query("impact_aliases", _impact_sql("nation_3::c1", 2))(_impact("nation_3::c1", 2))


def _impact_many_sql(depth: int) -> str:
    return f"""{_GRAPH}, m AS (SELECT DISTINCT target FROM edges WHERE target NOT IN (SELECT id FROM nodes)), start AS (SELECT id AS origin, id FROM nodes UNION SELECT n.id, m.target FROM nodes n JOIN m ON contains(n.id, '::') AND split_part(m.target, '::', -1) = split_part(n.id, '::', 2)
    UNION SELECT n.id, n.name FROM (SELECT name, min(id) AS id FROM nodes GROUP BY name HAVING count(DISTINCT id) = 1) n JOIN m ON m.target = n.name WHERE NOT contains(n.name, '::')),
    reach(origin, id, hop) AS (SELECT s.origin, e.source, 1 FROM edges e JOIN start s ON e.target = s.id WHERE e.kind IN ('calls', 'imports', 'inherits') UNION SELECT r.origin, e.source, r.hop + 1 FROM reach r JOIN edges e ON e.target = r.id WHERE r.hop < {depth} AND e.kind IN ('calls', 'imports', 'inherits') AND r.id NOT IN (SELECT id FROM nodes WHERE kind = 'module')),
    found AS (SELECT origin, id, min(hop) AS hop FROM reach GROUP BY origin, id), rep AS (SELECT origin, n.id, CAST(hop AS INT) AS hop, kind, file_path FROM found JOIN nodes n USING (id) WHERE n.id <> split_part(origin, '::', 1) OR origin = split_part(origin, '::', 1))
    SELECT origin, id, hop, kind FROM rep a WHERE NOT (kind = 'module' AND EXISTS (SELECT 1 FROM rep b WHERE b.origin = a.origin AND b.file_path = a.file_path AND b.kind <> 'module'))"""


@query("impact_radius_many", _impact_many_sql(3))
def impact_radius_many(spark, sf_dir):
    """What depends on each node there is, within three hops, in one job."""
    nodes, edges = _graph(spark, sf_dir)
    return impact.impact_radius_many(nodes.select("id"), nodes, edges, 3).select("origin", "id", "hop", "kind")


#: A class for each nation, which inherits from the one before it in its region; classes of even number have the method.
_CLASSES = "SELECT n_nationkey AS k, concat('r', CAST(n_regionkey AS STRING), '::N', CAST(n_nationkey AS STRING)) AS id, lag(concat('r', CAST(n_regionkey AS STRING), '::N', CAST(n_nationkey AS STRING))) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS parent FROM nation"


@query(
    "impact_seeds",
    f"WITH c AS ({_CLASSES}), m AS (SELECT id || '.meet' AS id FROM c WHERE k % 2 = 0) SELECT id || '.meet' AS id FROM c UNION SELECT parent || '.meet' FROM c WHERE parent || '.meet' IN (SELECT id FROM m)",
)
def impact_seeds(spark, sf_dir):
    """Seeds of every class's method: itself, and its parent's if that class has one."""
    classes = a.view(spark, sf_dir, _CLASSES, "nation")
    nodes = classes.select("id").unionByName(classes.where("k % 2 = 0").select(F.concat("id", F.lit(".meet")).alias("id")))
    edges = classes.where("parent is not null").select(F.col("id").alias("source"), F.col("parent").alias("target"), F.lit("inherits").alias("kind"))
    return impact.seeds(classes.select(F.concat("id", F.lit(".meet")).alias("id")), nodes, edges)


@query("impact_module_suppress", f"{_GRAPH} SELECT id, kind FROM nodes a WHERE (kind = 'module' OR contains(id, '::n1')) AND NOT (kind = 'module' AND EXISTS (SELECT 1 FROM nodes b WHERE b.file_path = a.file_path AND contains(b.id, '::n1')))")
def impact_module_suppress(spark, sf_dir):
    some = a.nodes(spark, sf_dir).where("kind = 'module' or contains(id, '::n1')")
    return impact.suppress_modules(some).select("id", "kind")


@query("zero_caller_hint", f"{_GRAPH} SELECT n.id, coalesce(i.n, 0) AS n_importers FROM nodes n LEFT JOIN (SELECT target, count(DISTINCT source) AS n FROM edges WHERE kind = 'imports' GROUP BY target) i ON i.target = n.file_path WHERE n.id NOT IN (SELECT target FROM edges WHERE kind IN ('calls', 'inherits'))")
def zero_caller_hint(spark, sf_dir):
    return impact.zero_caller_hints(a.nodes(spark, sf_dir), a.edges(spark, sf_dir))


# ---- scalars ----
_URL_PATH = "concat(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), CASE page_id % 3 WHEN 0 THEN '/__init__.py' WHEN 1 THEN '/mod.ts' ELSE '/index.js' END)"
_NAMES = f"""WITH p AS (SELECT page_id, {_URL_PATH} AS path FROM pages), q AS (SELECT page_id, path, string_split(regexp_replace(path, '[.](tsx|pyi|jsx|mjs|cjs|py|js|ts)$', ''), '/') AS w FROM p),
r AS (SELECT page_id, path, CASE WHEN w[-1] IN ('__init__', 'index') AND len(w) > 1 THEN w[:-2] ELSE w END AS w FROM q), s AS (SELECT page_id, path, w, unnest(range(1, len(w) + 1)) AS i FROM r),
names AS (SELECT page_id, path, array_to_string(w[i:], '.') AS module FROM s UNION ALL SELECT page_id, path, array_to_string(w[i:], '/') FROM s WHERE i < len(w))"""


def _paths(spark, sf_dir) -> DataFrame:
    return a.table(spark, sf_dir, "pages").select("page_id", F.expr(_URL_PATH).alias("path"))


@query("module_names", _NAMES + " SELECT page_id, module FROM names")
def module_names(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", F.explode(scalar.module_names(F.col("path"))).alias("module"))


@query("module_index", _NAMES + " SELECT module, min(path) AS path FROM names GROUP BY module")
def module_index(spark, sf_dir):
    return graph.module_index(_paths(spark, sf_dir))


@query(
    "relative_import",
    f"""WITH p AS (SELECT doc_id, {a.PATH} AS path, CASE doc_id % 6 WHEN 0 THEN './x' WHEN 1 THEN '../y/z' WHEN 2 THEN '.a.b' WHEN 3 THEN '..m' WHEN 4 THEN '....k' ELSE 'abs.z' END AS spec, string_split(path, '/') AS w FROM documents)
    SELECT doc_id, spec, CASE doc_id % 6 WHEN 0 THEN array_to_string(w[:-2], '/') || '/x' WHEN 1 THEN array_to_string(w[:-3], '/') || '/y/z' WHEN 2 THEN array_to_string(w[:-2], '/') || '/a/b' WHEN 3 THEN array_to_string(w[:-3], '/') || '/m'
    WHEN 4 THEN CASE WHEN len(w) - 1 < 3 THEN NULL ELSE array_to_string(list_append(w[1:len(w) - 4], 'k'), '/') END END AS resolved FROM p""",
)
def relative_import(spark, sf_dir):
    spec = F.expr("CASE doc_id % 6 WHEN 0 THEN './x' WHEN 1 THEN '../y/z' WHEN 2 THEN '.a.b' WHEN 3 THEN '..m' WHEN 4 THEN '....k' ELSE 'abs.z' END")
    rows = a.chunks(spark, sf_dir).select("doc_id", "path", spec.alias("spec"))
    return rows.select("doc_id", "spec", scalar.relative_import(F.col("path"), F.col("spec")).alias("resolved"))


@query("node_id_split", f"{_GRAPH} SELECT source, split_part(source, '::', 1) AS file, CASE WHEN contains(source, '::') THEN split_part(source, '::', 2) END AS qualified, list_last(string_split(list_last(string_split(target, '::')), '.')) AS last FROM edges")
def node_id_split(spark, sf_dir):
    e = a.edges(spark, sf_dir)
    return e.select("source", scalar.file_of(F.col("source")).alias("file"), scalar.qualified_of(F.col("source")).alias("qualified"), scalar.last_component(F.col("target")).alias("last"))


@query("target_kind", f"{_GRAPH} SELECT source, target, kind, CASE WHEN target IN (SELECT id FROM nodes) OR contains(target, '::') THEN 'resolved_node' WHEN kind = 'imports' THEN 'module_ref' ELSE 'phantom' END AS target_kind FROM edges")
def target_kind(spark, sf_dir):
    known = a.nodes(spark, sf_dir).select(F.col("id").alias("target"), F.lit(True).alias("_known"))
    joined = a.edges(spark, sf_dir).join(known, "target", "left")
    return joined.select("source", "target", "kind", scalar.target_kind(F.col("target"), F.col("kind"), F.coalesce("_known", F.lit(False))).alias("target_kind"))


@query("alias_sanitize", "WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS alias FROM pages) SELECT page_id, CASE alias WHEN '' THEN 'root' ELSE alias END AS alias FROM p")
def alias_sanitize(spark, sf_dir):
    return a.table(spark, sf_dir, "pages").select("page_id", scalar.sanitize_alias(F.col("url")).alias("alias"))


_ARG = f"concat({a.PATH}, CASE doc_id % 3 WHEN 0 THEN concat(':', CAST(doc_id % 9 + 1 AS STRING), '-', CAST(doc_id % 7 + 3 AS STRING)) ELSE '' END)"


@query("path_range_parse", f"SELECT doc_id, {a.PATH} AS path, CASE doc_id % 3 WHEN 0 THEN CAST(doc_id % 9 + 1 AS INT) END AS lo, CASE doc_id % 3 WHEN 0 THEN CAST(doc_id % 7 + 3 AS INT) END AS hi, doc_id % 3 = 0 AND doc_id % 7 + 3 < doc_id % 9 + 1 AS error FROM documents")
def path_range_parse(spark, sf_dir):
    rows = a.table(spark, sf_dir, "documents").select("doc_id", scalar.path_range(F.expr(_ARG)).alias("r"))
    return rows.select("doc_id", "r.path", "r.lo", "r.hi", "r.error")


@query("matryoshka", "SELECT vec_id, array_to_string(list_transform(embedding[1:16], lambda x: CAST(round(x::DOUBLE * 10000) AS BIGINT)::STRING), ' ') AS head FROM embeddings")
def matryoshka(spark, sf_dir):
    cut = scalar.matryoshka(F.col("embedding"), 16)
    return a.table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(cut, lambda x: F.round(x.cast("double") * 10000).cast("long").cast("string")), " ").alias("head"))


@query("embed_format", f"SELECT doc_id, sha256(concat(path, chr(10), symbol, chr(10), content)) AS text_sha256, concat('search_document: ', symbol) AS prefixed FROM ({a.CHUNKS})")
def embed_format(spark, sf_dir):
    return a.chunks(spark, sf_dir).select("doc_id", scalar.content_hash(scalar.search_text(F.col("path"), F.col("symbol"), F.col("content"))).alias("text_sha256"), scalar.with_prefix(F.col("symbol"), "document", "nomic-embed-text").alias("prefixed"))


# ---- events and state ----
_BURSTS = f"""WITH e AS ({a.EVENTS}), g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM e), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS n FROM g),
w AS (SELECT *, min(ts) OVER (PARTITION BY user_id, n) AS first, max(ts) OVER (PARTITION BY user_id, n) + INTERVAL 6 HOUR AS last FROM s)"""


@query("event_debounce", _BURSTS + " SELECT user_id AS key, first AS start, last AS \"end\", path, arg_max(op, (ts, seq)) AS op FROM w GROUP BY user_id, first, last, path")
def event_debounce(spark, sf_dir):
    return ev.debounced(a.events(spark, sf_dir), "6 hours", F.col("user_id"))


@query("event_last_wins", f"SELECT user_id, path, arg_max(op, (ts, seq)) AS op FROM ({a.EVENTS}) GROUP BY user_id, path")
def event_last_wins(spark, sf_dir):
    return ev.last_wins(a.events(spark, sf_dir), ["user_id"])


@query(
    "event_moves",
    "WITH e AS (SELECT event_id, ts, event_id % 4 AS k, concat('app/f', CAST(user_id AS STRING), '.py') AS path, concat('app/.git/g', CAST(user_id AS STRING)) AS dest FROM events) SELECT event_id AS seq, path, CASE WHEN k IN (2, 3) THEN 'removed' ELSE 'changed' END AS op FROM e",
)
def event_moves(spark, sf_dir):
    raw = a.table(spark, sf_dir, "events").select(
        "ts", F.col("event_id").alias("seq"), F.expr("element_at(array('created', 'modified', 'deleted', 'moved'), CAST(event_id % 4 AS INT) + 1)").alias("event_type"), F.expr("concat('app/f', user_id, '.py')").alias("path"),
        F.expr("concat('app/.git/g', user_id)").alias("dest_path"), F.lit(False).alias("is_directory"),
    )
    return ev.expand(raw).where(ev.indexable(F.col("path"), ["app"])).select("seq", "path", "op")


@query(
    "state_transitions",
    f"""WITH e AS ({a.ACTIONS}), s AS (SELECT *, max(CASE WHEN action = 'start' THEN 1 END) OVER w AS started FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT *, CASE WHEN action IN ('start', 'error', 'finish') AND started = 1 THEN 1 ELSE 0 END AS sets FROM s), r AS (SELECT *, sum(sets) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM t),
    u AS (SELECT *, max(CASE WHEN sets = 1 THEN action END) OVER (PARTITION BY user_id, run) AS what, max(CASE WHEN action = 'incomplete' THEN 1 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS inc FROM r),
    v AS (SELECT *, CASE WHEN what = 'start' AND inc = 1 THEN 'incomplete' WHEN what = 'start' THEN 'in_progress' WHEN what = 'error' THEN 'errored' WHEN what = 'finish' THEN 'done' END AS after FROM u)
    SELECT user_id, event_id, action, after, lag(after) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM v""",
)
def state_transitions(spark, sf_dir):
    return state.state_log(a.actions(spark, sf_dir), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "action", "after", "before")


# ---- parsers, over a source for each document: classes of one to four methods, and every fifth in another language ----
_PY = "concat('d', CAST(doc_id % 9 AS STRING), '/a', CAST(doc_id AS STRING), '.py')"
_TS = "concat('d', CAST(doc_id % 9 AS STRING), '/k', CAST(doc_id AS STRING), '.ts')"
_PY_TEXT = """concat('from m', doc_id % 10, ' import helper\n\nclass A', doc_id, ':\n', array_join(transform(sequence(0, CAST(doc_id % 4 AS INT)), i -> concat('    def run', i, '(self):\n        return helper(', i, ')\n')), ''),
'\ndef main():\n    return A', doc_id, '()\n')"""
_TS_TEXT = "'import { go } from \\'./lib\\';\nexport function start(n: number) {\n  return go(n);\n}\n'"
#: The same rows in SQL: a source, its number of methods, and each method.
_PARSED = f"WITH s AS (SELECT doc_id, {_PY} AS path, {_TS} AS ts, CAST(doc_id % 4 + 1 AS INT) AS k, doc_id % 5 = 0 AS other FROM documents), py AS (SELECT * FROM s WHERE NOT other), ts AS (SELECT * FROM s WHERE other), m AS (SELECT *, unnest(range(0, k)) AS i FROM py)"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.table(spark, sf_dir, "documents")
    return rows.select(F.expr(f"CASE WHEN doc_id % 5 = 0 THEN {_TS} ELSE {_PY} END").alias("path"), F.expr(f"CASE WHEN doc_id % 5 = 0 THEN {_TS_TEXT} ELSE {_PY_TEXT} END").alias("content"))


@query(
    "python_chunks",
    f"""{_PARSED} SELECT path, 1 AS start_line, CAST(7 + 2 * k AS INT) AS end_line, '<module>' AS symbol FROM py UNION ALL SELECT path, 3, CAST(3 + 2 * k AS INT), 'A' || doc_id FROM py UNION ALL SELECT path, CAST(4 + 2 * i AS INT), CAST(5 + 2 * i AS INT), 'run' || i FROM m
    UNION ALL SELECT path, CAST(5 + 2 * k AS INT), CAST(6 + 2 * k AS INT), 'main' FROM py UNION ALL SELECT ts, 1, 5, '<module>' FROM ts UNION ALL SELECT ts, 2, 4, 'start' FROM ts""",
)
def python_chunks(spark, sf_dir):
    return parsers.chunk_files(_sources(spark, sf_dir)).select("path", "start_line", "end_line", "symbol")


@query(
    "skeleton_rows",
    f"""{_PARSED} SELECT path, 0 AS depth, 'class' AS kind, 'A' || doc_id AS qualified_name, 3 AS start_line, CAST(3 + 2 * k AS INT) AS end_line, 'class A' || doc_id || ':' AS signature FROM py
    UNION ALL SELECT path, 1, 'function', 'A' || doc_id || '.run' || i, CAST(4 + 2 * i AS INT), CAST(5 + 2 * i AS INT), 'def run' || i || '(self):' FROM m UNION ALL SELECT path, 0, 'function', 'main', CAST(5 + 2 * k AS INT), CAST(6 + 2 * k AS INT), 'def main():' FROM py
    UNION ALL SELECT ts, 0, 'function', 'start', 2, 4, 'export function start(n: number)' FROM ts""",
)
def skeleton_rows(spark, sf_dir):
    return parsers.skeleton(_sources(spark, sf_dir)).select("path", "depth", "kind", "qualified_name", "start_line", "end_line", "signature")


@query(
    "graph_facts",
    f"""{_PARSED}, c AS (SELECT *, path || '::A' || doc_id AS class FROM py), l AS (SELECT *, string_split(ts, '/')[1] || '/lib' AS lib FROM ts)
    SELECT path AS source, 'm' || (doc_id % 10) AS target, 'imports' AS kind FROM py UNION ALL SELECT path, class, 'defines' FROM c UNION ALL SELECT path, path || '::main', 'defines' FROM c
    UNION ALL SELECT path || '::A' || doc_id, path || '::A' || doc_id || '.run' || i, 'defines' FROM m UNION ALL SELECT path || '::A' || doc_id || '.run' || i, 'm' || (doc_id % 10) || '::helper', 'calls' FROM m UNION ALL SELECT path || '::main', class, 'calls' FROM c
    UNION ALL SELECT ts, lib, 'imports' FROM l UNION ALL SELECT ts, ts || '::start', 'defines' FROM l UNION ALL SELECT ts || '::start', lib || '::go', 'calls' FROM l""",
)
def graph_facts(spark, sf_dir):
    return parsers.graph_facts(_sources(spark, sf_dir))[1]


@query("embed_hashing", None)
def embed_hashing(spark, sf_dir):
    vector = embed_column(F.col("content"), HashingEmbedder(64))
    return a.chunks(spark, sf_dir).select("doc_id", vector.alias("vector"))
