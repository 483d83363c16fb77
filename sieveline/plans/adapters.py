"""The engine's relations as views of the test tables. The expressions read alike in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PATH = (
    "concat(CASE doc_id % 5 WHEN 0 THEN 'app/src' WHEN 1 THEN 'app/tests' WHEN 2 THEN 'lib/core' WHEN 3 THEN 'web/src/__tests__' ELSE 'lib/src/latest' END, '/', source, '/', "
    "CASE WHEN doc_id % 11 = 0 THEN concat('d', CAST(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN '/conftest.py' WHEN 1 THEN '/conftest_db.py' ELSE '/spec/a.test.ts' END) ELSE concat('doc_', CAST(doc_id AS STRING), "
    "CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '_test.py' WHEN 2 THEN '.spec.ts' ELSE '.ts' END) END)"
)
LINES = "CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT)"
CHUNKS = f"SELECT doc_id, {PATH} AS path, 1 AS start_line, {LINES} AS end_line, lang AS symbol, text AS content FROM documents"
VECTORS = "SELECT vec_id AS doc_id, embedding AS vector FROM embeddings"
NODES = """
SELECT concat('region_', CAST(r_regionkey AS STRING)) AS id, 'module' AS kind, concat('region_', CAST(r_regionkey AS STRING)) AS file_path, 1 AS start_line, 100 AS end_line, r_name AS name, r_name AS qualified_name FROM region
UNION ALL SELECT concat('region_', CAST(n_regionkey AS STRING), '::n', CAST(n_nationkey AS STRING)), 'class', concat('region_', CAST(n_regionkey AS STRING)), n_nationkey + 1, n_nationkey + 2, n_name, concat('n', CAST(n_nationkey AS STRING)) FROM nation
UNION ALL SELECT concat('nation_', CAST(c_nationkey AS STRING), '::c', CAST(c_custkey AS STRING)), 'function', concat('nation_', CAST(c_nationkey AS STRING)), 1, 2, c_mktsegment, concat('c', CAST(c_custkey AS STRING)) FROM customer
UNION ALL SELECT concat('nation_', CAST(s_nationkey AS STRING), '::s', CAST(s_suppkey AS STRING)), 'function', concat('nation_', CAST(s_nationkey AS STRING)), 1, 2, s_name, concat('s', CAST(s_suppkey AS STRING)) FROM supplier
UNION ALL SELECT concat('parts::p', CAST(p_partkey AS STRING)), 'function', 'parts', 1, 2, p_name, concat('p', CAST(p_partkey AS STRING)) FROM part
UNION ALL SELECT concat('orders::o', CAST(o_orderkey AS STRING)), 'function', 'orders', 1, 2, concat('o', CAST(o_orderkey AS STRING)), concat('o', CAST(o_orderkey AS STRING)) FROM orders
"""
_LINKS = """SELECT concat('orders::o', CAST(o_orderkey AS STRING)) AS source, CASE WHEN o_custkey % 50 = 0 THEN c_mktsegment WHEN o_custkey % 50 = 1 THEN concat('pkg::c', CAST(c_custkey AS STRING)) WHEN o_custkey % 50 = 2 THEN concat('pkg::x', CAST(c_custkey AS STRING))
  WHEN o_custkey % 50 = 3 THEN concat('c', CAST(c_custkey AS STRING)) ELSE concat('nation_', CAST(c_nationkey AS STRING), '::c', CAST(c_custkey AS STRING)) END AS target, 'calls' AS kind FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT concat('orders::o', CAST(l_orderkey AS STRING)), concat('parts::p', CAST(l_partkey AS STRING)), 'calls' FROM lineitem
UNION ALL SELECT concat('nation_', CAST(c_nationkey AS STRING), '::c', CAST(c_custkey AS STRING)), concat('region_', CAST(n_regionkey AS STRING), '::n', CAST(n_nationkey AS STRING)), 'imports' FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT concat('nation_', CAST(s_nationkey AS STRING), '::s', CAST(s_suppkey AS STRING)), concat('region_', CAST(n_regionkey AS STRING), '::n', CAST(n_nationkey AS STRING)), 'imports' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT concat('region_', CAST(n_regionkey AS STRING), '::n', CAST(n_nationkey AS STRING)), concat('region_', CAST(n_regionkey AS STRING)), 'inherits' FROM nation
UNION ALL SELECT concat('region_', CAST(n_regionkey AS STRING), '::n', CAST(n_nationkey AS STRING)), concat('region_', CAST(n_regionkey AS STRING)), 'imports' FROM nation"""
EDGES = f"""
SELECT DISTINCT source, target, kind FROM (
{_LINKS})
"""
EVENTS = "SELECT user_id, ts, event_id AS seq, concat('f', CAST(event_id % 7 AS STRING)) AS path, CASE event_type WHEN 'error' THEN 'removed' ELSE 'changed' END AS op FROM events"
ACTIONS = "SELECT user_id, ts, event_id, CASE event_id % 5 WHEN 0 THEN 'start' WHEN 1 THEN 'progress' WHEN 2 THEN 'incomplete' WHEN 3 THEN 'finish' ELSE 'error' END AS action FROM events"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The rows of a query over some of the tables, which are given to it by name without touching the catalogue."""
    for t in tables:
        sql = _named(sql, t)
    return spark.sql(sql, **{f"t_{t}": table(spark, sf_dir, t) for t in tables})


def _named(sql: str, table_name: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {table_name}\b", rf"\1 {{t_{table_name}}}", sql)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CHUNKS, "documents")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, VECTORS, "embeddings")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, NODES, "region", "nation", "customer", "supplier", "part", "orders")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EDGES, "orders", "customer", "lineitem", "nation", "supplier")


def edges_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, those of a target in one partition and in order: they are shuffled once, by target, and made distinct where they are sorted."""
    links = view(spark, sf_dir, _LINKS, "orders", "customer", "lineitem", "nation", "supplier").repartition("target")
    same = Window.partitionBy("target", "source", "kind").orderBy("kind")
    return links.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EVENTS, "events")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ACTIONS, "events")
