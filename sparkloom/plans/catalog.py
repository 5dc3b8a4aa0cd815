"""The driver's tables as a repository: files, symbols, imports, edges, memory.

Every view is one SQL text that Spark and DuckDB both run, so that a query and its oracle start from the same rows.
Operators never use these names; they take DataFrames.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()

#: In order: later views use earlier ones. {sha} is the dialect's SHA-256 of text.
VIEWS = {
    "files": """
SELECT doc_id, path, {sha} AS hash, n_chars AS size, 1700000000000 + doc_id * 1000 AS mtime, text,
  CASE ext WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.rs' THEN 'rust' WHEN '.go' THEN 'go' END AS language
FROM (
  SELECT doc_id, n_chars, text, ext, dir || base || ext AS path FROM (
    SELECT doc_id, n_chars, text,
      CASE doc_id % 7 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.rs' WHEN 3 THEN '.go' WHEN 4 THEN '.tsx' WHEN 5 THEN '.md' ELSE '.yml' END AS ext,
      CASE doc_id % 10 WHEN 0 THEN 'tests/' WHEN 1 THEN 'packages/' || source || '/models/' WHEN 2 THEN 'db/migrations/' WHEN 3 THEN 'dist/'
        WHEN 4 THEN 'node_modules/' || lang || '/' WHEN 5 THEN 'config/' ELSE 'packages/' || source || '/src/' END AS dir,
      CASE WHEN doc_id % 50 = 7 THEN '.env.' || doc_id WHEN doc_id % 50 = 17 THEN 'my_secrets_' || doc_id WHEN doc_id % 50 = 27 THEN 'schema' || doc_id
        WHEN doc_id % 8 = 1 THEN 'test_' || doc_id WHEN doc_id % 8 = 2 THEN 'n' || doc_id || '.test' WHEN doc_id % 8 = 3 THEN 'n' || doc_id || '_test'
        ELSE 'n' || doc_id END AS base
    FROM documents) x) y""",
    "symbols": """
SELECT 's' || p_partkey AS id, p_partkey AS ord, f.path AS file_path,
  CASE p_partkey % 6 WHEN 0 THEN 'get_' WHEN 1 THEN 'Model' WHEN 2 THEN 'GET' ELSE '' END || replace(p_name, ' ', '_') AS name,
  CASE p_partkey % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'const' WHEN 3 THEN 'interface' ELSE 'route' END AS kind,
  p_size AS line, p_partkey % 3 <> 0 AS exported
FROM part CROSS JOIN (SELECT count(*) AS total FROM documents) t JOIN files f ON f.doc_id = p_partkey % total""",
    "imports": """
SELECT p_partkey AS ord, f.path AS file_path,
  CASE p_partkey % 4 WHEN 0 THEN '@scope/pkg' || (p_partkey % 5) WHEN 1 THEN 'lib' || (p_partkey % 9) || '/sub' WHEN 2 THEN './n' || ((p_partkey * 3) % 1000) || '.js' ELSE '../src/n' || ((p_partkey * 7) % 1000) END AS source,
  CASE p_partkey % 3 WHEN 0 THEN '{{ ' || replace(p_name, ' ', '_') || ', other }}' WHEN 1 THEN replace(p_name, ' ', '_') || ' as ' || 'x' || (p_partkey % 7) ELSE '*' END AS specifier, p_size AS line
FROM part CROSS JOIN (SELECT count(*) AS total FROM documents) t JOIN files f ON f.doc_id = (p_partkey * 7) % total""",
    "edges": """
SELECT DISTINCT 'file:' || a AS from_id, 'file:' || b AS to_id, CASE k % 4 WHEN 0 THEN 'DEPENDS_ON' WHEN 1 THEN 'TESTS' ELSE 'IMPORTS' END AS edge_type
FROM (
  SELECT event_type || '_' || CAST(floor(value) AS INT) AS a, CAST(floor(value) AS INT) AS k,
    lead(event_type || '_' || CAST(floor(value) AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b
  FROM events) x WHERE b IS NOT NULL""",
    "memory": """
SELECT CAST(d.doc_id AS VARCHAR(20)) AS id, CASE d.doc_id % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'note' WHEN 2 THEN 'task' ELSE 'session' END AS type,
  lang || ' ' || source || ' ' || d.doc_id AS title, text AS content, lang || ',' || source AS tags, d.doc_id * 1000 AS created_at, (d.doc_id * 7919) % 100003 AS updated_at
FROM documents d""",
}


def with_views(sql: str) -> str:
    """DuckDB text: the views as CTEs before the query."""
    made = ", ".join(f"{k} AS ({v.format(sha='sha256(text)')})" for k, v in VIEWS.items())
    return f"WITH RECURSIVE {made}, {sql.strip()[4:].strip()}" if sql.strip().upper().startswith("WITH") else f"WITH RECURSIVE {made} {sql}"


class Catalog:
    """The views over one folder of tables, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._views: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            sql = VIEWS[name].format(sha="sha2(text, 256)")
            words = set(sql.replace("(", " ").replace(")", " ").split())
            ctes = [v for v in VIEWS if v != name and v in words]
            known = {t: self.table(t) for t in TABLES if t in words} | {v: self.view(v) for v in ctes}
            for k, df in known.items():
                df.createOrReplaceTempView(f"sparkloom_{k}")
                sql = _renamed(sql, k)
            self._views[name] = self.spark.sql(sql)
        return self._views[name]

    files = cached_property(lambda self: self.view("files"))
    symbols = cached_property(lambda self: self.view("symbols"))
    imports = cached_property(lambda self: self.view("imports"))
    edges = cached_property(lambda self: self.view("edges"))
    memory = cached_property(lambda self: self.view("memory"))


def _renamed(sql: str, name: str) -> str:
    """Table name after FROM or JOIN as the temporary view's."""
    for word in ("FROM", "JOIN"):
        sql = sql.replace(f"{word} {name} ", f"{word} sparkloom_{name} ").replace(f"{word} {name})", f"{word} sparkloom_{name})")
        if sql.endswith(f"{word} {name}"):
            sql = sql[:-len(name)] + f"sparkloom_{name}"
    return sql
