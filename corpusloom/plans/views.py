"""Derived tables that the queries share, in Spark's and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "papers_v": """
SELECT concat('p', doc_id) AS paper_id, source AS owner_id, split_part(text, chr(10), 1) AS title,
  array(concat('Author ', doc_id % 50), concat('Ada B. Writer', doc_id % 9)) AS authors,
  CAST(1998 + doc_id % 27 AS INT) AS year,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('10.1000/d', doc_id % 400) END AS doi,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('Venue ', doc_id % 7) END AS venue,
  array(lang, concat('topic ', doc_id % 11)) AS keywords, sha2(text, 256) AS content_hash,
  CASE WHEN doc_id % 17 = 0 THEN 'failed' WHEN doc_id % 13 = 0 THEN 'embedding' ELSE 'indexed' END AS status,
  n_chars AS char_count, text AS full_text
FROM {documents}""",
    "kg_nodes_v": """
SELECT concat('s:', s_suppkey) AS id, s_name AS name, 'Method' AS type, p.papers FROM {supplier}
  JOIN (SELECT l_suppkey, collect_set(concat('o', l_orderkey)) AS papers FROM {lineitem} GROUP BY l_suppkey) p ON l_suppkey = s_suppkey
UNION ALL SELECT concat('p:', p_partkey), concat('Part ', p_partkey, CASE WHEN p_partkey % 10 = 0 THEN concat(' (P', p_partkey, ')') ELSE '' END), 'Dataset', p.papers FROM {part}
  JOIN (SELECT l_partkey, collect_set(concat('o', l_orderkey)) AS papers FROM {lineitem} GROUP BY l_partkey) p ON l_partkey = p_partkey
UNION ALL SELECT concat('pa:', l_partkey), concat('P', l_partkey), 'Dataset', collect_set(concat('o', l_orderkey)) FROM {lineitem} WHERE l_partkey % 10 = 0 AND l_orderkey % 10 = 0 GROUP BY l_partkey
UNION ALL SELECT concat('paper:o', l_orderkey), concat('Order ', l_orderkey), 'Paper', collect_set(concat('o', l_orderkey)) FROM {lineitem} GROUP BY l_orderkey""",
    "kg_edges_v": """
SELECT source, target, type, collect_set(paper) AS papers FROM (
  SELECT concat('s:', l_suppkey) AS source, concat('p:', l_partkey) AS target,
    CASE l_linenumber % 3 WHEN 0 THEN 'USES' WHEN 1 THEN 'EVALUATED_ON' ELSE 'APPLIED_TO' END AS type, concat('o', l_orderkey) AS paper FROM {lineitem}
  UNION ALL SELECT concat('p:', a.l_partkey), concat(CASE WHEN b.l_partkey % 10 = 0 THEN 'pa:' ELSE 'p:' END, b.l_partkey), 'COMPARES_WITH', concat('o', a.l_orderkey)
    FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey AND a.l_orderkey % 10 = 0
  UNION ALL SELECT concat('paper:o', l_orderkey), concat('s:', l_suppkey), 'MENTIONS', concat('o', l_orderkey) FROM {lineitem}) e
GROUP BY source, target, type""",
    "payloads_v": """
SELECT concat('o', l_orderkey) AS paper_id, 'datasets' AS field, p_name AS name, l_linenumber AS ord FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
UNION ALL SELECT concat('o', l_orderkey), 'methods', s_name, l_linenumber FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey
UNION ALL SELECT concat('o', l_orderkey), 'metrics', concat('flag ', l_returnflag), l_linenumber FROM {lineitem}""",
    "claims_v": """
SELECT concat('v', doc_id % 50) AS verification_id, doc_id AS claim_index, doc_id % 7 <> 0 AS checkable,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'supported' WHEN quality = 1 THEN 'partially_supported' WHEN toxic = 0 THEN 'unsupported' ELSE 'contradicted' END AS verdict
FROM {labels}""",
    "works_v": """
SELECT concat('W', doc_id) AS external_id, split_part(text, chr(10), 1) AS title, concat('10.1000/d', doc_id % 400) AS doi, n_chars % 500 AS citations,
  array(concat('W', (doc_id * 7 + 1) % n.n), concat('W', (doc_id * 3 + 2) % n.n)) AS related_works,
  array(concat('W', (doc_id * 5 + 3) % n.n), concat('W', (doc_id % 10))) AS referenced_works
FROM {documents} CROSS JOIN (SELECT count(*) AS n FROM {documents}) n""",
    "runs_v": """
SELECT concat('r', event_id) AS run_id, concat('u', user_id) AS owner_id,
  CASE event_type WHEN 'view' THEN 'qa' WHEN 'click' THEN 'summarize' WHEN 'purchase' THEN 'extract' WHEN 'signup' THEN 'gap' ELSE 'figures' END AS intent,
  CASE WHEN event_id % 3 = 0 THEN props ELSE NULL END AS question, CASE WHEN event_type = 'error' THEN 'partial' ELSE 'completed' END AS status,
  CAST(floor(value * 10) AS INT) AS duration_ms, ts AS created_at FROM {events}""",
    "job_items_v": """
SELECT concat('j', user_id) AS job_id, event_id AS item_no,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'indexed' WHEN 'signup' THEN 'duplicate' WHEN 'view' THEN 'running' ELSE 'queued' END AS state, ts FROM {events}""",
    "cache_v": """
SELECT sha2(props, 256) AS key, min(ts) AS created_at, count(*) - 1 AS hit_count FROM {events} GROUP BY props""",
    # papers with headings in their text
    "sectioned_v": """
SELECT concat('p', doc_id) AS paper_id, concat('Abstract', chr(10), text, chr(10), '1 Introduction', chr(10), text, chr(10), 'References', chr(10), 'none') AS full_text FROM {documents}""",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def duck(name: str) -> str:
    """The view as a DuckDB common table expression."""
    sql = VIEWS[name]
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return f"{name} AS ({sql.replace('sha2(text, 256)', 'sha256(text)').replace('sha2(props, 256)', 'sha256(props)').replace('array(', 'list_value(').replace('collect_set(concat', 'list(DISTINCT concat').replace('collect_set(paper)', 'list(DISTINCT paper)')})"


def with_views(names: list[str], sql: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(map(duck, names)) + ("," if sql.lstrip().startswith(",") else "\n") + sql.lstrip().lstrip(",")
