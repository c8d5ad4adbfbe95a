"""Evidence tables derived from the given tables, as SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "conversations")

FIXTURES = {
    "fx_framework": "SELECT * FROM (VALUES ('basic_info',1,'brand',1,true),('basic_info',1,'kind',2,true),('performance_metrics',2,'size',1,false),('business_info',3,'price',1,true),('history',4,'release_date',1,false)) AS t(category, category_pos, field, field_pos, required)",
    "fx_field": """SELECT p_partkey AS item_id, concat('part_', CAST(p_partkey AS STRING)) AS slug, pos, category, field, value FROM (
  SELECT p_partkey, 1 AS pos, 'basic_info' AS category, 'brand' AS field, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS value FROM {part}
  UNION ALL SELECT p_partkey, 2, 'basic_info', 'kind', CASE WHEN p_partkey % 11 = 0 THEN '[uncertain]' ELSE p_type END FROM {part}
  UNION ALL SELECT p_partkey, 3, 'performance_metrics', 'size', CAST(p_size AS STRING) FROM {part} WHERE p_partkey % 5 <> 0
  UNION ALL SELECT p_partkey, 4, 'business_info', 'price', CAST(CAST(p_retailprice * 100 AS BIGINT) AS STRING) FROM {part} WHERE p_partkey % 13 <> 0
  UNION ALL SELECT p_partkey, 5, 'Other Info', 'nickname', p_name FROM {part} WHERE p_partkey % 3 = 0) u""",
    "fx_sidecar": "SELECT doc_id AS item_id, CASE WHEN quality = 1 THEN 'high' WHEN toxic = 1 THEN 'low' ELSE 'medium' END AS confidence, toxic AS n_conflicts FROM {labels}",
    "fx_source": "SELECT CAST(floor(page_id / 3) AS BIGINT) AS item_id, page_id AS ord, url FROM {pages}",
    "fx_citation": "SELECT CAST(floor(page_id / 3) AS BIGINT) AS item_id, 'brand' AS field, page_id % 3 AS ref_ord, CASE WHEN page_id % 9 = 0 THEN 'http://nowhere.invalid/' ELSE url END AS ref FROM {pages}",
    "fx_round": "SELECT o_custkey AS item_id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS round_no, o_orderkey AS seq, concat('f', CAST(o_orderkey % 4 AS STRING)) AS path, CASE WHEN o_orderkey % 10 = 0 THEN '[uncertain]' ELSE o_orderpriority END AS value FROM {orders}",
    "fx_tool_event": "SELECT event_id AS seq, ts, CASE WHEN event_type = 'purchase' THEN 'tool/result' ELSE event_type END AS type, user_id AS call_id, CAST(floor(value * 1024) AS BIGINT) AS bytes, props FROM {events}",
    "fx_flow_node": "SELECT n_nationkey AS id, n_name AS label FROM {nation} WHERE n_nationkey % 10 <> 9",
    "fx_flow_edge": "SELECT DISTINCT c_nationkey AS from_id, CAST(c_custkey % 30 AS INT) AS to_id FROM {customer}",
    "fx_status": "SELECT o_orderkey AS req_id, o_orderpriority AS area, CASE o_orderstatus WHEN 'F' THEN 'match' WHEN 'O' THEN 'gap' ELSE 'partial' END AS status FROM {orders}",
    "fx_before": "SELECT p_partkey AS k, p_name AS name, CAST(p_size AS INT) AS n_lines FROM {part} WHERE p_partkey % 17 <> 0",
    "fx_after": "SELECT p_partkey AS k, p_name AS name, CAST(CASE WHEN p_partkey % 5 = 0 THEN p_size + 3 ELSE p_size END AS INT) AS n_lines FROM {part} WHERE p_partkey % 13 <> 0",
    "fx_claim": "SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN -doc_id - 1 ELSE doc_id END AS subject, CASE WHEN doc_id % 23 = 0 THEN 'opinion' ELSE 'n_chars' END AS attribute, CAST(CASE WHEN doc_id % 9 = 0 THEN n_chars + 1 ELSE n_chars END AS BIGINT) AS claimed FROM {documents}",
    "fx_evidence": "SELECT doc_id AS subject, 'n_chars' AS attribute, CAST(length(text) AS BIGINT) AS actual FROM {documents}",
    "fx_inventory": "SELECT l_orderkey AS deck_id, l_linenumber AS item_no, l_returnflag AS kind FROM {lineitem}",
    "fx_slide_map": "SELECT DISTINCT l_orderkey AS deck_id, l_linenumber AS item_no FROM {lineitem} WHERE l_returnflag <> 'R'",
    "fx_slide": "SELECT user_id AS deck_id, event_id AS slide_no, CASE WHEN event_type IN ('click', 'view') THEN 'centered' WHEN event_type = 'signup' THEN 'split' ELSE 'full-bleed' END AS composition, concat('Slide ', CAST(event_id AS STRING)) AS title FROM {events}",
    "fx_risk": "SELECT l_returnflag AS dimension, CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount < 0.06 THEN 'medium' WHEN l_discount < 0.09 THEN 'high' ELSE 'critical' END AS severity, l_orderkey AS spec_id FROM {lineitem}",
}


class Fixtures:
    """Lazy access to the derived and given tables of one folder: ``fx('fx_field')``, ``fx('pages')``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name not in FIXTURES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self.sql(FIXTURES[name])

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{self.dir}/{m[1]}.parquet`", text))


def oracle(query: str) -> str:
    """``query`` with the fixtures that it names as common table expressions, for DuckDB."""
    used = [n for n in FIXTURES if re.search(rf"\b{n}\b", query)]
    ctes = ", ".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', FIXTURES[n])})" for n in used)
    if not ctes:
        return query
    return f"WITH {ctes}, {query.strip()[5:]}" if query.strip().upper().startswith("WITH ") else f"WITH {ctes} {query}"
