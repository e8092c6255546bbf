"""Driver tables and the views derived from them. Each view text runs unchanged on Spark
SQL and DuckDB, so queries and their SQL equivalents see the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations"]

PLACEHOLDERS = ["-- no brand --"]

VIEWS: dict[str, tuple[str, str]] = {
    # name: (views it needs, text)
    "products": ("", """
SELECT p_partkey AS product_id,
  CASE WHEN p_partkey % 97 = 0 THEN ' ' ELSE 'MPN-' || lpad(CAST(CASE WHEN p_partkey % 20 = 19 THEN p_partkey - 1 ELSE p_partkey END AS STRING), 6, '0') END AS mpn,
  CASE WHEN p_partkey % 89 = 0 THEN '' ELSE p_name || ' ' || CAST(p_size AS STRING) || '/64"x' || CAST(p_size AS STRING) || '" - ' || p_type || ' ' || CAST(1 + p_size % 9 AS STRING) || 'pc' END AS description,
  CASE WHEN p_partkey % 5 = 0 THEN '-- Unbranded --' ELSE p_brand END AS brand_1,
  CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE '-- No Brand --' END AS brand_2,
  CAST(NULL AS STRING) AS brand_3,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE s_name || ' Incorporated (' || CAST(s_suppkey AS STRING) || ')' END AS manufacturer
FROM (SELECT part.*, p_partkey % (SELECT count(*) FROM supplier) AS maker_slot FROM part) p
JOIN supplier ON s_suppkey = maker_slot"""),
    "valid_products": ("products", """
SELECT product_id, trim(mpn) AS mpn, trim(description) AS description, brand_1, brand_2, brand_3, manufacturer
FROM products WHERE trim(mpn) <> '' AND trim(description) <> ''"""),
    "brand_alias": ("", """
SELECT DISTINCT p_brand AS canonical, p_brand AS alias, 1 AS priority FROM part
UNION ALL SELECT DISTINCT p_brand, upper(p_brand), 2 FROM part
UNION ALL SELECT DISTINCT p_brand, replace(p_brand, '#', ' No. '), 3 FROM part"""),
    "manufacturer_alias": ("", """
SELECT s_name AS canonical, s_name || ' Inc' AS alias, 1 AS priority FROM supplier"""),
    "taxonomy": ("", """
SELECT row_number() OVER (ORDER BY noun) AS node, 'Catalog' AS department, 'Goods' AS class_name,
  'Catalog>' || noun || 's' AS classpath, noun || 's' AS fine, noun AS alias
FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS noun FROM part) t"""),
    "template": ("", """
SELECT * FROM (VALUES (1,'Product Type',true,false,''),(2,'Width',true,true,'length'),(3,'Length',true,true,'length'),(4,'Quantity',false,true,'count'),(5,'Application',false,false,'')) AS t(position,label,required,expects_uom,uom_family)"""),
    "extracted": ("", """
SELECT p_partkey * 10 + 1 AS attribute_id, p_partkey AS product_id, 'Width' AS label, CAST(p_size / 64.0e0 AS STRING) AS value, CASE WHEN p_partkey % 11 = 0 THEN 'kg' ELSE 'inches' END AS uom FROM part WHERE p_partkey % 4 <> 0
UNION ALL SELECT p_partkey * 10 + 2, p_partkey, 'Length', CAST(p_size + CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END AS STRING), 'in.' FROM part
UNION ALL SELECT p_partkey * 10 + 3, p_partkey, 'Product Type', split_part(p_name, ' ', 2), CAST(NULL AS STRING) FROM part WHERE p_partkey % 10 <> 0"""),
    "stage_runs": ("", """
SELECT event_id, user_id % 10 AS job_id, user_id AS product_id, event_type AS stage,
  CASE WHEN event_id % 10 = 0 THEN 'SKIPPED' WHEN event_id % 17 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  CASE WHEN event_id % 10 = 0 THEN 0.0e0 ELSE value END AS duration_ms, props AS metrics FROM events"""),
    "search_hits": ("", """
SELECT page_id, page_id % 50 AS product_id, page_id % 4 AS query_pos, page_id AS hit_pos, url, html FROM pages"""),
    "review_queue": ("", """
SELECT o_orderkey AS review_id, o_custkey AS product_id, o_orderpriority AS issue_type, o_orderstatus AS attribute,
  CASE WHEN o_orderkey % 3 = 0 THEN 'APPROVED' ELSE 'PENDING' END AS status FROM orders"""),
    "chunk_vectors": ("", "SELECT vec_id, label AS product_id, embedding FROM embeddings"),
    # ---- views below are our own ------------------------------------------------
    "understood": ("valid_products", """
SELECT v.product_id, v.mpn, v.description, brand_1, brand_2, brand_3, manufacturer,
  CASE WHEN v.product_id % 8 = 0 THEN NULL WHEN v.product_id % 8 = 1 THEN '-- Unbranded --' WHEN v.product_id % 8 = 2 THEN upper(p_brand)
       WHEN v.product_id % 8 = 3 THEN 'Brand#1' WHEN v.product_id % 16 = 4 THEN 'Acme Industrial' WHEN v.product_id % 16 = 12 THEN replace(p_brand, 'Brand', 'Brnd') ELSE p_brand END AS brand_candidate,
  CASE WHEN v.product_id % 9 = 0 THEN 'Unknown' WHEN v.product_id % 9 < 4 THEN NULL WHEN v.product_id % 9 = 4 THEN replace(manufacturer, 'Supplier', 'Suplier') ELSE manufacturer END AS manufacturer_candidate,
  CASE WHEN v.product_id % 6 = 0 THEN split_part(p_name, ' ', 2) || 's' WHEN v.product_id % 6 = 1 THEN upper(p_name) || ' set'
       WHEN v.product_id % 6 = 2 THEN 'sprocket' WHEN v.product_id % 6 = 3 THEN NULL WHEN v.product_id % 12 = 4 THEN 'hot ' || left(split_part(p_name, ' ', 2), 2) || substr(split_part(p_name, ' ', 2), 4) ELSE split_part(p_name, ' ', 2) END AS product_type
FROM valid_products v JOIN part ON p_partkey = v.product_id"""),
    "listed": ("valid_products", """
SELECT v.*, 'Catalog>' || split_part(p_name, ' ', 2) || 's' AS classpath, split_part(p_name, ' ', 2) || 's' AS fine,
  v.product_id % 13 <> 0 AS classified
FROM valid_products v JOIN part ON p_partkey = v.product_id"""),
    "states": ("valid_products", """
SELECT product_id, mpn, description, brand_1, manufacturer,
  CASE product_id % 12 WHEN 0 THEN 'INGESTED' WHEN 1 THEN 'DUPLICATE_CANDIDATE' WHEN 2 THEN 'INVALID' WHEN 3 THEN 'REVIEW_REQUIRED'
    WHEN 4 THEN 'NO_AUTHORITATIVE_SOURCE' WHEN 5 THEN 'NORMALIZED' WHEN 6 THEN 'VALIDATED' WHEN 7 THEN 'PARTIAL' WHEN 8 THEN 'FAIL'
    WHEN 9 THEN 'APPROVED' WHEN 10 THEN 'CLASSIFIED' ELSE 'INDEXED' END AS status
FROM valid_products"""),
    "verdicts": ("", """
SELECT p_partkey AS product_id, CASE p_partkey % 7 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'REVIEW_REQUIRED' WHEN 2 THEN 'PARTIAL' ELSE 'PASS' END AS status,
  p_partkey % 7 >= 2 AS approved_for_output, (p_partkey % 5) / 4.0e0 AS evidence_coverage, (p_partkey % 9) / 8.0e0 AS completeness_score
FROM part WHERE p_partkey % 4 <> 3"""),
    "product_reviews": ("", """
SELECT o_orderkey AS review_id, o_custkey % (SELECT count(*) FROM part) AS product_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'LOV_INVALID' WHEN 1 THEN 'SOURCE_CONFLICT' WHEN 2 THEN 'UOM_INVALID' WHEN 3 THEN 'MISSING_REQUIRED' ELSE 'BRAND_CONFLICT' END AS issue_type,
  CASE o_orderkey % 4 WHEN 0 THEN 'Product Type' WHEN 1 THEN 'Width' WHEN 2 THEN 'Length' ELSE '' END AS attribute,
  CASE CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 2 ELSE o_orderkey % 7 END WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'IN_REVIEW' WHEN 3 THEN 'UNKNOWN' ELSE 'PENDING' END AS status,
  'value ' || CAST(o_orderkey % 10 AS STRING) AS current_value
FROM orders"""),
    "job_items": ("", """
SELECT o_orderkey AS item_id, o_custkey % 20 AS job_id, o_orderkey % (SELECT count(*) FROM part) AS product_id,
  CASE o_orderkey % 9 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'PARTIAL' WHEN 3 THEN 'REVIEW_REQUIRED' WHEN 4 THEN 'FAILED' WHEN 5 THEN 'SKIPPED' ELSE 'APPROVED' END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN 0.0e0 ELSE round(o_totalprice, 2) END AS duration_ms
FROM orders"""),
    "page_hits": ("", """
SELECT page_id, page_id % 50 AS product_id, CAST(page_id % 4 AS INT) AS query_pos, page_id AS hit_pos, CASE WHEN page_id % 4 < 2 THEN 1 ELSE 2 END AS tier,
  url, CASE WHEN page_id % 3 = 0 THEN 'Item ' || CAST(page_id % 50 AS STRING) || '-X catalog' WHEN page_id % 3 = 1 THEN 'Manual for ' || CAST(page_id % 50 AS STRING) || '-X' ELSE 'Overview' END AS title,
  CASE WHEN page_id % 5 = 0 THEN 'spec sheet ' || CAST(page_id % 50 AS STRING) || 'X' WHEN page_id % 5 = 1 THEN 'widget ' || CAST(page_id % 50 AS STRING) || ' x' ELSE '' END AS snippet,
  CAST(page_id % 50 AS STRING) || '-X' AS mpn, 'Example' AS brand, 'Widget' AS product_type
FROM pages"""),
    "product_sources": ("", """
SELECT l_orderkey * 10 + l_linenumber AS source_id, l_partkey AS product_id,
  'https://' || CASE l_linenumber % 3 WHEN 0 THEN 'maker' WHEN 1 THEN 'shop' ELSE 'market' END || CAST(l_suppkey % 7 AS STRING) || '.example.com/' || CAST(l_partkey AS STRING) AS url,
  CASE l_linenumber % 3 WHEN 0 THEN 'MANUFACTURER' WHEN 1 THEN 'RETAILER' ELSE 'MARKETPLACE' END AS source_type,
  CASE l_linenumber % 5 WHEN 0 THEN 'SPECIFICATION' WHEN 1 THEN 'CATALOG' WHEN 2 THEN 'INSTALLATION_MANUAL' WHEN 3 THEN 'TECHNICAL_DOCUMENT' ELSE 'OTHER' END AS content_type,
  CASE l_linenumber % 3 WHEN 0 THEN 0.95e0 WHEN 1 THEN 0.45e0 ELSE 0.2e0 END AS authority_score, (l_suppkey % 10) / 10.0e0 AS relevance_score,
  CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_suppkey % 200 AS STRING) || '-Grit belt' WHEN l_linenumber % 4 = 1 THEN '60/80/' || CAST(100 + l_suppkey % 50 AS STRING) || ' grit pack' ELSE 'plain title' END AS title
FROM lineitem"""),
}


def _ordered(names: str) -> list[str]:
    out: list[str] = []

    def add(name):
        for need in VIEWS[name][0].split():
            add(need)
        if name not in out:
            out.append(name)
    for name in names.split():
        add(name)
    return out


def with_views(names: str, body: str) -> str:
    """Prefix a SQL body with the derived views it uses. A body may start with its own WITH list."""
    ctes = [f"{n} AS ({VIEWS[n][1].strip()})" for n in _ordered(names)]
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


class Tables:
    """Base tables and derived views of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in BASE:
                self._seen[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                self._seen[name] = self.sql(VIEWS[name][1], *_ordered(name)[:-1])
            else:
                raise AttributeError(name)
        return self._seen[name]

    def sql(self, text: str, *needs: str) -> DataFrame:
        import re
        used = [n for n in BASE if re.search(rf"\b{n}\b", text)]
        for n in [*used, *needs]:
            getattr(self, n).createOrReplaceTempView(n)
        return self.spark.sql(text)
