"""Scans, sinks, row validation, duplicates and intake statistics on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import INTAKE_COLUMNS
from ..functions.text import (blank_to_null, first_real_brand, is_missing_entity, is_placeholder_brand,
                              traceable_brand)
from ..operators import jobs
from ..scale import scratch_path
from ..sources import cache, dimensions, intake, stage_store
from . import dims
from .fixtures import PLACEHOLDERS, Tables
from .registry import query

B = ("brand_1", "brand_2", "brand_3")
NOBRAND = "('-- unbranded --','-- no unilog brand --','-- no dib brand --','-- no brand --')"
NOENTITY = "('-','--','n/a','na','none','unknown','null')"


def raw_rows(t: Tables):
    """The products view as an unvalidated intake: part key as index, bad index on some rows."""
    index = F.when(F.col("product_id") % 31 == 0, "n/a").when(F.col("product_id") % 4 == 0, F.lit(" ")).otherwise(
        F.col("product_id").cast("string"))
    return t.products.select("product_id", (F.col("product_id") + 1).alias("row_position"), index.alias("index_text"),
                             "mpn", "description", *B, "manufacturer")


RAW_SQL = """raw AS (SELECT product_id, product_id + 1 AS row_position,
  CASE WHEN product_id % 31 = 0 THEN 'n/a' WHEN product_id % 4 = 0 THEN ' ' ELSE CAST(product_id AS STRING) END AS index_text,
  nullif(trim(mpn), '') AS mpn, nullif(trim(description), '') AS description, nullif(trim(brand_1), '') AS brand_1,
  nullif(trim(brand_2), '') AS brand_2, nullif(trim(brand_3), '') AS brand_3, nullif(trim(manufacturer), '') AS manufacturer FROM products),
checked AS (SELECT product_id, CASE WHEN trim(index_text) = '' OR index_text = 'n/a' THEN row_position ELSE CAST(index_text AS BIGINT) END AS source_index,
  mpn, description, brand_1, brand_2, brand_3, manufacturer,
  nullif(concat_ws('; ', CASE WHEN index_text = 'n/a' THEN 'index is not an integer' END, CASE WHEN mpn IS NULL THEN 'Mfg_Part_Num is missing' END,
    CASE WHEN description IS NULL THEN 'Part_Desc is missing' END), '') AS error FROM raw)"""


@query("src_01_csv_scan", "products", """
SELECT product_id + 1 AS source_index, nullif(trim(mpn), '') AS mpn, nullif(trim(description), '') AS description,
  nullif(trim(brand_1), '') AS brand_1, nullif(trim(brand_2), '') AS brand_2, nullif(trim(brand_3), '') AS brand_3,
  nullif(trim(manufacturer), '') AS manufacturer,
  nullif(concat_ws('; ', CASE WHEN trim(mpn) = '' THEN 'Mfg_Part_Num is missing' END, CASE WHEN trim(description) = '' THEN 'Part_Desc is missing' END), '') AS error
FROM products""")
def csv_scan(t: Tables):
    """SRC-01: the products view written as CSV and scanned back through validation."""
    path = scratch_path(t.spark, "csv")
    rows = t.products.withColumn("index", F.col("product_id") + 1)
    (rows.select(F.col("index"), *[F.col(f).alias(f" {h} ") for f, h in INTAKE_COLUMNS.items()])
     .write.option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return intake.validate_rows(intake.read_product_csv(t.spark, path)).select(
        "source_index", "mpn", "description", *B, "manufacturer", "error")


@query("src_02_json_scan", "valid_products", """
SELECT product_id AS source_index, mpn, description, CASE WHEN brand_1 = '' THEN NULL ELSE brand_1 END AS brand_1, manufacturer, CAST(NULL AS STRING) AS error FROM valid_products
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, 'Mfg_Part_Num is missing; Part_Desc is missing' FROM events WHERE event_id % 3 > 0
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'row must be an object' FROM events WHERE event_id % 3 = 0""")
def json_scan(t: Tables):
    """SRC-02: JSON Lines with aliased, mixed-case keys, event payloads and non-objects."""
    path = scratch_path(t.spark, "json")
    products = t.valid_products.select(F.to_json(F.struct(
        F.col("product_id").alias("index"), F.col("mpn").alias("MPN"), F.col("description").alias("Part_Desc"),
        F.col("brand_1").alias("E1_brand"), F.col("manufacturer").alias("Manufacturer"))).alias("value"))
    payload = t.events.select(F.when(F.col("event_id") % 3 == 0, F.to_json(F.array(F.col("event_id")))).otherwise(
        F.concat(F.lit('{"index": '), F.col("event_id").cast("string"), F.lit(", "), F.substr("props", F.lit(2)))).alias("value"))
    products.unionByName(payload).write.text(path)
    records = intake.read_product_json(t.spark, path, lines=True)
    checked = intake.validate_rows(records)
    # The index of a non-object is its line number, which depends on how the files were cut.
    numbered = F.when(F.col("error").eqNullSafe("row must be an object"), None).otherwise(F.col("source_index"))
    return checked.select(numbered.alias("source_index"), "mpn", "description", "brand_1", "manufacturer", "error")


@query("src_03_dimension_load", "brand_alias taxonomy", """
SELECT 'brand' AS dim, canonical AS name, alias AS spelling FROM brand_alias WHERE priority <> 2
UNION ALL SELECT 'taxonomy', fine, alias FROM taxonomy UNION ALL SELECT 'taxonomy', fine, fine FROM taxonomy
UNION ALL SELECT 'template', label, label FROM (SELECT DISTINCT p_name AS label FROM part) t
UNION ALL SELECT 'lov', lower(p_type), lower(p_type) || ' grade' FROM (SELECT DISTINCT p_type FROM part) t""")
def dimension_load(t: Tables):
    """SRC-03: dimension documents written as JSON from the tables, loaded and exploded."""
    base = scratch_path(t.spark, "dims")

    def document(df, name):
        # A dimension document is one JSON text by contract, so it is one small file.
        df.coalesce(1).write.text(f"{base}/{name}")
        return f"{base}/{name}"

    def array_text(df):
        return df.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))

    brands = t.brand_alias.groupBy(F.col("canonical").alias("canonical_name")).agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    b = dimensions.load_alias_catalog(t.spark, document(array_text(brands), "brands"))
    tax = dimensions.load_taxonomy(t.spark, document(array_text(dims.taxonomy(t).drop("node")), "taxonomy"))
    names = t.part.select(F.col("p_name").alias("label")).distinct().withColumn("query", F.col("label"))
    tpl = names.agg(F.to_json(F.struct(F.array().cast("array<string>").alias("templates"),
                                       F.collect_list(F.struct("*")).alias("default"))).alias("value"))
    templates = dimensions.load_templates(t.spark, document(tpl, "templates"))
    lov = t.part.select("p_type").distinct().select(F.struct(
        F.lower("p_type").alias("canonical"), F.array(F.concat(F.lower("p_type"), F.lit(" grade"))).alias("aliases")).alias("e"))
    lov = lov.agg(F.to_json(F.struct(F.create_map(F.lit("Finish"), F.collect_list("e")).alias("attributes"))).alias("value"))
    lists = dimensions.load_lov(t.spark, document(lov, "lov"))
    return (
        b.select(F.lit("brand").alias("dim"), F.col("canonical").alias("name"), F.col("alias").alias("spelling"))
        .unionByName(tax.select(F.lit("taxonomy").alias("dim"), F.col("fine").alias("name"),
                                F.explode(F.concat("aliases", F.array("fine"))).alias("spelling")))
        .unionByName(templates.select(F.lit("template").alias("dim"), F.col("label").alias("name"), F.col("query").alias("spelling")))
        .unionByName(lists.select(F.lit("lov").alias("dim"), F.col("canonical").alias("name"), F.explode("aliases").alias("spelling")))
    )


KEY_SQL = "sha256('brand=' || lower(trim(coalesce(brand_1,''))) || chr(1) || 'manufacturer=' || lower(trim(coalesce(manufacturer,''))) || chr(1) || 'mpn=' || lower(trim(coalesce(mpn,''))) || chr(1))"


@query("src_04_keyed_cache", "products", f"""WITH k AS (SELECT product_id, {KEY_SQL} AS cache_key FROM products),
c AS (SELECT DISTINCT cache_key FROM k WHERE product_id % 3 = 0)
SELECT 'hit' AS outcome, product_id, cache_key FROM k WHERE cache_key IN (SELECT cache_key FROM c)
UNION ALL SELECT 'miss', CAST(NULL AS BIGINT), cache_key FROM (SELECT DISTINCT cache_key FROM k WHERE cache_key NOT IN (SELECT cache_key FROM c)) m
UNION ALL SELECT 'document', min(page_id), sha256(html) FROM (SELECT url, min_by(html, page_id) AS html, min(page_id) AS page_id FROM pages GROUP BY url) d GROUP BY url, html""")
def keyed_cache(t: Tables):
    """SRC-04: cache hits joined, misses once per key, and the page cache with content hash."""
    keyed = t.products.withColumn("brand", F.col("brand_1"))
    stored = keyed.where("product_id % 3 = 0").select(
        cache.cache_key(cache.RESEARCH_FIELDS).alias("cache_key")).distinct()
    hits, misses = cache.with_cache(keyed, stored, cache.RESEARCH_FIELDS)
    documents = cache.document_cache(t.pages)
    return (
        hits.select(F.lit("hit").alias("outcome"), "product_id", "cache_key")
        .unionByName(misses.select(F.lit("miss").alias("outcome"), F.lit(None).cast("long").alias("product_id"), "cache_key"))
        .unionByName(documents.select(F.lit("document").alias("outcome"), F.col("page_id").alias("product_id"),
                                      F.col("content_hash").alias("cache_key"))))


@query("snk_01_replace_by_product", "extracted stage_runs", """
WITH batch AS (SELECT product_id, label, 'new ' || value AS value FROM extracted WHERE product_id % 10 = 4)
SELECT 'attributes' AS stage_table, product_id, label, value FROM extracted WHERE product_id NOT IN (SELECT product_id FROM batch)
UNION ALL SELECT 'attributes', product_id, label, value FROM batch
UNION ALL SELECT 'normalized', product_id, stage, status FROM stage_runs WHERE product_id NOT IN (SELECT product_id FROM batch)""")
def replace_by_product(t: Tables):
    """SNK-01: bucketed stage tables; the batch replaces its products and empties downstream."""
    store = stage_store.StageStore(t.spark, scratch_path(t.spark, "stages"), buckets=16)
    store.append("attributes", t.extracted.select("product_id", "label", "value"))
    store.append("normalized", t.stage_runs.select("product_id", F.col("stage").alias("label"), F.col("status").alias("value")))
    batch = t.extracted.where("product_id % 10 = 4").select("product_id", "label", F.concat(F.lit("new "), "value").alias("value"))
    store.replace("attributes", batch)
    parts = [store.read(n).select(F.lit(n).alias("stage_table"), "product_id", "label", "value") for n in ("attributes", "normalized")]
    return parts[0].unionByName(parts[1])


@query("prj_01_row_validation", "products", f"WITH {RAW_SQL} SELECT * FROM checked")
def row_validation(t: Tables):
    """PRJ-01 / PRJ-02 / PRJ-03: trim, number and check rows."""
    return intake.validate_rows(raw_rows(t))


@query("prj_02_blank_to_null", "products", """
SELECT product_id, nullif(trim(mpn), '') AS mpn, nullif(trim(description), '') AS description, nullif(trim(manufacturer), '') AS manufacturer FROM products""")
def blanks(t: Tables):
    """PRJ-02: trim, blank becomes null."""
    return t.products.select("product_id", *[blank_to_null(F.col(c)).alias(c) for c in ("mpn", "description", "manufacturer")])


@query("prj_03_source_index", "products", f"WITH {RAW_SQL} SELECT product_id, source_index FROM checked")
def source_index(t: Tables):
    """PRJ-03: integer index, else row position."""
    return intake.validate_rows(raw_rows(t)).select("product_id", "source_index")


@query("prj_04_placeholders", "products", f"""
SELECT product_id, coalesce(trim(brand_1),'') = '' OR lower(trim(brand_1)) IN {NOBRAND} AS no_brand_1,
  coalesce(trim(brand_2),'') = '' OR lower(trim(brand_2)) IN {NOBRAND} AS no_brand_2,
  coalesce(trim(manufacturer),'') = '' OR lower(trim(manufacturer)) IN {NOENTITY} AS no_manufacturer FROM products""")
def placeholders(t: Tables):
    """PRJ-04: placeholder predicates."""
    return t.products.select(
        "product_id", is_placeholder_brand(F.col("brand_1"), PLACEHOLDERS).alias("no_brand_1"),
        is_placeholder_brand(F.col("brand_2"), PLACEHOLDERS).alias("no_brand_2"),
        is_missing_entity(F.col("manufacturer")).alias("no_manufacturer"))


@query("prj_05_first_real_brand", "products", f"""
WITH r AS (SELECT product_id, brand_1, brand_2, coalesce(CASE WHEN lower(trim(brand_1)) NOT IN {NOBRAND} THEN brand_1 END,
  CASE WHEN lower(trim(brand_2)) NOT IN {NOBRAND} THEN brand_2 END) AS real_brand FROM products)
SELECT product_id, real_brand, coalesce(real_brand, brand_1, brand_2) AS traceable_brand FROM r""")
def real_brand(t: Tables):
    """PRJ-05: first real source brand and its traceable variant."""
    cols = [F.col(b) for b in B]
    return t.products.select("product_id", first_real_brand(*cols, extra=PLACEHOLDERS).alias("real_brand"),
                             traceable_brand(*cols, extra=PLACEHOLDERS).alias("traceable_brand"))


@query("prj_06_job_eligibility", "states", """
SELECT 'default' AS run, product_id, product_id AS run_order FROM states WHERE status NOT IN ('INVALID','DUPLICATE_CANDIDATE')
UNION ALL SELECT 'explicit', s.product_id, o_orderkey FROM orders JOIN states s ON s.product_id = o_custkey WHERE s.status <> 'INVALID'""")
def job_eligibility(t: Tables):
    """PRJ-06: default run, and an explicit request that keeps its order."""
    default = jobs.eligible(t.states)
    asked = t.orders.select(F.col("o_orderkey").alias("request_pos"), F.col("o_custkey").alias("product_id"))
    explicit = jobs.eligible(t.states, asked)
    cols = ["product_id", F.col("run_order").cast("long").alias("run_order")]
    return default.select(F.lit("default").alias("run"), *cols).unionByName(
        explicit.select(F.lit("explicit").alias("run"), *cols))


@query("joi_15_duplicate_marking", "valid_products", """
WITH n AS (SELECT mpn, count(*) AS c FROM valid_products GROUP BY mpn), s AS (SELECT DISTINCT mpn FROM valid_products WHERE product_id % 50 = 7)
SELECT v.product_id, v.mpn, CASE WHEN n.c > 1 OR v.mpn IN (SELECT mpn FROM s) THEN 'DUPLICATE_CANDIDATE' ELSE 'INGESTED' END AS status
FROM valid_products v JOIN n ON n.mpn = v.mpn""")
def duplicates(t: Tables):
    """JOI-15: repeated in the batch or already stored."""
    stored = t.valid_products.where("product_id % 50 = 7")
    return intake.mark_duplicates(t.valid_products, stored).select("product_id", "mpn", "status")


@query("agg_01_intake_statistics", "products", f"""WITH {RAW_SQL}
SELECT count(*) AS total_rows, count(*) FILTER (error IS NULL) AS valid_rows, count(*) FILTER (error IS NOT NULL) AS invalid_rows,
  count(*) FILTER (contains(lower(error), 'mfg_part_num')) AS missing_mpn, count(*) FILTER (contains(lower(error), 'part_desc')) AS missing_description,
  count(*) FILTER (error IS NULL AND lower(brand_1) IN {NOBRAND} AND lower(brand_2) IN {NOBRAND}) AS missing_brand,
  count(*) FILTER (error IS NULL AND manufacturer IS NULL) AS missing_manufacturer,
  (SELECT count(*) FROM (SELECT mpn FROM checked WHERE error IS NULL GROUP BY mpn HAVING count(*) > 1) d) AS duplicate_mpns FROM checked""")
def statistics(t: Tables):
    """AGG-01: counts over one intake."""
    return intake.intake_statistics(intake.validate_rows(raw_rows(t)), extra_placeholders=PLACEHOLDERS)


@query("set_06_identity_unchanged", "products", """
SELECT product_id, mpn, description FROM products EXCEPT ALL
SELECT product_id, CASE WHEN product_id % 100 = 3 THEN 'changed' ELSE mpn END, description FROM products""")
def identity_unchanged(t: Tables):
    """SET-06: identity columns before and after enrichment."""
    after = t.products.withColumn("mpn", F.when(F.col("product_id") % 100 == 3, "changed").otherwise(F.col("mpn")))
    return jobs.unchanged_identity(t.products, after, ["product_id", "mpn", "description"])
