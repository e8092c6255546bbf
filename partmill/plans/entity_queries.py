"""Entity resolution and taxonomy classification on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fold_entity_name
from ..operators import entities
from ..operators import taxonomy as tax
from . import dims
from . import sqltext as q
from .fixtures import PLACEHOLDERS, Tables
from .registry import query

NOBRAND = "('-- unbranded --','-- no unilog brand --','-- no dib brand --','-- no brand --')"
NOENTITY = "('-','--','n/a','na','none','unknown','null')"
BRAND_DIM = f"""bx AS (SELECT canonical, alias FROM brand_alias WHERE priority <> 2),
bk AS (SELECT DISTINCT canonical, {q.entity_key('alias')} AS k FROM brand_alias),
bp AS (SELECT canonical, {q.entity_key('alias')} AS k, priority AS position FROM brand_alias)"""
MAKER_DIM = f"""mx AS (SELECT canonical, alias FROM manufacturer_alias UNION SELECT canonical, canonical FROM manufacturer_alias),
mk AS (SELECT DISTINCT canonical, {q.entity_key('alias')} AS k FROM mx),
mp AS (SELECT canonical, {q.entity_key('alias')} AS k, CASE WHEN alias = canonical THEN 0 ELSE 1 END AS position FROM mx)"""


def matched(name: str, exact: str, keyed: str, fuzzy: str, out: str, src: str, key: str) -> str:
    """CTEs ending in `out`: (key, name, canonical, confidence, method, status) by equality, else by similarity."""
    folded = q.entity_key(name)
    left_over = f"""SELECT {folded} AS key FROM {src} s LEFT JOIN {exact} x ON x.alias = trim({name}) LEFT JOIN {keyed} k ON k.k = {folded}
    WHERE x.canonical IS NULL AND k.canonical IS NULL AND {name} IS NOT NULL"""
    return f"""{q.fuzzy_ctes(out + '_f', left_over, f'SELECT canonical, k, position FROM {fuzzy}')},
{out} AS (SELECT s.{key}, trim({name}) AS name, coalesce(x.canonical, k.canonical, f.canonical) AS canonical,
  CASE WHEN x.canonical IS NOT NULL THEN 1.0e0 WHEN k.canonical IS NOT NULL THEN 0.99e0 WHEN f.score IS NOT NULL THEN round(f.score / 100, 4) ELSE 0.71e0 END AS confidence,
  CASE WHEN x.canonical IS NOT NULL THEN 'exact' WHEN k.canonical IS NOT NULL THEN 'normalized_exact_match' WHEN f.score IS NOT NULL THEN 'rapidfuzz' ELSE 'unknown_entity' END AS method,
  CASE WHEN x.canonical IS NOT NULL OR k.canonical IS NOT NULL OR f.score >= 92 THEN 'RESOLVED' ELSE 'REVIEW_REQUIRED' END AS status
  FROM {src} s LEFT JOIN {exact} x ON x.alias = trim({name}) LEFT JOIN {keyed} k ON k.k = {folded} LEFT JOIN {out}_f f ON f.key = {folded})"""


@query("joi_01_exact_alias", "valid_products brand_alias", f"""WITH {BRAND_DIM}
SELECT product_id, brand_1 AS name, canonical FROM valid_products JOIN bx ON alias = brand_1""")
def exact_alias(t: Tables):
    """JOI-01: case-sensitive alias hit."""
    names = t.valid_products.select("product_id", F.col("brand_1").alias("name"))
    return entities.exact_match(names, dims.brand_catalog(t)).select("product_id", "name", "canonical")


@query("joi_02_normalized_name", "valid_products manufacturer_alias", f"""WITH {MAKER_DIM}
SELECT product_id, k AS name_key, canonical FROM valid_products JOIN mk ON k = {q.entity_key('manufacturer')}""")
def normalized_name(t: Tables):
    """JOI-02: equi-join on the folded name."""
    names = t.valid_products.select("product_id", fold_entity_name(F.col("manufacturer")).alias("name_key"))
    return entities.normalized_match(names, dims.maker_catalog(t)).select("product_id", "name_key", "canonical")


MISSPELT = """SELECT DISTINCT left(p_name, CAST(2 + p_partkey % 3 AS INT)) || substr(p_name, CAST(4 + p_partkey % 3 AS INT)) AS key FROM part
  UNION SELECT lower(replace(s_name, '#', ' ')) || ' inx' FROM supplier UNION SELECT lower(replace(s_name, '#', ' no ')) FROM supplier"""
CATALOG = "SELECT p_name AS canonical, p_name AS alias FROM part UNION SELECT s_name, lower(replace(s_name, '#', ' ')) || ' inc' FROM supplier"


@query("joi_03_fuzzy_best_match", "", f"""WITH c AS ({CATALOG}),
{q.fuzzy_ctes('best', MISSPELT, f"SELECT canonical, {q.entity_key('alias')} AS k, CASE WHEN alias = canonical THEN 0 ELSE 1 END AS position FROM (SELECT * FROM c UNION SELECT canonical, canonical FROM c)")}
SELECT key AS name_key, canonical, round(score, 4) AS score FROM best""")
def fuzzy_best(t: Tables):
    """JOI-03: part names with a character dropped and supplier names of one pattern with another ending, against the catalog of both."""
    catalog = dims.catalog(t.sql(CATALOG).withColumn("priority", F.lit(1)))
    best = entities.fuzzy_scores(t.sql(MISSPELT).withColumnRenamed("key", "name_key"), catalog)
    return best.select("name_key", "canonical", F.round("score", 4).alias("score"))


@query("joi_04_match_cascade", "understood brand_alias", f"""WITH {BRAND_DIM}, n AS (SELECT DISTINCT trim(brand_candidate) AS name FROM understood WHERE trim(brand_candidate) <> ''),
{matched('s.name', 'bx', 'bk', 'bp', 'm', 'n', 'name')} SELECT DISTINCT name, canonical, confidence, method, status FROM m""")
def cascade(t: Tables):
    """JOI-04: exact, normalized, fuzzy, unknown over distinct names."""
    return entities.match_names(t.understood.select(F.col("brand_candidate").alias("name")), dims.brand_catalog(t))


def ladder(product_cols: str = "") -> str:
    return f"""WITH {BRAND_DIM}, {MAKER_DIM},
u AS (SELECT *, coalesce(CASE WHEN lower(trim(brand_1)) NOT IN {NOBRAND} THEN brand_1 END, CASE WHEN lower(trim(brand_2)) NOT IN {NOBRAND} THEN brand_2 END) AS s_name,
  CASE WHEN lower(trim(brand_candidate)) NOT IN {NOBRAND} THEN brand_candidate END AS d_name,
  CASE WHEN lower(trim(coalesce(manufacturer_candidate, manufacturer))) NOT IN {NOENTITY} THEN coalesce(manufacturer_candidate, manufacturer) END AS m_name FROM understood),
{matched('s_name', 'bx', 'bk', 'bp', 'sm', 'u', 'product_id')}, {matched('d_name', 'bx', 'bk', 'bp', 'dm', 'u', 'product_id')}, {matched('m_name', 'mx', 'mk', 'mp', 'mm', 'u', 'product_id')},
j AS (SELECT u.*, sm.canonical AS sc, sm.confidence AS sf, sm.method AS sme, sm.status AS ss, dm.canonical AS dc, dm.confidence AS df, dm.method AS dme, dm.status AS ds,
  mm.canonical AS mc, mm.confidence AS mf, mm.method AS mme, mm.status AS ms FROM u JOIN sm USING (product_id) JOIN dm USING (product_id) JOIN mm USING (product_id)),
b AS (SELECT *, CASE WHEN s_name IS NOT NULL AND d_name IS NOT NULL AND coalesce(lower(sc) <> lower(dc), false) THEN 1 WHEN d_name IS NOT NULL AND ds = 'RESOLVED' THEN 2
  WHEN s_name IS NOT NULL AND d_name IS NOT NULL AND ss = 'RESOLVED' THEN 3 WHEN d_name IS NOT NULL THEN 4 WHEN s_name IS NOT NULL THEN 3 ELSE 5 END AS rung FROM j),
r AS (SELECT product_id, CASE rung WHEN 1 THEN d_name WHEN 2 THEN trim(d_name) WHEN 3 THEN trim(s_name) WHEN 4 THEN trim(d_name) ELSE coalesce(nullif(brand_1, ''), nullif(brand_2, '')) END AS candidate,
  CASE rung WHEN 2 THEN dc WHEN 3 THEN sc WHEN 4 THEN dc END AS canonical, CASE rung WHEN 1 THEN 0.55e0 WHEN 2 THEN df WHEN 3 THEN sf WHEN 4 THEN df ELSE 0.2e0 END AS confidence,
  CASE rung WHEN 1 THEN 'brand_conflict' WHEN 2 THEN 'description_match' WHEN 3 THEN sme WHEN 4 THEN dme ELSE 'missing' END AS method,
  CASE rung WHEN 2 THEN ds WHEN 3 THEN ss WHEN 4 THEN ds ELSE 'REVIEW_REQUIRED' END AS status, s_name, d_name, m_name, mc, mf, mme, ms FROM b)"""


@query("joi_05_brand_reconciliation", "understood brand_alias manufacturer_alias",
       ladder() + " SELECT product_id, candidate, canonical, confidence, method, status FROM r")
def brand_reconciliation(t: Tables):
    """JOI-05: source brand against description brand."""
    return entities.resolve_brands(t.understood, dims.brand_catalog(t), PLACEHOLDERS).select("product_id", "brand.*")


@query("joi_06_entity_resolution", "understood brand_alias manufacturer_alias", ladder() + """
SELECT product_id, CASE WHEN m_name IS NULL THEN NULL ELSE mc END AS maker, CASE WHEN m_name IS NULL THEN 'missing' ELSE mme END AS maker_method, CASE WHEN m_name IS NULL THEN 0.0e0 ELSE mf END AS maker_confidence,
  CASE WHEN status = 'RESOLVED' AND m_name IS NOT NULL AND ms = 'RESOLVED' THEN 'RESOLVED' ELSE 'REVIEW_REQUIRED' END AS entity_status,
  (d_name IS NOT NULL AND coalesce(lower(trim(s_name)) <> lower(trim(d_name)), true)) OR method = 'brand_conflict' AS brand_conflict,
  ((d_name IS NOT NULL AND coalesce(lower(trim(s_name)) <> lower(trim(d_name)), true)) OR method = 'brand_conflict') AND status = 'RESOLVED' AND canonical IS NOT NULL AS conflict_resolved FROM r""")
def entity_resolution(t: Tables):
    """JOI-06: manufacturer match, product status and conflict flags."""
    r = entities.resolve_entities(t.understood, dims.brand_catalog(t), dims.maker_catalog(t), PLACEHOLDERS)
    return r.select("product_id", F.col("maker.canonical").alias("maker"), F.col("maker.method").alias("maker_method"),
                    F.col("maker.confidence").alias("maker_confidence"), "entity_status", "brand_conflict", "conflict_resolved")


def nodes(t: Tables):
    """The taxonomy view with a two-word alias per node, so containment tiers fire."""
    return dims.taxonomy(t).withColumn("aliases", F.concat("aliases", F.array(F.concat(F.lit("hot "), F.element_at("aliases", 1)))))


@query("joi_07_taxonomy_classification", "understood taxonomy", f"""WITH l AS (SELECT node, 0 AS pos, fine AS label FROM taxonomy UNION ALL SELECT node, 1, alias FROM taxonomy UNION ALL SELECT node, 2, 'hot ' || alias FROM taxonomy),
u AS (SELECT product_id, mpn, description, product_type, {q.entity_key(q.display('product_type'))} AS tk FROM understood),
b AS (SELECT *, trim(tk || ' ' || {q.entity_key("concat_ws(' ', trim(product_type), trim(description), trim(mpn))")}) AS blob FROM u),
{q.set_ratio_ctes('z', "SELECT DISTINCT tk AS s FROM b WHERE tk <> ''", "SELECT DISTINCT label AS t FROM l")},
s AS (SELECT product_id, node, pos, CASE WHEN tk = label THEN 0.92e0 WHEN regexp_replace(tk, 's+$', '') = regexp_replace(label, 's+$', '') AND tk <> '' THEN 0.9e0 WHEN contains(tk, label) AND (length(label) >= 8 OR contains(label, ' ')) THEN 0.9e0
   WHEN (contains(blob, label) AND (length(label) >= 8 OR contains(label, ' '))) OR z.set_ratio >= 90 THEN 0.88e0 ELSE 0 END AS score,
  CASE WHEN tk = label THEN 5 WHEN regexp_replace(tk, 's+$', '') = regexp_replace(label, 's+$', '') AND tk <> '' THEN 4 WHEN contains(tk, label) AND (length(label) >= 8 OR contains(label, ' ')) THEN 3
   WHEN z.set_ratio >= 90 THEN 2 ELSE 1 END AS rank FROM b CROSS JOIN l LEFT JOIN z ON z.s = tk AND z.t = label WHERE tk = label OR (tk <> '' AND regexp_replace(tk, 's+$', '') = regexp_replace(label, 's+$', '')) OR contains(blob, label) OR z.set_ratio >= 90),
n AS (SELECT product_id, node, max(score) AS score, CASE WHEN max(score) > 0.89 THEN max(rank) ELSE max_by(rank, pos) END AS rank FROM s WHERE score > 0 GROUP BY product_id, node),
w AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, rank DESC, node) AS rn FROM n)
SELECT u.product_id, x.classpath, x.fine, coalesce(w.score, 0.0e0) AS confidence, CASE w.rank WHEN 5 THEN 'exact' WHEN 4 THEN 'normalized_exact' WHEN 3 THEN 'alias_containment' WHEN 2 THEN 'rapidfuzz' WHEN 1 THEN 'keyword' ELSE 'no_match' END AS method,
  CASE WHEN w.score >= 0.9 THEN 'CLASSIFIED' ELSE 'REVIEW_REQUIRED' END AS status FROM u LEFT JOIN w ON w.product_id = u.product_id AND rn = 1 LEFT JOIN taxonomy x ON x.node = w.node""")
def classification(t: Tables):
    """JOI-07: all tiers."""
    products = t.understood.withColumn("extracted_terms", F.lit(None).cast("array<string>"))
    return tax.classify(products, nodes(t)).select("product_id", "classpath", "fine", "confidence", "method", "status")
