"""Template, consolidation, normalization and validation on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.status import delivery_eligibility
from ..operators import evidence, normalization, validation
from . import dims
from . import sqltext as q
from .fixtures import Tables
from .registry import query

LISTED = "listed extracted template taxonomy"
# Accepted Product Type spellings per classpath.
VOCAB = """vocab AS (SELECT DISTINCT 'Product Type' AS label, classpath, spelling AS key, fine AS canonical FROM (SELECT classpath, fine, fine AS spelling FROM taxonomy UNION SELECT classpath, fine, alias FROM taxonomy) s)"""
CANDIDATES = f"""cand AS (SELECT c.*, l.classpath FROM (SELECT product_id, label, value, uom, evidence_text, 'in' AS side, 1 AS ord FROM ({q.title_rows('listed')}) a
  UNION ALL SELECT product_id, label, value, uom, NULL, 'mfr', attribute_id FROM extracted WHERE value <> '') c JOIN listed l USING (product_id))"""
CONSOLIDATED = f"""{VOCAB}, {CANDIDATES}, {q.normalize_ctes('cand', 'nc', vocab='vocab')},
k AS (SELECT *, lower(trim(normalized_value)) || chr(1) || lower(coalesce(normalized_uom, '')) AS ckey FROM nc),
cons AS (SELECT l.product_id, l.classpath, l.classified, t.label, t.position, t.required, t.expects_uom, t.uom_family,
  CASE WHEN i.ckey = m.ckey THEN 'AGREEMENT' WHEN i.ckey <> m.ckey THEN 'CONFLICT' WHEN m.product_id IS NOT NULL THEN 'MANUFACTURER_SUPPORTED' WHEN i.product_id IS NOT NULL THEN 'INPUT_SOURCED' ELSE 'NOT_FOUND' END AS agreement,
  i.value AS i_value, i.uom AS i_uom, i.evidence_text AS i_ev, i.raw_value AS i_rv, i.raw_uom AS i_ru, i.normalized_value AS i_nv, i.normalized_uom AS i_nu, i.method AS i_m,
  m.raw_value AS m_rv, m.raw_uom AS m_ru, m.normalized_value AS m_nv, m.normalized_uom AS m_nu, m.method AS m_m
  FROM listed l CROSS JOIN template t LEFT JOIN k i ON i.product_id = l.product_id AND i.label = t.label AND i.side = 'in' LEFT JOIN k m ON m.product_id = l.product_id AND m.label = t.label AND m.side = 'mfr'),
attr AS (SELECT product_id, classpath, classified, label, position, required, expects_uom, uom_family, agreement,
  CASE WHEN agreement IN ('AGREEMENT','MANUFACTURER_SUPPORTED') THEN m_rv WHEN agreement = 'INPUT_SOURCED' THEN i_rv ELSE i_value END AS raw_value,
  CASE WHEN agreement IN ('AGREEMENT','MANUFACTURER_SUPPORTED') THEN m_nv WHEN agreement = 'INPUT_SOURCED' THEN i_nv END AS normalized_value,
  CASE WHEN agreement IN ('AGREEMENT','MANUFACTURER_SUPPORTED') THEN m_ru WHEN agreement = 'INPUT_SOURCED' THEN i_ru ELSE i_uom END AS raw_uom,
  CASE WHEN agreement IN ('AGREEMENT','MANUFACTURER_SUPPORTED') THEN m_nu WHEN agreement = 'INPUT_SOURCED' THEN i_nu END AS normalized_uom,
  CASE WHEN agreement IN ('AGREEMENT','MANUFACTURER_SUPPORTED') THEN m_m WHEN agreement = 'INPUT_SOURCED' THEN i_m END AS normalization_method,
  CASE WHEN agreement IN ('AGREEMENT','MANUFACTURER_SUPPORTED') THEN 'MANUFACTURER' WHEN agreement = 'INPUT_SOURCED' THEN 'INPUT' END AS selected_source,
  CASE WHEN agreement IN ('AGREEMENT','MANUFACTURER_SUPPORTED') THEN NULL ELSE i_ev END AS evidence_text FROM cons),
attr2 AS (SELECT *, CASE WHEN agreement = 'CONFLICT' THEN 'CONFLICT' WHEN agreement = 'NOT_FOUND' OR coalesce(normalized_value, '') = '' THEN 'NOT_FOUND' WHEN normalization_method IS NOT NULL THEN 'NORMALIZED' ELSE 'UNCHANGED' END AS status FROM attr)"""
ISSUES = f"""{CONSOLIDATED},
chk AS (SELECT a.*, coalesce(normalized_value, '') <> '' AS populated, coalesce(normalized_value, '') <> '' AND selected_source IS NOT NULL AND (evidence_text IS NOT NULL OR selected_source = 'INPUT') AS evidenced,
  label = 'Product Type' AS has_lov, EXISTS (SELECT 1 FROM vocab v WHERE v.label = a.label AND v.classpath = a.classpath AND (v.key = {q.lov_key('a.normalized_value')})) AS lov_ok,
  coalesce(normalized_uom, '') <> '' AND uom_family <> '' AND NOT (uom_family = 'length' AND normalized_uom IN ('in','ft','mm','cm') OR uom_family = 'count' AND normalized_uom IN ('EA','PK')) AS bad_uom FROM attr2 a),
iss AS (SELECT product_id, label AS attribute, 'MISSING_REQUIRED' AS issue_type, 'HIGH' AS severity, true AS requires_review, 'Required attribute ' || label || ' is missing.' AS message FROM chk WHERE required AND NOT populated AND agreement <> 'CONFLICT'
UNION ALL SELECT product_id, label, 'SOURCE_CONFLICT', 'HIGH', true, 'Input and manufacturer values disagree.' FROM chk WHERE agreement = 'CONFLICT'
UNION ALL SELECT product_id, label, 'MISSING_EVIDENCE', 'HIGH', true, label || ' is populated without source evidence.' FROM chk WHERE agreement <> 'CONFLICT' AND populated AND NOT evidenced
UNION ALL SELECT product_id, label, 'UOM_INVALID', 'HIGH', true, 'UOM ''' || normalized_uom || ''' is not an approved unit for ' || label || '.' FROM chk WHERE agreement <> 'CONFLICT' AND bad_uom
UNION ALL SELECT product_id, label, 'UOM_MISSING', 'MEDIUM', false, label || ' is populated but has no approved UOM.' FROM chk WHERE agreement <> 'CONFLICT' AND coalesce(normalized_uom, '') = '' AND expects_uom AND populated
UNION ALL SELECT product_id, label, 'LOV_INVALID', 'HIGH', true, 'Normalized value ''' || normalized_value || ''' does not match approved LOV for ' || label || '.' FROM chk WHERE agreement <> 'CONFLICT' AND populated AND has_lov AND NOT lov_ok
UNION ALL SELECT product_id, 'Classification', 'MISSING_IDENTITY', 'HIGH', true, 'Product classification is missing.' FROM listed WHERE NOT classified)"""
ROLLED = f"""{ISSUES},
rolled AS (SELECT c.product_id, round(least(1.0e0, count(*) FILTER (populated) / 5.0e0), 4) AS completeness_score, CASE WHEN count(*) FILTER (populated) > 0 THEN round(count(*) FILTER (evidenced) * 1.0e0 / count(*) FILTER (populated), 4) ELSE 0.0e0 END AS evidence_coverage,
  coalesce(string_agg(label, '|' ORDER BY position) FILTER (NOT populated), '') AS missing_attributes, (SELECT count(*) FROM iss i WHERE i.product_id = c.product_id) AS issues,
  (SELECT count(*) FROM iss i WHERE i.product_id = c.product_id AND i.requires_review) > 0 AS requires_review,
  (SELECT count(*) FROM iss i WHERE i.product_id = c.product_id AND issue_type IN ('MISSING_IDENTITY', 'MISSING_REQUIRED')) > 0 AS failed FROM chk c GROUP BY c.product_id),
verdict AS (SELECT *, CASE WHEN failed THEN 'FAIL' WHEN requires_review THEN 'REVIEW_REQUIRED' WHEN missing_attributes <> '' THEN 'PARTIAL' ELSE 'PASS' END AS status FROM rolled)"""


def extracted(t: Tables):
    """Extracted values as stored attribute rows; the view carries no evidence."""
    return t.extracted.select("product_id", "attribute_id", "label", "value", "uom", F.lit("EXTRACTED").alias("status"),
                              F.lit(None).cast("long").alias("source_id"), F.lit(None).cast("string").alias("evidence_text"))


def consolidated(t: Tables, vocab=None):
    return evidence.consolidate(t.listed.drop("fine"), dims.template(t), extracted(t), vocab or dims.vocabulary(t))


@query("joi_10_template_expansion", "listed template", """
SELECT product_id, label, position, required, expects_uom, nullif(uom_family, '') AS uom_family FROM listed CROSS JOIN template WHERE product_id % 2 = 0 OR classpath <> 'Catalog>rings'
UNION ALL SELECT product_id, 'Diameter', 1, true, true, 'length' FROM listed WHERE product_id % 2 = 1 AND classpath = 'Catalog>rings'""")
def template_expansion(t: Tables):
    """JOI-10: own template for one classpath, default set for all others."""
    own = dims.template(t).where("position = 1").withColumns({
        "classpath": F.lit("Catalog>rings"), "label": F.lit("Diameter"), "expects_uom": F.lit(True), "uom_family": F.lit("length")})
    every = dims.template(t).unionByName(own)
    odd = F.when((F.col("product_id") % 2 == 1), F.concat(F.lit(" "), F.col("classpath"))).otherwise("Catalog>other")
    return evidence.expand_template(t.listed.select("product_id", odd.alias("classpath")), every).select(
        "product_id", "label", "position", "required", "expects_uom", "uom_family")


@query("joi_11_evidence_consolidation", LISTED, f"""WITH {CONSOLIDATED}
SELECT product_id, label, agreement, status, raw_value, normalized_value, raw_uom, normalized_uom, normalization_method, selected_source, evidence_text FROM attr2""")
def consolidation(t: Tables):
    """JOI-11 with SCA-06 and SCA-08: agreement, selection and normalized value."""
    return consolidated(t).select("product_id", "label", "agreement", "status", "raw_value", "normalized_value", "raw_uom",
                                  "normalized_uom", "normalization_method", "selected_source", "evidence_text")


@query("joi_11_secondary_candidates", "product_sources", """
WITH g AS (SELECT product_id, source_id, source_type, regexp_extract(title, '[0-9][0-9/]*[ -]?grit', 0, 'i') AS hit FROM product_sources WHERE source_type <> 'MANUFACTURER')
SELECT product_id, source_id, source_type AS source, CAST(CASE source_type WHEN 'RETAILER' THEN 0.4 ELSE 0.2 END AS DOUBLE) AS authority, hit AS evidence_text,
  regexp_extract(hit, '[0-9/]+') AS value FROM g WHERE hit <> ''""")
def secondary(t: Tables):
    """JOI-11: grit evidence in titles of non-manufacturer sources (long form)."""
    return evidence.secondary_candidates(t.product_sources).select("product_id", "source_id", "source", "authority", "evidence_text", "value")


@query("joi_12_lov_resolution", "taxonomy", f"""WITH f AS (SELECT DISTINCT upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS canonical FROM part),
spell AS (SELECT 'Finish' AS label, '' AS classpath, {q.lov_key('canonical')} AS key, canonical FROM f UNION SELECT 'Finish', '', lower(canonical) || ' grade', canonical FROM f UNION SELECT 'Finish', '', lower(canonical) || ' type', canonical FROM f
  UNION SELECT 'Product Type', classpath, fine, fine FROM taxonomy UNION SELECT 'Product Type', classpath, alias, fine FROM taxonomy),
v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN 'Product Type' WHEN 2 THEN 'Weight' ELSE 'Finish' END AS label, CASE WHEN p_partkey % 4 = 3 THEN 'Catalog>' || split_part(p_name, ' ', 2) || 's' ELSE '' END AS classpath,
  CASE p_partkey % 4 WHEN 3 THEN CASE WHEN p_partkey % 5 = 0 THEN 'Type 1' ELSE upper(split_part(p_name, ' ', 2)) END WHEN 0 THEN CASE p_partkey % 3 WHEN 0 THEN p_type ELSE lower(p_type) || '-Grade' END ELSE CASE WHEN p_partkey % 7 = 0 THEN 'bogus' ELSE ' ' || lower(p_type) || '  type ' END END AS value FROM part)
SELECT p_partkey, v.label, s.canonical AS lov_value, v.label <> 'Weight' AS has_list FROM v LEFT JOIN spell s ON s.label = v.label AND s.classpath = v.classpath AND s.key = {q.lov_key('v.value')}""")
def lov_resolution(t: Tables):
    """JOI-12: verbatim, folded, alias; three-valued outcome."""
    df = t.sql("""SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN 'Product Type' WHEN 2 THEN 'Weight' ELSE 'Finish' END AS label, CASE WHEN p_partkey % 4 = 3 THEN 'Catalog>' || split_part(p_name, ' ', 2) || 's' ELSE 'x' END AS classpath,
  CASE p_partkey % 4 WHEN 3 THEN CASE WHEN p_partkey % 5 = 0 THEN 'Type 1' ELSE upper(split_part(p_name, ' ', 2)) END WHEN 0 THEN CASE p_partkey % 3 WHEN 0 THEN p_type ELSE lower(p_type) || '-Grade' END ELSE CASE WHEN p_partkey % 7 = 0 THEN 'bogus' ELSE ' ' || lower(p_type) || '  type ' END END AS value FROM part""")
    out = normalization.resolve_lov(df, dims.vocabulary(t, finish=True))
    return out.select("p_partkey", "label", "lov_value", F.col("lov_allowed").isNotNull().alias("has_list"))


@query("sca_06_value_normalization", LISTED, f"""WITH {VOCAB}, e AS (SELECT x.attribute_id, x.label, x.value, x.uom, l.classpath FROM extracted x JOIN listed l USING (product_id)),
{q.normalize_ctes('e', 'n', vocab='vocab')} SELECT attribute_id, raw_value, raw_uom, normalized_value, normalized_uom, method FROM n""")
def value_normalization(t: Tables):
    """SCA-06: the whole value pipeline with its method trace."""
    df = t.extracted.join(t.listed.select("product_id", "classpath"), "product_id")
    return normalization.normalize_values(df, dims.vocabulary(t)).select(
        "attribute_id", "raw_value", "raw_uom", "normalized_value", "normalized_uom", "method")


@query("sca_08_comparison_key", LISTED, f"""WITH {VOCAB}, e AS (SELECT x.attribute_id, x.label, x.value, x.uom, l.classpath FROM extracted x JOIN listed l USING (product_id)),
{q.normalize_ctes('e', 'n', vocab='vocab')} SELECT attribute_id, nullif(lower(trim(normalized_value)), '') || chr(1) || lower(coalesce(normalized_uom, '')) AS comparison_key FROM n""")
def comparison_key(t: Tables):
    """SCA-08: comparison keys."""
    df = t.extracted.join(t.listed.select("product_id", "classpath"), "product_id")
    return normalization.normalize_values(df, dims.vocabulary(t)).select(
        "attribute_id", normalization.comparison_key().alias("comparison_key"))


@query("sca_12_type_from_title", "listed taxonomy", f"""
WITH s AS (SELECT classpath, fine AS spelling, fine FROM taxonomy UNION ALL SELECT classpath, alias, fine FROM taxonomy)
SELECT l.product_id, (SELECT max_by(s.fine, length(s.spelling)) FROM s WHERE s.classpath = l.classpath AND contains({q.lov_key('l.description')}, s.spelling)) AS title_type FROM listed l""")
def type_from_title(t: Tables):
    """SCA-12: longest approved Product Type spelling in the title."""
    return normalization.approved_type_from_title(t.listed, dims.vocabulary(t)).select("product_id", "title_type")


@query("agg_07_validation_rollup", LISTED, f"""WITH {ROLLED}
SELECT product_id, status, completeness_score, evidence_coverage, missing_attributes, issues, requires_review, status IN ('PASS', 'PARTIAL') AS approved_for_output FROM verdict""")
def validation_rollup(t: Tables):
    """AGG-07: scores, missing labels and status per product."""
    vocab = dims.vocabulary(t)
    checked = validation.check_attributes(consolidated(t, vocab), vocab)
    return validation.roll_up(checked, t.listed).select(
        "product_id", "status", "completeness_score", "evidence_coverage", F.array_join("missing_attributes", "|").alias("missing_attributes"),
        F.size("issues").cast("long").alias("issues"), "requires_review", "approved_for_output")


@query("agg_08_attribute_issues", LISTED, f"WITH {ISSUES} SELECT * FROM iss")
def attribute_issues(t: Tables):
    """AGG-08: one row per issue."""
    vocab = dims.vocabulary(t)
    checked = validation.check_attributes(consolidated(t, vocab), vocab)
    cols = ["product_id", "attribute", "issue_type", "severity", "requires_review", "message"]
    return validation.attribute_issues(checked).select(*cols).unionByName(validation.identity_issues(t.listed).select(*cols))


@query("agg_08_stored_attributes", "valid_products extracted template taxonomy listed", f"""WITH {VOCAB},
e AS (SELECT x.product_id, x.label, x.value, u.code AS nu, l.classpath FROM extracted x JOIN listed l USING (product_id) LEFT JOIN (VALUES ('inches','in'),('in.','in'),('kg','kg')) u(a, code) ON u.a = x.uom),
g AS (SELECT l.product_id, t.label, t.position, t.required, t.expects_uom, e.value, e.nu, e.product_id IS NOT NULL AS has_row, v.canonical FROM listed l CROSS JOIN template t LEFT JOIN e ON e.product_id = l.product_id AND e.label = t.label
  LEFT JOIN vocab v ON v.label = t.label AND v.classpath = l.classpath AND v.key = e.value)
SELECT product_id, label, coalesce(canonical, value) AS normalized_value, NOT has_row AS missing, has_row AND coalesce(nu, '') = 'kg' AS uom_invalid, CASE WHEN canonical <> value THEN 'LOV' END AS normalization_method FROM g""")
def stored_attributes(t: Tables):
    """AGG-08 on stored rows: grid against attributes, value rewritten to its canonical form."""
    unit = F.when(F.col("uom") == "kg", "kg").when(F.col("uom").isNotNull(), "in")
    none = F.lit(None).cast("string")
    stored = t.extracted.select("product_id", "label", F.col("value").alias("raw_value"), F.col("value").alias("normalized_value"),
                                F.col("uom").alias("raw_uom"), unit.alias("normalized_uom"), F.col("attribute_id").alias("source_id"),
                                none.alias("evidence_text"), F.lit("MANUFACTURER").alias("selected_source"),
                                F.lit("MANUFACTURER_SUPPORTED").alias("agreement"), none.alias("normalization_method"))
    stored = stored.join(t.listed.select("product_id"), "product_id", "left_semi")
    grid = validation.attribute_grid(t.listed, dims.template(t), stored)
    return validation.check_attributes(grid, dims.vocabulary(t)).select(
        "product_id", "label", "normalized_value", "missing", F.coalesce("uom_invalid", F.lit(False)).alias("uom_invalid"), "normalization_method")


@query("agg_09_missing_attributes", LISTED, f"""WITH {ROLLED}
SELECT product_id, missing_attributes, CASE WHEN EXISTS (SELECT 1 FROM chk c WHERE c.product_id = r.product_id AND agreement = 'CONFLICT') THEN 'REVIEW_REQUIRED' WHEN missing_attributes = '' THEN 'COMPLETE' ELSE 'PARTIAL' END AS completeness FROM rolled r""")
def missing_attributes(t: Tables):
    """AGG-09: missing labels and completeness class."""
    vocab = dims.vocabulary(t)
    out = validation.completeness(validation.check_attributes(consolidated(t, vocab), vocab))
    return out.select("product_id", F.array_join("missing_attributes", "|").alias("missing_attributes"), "completeness")


@query("flagship_deliverable_products", LISTED + " product_reviews", f"""WITH {ROLLED},
p AS (SELECT v.*, CASE status WHEN 'PASS' THEN 'VALIDATED' ELSE status END AS product_status, (SELECT count(*) FROM product_reviews r WHERE r.product_id = v.product_id AND r.status IN ('PENDING', 'IN_REVIEW')) AS pending FROM verdict v)
SELECT CASE WHEN pending > 0 OR product_status = 'REVIEW_REQUIRED' THEN 'review_pending' WHEN product_status = 'FAIL' THEN 'failed' WHEN status = 'PASS' THEN 'approved' WHEN status = 'PARTIAL' THEN 'partial' ELSE 'not_ready' END AS eligibility,
  count(*) AS products, round(avg(completeness_score), 4) AS mean_completeness, round(avg(evidence_coverage), 4) AS mean_coverage FROM p GROUP BY 1""")
def flagship(t: Tables):
    """Which products are complete and deliverable?

    Titles and extracted values -> consolidation -> normalization -> validation -> eligibility.
    """
    from ..functions.status import review_flow_status
    from ..operators.review import open_counts
    vocab = dims.vocabulary(t)
    checked = validation.check_attributes(consolidated(t, vocab), vocab)
    verdicts = validation.roll_up(checked, t.listed).join(open_counts(t.product_reviews), "product_id", "left")
    state = delivery_eligibility(review_flow_status(F.col("status")), F.col("status"), F.col("approved_for_output"), F.col("open_reviews"))
    return verdicts.groupBy(state.alias("eligibility")).agg(
        F.count(F.lit(1)).alias("products"), F.round(F.avg("completeness_score"), 4).alias("mean_completeness"),
        F.round(F.avg("evidence_coverage"), 4).alias("mean_coverage"))
