"""Review workflow on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents, review, validation
from . import dims
from .evidence_queries import ISSUES, LISTED, consolidated
from .fixtures import PLACEHOLDERS, Tables
from .registry import query

OPEN = "status IN ('PENDING', 'IN_REVIEW')"


def checked(t: Tables):
    vocab = dims.vocabulary(t)
    return validation.check_attributes(consolidated(t, vocab), vocab)


@query("rev_01_validation_drafts", LISTED, f"""WITH {ISSUES}
SELECT i.product_id, i.issue_type, i.severity, i.attribute, i.message AS reason, CASE WHEN a.agreement = 'CONFLICT' THEN coalesce(nullif(c.i_value, ''), a.raw_value) ELSE coalesce(nullif(a.normalized_value, ''), a.raw_value) END AS current_value
FROM iss i JOIN attr2 a ON a.product_id = i.product_id AND a.label = i.attribute JOIN cons c ON c.product_id = a.product_id AND c.label = a.label WHERE i.requires_review""")
def drafts(t: Tables):
    """REV-01: drafts from reviewable issues with the current-value rule."""
    return review.checked_drafts(checked(t)).select("product_id", "issue_type", "severity", "attribute", "reason", "current_value")


CAND = """cand AS (SELECT p_partkey AS product_id, 'Width' AS label, 0 AS ordinal, CAST(p_size AS STRING) AS value, 'INPUT' AS source FROM part UNION ALL SELECT p_partkey, 'Width', 1, CAST(p_size + 1 AS STRING), 'MANUFACTURER' FROM part WHERE p_partkey % 3 = 0)"""


@query("rev_01_draft_candidates", "", f"""WITH {CAND}
SELECT product_id, 'LOV_INVALID' AS issue_type, 0 AS block, ordinal, value, source FROM cand
UNION ALL SELECT p_partkey, 'LOV_INVALID', 1, 0, p_brand, 'ALLOWED_LOV' FROM part UNION ALL SELECT p_partkey, 'LOV_INVALID', 1, 1, p_type, 'ALLOWED_LOV' FROM part""")
def draft_candidates(t: Tables):
    """REV-01: evidence candidates followed by the allowed list values."""
    d = t.part.select(F.col("p_partkey").alias("product_id"), F.lit("LOV_INVALID").alias("issue_type"),
                      F.lit("Width").alias("attribute"), F.array("p_brand", "p_type").alias("allowed_values"))
    c = t.sql(CAND[CAND.index("(") + 1:-1])
    return review.draft_candidates(d, c).select("product_id", "issue_type", "block", F.col("ordinal").cast("int").alias("ordinal"), "value", "source")


@query("rev_02_cross_table_drafts", "understood states product_sources product_reviews", f"""
WITH u AS (SELECT *, CASE WHEN lower(trim(brand_1)) NOT IN ('-- unbranded --','-- no brand --') THEN brand_1 WHEN lower(trim(brand_2)) NOT IN ('-- unbranded --','-- no brand --') THEN brand_2 END AS s, CASE WHEN lower(trim(brand_candidate)) NOT IN ('-- unbranded --') THEN brand_candidate END AS d FROM understood),
c AS (SELECT p_partkey AS product_id, (p_partkey % 10) / 10.0e0 AS confidence, 'Path ' || p_type AS classpath FROM part),
q AS (SELECT product_id, min(review_id) AS r FROM product_reviews WHERE issue_type = 'BRAND_CONFLICT' AND {OPEN} GROUP BY product_id)
SELECT product_id, 'BRAND_CONFLICT' AS issue_type, 'Brand' AS attribute, coalesce(s, 'match') AS current_value FROM u WHERE coalesce(lower(trim(s)) <> lower(trim(d)), false) OR product_id % 50 = 0
UNION ALL SELECT product_id, 'LOW_CLASSIFICATION_CONFIDENCE', 'Classification', classpath FROM c WHERE confidence < 0.7
UNION ALL SELECT s.product_id, 'NO_AUTHORITATIVE_SOURCE', 'Manufacturer source', NULL FROM states s LEFT JOIN (SELECT product_id, bool_or(source_type = 'MANUFACTURER') AS m FROM product_sources GROUP BY product_id) x ON x.product_id = s.product_id
  WHERE s.status = 'NO_AUTHORITATIVE_SOURCE' OR (NOT coalesce(m, true) AND s.status NOT IN ('INGESTED','DUPLICATE_CANDIDATE','INVALID','UNDERSTOOD','RESOLVED','CLASSIFIED'))
UNION ALL SELECT q.product_id, 'LLM_QUOTA_EXHAUSTED', p.attribute, p.current_value FROM q JOIN product_reviews p ON p.review_id = q.r WHERE q.product_id % 4 = 0 OR q.product_id NOT IN (SELECT product_id FROM understood)
UNION ALL SELECT product_id, CASE WHEN kind = 0 THEN 'SOURCE_FETCH_FAILED' ELSE 'LLM_QUOTA_EXHAUSTED' END, CASE WHEN kind = 0 THEN 'Manufacturer Source' ELSE 'Extraction' END, NULL FROM (SELECT DISTINCT user_id AS product_id, event_id % 2 AS kind FROM events WHERE user_id IN (SELECT product_id FROM states)) e""")
def cross_table_drafts(t: Tables):
    """REV-02: brand, classification, source, quota and deferral drafts."""
    brand = t.understood.withColumn("brand_method", F.when(F.col("product_id") % 50 == 0, "brand_conflict")).withColumn("brand_match_candidate", F.lit("match"))
    classed = t.part.select(F.col("p_partkey").alias("product_id"), ((F.col("p_partkey") % 10) / 10.0).alias("confidence"),
                            F.concat(F.lit("Path "), "p_type").alias("classpath"))
    queue = t.product_reviews.withColumn("issue_type", F.when(F.col("issue_type") == "BRAND_CONFLICT", "LLM_QUOTA_EXHAUSTED").otherwise(F.col("issue_type"))).withColumns({
        "severity": F.lit("HIGH"), "reason": F.lit("quota"), "stage": F.when(F.col("product_id") % 4 == 0, "extraction").otherwise("understanding")})
    errors = t.events.select(F.col("user_id").alias("product_id"), F.col("event_id").alias("error_id"), F.lit("extraction").alias("stage"),
                             F.when(F.col("event_id") % 2 == 0, "SOURCE_FETCH_FAILED").otherwise("LLM_QUOTA_EXHAUSTED").alias("error_type"), F.lit("").alias("message"))
    parts = [review.brand_drafts(brand, PLACEHOLDERS), review.classification_drafts(classed), review.source_drafts(t.states, t.product_sources),
             review.quota_drafts(queue, t.understood), review.deferral_rows(errors, t.states)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("product_id", "issue_type", "attribute", "current_value")


PRIMARY = """SELECT p_partkey AS product_id, 'LOV_INVALID' AS issue_type, ' Product type' AS attribute, 'cur ' || p_type AS current_value FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'SOURCE_CONFLICT', 'Width', p_brand FROM part WHERE p_partkey % 3 = 0"""
EXTRAS = """SELECT p_partkey AS product_id, 'LOV_INVALID' AS issue_type, 'PRODUCT TYPE' AS attribute, 'extra' AS current_value FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'BRAND_CONFLICT', 'Brand', p_brand FROM part WHERE p_partkey % 5 = 0"""
COLLECTED = f"""dec AS (SELECT DISTINCT product_id, issue_type, lower(trim(attribute)) AS k FROM product_reviews WHERE status IN ('APPROVED','REJECTED','UNKNOWN')),
al AS (SELECT *, 0 AS p FROM ({PRIMARY}) a UNION ALL SELECT *, 1 FROM ({EXTRAS}) b),
dr AS (SELECT * FROM (SELECT *, lower(trim(attribute)) AS k, row_number() OVER (PARTITION BY product_id, issue_type, lower(trim(attribute)) ORDER BY p) AS rn FROM al) x WHERE rn = 1 AND (product_id, issue_type, k) NOT IN (SELECT product_id, issue_type, k FROM dec))"""


def shaped(df):
    return review._draft(df, product_id=F.col("product_id"), issue_type=F.col("issue_type"), severity=F.lit("HIGH"),
                         attribute=F.col("attribute"), current_value=F.col("current_value"), reason=F.lit("why"))


def collected(t: Tables):
    return review.collect_drafts(shaped(t.sql(PRIMARY)), shaped(t.sql(EXTRAS)), t.product_reviews)


@query("set_03_undecided_drafts", "product_reviews", f"WITH {COLLECTED} SELECT product_id, issue_type, k AS attribute_key, current_value FROM dr")
def undecided(t: Tables):
    """SET-03: drafts minus decided keys, first draft per key."""
    return collected(t).select("product_id", "issue_type", "attribute_key", "current_value")


@query("rev_03_queue_synchronisation", "product_reviews", f"""WITH {COLLECTED},
o AS (SELECT *, lower(trim(attribute)) AS k FROM product_reviews WHERE {OPEN})
SELECT review_id, product_id, issue_type, attribute, status, current_value FROM product_reviews WHERE NOT {OPEN}
UNION ALL SELECT o.review_id, dr.product_id, dr.issue_type, dr.attribute, o.status, dr.current_value FROM o JOIN dr ON dr.product_id = o.product_id AND dr.issue_type = o.issue_type AND dr.k = o.k
UNION ALL SELECT NULL, dr.product_id, dr.issue_type, dr.attribute, 'PENDING', dr.current_value FROM dr LEFT JOIN o ON dr.product_id = o.product_id AND dr.issue_type = o.issue_type AND dr.k = o.k WHERE o.product_id IS NULL""")
def synchronisation(t: Tables):
    """REV-03: merge of drafts into the queue (new ids are shown as null)."""
    synced = review.sync_queue(t.product_reviews, collected(t))
    return synced.select(F.when(F.col("review_id") < 10**9, F.col("review_id")).alias("review_id"), "product_id", "issue_type",
                         "attribute", "status", "current_value")


@query("rev_03_quality_gate", "product_reviews states", f"""WITH n AS (SELECT product_id, count(*) AS c FROM product_reviews WHERE {OPEN} GROUP BY product_id)
SELECT s.product_id, CASE WHEN c > 0 THEN 'REVIEW_REQUIRED' ELSE s.status END AS status, coalesce(c, 0) > 0 AS requires_review, coalesce(c, 0) AS open_reviews FROM states s LEFT JOIN n ON n.product_id = s.product_id""")
def quality_gate(t: Tables):
    """REV-03: product status after synchronisation."""
    return review.quality_gate(t.states, t.product_reviews).select("product_id", "status", "requires_review", "open_reviews")


ATTRS = """SELECT x.product_id, x.label, CAST(p_size AS STRING) AS raw_value, CASE WHEN x.product_id % 6 = 0 THEN NULL ELSE CAST(p_size AS STRING) END AS normalized_value, 'in' AS normalized_uom, CAST(NULL AS STRING) AS evidence_text, x.attribute_id AS source_id,
  CASE WHEN x.product_id % 6 = 0 THEN 'CONFLICT' ELSE 'AGREEMENT' END AS agreement, CASE WHEN x.product_id % 2 = 0 THEN 'FRACTION' END AS normalization_method, 'MANUFACTURER' AS selected_source, 'NORMALIZED' AS status FROM extracted x JOIN part ON p_partkey = x.product_id WHERE x.label <> 'Product Type'"""
CANDS = """SELECT product_id, label, 0 AS ordinal, CAST(CAST(raw_value AS INT) + 1 AS STRING) AS value, 'INPUT' AS source, 'title' AS evidence_text, CAST(NULL AS BIGINT) AS source_id FROM attrs UNION ALL SELECT product_id, label, 1, raw_value, 'MANUFACTURER', 'page', source_id FROM attrs"""
DECISIONS = """SELECT review_id, CASE review_id % 5 WHEN 0 THEN ' approve' WHEN 1 THEN 'Select Candidate' WHEN 2 THEN 'REJECT' WHEN 3 THEN 'mark as unknown' ELSE 'SELECT' END AS decision, CASE WHEN review_id % 5 = 1 THEN '7' END AS selected_value,
  CASE WHEN review_id % 5 = 4 THEN 'input' END AS selected_source, 'pat' AS reviewed_by, 'checked' AS review_reason FROM product_reviews"""


def decided(t: Tables):
    attrs = t.sql(ATTRS, "extracted")
    attrs.createOrReplaceTempView("attrs")
    cands = t.spark.sql(CANDS)
    decisions = t.sql(DECISIONS, "product_reviews")
    queue = t.product_reviews.withColumn("ai_value", F.lit(None).cast("string"))
    paths = t.part.select(F.col("p_partkey").alias("product_id"), F.lit("Catalog").alias("classpath"))
    return attrs, queue, review.apply_decisions(decisions, queue, attrs, cands, paths, None)


OUTCOME = f"""attrs AS ({ATTRS}), d AS ({DECISIONS}),
j AS (SELECT d.*, r.product_id, r.attribute AS label, r.status AS qs, r.current_value AS qc, a.raw_value, a.normalized_value, a.agreement, a.normalization_method, a.label IS NOT NULL AS has_row,
  CASE d.review_id % 5 WHEN 0 THEN 'APPROVE_CURRENT' WHEN 1 THEN 'SELECT_CANDIDATE' WHEN 2 THEN 'REJECT_ATTRIBUTE' WHEN 3 THEN 'MARK_UNKNOWN' ELSE 'SELECT_CANDIDATE' END AS dec,
  CASE WHEN d.review_id % 5 = 1 THEN '7' WHEN a.label IS NOT NULL THEN CAST(CAST(a.raw_value AS INT) + 1 AS STRING) END AS chosen
  FROM d JOIN product_reviews r USING (review_id) LEFT JOIN attrs a ON a.product_id = r.product_id AND a.label = r.attribute)"""


@query("rev_04_apply_decisions", "product_reviews extracted", f"""WITH {OUTCOME}
SELECT review_id, dec AS decision, CASE WHEN NOT qs IN ('PENDING','IN_REVIEW') THEN 'review is already ' || qs END AS problem, CASE WHEN NOT has_row THEN selected_value WHEN dec = 'SELECT_CANDIDATE' THEN chosen WHEN dec = 'APPROVE_CURRENT' THEN coalesce(normalized_value, raw_value) END AS final_value,
  CASE WHEN dec = 'SELECT_CANDIDATE' THEN CASE WHEN review_id % 5 = 4 THEN 'INPUT_SOURCED' WHEN has_row AND chosen = CAST(CAST(raw_value AS INT) + 1 AS STRING) THEN 'INPUT_SOURCED' WHEN has_row THEN 'MANUFACTURER_SUPPORTED' ELSE 'INPUT_SOURCED' END WHEN dec = 'APPROVE_CURRENT' THEN agreement ELSE 'NOT_FOUND' END AS agreement,
  CASE WHEN dec = 'SELECT_CANDIDATE' THEN concat_ws('+', normalization_method, 'HUMAN') ELSE normalization_method END AS normalization_method,
  CASE dec WHEN 'MARK_UNKNOWN' THEN 'UNKNOWN' WHEN 'REJECT_ATTRIBUTE' THEN 'REJECTED' ELSE 'APPROVED' END AS queue_status FROM j""")
def decisions(t: Tables):
    """REV-04: outcome of each human decision."""
    out = decided(t)[2]
    return out.select("review_id", "decision", "problem", "final_value", "agreement", "normalization_method", "queue_status")


@query("rev_04_updated_attributes", "product_reviews extracted", f"""WITH {OUTCOME},
g AS (SELECT DISTINCT product_id, label, dec, chosen, normalized_value AS nv FROM j WHERE has_row AND qs IN ('PENDING','IN_REVIEW') AND review_id IN (SELECT max(review_id) FROM j WHERE qs IN ('PENDING','IN_REVIEW') GROUP BY product_id, label))
SELECT a.product_id, a.label, CASE WHEN g.dec IS NULL THEN a.normalized_value WHEN g.dec = 'SELECT_CANDIDATE' THEN g.chosen WHEN g.dec = 'APPROVE_CURRENT' THEN a.normalized_value END AS normalized_value, g.dec AS review_decision FROM attrs a LEFT JOIN g ON g.product_id = a.product_id AND g.label = a.label""")
def updated_attributes(t: Tables):
    """REV-04: attribute table after the newest open decision per attribute."""
    attrs, _, out = decided(t)
    good = out.where("problem is null")
    last = good.groupBy("product_id", "label").agg(F.max("review_id").alias("review_id"))
    chosen = good.join(last.select("review_id"), "review_id", "left_semi")
    return review.updated_attributes(attrs, chosen).select("product_id", "label", "normalized_value", "review_decision")


@query("rev_05_product_finalisation", "product_reviews states verdicts", f"""WITH n AS (SELECT product_id, count(*) AS c, min(review_id) AS f FROM product_reviews WHERE {OPEN} GROUP BY product_id)
SELECT s.product_id, CASE WHEN c > 0 THEN 'REVIEW_REQUIRED' WHEN v.status IS NULL OR v.approved_for_output THEN 'APPROVED' ELSE v.status END AS final_status, coalesce(c, 0) AS remaining_reviews,
  CASE WHEN c > 0 THEN 'REVIEW_REQUIRED' ELSE s.status END AS process_status, coalesce(v.approved_for_output, false) AND coalesce(c, 0) = 0 AS approved_for_output, f AS review_id
FROM states s LEFT JOIN n ON n.product_id = s.product_id LEFT JOIN verdicts v ON v.product_id = s.product_id""")
def finalisation(t: Tables):
    """REV-05: product status after decisions and the process summary."""
    done = review.finalize_products(t.states, t.product_reviews, t.verdicts).withColumnRenamed("status", "final_status")
    summary = review.process_summary(t.states, t.product_reviews, t.verdicts).withColumnRenamed("status", "process_status")
    return done.join(summary.select("product_id", "process_status", "approved_for_output", "review_id"), "product_id")


@query("set_04_ordered_distinct", "", """
WITH h AS (SELECT conv_id, turn, trim(split_part(text, '.', 1)) AS s FROM conversations)
SELECT conv_id AS product_id, s AS snippet, min(turn) AS first_rank FROM h WHERE s <> '' GROUP BY conv_id, s""")
def ordered_distinct(t: Tables):
    """SET-04: snippets once per group, by first occurrence."""
    hits = t.conversations.select(F.col("conv_id").alias("product_id"), F.col("turn").alias("hit_rank"),
                                  F.split_part("text", F.lit("."), F.lit(1)).alias("evidence_text"))
    return documents.unique_snippets(hits)


# Stored findings: some reviews keep an allowed list, some of these also the normalized value.
STORED = """SELECT r.*, CASE WHEN review_id % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'why ' || CAST(review_id AS STRING) AS reason, CASE WHEN review_id % 4 = 0 THEN 'kept' END AS normalized_value,
  CASE WHEN review_id % 8 = 0 THEN 'stored list' END AS list_text FROM product_reviews r"""


@query("joi_19_review_enrichment", "product_reviews states extracted listed", f"""WITH attrs AS ({ATTRS}), st AS ({STORED}),
j AS (SELECT r.*, s.mpn, l.classpath, l.fine, a.raw_value AS ar, a.normalized_value AS an, a.selected_source AS asrc, r.issue_type = 'LOV_INVALID' AND (list_text IS NULL OR r.normalized_value IS NULL) AS fill
  FROM st r LEFT JOIN states s ON s.product_id = r.product_id LEFT JOIN listed l ON l.product_id = r.product_id LEFT JOIN attrs a ON a.product_id = r.product_id AND a.label = r.attribute)
SELECT review_id, mpn, issue_type, attribute, classpath, severity, reason, current_value, CASE WHEN fill THEN ar END AS raw_value, coalesce(normalized_value, CASE WHEN fill THEN an END, current_value) AS normalized_value,
  coalesce(list_text, CASE WHEN fill AND attribute = 'Product Type' THEN fine END) AS allowed_values, CASE WHEN fill THEN asrc END AS source FROM j""")
def enrichment(t: Tables):
    """JOI-19: queue rows with product, classification, stored findings and back-filled diagnostics."""
    attrs, queue = t.sql(ATTRS, "extracted"), t.sql(STORED, "product_reviews")
    queue = queue.withColumn("allowed_values", F.when(F.col("list_text").isNotNull(), F.array("list_text"))).drop("list_text")
    rows = review.enrich_queue(queue, t.states, attrs, t.listed, dims.vocabulary(t))
    return rows.select("review_id", "mpn", "issue_type", "attribute", "classpath", "severity", "reason", "current_value", "raw_value",
                       "normalized_value", F.array_join("allowed_values", "|").alias("allowed_values"), "source")


@query("joi_19_review_sources", "product_reviews product_sources", """
SELECT r.review_id, r.product_id, s.source_id, s.url, CAST(row_number() OVER (PARTITION BY r.review_id ORDER BY s.authority_score DESC, s.source_id, s.url) AS INT) AS source_rank FROM product_reviews r JOIN product_sources s ON s.product_id = r.product_id""")
def review_sources(t: Tables):
    """JOI-19: the product's sources beside each review."""
    return review.review_sources(t.product_reviews, t.product_sources).select("review_id", "product_id", "source_id", "url", "source_rank")


OLD = "SELECT product_id, issue_type, attribute, 0 AS block, CAST(0 AS BIGINT) AS ordinal, 'old ' || CAST(review_id AS STRING) AS value, 'INPUT' AS source FROM product_reviews"
VALUES = "SELECT p_partkey AS product_id, 'Width' AS label, CAST(1 AS BIGINT) AS ordinal, CAST(p_size AS STRING) AS value, 'INPUT' AS source FROM part UNION ALL SELECT p_partkey, 'Brand', 2, p_brand, 'MANUFACTURER' FROM part"


@query("rev_03_candidate_refresh", "product_reviews", f"""WITH {COLLECTED}, old AS ({OLD}), cv AS ({VALUES}),
closed AS (SELECT DISTINCT product_id, issue_type, lower(trim(attribute)) AS k FROM product_reviews WHERE NOT {OPEN})
SELECT o.product_id, o.issue_type, o.attribute, o.ordinal, o.value FROM old o JOIN closed c ON c.product_id = o.product_id AND c.issue_type = o.issue_type AND c.k = lower(trim(o.attribute))
UNION ALL SELECT d.product_id, d.issue_type, d.attribute, v.ordinal, v.value FROM dr d JOIN cv v ON v.product_id = d.product_id AND v.label = d.attribute""")
def candidate_refresh(t: Tables):
    """REV-03: candidate values follow the synchronised queue."""
    drafts = collected(t)
    fresh = review.draft_candidates(drafts, t.sql(VALUES))
    synced = review.sync_queue(t.product_reviews, drafts)
    return review.sync_candidates(t.sql(OLD, "product_reviews"), synced, fresh).select("product_id", "issue_type", "attribute", "ordinal", "value")
