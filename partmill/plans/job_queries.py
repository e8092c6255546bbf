"""Run metrics, work selection and listings on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs
from .fixtures import Tables
from .registry import query

OPEN = "status IN ('PENDING', 'IN_REVIEW')"


@query("agg_02_job_counters", "job_items verdicts", """
WITH c AS (SELECT job_id, count(*) AS total, count(*) FILTER (status IN ('APPROVED','PARTIAL','REVIEW_REQUIRED','FAILED','SKIPPED')) AS processed, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'PARTIAL') AS partial,
  count(*) FILTER (status = 'REVIEW_REQUIRED') AS review_required, count(*) FILTER (status = 'FAILED') AS failed, round(avg(duration_ms) FILTER (duration_ms <> 0), 3) AS avg_processing_ms FROM job_items GROUP BY job_id),
v AS (SELECT job_id, round(avg(evidence_coverage), 4) AS evidence_coverage, round(avg(completeness_score), 4) AS completeness FROM job_items JOIN verdicts USING (product_id) GROUP BY job_id)
SELECT c.*, v.evidence_coverage, v.completeness, round((approved + partial + review_required) * 1.0e0 / processed, 4) AS success_rate FROM c JOIN v USING (job_id)""")
def job_counters(t: Tables):
    """AGG-02: counters, mean duration, success rate, mean scores."""
    return jobs.job_counters(t.job_items, t.verdicts).drop("products_per_minute", "progress")


@query("agg_03_stage_seconds", "stage_runs", """
SELECT job_id, stage, round(avg(duration_ms) / 1000, 3) AS avg_seconds FROM stage_runs WHERE duration_ms <> 0 GROUP BY job_id, stage""")
def stage_seconds(t: Tables):
    """AGG-03: mean seconds per stage, timed rows only."""
    return jobs.stage_timings(t.stage_runs)


@query("agg_04_stage_profile", "stage_runs", """
WITH s AS (SELECT job_id, stage, status, duration_ms, CASE WHEN duration_ms <> 0 THEN CAST(duration_ms AS DOUBLE) END AS d FROM stage_runs)
SELECT job_id, stage, count(*) AS count_total, count(d) AS count_timed, count(*) FILTER (status = 'SKIPPED') AS count_skipped, count(*) FILTER (status = 'FAILED') AS count_failed, round(avg(d), 1) AS avg_ms, round(max(d), 1) AS max_ms,
  round(quantile_cont(d, 0.5), 1) AS p50_ms, round(quantile_cont(d, 0.95), 1) AS p95_ms, round(quantile_cont(d, 0.99), 1) AS p99_ms, round(round(avg(d), 1) / 1000, 3) AS avg_s FROM s GROUP BY job_id, stage""")
def stage_profile(t: Tables):
    """AGG-04: counts and exact interpolated percentiles."""
    return jobs.stage_profile(t.stage_runs)


@query("agg_05_metric_averages", "stage_runs", """
WITH m AS (SELECT job_id, stage, unnest(json_keys(metrics)) AS metric, metrics FROM stage_runs WHERE duration_ms <> 0)
SELECT job_id, stage, metric, round(avg(TRY_CAST(json_extract_string(metrics, '$.' || metric) AS DOUBLE)), 1) AS average FROM m GROUP BY job_id, stage, metric""")
def metric_averages(t: Tables):
    """AGG-05: average of each numeric entry of the metrics map."""
    return jobs.metric_averages(t.stage_runs.withColumn("metrics", F.from_json("metrics", "map<string,string>")))


@query("agg_06_review_breakdown", "product_reviews", f"""WITH r AS (SELECT * FROM product_reviews WHERE {OPEN})
SELECT 'total' AS scope, '' AS name, count(*) AS items, count(DISTINCT product_id) AS products FROM r
UNION ALL SELECT 'issue_type', issue_type, count(*), count(DISTINCT product_id) FROM r GROUP BY issue_type
UNION ALL SELECT 'attribute', attribute, count(*), count(DISTINCT product_id) FROM r WHERE attribute <> '' GROUP BY attribute
UNION ALL SELECT 'lov_attribute', attribute, count(*), count(DISTINCT product_id) FROM r WHERE attribute <> '' AND issue_type = 'LOV_INVALID' GROUP BY attribute""")
def review_breakdown(t: Tables):
    """AGG-06: open items and distinct products by several scopes."""
    return jobs.review_breakdown(t.product_reviews)


@query("agg_06_review_breakdown_by_job", "product_reviews job_items", f"""WITH r AS (SELECT j.job_id, p.* FROM product_reviews p JOIN (SELECT DISTINCT job_id, product_id FROM job_items) j USING (product_id) WHERE {OPEN})
SELECT job_id, 'total' AS scope, '' AS name, count(*) AS items, count(DISTINCT product_id) AS products FROM r GROUP BY job_id
UNION ALL SELECT job_id, 'issue_type', issue_type, count(*), count(DISTINCT product_id) FROM r GROUP BY job_id, issue_type
UNION ALL SELECT job_id, 'attribute', attribute, count(*), count(DISTINCT product_id) FROM r WHERE attribute <> '' GROUP BY job_id, attribute
UNION ALL SELECT job_id, 'lov_attribute', attribute, count(*), count(DISTINCT product_id) FROM r WHERE attribute <> '' AND issue_type = 'LOV_INVALID' GROUP BY job_id, attribute""")
def review_breakdown_by_job(t: Tables):
    """AGG-06 per job."""
    return jobs.review_breakdown(t.product_reviews, t.job_items)


@query("agg_12_throughput", "job_items", """
WITH c AS (SELECT job_id, count(*) AS total, count(*) FILTER (status IN ('APPROVED','PARTIAL','REVIEW_REQUIRED','FAILED','SKIPPED')) AS processed, round(avg(duration_ms) FILTER (duration_ms <> 0), 3) AS a FROM job_items GROUP BY job_id)
SELECT job_id, round(60000.0e0 / a * 2, 2) AS products_per_minute, round(processed * 100.0e0 / total, 1) AS progress FROM c""")
def throughput(t: Tables):
    """AGG-12: implied throughput and progress."""
    return jobs.job_counters(t.job_items, workers=2).select("job_id", "products_per_minute", "progress")


@query("agg_13_queue_counts", "review_queue", "SELECT issue_type, count(*) AS items FROM review_queue GROUP BY issue_type ORDER BY items DESC, issue_type")
def queue_counts(t: Tables):
    """AGG-13: queue counts by issue type."""
    return jobs.queue_counts(t.review_queue)


def outputs(t: Tables):
    """Stage output tables with product_id, each covering part of the products."""
    p = t.states.select("product_id")
    have = {"understanding": "product_id % 10 <> 9", "entity_resolution": "product_id % 10 < 8", "classification": "product_id % 10 < 7",
            "research": "product_id % 10 < 6", "manufacturer_source": "product_id % 10 < 5", "rag": "product_id % 10 < 4",
            "extraction": "product_id % 10 < 3", "normalization": "product_id % 10 < 2", "validation": "product_id % 10 < 1"}
    return {k: p.where(v) for k, v in have.items()}


DONE = """done AS (SELECT product_id, stage, pos, CASE stage WHEN 'understanding' THEN d <> 9 WHEN 'entity_resolution' THEN d < 8 WHEN 'classification' THEN d < 7 WHEN 'research' THEN d < 6 OR status = 'NO_AUTHORITATIVE_SOURCE'
  WHEN 'rag' THEN d < 4 OR NOT d < 5 WHEN 'extraction' THEN d < 3 OR NOT d < 4 WHEN 'normalization' THEN d < 2 OR NOT d < 3 ELSE d < 1 OR NOT d < 2 END AS complete
  FROM (SELECT product_id, status, product_id % 10 AS d FROM states) s CROSS JOIN (VALUES (0,'understanding'),(1,'entity_resolution'),(2,'classification'),(3,'research'),(4,'rag'),(5,'extraction'),(6,'normalization'),(7,'validation')) g(pos, stage))"""
RUNS = """runs AS (SELECT event_id AS run_id, user_id AS product_id, CASE event_type WHEN 'view' THEN 'rag' WHEN 'click' THEN 'research' WHEN 'error' THEN 'extraction' ELSE 'validation' END AS stage,
  CASE WHEN event_id % 17 = 0 THEN 'FAILED' WHEN event_id % 5 = 0 THEN 'PENDING' ELSE 'COMPLETED' END AS status, user_id % 10 AS job_id, value AS duration_ms, '' AS error_message FROM events)"""


def runs(t: Tables):
    return t.sql(RUNS[RUNS.index("(") + 1:-1])


@query("agg_14_stage_map", "states", f"""WITH {DONE}, {RUNS}, last AS (SELECT product_id, stage, max_by(status, run_id) AS status FROM runs GROUP BY product_id, stage)
SELECT d.product_id, d.stage, coalesce(l.status, CASE WHEN complete THEN 'COMPLETED' ELSE 'PENDING' END) AS status FROM done d LEFT JOIN last l ON l.product_id = d.product_id AND l.stage = d.stage""")
def stage_map(t: Tables):
    """AGG-14: stage status per product, long form."""
    return jobs.stage_map(t.states, outputs(t), runs(t)).drop("stage_pos")


@query("joi_16_pending_work", "states", f"""WITH {DONE}, {RUNS}, f AS (SELECT DISTINCT product_id, stage FROM runs WHERE status = 'FAILED')
SELECT d.product_id, min_by(d.stage, pos) AS next_stage FROM done d LEFT JOIN f ON f.product_id = d.product_id AND f.stage = d.stage WHERE NOT complete OR f.stage IS NOT NULL GROUP BY d.product_id""")
def pending_work(t: Tables):
    """JOI-16: next due stage per product."""
    return jobs.pending_work(t.states, outputs(t), runs(t))


@query("joi_16_skip_after_failure", "", f"""WITH {RUNS}, o(pos, stage) AS (VALUES (1,'understanding'),(2,'entity_resolution'),(3,'classification'),(4,'research'),(5,'rag'),(6,'extraction'),(7,'normalization'),(8,'validation')),
f AS (SELECT job_id, product_id, min(pos) AS p FROM runs JOIN o USING (stage) WHERE status = 'FAILED' GROUP BY job_id, product_id)
SELECT run_id, CASE WHEN o.pos > f.p AND status NOT IN ('COMPLETED', 'SKIPPED') THEN 'SKIPPED' ELSE status END AS status, CASE WHEN o.pos > f.p AND status NOT IN ('COMPLETED', 'SKIPPED') THEN 'Skipped: earlier stage failed' ELSE '' END AS error_message
FROM runs JOIN o USING (stage) LEFT JOIN f ON f.job_id = runs.job_id AND f.product_id = runs.product_id""")
def skip_after_failure(t: Tables):
    """JOI-16: stages after a failed one are skipped."""
    r = runs(t)
    failed = r.where("status = 'FAILED'").withColumn("reason", F.lit("Skipped: earlier stage failed"))
    return jobs.skip_after_failure(r, failed.select("job_id", "product_id", "stage", "reason")).select("run_id", "status", "error_message")


@query("joi_16_retry_reset", "", f"""WITH {RUNS} SELECT run_id, CASE WHEN status = 'FAILED' AND product_id % 2 = 0 THEN 'PENDING' ELSE status END AS status FROM runs""")
def retry_reset(t: Tables):
    """JOI-16: a retry makes failed runs pending again."""
    r = runs(t)
    return jobs.reset_failed(r, r.where("product_id % 2 = 0")).select("run_id", "status")


@query("joi_18_job_products", "job_items states", """
SELECT i.job_id, i.item_id, i.product_id, i.status AS item_status, s.mpn, s.description, s.brand_1 AS brand, s.manufacturer, s.status AS product_status, count(*) OVER (PARTITION BY i.job_id) AS joined_total
FROM job_items i JOIN states s ON s.product_id = i.product_id""")
def job_products(t: Tables):
    """JOI-18: items joined with their products."""
    known = t.job_items.join(t.states.select("product_id"), "product_id", "left_semi")
    return jobs.job_products(known, t.states).withColumnRenamed("total", "joined_total")


@query("srt_01_listing_page", "states", """
SELECT * FROM (SELECT 'products' AS listing, product_id, status FROM states ORDER BY product_id LIMIT 100 OFFSET 50) a
UNION ALL SELECT * FROM (SELECT 'understanding', product_id, status FROM states WHERE status IN ('INGESTED', 'DUPLICATE_CANDIDATE') ORDER BY product_id LIMIT 30 OFFSET 20) b""")
def listing_page(t: Tables):
    """SRT-01: offset/limit listings (the page is the feature)."""
    a = jobs.page(t.states, ["product_id"], 50, 100).select(F.lit("products").alias("listing"), "product_id", "status")
    b = jobs.understanding_batch(t.states, 20, 30).select(F.lit("understanding").alias("listing"), "product_id", "status")
    return a.unionByName(b)


@query("srt_02_ordered_listings", "product_sources", """
SELECT product_id, source_id, authority_score, relevance_score FROM product_sources ORDER BY product_id, authority_score DESC, relevance_score DESC, source_id""")
def ordered_listings(t: Tables):
    """SRT-02: sources by authority and relevance."""
    from ..operators.research import ordered_sources
    return ordered_sources(t.product_sources).select("product_id", "source_id", "authority_score", "relevance_score")


JOBS = """jobs AS (SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, max(item_id) AS completed_at, min(item_id) AS created_at, count(*) AS total_products, count(*) AS processed_products FROM job_items GROUP BY job_id)"""


@query("srt_03_latest_completed_job", "job_items", f"""WITH {JOBS}
SELECT max_by(job_id, completed_at * 1000000 + created_at) FILTER (status = 'COMPLETED') AS job_id, count(*) FILTER (status IN ('QUEUED', 'RUNNING', 'PAUSED')) AS in_flight, true AS ready FROM jobs""")
def latest_job(t: Tables):
    """SRT-03: newest completed job, guarded."""
    j = t.sql(JOBS[JOBS.index("(") + 1:-1], "job_items")
    return jobs.latest_completed_job(j)


@query("srt_04_review_listing", "review_queue", "SELECT review_id, product_id, issue_type FROM review_queue WHERE status = 'PENDING' ORDER BY review_id")
def review_listing(t: Tables):
    """SRT-04: pending rows by id."""
    from ..operators.review import queue_listing
    return queue_listing(t.review_queue).select("review_id", "product_id", "issue_type")


CLASSED = "SELECT p_partkey AS product_id, CASE WHEN p_partkey % 6 = 0 THEN 'keyword' ELSE 'exact' END AS method FROM part WHERE p_partkey % 5 <> 4"


@query("set_01_wrong_type_products", "product_reviews job_items", f"""WITH c AS ({CLASSED})
SELECT product_id FROM (SELECT product_id FROM product_reviews WHERE issue_type = 'LOV_INVALID' AND attribute = 'Product Type' AND {OPEN} UNION SELECT product_id FROM c WHERE method = 'keyword') u WHERE product_id IN (SELECT product_id FROM job_items)""")
def wrong_type(t: Tables):
    """SET-01: union of open Product Type issues and keyword-classified products."""
    return jobs.reprocess_wrong_type(t.product_reviews, t.sql(CLASSED), t.job_items)


@query("set_02_stale_lov_products", "product_reviews job_items", f"""WITH c AS ({CLASSED})
SELECT product_id FROM (SELECT product_id FROM product_reviews WHERE issue_type = 'LOV_INVALID' AND {OPEN} INTERSECT SELECT product_id FROM c) u WHERE product_id IN (SELECT product_id FROM job_items)""")
def stale_lov(t: Tables):
    """SET-02: intersection of open vocabulary issues and classified products."""
    return jobs.reprocess_stale_lov(t.product_reviews, t.sql(CLASSED), t.job_items)


@query("set_01_reset_runs", "product_reviews job_items", f"""WITH {RUNS}, c AS ({CLASSED}),
g AS (SELECT product_id FROM product_reviews WHERE issue_type = 'LOV_INVALID' AND attribute = 'Product Type' AND {OPEN} UNION SELECT product_id FROM c WHERE method = 'keyword')
SELECT run_id, CASE WHEN stage IN ('classification','extraction','normalization','validation') AND product_id IN (SELECT product_id FROM g WHERE product_id IN (SELECT product_id FROM job_items)) THEN 'PENDING' ELSE status END AS status,
  CASE WHEN stage IN ('classification','extraction','normalization','validation') AND product_id IN (SELECT product_id FROM g WHERE product_id IN (SELECT product_id FROM job_items)) THEN 0.0e0 ELSE duration_ms END AS duration_ms FROM runs""")
def reset_runs(t: Tables):
    """SET-01: runs of the reprocess set return to pending."""
    targets = jobs.reprocess_wrong_type(t.product_reviews, t.sql(CLASSED), t.job_items)
    return jobs.reset_runs(runs(t), targets, ["classification", "extraction", "normalization", "validation"]).select("run_id", "status", "duration_ms")


@query("win_07_sample_product", "job_items", """WITH r AS (SELECT event_id AS run_id, user_id % 20 AS job_id, user_id AS product_id, event_type AS stage, value AS duration_ms FROM events),
s AS (SELECT job_id, min_by(product_id, item_id) AS product_id FROM (SELECT o_orderkey AS item_id, o_custkey % 20 AS job_id, o_custkey % 150 AS product_id, status FROM job_items JOIN orders ON o_orderkey = item_id) i WHERE status NOT IN ('PENDING', 'RUNNING') GROUP BY job_id)
SELECT job_id, product_id, stage, round(max_by(duration_ms, run_id) / 1000, 3) AS seconds FROM r WHERE duration_ms <> 0 AND (job_id, product_id) IN (SELECT job_id, product_id FROM s) GROUP BY job_id, product_id, stage""")
def sample_product(t: Tables):
    """WIN-07: stage seconds of each job's first finished item."""
    r = t.events.select(F.col("event_id").alias("run_id"), (F.col("user_id") % 20).alias("job_id"), F.col("user_id").alias("product_id"),
                        F.col("event_type").alias("stage"), F.col("value").alias("duration_ms"))
    items = t.job_items.join(t.orders.select(F.col("o_orderkey").alias("item_id"), (F.col("o_custkey") % 150).alias("_p")), "item_id").select(
        "item_id", "job_id", F.col("_p").alias("product_id"), "status")
    return jobs.sample_product(items, r)
