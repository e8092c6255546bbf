"""Structured Streaming jobs on the driver tables, run to completion with availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import TERMINAL_ITEMS
from ..scale import scratch_path
from ..streaming import intake
from .fixtures import Tables
from .registry import query


@query("str_01_incremental_intake", "products", """
WITH v AS (SELECT product_id, nullif(trim(mpn), '') AS mpn, nullif(trim(description), '') AS description FROM products), ok AS (SELECT *, CASE WHEN product_id % 20 = 19 OR product_id % 7 = 3 THEN 2 ELSE 1 END AS arrival FROM v WHERE mpn IS NOT NULL AND description IS NOT NULL),
n AS (SELECT mpn, arrival, count(*) AS c FROM ok GROUP BY mpn, arrival)
SELECT product_id, ok.mpn, CASE WHEN n.c > 1 OR e.c > 0 THEN 'DUPLICATE_CANDIDATE' ELSE 'INGESTED' END AS status FROM ok JOIN n ON n.mpn = ok.mpn AND n.arrival = ok.arrival LEFT JOIN n e ON e.mpn = ok.mpn AND e.arrival < ok.arrival
UNION ALL SELECT product_id, mpn, 'INVALID' FROM v WHERE mpn IS NULL OR description IS NULL""")
def incremental_intake(t: Tables):
    """STR-01: two arrivals with copies within and across them, each validated and marked against what is stored."""
    base = scratch_path(t.spark, "stream")
    source, products, errors = f"{base}/in", f"{base}/products", f"{base}/errors"
    raw = t.products.select("product_id", (F.col("product_id") + 1).alias("row_position"), "mpn", "description",
                            "brand_1", "brand_2", "brand_3", "manufacturer")
    # Most second copies of a part number arrive later than the first: marking reaches back over the batch.
    later = "(product_id % 20 = 19 or product_id % 7 = 3)"
    for arrival in (f"not {later}", later):
        raw.where(arrival).write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(intake.RAW_SCHEMA).parquet(source)
        run = intake.incremental_intake(stream, products, errors, f"{base}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    stored = intake.stored_products(t.spark, products).select("product_id", "mpn", "status")
    bad = intake.stored_products(t.spark, errors).select("product_id", "source_index")
    bad = bad.join(t.products.select("product_id", F.nullif(F.trim("mpn"), F.lit("")).alias("mpn")), "product_id")
    return stored.unionByName(bad.select("product_id", "mpn", F.lit("INVALID").alias("status")))


@query("str_02_live_progress", "", f"""
WITH i AS (SELECT user_id % 10 AS job_id, CASE event_type WHEN 'purchase' THEN 'APPROVED' WHEN 'view' THEN 'PARTIAL' WHEN 'click' THEN 'REVIEW_REQUIRED' WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END AS status, CASE WHEN event_id % 10 = 0 THEN 0 ELSE value END AS duration_ms FROM events)
SELECT job_id, count(*) AS total, count(*) FILTER (status IN ({', '.join(repr(s) for s in TERMINAL_ITEMS)})) AS processed, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'PARTIAL') AS partial,
  count(*) FILTER (status = 'REVIEW_REQUIRED') AS review_required, count(*) FILTER (status = 'FAILED') AS failed, round(sum(duration_ms) FILTER (duration_ms <> 0), 2) AS timed_ms, count(*) FILTER (duration_ms <> 0) AS timed FROM i GROUP BY job_id""")
def live_progress(t: Tables):
    """STR-02: counters over the event stream in four arrivals; each trigger writes the jobs that changed."""
    base = scratch_path(t.spark, "progress")
    status = F.when(F.col("event_type") == "purchase", "APPROVED").when(F.col("event_type") == "view", "PARTIAL").when(
        F.col("event_type") == "click", "REVIEW_REQUIRED").when(F.col("event_type") == "error", "FAILED").otherwise("RUNNING")
    items = t.events.select((F.col("user_id") % 10).alias("job_id"), status.alias("status"),
                            F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(F.col("value")).alias("duration_ms"),
                            F.pmod(F.col("event_id"), F.lit(4)).alias("arrival"))
    items.repartition("arrival").write.partitionBy("arrival").parquet(f"{base}/in")
    stream = t.spark.readStream.schema(items.drop("arrival").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/arrival=*")
    intake.track_progress(stream, f"{base}/out", f"{base}/checkpoint", 3).trigger(availableNow=True).start().awaitTermination()
    return intake.progress_so_far(t.spark, f"{base}/out").withColumn("timed_ms", F.round("timed_ms", 2))
