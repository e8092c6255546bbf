"""Run metrics: job counters, stage profile, review breakdown, work selection, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import OPEN_REVIEW, STAGES, TERMINAL_ITEMS
from ..scale import exact_percentiles, percentile_name


# ---- counters ---------------------------------------------------------------

def job_counters(items: DataFrame, validations: DataFrame | None = None, workers: int = 1) -> DataFrame:
    """Per job: status counts, mean duration, success rate, throughput, mean scores."""
    status, took = F.col("status"), F.col("duration_ms")
    counts = items.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status.isin(TERMINAL_ITEMS)).alias("processed"),
        F.count_if(status == "APPROVED").alias("approved"),
        F.count_if(status == "PARTIAL").alias("partial"),
        F.count_if(status == "REVIEW_REQUIRED").alias("review_required"),
        F.count_if(status == "FAILED").alias("failed"),
        F.coalesce(F.round(F.avg(F.when(took != 0, took)), 3), F.lit(0.0)).alias("avg_processing_ms"),
    )
    if validations is not None:
        scores = items.select("job_id", "product_id").join(
            validations.select("product_id", "evidence_coverage", "completeness_score"), "product_id"
        ).groupBy("job_id").agg(F.round(F.avg("evidence_coverage"), 4).alias("evidence_coverage"),
                                F.round(F.avg("completeness_score"), 4).alias("completeness"))
        counts = counts.join(scores, "job_id", "left").withColumns({
            "evidence_coverage": F.coalesce("evidence_coverage", F.lit(0.0)),
            "completeness": F.coalesce("completeness", F.lit(0.0))})
    success = F.col("approved") + F.col("partial") + F.col("review_required")
    return counts.withColumns({
        "success_rate": F.when(F.col("processed") > 0, F.round(success / F.col("processed"), 4)).otherwise(0.0),
        "products_per_minute": throughput(F.col("avg_processing_ms"), F.lit(workers)),
        "progress": F.when(F.col("total") > 0, F.round(F.col("processed") * 100.0 / F.col("total"), 1)).otherwise(0.0),
    })


def throughput(avg_ms, workers):
    """Products per minute implied by the mean item time."""
    return F.when(avg_ms > 0, F.round(F.lit(60000.0) / avg_ms * F.greatest(workers, F.lit(1)), 2)).otherwise(0.0)


# ---- stage profile -----------------------------------------------------------

def stage_timings(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("duration_ms") != 0).groupBy("job_id", "stage").agg(
        F.round(F.avg("duration_ms") / 1000.0, 3).alias("avg_seconds"))


def stage_profile(runs: DataFrame, keys: list[str] = ("job_id", "stage")) -> DataFrame:
    """Counts include skipped runs; averages and percentiles use timed runs only."""
    keys = list(keys)
    took = F.when(F.col("duration_ms") != 0, F.col("duration_ms"))
    points = [0.5, 0.95, 0.99]
    counts = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count_total"), F.count(took).alias("count_timed"),
        F.count_if(F.col("status") == "SKIPPED").alias("count_skipped"),
        F.count_if(F.col("status") == "FAILED").alias("count_failed"),
        F.coalesce(F.round(F.avg(took), 1), F.lit(0.0)).alias("avg_ms"),
        F.coalesce(F.round(F.max(took), 1), F.lit(0.0)).alias("max_ms"))
    exact = exact_percentiles(runs.where(F.col("duration_ms") != 0), keys, "duration_ms", points)
    named = exact.select(*keys, *[F.col(percentile_name(p)).alias(f"p{p * 100:.0f}_ms") for p in points])
    out = counts.join(named, keys, "left")
    return out.withColumns({f"p{p * 100:.0f}_ms": F.coalesce(F.round(f"p{p * 100:.0f}_ms", 1), F.lit(0.0)) for p in points}
                           | {"avg_s": F.round(F.col("avg_ms") / 1000.0, 3)})


def metric_averages(runs: DataFrame, keys: list[str] = ("job_id", "stage")) -> DataFrame:
    """Average of every numeric entry of the metrics map over timed runs (long form)."""
    return (
        runs.where(F.col("duration_ms") != 0)
        .select(*keys, F.explode("metrics").alias("metric", "v"))
        .withColumn("v", F.col("v").try_cast("double")).where(F.col("v").isNotNull())
        .groupBy(*keys, "metric").agg(F.round(F.avg("v"), 1).alias("average"))
    )


def sample_product(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Stage seconds of each job's first item that is neither pending nor running."""
    first = items.where(~F.col("status").isin("PENDING", "RUNNING")).groupBy("job_id").agg(
        F.min(F.struct("item_id", "product_id"))["product_id"].alias("product_id"))
    return runs.where(F.col("duration_ms") != 0).join(first, ["job_id", "product_id"], "left_semi").groupBy(
        "job_id", "product_id", "stage").agg(F.round(F.max_by("duration_ms", "run_id") / 1000.0, 3).alias("seconds"))


# ---- reviews -------------------------------------------------------------------

def review_breakdown(queue: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Open items and distinct products in total, by issue type, by attribute, and
    LOV-invalid by attribute.

    Rows are first counted per (issue, attribute, product), then per scope and product: every product is
    then one row of its scope. Only these rows meet the jobs, of which each has a product once, so
    what a join gives is added up as it comes and no product is grouped again for every job.
    """
    rows = queue.where(F.col("status").isin(OPEN_REVIEW))
    base = rows.groupBy("issue_type", "attribute", "product_id").agg(F.count(F.lit(1)).alias("n"))
    lov = F.col("issue_type") == "LOV_INVALID"
    scopes = F.array_compact(F.array(
        F.struct(F.lit("total").alias("scope"), F.lit("").alias("name")),
        F.struct(F.lit("issue_type").alias("scope"), F.col("issue_type").alias("name")),
        F.when(F.col("attribute") != "", F.struct(F.lit("attribute").alias("scope"), F.col("attribute").alias("name"))),
        F.when(lov & (F.col("attribute") != ""), F.struct(F.lit("lov_attribute").alias("scope"), F.col("attribute").alias("name"))),
    ))
    per_product = base.select("product_id", "n", F.explode(scopes).alias("s")).groupBy(
        F.col("s.scope").alias("scope"), F.col("s.name").alias("name"), "product_id").agg(F.sum("n").alias("n"))
    lead = []
    if items is not None:
        per_product = per_product.join(items.select("job_id", "product_id").distinct(), "product_id")
        lead = ["job_id"]
    return per_product.groupBy(*lead, "scope", "name").agg(
        F.sum("n").alias("items"), F.count(F.lit(1)).alias("products"))


def queue_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("issue_type").agg(F.count(F.lit(1)).alias("items")).orderBy(F.desc("items"), "issue_type")


# ---- work selection --------------------------------------------------------------

def eligible(products: DataFrame, requested: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Products to process with their order.

    Requested ids (request_pos, product_id) keep their order and may be duplicates; a
    default run leaves duplicate candidates out. The limit is the caller's own.
    """
    if requested is not None:
        chosen = requested.join(products, "product_id").where(F.col("status") != "INVALID").withColumn(
            "run_order", F.col("request_pos"))
    else:
        chosen = products.where(~F.col("status").isin("INVALID", "DUPLICATE_CANDIDATE")).withColumn(
            "run_order", F.col("product_id"))
    return chosen.orderBy("run_order").limit(limit) if limit else chosen


PREREQUISITE = {"rag": "manufacturer_source", "extraction": "rag", "normalization": "extraction",
                "validation": "normalization"}


def _done(products: DataFrame, outputs: dict[str, DataFrame]) -> DataFrame:
    """One flag per stage output, from distinct product ids of each stage table."""
    df = products
    for name, table in outputs.items():
        have = table.select("product_id").distinct().withColumn(f"_{name}", F.lit(True))
        df = df.join(have, "product_id", "left").withColumn(f"_{name}", F.coalesce(f"_{name}", F.lit(False)))
    return df


def completed_stages(products: DataFrame, outputs: dict[str, DataFrame]) -> DataFrame:
    """(product_id, stage, complete): output exists, or the stage's prerequisite is missing.

    `outputs` maps stage names, plus "manufacturer_source", to tables with product_id.
    """
    df = _done(products.select("product_id", "status"), outputs)

    def flag(stage):
        have = F.col(f"_{stage}") if stage in outputs else F.lit(False)
        if stage == "research":
            return have | (F.col("status") == "NO_AUTHORITATIVE_SOURCE")
        need = PREREQUISITE.get(stage)
        return have | ~F.col(f"_{need}") if need in outputs else have
    grid = F.array(*[F.struct(F.lit(i).alias("stage_pos"), F.lit(s).alias("stage"), flag(s).alias("complete"))
                     for i, s in enumerate(STAGES)])
    return df.select("product_id", F.explode(grid).alias("g")).select("product_id", "g.*")


def pending_work(products: DataFrame, outputs: dict[str, DataFrame], runs: DataFrame | None = None) -> DataFrame:
    """First stage each product still has to run; a failed run makes its stage due again."""
    done = completed_stages(products, outputs)
    if runs is not None:
        failed = runs.where("status = 'FAILED'").select("product_id", "stage").distinct().withColumn("_failed", F.lit(True))
        done = done.join(failed, ["product_id", "stage"], "left")
    else:
        done = done.withColumn("_failed", F.lit(False))
    due = done.where(~F.col("complete") | F.coalesce("_failed", F.lit(False)))
    return due.groupBy("product_id").agg(F.min(F.struct("stage_pos", "stage"))["stage"].alias("next_stage"))


def stage_work(products: DataFrame, output: DataFrame, prerequisite: DataFrame | None = None) -> DataFrame:
    """Products lacking one stage's output and having what it needs."""
    due = products.join(output.select("product_id"), "product_id", "left_anti")
    return due if prerequisite is None else due.join(prerequisite.select("product_id"), "product_id", "left_semi")


def reset_failed(runs: DataFrame, products: DataFrame) -> DataFrame:
    """Retry: failed runs of the given products become pending."""
    retry = products.select("product_id").distinct().withColumn("_retry", F.lit(True))
    df = runs.join(retry, "product_id", "left")
    hit = F.coalesce("_retry", F.lit(False)) & (F.col("status") == "FAILED")
    return df.withColumn("status", F.when(hit, "PENDING").otherwise(F.col("status"))).drop("_retry")


def skip_after_failure(runs: DataFrame, failures: DataFrame) -> DataFrame:
    """Stages after a failed or deferred one are skipped unless already finished.

    `failures` has job_id, product_id, stage, reason.
    """
    pos = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    first = failures.groupBy("job_id", "product_id").agg(
        F.min(F.struct(pos.alias("p"), "reason")).alias("_f"))
    df = runs.join(first, ["job_id", "product_id"], "left").withColumn("_p", pos)
    skip = F.coalesce(F.col("_p") > F.col("_f.p"), F.lit(False)) & ~F.col("status").isin("COMPLETED", "SKIPPED")
    return df.withColumn("error_message", F.when(skip, F.col("_f.reason")).otherwise(F.col("error_message"))).withColumn(
        "status", F.when(skip, "SKIPPED").otherwise(F.col("status"))).drop("_f", "_p")


def stage_map(products: DataFrame, outputs: dict[str, DataFrame], runs: DataFrame) -> DataFrame:
    """(product_id, stage, status): recorded status, else COMPLETED when done, else PENDING."""
    recorded = runs.groupBy("product_id", "stage").agg(F.max_by("status", "run_id").alias("recorded"))
    return completed_stages(products, outputs).join(recorded, ["product_id", "stage"], "left").select(
        "product_id", "stage_pos", "stage",
        F.coalesce("recorded", F.when(F.col("complete"), "COMPLETED").otherwise("PENDING")).alias("status"))


def reprocess_wrong_type(queue: DataFrame, classifications: DataFrame, items: DataFrame) -> DataFrame:
    """Products with an open Product Type vocabulary issue, or classified by keyword only."""
    typed = queue.where((F.col("issue_type") == "LOV_INVALID") & (F.col("attribute") == "Product Type")
                        & F.col("status").isin(OPEN_REVIEW)).select("product_id")
    keyword = classifications.where("method = 'keyword'").select("product_id")
    return typed.union(keyword).distinct().join(items.select("product_id"), "product_id", "left_semi")


def reprocess_stale_lov(queue: DataFrame, classifications: DataFrame, items: DataFrame) -> DataFrame:
    """Products with an open vocabulary issue that are classified."""
    open_lov = queue.where((F.col("issue_type") == "LOV_INVALID") & F.col("status").isin(OPEN_REVIEW)).select("product_id")
    return open_lov.intersect(classifications.select("product_id")).join(
        items.select("product_id"), "product_id", "left_semi")


def reset_runs(runs: DataFrame, targets: DataFrame, stages: list[str]) -> DataFrame:
    hit = targets.select("product_id").distinct().withColumn("_hit", F.lit(True))
    df = runs.join(hit, "product_id", "left")
    due = F.coalesce("_hit", F.lit(False)) & F.col("stage").isin(stages)
    return df.withColumn("status", F.when(due, "PENDING").otherwise(F.col("status"))).withColumn(
        "duration_ms", F.when(due, 0.0).otherwise(F.col("duration_ms"))).drop("_hit")


# ---- listings ---------------------------------------------------------------------

def page(df: DataFrame, order: list, skip: int = 0, limit: int = 100) -> DataFrame:
    """Offset/limit listing in a given order; only the first skip + limit rows are merged."""
    return df.orderBy(*order).offset(max(0, skip)).limit(max(1, limit))


def understanding_batch(products: DataFrame, skip: int = 0, limit: int = 100, force: bool = False) -> DataFrame:
    rows = products if force else products.where(F.col("status").isin("INGESTED", "DUPLICATE_CANDIDATE"))
    return page(rows, ["product_id"], skip, limit)


def job_products(items: DataFrame, products: DataFrame) -> DataFrame:
    """Item listing joined with its product; `total` counts the job's items."""
    totals = items.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))
    return items.select("job_id", "item_id", "product_id", F.col("status").alias("item_status")).join(
        products.select("product_id", "mpn", "description", F.col("brand_1").alias("brand"), "manufacturer",
                        F.col("status").alias("product_status")), "product_id").join(totals, "job_id")


def latest_completed_job(jobs: DataFrame) -> DataFrame:
    """The newest completed job with `ready`; refused while any job is in flight or it is incomplete."""
    best = jobs.agg(
        F.max(F.when(F.col("status") == "COMPLETED", F.struct(
            "completed_at", "created_at", "job_id", "total_products", "processed_products"))).alias("j"),
        F.count_if(F.col("status").isin("QUEUED", "RUNNING", "PAUSED")).alias("in_flight"))
    ready = (F.col("in_flight") == 0) & F.col("j").isNotNull() & (F.col("j.total_products") > 0) & (
        F.col("j.processed_products") >= F.col("j.total_products"))
    return best.select("j.job_id", "in_flight", F.coalesce(ready, F.lit(False)).alias("ready"))


def unchanged_identity(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose identity columns differ between two snapshots (empty when all is well)."""
    return before.select(*columns).exceptAll(after.select(*columns))
