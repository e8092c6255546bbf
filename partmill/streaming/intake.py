"""Incremental intake and live progress on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import TERMINAL_ITEMS
from ..sources.intake import FIELDS, validate_rows

RAW_SCHEMA = T.StructType(
    [T.StructField("product_id", T.LongType()), T.StructField("row_position", T.LongType())]
    + [T.StructField(f, T.StringType()) for f in FIELDS])
#: Progress snapshots are folded into one after so many batches.
FOLD_EVERY = 20


def _mark(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One part number's rows of a micro-batch: copies of each other, or of a number seen before, are flagged.

    The first row waits for a second one; no other row is held.
    """
    if key[0] is None or key[0].startswith(INVALID):
        for part in parts:
            yield part.assign(status="INVALID")
        return
    copies, waiting = state.exists, None
    for part in parts:
        if not copies and waiting is not None and len(part):
            copies = True
            yield waiting.assign(status="DUPLICATE_CANDIDATE")
        if not copies and len(part) == 1:
            waiting = part
        elif len(part):
            copies = True
            yield part.assign(status="DUPLICATE_CANDIDATE")
    if not copies and waiting is not None:
        yield waiting.assign(status="INGESTED")
    state.update((True,))


INVALID = "\u0001"


def marked_arrivals(stream: DataFrame) -> DataFrame:
    """Validated rows of a stream with status INGESTED, DUPLICATE_CANDIDATE or INVALID, as a stream for any sink.

    Python is called once for every part number: `incremental_intake`, which writes folders, counts
    instead. What is remembered of a stored part number is one entry of keyed state, so a micro-batch touches
    the entries of its own numbers and never reads the stored products. Rows that were stored are
    not re-flagged when a later batch repeats their part number. Invalid rows have keys of their own
    and leave no state.
    """
    checked = validate_rows(stream)
    bad = F.concat(F.lit(INVALID), F.coalesce(F.xxhash64("product_id", "source_index"), F.lit(0)).cast("string"))
    keyed = checked.withColumn("_key", F.when(F.col("error").isNull(), F.col("mpn")).otherwise(bad))
    schema = T.StructType([*keyed.schema.fields, T.StructField("status", T.StringType())])
    return keyed.groupBy("_key").applyInPandasWithState(
        _mark, schema, "seen boolean", "append", GroupStateTimeout.NoTimeout).drop("_key")


def counted_arrivals(stream: DataFrame) -> DataFrame:
    """Validated rows of a stream and, beside them, a row (_number, _total) for every part number among the valid
    ones of a micro-batch: how often it has come up to now.

    The count is the only entry of keyed state of a part number; a micro-batch touches the entries of its own
    numbers and never reads the stored products. Invalid rows leave no state.
    """
    checked = validate_rows(stream)
    totals = checked.where("error is null").groupBy(F.col("mpn").alias("_number")).agg(F.count(F.lit(1)).alias("_total"))
    return checked.unionByName(totals, allowMissingColumns=True)


def incremental_intake(stream: DataFrame, products_path: str, errors_path: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch is written to its own batch folder, so a repeated batch overwrites itself.

    A row whose part number has come once is INGESTED, any other a DUPLICATE_CANDIDATE; rows that
    were stored are not re-flagged when a later batch repeats their part number.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist().count()  # the counts are read from state once, not for each use
        rows = batch.where("_total is null").drop("_number", "_total")
        copied = batch.where("_total > 1").select(F.col("_number").alias("mpn"), F.lit(True).alias("_copied"))
        valid = rows.where("error is null").drop("error")
        status = F.when(F.col("_copied"), "DUPLICATE_CANDIDATE").otherwise("INGESTED").alias("status")
        valid.join(copied, "mpn", "left").select(*valid.columns, status).write.mode("overwrite").parquet(
            f"{products_path}/batch_id={batch_id}")
        rows.where("error is not null").select("product_id", "source_index", "error").write.mode("overwrite").parquet(
            f"{errors_path}/batch_id={batch_id}")
        batch.unpersist()

    return (counted_arrivals(stream).writeStream.outputMode("update").foreachBatch(handle)
            .option("checkpointLocation", checkpoint))


def _folder(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def stored_products(spark: SparkSession, path: str) -> DataFrame | None:
    root, fs = _folder(spark, path)
    if not fs.exists(root):
        return None
    return spark.read.option("basePath", path).parquet(path).withColumn("batch_id", F.col("batch_id").cast("long"))


def live_progress(items: DataFrame) -> DataFrame:
    """Running counters per job over a stream of item results (update or complete mode)."""
    s, took = F.col("status"), F.col("duration_ms")
    return items.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s.isin(TERMINAL_ITEMS)).alias("processed"),
        F.count_if(s == "APPROVED").alias("approved"), F.count_if(s == "PARTIAL").alias("partial"),
        F.count_if(s == "REVIEW_REQUIRED").alias("review_required"), F.count_if(s == "FAILED").alias("failed"),
        F.sum(F.when(took != 0, took)).alias("timed_ms"), F.count_if(took != 0).alias("timed"))


def track_progress(items: DataFrame, path: str, checkpoint: str, fold_every: int = FOLD_EVERY) -> DataStreamWriter:
    """Keep the counters of all jobs under `path`: every trigger writes the jobs that changed, as one
    folder; from time to time one folder takes up all before it. Read them with `progress_so_far`."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, here = batch.sparkSession, f"{path}/batch_id={batch_id}"
        if (batch_id + 1) % fold_every:
            batch.write.mode("overwrite").parquet(here)
            return
        done, fs = _folder(spark, f"{here}/_SUCCESS")
        if not fs.exists(done):  # a repeated batch finds its folder whole, and maybe the others gone
            earlier = progress_so_far(spark, path, batch_id)
            changed = batch if earlier is None else batch.unionByName(earlier.join(batch.select("job_id"), "job_id", "left_anti"))
            changed.write.mode("overwrite").parquet(here)
        for status in fs.listStatus(_folder(spark, path)[0]):
            name = status.getPath().getName()
            if name.startswith("batch_id=") and int(name.split("=")[1]) < batch_id:
                fs.delete(status.getPath(), True)

    return live_progress(items).writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)


def progress_so_far(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The latest counters of every job, of batches below `before` if given."""
    stored = stored_products(spark, path)
    if stored is None:
        return None
    if before is not None:
        stored = stored.where(F.col("batch_id") < before)
    counters = [c for c in stored.columns if c not in ("job_id", "batch_id")]
    last = stored.groupBy("job_id").agg(F.max_by(F.struct(*counters), "batch_id").alias("x"))
    return last.select("job_id", "x.*")
