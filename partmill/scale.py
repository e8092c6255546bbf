"""Helpers that keep plans safe when the data grows: size-checked broadcast,
lineage cutting through shared storage, exact distributed percentiles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SURE_BYTES = 1 << 18
MAX_LOOKUP_ROWS = 20_000
MAX_LOOKUP_BYTES = 4 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on (all changeable on a live session)."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Patterned rows are many times larger in memory than in a shuffle file: past this size a shuffle is
        # read by more tasks, not by larger ones.
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # A Python worker holds a few batches with their results: its memory follows their size.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # The driver builds every table it broadcasts, several at a time: only small ones. Patterned names
        # are many times larger in memory than in their Parquet files, from which sizes are planned.
        "spark.sql.autoBroadcastJoinThreshold": "4m",
        "spark.sql.sources.fileCompressionFactor": "8.0",
        # Keyed state of streams on disk: memory does not grow with the keys.
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # Lookup joins run on derived keys, never on partition columns. The pruning rule
        # still expands every derived key to its inputs, which took most of planning time.
        "spark.sql.optimizer.dynamicPartitionPruning.enabled": "false",
    }.items():
        spark.conf.set(key, value)
    return spark


def planned_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate; no job runs."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:
        return None


def lookup(dim: DataFrame, max_rows: int = MAX_LOOKUP_ROWS, max_bytes: int = MAX_LOOKUP_BYTES) -> DataFrame:
    """Mark a dimension for broadcast only when its size is known to be small.

    The planner's estimate settles the clear cases; otherwise a bounded probe counts
    rows and bytes. A dimension beyond the bound is returned unmarked, so the join
    becomes a shuffled one that AQE may still split or convert. Meant for dimensions and
    written tables: the probe runs the input's plan.
    """
    planned = planned_bytes(dim)
    if planned is not None and planned <= SURE_BYTES:
        return F.broadcast(dim)
    probe = dim.limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long")), F.lit(0)).alias("b"),
    ).first()
    if probe.n <= max_rows and probe.b <= max_bytes:
        return F.broadcast(dim)
    return dim


_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; only a local session may fall back to /tmp."""
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dir


_scopes: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


def scratch_path(spark: SparkSession, label: str, lasting: bool = False) -> str:
    """A new path in the innermost scratch scope of this thread; `lasting` ones outlive every scope."""
    folder = shared_dir(spark) if lasting or not _scopes.get() else _scopes.get()[-1]
    return f"{folder}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Keep the scratch tables of one run in one folder of the shared store and delete it at the end.

    Results built inside read those tables: write or collect them before leaving the scope.
    """
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    entered = _scopes.set((*_scopes.get(), folder))
    try:
        yield folder
    finally:
        _scopes.reset(entered)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Write once to shared storage and read back: a reusable result whose recovery
    does not depend on the executors that produced it."""
    path = scratch_path(df.sparkSession, label, lasting)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def percentile_name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """Exact linearly interpolated percentiles per key, with no group in one task.

    Equal values are counted first, then counted again per narrow logarithmic band.
    Bands give the running rank; only the bands that hold a wanted rank are opened.
    """
    band = (
        F.when(F.col("_v") > 0, F.floor(F.log2(F.col("_v")) * 64) + 1_000_000)
        .when(F.col("_v") < 0, -(F.floor(F.log2(-F.col("_v")) * 64) + 1_000_000))
        .otherwise(F.lit(0))
    )
    counted = (
        df.select(*keys, F.col(value).cast("double").alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_band", band.cast("long"))
    )
    per_key = Window.partitionBy(*keys)
    bands = (
        counted.groupBy(*keys, "_band").agg(F.sum("_n").alias("_bn"))
        .withColumn("_total", F.sum("_bn").over(per_key))
        .withColumn(
            "_before",
            F.sum("_bn").over(per_key.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .withColumn("_before", F.coalesce("_before", F.lit(0)))
    )
    wanted = bands.withColumn(
        "_w",
        F.explode(F.array(*[
            F.struct(
                F.lit(p).alias("p"),
                F.floor((F.col("_total") - 1) * F.lit(p)).alias("low"),
                ((F.col("_total") - 1) * F.lit(p) - F.floor((F.col("_total") - 1) * F.lit(p))).alias("frac"),
            ) for p in points
        ])),
    ).withColumn(
        "_r", F.explode(F.array(
            F.struct(F.lit("low").alias("side"), F.col("_w.low").alias("rank")),
            F.struct(F.lit("high").alias("side"),
                     F.least(F.col("_w.low") + 1, F.col("_total") - 1).alias("rank")),
        ))
    ).where(
        (F.col("_r.rank") >= F.col("_before")) & (F.col("_r.rank") < F.col("_before") + F.col("_bn"))
    ).select(*keys, "_band", "_before", F.col("_w.p").alias("_p"), F.col("_w.frac").alias("_frac"),
             F.col("_r.side").alias("_side"), F.col("_r.rank").alias("_rank"))
    opened = counted.join(wanted.select(*keys, "_band").distinct(), [*keys, "_band"], "left_semi")
    in_band = Window.partitionBy(*keys, "_band").orderBy("_v")
    ranked = opened.withColumn("_upto", F.sum("_n").over(in_band)).withColumn(
        "_from", F.col("_upto") - F.col("_n"))
    hit = wanted.join(ranked, [*keys, "_band"]).where(
        (F.col("_rank") - F.col("_before") >= F.col("_from"))
        & (F.col("_rank") - F.col("_before") < F.col("_upto"))
    )
    out = []
    for p in points:
        at = F.col("_p") == F.lit(p)
        low = F.max(F.when(at & (F.col("_side") == "low"), F.col("_v")))
        high = F.max(F.when(at & (F.col("_side") == "high"), F.col("_v")))
        frac = F.max(F.when(at, F.col("_frac")))
        out.append((low * (1 - frac) + high * frac).alias(percentile_name(p)))
    return hit.groupBy(*keys).agg(*out)


def case_map(key: Column, mapping: dict, default=None) -> Column:
    """A literal lookup as one CASE expression."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == F.lit(k), F.lit(v)) if expr is None else expr.when(key == F.lit(k), F.lit(v))
    return expr if default is None else expr.otherwise(F.lit(default))
