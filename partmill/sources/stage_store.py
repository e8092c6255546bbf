"""Stage tables with replace-by-product writes and cascading invalidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Writing a stage invalidates what was derived from it.
DOWNSTREAM = {
    "sources": ["documents", "chunks", "attributes", "normalized", "validations", "open_reviews"],
    "documents": ["chunks", "attributes", "normalized", "validations", "open_reviews"],
    "attributes": ["normalized", "validations", "open_reviews"],
    "classifications": ["attributes", "normalized", "validations"],
    "normalized": ["validations", "open_reviews"],
    "validations": [],
}


def replace_rows(old: DataFrame, batch: DataFrame, key: str = "product_id") -> DataFrame:
    """New table content: the batch's products are replaced, all others kept."""
    return old.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def invalidate(old: DataFrame, batch: DataFrame, key: str = "product_id") -> DataFrame:
    return old.join(batch.select(key).distinct(), key, "left_anti")


class StageStore:
    """Parquet tables partitioned by a hash bucket of product_id.

    A write rewrites only the buckets its products fall into (dynamic partition
    overwrite), so cost follows the batch and not the table.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _bucket(self):
        return F.pmod(F.xxhash64("product_id"), F.lit(self.buckets)).cast("int")

    def read(self, table: str, schema: T.StructType | None = None) -> DataFrame:
        reader = self.spark.read
        if schema is not None:
            reader = reader.schema(T.StructType(schema.fields + [T.StructField("bucket", T.IntegerType())]))
        return reader.parquet(self.path(table)).drop("bucket")

    def _write(self, df: DataFrame, table: str) -> None:
        # Rows of a bucket may exceed one task: AQE splits the rebalanced partitions.
        (df.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path(table)))

    def append(self, table: str, batch: DataFrame) -> None:
        batch.withColumn("bucket", self._bucket()).write.mode("append").partitionBy("bucket").parquet(self.path(table))

    def replace(self, table: str, batch: DataFrame, cascade: bool = True) -> None:
        """Replace the batch's products and drop them from every downstream table.

        The batch is written to shared storage first: the table may be among its inputs.
        """
        from ..scale import materialize
        batch = materialize(batch, f"batch-{table}")
        keys = batch.select("product_id").distinct()
        touched = [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]
        for name in DOWNSTREAM.get(table, []) if cascade else []:
            if self.exists(name):
                self._rewrite(name, None, keys, touched)
        self._rewrite(table, batch, keys, touched)

    def _rewrite(self, table: str, batch: DataFrame | None, keys: DataFrame, touched: list[int]) -> None:
        if not self.exists(table):
            if batch is not None:
                self._write(batch, table)
            return
        from ..scale import materialize
        stored = self.spark.read.parquet(self.path(table))
        kept = stored.where(F.col("bucket").isin(touched)).drop("bucket").join(keys, "product_id", "left_anti")
        kept = materialize(kept, f"kept-{table}")
        content = kept if batch is None else kept.unionByName(batch, allowMissingColumns=True)
        self._write(content, table)
        if batch is None:
            self._clear_emptied(table, content, touched)

    def _clear_emptied(self, table: str, content: DataFrame, touched: list[int]) -> None:
        """Dynamic overwrite leaves a partition alone when it gets no row; remove those."""
        filled = {r[0] for r in content.select(self._bucket().alias("b")).distinct().collect()}
        conf = self.spark._jsc.hadoopConfiguration()
        for bucket in set(touched) - filled:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/bucket={bucket}")
            path.getFileSystem(conf).delete(path, True)
